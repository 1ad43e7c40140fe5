import random

import pytest


def prose(rng, n):
    stems = ["the", "of", "and", "re", "ti", "on", "ing", "er", "ha", "ou", "é", "ñ", "ß"]
    words = ["".join(rng.choices(stems, k=rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", " ", ", ", ".\n"]) for w in words)


@pytest.fixture(scope="session")
def rows():
    """Ordinary and awkward documents: null, empty, blanks, odd white space, long, copies, near copies, a null id, repeated rows."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(120)]
    texts += [None, "", " ", "  \n ", "\n\n", "a", "A  b\tC　d e\x85f\x1cg", "x" * 5000, "▁ ▁▁a ▁", "<|endoftext|> a <|im_end|>", "日本語 テキスト 🙂🙂 ​", prose(rng, 9000)]
    texts += [texts[0]] * 25 + [texts[1].replace("the", "then", 1), texts[2] + " more"]
    texts += [f"{t}\nShared  line HERE " for t in texts[20:40] if t]
    out = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, "no id", None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
