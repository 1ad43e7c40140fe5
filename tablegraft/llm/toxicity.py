"""Operator 5: toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding joins four hashed parts: two of the whole word by independent hashes, one of its first four and one of its
first six characters. Filters of one, two and three words slide over a text, the greatest response of each filter feeds a
logistic output. All of it is trained in numpy on a bounded sample of labelled rows (`max_rows`, by a hash of the id, of texts
of at most `max_bytes` bytes and `total_bytes` together); parts of embeddings that too few sample rows hold stay zero. A quarter
of the sample is
kept from training and used to calibrate a threshold for each language, which is guessed from the text's function words; the
score is shifted by language so that its threshold stands at 0.7.

Only the text makes the score; labels of rows with crc32(id) mod 3 = 1 are never read. Null text counts as empty, which has
the score of a text without any response. Labels that are null or of unknown ids are skipped, of repeated labels the larger
counts, of repeated ids with several texts the one with the least hash is learned. Without both classes in the sample every score is 0. Repeated rows get equal scores; an empty table gives an empty
result; clashing columns of the input stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, col, crc_mod, raw, slices

PART, WIDTHS, FILTERS = 4, (1, 2, 3), (12, 4, 4)
SIZES = (1 << 18, 1 << 18, 1 << 16, 1 << 16)
LEAST_DOCS = 5
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to that with for this was are by it",
    "fr": "le la les des et dans que pour une est pas avec",
    "de": "der die das und den mit nicht von ein eine zu auf",
    "es": "el los las que y del para por con se una no",
}
_PUNCT = bytes(x for x in range(33, 127) if not chr(x).isalnum())
_SPLIT = bytes.maketrans(_PUNCT, b" " * len(_PUNCT))
_LANG = {w.encode(): k + 1 for k, ws in reversed(list(enumerate(FUNCTION_WORDS.values()))) for w in ws.split()}


def tokens(data: bytes) -> list[bytes]:
    return data.translate(LOWER).translate(_SPLIT).split()


def places(word: bytes) -> tuple[int, int, int, int]:
    """Rows of the embedding's four parts."""
    text = word.decode("utf-8", "replace")
    a, b = text[:4].encode(), text[:6].encode()
    return xxhash.xxh32_intdigest(word, 1) % SIZES[0], xxhash.xxh32_intdigest(word, 2) % SIZES[1], xxhash.xxh32_intdigest(a, 3) % SIZES[2], xxhash.xxh32_intdigest(b, 4) % SIZES[3]


class Words(dict):
    """Numbers words from 1 on; 0 stands between texts."""

    def __missing__(self, word):
        self[word] = n = len(self) + 1
        return n


def _join(docs: list[list[bytes]], index: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts (one zero for a text without words), each followed by as many zeros as the widest filter needs,
    and where each starts."""
    pad = [0] * (max(WIDTHS) - 1) or [0]
    out, starts, at = [], [], 0
    for words in docs:
        ids = np.fromiter(map(index.__getitem__, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
        out += [ids, np.array(pad, np.int32)]
        starts.append(at)
        at += len(ids) + len(pad)
    return np.concatenate(out), np.array(starts, np.int64)


class Net:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = PART * len(SIZES)
        self.tables = [np.zeros((n, PART), np.float32) for n in SIZES]
        self.filters = [rng.normal(0, 0.15, (w, d, f)).astype(np.float32) for w, f in zip(WIDTHS, FILTERS, strict=True)]
        for k in range(FILTERS[0] // 2):  # half of the one-word filters start on the parts' evidence for the label
            self.filters[0][0, 0::PART, k] += 0.5
        self.bias = np.full(sum(FILTERS), -0.5, np.float32)
        self.out = np.full(sum(FILTERS), 0.1, np.float32)
        self.out[: FILTERS[0] // 2] = 0.5
        self.shift = np.float32(-2)
        self.thresholds: list[float] = [0.0] * (len(FUNCTION_WORDS) + 1)
        self.slope = 1.0
        self.blank = False

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([t[rows[:, k]] for k, t in enumerate(self.tables)], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Each word's part in every filter at every position, side by side."""
        return np.concatenate([x @ f[j] for f in self.filters for j in range(len(f))], axis=1)

    def responses(self, parts: np.ndarray) -> np.ndarray:
        """Filter responses by position, from projected words in order."""
        out, at = [], 0
        for w, f in zip(WIDTHS, FILTERS, strict=True):
            r = parts[:, at : at + f].copy()
            for j in range(1, w):
                r[:-j] += parts[j:, at + j * f : at + (j + 1) * f]
            out.append(r)
            at += w * f
        return np.concatenate(out, axis=1)

    def logits(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top + self.bias, 0) @ self.out + self.shift

    def fit(self, rows: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 128, seed: int = 3) -> None:
        """rows: of each word, word 0 first; docs: word numbers."""
        rng = np.random.default_rng(seed)
        prior = labels.mean()
        self.shift = np.float32(np.log(prior / (1 - prior)) - 1)
        live = []
        for k, table in enumerate(self.tables):
            n = np.zeros((2, len(table)), np.float64)
            for ids, y in zip(docs, labels, strict=True):
                n[y, np.unique(rows[ids, k])] += 1
            odds = np.log((n[1] + 0.3) / (labels.sum() + 0.6)) - np.log((n[0] + 0.3) / ((1 - labels).sum() + 0.6))
            held = n.sum(0) >= LEAST_DOCS
            live.append(held)
            table[held] = rng.normal(0, 0.05, (int(held.sum()), PART))
            table[:, 0] = np.where(held, odds.clip(-3, 3) / 2, 0)
            table[rows[0, k]] *= bool(held[rows[0, k]])
        params = {"bias": self.bias, "out": self.out, **{f"f{k}": f for k, f in enumerate(self.filters)}}
        m, v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
        squares = [np.full(len(t), 1e-3, np.float32) for t in self.tables]
        pad, step = np.zeros(max(WIDTHS) - 1, np.int32), 0
        docs = [x if len(x) else np.zeros(1, np.int32) for x in docs]
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                ids = np.concatenate([x for i in own for x in (docs[i], pad)])
                ends = np.cumsum([len(docs[i]) + len(pad) for i in own])
                x = self.embed(rows[ids])
                x[ids == 0] = 0
                r = self.responses(self.project(x))
                best = np.stack([a + r[a : b - len(pad)].argmax(axis=0) for a, b in zip([0, *ends[:-1]], ends, strict=True)])
                top = np.take_along_axis(r, best, axis=0)
                hidden = np.maximum(top + self.bias, 0)
                p = 1 / (1 + np.exp(-(hidden @ self.out + self.shift).clip(-30, 30)))
                d = ((p - labels[own]) / len(own)).astype(np.float32)
                self.shift -= np.float32(0.5 * d.sum())
                dh = d[:, None] * self.out * (hidden > 0)
                g = {"out": hidden.T @ d, "bias": dh.sum(0)}
                dx: dict[int, np.ndarray] = {}
                at_f = 0
                touched, grads = [], []
                for k, f in enumerate(self.filters):
                    w, _, n = f.shape
                    own_best, own_d = best[:, at_f : at_f + n], dh[:, at_f : at_f + n]
                    gf = np.zeros_like(f)
                    for j in range(w):
                        pos = np.minimum(own_best + j, len(ids) - 1)
                        gf[j] = np.einsum("bnd,bn->dn", x[pos], own_d)
                        touched.append(pos.reshape(-1))
                        grads.append((own_d[:, :, None] * f[j].T[None]).reshape(-1, f.shape[1]))
                    g[f"f{k}"] = gf + 1e-5 * f
                    at_f += n
                step += 1
                rate = 0.01 * (1 - epoch / epochs)
                for k, q in params.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    q -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
                pos, dxs = np.concatenate(touched), np.concatenate(grads)
                used = (np.abs(dxs).sum(1) > 0) & (ids[pos] > 0)
                pos, dxs = pos[used], dxs[used]
                for k, table in enumerate(self.tables):
                    to, part = rows[ids[pos], k], dxs[:, k * PART : (k + 1) * PART]
                    ok = live[k][to]
                    to, part = to[ok], part[ok]
                    uniq, inverse = np.unique(to, return_inverse=True)
                    total = np.zeros((len(uniq), PART), np.float32)
                    np.add.at(total, inverse, part)
                    squares[k][uniq] += (total**2).sum(1)
                    table[uniq] -= 0.05 * total / np.sqrt(squares[k][uniq])[:, None]
                del dx

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, langs: np.ndarray, least: int = 8) -> None:
        """The middle of the best thresholds by F1 (a beta of 0.7 weighs precision) over all, then for each language."""

        def best(s, y):
            order = np.argsort(-s)
            s, y = s[order], y[order]
            hits = np.cumsum(y)
            f = 1.49 * hits / (0.49 * max(1, y.sum()) + np.arange(1, len(y) + 1))
            f[:-1][s[:-1] == s[1:]] = -1
            top = np.flatnonzero(f >= f.max() - 1e-9)
            k = int(top[-1])
            return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 0.5)

        general = best(logits, labels)
        self.thresholds = [best(logits[langs == k], labels[langs == k]) if labels[langs == k].sum() >= least else general for k in range(len(self.thresholds))]
        z = logits - np.array(self.thresholds)[langs]

        def loss(slope):
            return np.mean(np.logaddexp(0, -(2 * labels - 1) * (slope * z + np.log(0.7 / 0.3))))

        self.slope = float(min((0.25, 0.5, 0.75, 1, 1.5, 2, 3), key=loss))

    def scores(self, logits: np.ndarray, langs: np.ndarray) -> np.ndarray:
        if self.blank:
            return np.zeros(len(logits))
        z = self.slope * (logits - np.array(self.thresholds)[langs]) + np.log(0.7 / 0.3)
        return 1 / (1 + np.exp(-z.clip(-50, 50)))


class Scorer:
    """Applies a net to texts; each distinct word is projected once for a worker."""

    def __init__(self, net: Net, limit: int = 150_000):
        self.net, self.limit = net, limit
        self.clear()

    def clear(self) -> None:
        self.index, self.parts = Words(), np.zeros((1, sum(w * f for w, f in zip(WIDTHS, FILTERS, strict=True))), np.float32)
        self.langs, self.n = np.zeros(1, np.int8), 1

    def known(self) -> None:
        new = list(self.index)[self.n - 1 :]
        if not new:
            return
        if self.n + len(new) > len(self.parts):
            more = max(2 * len(self.parts), self.n + len(new))
            self.parts, self.langs = (np.concatenate([a, np.zeros((more - len(a),) + a.shape[1:], a.dtype)]) for a in (self.parts, self.langs))
        rows = np.array(list(map(places, new)), np.int64)
        self.parts[self.n : self.n + len(new)] = self.net.project(self.net.embed(rows))
        self.langs[self.n : self.n + len(new)] = [_LANG.get(w, 0) for w in new]
        self.n += len(new)

    def logits(self, datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.limit:
            self.clear()
        docs = [tokens(x) for x in datas]
        ids, starts = _join(docs, self.index)
        self.known()
        top, langs = [], []
        ends = [*starts[1:], len(ids)]
        at = 0
        while at < len(starts):  # so many words at a time that the responses stay small
            to = at + 1
            while to < len(starts) and ends[to] - starts[at] < 1 << 17:
                to += 1
            own = ids[starts[at] : ends[to - 1]]
            first = starts[at:to] - starts[at]
            if len(own) > 1 << 18:
                got = self._long(own)
            else:
                last = np.array(ends[at:to]) - starts[at] - (max(WIDTHS) - 1)  # no response begins at a zero after the text
                got = np.maximum.reduceat(self.net.responses(self.parts[own]), np.stack([first, last], axis=1).reshape(-1), axis=0)[::2]
            top.append(got)
            for a, b in zip(starts[at:to], ends[at:to], strict=True):
                n = np.bincount(self.langs[ids[a:b]], minlength=len(FUNCTION_WORDS) + 1)[1:]
                langs.append(int(n.argmax()) + 1 if n.any() else 0)
            at = to
        return self.net.logits(np.concatenate(top)), np.array(langs)

    def _long(self, own: np.ndarray) -> np.ndarray:
        """One long text, in windows that overlap by the widest filter."""
        step, over = 1 << 17, max(WIDTHS) - 1
        n = len(own) - over  # no response begins at the zeros after the text
        return np.max([self.net.responses(self.parts[own[a : a + step + over]])[: min(step, n - a)].max(axis=0) for a in range(0, n, step)], axis=0)[None]


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 8000, max_bytes: int = 1 << 20, total_bytes: int = 96 << 20) -> pa.Table:
    """(label, text) of at most max_rows labelled rows outside the held-out third, with total_bytes of text at most."""
    rows = labels.where(col(label).isNotNull() & col(doc_id).isNotNull()).select(col(doc_id).alias("id"), col(label).cast("int").alias("label")).where(crc_mod("id", 3) != 1)
    known = rows.groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(col(doc_id).alias("id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text")).withColumn("body", F.xxhash64("text"))
    sized = texts.select("id", F.struct("body", F.octet_length("text").alias("size")).alias("one")).where(F.col("one.size") <= max_bytes)
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    chosen = sized.join(known, "id").groupBy("id", "label").agg(F.min("one").alias("one")).select("id", "label", "one.*").orderBy(*order).limit(max_rows)
    within = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # of max_rows rows at most
    chosen = chosen.withColumn("sum", within).where(F.col("sum") <= total_bytes).select("id", "label", "body")
    return texts.join(F.broadcast(chosen), ["id", "body"]).dropDuplicates(["id"]).orderBy(*order).select("label", "text").toArrow()


def train(rows: pa.Table) -> Net:
    net, index = Net(), Words()
    labels = rows.column(0).to_numpy().astype(np.int64)
    if not len(labels) or labels.min() == labels.max():
        net.blank = True
        return net
    docs = [np.fromiter(map(index.__getitem__, tokens(x)), np.int32) for chunk in rows.column(1).chunks for x in raw(chunk)]
    at = np.array([(0, 0, 0, 0), *map(places, index)], np.int64)
    own = np.arange(len(docs)) % 4 != 3
    if not 0 < labels[own].sum() < own.sum() or not 0 < labels[~own].sum() < (~own).sum():
        own[:] = True
    net.fit(at, [d for d, o in zip(docs, own, strict=True) if o], labels[own])
    rest = np.flatnonzero(~own) if not own.all() else np.arange(len(docs))
    texts = [raw(rows.column(1).slice(int(i), 1).chunk(0))[0] for i in rest]
    scorer = Scorer(net)
    got = [scorer.logits(texts[k : k + 256]) for k in range(0, len(texts), 256)]
    net.calibrate(np.concatenate([g[0] for g in got]), labels[rest], np.concatenate([g[1] for g in got]))
    return net


def model(docs: DataFrame, labels: DataFrame, **kwargs) -> Net:
    return train(sample(docs, labels, **kwargs))


_scorers: dict = {}


def with_score(docs: DataFrame, net: Net, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each whole text."""
    import uuid

    shared, key = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex

    def run(column: pa.Array) -> pa.Array:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        scorer, out = _scorers[key], []
        for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0, 2 << 20):
            logits, langs = scorer.logits(raw(part.column(0)))
            out.append(scorer.net.scores(logits, langs))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn(name, F.arrow_udf(run, "double")(col(text).cast("string")))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    net = model(docs, labels, doc_id=doc_id, text=text)
    narrow = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")).withColumn("held_out", crc_mod("doc_id", 3) == 1)
    return with_score(narrow, net).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
