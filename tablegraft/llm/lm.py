"""Operator 3: language-model scores from a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end for each text. The most frequent words have vectors of their own; their number grows
with the training tokens (one for each WORDS_FOR tokens, as a power of two, up to `most_words`). All other words are one symbol to
the network, within which a word has its smoothed share of their tokens, and so words that training never saw keep a share.
A token's symbol is predicted from the word before it and the group of the word before that (the GROUPS - 2 most frequent words,
any other word, none): P(token | context) = P(symbol | context) x P(word | symbol), both factors normalised.

What is learned comes from all training texts: counts of all tokens, which stay a distributed table, and every token as a triple of
group, word and word, by noise-contrastive estimation in numpy. Up to `draws` tokens, the driver trains on all triples. Beyond, it
only makes a start, from `draws` of them in proportion to their counts; tasks then train on every token of every training text, once
each: in each of ROUNDS rounds all tasks begin with the same network and take their share of the texts, and the mean of what they make, by
tokens learned, is the next round's network. Means are made in pieces, so that neither a task nor the driver holds all networks.
Normalisers of all contexts then come from batched matrix products, spread over tasks; a token's log-probability is a product of two
vectors less its context's normaliser.

The count of every token has to reach every text that holds it. Texts are dealt into blocks of bounded size; a block sends
each distinct token once with its own count, the sums go back to the block, and texts are read beside them. Counts of frequent
words don't take that way: they are broadcast, so that no key has many rows in one task. A token is never sent for each text or
each occurrence, and no task holds a vocabulary that grows with the input.

Tokens are told apart by 64 bits. Null text counts as empty: one token, the end; a null id counts as the empty text in the choice
of training rows. Repeated rows count each on their own, and are dealt into different blocks. With no training rows every symbol
is as likely as any other. An empty table gives an empty result. Other columns than the two named are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, col, materialise, raw, shared_dir, slices, with_block, words

WORDS_FOR, MOST_WORDS, DIM, GROUPS = 2048, 16384, 32, 32
DRAWS = 1 << 22
ROUNDS, PIECE = 4, 1 << 12
TASKS, BLOCKS_A_TASK = 8, 8  # tasks of a round: so many, or more where each would have more blocks
BUCKETS = 20_000  # a bucket holds several blocks beyond; Spark's own limit is 100,000
END = b"\n"  # no word holds it


def key_of(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, 11)


END_KEY = np.uint64(key_of(END)).view(np.int64).item()


def keys_of(tokens) -> np.ndarray:
    return np.fromiter(map(key_of, tokens), np.uint64, len(tokens)).view(np.int64)


class Index(dict):
    """Numbers tokens as they come."""

    def __missing__(self, token):
        self[token] = n = len(self)
        return n

    def of(self, tokens: list[bytes]) -> np.ndarray:
        out = np.empty(len(tokens) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))
        out[-1] = self[END]
        return out


class Symbols:
    """The symbol of each token key: the end is 0, frequent words follow by frequency, all others are the last one, `rare`. As a
    context, `start` stands before a text."""

    def __init__(self, heads: np.ndarray, counts: np.ndarray):
        self.order = np.argsort(heads)
        self.heads, self.counts = heads[self.order], counts
        self.rare, self.start = len(heads), len(heads) + 1

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.heads, keys), len(self.heads) - 1)
        return np.where(self.heads[at] == keys, self.order[at], self.rare).astype(np.int32)

    def contexts(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group two tokens back, symbol one token back) of each token of a text."""
        before = np.concatenate([[self.start, self.start], symbols[:-1]])
        groups = np.where(before[:-1] == self.start, GROUPS - 1, np.minimum(before[:-1], GROUPS - 2))
        return groups.astype(np.int32), before[1:].astype(np.int32)

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        groups, last = self.contexts(symbols)
        return (groups.astype(np.int64) * (self.start + 1) + last) * (self.rare + 1) + symbols

    def split(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        context, symbol = np.divmod(codes, self.rare + 1)
        groups, last = np.divmod(context, self.start + 1)
        return groups, last, symbol


@dataclass
class Network:
    """Vectors of the last word, of the group before it, and of the predicted symbol with its bias; normalisers by context."""

    last: np.ndarray
    group: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    log_z: np.ndarray | None = None
    seen: list[np.ndarray] | None = None  # sums of squared gradients of the four above, by row

    @classmethod
    def start(cls, unigram: np.ndarray, rng: np.random.Generator) -> Network:
        """Symbols are as likely as they are frequent."""
        n = len(unigram)
        net = cls(rng.normal(0, 0.3, (n + 1, DIM)).astype(np.float32), rng.normal(0, 0.3, (GROUPS, DIM)).astype(np.float32), np.zeros((n, DIM), np.float32), np.log(unigram).astype(np.float32))
        net.seen = [np.full(p.shape[:1] + (1,) * (p.ndim - 1), 1e-2, np.float32) for p in net.learned()]
        return net

    def learned(self) -> list[np.ndarray]:
        return [self.last, self.group, self.target, self.bias]

    def flat(self) -> np.ndarray:
        """All that training moves, as one vector."""
        return np.concatenate([x.ravel() for x in (*self.learned(), *self.seen)])

    def like(self, flat: np.ndarray) -> Network:
        """A network of this one's shape from such a vector."""
        own = [*self.learned(), *self.seen]
        parts = np.split(flat, np.cumsum([x.size for x in own])[:-1])
        made = [x.astype(np.float32).reshape(y.shape) for x, y in zip(parts, own, strict=True)]
        return Network(*made[:4], seen=made[4:])

    def normalisers(self, last: np.ndarray) -> np.ndarray:
        """Natural logarithms of the sums over all symbols, for these words in each group."""
        out = np.empty((len(last), GROUPS), np.float32)
        step = max(1, (1 << 23) // (len(self.bias) * GROUPS))
        for at in range(0, len(last), step):
            contexts = (self.last[last[at : at + step], None] + self.group[None]).reshape(-1, DIM)
            s = contexts @ self.target.T + self.bias
            most = s.max(axis=1, keepdims=True)
            out[at : at + step] = (np.log(np.exp(s - most).sum(axis=1)) + most[:, 0]).reshape(-1, GROUPS)
        return out

    def log10(self, groups: np.ndarray, last: np.ndarray, symbols: np.ndarray, part: int = 1 << 16) -> np.ndarray:
        out = np.empty(len(symbols), np.float64)
        for at in range(0, len(symbols), part):
            g, w, s = (x[at : at + part] for x in (groups, last, symbols))
            out[at : at + part] = np.einsum("nd,nd->n", self.last[w] + self.group[g], self.target[s]) + self.bias[s] - self.log_z[w, g]
        return out / np.log(10)


def _sums(rows: np.ndarray, gradients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sums of their gradients."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(gradients[order], first, axis=0)


class Noise:
    """Noise is the symbols' own frequency; `step` moves a network by one batch of (group, last word, symbol)."""

    def __init__(self, unigram: np.ndarray, each: int, rng: np.random.Generator):
        self.each, self.rng, self.ends = each, rng, np.cumsum(unigram)
        self.odds = (np.log(each) + np.log(unigram)).astype(np.float32)

    def step(self, net: Network, g: np.ndarray, w: np.ndarray, s: np.ndarray, scale: float) -> None:
        odds, ends = self.odds, self.ends
        other = np.minimum(np.searchsorted(ends, self.rng.random(self.each) * ends[-1], side="right"), len(ends) - 1)
        q = net.last[w] + net.group[g]
        true = np.einsum("nd,nd->n", q, net.target[s]) + net.bias[s] - odds[s]
        false = q @ net.target[other].T + net.bias[other] - odds[other]
        dt = (-1 / (1 + np.exp(true.clip(-30, 30)))).astype(np.float32)  # of -log sigmoid(true)
        df = (1 / (1 + np.exp(-false.clip(-30, 30)))).astype(np.float32)  # of -log sigmoid(-false)
        dq = dt[:, None] * net.target[s] + df @ net.target[other]
        symbols = np.concatenate([s, other])
        dtarget = np.concatenate([dt[:, None] * q, df.T @ q])
        last, group, target, bias = zip(net.learned(), net.seen, strict=True)
        self.move(*target, symbols, dtarget, scale)
        self.move(*bias, symbols, np.concatenate([dt, df.sum(axis=0)]), scale * 0.5)
        self.move(*last, w, dq, scale)
        self.move(*group, g, dq, scale)

    @staticmethod
    def move(p: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradients: np.ndarray, scale: float) -> None:
        rows, total = _sums(rows, gradients)
        squares[rows] += (total**2).mean(axis=1, keepdims=True) if p.ndim > 1 else total**2
        p[rows] -= scale * total / np.sqrt(squares[rows])


def train(triples: tuple[np.ndarray, np.ndarray, np.ndarray], unigram: np.ndarray, epochs: int = 2, batch: int = 2048, noise: int = 96, rate: float = 0.12, seed: int = 7) -> Network:
    """A network from (group, last word, symbol) draws by noise-contrastive estimation. It starts from the symbols' frequencies:
    without draws it stays there."""
    rng = np.random.default_rng(seed)
    net = Network.start(unigram, rng)
    sampler, s_all = Noise(unigram, noise, rng), triples[2]
    steps, step = max(1, epochs * -(-len(s_all) // batch)), 0
    for _ in range(epochs if len(s_all) else 0):
        order = rng.permutation(len(s_all))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sampler.step(net, *(x[own] for x in triples), rate * min(1.0, 1.5 * (1 - step / steps)))
            step += 1
    return net


def _own_counts(blocked: DataFrame) -> DataFrame:
    """(block, key, n): each distinct token of a block with its count in the block's training texts."""

    def count(table: pa.Table) -> pa.Table:
        from collections import Counter

        learned, held, block = Counter(), set(), table.column("block")[0].as_py()
        for batch in table.select(["held_out", "text"]).to_batches():
            for part in slices(batch, 1):
                for h, data in zip(part.column(0).to_pylist(), raw(part.column(1)), strict=True):
                    own = words(data)
                    own.append(END)
                    if h:
                        held.update(own)
                    else:
                        learned.update(own)
        held.difference_update(learned)
        keys = np.concatenate([keys_of(learned), keys_of(held)])
        n = np.concatenate([np.fromiter(learned.values(), np.int64, len(learned)), np.zeros(len(held), np.int64)])
        return pa.table({"block": pa.array(np.full(len(keys), block, np.int32)), "key": keys, "n": n})

    return blocked.groupBy("block").applyInArrow(count, "block int, key long, n long")


def frequent(own: DataFrame, tokens: int, most_words: int, words_for: int) -> Symbols:
    """The symbols, with the exact counts of frequent words, which are those of the largest sums over all blocks. Sums over the blocks
    where a word is more than a few lack a known amount at most: words that may be among the largest by these are summed over all
    blocks, or all words where the amount is too large to tell."""
    room = 1
    while room < most_words and 2 * room * words_for <= tokens:
        room *= 2
    blocks = own.agg(F.max("block")).first()[0]
    few = 0 if blocks is None else tokens // (64 * room * (blocks + 1))

    def often(few: int) -> tuple[DataFrame, int, int]:
        sums = materialise(own.where((F.col("n") > few) & (F.col("key") != END_KEY)).groupBy("key").agg(F.sum("n").alias("n")), "often")
        return sums, *sums.orderBy(F.desc("n")).limit(room - 1).agg(F.count("*"), F.coalesce(F.min("n"), F.lit(0))).first()

    lacking = few * (1 + (blocks or 0))
    sums, found, least = often(few)
    if few and (found < room - 1 or least <= lacking):
        lacking, (sums, found, least) = 0, often(0)
    near = [r.key for r in sums.where(F.col("n") >= least - lacking).collect()]
    heads = own.sparkSession.createDataFrame([(k,) for k in [END_KEY, *near]], "key long")
    exact = {r.key: r.n for r in own.join(F.broadcast(heads), "key").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    ordered = [END_KEY, *sorted(near, key=lambda k: (-exact[k], k))[: room - 1]]
    return Symbols(np.array(ordered, np.int64), np.array([exact.get(k, 0) for k in ordered], np.int64))


def _codes(batches, of: Symbols, most: int, limit: int = 400_000):
    """Lists of the codes of texts, of a little over `most` tokens each; known tokens are forgotten beyond `limit`."""
    index, known, held, size = Index(), np.zeros(0, np.int32), [], 0
    for batch in batches:
        for part in slices(batch, 0):
            if len(index) > limit:
                index, known = Index(), np.zeros(0, np.int32)
            for ids in [index.of(words(data)) for data in raw(part.column(0))]:
                if len(known) < len(index):
                    known = np.concatenate([known, of.of(keys_of(list(index)[len(known) :]))])
                held.append(of.codes(known[ids]))
                size += len(ids)
            if size > most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _triples(docs: DataFrame, symbols) -> DataFrame:
    """(code, n) of all triples in training texts."""

    def table(parts: list[np.ndarray]):
        codes, n = np.unique(np.concatenate(parts), return_counts=True)
        for k in range(0, len(codes), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(codes[k : k + (1 << 18)]), pa.array(n[k : k + (1 << 18)])], names=["code", "n"])

    def run(batches):
        for held in _codes(batches, symbols.value, 1 << 22):
            yield from table(held)

    return docs.where(~F.col("held_out")).select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def drawn(triples: DataFrame, tokens: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, how often): about `draws` draws from all triples in proportion to their counts, for the start of the training; all triples
    where there are no more."""
    share = min(1.0, draws / max(1, tokens))
    chance = F.pmod(F.xxhash64("code"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = triples.select("code", F.floor(F.col("n") * F.lit(share) + chance).cast("int").alias("k")).where("k > 0").toArrow()
    codes, k = rows.column("code").to_numpy(), rows.column("k").to_numpy()
    order = np.argsort(codes)
    return codes[order], k[order]


def passed(blocked: DataFrame, blocks: int, symbols, net: Network, unigram: np.ndarray, batch: int = 2048, noise: int = 64, rate: float = 0.12, seed: int = 11) -> Network:
    """The network after every token of every training text has been learned once, a round's texts by all tasks beside each other."""
    spark = blocked.sparkSession
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((net, unigram))
        scale = rate * (1 - turn / ROUNDS)

        def learn(batches, shared=shared, scale=scale, turn=turn):
            own, unigram = shared.value
            rng, tokens = np.random.default_rng([seed, turn, TaskContext.get().partitionId()]), 0
            own, sampler = own.like(own.flat()), Noise(unigram, noise, rng)
            for held in _codes(batches, symbols.value, 1 << 18, 100_000):
                codes = rng.permutation(np.concatenate(held))
                for at in range(0, len(codes), batch):
                    sampler.step(own, *symbols.value.split(codes[at : at + batch]), scale)
                tokens += len(codes)
            flat = own.flat() if tokens else np.zeros(0, np.float32)
            for at in range(0, len(flat), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([at // PIECE], pa.int32()), pa.array([tokens], pa.int64()), pa.array([flat[at : at + PIECE].tobytes()], pa.binary())], names=["piece", "n", "part"])

        def mean(table: pa.Table) -> pa.Table:
            n = table.column("n").to_numpy()
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) * k for x, k in zip(table.column("part").to_pylist(), n.tolist(), strict=True))
            return pa.table({"piece": table.column("piece")[:1], "part": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})

        made = blocked.where(~F.col("held_out") & (F.col("turn") == turn)).select("text").coalesce(max(TASKS, -(-blocks // BLOCKS_A_TASK))).mapInArrow(learn, "piece int, n long, part binary")
        pieces = sorted(made.groupBy("piece").applyInArrow(mean, "piece int, part binary").collect(), key=lambda r: r.piece)
        if pieces:
            net = net.like(np.frombuffer(b"".join(r.part for r in pieces), np.float32))
        shared.unpersist()
    return net


def _normalised(spark: SparkSession, net: Network, step: int = 64) -> Network:
    """The network with the normalisers of all contexts, which tasks make from batched matrix products."""
    n = len(net.last)
    shared, blocks = spark.sparkContext.broadcast(net), -(-n // step)

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                last = np.arange(block * step, min(n, (block + 1) * step))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shared.value.normalisers(last).tobytes()], pa.binary())], names=["block", "z"])

    rows = spark.range(0, blocks, 1, min(blocks, 64)).mapInArrow(run, "block long, z binary").collect()
    z = b"".join(r.z for r in sorted(rows, key=lambda r: r.block))
    return Network(net.last, net.group, net.target, net.bias, np.frombuffer(z, np.float32).reshape(n, GROUPS))


def score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1, block_bytes: int = 24 << 20, most_words: int = MOST_WORDS, words_for: int = WORDS_FOR, draws: int = DRAWS,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    spark = docs.sparkSession
    narrow = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text")).withColumn("held_out", crc_mod("doc_id", folds) == held_fold)
    blocked, blocks = with_block(narrow, "text", block_bytes, "block", BUCKETS)
    blocked = blocked.withColumn("turn", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit("turn")), F.lit(ROUNDS)).cast("byte"))
    # Buckets by block: the two reads below need the texts of a block together, and neither shuffles them again.
    name, buckets = f"blocks_{uuid.uuid4().hex}", min(blocks, BUCKETS)
    try:
        blocked.repartition(buckets, "block").write.bucketBy(buckets, "block").format("parquet").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        return materialise(_scored(spark, spark.table(name), blocks, narrow, most_words, words_for, draws), "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _scored(spark: SparkSession, blocked: DataFrame, blocks: int, narrow: DataFrame, most_words: int, words_for: int, draws: int) -> DataFrame:
    own = materialise(_own_counts(blocked), "own")
    n_all = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    symbols = frequent(own, n_all, most_words, words_for)
    heads = spark.createDataFrame([(int(k),) for k in symbols.heads], "key long")
    by_key = Window.partitionBy("key")
    counted = materialise(own.join(F.broadcast(heads), "key", "left_anti").select("block", "key", F.sum("n").over(by_key).alias("c"), F.min("block").over(by_key).alias("least")), "counts")
    rare, v_rare = counted.where((F.col("block") == F.col("least")) & (F.col("c") > 0)).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    v_all = v_rare + int((symbols.counts > 0).sum())
    unigram = np.concatenate([symbols.counts, [rare]]) + 0.5
    unigram /= unigram.sum()
    known = spark.sparkContext.broadcast(symbols)
    codes, k = drawn(_triples(narrow, known), n_all, draws)
    net = train(tuple(np.repeat(x, k) for x in symbols.split(codes)), unigram)
    if n_all > draws:
        net = passed(blocked, blocks, known, net, unigram)
    shared = spark.sparkContext.broadcast((symbols, _normalised(spark, net), float(np.log10(rare + 0.5 * (v_rare + 1)))))
    base = np.log10(n_all + 0.5 * (v_all + 1))

    def apply(own: pa.Table, counts: pa.Table) -> pa.Table:
        symbols, net, log_share = shared.value
        index = Index()
        ids = [index.of(words(data)) for batch in own.select(["text"]).to_batches() for part in slices(batch, 0) for data in raw(part.column(0))]
        keys = keys_of(list(index))
        kind = symbols.of(keys)
        known, sums = counts.column("key").to_numpy(), counts.column("c").to_numpy()
        order = np.argsort(known)
        known, sums = known[order], sums[order]
        others = np.flatnonzero(kind == symbols.rare)
        at = np.searchsorted(known, keys[others])
        if len(others) and (at.max() >= len(known) or not np.array_equal(known[at], keys[others])):
            raise ValueError("a block's tokens and counts don't belong together")
        c = np.append(symbols.counts, 0)[kind]
        c[others] = sums[at] if len(others) else 0
        log_c = np.log10(c + 0.5)
        within = np.where(kind < symbols.rare, 0.0, log_c - log_share)
        rows, at = [], 0
        while at < len(ids):  # so many tokens at a time
            to, size = at, 0
            while to < len(ids) and (to == at or size + len(ids[to]) <= 1 << 17):
                size += len(ids[to])
                to += 1
            some = ids[at:to]
            parts = [symbols.contexts(kind[x]) for x in some]
            tokens = np.concatenate(some)
            model = net.log10(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), kind[tokens]) + within[tokens]
            starts = np.cumsum([0, *map(len, some[:-1])])
            lengths = np.array([len(x) for x in some])
            rows += zip(lengths.tolist(), np.add.reduceat((c[tokens] > 0).astype(np.int64), starts).tolist(), (np.add.reduceat(log_c[tokens], starts) - lengths * base).tolist(), np.add.reduceat(model, starts).tolist(), strict=True)
            at = to
        n, n_known, b, s = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table([own.column("doc_id"), own.column("held_out"), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array([n_all] * len(n), pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64())], names=schema.names)

    schema = T.StructType([T.StructField("doc_id", narrow.schema["doc_id"].dataType)]).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return blocked.groupBy("block").cogroup(counted.select("block", "key", "c").groupBy("block")).applyInArrow(apply, schema)
