"""Quality classifier (operator 2): random-indexing word vectors pooled per document, a two-layer network, temperature.

Words are runs of letters, of digits or of other characters; a run of letters is preceded by a word for its shape
(upper case, capitalised) and one for "same as the word before", where that holds. Each word falls in one of `BUCKETS` buckets by hash. A bucket has
a fixed sparse index vector of +1 and -1; its word vector is the sum of the index vectors of its neighbours (two on either
side) over all documents, which needs no labels, scaled to unit length, plus its own index vector. A document is the mean of its words' vectors.

The network (`DIM` inputs, `HIDDEN` tanh units, one logit) is trained by Adam in numpy on the driver, on pooled vectors
only: `FIT_ROWS` rows at most, half for each label, chosen by a hash of the id, from labelled rows whose crc32 of the id isn't
2 modulo 4. The loss weighs the labels as often as they occur among all such rows. A fifth of the sample isn't trained on;
the temperature that divides the logits is the one with the least loss on it.

What travels to executors and to the driver has a fixed size: `BUCKETS` x `DIM` numbers; the tasks' sums are added up in `SLICES` parts. Every row of the input is scored, whole, in one map.

Defined results: a null or empty text, or one without words, scores 0; several labels of one id count as the lowest, null labels as none;
without labelled rows of both kinds the score is the share of label 1 (0.5 without any); a null doc_id isn't held out;
repeated rows are scored one by one; an empty table gives an empty table; other columns are not read (`keep_good`: are returned as they are).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import KIND, PLACE, mix, parts, runs, text_bytes, trimmed
from .shared import table

BITS, DIM, HIDDEN, FIT_ROWS, THRESHOLD, WINDOW = 14, 64, 24, 8000, 0.7, 2
BUCKETS, MOST_PAIRS = 1 << BITS, 4_000_000
#: Pairs that are added at once.
CHUNK = 250_000
#: Buckets of the words for shapes.
UPPER, TITLE, SAME, RESERVED = 0, 1, 2, 8
SLICES = 64


def index_places(buckets: int = BUCKETS, dim: int = DIM, ones: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's index vector has its ones, and their signs, one row for each of them."""
    rng = np.random.default_rng(7)
    places, signs = np.empty((ones, buckets), np.int64), np.empty((ones, buckets), np.float64)
    for k in range(ones):
        places[k] = rng.integers(0, dim, buckets)
        signs[k] = rng.choice(np.float32([-1, 1]), buckets)
    return places, signs


def index_vectors(buckets: int = BUCKETS, dim: int = DIM, ones: int = 6) -> np.ndarray:
    out = np.zeros((buckets, dim), np.float32)
    for place, sign in zip(*index_places(buckets, dim, ones), strict=True):
        out[np.arange(buckets), place] += sign.astype(np.float32)
    return out


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and in all."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, shapes included, and its text's number."""
    data, off = text_bytes(texts)
    h, doc, start, length = runs(data, off, KIND)
    letters = KIND[data[start]] == 1 if len(start) else np.empty(0, bool)
    capital = _before((data >= 65) & (data <= 90))
    upper = capital[start + length] - capital[start]
    further = _before((data & 0xC0) == 0x80)  # bytes of a character after its first
    size = length - (further[start + length] - further[start])
    shout = letters & (upper >= 2) & (upper * 10 >= size * 6)
    title = letters & (upper >= 1) & ~shout
    before = np.full(len(h), -1)
    at = np.flatnonzero(letters)
    before[at[1:]] = at[:-1]
    same = (before >= 0) & (doc == doc[before]) & (h == h[before]) if len(h) else letters
    own = RESERVED + (mix(h + PLACE[3]) % np.uint64(BUCKETS - RESERVED)).astype(np.int64)
    extra = shout.astype(np.int64) + title + same
    where = np.arange(len(h)) + np.cumsum(extra)  # the place of the word itself
    out = np.empty(len(h) + int(extra.sum()), np.int64)
    out[where] = own
    out[(where - 1)[same]] = SAME
    out[(where - 1 - same)[shout]] = UPPER
    out[(where - 1 - same)[title]] = TITLE
    return out, np.repeat(doc, extra + 1)


class ContextSums:
    """The sum of neighbours' index vectors by bucket. Neighbours are counted as pairs of buckets first: a sum takes as many
    additions as there are distinct pairs. `MOST_PAIRS` of them wait at most, and are added `CHUNK` by `CHUNK`, so memory is bounded.
    All sums are of whole numbers, so they are exact in any order."""

    def __init__(self, dim: int = DIM):
        self.places, self.signs = index_places(dim=dim)
        self.dim, self.total, self.keys, self.n = dim, np.zeros(BUCKETS * dim), np.empty(MOST_PAIRS, np.uint32), 0

    def add(self, texts: pa.Array) -> None:
        for a, b in parts(texts):
            w, doc = word_buckets(texts[a:b])
            w = w.astype(np.uint32)
            for k in range(1, WINDOW + 1):
                for at in range(0, max(0, len(w) - k), CHUNK):  # bounds memory for very long texts
                    first, second = slice(at, min(at + CHUNK, len(w) - k)), slice(at + k, min(at + CHUNK + k, len(w)))
                    self._wait((w[first] << BITS | w[second])[doc[first] == doc[second]])

    def _wait(self, keys: np.ndarray) -> None:
        while len(keys):
            some = keys[: len(self.keys) - self.n]
            self.keys[self.n : self.n + len(some)] = some
            self.n += len(some)
            keys = keys[len(some) :]
            if self.n == len(self.keys):
                self.flush()

    def flush(self) -> None:
        self.keys[: self.n].sort()
        for at in range(0, self.n, CHUNK):  # a pair on both sides of a cut is added twice, with a part of its count each time
            self._sum(self.keys[at : min(at + CHUNK, self.n)])
        self.n = 0

    def _sum(self, keys: np.ndarray) -> None:
        """keys: sorted."""
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        count = np.diff(np.append(at, len(keys))).astype(np.float64)
        one, other = (keys[at] >> BITS).astype(np.int64), (keys[at] & (BUCKETS - 1)).astype(np.int64)
        for x, y in ((one, other), (other, one)):
            row = x * self.dim
            for place, sign in zip(self.places, self.signs, strict=True):
                np.add.at(self.total, row + place[y], count * sign[y])

    def sums(self) -> np.ndarray:
        self.flush()
        return self.total.reshape(BUCKETS, self.dim)


def pool(texts: pa.Array, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean vector of each text and its number of words."""
    n, total = np.zeros(len(texts)), np.zeros((len(texts), vectors.shape[1]))
    for a, b in parts(texts):
        w, doc = word_buckets(texts[a:b])
        n[a:b] = np.bincount(doc, minlength=b - a)
        for at in range(0, len(w), 50_000):
            x, d = w[at : at + 50_000], doc[at : at + 50_000] + a
            first = np.flatnonzero(np.append(True, np.diff(d) > 0))
            np.add.at(total, d[first], np.add.reduceat(vectors[x], first))
    return total / np.maximum(n, 1)[:, None], n


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    @functools.cached_property
    def images(self) -> np.ndarray:
        return self.vectors / self.scale @ self.w1

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.where(pool(texts, self.vectors[:, :1])[1] > 0, self.constant, 0.0)
        # the first layer is linear: means of the words' images under it, of HIDDEN numbers each, need no vectors of DIM
        x, n = pool(texts, self.images)
        z = (np.tanh(x - self.mean / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2) / self.temperature
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, test: np.ndarray, steps: int = 400) -> tuple:
    """mean, scale, w1, b1, w2, b2, temperature. test: the rows for the temperature."""
    rng = np.random.default_rng(11)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    tr = ~test if (~test).any() else np.ones(len(y), bool)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    zt, yt, wt = z[tr], y[tr], weight[tr] / weight[tr].sum()
    for t in range(1, steps + 1):
        h = np.tanh(zt @ p[0] + p[1])
        g = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - yt) * wt
        gh = np.outer(g, p[2]) * (1 - h * h)
        for k, grad in enumerate((zt.T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()]))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            p[k] -= 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    te = test if test.any() else tr
    logit, ye, we = np.tanh(z[te] @ p[0] + p[1]) @ p[2] + p[3], y[te], weight[te]
    loss = lambda t: float((we * np.logaddexp(0, np.where(ye > 0, -logit, logit) / t)).sum())
    return mean, scale, p[0], p[1], p[2], float(p[3][0]), float(min(np.geomspace(0.25, 8, 61), key=loss))


def trainable(labels: DataFrame) -> DataFrame:
    """`(doc_id, quality)` of the rows that may be learnt from."""
    own = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return labels.where(F.col("quality").isNotNull() & own).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    spark = docs.sparkSession
    known = trainable(labels)
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect() if r["quality"] in (0, 1)}
    picked = known.where("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2).unionByName(known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2))
    # at most fit_rows ids travel to the scan of the texts, and at most fit_rows texts are shuffled
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").repartition(16, "doc_id")
    sample = sample.withColumn("__n", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where("__n = 1").drop("__n").persist()
    try:

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context = ContextSums()
            for b in batches:
                context.add(b.column(0))
            for k, part in enumerate(np.split(np.rint(context.sums()).astype(np.int64), SLICES)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "sums"])

        def add_up(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), np.int64) for x in t.column("sums"))
            return pa.table({"slice": t.column("slice")[:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        context = np.zeros((SLICES, BUCKETS // SLICES * DIM), np.int64)
        for r in docs.select("text").mapInArrow(trimmed(sums), "slice int, sums binary").groupBy("slice").applyInArrow(add_up, "slice int, sums binary").toLocalIterator():
            context[r["slice"]] += np.frombuffer(r["sums"], np.int64)
        context = context.reshape(BUCKETS, DIM).astype(np.float32)
        vectors = context / (np.linalg.norm(context, axis=1, keepdims=True) + 1e-6) + index_vectors() / np.sqrt(6).astype(np.float32)
        own = spark.sparkContext.broadcast(vectors)

        def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, n = pool(b.column(1), own.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64())), pa.array(n > 0)], ["doc_id", "quality", "x", "some"])

        rows = sample.select("doc_id", "text", "quality").mapInArrow(trimmed(pooled), "doc_id bigint, quality int, x array<double>, some boolean").where("some").toPandas()
    finally:
        sample.unpersist()
    blank = [np.zeros(DIM), np.ones(DIM), np.zeros((DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0]
    if len(share) < 2 or rows["quality"].nunique() < 2:
        return Model(vectors, *blank, constant=share.get(1, 0) / sum(share.values()) if share else 0.5)
    rows = rows.sort_values("doc_id").reset_index(drop=True)
    y = rows["quality"].to_numpy(float)
    weight = np.where(y > 0, share[1] / (y > 0).sum(), share[0] / (y == 0).sum())
    test = mix(rows["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(5) == 0
    return Model(vectors, *train(np.stack(rows["x"]), y, weight, test))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` per row."""
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = own.value.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(trimmed(run), "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted good, as they were."""
    own, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(own.value.score(b.column(at)) >= threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
