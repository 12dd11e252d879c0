"""N-gram Jaccard join (operator 1): a prefix-tree join over globally ordered shingle sets.

A text's words are lower-cased (A-Z); its set are the hashes (64 bits) of its distinct k-word shingles. Two documents link when
100 * intersection >= percent * union; the components of the links are returned.

1. Documents with equal sets (size and two 64-bit sums over the set) are one class; only one document of it goes on.
2. Sharding, from `LEAST_PARTS` percent on. Sets of sizes a <= b that link differ in at most (a + b) (100 - p) / (100 + p) elements. If elements are dealt by hash into more
   parts than that, some part is equal in both (pigeonhole). Each set gives a signature per part; sets that share one
   are joined, to the smallest class with it, and the components of these pairs are the shards. Sizes are put in bands, so that
   partners use the same number of parts; a set whose partners may lie in the next band signs for that one too. Parts that are
   empty are only signed by sets with so many empty parts that all equal parts could be empty. Sets of fewer than `SHORT` shingles
   sign for their first n - ceil(p n / 100) + 1 shingles by hash instead: sets that link share one. Below `LEAST_PARTS` percent, all
   sets do so, in the order of the number of documents that hold a shingle, counted exactly (`counted_rows`).
3. The shingles of a shard's sets are ordered by frequency in the shard. Sets that share none of their rarest shingles are told apart; the others are
   stored, most frequent shingle first, in compressed tries. For each set the trie is traversed once:
   overlaps with a path are counted once for all sets below it; a subtree is pruned when the overlap so far and the
   lengths that remain can't reach the threshold, or when all its sets are already in the component of the one in hand. The join is exact.
   A shard beyond `BLOCK_SHINGLES` is dealt into blocks and each pair of blocks makes a trie, so a task holds two blocks at most.
4. Components of the links, in rounds over written tables.

No step emits all pairs of a group: signatures give stars, tries give spanning forests.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; a text with fewer than k words is one
shingle; rows with a null doc_id link with nothing and have a null component; rows that repeat a doc_id are judged each by its text;
an empty table gives an empty table; other columns are not read (`keep_one`: are returned as they are).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import FAN, column, fitting, with_totals
from .hashing import PLACE, mix, parts, runs, shingles, text_bytes, trimmed
from .shared import components, materialize, table

K, PERCENT, BAND, BLOCK_BYTES, BLOCK_SHINGLES, MAX_BROADCAST_ROWS = 3, 90, 1.6, 4 << 20, 1_500_000, 100_000
#: Sets of SHORT shingles or more sign for parts, if the percentage is LEAST_PARTS or more.
SHORT, LEAST_PARTS = 45, 85


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted set of each text."""
    out = []
    for a, b in parts(texts):
        h, doc, _, _ = runs(*text_bytes(texts[a:b]))
        g, owner = shingles(h, doc, k)
        cuts = np.searchsorted(owner, np.arange(b - a + 1))
        out += [np.unique(g[i:j]) if j > i else g[:0] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


@functools.cache
def bands(percent: int, most: int = 1 << 40) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, number of parts, empty parts that need no signature) per band; 0 parts: the band signs for
    its shingles that come first by hash."""
    p, q, out = 100 - percent, 100 + percent, []
    low = next(n for n in range(1, 1000) if (2 * n - 1) * p >= q) if p else most
    while low < most:
        high = max(low, int(low * BAND))
        differ, spare = 2 * high * p // q, 1
        for _ in range(8):
            m = differ + 1 + spare
            mean = m * math.exp(-low / m)
            spare = max(spare, math.ceil(mean + 4 * math.sqrt(mean)) if mean >= 0.05 else 1)
        out.append((low, high, *((differ + 1 + spare, spare) if low >= SHORT else (0, 0))))
        low = high + 1
    return out


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set, for its band and, if partners may be there, the next."""
    n, out = len(s), []
    table_ = bands(percent)
    own = next((i for i, b in enumerate(table_) if n <= b[1]), len(table_))
    for i in (own, own + 1):
        if i >= len(table_):
            break
        low, _, m, spare = table_[i]
        if n < low and n * 100 // percent < low:
            continue
        salt = mix(np.array([i + 1], np.uint64))[0]
        h = mix(s + PLACE[5])
        if m == 0:
            first = n - -(-percent * n // 100) + 1
            out.append(mix(np.partition(h, first - 1)[:first] + salt))
            continue
        part = (h % np.uint64(m)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, part, mix(s + PLACE[6]))
        full = np.bincount(part, minlength=m) > 0
        if m - int(full.sum()) > spare:
            full[:] = True
        at = np.flatnonzero(full)
        out.append(mix(total[at] + PLACE[7] * at.astype(np.uint64) + salt))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    two = [int(x) for x in (mix(s + PLACE[9]).sum(dtype=np.uint64), mix(s + PLACE[10]).sum(dtype=np.uint64))]
    return tuple(x - (1 << 64) if x >> 63 else x for x in two)


class Trie:
    """A compressed trie over sets given as sorted arrays of ranks. Nodes are tuples: sets below [lo, hi), depths [d0, d1) of the node's
    segment, shortest and longest set below, children."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.n = np.array([len(s) for s in self.sets])
        self.lcp = np.zeros(len(sets) + 1, np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            unequal = np.flatnonzero(a[:m] != b[:m])
            self.lcp[i] = unequal[0] if len(unequal) else m
        self.root = self._node(0, len(sets), 0)

    def _node(self, lo: int, hi: int, d0: int) -> list:
        made: list = []
        todo = [(lo, hi, d0, made)]
        while todo:
            lo, hi, d0, into = todo.pop()
            if hi - lo == 1:
                n = int(self.n[lo])
                into.append((lo, hi, d0, n, n, n, ()))
                continue
            inner = self.lcp[lo + 1 : hi]
            d1 = int(inner.min())
            children: list = []
            into.append((lo, hi, d0, d1, int(self.n[lo:hi].min()), int(self.n[lo:hi].max()), children))
            cuts = [lo, *(lo + 1 + np.flatnonzero(inner == d1)).tolist(), hi]
            todo += [(a, b, d1, children) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return made[0]


def groups(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Sets of ranks, rarest last, that share one of their rarest members, as numbers of the list: sets that link do."""
    first = [s[len(s) - (len(s) - -(-percent * len(s) // 100) + 1) :] for s in sets]
    owner, token = np.repeat(np.arange(len(sets)), [len(f) for f in first]), np.concatenate(first)
    label = np.arange(len(sets))
    lowest = np.empty(int(token.max()) + 1, np.int64)
    while True:
        lowest[:] = len(sets)
        np.minimum.at(lowest, token, label[owner])
        new = label.copy()
        np.minimum.at(new, owner, lowest[token])
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    return [g for g in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(g) > 1]


def join_sets(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between sets, as numbers of the list."""
    if len(sets) == 2:
        a, b = sets
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (len(a) + len(b) - both) else []
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    ranked, at = [], 0
    for s in sets:
        ranked.append(np.sort(rank[inverse[at : at + len(s)]]))
        at += len(s)
    has = np.zeros(len(values), np.int8)
    return [(int(g[a]), int(g[b])) for g in groups(ranked, percent) for a, b in traverse(Trie([ranked[i] for i in g]), has, percent)]


def traverse(trie: Trie, has: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """The edges of `join_sets` for one trie. has: zeros by rank, left as found."""
    edges, label = [], np.arange(len(trie.sets))
    for x in range(len(trie.sets)):
        s, nx = trie.sets[x], len(trie.sets[x])
        has[s] = 1
        todo = [(trie.root, 0)]
        while todo:
            (lo, hi, d0, d1, shortest, longest, children), hits = todo.pop()
            if hi <= x + 1:
                continue
            below = label[max(lo, x + 1) : hi]
            if (below == label[x]).all():
                continue
            path = trie.sets[lo]
            if d1 > d0:
                hits += int(has[path[d0:d1]].sum())
            if not children:
                if 100 * hits >= percent * (nx + longest - hits):
                    edges.append((trie.order[x], trie.order[lo]))
                    label[label == label[lo]] = label[x]
                continue
            rest = nx - int(np.searchsorted(s, path[d1 - 1], "right")) if d1 else nx
            ny = min(max(d1 + rest, shortest), longest)  # the length with the most slack
            best = hits + min(rest, ny - d1)
            if 100 * best >= percent * (nx + ny - best):
                todo += [(c, hits) for c in children]
        has[s] = 0
    return edges


def as_batch(ids, sets: list[np.ndarray], signed: list[np.ndarray]) -> pa.RecordBatch:
    prints = [fingerprint(s) for s in sets]
    off = np.append(0, np.cumsum([len(s) for s in signed])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(signed).view(np.int64) if signed else np.empty(0, np.int64)))
    return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), *(pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1)), lists], ["doc_id", "n", "f1", "f2", "signed"])


SCHEMA = "doc_id bigint, n bigint, f1 bigint, f2 bigint, signed array<bigint>"


def shingle_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A row per document: its set's size, fingerprint and signatures."""
    if percent < LEAST_PARTS:
        return counted_rows(docs, k, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1), k)
            yield as_batch(b.column(0), sets, [signatures(s, percent) for s in sets])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)


def counted_rows(docs: DataFrame, k: int, percent: int, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """`shingle_rows` with the shingles ordered by the number of documents that hold them, then by hash. A set signs for those of
    its first n - ceil(p n / 100) + 1 shingles that another document holds too. The counts are those of `exchange`, of all documents."""

    def keys_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(shingle_sets(column(t, "text"), k)), return_counts=True)

    def use(t: pa.Table, totals: np.ndarray) -> pa.Table:
        sets = shingle_sets(column(t, "text"), k)
        values = np.unique(np.concatenate(sets))
        count = fitting(values, totals)
        signed = []
        for s in sets:
            c, h = count[np.searchsorted(values, s)], mix(s + PLACE[5])
            first = np.lexsort((h, c))[: len(s) - -(-percent * len(s) // 100) + 1]
            signed.append(h[first][c[first] > 1])
        return pa.Table.from_batches([as_batch(column(t, "doc_id"), sets, signed)])

    return with_totals(docs, ["doc_id", "text"], keys_of, use, SCHEMA, block_bytes, fan)


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """`(doc_id, n_shingles, component_id)` per row of docs(doc_id, text)."""
    rows = materialize(shingle_rows(docs, k, percent))
    same = ["n", "f1", "f2"]
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("signed").alias("signed"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    signed = classes.select("cid", F.explode("signed").alias("s"))
    shared = signed.groupBy("s").agg(F.min("cid").alias("hub"), F.max("cid").alias("last")).where("hub < last").select("s", "hub")
    stars = signed.join(shared, "s").where("cid <> hub").select(F.col("cid").alias("u"), F.col("hub").alias("v"))
    shards = components(stars).select(F.col("node").alias("cid"), F.col("component").alias("shard"))
    members = materialize(shards.join(classes.select("cid", "rep", *same), "cid"))
    sizes = members.groupBy("shard").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    wanted = members.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    wanted = wanted.select(F.col("rep").alias("doc_id"), "cid", "shard", "blocks", "own", *[F.col(c).alias(f"__{c}") for c in same])
    if members.count() <= max_broadcast:  # some 70 bytes each; beyond, the texts are shuffled by id
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shingle_sets(b.column(0), k)
            want = zip(*(b.column(c).to_pylist() for c in ("__n", "__f1", "__f2")), strict=True)
            right = [len(s) == w[0] and fingerprint(s) == w[1:] for s, w in zip(found, want, strict=True)]
            data = pa.array([s.tobytes() if r else None for s, r in zip(found, right, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cid", "shard", "blocks", "own")), data], ["cid", "shard", "blocks", "own", "data"]).filter(pa.array(right))

    with_sets = texts.select("text", "cid", "shard", "blocks", "own", "__n", "__f1", "__f2").mapInArrow(trimmed(sets), "cid bigint, shard bigint, blocks int, own int, data binary")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own"))))
    pairs = with_sets.withColumn("other", other).select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "data")
    pairs = pairs.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "cid")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held = None, [], []

        def out() -> pa.RecordBatch:
            found = join_sets(held, percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[e[k]] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for b in batches:
            for key, cid, data in zip(zip(*(b.column(c).to_pylist() for c in (0, 1, 2)), strict=True), b.column(3).to_pylist(), b.column(4), strict=True):
                if key != at:
                    if len(held) > 1:
                        yield out()
                    at, ids, held = key, [], []
                if not ids or ids[-1] != cid:  # a row that repeats comes once
                    ids.append(cid)
                    held.append(np.frombuffer(data.as_py(), np.uint64))
        if len(held) > 1:
            yield out()

    found = pairs.mapInArrow(trimmed(links), "u bigint, v bigint")
    group = components(found).select(F.col("node").alias("cid"), "component")
    of = classes.select("cid", "rep", *same).join(group, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = of.join(lowest, "component").select(*same, "component_id")
    full = rows.select("doc_id", *same)
    linked = full.where("n > 0 AND doc_id IS NOT NULL").join(of, same).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = full.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The documents without those whose component has a smaller id; of rows with one id, all or none stay."""
    groups = materialize(jaccard_components(docs, k, percent))
    drop = groups.groupBy("doc_id").agg(F.min("component_id").alias("c")).where("c <> doc_id").select("doc_id")
    if groups.where("component_id <> doc_id").count() <= max_broadcast:
        drop = F.broadcast(drop)
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
