"""Near-duplicate embeddings by epsilon grid order (operator 4).

Vectors of one label link when their cosine, in double precision, is 0.98 or more: unit vectors at a distance of at most
eps = sqrt(2 - 2 * 0.98). Equal vectors of a label are one class with a weight. Classes are projected on `AXES`
leading principal directions (of a sample of `PCA_ROWS` classes: it shapes the order alone, not the result), and the coordinates
cut into cells of width eps. Sorted by label and cells, they form a sequence, which a range partitioning deals over tasks and
cuts into blocks of `BLOCK` classes, each with its bounding box.

Blocks are paired if their boxes are at most eps apart, found by an equi-join on the cells of the two first axes that
they touch; projections shrink distances, so the blocks skipped are provably too far. A pair of blocks is joined by
halving the longer interval again and again, skipping intervals whose boxes are too far apart, down to small matrix products.
The join is exact. A task holds two blocks at a time, whatever the size of a group, and a block meets `PARTNERS` others at a time; it gives counts per class and the
edges of a spanning forest, never all pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null label or null vec_id, link with nothing: 0
links and their own component; vectors of different lengths don't link; rows that repeat count as vectors each; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, materialize, table

COSINE, AXES, PCA_ROWS, BLOCK, LEAF, PARTNERS = 0.98, 6, 4096, 512, 48, 16


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def principal(classes: DataFrame, axes: int) -> np.ndarray:
    """Leading principal directions as columns."""
    rows = [r[0] for r in classes.orderBy(F.xxhash64("cid"), "cid").limit(PCA_ROWS).select("embedding").collect()]
    if not rows:
        return np.zeros((1, axes))
    d = max(map(len, rows))
    x = np.zeros((len(rows), d))
    for k, r in enumerate(rows):
        x[k, : len(r)] = units(np.array([r]))[0]
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    out = np.zeros((d, axes))
    out[:, : min(axes, len(v))] = v[:axes].T
    return out


def project(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    n = min(x.shape[1], len(directions))
    return x[:, :n] @ directions[:n]


def apart(a: np.ndarray, b: np.ndarray) -> float:
    """The distance between the bounding boxes of two sets of points."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(np.sqrt((gap * gap).sum()))


def interval_join(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, eps: float, cosine: float) -> np.ndarray:
    """Which rows of a and b link, by recursive halving of the two intervals."""
    out = np.zeros((len(a), len(b)), bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        if apart(pa_[i:j], pb[k:n]) > eps:
            continue
        if j - i <= LEAF and n - k <= LEAF:
            out[i:j, k:n] = a[i:j] @ b[k:n].T >= cosine
        elif j - i >= n - k:
            m = (i + j) // 2
            todo += [(i, m, k, n), (m, j, k, n)]
        else:
            m = (k + n) // 2
            todo += [(i, j, k, m), (i, j, m, n)]
    return out


def forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and columns of a matrix of links, the row that stands for their component; -1: no link."""
    some, most = link.any(1), len(link)
    row = np.where(some, np.arange(most), most)
    while True:
        col = np.where(link, row[:, None], most).min(0, initial=most)
        new = np.minimum(row, np.where(link, col[None, :], most).min(1, initial=most))
        if (new == row).all():
            return np.where(row < most, row, -1), np.where(col < most, col, -1)
        row = new


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, axes: int = AXES, block: int = BLOCK, partners: int = PARTNERS) -> DataFrame:
    """`(vec_id, n_links, component_id, kept)` per row."""
    eps = float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    slim = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad, F.lit(False))
    slim = slim.withColumn("__valid", valid)
    classes = slim.where("__valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    directions = classes.sparkSession.sparkContext.broadcast(principal(classes, axes))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(b.column(3))
            for d in np.unique(lengths):
                at = pa.array(np.flatnonzero(lengths == d))
                rows = b.take(at)
                cell = np.floor(project(units(matrix(rows.column(2))), directions.value) / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(list(cell), pa.list_(pa.int32()))], [*b.schema.names, "cell"])

    kind = classes.schema["label"].dataType.simpleString()
    ordered = classes.select("cid", "label", "embedding", F.size("embedding").alias("dim"), "w").mapInArrow(cells, f"cid bigint, label {kind}, embedding array<double>, dim int, w bigint, cell array<int>")
    key = ["label", "dim", "cell", "cid"]
    ordered = ordered.repartitionByRange(*key).sortWithinPartitions(*key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def out(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            x = matrix(rows.column("embedding").combine_chunks())
            p = project(units(x), directions.value)
            cell = np.floor(p / eps).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), rows.column("label").combine_chunks()[:1], pa.array([x.shape[1]], pa.int32())]
                + [pa.array([list(v)], pa.list_(pa.float64())) for v in (p.min(0), p.max(0))]
                + [pa.array([list(v[:2])], pa.list_(pa.int64())) for v in (cell.min(0), cell.max(0))]
                + [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (rows.column("cid").to_numpy(), rows.column("w").to_numpy(), x)],
                ["block", "label", "dim", "low", "high", "cell_low", "cell_high", "cids", "ws", "x"],
            )

        for b in batches:
            t = pa.Table.from_batches([b])
            change = np.flatnonzero((np.asarray(b.column(3))[1:] != np.asarray(b.column(3))[:-1]) | (np.asarray(b.column(1))[1:] != np.asarray(b.column(1))[:-1])) + 1
            for i, j in zip([0, *change], [*change, len(t)], strict=True):
                part = t.slice(i, j - i)
                if held and (held[0].column("label")[0] != part.column("label")[0] or held[0].column("dim")[0] != part.column("dim")[0]):
                    yield out(pa.concat_tables(held))
                    held = []
                held.append(part)
                while sum(map(len, held)) >= block:
                    whole = pa.concat_tables(held)
                    yield out(whole.slice(0, block))
                    held = [whole.slice(block)] if len(whole) > block else []
        if held:
            yield out(pa.concat_tables(held))

    blocks = materialize(ordered.mapInArrow(cut, f"block bigint, label {kind}, dim int, low array<double>, high array<double>, cell_low array<bigint>, cell_high array<bigint>, cids binary, ws binary, x binary"))
    box = blocks.select("block", "label", "dim", "low", "high", "cell_low", "cell_high")

    def touched(df: DataFrame, by: int, name: str) -> DataFrame:
        for k in range(min(2, axes)):
            df = df.withColumn(f"c{k}", F.explode(F.sequence(F.col("cell_low")[k] - by, F.col("cell_high")[k] + by)))
        return df.select("label", "dim", *[f"c{k}" for k in range(min(2, axes))], *[F.col(c).alias(f"{c}_{name}") for c in ("block", "low", "high")])

    gap2 = F.aggregate(F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y)), F.lit(0.0), lambda s, g: s + g * g)
    pairs = touched(box, 0, "a").join(touched(box, 1, "b"), ["label", "dim", *[f"c{k}" for k in range(min(2, axes))]]).where((F.col("block_a") <= F.col("block_b")) & (gap2 <= eps * eps)).select("block_a", "block_b").distinct()
    # the later block of a pair travels to the earlier one, which is its own first partner; a block with many partners meets them in
    # several chunks, and comes to each of them
    chunks = pairs.groupBy("block_a").agg(F.ceil(F.count(F.lit(1)) / partners).cast("int").alias("chunks"))
    own_chunks = F.sequence(F.lit(0), F.col("chunks") - 1)
    one_chunk = F.array(F.pmod(F.xxhash64("block_b"), F.col("chunks")).cast("int"))
    dealt = pairs.join(chunks, "block_a").select("block_a", "block_b", F.explode(F.when(F.col("block_a") == F.col("block_b"), own_chunks).otherwise(one_chunk)).alias("chunk"))
    key = ["block_a", "chunk"]
    meet = dealt.join(blocks.select(F.col("block").alias("block_b"), "dim", "cids", "ws", "x"), "block_b").repartition(*key).sortWithinPartitions(*key, "block_b")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            for r in range(len(b)):
                first, second, chunk = (b.column(c)[r].as_py() for c in ("block_a", "block_b", "chunk"))
                cid, w = (np.frombuffer(b.column(c)[r].as_py(), np.int64) for c in ("cids", "ws"))
                x = units(np.frombuffer(b.column("x")[r].as_py(), np.float64).reshape(len(cid), -1))
                p = project(x, directions.value)
                if first == second:
                    own = ((first, chunk), cid, w, x, p)
                    if chunk:
                        continue
                assert own[0] == (first, chunk)
                link = interval_join(own[3], x, own[4], p, eps, cosine)
                if first == second:
                    np.fill_diagonal(link, False)
                row, col = forest(link)
                us, vs, ns = [], [], []
                for ids, weights, stands in ((own[1], link @ w, row), (cid, own[2] @ link if first != second else None, col)):
                    at = np.flatnonzero(stands >= 0)
                    us.append(ids[at])
                    vs.append(own[1][stands[at]])
                    ns.append(weights[at] if weights is not None else np.zeros(len(at), np.int64))
                if sum(map(len, us)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in (us, vs, ns)], ["u", "v", "n"])

    found = materialize(meet.select("block_a", "block_b", "chunk", "cids", "ws", "x").mapInArrow(join, "u bigint, v bigint, n bigint"))
    links = found.groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("linked"))
    group = components(found.select("u", "v")).withColumnRenamed("node", "cid")
    of = classes.join(links, "cid", "left").join(group, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = of.join(lowest, "component").select("label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    alone = slim.where("NOT __valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = slim.where("__valid").join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
