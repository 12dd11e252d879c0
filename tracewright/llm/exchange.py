"""Counts of 64-bit keys over all documents, answered block by block.

Documents are cut into blocks of `BLOCK_BYTES` of text, in the order of the scan; a longer document is a block of its own. A block sends
its distinct keys with counts, sorted and cut into buckets of the key space; a bucket's task adds up what all blocks sent and answers
each block in the order of its keys, a few bits a key. Beyond `FAN` blocks this goes by levels: blocks are dealt to groups of about `FAN`, a
group's keys are added up by bucket, and the sums travel on as if they were a block's, into `FAN` times finer buckets; answers come
back the same way. So a block sends `FAN` rows at most on each level, rows grow in proportion to the input, and a task holds what
about one block holds, whatever the size of the input.

Blocks are read twice, to send and to use the answers, and must be cut alike both times: `docs` is a scan of a table, not a shuffled
result. If the keys of a block don't fit its answers, the task fails.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import squeeze, trim, trimmed, widen

BLOCK_BYTES, FAN = 8 << 20, 8192
#: Buckets for each block, where one level does.
BUCKETS = 4
PIECE = "block bigint, bucket bigint, keys binary, counts binary"
ANSWER = "block bigint, bucket bigint, totals binary"
#: (sorted distinct keys, counts) of a block's documents.
KeysOf = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]


def cut(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Number and rows of each block of a task. Rows decide where a block ends, so the edges of batches don't matter."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0)).astype(np.int64) + 16)
        at = done = 0
        while at < len(b):
            stop = min(len(b), int(np.searchsorted(ends, done + block_bytes - size, "left")) + 1)
            held.append(b.slice(at, stop - at))
            size, done, at = size + int(ends[stop - 1]) - done, int(ends[stop - 1]), stop
            if size >= block_bytes:
                yield number, held
                number, held, size = number + 1, [], 0
    if held:
        yield number, held


def packed(docs: DataFrame, columns: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`(block, data)`: the columns, `text` among them, of a block's rows, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in cut(batches, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                for b in held:
                    w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"])

    return docs.select(*columns).mapInArrow(trimmed(run), "block bigint, data binary")


def unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks else pa.array([], c.type)


@functools.lru_cache(64)
def _edges(low: int, high: int, width: int) -> np.ndarray:
    return np.array([(b << 64) // width for b in range(low + 1, high)], np.uint64)


def split(block: int, values: np.ndarray, counts: np.ndarray, width: int, low: int, high: int) -> pa.Table:
    """The pieces of sorted keys in the buckets from low to high of `width` buckets that share the key space; no row for an empty one."""
    at = np.concatenate([[0], np.searchsorted(values, _edges(low, high, width)), [len(values)]])
    some = np.flatnonzero(np.diff(at))
    small = counts.astype(least_kind(counts))
    rows = [(values[i:j], small[i:j]) for i, j in zip(at[some], at[some + 1], strict=True)]
    return pa.table(
        {
            "block": pa.array(np.full(len(some), block, np.int64)), "bucket": pa.array(some + low, pa.int64()),
            "keys": pa.array([press(squeeze(v)) for v, _ in rows], pa.binary()), "counts": pa.array([planes(c) for _, c in rows], pa.binary()),
        }
    )


@functools.cache
def _zstd():
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def press(data: bytes) -> bytes:
    return _zstd()[0].compress(data)


def loose(data: bytes) -> bytes:
    return _zstd()[1].decompress(data)


def least_kind(counts: np.ndarray) -> type:
    most = int(counts.max()) if len(counts) else 0
    return next((k for k in (np.uint8, np.uint16, np.uint32) if most <= np.iinfo(k).max), np.uint64)


def planes(counts: np.ndarray) -> bytes:
    """The width of a count, then the planes of their bytes."""
    wide = counts.dtype.itemsize
    return press(bytes([wide]) + np.ascontiguousarray(counts.view(np.uint8).reshape(-1, wide).T).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    data = loose(data)
    wide = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(wide, -1).T).view(f"<u{wide}").reshape(-1)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each key's place among them, and the order that sorts the keys; in little memory."""
    order = np.argsort(keys, kind="stable").astype(np.int32 if len(keys) < 1 << 31 else np.int64)
    values = keys[order]
    new = np.append(True, values[1:] != values[:-1]) if len(keys) else np.empty(0, bool)
    at = np.empty(len(keys), order.dtype)
    at[order] = np.cumsum(new, dtype=order.dtype) - 1
    return values[new], at, order


def added_up(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of pieces, their totals, where each key of each piece is among them, and where the pieces end."""
    keys = [widen(loose(x.as_py())) for x in t.column("keys")]
    ends = np.cumsum([len(k) for k in keys])
    keys = np.concatenate(keys)
    values, at, order = ranked(keys)
    del keys
    counts = np.concatenate([from_planes(x.as_py()) for x in t.column("counts")])[order]
    first = np.flatnonzero(np.append(True, at[order[1:]] != at[order[:-1]]))
    return values, np.add.reduceat(counts, first, dtype=np.int64), at, ends


def answers(t: pa.Table, total: np.ndarray, at: np.ndarray, ends: np.ndarray) -> pa.Table:
    small = total.astype(least_kind(total))
    back = [planes(small[at[i:j]]) for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)]
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "totals": pa.array(back, pa.binary())})


def known_totals(known: pa.Table) -> np.ndarray:
    """The totals of a block's keys, in their order."""
    rows = sorted(zip(known.column("bucket").to_pylist(), known.column("totals").to_pylist(), strict=True))
    return np.concatenate([from_planes(x) for _, x in rows]) if rows else np.empty(0, np.uint8)


def fitting(values: np.ndarray, totals: np.ndarray) -> np.ndarray:
    if len(values) != len(totals):
        raise RuntimeError("a block was cut otherwise when it was read again")
    return totals


def totals(pieces: DataFrame, blocks: int, width: int, fan: int) -> DataFrame:
    """`ANSWER` rows for `PIECE` rows, whose buckets are those of `width`."""
    if blocks <= fan:

        def answer_all(t: pa.Table) -> pa.Table:
            trim()
            _, total, at, ends = added_up(t)
            return answers(t, total, at, ends)

        return pieces.groupBy("bucket").applyInArrow(answer_all, ANSWER)
    groups = -(-blocks // fan)
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))

    def merge(t: pa.Table) -> pa.Table:
        values, total, _, _ = added_up(t)
        bucket = t.column("bucket")[0].as_py()
        return split(t.column("group")[0].as_py(), values, total, width * fan, bucket * fan, (bucket + 1) * fan)

    merged = grouped.groupBy("bucket", "group").applyInArrow(merge, PIECE)
    known = totals(merged, groups, width * fan, fan).withColumn("coarse", F.floor(F.col("bucket") / fan))

    def answer(t: pa.Table, k: pa.Table) -> pa.Table:
        values, _, at, ends = added_up(t)
        return answers(t, fitting(values, known_totals(k)), at, ends)

    return grouped.groupBy("bucket", "group").cogroup(known.groupBy("coarse", "block")).applyInArrow(answer, ANSWER)


def with_totals(docs: DataFrame, columns: list[str], keys_of: KeysOf, use: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """`use(documents, totals)` for each block: the totals over all blocks of the keys of `keys_of(documents)`, in their order."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    levels = 1
    while fan**levels < blocks:
        levels += 1
    step = next(k for k in range(1, fan + 1) if k**levels >= blocks) if levels > 1 else min(fan, BUCKETS * blocks)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in cut(batches, block_bytes):
            yield from split(number, *keys_of(pa.Table.from_batches(held).combine_chunks()), step, 0, step).to_batches()

    pieces = docs.select(*columns).mapInArrow(trimmed(send), PIECE)
    known = totals(pieces, blocks, step, step if levels > 1 else blocks)
    own = packed(docs, columns, block_bytes)

    def finish(block: pa.Table, known: pa.Table) -> pa.Table:
        trim()
        return use(unpacked(block.column("data")[0]), known_totals(known))

    return own.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(finish, schema)
