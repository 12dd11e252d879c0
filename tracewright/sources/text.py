"""Lines of block-compressed (BGZF) and other gzip files named `.bgz`, and of standard input.

A BGZF file is split by ranges of its bytes: a task begins at the first block whose place is in its range, leaves out the line it begins
in the midst of, and reads on to the end of the line that it ends in the midst of. A file that is gzip but not in such blocks is one task,
read as a stream. Paths are any that `pyarrow.fs` opens on the driver and the executors alike.
"""

from __future__ import annotations

import struct
import sys
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..functions.codecs import BGZF_HEAD, unbgzf

RANGE, BATCH, MOST = 32 << 20, 8192, 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session that runs in one process may do without the setting."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return f"{tempfile.gettempdir()}/tracewright"


def is_block(data: bytes, at: int = 0) -> bool:
    """The time, flags and system of a block may be any."""
    return data[at : at + 4] == BGZF_HEAD[:4] and data[at + 10 : at + 16] == BGZF_HEAD[10:16]


def first_block(f: pa.NativeFile, lo: int, size: int) -> int:
    """The place of the first block at `lo` or after it: one that another block, or the end, follows."""
    f.seek(lo)
    data, k = f.read(3 * MOST), -1
    while (k := data.find(BGZF_HEAD[:4], k + 1)) >= 0 and k <= MOST:
        if is_block(data, k) and k + 18 <= len(data):
            after = k + struct.unpack("<H", data[k + 16 : k + 18])[0] + 1
            if lo + after == size or is_block(data, after):
                return lo + k
    return size


def texts(f: pa.NativeFile, start: int, stop: int, size: int) -> Iterator[tuple[bool, bytes]]:
    """Text block by block from `start` to the end of the file; the flag says whether the block begins before `stop`."""
    at, data = start, b""
    f.seek(at)
    while at < size:
        if len(data) < 2 * MOST:
            data += f.read(32 * MOST)
        if not is_block(data):
            raise ValueError("a block is damaged")
        n = struct.unpack("<H", data[16:18])[0] + 1
        yield at < stop, unbgzf(data[:n])
        at, data = at + n, data[n:]


def gzip_texts(f: pa.NativeFile) -> Iterator[tuple[bool, bytes]]:
    """Text of one or more gzip members, a part at a time."""
    z = zlib.decompressobj(31)
    while data := f.read(1 << 20):
        while data:
            yield True, z.decompress(data, 16 << 20)
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
    yield True, z.flush()


def lines(parts: Iterator[tuple[bool, bytes]], whole: bool) -> Iterator[bytes]:
    """Lines that begin after the first byte of the own parts (`whole`: at it) and not after the last."""
    rest: list[bytes] = []
    skip = not whole
    for own, text in parts:
        if not own and skip:
            return
        *full, tail = text.split(b"\n")
        for line in full:
            if not skip:
                yield b"".join([*rest, line])
            skip, rest = False, []
            if not own:
                return
        rest.append(tail)
    if not skip and any(rest):
        yield b"".join(rest)


def lines_in(f: pa.NativeFile, lo: int, hi: int, size: int, blocks: bool) -> Iterator[bytes]:
    parts = texts(f, first_block(f, lo, size), hi, size) if blocks else gzip_texts(f)
    return lines(parts, not lo)


def read_bgzf(spark: SparkSession, path: str, width: int = RANGE) -> DataFrame:
    """`(value binary, file, block, row)`: `row` rises in the order of the input."""
    store, name = fs.FileSystem.from_uri(path)
    info = store.get_file_info(name)
    found = sorted(store.get_file_info(fs.FileSelector(name)), key=lambda i: i.path) if info.type == fs.FileType.Directory else [info]
    rows = []
    for i in found:
        if i.type != fs.FileType.File:
            raise FileNotFoundError(i.path)
        with store.open_input_file(i.path) as f:
            blocks = is_block(f.read(18))
        step = width if blocks else max(1, i.size)
        rows += [(len(rows) + k, i.path, lo, min(lo + step, i.size), i.size, blocks) for k, lo in enumerate(range(0, i.size, step))]
    ranges = spark.createDataFrame(rows, "k bigint, file string, lo bigint, hi bigint, size bigint, blocks boolean").repartition(max(1, min(len(rows), 65536)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                store, _ = fs.FileSystem.from_uri(path)
                with store.open_input_file(r["file"]) as f:
                    held, n = [], 0
                    for line in lines_in(f, r["lo"], r["hi"], r["size"], r["blocks"]):
                        held.append(line)
                        if len(held) == BATCH:
                            yield out(held, r, n)
                            held, n = [], n + BATCH
                    if held:
                        yield out(held, r, n)

    def out(held: list[bytes], r: dict, n: int) -> pa.RecordBatch:
        cols = [pa.array(held, pa.binary()), pa.array([r["file"]] * len(held)), pa.array([r["lo"]] * len(held), pa.int64()), pa.array([(r["k"] << 33) + n + j for j in range(len(held))], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["value", "file", "block", "row"])

    return ranges.mapInArrow(run, "value binary, file string, block bigint, row bigint")


def spool_stdin(spark: SparkSession) -> str:
    """Standard input as a file that executors can read."""
    base = shared_folder(spark)
    store, folder = fs.FileSystem.from_uri(base)
    store.create_dir(folder)
    name = f"{uuid.uuid4().hex}.paf"
    with store.open_output_stream(f"{folder}/{name}") as f:
        while data := sys.stdin.buffer.read(1 << 20):
            f.write(data)
    return f"{base}/{name}"
