"""The binary container of alignment records: header, names, records, footer, and an index of record positions beside it.

Records are encoded and decoded by executors; the driver only strings finished pieces together, one at a time, and holds eight bytes
a record of the index. A file is one sequence of bytes, so this is for exchange; for work at scale keep records as Parquet.

Records are numbered from 0 in the order of `record_id`. A record whose trace is null or empty, or that a codec can't hold, is
rejected and counted. Names and ids are those of `operators.dictionary.string_table`, rejected records included. Paths are any that
`pyarrow.fs` opens on the driver and the executors alike.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions.streams import varint_size
from ..operators.dictionary import names, resolve, string_table
from ..operators.selection import LAYERS, STRATEGIES, Strategy

#: Fixed values of the format.
MAGIC, VERSION, INDEX_MAGIC, INDEX_VERSION = b"TPA\0", 1, b"TPAI", 2
DISTANCES = {"edit": 0, "gap-affine": 3, "gap-affine-2p": 5}  # numbers that follow
#: Our own numbering: the format's is not published.
VARIANTS, METRICS = ("standard", "mixed", "variable", "fastga", "single"), ("edit-distance", "diagonal-distance")
PIECE, SLICE, STRIDE = 4 << 20, 65536, 16384
HEAD = ("query_name_id", "query_start", "query_end", "strand", "target_name_id", "target_start", "target_end", "residue_matches", "alignment_block_len", "mapping_quality")
SPAN = "first bigint, last bigint, start bigint, stop bigint"
SCHEMA = "record_id bigint, query_name_id bigint, query_start bigint, query_end bigint, strand string, target_name_id bigint, target_start bigint, target_end bigint, residue_matches bigint, alignment_block_len bigint, mapping_quality smallint, trace array<struct<a:bigint,b:bigint,op:string>>, tags array<struct<key:string,type:string,i:int,f:float,s:string>>"


@dataclass(frozen=True)
class Header:
    first: Strategy = field(default_factory=lambda: Strategy("rice"))
    second: Strategy = field(default_factory=lambda: Strategy("2d-delta"))
    variant: str = "standard"
    metric: str = "edit-distance"
    max_complexity: int = 32
    distance: tuple = ("edit",)
    all_records: bool = False
    num_records: int = 0
    num_strings: int = 0

    def prefix(self) -> bytes:
        return MAGIC + bytes([VERSION]) + C.varint(self.num_records) + C.varint(self.num_strings)

    def data(self) -> bytes:
        kind, *numbers = self.distance
        if len(numbers) != DISTANCES[kind]:
            raise ValueError(f"{kind} takes {DISTANCES[kind]} numbers")
        both = bytes(LAYERS.index(s.layer) << 6 | s.code for s in (self.first, self.second))
        rest = bytes([VARIANTS.index(self.variant), METRICS.index(self.metric)]) + C.varint(self.max_complexity)
        return self.prefix() + both + rest + bytes([list(DISTANCES).index(kind)]) + struct.pack(f"<{len(numbers)}i", *numbers) + bytes([self.all_records])

    def footer(self) -> bytes:
        return self.prefix() + struct.pack("<I", len(self.prefix()))


def read_prefix(r: C.Reader) -> tuple[int, int]:
    if r.bytes(4) != MAGIC or r.number(1) != VERSION:
        raise ValueError("not a container of this version")
    return r.varint(), r.varint()


def parse_header(r: C.Reader) -> Header:
    records, strings = read_prefix(r)
    codes = r.bytes(2)
    first, second = (Strategy(STRATEGIES[c & 63], LAYERS[c >> 6]) for c in codes)
    variant, metric, most = VARIANTS[r.number(1)], METRICS[r.number(1)], r.varint()
    kind = list(DISTANCES)[r.number(1)]
    numbers = struct.unpack(f"<{DISTANCES[kind]}i", r.bytes(4 * DISTANCES[kind]))
    return Header(first, second, variant, metric, most, (kind, *numbers), bool(r.number(1)), records, strings)


# One record.


#: Fields of a trace's items and of tags.
ITEM, TAG = ("a", "b", "op"), ("key", "type", "i", "f", "s")


def streams_of(a: list, b: list, op: list, h: Header) -> tuple[bytes, list[tuple[list[int], Strategy]]]:
    """What comes before the streams, and the streams with their strategies."""
    if h.variant in ("standard", "fastga"):
        return b"", [(a, h.first), (b, h.second)]
    if h.variant == "single":
        return b"", [(a, h.first)]
    mixed = h.variant == "mixed"
    flags = [x is not None for x in (op if mixed else b)]
    bitmap = np.packbits(flags, bitorder="little").tobytes()
    before = C.varint(len(bitmap)) + bitmap
    if not mixed:
        return before, [(a, h.first), ([x for x in b if x is not None], h.second)]
    pairs = [[x for x, f in zip(v, flags, strict=True) if not f] for v in (a, b)]
    return before, [(pairs[0], h.first), (pairs[1], h.second), ([x for x, f in zip(a, flags, strict=True) if f], h.first)]


def write_trace(a: list, b: list, op: list, h: Header) -> bytes:
    before, streams = streams_of(a, b, op, h)
    aligned = h.variant in ("standard", "fastga")
    out = [C.varint(len(a)), before]
    for k, (x, s) in enumerate(streams):
        data = C.encode_second(s.name, streams[0][0], x) if aligned and k == 1 else C.encode(s.name, x)
        if x or aligned or h.variant == "single":
            data = C.layer("nocomp" if h.all_records else s.layer, s.level)[0](data)
        out += [C.varint(len(data)), data]
    if h.variant == "mixed":
        ops = "".join(x for x in op if x is not None).encode("latin-1")
        out += [C.varint(len(ops)), ops]
    return b"".join(out)


def read_trace(r: C.Reader, h: Header) -> list[dict]:
    n = r.varint()
    if not n:
        raise ValueError("a trace has no items")
    bitmap = h.variant in ("variable", "mixed") and r.bytes(r.varint())
    flags = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n, bitorder="little").tolist() if bitmap else []
    cut = lambda: r.bytes(r.varint())

    def stream(s: Strategy, m: int, data: bytes, first=None) -> list[int]:
        if not data and not m:
            return []
        if s.layer != "nocomp" and not h.all_records:
            data = C.layer(s.layer)[1](data)
        return C.decode(s.name, data, m) if first is None else C.decode_second(s.name, first, data, m)

    item = lambda a, b=None, op=None: {"a": a, "b": b, "op": op}
    if h.variant == "single":
        return [item(a) for a in stream(h.first, n, cut())]
    if h.variant in ("standard", "fastga"):
        a = stream(h.first, n, cut())
        return [item(*p) for p in zip(a, stream(h.second, n, cut(), a), strict=True)]
    some = sum(flags)
    if h.variant == "variable":
        a = stream(h.first, n, cut())
        b = iter(stream(h.second, some, cut()))
        return [item(v, next(b) if f else None) for v, f in zip(a, flags, strict=True)]
    a, b, size = (iter(stream(s, m, cut())) for s, m in ((h.first, n - some), (h.second, n - some), (h.first, some)))
    ops = iter(cut().decode("latin-1"))
    return [item(next(size), None, next(ops)) if f else item(next(a), next(b)) for f in flags]


#: Pieces of a trace that come with their lengths.
LENGTHS = {"single": 1, "standard": 2, "fastga": 2, "variable": 3, "mixed": 5}


def skip_trace(r: C.Reader, h: Header) -> None:
    r.varint()
    for _ in range(LENGTHS[h.variant]):
        r.bytes(r.varint())


def write_tag(key: str, kind: str, i: int | None, f: float | None, s: str | None) -> bytes:
    head = key.encode() + kind.encode()
    if kind == "i":
        return head + struct.pack("<i", i)
    if kind == "f":
        return head + struct.pack("<f", f)
    text = s.encode()
    return head + C.varint(len(text)) + text


def read_tag(r: C.Reader) -> dict:
    head = r.bytes(3)
    key, kind = head[:2].decode(), chr(head[2])
    if kind not in "ifZ":
        raise ValueError(f"unknown type of tag: {kind}")
    value = r.bytes(r.varint()).decode() if kind == "Z" else struct.unpack("<" + kind, r.bytes(4))[0]
    return {"key": key, "type": kind, "i": value if kind == "i" else None, "f": value if kind == "f" else None, "s": value if kind == "Z" else None}


def write_parts(numbers: list | tuple, trace: list[list], tags: list[tuple], h: Header) -> bytes:
    """A record of the values of `HEAD`, its trace as a list for each field of `ITEM`, and its tags."""
    if not trace[0]:
        raise ValueError("a trace has no items")
    head = b"".join(bytes([ord(v)]) if c == "strand" else bytes([v]) if c == "mapping_quality" else C.varint(v) for c, v in zip(HEAD, numbers, strict=True))
    return head + write_trace(*trace, h) + C.varint(len(tags)) + b"".join(write_tag(*t) for t in tags)


def write_record(row: dict, h: Header) -> bytes:
    trace, tags = row["trace"] or [], row["tags"] or []
    return write_parts([row[c] for c in HEAD], [[x[k] for x in trace] for k in ITEM], [tuple(t[k] for k in TAG) for t in tags], h)


def parts_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[list], list[tuple]]]:
    """What `write_parts` takes, of each row: field by field, which is quicker than a dict for each item."""

    def fields(name: str, of: tuple) -> tuple[list[int], list[list]]:
        a = batch.column(name)
        flat = a.flatten()
        columns = {f.name: x for f, x in zip(flat.type, flat.flatten(), strict=True)}
        return np.append(0, np.cumsum(a.value_lengths().fill_null(0))).tolist(), [columns[k].to_pylist() for k in of]

    (at, items), (to, tags) = fields("trace", ITEM), fields("tags", TAG)
    tags = list(zip(*tags, strict=True))
    for k, numbers in enumerate(zip(*(batch.column(c).to_pylist() for c in HEAD), strict=True)):
        yield numbers, [x[at[k] : at[k + 1]] for x in items], tags[to[k] : to[k + 1]]


def read_record(r: C.Reader, h: Header, metadata_only: bool = False) -> dict:
    out = {c: chr(r.number(1)) if c == "strand" else r.number(1) if c == "mapping_quality" else r.varint() for c in HEAD}
    out["trace"] = skip_trace(r, h) if metadata_only else read_trace(r, h)
    out["tags"] = [read_tag(r) for _ in range(r.varint())]
    return out


_VARINT = rb"[\x80-\xff]{0,9}[\x00-\x7f]"
#: What comes before the pieces of a trace.
_BEFORE = re.compile(b"".join(b"." if c in ("strand", "mapping_quality") else _VARINT for c in HEAD) + _VARINT, re.DOTALL)


def skip_record(r: C.Reader, h: Header) -> None:
    """The reader's place after a record whose values aren't read."""
    data, found = r.data, _BEFORE.match(r.data, r.at)
    if not found:
        raise ValueError("bytes are cut off")
    to = found.end()

    def number() -> int:
        nonlocal to
        n = data[to]
        if n < 128:
            to += 1
            return n
        r.at = to
        n, to = r.varint(), r.at
        return n

    try:
        for _ in range(LENGTHS[h.variant]):
            n = number()
            to += n
        for _ in range(number()):
            kind, to = data[to + 2], to + 3
            if kind not in b"ifZ":
                raise ValueError(f"unknown type of tag: {chr(kind)}")
            n = number() if kind == ord("Z") else 4
            to += n
    except IndexError as e:
        raise ValueError("bytes are cut off") from e
    if to > len(data):
        raise ValueError("bytes are cut off")
    r.at = to


# Files.


def at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def is_container(path: str) -> bool:
    if path == "-":
        return False
    store, name = at(path)
    with store.open_input_file(name) as f:
        return f.read(4) == MAGIC


def read_header(path: str) -> tuple[Header, int]:
    """Header, held against the footer, and its length."""
    store, name = at(path)
    with store.open_input_file(name) as f:
        size = f.size()
        r = C.Reader(f.read(min(size, 4096)))
        h = parse_header(r)
        f.seek(size - 4)
        n = struct.unpack("<I", f.read(4))[0]
        if n + 4 > size:
            raise ValueError("bad footer")
        f.seek(size - 4 - n)
        if read_prefix(C.Reader(f.read(n))) != (h.num_records, h.num_strings):
            raise ValueError("the footer has other counts than the header")
    return h, r.at


def index_bytes(positions: np.ndarray, virtual: bool, section: int) -> bytes:
    body = positions.astype("<u8").tobytes() if virtual else C.varints(positions, np.array([0, len(positions)]))[0].tobytes()
    return INDEX_MAGIC + bytes([INDEX_VERSION, virtual]) + struct.pack("<Q", section) + C.varint(len(positions)) + body


def read_index(path: str) -> tuple[np.ndarray, bool, int]:
    """Positions, whether they are virtual (block << 16 | place in it), and where the section of records begins."""
    store, name = at(path)
    with store.open_input_file(name) as f:
        r = C.Reader(f.read())
    if r.bytes(4) != INDEX_MAGIC or r.number(1) != INDEX_VERSION:
        raise ValueError("not an index of this version")
    virtual, section, n = bool(r.number(1)), r.number(8), r.varint()
    rest = np.frombuffer(r.data, np.uint8)[r.at :]
    got = rest.view("<u8").astype(np.int64) if virtual else C.unvarints(rest, np.array([0, len(rest)]))[0]
    if len(got) != n:
        raise ValueError("the index is cut off")
    return got, virtual, section


def string_bytes(rows: Iterator[tuple[str, int]]) -> bytes:
    return b"".join(C.varint(len(b := name.encode())) + b + C.varint(length) for name, length in rows)


def write(records: DataFrame, path: str, header: Header = Header()) -> dict[str, int]:  # noqa: B008
    """Writes the container and `path`.idx; counts of records written and rejected. Raises ValueError if none can be written."""
    strings = string_table(names(records)).persist(StorageLevel.DISK_ONLY)
    cols = [c for c in HEAD if not c.endswith("name_id")]
    ids = records.select("record_id", *cols, "trace", "tags", "query_name", "target_name")
    for role in ("query", "target"):
        ids = ids.join(strings.select(F.col("name").alias(f"{role}_name"), F.col("id").alias(f"{role}_name_id")), f"{role}_name")
    ids = ids.drop("query_name", "target_name").repartitionByRange("record_id").sortWithinPartitions("record_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bad, n = [], 0, 0, 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, bad, n
            n += 1
            places, data = np.cumsum([0, *map(len, held)])[:-1], b"".join(held)
            if header.all_records:
                blocks = [C.bgzf(data[k : k + C.BGZF_MOST], header.first.level or 6)[: -len(C.BGZF_END)] for k in range(0, len(data), C.BGZF_MOST)]
                starts = np.cumsum([0, *map(len, blocks)])
                places, data = starts[places // C.BGZF_MOST] << 16 | places % C.BGZF_MOST, b"".join(blocks)
            row = [TaskContext.get().partitionId() << 32 | n, places.tolist(), data, bad]
            held, size, bad = [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.list_(pa.int64())), pa.array([row[2]], pa.binary()), pa.array([row[3]])], ["piece", "places", "data", "bad"])

        for b in batches:
            for row in parts_of(b):
                data = C.tried(write_parts, *row, header)
                if data is None:
                    bad += 1
                    continue
                held.append(data)
                size += len(data)
                if size >= PIECE:
                    yield out()
        if held or bad:
            yield out()

    pieces = ids.mapInArrow(pack, "piece bigint, places array<bigint>, data binary, bad bigint").persist(StorageLevel.DISK_ONLY)
    try:
        n = pieces.agg(F.sum(F.size("places")), F.sum("bad")).first()
        written, rejected = int(n[0] or 0), int(n[1] or 0)
        if not written:
            raise ValueError("no record to write")
        h = Header(*[getattr(header, c) for c in ("first", "second", "variant", "metric", "max_complexity", "distance", "all_records")], written, strings.count())
        store, name = at(path)
        with store.open_output_stream(name) as f:
            f.write(h.data())
            ordered = strings.repartitionByRange("id").sortWithinPartitions("id")
            for row in ordered.toLocalIterator(prefetchPartitions=True):
                f.write(string_bytes([(row["name"], row["length"])]))
            section, positions = f.tell(), []
            for row in pieces.toLocalIterator(prefetchPartitions=True):
                start = f.tell()
                positions.append(np.array(row["places"], np.int64) + (start << 16 if h.all_records else start))
                f.write(bytes(row["data"]))
            if h.all_records:
                f.write(C.BGZF_END)
            f.write(h.footer())
        with store.open_output_stream(name + ".idx") as f:
            f.write(index_bytes(np.concatenate(positions), h.all_records, section if h.all_records else 0))
        return {"records": written, "rejected": rejected, "strings": h.num_strings}
    finally:
        pieces.unpersist()
        strings.unpersist()


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """`(id, name, length)`. One task, as nothing says where a name begins but the one before; it holds a part of the file at a time."""
    h, start = read_header(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            store, name = at(path)
            with store.open_input_file(name) as f:
                f.seek(start)
                rest, k, rows = b"", 0, []
                while k < h.num_strings:
                    more = f.read(PIECE)
                    r, kept = C.Reader(rest + more), 0
                    while k < h.num_strings:
                        try:
                            row = (k, r.bytes(r.varint()).decode(), r.varint())
                        except ValueError:
                            if not more:
                                raise
                            break
                        rows.append(row)
                        kept, k = r.at, k + 1
                    rest = r.data[kept:]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["id", "name", "length"])
                    rows = []

    return spark.range(0, 1, 1, 1).mapInArrow(run, "id bigint, name string, length bigint")


def read(spark: SparkSession, path: str, ids: list[int] | None = None, metadata_only: bool = False) -> DataFrame:
    """Records with name ids, found by their positions (see `open_index`); with `ids` only those. Metadata only: the trace is skipped and null.
    IndexError if an id is out of range."""
    h, _ = read_header(path)
    store, name = at(path)
    positions, virtual = open_index(path), h.all_records
    if ids is not None and any(not 0 <= k < len(positions) for k in ids):
        raise IndexError("no such record")
    end = store.get_file_info(name).size
    spans = [(k, min(k + SLICE, len(positions))) for k in range(0, len(positions), SLICE)] if ids is None else [(k, k + 1) for k in sorted(set(ids))]
    edge = lambda k: int(positions[k]) if k < len(positions) else (end << 16 if virtual else end)
    rows = [(i, j, edge(i), edge(j)) for i, j in spans]
    return read_spans(spark.createDataFrame(rows, SPAN).repartition(max(1, min(len(rows), 4096))), path, metadata_only)


def read_spans(spans: DataFrame, path: str, metadata_only: bool = False) -> DataFrame:
    """The records from `first` to before `last`, which lie between the positions `start` and `stop`."""
    h, _ = read_header(path)
    virtual = h.all_records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            store, name = at(path)
            with store.open_input_file(name) as f:
                for s in b.to_pylist():
                    start, stop = (s["start"] >> 16, (s["stop"] >> 16) + (1 << 16)) if virtual else (s["start"], s["stop"])
                    f.seek(start)
                    data = f.read(stop - start)
                    r = C.Reader(C.unbgzf(data, partial=True)) if virtual else C.Reader(data)
                    r.at = s["start"] & 0xFFFF if virtual else 0
                    out = []
                    for k in range(s["first"], s["last"]):
                        out.append({"record_id": k, **read_record(r, h, metadata_only)})
                        if len(out) == 4096 or k + 1 == s["last"]:
                            yield pa.RecordBatch.from_pylist(out, ARROW)
                            out = []

    return spans.mapInArrow(run, SCHEMA)


_TRACE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("op", pa.string())]))
_TAGS = pa.list_(pa.struct([("key", pa.string()), ("type", pa.string()), ("i", pa.int32()), ("f", pa.float32()), ("s", pa.string())]))
ARROW = pa.schema([("record_id", pa.int64()), *[(c, pa.string() if c == "strand" else pa.int16() if c == "mapping_quality" else pa.int64()) for c in HEAD], ("trace", _TRACE), ("tags", _TAGS)])


def read_resolved(spark: SparkSession, path: str, ids: list[int] | None = None, metadata_only: bool = False) -> DataFrame:
    """`read` with names and lengths."""
    return resolve(read(spark, path, ids, metadata_only), read_strings(spark, path)).drop("query_name_id", "target_name_id")


class Cut:
    """The part of a file from a position on: text for a reader, and positions of places in it."""

    def __init__(self, f: pa.NativeFile, position: int, virtual: bool, window: int):
        start = position >> 16 if virtual else position
        f.seek(start)
        data = f.read(window)
        self.complete, self.blocks = f.tell() == f.size(), [(0, start)]
        if virtual:
            texts, k, n = [], 0, 0
            while data[k : k + 4] == C.BGZF_HEAD[:4] and k + 18 <= len(data) and k + (size := struct.unpack("<H", data[k + 16 : k + 18])[0] + 1) <= len(data):
                texts.append(C.unbgzf(data[k : k + size]))
                k, n = k + size, n + len(texts[-1])
                self.blocks.append((n, start + k))
            data = b"".join(texts)
        self.virtual, self.reader = virtual, C.Reader(data)
        self.reader.at = position & 0xFFFF if virtual else 0

    def position(self, place: int) -> int:
        n, start = next(b for b in reversed(self.blocks) if b[0] <= place)
        return start << 16 | place - n if self.virtual else start + place


def read_from(path: str, position: int, what):
    """What `what(cut, header)` reads at a position, with as much of the file as it takes."""
    h, _ = read_header(path)
    store, name = at(path)
    window = 1 << 18
    with store.open_input_file(name) as f:
        while True:
            cut = Cut(f, position, h.all_records, window)
            try:
                return what(cut, h)
            except ValueError:
                if cut.complete:
                    raise
                window *= 8


def record_at(path: str, position: int, metadata_only: bool = False) -> dict:
    """The record at a position of the index, on the driver."""
    return read_from(path, position, lambda c, h: read_record(c.reader, h, metadata_only))


def trace_position(path: str, position: int) -> int:
    """Where the trace of the record at a position begins; virtual if the positions of the index are."""

    def skip(c: Cut, h: Header) -> int:
        for name in HEAD:
            c.reader.number(1) if name in ("strand", "mapping_quality") else c.reader.varint()
        return c.position(c.reader.at)

    return read_from(path, position, skip)


def trace_at(path: str, position: int, variant: str | None = None) -> list[dict]:
    """The trace that begins at a position. ValueError if `variant` is given and isn't the container's."""
    if variant and read_header(path)[0].variant != variant:
        raise ValueError(f"the traces are not {variant}")
    return read_from(path, position, lambda c, h: read_trace(c.reader, h))


def size_report(spark: SparkSession, path: str) -> DataFrame:
    """`(section, part, bytes, share, average)`: bytes of the header, of the names by parts, and of the rest (records, footer). The share is
    of the file; the average per name or record."""
    h, head = read_header(path)
    store, name = at(path)
    size = store.get_file_info(name).size
    n = F.octet_length("name").cast("bigint")
    parts = {"name lengths": varint_size(n), "names": n, "sequence lengths": varint_size(F.col("length"))}
    strings = read_strings(spark, path).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in parts.items()])
    row = lambda section, part, b, count: F.struct(F.lit(section).alias("section"), F.lit(part).alias("part"), b.cast("bigint").alias("bytes"), F.lit(count).cast("bigint").alias("count"))
    rest = F.lit(size - head) - sum((F.col(k) for k in parts), F.lit(0))
    rows = [row("header", "all", F.lit(head), 1), *[row("names", k, F.col(k), h.num_strings) for k in parts], row("records", "all", rest, h.num_records)]
    flat = strings.select(F.inline(F.array(*rows)))
    return flat.select("section", "part", "bytes", F.try_divide("bytes", F.lit(size)).alias("share"), F.try_divide("bytes", "count").alias("average"))


class Flow:
    """The bytes of a file from a place on, read from front to back, a part at a time; of a BGZF section (`virtual`) their text."""

    def __init__(self, f: pa.NativeFile, start: int, virtual: bool):
        f.seek(start)
        self.f, self.virtual, self.raw, self.reader = f, virtual, b"", C.Reader(b"")
        self.before, self.blocks, self.next = 0 if virtual else start, [], start

    def more(self) -> bool:
        """Reads on; the text before the reader's place is dropped."""
        data = self.f.read(PIECE)
        if self.virtual:
            self.raw += data
            texts, k, end = [], 0, self.before + len(self.reader.data)
            while C.is_block(self.raw, k) and k + (size := C.block_size(self.raw, k)) <= len(self.raw):
                self.blocks.append((end, self.next + k))
                texts.append(C.unbgzf(self.raw[k : k + size]))
                k, end = k + size, end + len(texts[-1])
            self.raw, self.next, text = self.raw[k:], self.next + k, b"".join(texts)
        else:
            text = data
        self.before += self.reader.at
        self.reader = C.Reader(self.reader.data[self.reader.at :] + text)
        while len(self.blocks) > 1 and self.blocks[1][0] <= self.before:
            self.blocks.pop(0)
        return bool(data)

    def take(self, what):
        """`what(reader)`, with as much of the file as it takes."""
        while True:
            at = self.reader.at
            try:
                return what(self.reader)
            except ValueError:
                self.reader.at = at
                if not self.more():
                    raise

    def position(self) -> int:
        """Of the reader's place: in the file, or virtual."""
        if self.reader.done():
            self.more()
        place = self.before + self.reader.at
        if not self.virtual:
            return place
        n, start = self.blocks[bisect_right(self.blocks, place, key=itemgetter(0)) - 1]
        return start << 16 | place - n


def flow(path: str, every: int = 1) -> Iterator[int]:
    """Positions of record 0, `every`, 2 * `every` and so on, and of the end of the last, from front to back without an index; memory is that of a part of the file."""
    h, start = read_header(path)
    store, name = at(path)
    with store.open_input_file(name) as f:
        names_ = Flow(f, start, False)
        for _ in range(h.num_strings):
            names_.take(lambda r: (r.bytes(r.varint()), r.varint()))
        records = Flow(f, names_.position(), True) if h.all_records else names_
        for k in range(h.num_records):
            if k % every == 0:
                yield records.position()
            records.take(lambda r: skip_record(r, h))
        yield records.position()


def read_in_order(spark: SparkSession, path: str, metadata_only: bool = False) -> DataFrame:
    """`read` without an index: one task goes from front to back and finds where every `STRIDE`th record begins, and many decode what lies between."""
    h, _ = read_header(path)
    every = STRIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            edges = np.fromiter(flow(path, every), np.int64)
            first = np.arange(len(edges) - 1) * every
            columns = first, np.minimum(first + every, h.num_records), edges[:-1], edges[1:]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["first", "last", "start", "stop"])

    parts = -(-h.num_records // every)
    return read_spans(spark.range(0, 1, 1, 1).mapInArrow(run, SPAN).repartition(max(1, min(parts, 4096))), path, metadata_only)


def build_index(path: str) -> np.ndarray:
    """Positions of a container without an index; eight bytes a record."""
    return np.fromiter(flow(path), np.int64)[:-1]


def open_index(path: str) -> np.ndarray:
    """Positions of the records. An index that is missing, unreadable or of another number of records is built anew and saved."""
    h, _ = read_header(path)
    try:
        positions, virtual, _ = read_index(path + ".idx")
        if len(positions) == h.num_records and virtual == h.all_records:
            return positions
    except (FileNotFoundError, ValueError):
        pass
    positions = build_index(path)
    store, name = at(path)
    with store.open_output_stream(name + ".idx") as f:
        f.write(index_bytes(positions, h.all_records, int(positions[0]) >> 16 if h.all_records else 0))
    return positions


def index_rows(spark: SparkSession, path: str) -> DataFrame:
    """`(record_id, position, trace_position)`: positions as the index has them, and where the record's trace begins."""
    h, _ = read_header(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["record_id"], r["position"], trace_position(path, r["position"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, ["record_id", "position", "trace_position"])

    positions = open_index(path)
    parts = max(1, -(-len(positions) // SLICE))
    found = spark.createDataFrame(pa.table({"record_id": pa.array(np.arange(len(positions))), "position": pa.array(positions)}))
    return found.repartition(parts).mapInArrow(run, "record_id bigint, position bigint, trace_position bigint")


def trace_of(path: str, record_id: int, variant: str | None = None) -> tuple[list[dict], str, int]:
    """A record's trace, the metric and the greatest complexity of its container. IndexError for an id out of range."""
    h, _ = read_header(path)
    return trace_at(path, position_of(path, record_id), variant), h.metric, h.max_complexity


def position_of(path: str, record_id: int) -> int:
    """Where the trace of a record begins."""
    positions = open_index(path)
    if not 0 <= record_id < len(positions):
        raise IndexError("no such record")
    return trace_position(path, int(positions[record_id]))
