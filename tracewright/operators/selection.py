"""Which encoding for which stream: by rule, by name, or by measuring."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.streams import SIZES, all_sizes, varint_size

#: Fixed values of the format: names by code, layers by code.
STRATEGIES = ("raw", "zigzag-delta", "2d-delta", "rle", "bit-packed", "delta-of-delta", "frame-of-reference", "hybrid-rle", "xor-delta", "dictionary", "stream-vbyte", "fastpfor", "cascaded", "simple8b-full", "selective-rle", "rice", "huffman", "lz77", "elias-fano")
LAYERS = ("zstd", "bgzip", "nocomp")
MOST_LEVEL = 22
#: What wins of equal totals, the simpler decoder and the cheaper layer.
STRATEGY_RANK = ("raw", "zigzag-delta", "2d-delta", "rle", "bit-packed", "frame-of-reference", "hybrid-rle", "xor-delta", "delta-of-delta", "simple8b-full", "stream-vbyte", "dictionary", "rice", "huffman", "fastpfor", "cascaded", "selective-rle", "lz77", "elias-fano")
LAYER_RANK = ("nocomp", "zstd", "bgzip")
#: Records that a benchmark measures unless told otherwise.
SAMPLE = 10_000
ALIASES = {"for": "frame-of-reference", "dict": "dictionary", "streamvbyte": "stream-vbyte", "fast-pfor": "fastpfor", "simple8bfull": "simple8b-full", "selectiverle": "selective-rle", "ef": "elias-fano"}
#: (first, second) for a trace variant and complexity metric; None: any metric.
AUTOMATIC = {
    ("standard", "edit-distance"): ("rice", "2d-delta"),
    ("standard", "diagonal-distance"): ("raw", "2d-delta"),
    ("fastga", None): ("elias-fano", "huffman"),
    ("single", None): ("huffman", "raw"),
    ("variable", None): ("zigzag-delta", "2d-delta"),
    ("mixed", None): ("zigzag-delta", "2d-delta"),
}


@dataclass(frozen=True)
class Strategy:
    """sample: records that a benchmark measures (0: all). forced: the layer was named, so a benchmark measures no other."""

    name: str
    layer: str = "nocomp"
    level: int = 0
    sample: int | None = None
    forced: bool = False

    @property
    def code(self) -> int:
        return STRATEGIES.index(self.name)


def parse_strategy(text: str) -> Strategy:
    """`name[-layer][,level]`, and `benchmark[-layer][,level[,sample]]`; without a layer nothing is compressed; level 3 unless given, 0 without
    compression."""
    head, *rest = [p.strip() for p in text.strip().lower().split(",")]
    m = re.fullmatch(rf"(.+?)(?:-({'|'.join(LAYERS)}))?", head)
    name, layer = (ALIASES.get(m[1], m[1]), m[2] or "nocomp") if m else (head, "nocomp")
    if name not in (*STRATEGIES, "automatic", "benchmark") or len(rest) > 2:
        raise ValueError(f"unknown strategy: {text}")
    if any(not re.fullmatch(r"\+?[0-9]+", r) for r in rest) or int(rest[0] if rest else 0) > MOST_LEVEL:
        raise ValueError(f"bad level or sample in {text}: levels are 0 to {MOST_LEVEL}")
    level = int(rest[0]) if rest else (0 if layer == "nocomp" else 3)
    if name != "benchmark":
        return Strategy(name, layer, level)
    return Strategy(name, layer, level, int(rest[1]) if len(rest) > 1 else SAMPLE, m[2] is not None)


def automatic(variant: str, metric: str = "edit-distance", level: int = 0) -> tuple[Strategy, Strategy]:
    first, second = AUTOMATIC.get((variant, None)) or AUTOMATIC[variant, metric]
    return Strategy(first, level=level), Strategy(second, level=level)


def totals(records: DataFrame, stream: str) -> DataFrame:
    """`(strategy, total)`: encoded bytes with their length prefix over all records, for each encoding with a size expression. One aggregate: a task shuffles one
    row, whatever the number of encodings."""
    sized = records.select(all_sizes(F.col(stream)).alias("z"))
    sums = sized.agg(*[F.sum(F.col(f"z.`{k}`") + varint_size(F.col(f"z.`{k}`"))).cast("bigint").alias(k) for k in SIZES])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(f"`{k}`").alias("total")) for k in SIZES])))


def measured(records: DataFrame, stream: str, layers: tuple[str, ...] = LAYERS, level: int = 3, first: str | None = None) -> DataFrame:
    """`(strategy, layer, total)`: bytes with their length prefix as they are really written, for each encoding and layer. A
    pair that some stream doesn't fit has a null total. Streams stay where they are: a batch gives one row per pair. With
    `first`, `stream` is the second stream of pairs whose first is that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = {k: codecs.layer(k, level)[0] for k in layers}
        for b in batches:
            b = b.filter(pc.greater(pc.list_value_length(b.column(b.num_columns - 1)), 0))
            out = []
            for name in STRATEGIES:
                data = codecs.encode_all(name, b.column(b.num_columns - 1), b.column(0) if first else None).to_pylist()
                for k in layers:
                    sizes = np.array([len(squeeze[k](x)) for x in data if x is not None], np.int64)
                    out.append((name, k, int(sizes.sum() + codecs.varint_sizes(sizes).sum()), sum(x is None for x in data)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["strategy", "layer", "total", "failed"])

    parts = records.select(*([first] if first else []), stream).mapInArrow(run, "strategy string, layer string, total bigint, failed bigint")
    return parts.groupBy("strategy", "layer").agg(F.when(F.sum("failed") == 0, F.sum("total")).alias("total"))


def _rank(column: str, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in names]), F.col(column))


def best(total_rows: DataFrame, *by: str) -> DataFrame:
    """The encoding of the least total for each group of the columns `by`: `(*by, strategy, [layer,] total)`. Of equal totals the layer of the
    lower rank wins, then the strategy."""
    layered = "layer" in total_rows.columns
    kept = ["strategy", *(["layer"] if layered else []), "total"]
    order = F.struct("total", *([_rank("layer", LAYER_RANK).alias("l")] if layered else []), _rank("strategy", STRATEGY_RANK).alias("s"))
    return total_rows.where("total IS NOT NULL").groupBy(*by).agg(F.min_by(F.struct(*kept), order).alias("m")).where("m IS NOT NULL").select(*by, "m.*")


def best_measured(measured_rows: DataFrame, level: int = 3) -> Strategy:
    """The pair that `best` picks. ValueError if nothing fits."""
    m = best(measured_rows).first()
    if m is None:
        raise ValueError("no encoding fits")
    return Strategy(m["strategy"], m["layer"], 0 if m["layer"] == "nocomp" else level)


def chosen(records: DataFrame, first: Strategy, second: Strategy, variant: str, metric: str = "edit-distance", all_records: bool = False) -> tuple[Strategy, Strategy]:
    """Strategies to write with. Where either is `automatic`, both follow the rule for variant and metric; otherwise, where either is
    `benchmark`, both are measured on the traces of the first `sample` records (0: all), and each stream takes its best. The
    values measured are those written: pairs as pairs, operations with the first values, missing second values left out. All layers are
    measured unless one is forced, or all records are compressed in one section: then zstd stands for it."""
    names = {first.name, second.name}
    if "automatic" in names:
        return automatic(variant, metric, next(x.level for x in (first, second) if x.name == "automatic"))
    if "benchmark" not in names:
        return first, second
    asked = first if first.name == "benchmark" else second
    if asked.sample:
        records = records.orderBy("record_id").limit(asked.sample)
    level = asked.level or 3
    layers = (asked.layer,) if asked.forced else ("zstd",) if all_records else LAYERS
    pick = lambda c, keep: F.transform(F.filter("trace", keep), lambda x: x[c]).alias(c)
    paired = variant in ("standard", "fastga")
    streams = records.where("size(trace) > 0").select(pick("a", lambda x: F.lit(True)), pick("b", lambda x: F.lit(True) if paired else x["b"].isNotNull()))
    a = best_measured(measured(streams, "a", layers, level), level)
    if variant == "single":
        return a, Strategy("raw")
    return a, best_measured(measured(streams, "b", layers, level, "a" if paired else None), level)
