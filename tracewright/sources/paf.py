"""PAF text as a DataFrame, and back. Malformed lines are rejects with a reason, never lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.traces import format_trace, number, parse_trace
from . import text

LONGS = ("query_len", "query_start", "query_end", "target_len", "target_start", "target_end", "residue_matches", "alignment_block_len")
FIELDS = ("query_name", "query_len", "query_start", "query_end", "strand", "target_name", "target_len", "target_start", "target_end", "residue_matches", "alignment_block_len", "mapping_quality")

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are valid UTF-8, not blank and no comment, with their place (file, then row) for the input order. `-` is standard
    input; names that end in `.gz` or `.bgz` are decompressed, the latter in parallel."""
    if path == "-":
        path = text.spool_stdin(spark)
    if path.endswith(".bgz"):
        return kept_lines(text.read_bgzf(spark, path).withColumn("value", F.col("value").cast("string")))
    raw = spark.read.option("lineSep", "\n").text(path)
    return kept_lines(raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))

def kept_lines(raw: DataFrame) -> DataFrame:
    line = F.trim("value")
    return raw.withColumn("value", F.rtrim(F.col("value"), F.lit("\r"))).where(F.is_valid_utf8("value") & (line != "") & ~line.startswith("#"))

def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first n lines in the order of the input. A top-k: each task sends n rows at most."""
    return lines.orderBy("row").limit(n)


def names_only(lines: DataFrame) -> DataFrame:
    """Names and lengths of `lines` by the first seven fields; what follows isn't split. Lines whose fields don't fit are left out."""
    f = F.split("value", "\t", 8)
    cols = [(number(F.get(f, F.lit(k))) if name in LONGS else F.get(f, F.lit(k))).alias(name) for k, name in enumerate(FIELDS[:7]) if name in ("query_name", "query_len", "target_name", "target_len")]
    return lines.select(F.col("row").alias("record_id"), *cols).dropna()


def parse_tag(field: Column) -> Column:
    """STRUCT<key, type, i, f, s>, or null for a tag that isn't kept."""
    part = F.split(field, ":", 3)
    kind = F.substring(F.get(part, F.lit(1)), 1, 1)
    value = F.get(part, F.lit(2))
    i = F.when((kind == "i") & value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("int"))
    f = F.when((kind == "f") & value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("float"))
    s = F.when(kind == "Z", value)
    ok = (F.size(part) == 3) & (F.octet_length(part[0]) == 2) & (i.isNotNull() | f.isNotNull() | s.isNotNull())
    return F.when(ok, F.struct(part[0].alias("key"), kind.alias("type"), i.alias("i"), f.alias("f"), s.alias("s")))

def parse(lines: DataFrame, variant: str = "standard") -> DataFrame:
    """`lines` with typed fields, trace, cigar, tags and `reject`, which is null for a good line."""
    f = F.split("value", "\t", -1)
    got = lines.withColumn("__f", f)
    at = lambda k: F.get("__f", F.lit(k))
    cols = []
    for k, name in enumerate(FIELDS):
        v = at(k)
        cols.append((number(v) if name in LONGS else F.substring(v, 1, 1) if name == "strand" else number(v, "smallint") if name == "mapping_quality" else v).alias(name))
    tags = F.slice("__f", 13, F.greatest(F.lit(0), F.size("__f") - 12))

    has = lambda p: F.exists(tags, lambda x: F.startswith(x, F.lit(p)))
    cut = lambda p: F.when(has(p), F.substring(F.get(F.filter(tags, lambda x: F.startswith(x, F.lit(p))), F.size(F.filter(tags, lambda x: F.startswith(x, F.lit(p)))) - 1), len(p) + 1, 1 << 30))
    kept = F.filter(F.transform(F.filter(tags, lambda x: ~F.startswith(x, F.lit("tp:Z:")) & ~F.startswith(x, F.lit("cg:Z:"))), parse_tag), lambda t: t.isNotNull())

    out = got.select(*lines.columns, *cols, cut("tp:Z:").alias("__tp"), cut("cg:Z:").alias("cigar"), kept.alias("tags"), F.size("__f").alias("__n"))
    out = out.withColumn("trace", F.when(F.col("__tp").isNotNull(), parse_trace(F.col("__tp"), variant)))
    bad = F.when(F.col("__n") < 12, "fewer than 12 fields")
    for name in (*LONGS, "mapping_quality"):
        wrong = F.col(name).isNull() | ((F.col(name) > 255) if name == "mapping_quality" else F.lit(False))
        bad = bad.when(wrong, f"bad {name}")
    bad = bad.when(F.col("__tp").isNull() & F.col("cigar").isNull(), "neither trace nor cigar").when(F.col("__tp").isNotNull() & F.col("trace").isNull(), "bad trace")
    return out.withColumn("reject", bad).drop("__tp", "__n")

def format_tag(t: Column) -> Column:
    return F.concat_ws(":", t["key"], F.when(t["type"] == "i", F.concat(F.lit("i:"), t["i"].cast("string"))).when(t["type"] == "f", F.concat(F.lit("f:"), F.format_string("%.8f", t["f"].cast("double")))).otherwise(F.concat(F.lit("Z:"), t["s"])))

def line() -> Column:
    """12 fields, the tags in order, the trace last."""
    fields = [F.col(c).cast("string") for c in FIELDS]
    return F.concat_ws("\t", *fields, F.transform("tags", format_tag), F.concat(F.lit("tp:Z:"), format_trace(F.col("trace"))))

def to_lines(records: DataFrame) -> DataFrame:
    """One `value` per record."""
    return records.select(line().alias("value"))

def normalize(lines: DataFrame) -> DataFrame:
    """Lines of equal content as equal `value`s: tags in the order of their keys (those of one key as they stand), float tags as 32-bit
    floats with three decimals, ties to even."""
    f = F.split(F.rtrim("value", F.lit("\r")), "\t", -1)
    tags = F.slice(f, 13, F.greatest(F.lit(0), F.size(f) - 12))
    number_ = r"^([^:]*:f:)([0-9]+\.?[0-9]*|\.[0-9]+)$"

    def rounded(t: Column) -> Column:
        v = F.regexp_extract(t, number_, 2).try_cast("float").cast("double")
        return F.when(t.rlike(number_), F.concat(F.regexp_extract(t, number_, 1), F.format_string("%.3f", F.bround(v, 3)))).otherwise(t)

    ordered = F.array_sort(F.transform(tags, lambda t, k: F.struct(F.substring(t, 1, 2).alias("key"), k.alias("k"), rounded(t).alias("t"))))
    return lines.withColumn("value", F.concat_ws("\t", F.slice(f, 1, 12), F.transform(ordered, lambda x: x["t"])))
