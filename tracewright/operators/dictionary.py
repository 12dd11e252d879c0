"""Names as ids by first sight, offsets by order: global order without a global sort into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exclusive_prefix(df: DataFrame, order: str, value: Column, name: str, width: int) -> DataFrame:
    """The sum of `value` over the rows before, by the BIGINT column `order`. Two levels: sums of ranges of `width` keys, prefixed
    (one small row per range), then a window within a range."""
    part = F.floor(F.col(order) / width)
    cut = df.withColumn("__part", part).withColumn("__v", value)
    sums = cut.groupBy("__part").agg(F.sum("__v").alias("__sum"))
    # ranges are prefixed in groups of ranges again, so that no window holds them all
    sums = sums.withColumn("__top", F.floor(F.col("__part") / 4096))
    tops = sums.groupBy("__top").agg(F.sum("__sum").alias("__topsum"))
    tops = tops.select("__top", (F.sum("__topsum").over(W.orderBy("__top")) - F.col("__topsum")).alias("__topbase"))
    inner = (F.sum("__sum").over(W.partitionBy("__top").orderBy("__part")) - F.col("__sum")).alias("__inner")
    bases = sums.select("__part", "__top", inner).join(tops, "__top").select("__part", (F.col("__inner") + F.col("__topbase")).alias("__base"))
    own = F.sum("__v").over(W.partitionBy("__part").orderBy(order)) - F.col("__v")
    return cut.withColumn("__own", own).join(bases, "__part").withColumn(name, (F.col("__own") + F.col("__base")).cast("bigint")).drop("__part", "__v", "__own", "__base")


def names(records: DataFrame) -> DataFrame:
    """`(pos, name, length)`: the query of a record comes before its target."""
    both = F.array(*[F.struct((2 * F.col("record_id") + k).alias("pos"), F.col(f"{r}_name").alias("name"), F.col(f"{r}_len").alias("length")) for k, r in enumerate(("query", "target"))])
    return records.select(F.inline(both))


def string_table(names: DataFrame, width: int = 1 << 16) -> DataFrame:
    """`(id, name, length)` from `(pos, name, length)`: ids from 0 in order of first sight, the length first seen."""
    first = names.groupBy("name").agg(F.min(F.struct("pos", "length")).alias("m")).select("name", "m.pos", "m.length")
    return exclusive_prefix(first, "pos", F.lit(1).cast("bigint"), "id", width).select("id", "name", "length")


def ids_of(wanted: DataFrame, strings: DataFrame) -> DataFrame:
    """`wanted(name)` with `id` and `length`; null for names that aren't in the table."""
    return wanted.join(strings.select("name", "id", "length"), "name", "left")


def resolve(records: DataFrame, strings: DataFrame) -> DataFrame:
    """Names and lengths for query_name_id and target_name_id; adaptive execution broadcasts a small table. An id that isn't in the table is an
    error when the row is read."""
    for role in ("query", "target"):
        key = f"{role}_name_id"
        side = strings.select(F.col("id").alias(key), F.col("name").alias(f"{role}_name"), F.col("length").alias(f"{role}_len"))
        missing = F.raise_error(F.concat(F.lit(f"unknown {role} name id "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        records = records.join(side, key, "left").withColumn(f"{role}_name", F.coalesce(f"{role}_name", missing.cast("string")))
    return records
