"""Reports over results of encoding runs: which encoding is best, and whether the automatic choice found it.

A result has `dataset_name`, `compression_strategy` (its name; those that begin with `automatic` or `benchmark` chose for themselves),
`strategy_first`, `strategy_second`, `compression_layer_first`, `compression_layer_second` and the metrics. Ties go to the encoding
whose names come first, so that reruns agree. Everything is one aggregate a data set, joined back where rows are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHOICE = ("strategy_first", "strategy_second", "compression_layer_first", "compression_layer_second")
CHOOSES = r"^(automatic|benchmark)"
#: Seed, factor and step of the generator of seek positions, so that runs compare.
SEED, FACTOR, STEP = 12345, 1103515245, 12345


def _best(metric: Column, most: bool) -> Column:
    """The choice with the best metric; rows without the metric don't count."""
    by = F.when(metric.isNotNull(), F.struct((-metric if most else metric).alias("m"), *CHOICE))
    return F.min_by(F.struct(*CHOICE, metric.alias("value")), by)


def best_and_automatic(results: DataFrame, metric: str = "ratio_tp_to_tpa") -> DataFrame:
    """Each row that chose for itself beside the best of the others in its data set: `best_*`, and whether both are the same. A data set
    without other rows gives nulls."""
    own = F.col("compression_strategy").rlike(CHOOSES)
    best = results.where(~own).groupBy("dataset_name").agg(_best(F.col(metric), True).alias("b"))
    best = best.select("dataset_name", *[F.col(f"b.{c}").alias(f"best_{c}") for c in CHOICE], F.col("b.value").alias(f"best_{metric}"))
    same = F.lit(True)
    for c in CHOICE:
        same = same & F.col(c).eqNullSafe(F.col(f"best_{c}"))
    found = results.where(own).select("dataset_name", "compression_strategy", *CHOICE, metric)
    return found.join(best, "dataset_name", "left").withColumn("same", F.when(F.col(f"best_{metric}").isNotNull(), same))


def best_per_metric(results: DataFrame) -> DataFrame:
    """For each data set the encoding of the best ratio, seek, time, and balance of ratio and seek (ratio / (seek / 10))."""
    ratio, seek, took = (F.col(c) for c in ("ratio_orig_to_tpa", "direct_seek_avg_us", "compression_runtime_sec"))
    metrics = {"ratio": (ratio, True), "seek": (seek, False), "compression_time": (took, False), "balance": (F.try_divide(ratio, seek / 10), True)}
    wide = results.groupBy("dataset_name").agg(*[_best(c, most).alias(k) for k, (c, most) in metrics.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"{k}.strategy_first").alias("strategy_first"), F.col(f"{k}.strategy_second").alias("strategy_second"), F.col(f"{k}.value").cast("double").alias("value")) for k in metrics])
    return wide.select("dataset_name", F.inline(rows)).where("value IS NOT NULL")


def summary(results: DataFrame) -> DataFrame:
    """Per data set: rows, distinct pairs of strategies, mean ratio, share of rows that passed verification."""
    return results.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("strategy_first", "strategy_second").alias("pairs"),
        F.avg("ratio_orig_to_tpa").alias("mean_ratio"),
        F.avg((F.col("verification_passed") == "yes").cast("int")).alias("pass_rate"),
    )


def safe_ratio(numerator: Column, denominator: Column, decimals: int = 3) -> Column:
    """The quotient, rounded; 0 for a denominator of 0 or a missing number."""
    return F.round(F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)), decimals)


def seconds(text: Column) -> Column:
    """Seconds of `minutes:seconds.part` or of a plain number; null for `NA`, 0 for anything else."""
    minutes = r"^([0-9]+):([0-9]+\.[0-9]+)$"
    long = F.regexp_extract(text, minutes, 1).try_cast("double") * 60 + F.regexp_extract(text, minutes, 2).try_cast("double")
    plain = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))
    return F.when(text == "NA", None).otherwise(F.round(F.coalesce(F.when(text.rlike(minutes), long), plain, F.lit(0.0)), 3))


def megabytes(kilobytes: Column) -> Column:
    """Of a text with kilobytes; null for `NA`, 0 for what is no number."""
    return F.when(kilobytes == "NA", None).otherwise(F.round(F.coalesce(kilobytes.try_cast("double"), F.lit(0.0)) / 1024, 2))


def ranked(results: DataFrame, metric: str = "ratio_orig_to_tpa") -> DataFrame:
    """The results of each data set from the highest metric down, with their `place`; ties by the names of the encoding, missing metrics last."""
    order = W.partitionBy("dataset_name").orderBy(F.col(metric).desc_nulls_last(), *CHOICE, "compression_strategy")
    return results.withColumn("place", F.row_number().over(order))


def seek_summary(seeks: DataFrame) -> DataFrame:
    """`(decoded boolean, valid boolean, us double)` per seek as mean time and ratios, 0 without seeks."""
    share = lambda c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")), F.lit(0.0))
    return seeks.agg(F.coalesce(F.avg("us"), F.lit(0.0)).alias("avg_us"), share("decoded").alias("decode_ratio"), share("valid").alias("valid_ratio"))


def seek_positions(wanted: int, records: int, seed: int = SEED) -> Iterator[int]:
    """Distinct record ids from a linear congruential generator of 64 bits. Where it doesn't reach
    `wanted` ids, those not yet given follow in order."""
    seen: set[int] = set()
    wanted = min(wanted, records)
    for _ in range(64 * wanted + 1024):
        if len(seen) == wanted:
            return
        seed = (seed * FACTOR + STEP) % (1 << 64)
        if (k := seed % records) not in seen:
            seen.add(k)
            yield k
    rest = (k for k in range(records) if k not in seen)
    for _ in range(wanted - len(seen)):
        yield next(rest)
