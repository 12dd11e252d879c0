"""Mixing sources to target weights by weighted fair queueing (operator 8), in DataFrame functions only.

Sources are ranked by code point, null last, and get the weights of `WEIGHTS` in turn. They share `BUDGET` times all
words by weight; a source takes at most `MAX_PASSES` times its own words, and what it can't take goes to the others by
weight until no source is above its limit. This share is the source's target.

Each source's documents are shuffled (by the md5 of id and text) and queue in that order, `MAX_PASSES` times over. A
document's virtual finish is the source's words up to its end divided by the target, so every source has been served in
proportion to its target at every point of virtual time, and at time 1 the words served add up to the budget. The mix is
the schedule range-sorted by virtual finish and cut there; the document in service at that moment is cut too, so each
source takes its target exactly, less a fraction of a word.

The queue position is a prefix sum over a source in shuffled order. It's computed by levels: rows within a bucket of the shuffle key,
buckets within the 4096 that share a longer prefix's beginning, and so on up, with as many buckets as rows ask for. A source that holds most
rows is spread over many tasks, and no window holds more than a bucket's rows or 4096 sums. Only ids, keys and sizes are
shuffled. The distinct sources are ranked in one task: a list of names.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, the last; rows of equal or null id
queue by the md5 of their texts, rows that repeat in any order; an empty table gives an empty table; other columns are not read (`mix`: are returned as they are, a
document once for every pass that takes it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, materialize, table

WEIGHTS, BUDGET, MAX_PASSES = (3, 1, 2), 1.5, 2
#: Rows of a bucket that one task sorts, on average.
ROWS_PER_BUCKET = 256
#: Hex digits of the key by which a level of sums is finer than the one above.
LEVEL_DIGITS = 3


def n_words(text: Column) -> Column:
    """Runs of non-space characters, counted without an array of them."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(one, " \t\n\x0b\f\r", "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, passes: int = MAX_PASSES) -> DataFrame:
    """`(source, source_size, weight, target)` per source from `(source, size)` rows.

    With sources in the order of limit / weight, a prefix reaches its limit and the rest share what is left by weight. A row's
    rate supposes that all sources before it are full; it rises along the prefix and falls behind it.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    pick = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (turn + 1).cast("int"))
    ranked = total.select("source", "source_size", pick.alias("weight"))
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    money = F.sum("source_size").over(every) * F.lit(float(budget)) - passes * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    fair = ranked.withColumn("__rate", money / rest)
    full = F.col("__rate") * F.col("weight") >= passes * F.col("source_size")
    rate = F.max(F.when(~full, F.col("__rate"))).over(W.partitionBy())
    share = F.when(full | rate.isNull(), passes * F.col("source_size").cast("double")).otherwise(rate * F.col("weight"))
    return fair.select("source", "source_size", "weight", share.alias("target"))


def before(by: DataFrame, digits: int) -> DataFrame:
    """`(__source, __bucket, __before)`: the sum of `__sum` over the source's buckets before, whose names have so many digits."""
    above = max(0, digits - LEVEL_DIGITS)
    coarse = F.substring("__bucket", 1, above) if above else F.lit("")
    own = by.withColumn("__coarse", coarse)
    inner = (F.sum("__sum").over(W.partitionBy("__source", "__coarse").orderBy("__bucket")) - F.col("__sum")).alias("__inner")
    if not above:
        return own.select("__source", "__bucket", inner).withColumnRenamed("__inner", "__before")
    up = before(own.groupBy("__source", F.col("__coarse").alias("__bucket")).agg(F.sum("__sum").alias("__sum")), above)
    up = up.select("__source", F.col("__bucket").alias("__coarse"), "__before")
    return own.select("__source", "__coarse", "__bucket", inner).join(up, ["__source", "__coarse"]).select("__source", "__bucket", (F.col("__before") + F.col("__inner")).alias("__before"))


def schedule(docs: DataFrame, keep: list[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET, **how) -> DataFrame:
    """A row per document: `keep`, doc_id, source, size, source_size, target, virtual_finish (of the first pass) and
    takes, the words that each pass takes: 0 where the pass comes after the cut."""
    passes = how.get("passes", MAX_PASSES)
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    slim = [F.col("doc_id"), F.col("source"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__source"), n_words(F.col("text")).alias("size"), key.alias("__key")]
    base = materialize(docs.select(*slim))
    digits, rows = 0, base.count()
    while 16**digits * rows_per_bucket < rows:
        digits += 1
    bucket = (F.substring("__key", 1, digits) if digits else F.lit("")).alias("__bucket")
    cut = (docs.select(*keep, *slim) if keep else base).select("*", bucket)
    by = base.select("__source", "size", bucket).groupBy("__source", "__bucket").agg(F.sum("size").alias("__sum"))
    base_of = before(by, digits)
    goal = targets(base, **how).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__source"), "source_size", "target")
    # one row for each source and bucket: a few thousand times fewer than documents; adaptive execution picks the join
    offsets = base_of.join(goal, "__source")
    within = W.partitionBy("__source", "__bucket").orderBy("__key", F.col("doc_id").asc_nulls_first(), "size")
    queued = cut.withColumn("__upto", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)))
    end = F.col("__before") + F.col("__upto")
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - p * F.col("source_size") - end + F.col("size"))).cast("long") for p in range(passes)]
    return queued.join(offsets, ["__source", "__bucket"]).select(*keep, "doc_id", "source", "size", "source_size", "target", F.try_divide(end.cast("double"), "target").alias("virtual_finish"), F.array(*takes).alias("takes"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents in the order of virtual finish, a document once for each pass that takes it."""
    marked = docs.select(F.struct("*").alias("__row"), "doc_id", "source", "text")
    passes = schedule(marked, ["__row"], **how).select("__row", "doc_id", "virtual_finish", "source_size", "target", F.posexplode("takes").alias("pass", "taken"))
    finish = F.col("virtual_finish") + F.try_divide(F.col("pass") * F.col("source_size"), "target")
    return passes.where("taken > 0").orderBy(finish, "doc_id").select("__row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule, range-sorted by virtual finish, with the words of all passes of a document added up."""
    s = schedule(table(spark, sf_dir, "documents"))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x)
    return s.orderBy("virtual_finish", "doc_id").select("doc_id", "size", "source_size", "target", taken.alias("taken"), "virtual_finish")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k,
         len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS i FROM w),
r AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - (2 * coalesce(sum(source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
               / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM o),
f AS (SELECT *, rate * weight >= 2 * source_size AS is_full FROM r),
t AS (SELECT source, source_size, CASE WHEN is_full OR (max(rate) FILTER (NOT is_full) OVER ()) IS NULL THEN (2 * source_size)::DOUBLE ELSE (max(rate) FILTER (NOT is_full) OVER ()) * weight END AS target FROM f),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target) - upto + size)) + greatest(0, least(size, floor(target) - source_size - upto + size)))::BIGINT AS taken,
       CASE WHEN target <> 0 THEN upto::DOUBLE / target END AS virtual_finish
FROM q
"""
