"""Queries over the choice of encodings and over reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import traces as T
from ..functions.streams import total
from ..operators import reports, selection
from . import orders
from .registry import _RESULTS, ITEMS, _results, query, trace_format

#: Names by code, each with its rank among equal totals.
_RANKS = """('raw', 0, 0), ('zigzag-delta', 1, 1), ('2d-delta', 2, 2), ('rle', 3, 3), ('bit-packed', 4, 4), ('delta-of-delta', 5, 8), ('frame-of-reference', 6, 5), ('hybrid-rle', 7, 6), ('xor-delta', 8, 7),
('dictionary', 9, 11), ('stream-vbyte', 10, 10), ('fastpfor', 11, 14), ('cascaded', 12, 15), ('simple8b-full', 13, 9), ('selective-rle', 14, 16), ('rice', 15, 12), ('huffman', 16, 13), ('lz77', 17, 17), ('elias-fano', 18, 18)"""


@query(
    "benchmark_ties",
    f"""WITH s(strategy, code, rank) AS (VALUES {_RANKS}), l(layer, layer_rank) AS (VALUES ('nocomp', 0), ('zstd', 1), ('bgzip', 2)),
t AS (SELECT CAST(k AS BIGINT) AS k, strategy, layer, rank, layer_rank FROM s, l, range(0, 19) r(k) WHERE code >= k AND layer_rank >= k % 3)
SELECT k, strategy, layer, (SELECT count(*) FROM lineitem) AS total FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY layer_rank, rank) = 1""",
)
def benchmark_ties(spark: SparkSession, d: str) -> DataFrame:
    """All encodings from the k-th on, and the layers from the k-th modulo 3 on, with equal totals."""
    layers = ("nocomp", "zstd", "bgzip")
    rows = [(k, s, layer) for k in range(19) for code, s in enumerate(selection.STRATEGIES) for j, layer in enumerate(layers) if code >= k and j >= k % 3]
    n = orders.table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("total"))
    return selection.best(spark.createDataFrame(rows, "k bigint, strategy string, layer string").join(F.broadcast(n)), "k")


_ASK = "CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 7) * 60 + o_orderkey % 60 + 0.25 WHEN 1 THEN o_orderkey + 0.5 WHEN 3 THEN 0 END"


@query(
    "report_units",
    f"""SELECT o_orderkey AS record_id, CAST({_ASK} AS DOUBLE) AS seconds, CASE o_orderkey % 3 WHEN 0 THEN round(o_orderkey / 1024.0::DOUBLE, 2) WHEN 2 THEN 0 END::DOUBLE AS mb,
CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE round(o_orderkey / (o_orderkey % 5)::DOUBLE, 3) END::DOUBLE AS ratio FROM orders""",
)
def report_units(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    time = F.when(k % 4 == 0, F.concat(text(k % 7), F.lit(":"), text(k % 60), F.lit(".25"))).when(k % 4 == 1, F.concat(text(k), F.lit(".5"))).when(k % 4 == 2, "NA").otherwise("half an hour")
    kb = F.when(k % 3 == 0, text(k)).when(k % 3 == 1, "NA").otherwise("much")
    return orders.table(spark, d, "orders").select(k.alias("record_id"), reports.seconds(time).alias("seconds"), reports.megabytes(kb).alias("mb"), reports.safe_ratio(k, k % 5).alias("ratio"))


@query(
    "report_ranked",
    f"""WITH {_RESULTS}, a AS (SELECT *, 'manual' AS compression_strategy FROM m UNION ALL SELECT *, 'automatic' FROM m WHERE strategy = 'rice')
SELECT dataset_name, compression_strategy, strategy AS strategy_first, CAST(row_number() OVER (PARTITION BY dataset_name ORDER BY ratio DESC, strategy, compression_strategy) AS INTEGER) AS place FROM a""",
)
def report_ranked(spark: SparkSession, d: str) -> DataFrame:
    return reports.ranked(_results(spark, d)).select("dataset_name", "compression_strategy", "strategy_first", "place")


@query("trace_lax", f"WITH {ITEMS} SELECT record_id, count(*) AS n, CAST(sum(a) AS BIGINT) AS sum_a, CAST(sum(b) AS BIGINT) AS sum_b FROM items GROUP BY record_id")
def trace_lax(spark: SparkSession, d: str) -> DataFrame:
    """Empty items before, between and after are dropped."""
    spaced = F.concat(F.lit(";"), F.replace("trace", F.lit(";"), F.lit(";;")), F.lit(";"))
    t = trace_format(spark, d).select("record_id", T.parse_trace(spaced, "standard", lax=True).alias("t"))
    return t.select("record_id", F.size("t").cast("bigint").alias("n"), total(F.col("t.a")).alias("sum_a"), total(F.col("t.b")).alias("sum_b"))
