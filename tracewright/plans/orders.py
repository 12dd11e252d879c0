"""Alignment records made of the driver's tables: one per order that has lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(record_id, items)`, items being structs with a, b, v, op in order. One shuffle, by order."""
    op = F.when(F.col("l_returnflag") == "N", "=").when(F.col("l_returnflag") == "R", "X").when(F.col("l_linestatus") == "F", "I").otherwise("D")
    a = F.col("l_quantity").cast("bigint")
    item = F.struct(*KEY, a.alias("a"), (a + F.col("l_linenumber") % 3 - 1).alias("b"), F.col("l_partkey").alias("v"), op.alias("op"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), item.alias("item")).groupBy("record_id").agg(F.array_sort(F.collect_list("item")).alias("items"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(record_id, a, b, v)` as arrays."""
    return records(spark, sf_dir).select("record_id", *[F.col(f"items.{c}").alias(c) for c in ("a", "b", "v")])


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(pos, name, length)` of `dictionary.names` of `named`, but only where a customer or part is first seen: keys are reduced before names join."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct(*KEY)).alias("f")).select(F.col("l_orderkey").alias("record_id"), F.col("f.l_partkey").alias("p"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_custkey")
    both = F.array(*[F.struct(F.lit(k).alias("role"), F.col(x).alias("key"), (2 * F.col("record_id") + k).alias("pos")) for k, x in enumerate(("o_custkey", "p"))])
    keys = first.join(o, "record_id").select(F.inline(both)).groupBy("role", "key").agg(F.min("pos").alias("pos"))
    known = [table(spark, sf_dir, t).select(F.lit(k).alias("role"), F.col(f"{t[0]}_{key}").alias("key"), F.col(f"{t[0]}_name").alias("name"), F.lit(base).alias("base")) for k, (t, key, base) in enumerate((("customer", "custkey", 100000), ("part", "partkey", 1000)))]
    return keys.join(known[0].unionByName(known[1]), ["role", "key"]).select("pos", "name", (F.col("base") + F.col("key")).cast("bigint").alias("length"))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(record_id, query_name, query_len, target_name, target_len, strand)`."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct(*KEY)).alias("f")).select(F.col("l_orderkey").alias("record_id"), F.col("f.l_partkey").alias("p"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("query_name"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_name").alias("target_name"))
    joined = first.join(o, "record_id").join(c, "o_custkey").join(p, "p")
    return joined.select("record_id", "query_name", (F.lit(100000) + F.col("o_custkey")).cast("bigint").alias("query_len"), "target_name", (F.lit(1000) + F.col("p")).cast("bigint").alias("target_len"), F.when(F.col("record_id") % 2 == 0, "+").otherwise("-").alias("strand"))
