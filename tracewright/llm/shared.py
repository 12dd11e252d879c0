"""What several operators of this folder share: words, shared storage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, and tab to carriage return.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text as an array; null: none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a session that runs in one process may do without the setting."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return f"file://{tempfile.gettempdir()}/tracewright"


def materialize(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it: cuts the lineage in storage that outlives executors, and
    later readers take only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges(u, v)`, two BIGINT columns: rows `(node, component)` with the smallest node
    of each component, for every node that has an edge to another node.

    Alternates large-star and small-star rounds, so the number of rounds is logarithmic and no step gathers a
    node's neighbours: minima are aggregated map-side, and the join back is an inner sort-merge join, whose hot keys
    adaptive execution splits. Each round is written to the shared folder.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = materialize(e)
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minima(both)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        small = large.join(_minima(large), "u")
        e2 = small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(e2)
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    star = e.groupBy("u").agg(F.min("v").alias("component"))
    return star.select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _minima(e: DataFrame) -> DataFrame:
    """`(u, m)`. The key is made anew, so that a join on it shuffles the minima by themselves: adaptive execution splits the hot keys of a
    join of two shuffles, not of one with an aggregate."""
    return e.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not(F.bitwise_not("u")).alias("u"), "m")


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return (r["n"], r["h"])
