"""PAF text that keeps arriving in a folder, as a stream: records as they come, and running totals of encoded sizes.

Records need no state. Totals keep one row per encoding, whatever the length of the stream, and need no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.streams import SIZES, varint_size
from ..sources.paf import kept_lines, parse


def read_stream(spark: SparkSession, path: str, variant: str = "standard", files_per_trigger: int = 1000) -> DataFrame:
    """The rows of `sources.paf.parse` for each new file, rejects included. Files must appear whole, by a rename."""
    raw = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse(kept_lines(raw.select("value", F.col("_metadata.file_path").alias("file"))), variant)


def running_totals(records: DataFrame) -> DataFrame:
    """`(strategy, records, total)` over the first values of all traces so far: bytes with their length prefix. For output modes `complete` and `update`."""
    first = F.col("trace.a")
    sizes = F.array(*[F.struct(F.lit(k).alias("strategy"), f(first).alias("size")) for k, f in SIZES.items()])
    flat = records.where("reject IS NULL AND trace IS NOT NULL").select(F.inline(sizes))
    return flat.groupBy("strategy").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("size") + varint_size(F.col("size"))).cast("bigint").alias("total"))
