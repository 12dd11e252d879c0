"""PAF text to a container and back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alignment import cigar_to_trace
from ..operators.contigs import split_by_contigs
from ..operators.dictionary import exclusive_prefix
from ..operators.selection import chosen
from ..sources import container, paf


def records_of(spark: SparkSession, path: str, header: container.Header = container.Header(), contigs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """`(records, rejects)` of PAF text. A line without a trace gets that of its CIGAR. With `contigs` (fastga only), lines that have no trace
    and a listed name are split; the segments of a line follow each other."""
    rows = paf.parse(paf.read_lines(spark, path), header.variant).withColumn("record_id", F.col("row"))
    rejects, good = rows.where("reject IS NOT NULL"), rows.where("reject IS NULL")
    made = cigar_to_trace(F.col("cigar"), F.col("query_start"), header.variant, header.max_complexity, header.metric)
    cols = ["record_id", *paf.FIELDS, "trace", "tags"]
    if contigs is None or header.variant != "fastga":
        return good.withColumn("trace", F.coalesce("trace", made)).select(*cols), rejects
    listed = contigs.where("name IS NOT NULL AND start < end").select("name").distinct().withColumn("__in", F.lit(True))
    for role in ("query", "target"):
        good = good.join(listed.select(F.col("name").alias(f"{role}_name"), F.col("__in").alias(f"__{role}")), f"{role}_name", "left")
    split = F.col("trace").isNull() & F.coalesce("__query", "__target", F.lit(False))
    whole = good.where(~split).withColumn("trace", F.coalesce("trace", made)).select(*cols, F.lit(0).alias("segment"))
    pieces = split_by_contigs(good.where(split).select("record_id", *paf.FIELDS, "cigar", "trace", "tags"), contigs, header.max_complexity).select(*cols, "segment")
    both = whole.unionByName(pieces)
    most = both.groupBy("record_id").agg(F.count(F.lit(1)).cast("bigint").alias("__n"))
    base = exclusive_prefix(most, "record_id", F.col("__n"), "before", 1 << 16).select("record_id", "before")
    return both.join(base, "record_id").withColumn("record_id", F.col("before") + F.col("segment")).select(*cols), rejects


def paf_to_container(spark: SparkSession, source: str, path: str, header: container.Header = container.Header(), contigs: DataFrame | None = None) -> dict[str, int]:  # noqa: B008
    """Writes `path` and its index; counts, `rejected` being records that can't be written and `lines_rejected` lines that aren't
    records. The strategies of the header may be `automatic` or `benchmark`. With all records in one compressed section, streams aren't compressed by themselves."""
    records, rejects = records_of(spark, source, header, contigs)
    first, second = chosen(records, header.first, header.second, header.variant, header.metric, header.all_records)
    out = container.write(records, path, replace(header, first=first, second=second))
    return {**out, "lines_rejected": rejects.count()}


def container_lines(spark: SparkSession, path: str) -> DataFrame:
    """`(record_id, value)`: a PAF line per record."""
    r = container.read_resolved(spark, path)
    return r.select("record_id", paf.line().alias("value"))


def container_to_paf(spark: SparkSession, path: str, folder: str) -> None:
    """Lines in the order of the records, over as many files as it takes."""
    container_lines(spark, path).repartitionByRange("record_id").sortWithinPartitions("record_id").select("value").write.mode("errorifexists").text(folder)


def view(spark: SparkSession, path: str) -> Iterator[str]:
    """What a person reads: header, names, records; one partition at a time."""
    h, _ = container.read_header(path)
    show = lambda s: f"{s.name} ({s.layer})"
    yield from (f"records: {h.num_records}", f"names: {h.num_strings}", f"strategies: {show(h.first)} / {show(h.second)}", f"variant: {h.variant}", f"metric: {h.metric}", f"max complexity: {h.max_complexity}", f"distance: {' '.join(map(str, h.distance))}", f"all records in one section: {'yes' if h.all_records else 'no'}")
    for r in container.read_strings(spark, path).toLocalIterator():
        yield f"{r['id']}: {r['name']} (length: {r['length']})"
    for r in container_lines(spark, path).repartitionByRange("record_id").sortWithinPartitions("record_id").toLocalIterator():
        yield r["value"]


def strategies(path: str) -> str:
    """First and second strategy and layer, by tabs."""
    h, _ = container.read_header(path)
    return "\t".join((h.first.name, h.second.name, h.first.layer, h.second.layer))

