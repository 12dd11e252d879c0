"""Queries that go through files: PAF text with good and bad lines, and containers of all variants."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.streams import total
from ..operators.selection import Strategy
from ..sources import container, paf, text
from . import convert, orders
from .registry import _NAMES, query, trace_format, vs

#: What is wrong with the line of a record, by its id modulo 40; 6 is a comment, any other a good line.
FAULTS = {1: "fewer than 12 fields", 2: "bad mapping_quality", 3: "neither trace nor cigar", 4: "bad trace", 5: "bad query_len"}


def new_path(spark: SparkSession) -> str:
    base = text.shared_folder(spark)
    store, folder = container.at(base)
    store.create_dir(folder)
    return f"{base}/{uuid.uuid4().hex}"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """`(record_id, value)`."""
    kind = F.col("record_id") % 40
    sums = orders.streams(spark, d).select("record_id", total(F.col("a")).alias("qe"), total(F.col("b")).alias("te"))
    r = orders.named(spark, d).join(sums, "record_id").join(trace_format(spark, d), "record_id")
    head = [
        "query_name", F.when(kind == 5, F.lit("x")).otherwise(F.col("query_len").cast("string")), F.lit("0"), "qe", "strand", "target_name", "target_len", F.lit("0"), "te",
        F.least("qe", "te").cast("string"), "qe",
    ]
    rest = [
        F.when(kind == 2, F.lit("300")).otherwise((F.col("record_id") % 61).cast("string")), F.concat(F.lit("NM:i:"), F.col("record_id").cast("string")),
        F.when(kind == 3, F.lit("xx:Z:none")).otherwise(F.concat(F.lit("tp:Z:"), F.col("trace"), F.when(kind == 4, ";").otherwise(""))),
    ]
    value = F.concat_ws("\t", *head, F.when(kind != 1, F.concat_ws("\t", *rest)))
    return r.select("record_id", F.when(kind == 6, F.concat(F.lit("# "), value)).otherwise(value).alias("value"))


@functools.lru_cache
def _written(application: str, d: str, one_file: bool) -> str:
    spark = SparkSession.getActiveSession()
    df = lines(spark, d)
    path = new_path(spark)
    (df.coalesce(1).sortWithinPartitions("record_id") if one_file else df).select("value").write.text(path)
    return path


def paf_path(spark: SparkSession, d: str, one_file: bool = False) -> str:
    """The lines as text files, written once a session."""
    return _written(spark.sparkContext.applicationId, d, one_file)


_LINE = f"""{_NAMES}, k AS (SELECT record_id, CAST(sum(a) AS BIGINT) AS qe, CAST(sum(b) AS BIGINT) AS te, count(*) AS n_items, CAST(sum(a * i) AS BIGINT) AS first, CAST(sum(b * i) AS BIGINT) AS second, string_agg(a || ',' || b, ';' ORDER BY i) AS trace FROM items GROUP BY record_id),
r AS (SELECT *, record_id % 40 AS kind, CASE WHEN record_id % 2 = 0 THEN '+' ELSE '-' END AS strand, record_id % 61 AS mapq FROM n JOIN k USING (record_id)),
good AS (SELECT *, concat_ws(chr(9), query_name, query_len, 0, qe, strand, target_name, target_len, 0, te, least(qe, te), qe, mapq, 'NM:i:' || record_id, 'tp:Z:' || trace) AS value FROM r WHERE kind NOT BETWEEN 1 AND 6)"""


@query("paf_records", f"WITH {_LINE} SELECT record_id, query_name, CAST(query_len AS BIGINT) AS query_len, qe AS query_end, strand, target_name, te AS target_end, CAST(mapq AS INTEGER) AS mapping_quality, n_items, first, second FROM good")
def paf_records(spark: SparkSession, d: str) -> DataFrame:
    good = paf.parse(paf.read_lines(spark, paf_path(spark, d))).where("reject IS NULL")
    return good.select(
        F.col("tags")[0]["i"].cast("bigint").alias("record_id"), "query_name", "query_len", "query_end", "strand", "target_name", "target_end",
        F.col("mapping_quality").cast("int").alias("mapping_quality"), F.size("trace").cast("bigint").alias("n_items"), weighted("a").alias("first"), weighted("b").alias("second"),
    )


def weighted(field: str) -> Column:
    return F.aggregate(F.transform(f"trace.{field}", lambda x, k: F.coalesce(x, F.lit(0)) * (k + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)


_REASONS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in FAULTS.items())


@query("paf_rejects", f"WITH {_LINE} SELECT CASE kind {_REASONS} END AS reject, count(*) AS n FROM r WHERE kind BETWEEN 1 AND 5 GROUP BY ALL")
def paf_rejects(spark: SparkSession, d: str) -> DataFrame:
    return paf.parse(paf.read_lines(spark, paf_path(spark, d))).where("reject IS NOT NULL").groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


@query("paf_names", f"WITH {_LINE} SELECT query_name, CAST(query_len AS BIGINT) AS query_len, target_name, CAST(target_len AS BIGINT) AS target_len FROM r WHERE kind NOT IN (5, 6)")
def paf_names(spark: SparkSession, d: str) -> DataFrame:
    return paf.names_only(paf.read_lines(spark, paf_path(spark, d))).select("query_name", "query_len", "target_name", "target_len")


@query("paf_first_lines", f"WITH {_LINE} SELECT value FROM good WHERE kind NOT BETWEEN 1 AND 6 ORDER BY record_id LIMIT 20")
def paf_first_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 of the good lines."""
    good = paf.parse(paf.read_lines(spark, paf_path(spark, d, True))).where("reject IS NULL")
    return paf.first_lines(good, 20).select("value")


@functools.lru_cache
def _converted(application: str, source: str) -> str:
    spark = SparkSession.getActiveSession()
    path = new_path(spark) + ".bin"
    convert.paf_to_container(spark, source, path, container.Header(Strategy("automatic"), Strategy("automatic")))
    return path


_FIRST_LENGTH = "lens AS (SELECT target_name, arg_min(target_len, record_id) AS first_len FROM good GROUP BY target_name)"


@query("paf_container_roundtrip", f"WITH {_LINE}, {_FIRST_LENGTH} SELECT concat_ws(chr(9), query_name, query_len, 0, qe, strand, target_name, first_len, 0, te, least(qe, te), qe, mapq, 'NM:i:' || record_id, 'tp:Z:' || trace) AS value FROM good JOIN lens USING (target_name)")
def paf_container_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Text to a container and back, lines normalised. A name has one length there, that of its first line."""
    path = _converted(spark.sparkContext.applicationId, paf_path(spark, d, True))
    return paf.normalize(convert.container_lines(spark, path)).select("value")


#: Strategies that the containers of the queries are written with.
WRITTEN_WITH = {"standard": ("lz77", "cascaded"), "fastga": ("elias-fano", "huffman"), "single": ("huffman", "raw"), "variable": ("zigzag-delta", "simple8b-full"), "mixed": ("fastpfor", "hybrid-rle")}


def item(x: Column, variant: str) -> Column:
    none, no_op = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    b, op = x["b"], no_op
    if variant == "single":
        b = none
    elif variant == "variable":
        b = F.when(x["a"] % 3 != 0, x["b"])
    elif variant == "mixed":
        own = x["op"].isin("I", "D")
        b, op = F.when(~own, x["b"]), F.when(own, x["op"])
    return F.struct(x["a"].alias("a"), b.alias("b"), op.alias("op"))


def tag(key: str, kind: str, i: Column = None, f: Column = None, s: Column = None) -> Column:
    none = F.lit(None)
    fields = ((none if i is None else i).cast("int").alias("i"), (none if f is None else f).cast("float").alias("f"), (none if s is None else s).cast("string").alias("s"))
    return F.struct(F.lit(key).alias("key"), F.lit(kind).alias("type"), *fields)


@functools.lru_cache
def _container(application: str, d: str, variant: str, whole: bool, purpose: str) -> str:
    spark = SparkSession.getActiveSession()
    zero = F.lit(0).cast("bigint")
    r = orders.named(spark, d).join(orders.records(spark, d), "record_id").withColumn("trace", F.transform("items", lambda x: item(x, variant)))
    a, b = total(F.col("items.a")), total(F.col("items.b"))
    tags = F.array(tag("id", "i", i=F.col("record_id")), tag("fr", "f", f=F.col("record_id") % 8 / 8), tag("nm", "Z", s=F.concat(F.lit("é:"), F.col("record_id"))))
    r = r.select(
        "record_id", "query_name", "query_len", "strand", "target_name", "target_len", "trace", zero.alias("query_start"), a.alias("query_end"), zero.alias("target_start"), b.alias("target_end"),
        F.least(a, b).alias("residue_matches"), a.alias("alignment_block_len"), F.lit(60).cast("smallint").alias("mapping_quality"), tags.alias("tags"),
    )
    first, second = WRITTEN_WITH[variant]
    path = new_path(spark) + ".bin"
    container.write(r, path, container.Header(Strategy(first), Strategy(second, "nocomp" if whole else "zstd", 3), variant, all_records=whole))
    return path


def container_of(spark: SparkSession, d: str, variant: str = "standard", whole: bool = False, purpose: str = "") -> str:
    """A container of the records, written once a session; purpose: of its own."""
    return _container(spark.sparkContext.applicationId, d, variant, whole, purpose)


_B = {"standard": "b", "fastga": "b", "single": "0", "variable": "CASE WHEN a % 3 <> 0 THEN b ELSE 0 END", "mixed": "CASE WHEN op IN ('I', 'D') THEN 0 ELSE b END"}


def container_sql(variant: str) -> str:
    op = "CASE WHEN op IN ('I', 'D') THEN op ELSE '.' END" if variant == "mixed" else "'.'"
    return f"""WITH {_NAMES}, k AS (SELECT record_id, count(*) AS n_items, CAST(sum(a * i) AS BIGINT) AS first, CAST(sum(({_B[variant]}) * i) AS BIGINT) AS second, string_agg({op}, '' ORDER BY i) AS ops FROM items GROUP BY record_id)
SELECT row_number() OVER (ORDER BY record_id) - 1 AS record_id, record_id AS tag_i, CAST(record_id % 8 / 8.0 AS DOUBLE) AS tag_f, 'é:' || record_id AS tag_s, query_name, target_name, n_items, first, second, ops FROM n JOIN k USING (record_id)"""


def columns(df: DataFrame) -> DataFrame:
    t = F.col("tags")
    ops = F.array_join(F.transform("trace", lambda x: F.coalesce(x["op"], F.lit("."))), "")
    return df.select(
        "record_id", t[0]["i"].cast("bigint").alias("tag_i"), t[1]["f"].cast("double").alias("tag_f"), t[2]["s"].alias("tag_s"), "query_name", "target_name",
        F.size("trace").cast("bigint").alias("n_items"), weighted("a").alias("first"), weighted("b").alias("second"), ops.alias("ops"),
    )


for _variant in WRITTEN_WITH:
    for _whole in (False, True):

        @query(f"container_{_variant}{'_one_section' if _whole else ''}", container_sql(_variant))
        def container_variant(spark, d, variant=_variant, whole=_whole):
            return columns(container.read_resolved(spark, container_of(spark, d, variant, whole)))


for _whole in (False, True):

    @query(f"container_in_order{'_one_section' if _whole else ''}", container_sql("mixed"))
    def container_in_order(spark, d, whole=_whole):
        """Read from front to back, without the index."""
        path = container_of(spark, d, "mixed", whole)
        return columns(container.resolve(container.read_in_order(spark, path), container.read_strings(spark, path)))

    @query(f"container_rebuilt_index{'_one_section' if _whole else ''}", container_sql("variable"))
    def container_rebuilt_index(spark, d, whole=_whole):
        """The index is taken away and built anew on opening."""
        path = container_of(spark, d, "variable", whole, "rebuilt")
        store, name = container.at(path)
        if store.get_file_info(name + ".idx").is_file:
            store.delete_file(name + ".idx")
        return columns(container.read_resolved(spark, path))


_HEAD_BYTES = " + ".join([*(vs(c) for c in ("q.id", "qe", "t.id", "te", "least(qe, te)", "qe")), "4"])


@query("container_trace_places", f"WITH {_NAMES}, k AS (SELECT record_id, CAST(sum(a) AS BIGINT) AS qe, CAST(sum(b) AS BIGINT) AS te FROM items GROUP BY record_id) SELECT row_number() OVER (ORDER BY record_id) - 1 AS record_id, CAST({_HEAD_BYTES} AS BIGINT) AS head_bytes FROM n JOIN k USING (record_id) JOIN strings q ON q.name = query_name JOIN strings t ON t.name = target_name")
def container_trace_places(spark: SparkSession, d: str) -> DataFrame:
    """How far after the record its trace begins."""
    rows = container.index_rows(spark, container_of(spark, d))
    return rows.select("record_id", (F.col("trace_position") - F.col("position")).alias("head_bytes"))


@query("container_names", f"WITH {_NAMES}, wanted AS (SELECT c_name AS name FROM customer UNION ALL SELECT 'no such name') SELECT name, coalesce(id, -1) AS id, coalesce(length, -1) AS length FROM wanted LEFT JOIN strings USING (name)")
def container_names(spark: SparkSession, d: str) -> DataFrame:
    """Ids and lengths of names; -1 for those that the container doesn't have."""
    from ..operators.dictionary import ids_of

    wanted = orders.table(spark, d, "customer").select(F.col("c_name").alias("name")).unionByName(spark.createDataFrame([("no such name",)], "name string"))
    return ids_of(wanted, container.read_strings(spark, container_of(spark, d))).select("name", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("length", F.lit(-1)).alias("length"))
