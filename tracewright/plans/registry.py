"""Queries over the alignment records, and the SQL they are held against: arrays here, exploded rows there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import codecs as C
from ..functions import streams as S
from ..functions import traces as T
from ..operators import contigs, dictionary, reports, selection
from ..sources import container, paf, text
from . import orders

ITEMS = """items AS (SELECT l_orderkey AS record_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS i,
  CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) + l_linenumber % 3 - 1 AS b, l_partkey AS v,
  CASE WHEN l_returnflag = 'N' THEN '=' WHEN l_returnflag = 'R' THEN 'X' WHEN l_linestatus = 'F' THEN 'I' ELSE 'D' END AS op FROM lineitem)"""


def vs(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


def zz(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN 2 * ({x}) ELSE -2 * ({x}) - 1 END)"


def bits(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE length(bin({x})) END)"


def lagged(x: str, of: str = "v") -> str:
    return f"lag({of}, 1, 0) OVER (PARTITION BY record_id ORDER BY i)" if x == "lag" else x


D = f"d AS (SELECT *, v - {lagged('lag')} AS d, xor(v, {lagged('lag')}) AS x FROM items)"
DD = f"e AS (SELECT *, d - {lagged('lag', 'd')} AS e FROM d)"


def runs(c: str) -> str:
    return f"""m AS (SELECT *, CASE WHEN i > 1 AND {c} = lag({c}) OVER (PARTITION BY record_id ORDER BY i) THEN 0 ELSE 1 END AS s FROM items),
r AS (SELECT *, sum(s) OVER (PARTITION BY record_id ORDER BY i) AS g FROM m),
g AS (SELECT record_id, g, any_value({c}) AS value, count(*) AS n FROM r GROUP BY record_id, g)"""


def per_record(ctes: str, value: str, of: str, name: str = "size") -> str:
    return f"WITH {ctes} SELECT record_id, CAST({value} AS BIGINT) AS {name} FROM {of} GROUP BY record_id"


_COST = f"c AS (SELECT record_id, k, sum(({zz('d')} >> k) + 1 + k) AS cost FROM d, range(0, 17) t(k) GROUP BY record_id, k)"
_DICT = f"CASE WHEN count(DISTINCT v) <= 256 THEN 2 + (SELECT sum({vs('y')}) FROM unnest(list_distinct(list(v))) u(y)) + count(*) ELSE 1 + sum({vs('v')}) END"
SIZE_SQL = {
    "raw": per_record(ITEMS, f"sum({vs('v')})", "items"),
    "zigzag-delta": per_record(f"{ITEMS}, {D}", f"sum({vs(zz('d'))})", "d"),
    "delta-of-delta": per_record(f"{ITEMS}, {D}, {DD}", f"sum({vs(zz('e'))})", "e"),
    "xor-delta": per_record(f"{ITEMS}, {D}", f"sum({vs('x')})", "d"),
    "rle": per_record(f"{ITEMS}, {runs('v')}", f"sum({vs('value')} + {vs('n')})", "g"),
    "selective-rle": per_record(f"{ITEMS}, {runs('v')}", f"sum(CASE WHEN n >= 8 THEN 1 + {vs('value')} + {vs('n')} ELSE n * (1 + {vs('value')}) END)", "g"),
    "bit-packed": per_record(ITEMS, f"1 + ceil(count(*) * greatest(1, {bits('max(v)')}) / 8.0)", "items"),
    "frame-of-reference": per_record(ITEMS, f"{vs('min(v)')} + 1 + count(*) * CASE WHEN max(v) - min(v) < 256 THEN 1 WHEN max(v) - min(v) < 65536 THEN 2 WHEN max(v) - min(v) < 4294967296 THEN 4 ELSE 8 END", "items"),
    "stream-vbyte": per_record(ITEMS, f"{vs('ceil(count(*) / 4.0)')} + ceil(count(*) / 4.0) + sum(greatest(1, ceil({bits('v')} / 8.0)))", "items"),
    "dictionary": f"WITH {ITEMS}, u AS (SELECT record_id, sum({vs('v')}) AS s, count(*) AS n FROM (SELECT DISTINCT record_id, v FROM items) GROUP BY record_id), w AS (SELECT record_id, count(*) AS c, sum({vs('v')}) AS raw FROM items GROUP BY record_id) SELECT record_id, CAST(CASE WHEN n <= 256 THEN 2 + s + c ELSE 1 + raw END AS BIGINT) AS size FROM u JOIN w USING (record_id)",
    "rice": f"WITH {ITEMS}, {D}, {_COST} SELECT record_id, CAST(1 + ceil(min(cost) / 8.0) AS BIGINT) AS size FROM c GROUP BY record_id",
    "elias-fano": f"WITH {ITEMS}, s AS (SELECT record_id, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM items GROUP BY record_id), l AS (SELECT *, greatest(0, {bits('((s + 1) // n)')} - 1) AS l FROM s) SELECT record_id, CAST(1 + ceil((n * l + (s >> l) + n) / 8.0) AS BIGINT) AS size FROM l",
}
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


for _name, _size in S.SIZES.items():
    query(f"codec_{_name.replace('-', '_')}_size", SIZE_SQL[_name])(lambda spark, d, f=_size: orders.streams(spark, d).select("record_id", f(F.col("v")).alias("size")))


@query("codec_2d_delta_size", per_record(ITEMS, f"sum({vs(zz('(b - a)'))})", "items"))
def pair_delta(spark, d):
    return orders.streams(spark, d).select("record_id", S.pair_delta_size(F.col("a"), F.col("b")).alias("size"))


@query("codec_hybrid_rle_size", f"WITH {ITEMS}, {runs('b')}, f AS (SELECT record_id, sum({vs('a')}) AS f FROM items GROUP BY record_id), h AS (SELECT record_id, sum({vs('value')} + {vs('n')}) AS s FROM g GROUP BY record_id) SELECT record_id, CAST(f + s AS BIGINT) AS size FROM f JOIN h USING (record_id)")
def hybrid(spark, d):
    return orders.streams(spark, d).select("record_id", S.hybrid_rle_size(F.col("a"), F.col("b")).alias("size"))


@query("codec_cascaded_mode", f"WITH {ITEMS} SELECT record_id, CASE WHEN count(DISTINCT v) / count(*) < 0.01 THEN 1 ELSE 2 END AS mode FROM items GROUP BY record_id")
def cascaded(spark, d):
    return orders.streams(spark, d).select("record_id", S.cascaded_mode(F.col("v")).alias("mode"))


@query("codec_rice_k", f"WITH {ITEMS}, {D}, {_COST} SELECT record_id, CAST(arg_min(k, cost * 100 + k) AS INTEGER) AS k, CAST(min(cost) AS BIGINT) AS cost FROM c GROUP BY record_id")
def rice_k(spark, d):
    return orders.streams(spark, d).select("record_id", S.rice_parameter(F.col("v")).alias("r")).select("record_id", "r.k", "r.cost")


@query("codec_huffman_symbols", f"WITH {ITEMS}, {D}, h AS (SELECT record_id, {zz('d')} AS symbol, count(*) AS n FROM d GROUP BY ALL) SELECT record_id, symbol, n FROM h")
def huffman_symbols(spark, d):
    z = orders.streams(spark, d).select("record_id", F.explode(F.transform(S.deltas(F.col("v")), S.zigzag)).alias("symbol"))
    return z.groupBy("record_id", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("trace_format", f"WITH {ITEMS} SELECT record_id, string_agg(a || ',' || b, ';' ORDER BY i) AS trace FROM items GROUP BY record_id")
def trace_format(spark, d):
    t = F.transform("items", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.lit(None).cast("string").alias("op")))
    return orders.records(spark, d).select("record_id", T.format_trace(t).alias("trace"))


@query("trace_roundtrip", f"WITH {ITEMS} SELECT record_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(a) AS BIGINT) AS sum_a, CAST(sum(b) AS BIGINT) AS sum_b FROM items GROUP BY record_id")
def trace_roundtrip(spark, d):
    t = trace_format(spark, d).select("record_id", T.parse_trace(F.col("trace"), "standard").alias("t"))
    return t.select("record_id", F.size("t").cast("bigint").alias("n"), S.total(F.col("t.a")).alias("sum_a"), S.total(F.col("t.b")).alias("sum_b"))


def stats(spark, d):
    cigar = F.array_join(F.transform("items", lambda x: F.concat(x["a"].cast("string"), x["op"])), "")
    return orders.records(spark, d).select("record_id", S.let(T.parse_cigar(cigar), T.cigar_stats).alias("s"))


_C = f"""{ITEMS}, c AS (SELECT record_id, CAST(coalesce(sum(a) FILTER (op = '='), 0) AS BIGINT) AS m, CAST(coalesce(sum(a) FILTER (op = 'X'), 0) AS BIGINT) AS x, count(*) FILTER (op = 'I') AS ni, count(*) FILTER (op = 'D') AS nd,
  CAST(coalesce(sum(a) FILTER (op = 'I'), 0) AS BIGINT) AS bi, CAST(coalesce(sum(a) FILTER (op = 'D'), 0) AS BIGINT) AS bd, CAST(coalesce(sum(6 + 2 * a) FILTER (op IN ('I', 'D')), 0) AS BIGINT) AS g1, CAST(coalesce(sum(least(6 + 2 * a, 24 + a)) FILTER (op IN ('I', 'D')), 0) AS BIGINT) AS g2 FROM items GROUP BY record_id)"""


@query("cigar_stats", f"WITH {_C} SELECT record_id, m AS matches, x AS mismatches, ni AS insertions, bi AS inserted_bp, nd AS deletions, bd AS deleted_bp FROM c")
def cigar_stats(spark, d):
    n = lambda c: F.size(f"s.{c}").cast("bigint").alias(c)
    return stats(spark, d).select("record_id", "s.matches", "s.mismatches", n("insertions"), S.total(F.col("s.insertions")).alias("inserted_bp"), n("deletions"), S.total(F.col("s.deletions")).alias("deleted_bp"))


@query("cigar_identities", f"WITH {_C} SELECT record_id, round(CAST(CAST(m / (m + x + ni + nd) AS FLOAT) AS DOUBLE), 6) AS gap_compressed, round(CAST(CAST(m / (m + x + bi + bd) AS FLOAT) AS DOUBLE), 6) AS block FROM c")
def cigar_identities(spark, d):
    r = lambda c: F.round(c.cast("double"), 6)
    return stats(spark, d).select("record_id", r(T.gap_compressed_identity(F.col("s"))).alias("gap_compressed"), r(T.block_identity(F.col("s"))).alias("block"))


@query("cigar_scores", f"WITH {_C} SELECT record_id, -(x + bi + bd) AS edit, -(4 * x + g1) AS affine, -(4 * x + g2) AS two_piece FROM c")
def cigar_scores(spark, d):
    s = F.col("s")
    return stats(spark, d).select("record_id", T.edit_score(s).alias("edit"), T.affine_score(s, 4, (6, 2)).alias("affine"), T.affine_score(s, 4, (6, 2), (24, 1)).alias("two_piece"))


_NAMES = f"""{ITEMS}, n AS (SELECT record_id, c_name AS query_name, 100000 + o_custkey AS query_len, p_name AS target_name, 1000 + p_partkey AS target_len
  FROM items JOIN orders ON o_orderkey = record_id JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = v WHERE i = 1),
p AS (SELECT 2 * record_id AS pos, query_name AS name, query_len AS length FROM n UNION ALL SELECT 2 * record_id + 1, target_name, target_len FROM n),
f AS (SELECT name, min(pos) AS pos, arg_min(length, pos) AS length FROM p GROUP BY name),
strings AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS id, name, CAST(length AS BIGINT) AS length FROM f)"""


@query("string_table", f"WITH {_NAMES} SELECT id, name, length FROM strings")
def string_table(spark, d):
    return dictionary.string_table(orders.seen(spark, d))


@query("resolve_names", f"WITH {_NAMES} SELECT record_id, q.id AS query_name_id, query_name, q.length AS query_len, t.id AS target_name_id, target_name, t.length AS target_len FROM n JOIN strings q ON q.name = query_name JOIN strings t ON t.name = target_name")
def resolve_names(spark, d):
    r = orders.named(spark, d).select("record_id", "query_name", "target_name")
    strings = dictionary.string_table(dictionary.names(orders.named(spark, d)))
    for role in ("query", "target"):
        r = r.join(strings.select(F.col("name").alias(f"{role}_name"), F.col("id").alias(f"{role}_name_id")), f"{role}_name")
    return dictionary.resolve(r.select("record_id", "query_name_id", "target_name_id"), strings)


@query("string_table_bytes", f"WITH {_NAMES} SELECT CAST(sum({vs('strlen(name)')}) AS BIGINT) AS length_bytes, CAST(sum(strlen(name)) AS BIGINT) AS name_bytes, CAST(sum({vs('length')}) AS BIGINT) AS seq_length_bytes, count(*) AS n FROM strings")
def string_table_bytes(spark, d):
    n = F.octet_length("name").cast("bigint")
    return string_table(spark, d).agg(F.sum(S.varint_size(n)).alias("length_bytes"), F.sum(n).alias("name_bytes"), F.sum(S.varint_size(F.col("length"))).alias("seq_length_bytes"), F.count(F.lit(1)).alias("n"))


@query("record_offsets", f"WITH {ITEMS}, z AS (SELECT record_id, sum({vs('a')} + {vs('b')}) AS n FROM items GROUP BY record_id) SELECT record_id, CAST(n AS BIGINT) AS length, CAST(coalesce(sum(n) OVER (ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM z")
def record_offsets(spark, d):
    a = F.col("l_quantity").cast("bigint")
    sizes = S.varint_size(a) + S.varint_size(a + F.col("l_linenumber") % 3 - 1)
    sized = orders.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.sum(sizes).alias("length"))
    return dictionary.exclusive_prefix(sized, "record_id", F.col("length"), "offset", 1 << 14).select("record_id", "length", "offset")


_TOTALS = " UNION ALL ".join(f"SELECT '{k}' AS strategy, CAST(sum(size + {vs('size')}) AS BIGINT) AS total FROM ({v})" for k, v in SIZE_SQL.items())


@query("benchmark_totals", _TOTALS)
def benchmark_totals(spark, d):
    return selection.totals(orders.streams(spark, d), "v")


_BEST_ORDER = "['raw', 'zigzag-delta', 'rle', 'bit-packed', 'frame-of-reference', 'xor-delta', 'delta-of-delta', 'stream-vbyte', 'dictionary', 'rice', 'selective-rle', 'elias-fano']"


@query("benchmark_best", f"SELECT strategy, total FROM ({_TOTALS}) ORDER BY total, list_position({_BEST_ORDER}, strategy) LIMIT 1")
def benchmark_best(spark, d):
    return selection.best(benchmark_totals(spark, d))


@query("sample_first_n", f"WITH {_NAMES} SELECT record_id, query_name, target_name FROM n WHERE record_id < 1000")
def sample_first_n(spark, d):
    return orders.named(spark, d).where("record_id < 1000").select("record_id", "query_name", "target_name")


@query("point_lookup", f"WITH {ITEMS} SELECT record_id, string_agg(a || ',' || b, ';' ORDER BY i) AS trace FROM items WHERE record_id % 997 = 13 GROUP BY record_id")
def point_lookup(spark, d):
    return trace_format(spark, d).where("record_id % 997 = 13")


@query("metadata_only", f"WITH {_NAMES} SELECT record_id, query_name, CAST(query_len AS BIGINT) AS query_len, target_name, CAST(target_len AS BIGINT) AS target_len, CASE WHEN record_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM n")
def metadata_only(spark, d):
    return orders.named(spark, d)


def _checked(df, stream: str):
    """Number of values and their sum weighted by place, which decoding must give back."""
    weighted = F.aggregate(F.transform(stream, lambda x, k: x * (k + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return df.select("record_id", F.size(stream).cast("bigint").alias("n"), weighted.alias("weighted"))


def _checked_sql(c: str) -> str:
    return f"WITH {ITEMS} SELECT record_id, count(*) AS n, CAST(sum({c} * i) AS BIGINT) AS weighted FROM items GROUP BY record_id"


def _roundtrip(spark, d, name, layer="nocomp"):
    df = orders.streams(spark, d).select("record_id", F.size("v").alias("n"), C.encoded(F.col("v"), name, layer).alias("data"))
    return _checked(df.withColumn("x", C.decoded(F.col("data"), F.col("n"), name, layer)), "x")


def _second_roundtrip(spark, d, name):
    df = orders.streams(spark, d).select("record_id", "a", C.encoded_second(F.col("a"), F.col("b"), name).alias("data"))
    return _checked(df.withColumn("x", C.decoded_second(F.col("a"), F.col("data"), name)), "x")


for _name in selection.STRATEGIES:
    if _name in ("2d-delta", "hybrid-rle"):
        query(f"codec_{_name.replace('-', '_')}_roundtrip", _checked_sql("b"))(lambda spark, d, n=_name: _second_roundtrip(spark, d, n))
    else:
        query(f"codec_{_name.replace('-', '_')}_roundtrip", _checked_sql("v"))(lambda spark, d, n=_name: _roundtrip(spark, d, n))
for _name in ("zstd", "bgzip"):
    query(f"layer_{_name}_roundtrip", _checked_sql("v"))(lambda spark, d, n=_name: _roundtrip(spark, d, "zigzag-delta", n))


@query("benchmark_measured")
def benchmark_measured(spark, d):
    return selection.measured(orders.streams(spark, d), "v")


@query("cigar_trace_spans", f"WITH {ITEMS} SELECT record_id, CAST(coalesce(sum(a) FILTER (op <> 'D'), 0) AS BIGINT) AS query_span, CAST(coalesce(sum(a) FILTER (op <> 'I'), 0) AS BIGINT) AS target_span FROM items GROUP BY record_id")
def cigar_trace_spans(spark, d):
    cigar = F.array_join(F.transform("items", lambda x: F.concat(x["a"].cast("string"), x["op"])), "")
    t = orders.records(spark, d).select("record_id", A.cigar_to_trace(cigar, F.lit(0).cast("bigint"), "standard", 32).alias("t"))
    return t.select("record_id", S.total(F.col("t.a")).alias("query_span"), S.total(F.col("t.b")).alias("target_span"))


def _container(spark, d) -> str:
    """The records of the driver's tables as a container in the folder that driver and executors share."""
    zero = F.lit(0).cast("bigint")
    item = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.lit(None).cast("string").alias("op"))
    r = orders.named(spark, d).join(orders.records(spark, d).select("record_id", F.transform("items", item).alias("trace")), "record_id")
    a, b = S.total(F.col("trace.a")), S.total(F.col("trace.b"))
    tags = F.array(F.struct(F.lit("id").alias("key"), F.lit("i").alias("type"), F.col("record_id").cast("int").alias("i"), F.lit(None).cast("float").alias("f"), F.lit(None).cast("string").alias("s")))
    r = r.select("*", zero.alias("query_start"), a.alias("query_end"), zero.alias("target_start"), b.alias("target_end"), F.least(a, b).alias("residue_matches"), a.alias("alignment_block_len"), F.lit(60).cast("smallint").alias("mapping_quality"), tags.alias("tags"))
    base = text.shared_folder(spark)
    path = f"{base}/{uuid.uuid4().hex}.bin"
    container.at(base)[0].create_dir(container.at(base)[1])
    container.write(r, path)
    return path


_ROUND = f"WITH {_NAMES}, k AS (SELECT record_id, CAST(sum(a * i) AS BIGINT) AS first, CAST(sum(b * i) AS BIGINT) AS second FROM items GROUP BY record_id), c AS (SELECT row_number() OVER (ORDER BY record_id) - 1 AS record_id, record_id AS tag, query_name, target_name, first, second FROM n JOIN k USING (record_id))"


def _resolved(df):
    at = lambda c: F.aggregate(F.transform(f"trace.{c}", lambda x, k: x * (k + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return df.select("record_id", F.col("tags")[0]["i"].cast("bigint").alias("tag"), "query_name", "target_name", at("a").alias("first"), at("b").alias("second"))


@query("container_roundtrip", f"{_ROUND} SELECT * FROM c")
def container_roundtrip(spark, d):
    return _resolved(container.read_resolved(spark, _container(spark, d)))


@query("container_lookup", f"{_ROUND} SELECT * FROM c WHERE record_id IN (0, 7, 500, 1000)")
def container_lookup(spark, d):
    return _resolved(container.read_resolved(spark, _container(spark, d), [0, 7, 500, 1000]))


@query("container_metadata", f"{_ROUND} SELECT record_id, tag, query_name, target_name FROM c")
def container_metadata(spark, d):
    r = container.read_resolved(spark, _container(spark, d), metadata_only=True)
    return r.select("record_id", F.col("tags")[0]["i"].cast("bigint").alias("tag"), "query_name", "target_name")


# Contigs of 50 bases with gaps of 14 on the query; a record's CIGAR begins at 0 on both sides.
_BASES = """items2 AS (SELECT *, coalesce(sum(a) OVER w, 0) AS c0, coalesce(sum(CASE WHEN op <> 'D' THEN a ELSE 0 END) OVER w, 0) AS q0, coalesce(sum(CASE WHEN op <> 'I' THEN a ELSE 0 END) OVER w, 0) AS t0 FROM items WINDOW w AS (PARTITION BY record_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bases AS (SELECT record_id, op, c0 + k AS c, q0 + CASE WHEN op = 'D' THEN 0 ELSE k END AS q, t0 + CASE WHEN op = 'I' THEN 0 ELSE k END AS t FROM (SELECT *, unnest(range(a)) AS k FROM items2)),
pieces AS (SELECT record_id, q // 64 AS g, min(c) AS lo, max(c) AS hi, min(q) AS q1, max(q) + 1 AS q2, min(t) AS t1, max(t) + 1 AS t2 FROM bases WHERE op IN ('=', 'X') AND q % 64 < 50 GROUP BY ALL)"""


@query("contig_segments", f"WITH {ITEMS}, {_BASES} SELECT p.record_id, CAST(row_number() OVER (PARTITION BY p.record_id ORDER BY g) - 1 AS INTEGER) AS segment, CAST(q1 AS BIGINT) AS query_start, CAST(q2 AS BIGINT) AS query_end, CAST(t1 AS BIGINT) AS target_start, CAST(t2 AS BIGINT) AS target_end, CAST(greatest(0, q2 - q1 - count(*) FILTER (op <> '=')) AS BIGINT) AS residue_matches FROM pieces p JOIN bases b ON b.record_id = p.record_id AND b.c BETWEEN lo AND hi GROUP BY p.record_id, g, q1, q2, t1, t2")
def contig_segments(spark, d):
    zero = F.lit(0).cast("bigint")
    span = lambda skip: S.total(F.transform("items", lambda x: F.when(x["op"] != skip, x["a"]).otherwise(0)))
    cigar = F.array_join(F.transform("items", lambda x: F.concat(x["a"].cast("string"), x["op"])), "")
    r = orders.records(spark, d).select("record_id", F.lit("scaffold").alias("query_name"), zero.alias("query_start"), span("D").alias("query_end"), F.lit("+").alias("strand"), F.lit("target").alias("target_name"), span("I").alias("target_len"), zero.alias("target_start"), span("I").alias("target_end"), cigar.alias("cigar"), F.array().cast("array<string>").alias("tags"))
    runs = spark.range(64).select(F.lit("scaffold").alias("name"), (F.col("id") * 64).alias("start"), (F.col("id") * 64 + 50).alias("end"))
    return contigs.split_by_contigs(r, runs, 32).select("record_id", "segment", "query_start", "query_end", "target_start", "target_end", "residue_matches")


def _results(spark, d):
    """A row per order priority and encoding of the wide stream, and one of the automatic choice; times stand for nothing but their order."""
    o = orders.table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("dataset_name"))
    sizes = F.array(*[F.struct(F.lit(k).alias("strategy_first"), f(F.col("v")).alias("size")) for k, f in S.SIZES.items()])
    flat = orders.streams(spark, d).join(o, "record_id").select("dataset_name", F.size("v").alias("n"), F.inline(sizes))
    total = flat.groupBy("dataset_name", "strategy_first").agg(F.sum("size").cast("bigint").alias("size"), F.sum("n").alias("n"))
    ratio = (8 * F.col("n") / F.col("size")).alias("ratio_orig_to_tpa")
    chosen = F.when(F.col("strategy_first") == "rice", F.array(F.lit("manual"), F.lit("automatic"))).otherwise(F.array(F.lit("manual")))
    nocomp = [F.lit("nocomp").alias(f"compression_layer_{k}") for k in ("first", "second")]
    return total.select("dataset_name", F.explode(chosen).alias("compression_strategy"), "strategy_first", F.lit("2d-delta").alias("strategy_second"), *nocomp, ratio, ratio.alias("ratio_tp_to_tpa"), F.length("strategy_first").cast("double").alias("direct_seek_avg_us"), F.col("size").cast("double").alias("compression_runtime_sec"), F.lit("yes").alias("verification_passed"))


_SIZED = " UNION ALL ".join(f"SELECT '{k}' AS strategy, record_id, size FROM ({v})" for k, v in SIZE_SQL.items())
_RESULTS = f"""{ITEMS}, counts AS (SELECT record_id, count(*) AS n FROM items GROUP BY record_id), sized AS ({_SIZED}),
m AS (SELECT o_orderpriority AS dataset_name, strategy, 8 * sum(n) / sum(size) AS ratio, CAST(sum(size) AS DOUBLE) AS took, CAST(length(strategy) AS DOUBLE) AS seek FROM sized JOIN counts USING (record_id) JOIN orders ON o_orderkey = record_id GROUP BY ALL)"""


@query("report_automatic", f"WITH {_RESULTS}, b AS (SELECT dataset_name, strategy AS best_strategy, ratio AS best_ratio FROM m QUALIFY row_number() OVER (PARTITION BY dataset_name ORDER BY ratio DESC, strategy) = 1) SELECT dataset_name, strategy, round(ratio, 6) AS ratio, best_strategy, round(best_ratio, 6) AS best_ratio, strategy = best_strategy AS same FROM m JOIN b USING (dataset_name) WHERE strategy = 'rice'")
def report_automatic(spark, d):
    r = reports.best_and_automatic(_results(spark, d))
    return r.select("dataset_name", F.col("strategy_first").alias("strategy"), F.round("ratio_tp_to_tpa", 6).alias("ratio"), F.col("best_strategy_first").alias("best_strategy"), F.round("best_ratio_tp_to_tpa", 6).alias("best_ratio"), "same")


_PICK = " UNION ALL ".join(f"SELECT * FROM (SELECT dataset_name, '{k}' AS metric, strategy AS strategy_first, '2d-delta' AS strategy_second, round({x}, 6) AS value FROM m QUALIFY row_number() OVER (PARTITION BY dataset_name ORDER BY {x} {way}, strategy) = 1)" for k, x, way in (("ratio", "ratio", "DESC"), ("seek", "seek", ""), ("compression_time", "took", ""), ("balance", "ratio / (seek / 10)", "DESC")))


@query("report_best_per_metric", f"WITH {_RESULTS} {_PICK}")
def report_best_per_metric(spark, d):
    return reports.best_per_metric(_results(spark, d)).withColumn("value", F.round("value", 6))


@query("report_summary", f"WITH {_RESULTS} SELECT dataset_name, count(*) + 1 AS n, count(DISTINCT strategy) AS pairs, round((sum(ratio) + sum(ratio) FILTER (strategy = 'rice')) / (count(*) + 1), 6) AS mean_ratio, 1.0::DOUBLE AS pass_rate FROM m GROUP BY dataset_name")
def report_summary(spark, d):
    return reports.summary(_results(spark, d)).withColumn("mean_ratio", F.round("mean_ratio", 6))


@query("paf_normalized", f"WITH {ITEMS} SELECT record_id, 'q' || repeat(chr(9) || '1', 11) || chr(9) || 'ab:i:' || record_id || chr(9) || 'gi:f:' || (record_id % 8) || '.500' || chr(9) || 'tp:Z:' || string_agg(a || ',' || b, ';' ORDER BY i) AS value FROM items GROUP BY record_id")
def paf_normalized(spark, d):
    gi = F.concat(F.lit("gi:f:"), (F.col("record_id") % 8).cast("string"), F.lit(".5"))
    fields = [F.lit("q" + "\t1" * 11), F.concat(F.lit("tp:Z:"), F.col("trace")), gi, F.concat(F.lit("ab:i:"), F.col("record_id").cast("string"))]
    return paf.normalize(trace_format(spark, d).select("record_id", F.concat_ws("\t", *fields).alias("value")))


@query("container_sizes", f"WITH {_NAMES}, s AS (SELECT CAST(sum({vs('strlen(name)')}) AS BIGINT) AS a, CAST(sum(strlen(name)) AS BIGINT) AS b, CAST(sum({vs('length')}) AS BIGINT) AS c FROM strings) SELECT 'name lengths' AS part, a AS bytes FROM s UNION ALL SELECT 'names', b FROM s UNION ALL SELECT 'sequence lengths', c FROM s")
def container_sizes(spark, d):
    return container.size_report(spark, _container(spark, d)).where("section = 'names'").select("part", "bytes")
