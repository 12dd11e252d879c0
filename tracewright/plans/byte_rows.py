"""The exact bytes of the encoders as hex, and SQL that builds the same bytes from exploded rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs as C
from . import orders
from .registry import DD, ITEMS, SIZE_SQL, D, bits, query, runs, vs, zz


def byte(x: str) -> str:
    return f"printf('%02x', CAST({x} AS BIGINT))"


def varint(x: str) -> str:
    """Seven bits a byte, the lowest first, for numbers below 2^28."""
    low = lambda k: f"({x}) // {1 << 7 * k} % 128"
    cases = [f"WHEN {x} < {1 << 7 * (n + 1)} THEN " + " || ".join([*(byte(f"{low(k)} + 128") for k in range(n)), byte(low(n))]) for n in range(4)]
    return f"(CASE {' '.join(cases)} END)"


def little(x: str, width: str) -> str:
    """The lowest byte first, for widths up to three."""
    parts = [f"CASE WHEN {width} > {k} THEN {byte(f'({x}) // {256**k} % 256')} ELSE '' END" for k in range(3)]
    return f"({' || '.join(parts)})"


def packed(s: str) -> str:
    """A string of 0 and 1 as bytes, the last filled with 0."""
    one = f"list_sum(list_transform(range(0, 8), lambda j: CASE WHEN substr({s}, CAST(k + j + 1 AS BIGINT), 1) = '1' THEN 128 >> j ELSE 0 END))"
    return f"array_to_string(list_transform(range(0, length({s}), 8), lambda k: {byte(one)}), '')"


def listed(ctes: str, value: str, of: str, order: str = "i", head: str = "''") -> str:
    return f"WITH {ctes} SELECT record_id, {head} || string_agg({value}, '' ORDER BY {order}) AS bytes FROM {of} GROUP BY record_id"


_PER = "per AS (SELECT record_id, min(v) AS low, max(v) AS high, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM items GROUP BY record_id)"
_WIDE = f"wide AS (SELECT items.*, low, v - low AS o, {bits('(high - low)')} AS ob, greatest(1, {bits('high')}) AS w FROM items JOIN per USING (record_id))"
_FIRST = "firsts AS (SELECT record_id, v, min(i) AS f FROM items GROUP BY record_id, v), codes AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY f) - 1 AS code FROM firsts)"
_RICE_K = f"c AS (SELECT record_id, k, sum(({zz('d')} >> k) + 1 + k) AS cost FROM d, range(0, 17) t(k) GROUP BY record_id, k), best AS (SELECT record_id, CAST(arg_min(k, cost * 100 + k) AS INTEGER) AS k FROM c GROUP BY record_id)"
_SIZED = f"sized AS (SELECT *, CAST(greatest(1, ceil({bits('v')} / 8.0)) AS INTEGER) AS s FROM items)"
_EF = f"""l AS (SELECT record_id, greatest(0, {bits('((s + 1) // n)')} - 1) AS l FROM per),
t AS (SELECT record_id, i, l, CAST(sum(v) OVER (PARTITION BY record_id ORDER BY i) AS BIGINT) AS t FROM items JOIN l USING (record_id)),
h AS (SELECT *, (t >> l) - lag(t >> l, 1, 0) OVER (PARTITION BY record_id ORDER BY i) AS up, t % (1 << l) AS rest FROM t),
s AS (SELECT record_id, any_value(l) AS l, string_agg(CASE WHEN l > 0 THEN lpad(bin(rest), CAST(l AS INTEGER), '0') ELSE '' END, '' ORDER BY i) || string_agg(repeat('1', up) || '0', '' ORDER BY i) AS s FROM h GROUP BY record_id)"""
BYTES_SQL = {
    "raw": listed(ITEMS, varint("v"), "items"),
    "zigzag-delta": listed(f"{ITEMS}, {D}", varint(zz("d")), "d"),
    "delta-of-delta": listed(f"{ITEMS}, {D}, {DD}", varint(zz("e")), "e"),
    "xor-delta": listed(f"{ITEMS}, {D}", varint("x"), "d"),
    "rle": listed(f"{ITEMS}, {runs('v')}", f"{varint('value')} || {varint('n')}", "g", "g"),
    "selective-rle": listed(f"{ITEMS}, {runs('v')}", f"CASE WHEN n >= 8 THEN '00' || {varint('value')} || {varint('n')} ELSE repeat('01' || {varint('value')}, n) END", "g", "g"),
    "dictionary": f"""WITH {ITEMS}, {_FIRST}, head AS (SELECT record_id, '01' || {byte('count(*) % 256')} || string_agg({varint('v')}, '' ORDER BY f) AS h FROM codes GROUP BY record_id),
        rest AS (SELECT record_id, string_agg({byte('code')}, '' ORDER BY i) AS r FROM items JOIN codes USING (record_id, v) GROUP BY record_id) SELECT record_id, h || r AS bytes FROM head JOIN rest USING (record_id)""",
    "frame-of-reference": listed(f"{ITEMS}, {_PER}, {_WIDE}", little("o", "(CASE WHEN ob <= 8 THEN 1 ELSE 2 END)"), "wide", head=f"any_value({varint('low')}) || any_value({byte('ob')})"),
    "stream-vbyte": f"""WITH {ITEMS}, {_SIZED}, control AS (SELECT record_id, (i - 1) // 4 AS g, sum((s - 1) << CAST(2 * ((i - 1) % 4) AS INTEGER)) AS c FROM sized GROUP BY ALL),
        head AS (SELECT record_id, {varint('count(*)')} || string_agg({byte('c')}, '' ORDER BY g) AS h FROM control GROUP BY record_id),
        rest AS (SELECT record_id, string_agg({little('v', 's')}, '' ORDER BY i) AS r FROM sized GROUP BY record_id) SELECT record_id, h || r AS bytes FROM head JOIN rest USING (record_id)""",
    "bit-packed": f"""WITH {ITEMS}, {_PER}, {_WIDE}, s AS (SELECT record_id, any_value(w) AS w, string_agg(lpad(bin(v), CAST(w AS INTEGER), '0'), '' ORDER BY i) AS s FROM wide GROUP BY record_id)
        SELECT record_id, {byte('w')} || {packed('s')} AS bytes FROM s""",
    "rice": f"""WITH {ITEMS}, {D}, {_RICE_K}, z AS (SELECT record_id, i, k, {zz('d')} AS z FROM d JOIN best USING (record_id)),
        s AS (SELECT record_id, any_value(k) AS k, string_agg(repeat('1', z >> k) || '0' || CASE WHEN k > 0 THEN lpad(bin(z % (1 << k)), k, '0') ELSE '' END, '' ORDER BY i) AS s FROM z GROUP BY record_id)
        SELECT record_id, {byte('k')} || {packed('s')} AS bytes FROM s""",
    "elias-fano": f"WITH {ITEMS}, {_PER}, {_EF} SELECT record_id, {byte('l')} || {packed('s')} AS bytes FROM s",
}

for _name, _sql in BYTES_SQL.items():

    @query(f"codec_{_name.replace('-', '_')}_bytes", _sql)
    def codec_bytes(spark, d, name=_name):
        return orders.streams(spark, d).select("record_id", F.lower(F.hex(C.encoded(F.col("v"), name))).alias("bytes"))


@query("codec_2d_delta_bytes", listed(ITEMS, varint(zz("(b - a)")), "items"))
def pair_bytes(spark, d):
    return orders.streams(spark, d).select("record_id", F.lower(F.hex(C.encoded_second(F.col("a"), F.col("b"), "2d-delta"))).alias("bytes"))


_CASCADE = f"""WITH {ITEMS}, {D}, z AS (SELECT record_id, count(DISTINCT v) AS kinds, count(*) AS n, CAST(sum({vs('v')}) FILTER (i = 1) AS BIGINT) AS first, CAST(coalesce(sum({vs(zz('d'))}) FILTER (i > 1), 0) AS BIGINT) AS rest FROM d GROUP BY record_id)
SELECT record_id, 1 + first + rest AS size FROM z WHERE kinds >= 0.01 * n"""


@query("codec_cascaded_size", _CASCADE)
def cascaded_size(spark, d):
    """No record has few distinct values for its length here, so all are differences."""
    return orders.streams(spark, d).select("record_id", F.octet_length(C.encoded(F.col("v"), "cascaded")).cast("bigint").alias("size"))


_PFOR = f"""WITH {ITEMS}, {_PER}, o AS (SELECT record_id, v - low AS o, low, n, row_number() OVER (PARTITION BY record_id ORDER BY v) - 1 AS r FROM items JOIN per USING (record_id)),
w AS (SELECT record_id, greatest(1, {bits('max(o)')}) AS b FROM o WHERE r <= floor(n * 0.95) GROUP BY record_id),
x AS (SELECT o.*, b, (1 << CAST(b AS INTEGER)) - 1 AS top FROM o JOIN w USING (record_id))
SELECT record_id, CAST({vs('any_value(n)')} + {vs('any_value(low)')} + 1 + {vs('count(*) FILTER (o > top)')} + sum(CASE WHEN b <= 8 THEN 1 ELSE 2 END) + coalesce(sum(2 + {vs('(o - top - 1)')}) FILTER (o > top), 0) AS BIGINT) AS size FROM x GROUP BY record_id"""


@query("codec_fastpfor_size", _PFOR)
def fastpfor_size(spark, d):
    return orders.streams(spark, d).select("record_id", F.octet_length(C.encoded(F.col("v"), "fastpfor")).cast("bigint").alias("size"))


assert set(BYTES_SQL) <= set(SIZE_SQL)
