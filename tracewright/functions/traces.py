"""Trace strings, CIGAR statistics and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .streams import let, total

NUMBER = r"^\+?[0-9]+$"


def number(text: Column, kind: str = "bigint") -> Column:
    """Digits with an optional plus; anything else, or a value out of range, is null."""
    return F.when(text.rlike(NUMBER), text.try_cast(kind))


def parse_trace(text: Column, variant: str, lax: bool = False) -> Column:
    """ARRAY<STRUCT<a, b, op>> of `a,b;a,b` (standard, fastga), `v;v` (single), either (variable), or with items like `10I` (mixed); null if any item is malformed.
    lax: empty items are dropped."""
    # signs, spaces and the like are looked for once in the whole text; then a cast takes digits with an optional plus
    plain = variant != "mixed"
    digits = (lambda x: x.try_cast("bigint")) if plain else number

    def item(x: Column) -> Column:
        part = F.split(x, ",", -1)
        one, pair = F.size(part) == 1, F.size(part) == 2
        none = F.lit(None).cast("bigint")
        op = F.lit(None).cast("string")
        a, b = digits(part[0]), F.when(pair, digits(F.get(part, F.lit(1))))
        if variant in ("standard", "fastga"):
            ok = pair & a.isNotNull() & b.isNotNull()
        elif variant == "single":
            ok, b = one & a.isNotNull(), none
        elif variant == "variable":
            ok = (one & a.isNotNull()) | (pair & a.isNotNull() & b.isNotNull())
        elif variant == "mixed":
            cut = F.length(x) - 1
            n = number(F.substr(x, F.lit(1), cut))
            a = F.when(one, n).otherwise(a)
            op = F.when(one, F.substr(x, F.length(x), F.lit(1)))
            ok = a.isNotNull() & (pair & b.isNotNull() | one & ~op.rlike("[0-9]"))
        else:
            raise ValueError(f"unknown trace variant: {variant}")
        return F.when(ok, F.struct(a.alias("a"), b.alias("b"), op.alias("op")))

    parts = F.split(F.when(text.rlike(r"\A[0-9+,;]*\z"), text) if plain else text, ";", -1)
    items = F.transform(F.filter(parts, lambda x: x != "") if lax else parts, item)
    return let(items, lambda t: F.when(~F.exists(t, lambda x: x.isNull()), t))


def format_trace(trace: Column) -> Column:
    one = lambda x: F.when(x["op"].isNotNull(), F.concat(x["a"].cast("string"), x["op"])).when(x["b"].isNotNull(), F.concat_ws(",", x["a"].cast("string"), x["b"].cast("string"))).otherwise(x["a"].cast("string"))
    return F.array_join(F.transform(trace, one), ";")


def parse_cigar(text: Column) -> Column:
    """ARRAY<STRUCT<n, op>>; an operation without a usable number has length 0."""
    items = F.regexp_extract_all(text, F.lit("[0-9]*[^0-9]"), F.lit(0))
    n = lambda x: F.left(x, F.length(x) - 1).try_cast("bigint")
    return F.transform(items, lambda x: F.struct(F.coalesce(n(x), F.lit(0).cast("bigint")).alias("n"), F.right(x, F.lit(1)).alias("op")))


def cigar_stats(ops: Column) -> Column:
    """STRUCT<matches, mismatches, insertions, deletions>; the last two are arrays of run lengths."""
    pick = lambda *names: F.transform(F.filter(ops, lambda x: x["op"].isin(*names)), lambda x: x["n"])
    return F.struct(total(pick("M", "=")).alias("matches"), total(pick("X")).alias("mismatches"), pick("I").alias("insertions"), pick("D").alias("deletions"))


def gap_compressed_identity(s: Column) -> Column:
    d = s["matches"] + s["mismatches"] + F.size(s["insertions"]) + F.size(s["deletions"])
    return F.when(d == 0, 0.0).otherwise(s["matches"] / d).cast("float")


def block_identity(s: Column) -> Column:
    d = s["matches"] + s["mismatches"] + total(s["insertions"]) + total(s["deletions"])
    return F.when(d == 0, 0.0).otherwise(s["matches"] / d).cast("float")


def edit_score(s: Column) -> Column:
    return -(s["mismatches"] + total(s["insertions"]) + total(s["deletions"]))


def affine_score(s: Column, mismatch: int, *pieces: tuple[int, int]) -> Column:
    """pieces: (open, extend) once, or twice for the cheaper of two for each gap."""
    cost = lambda n: F.least(*[o + e * n for o, e in pieces]) if len(pieces) > 1 else pieces[0][0] + pieces[0][1] * n
    gaps = F.concat(s["insertions"], s["deletions"])
    return -(mismatch * s["mismatches"] + total(gaps, lambda n: cost(n).cast("bigint")))
