"""Records split where their sequences leave a contig.

A scaffold is a row of contigs with gaps of unknown bases between them; `contigs` is `(name, start, end)`, without overlaps. A segment of
a record is a longest stretch of its CIGAR that stays within one contig of the query and one of the target; a sequence that isn't listed
is one contig without ends. Segments begin and end with an aligned pair: indels at their edges, and what lies in gaps, fall out. The
trace holds (differences, target advance) between multiples of the spacing, counted from the start of the query's contig.
On the reverse strand the target's contigs are flipped for the walk, and the coordinates are given forward again.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.alignment import cigar_text, operations, spaced

END = 1 << 62
_OUT = "array<struct<query_start:bigint,query_end:bigint,target_start:bigint,target_end:bigint,differences:bigint,trace:array<struct<a:bigint,b:bigint,op:string>>>>"
_TRACE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("op", pa.string())]))
_ARROW = pa.list_(pa.struct([*[(c, pa.int64()) for c in ("query_start", "query_end", "target_start", "target_end", "differences")], ("trace", _TRACE)]))


class Runs:
    """Contigs in order; None stands for one without ends."""

    def __init__(self, runs: list[tuple[int, int]] | None):
        self.runs = [(0, END)] if runs is None else sorted(runs)
        self.starts = [s for s, _ in self.runs]

    def place(self, x: int) -> tuple[int, int]:
        """The contig that holds `x` and its end, or -1 and where the gap ends."""
        k = bisect_right(self.starts, x) - 1
        if k >= 0 and x < self.runs[k][1]:
            return k, self.runs[k][1]
        return -1, self.starts[k + 1] if k + 1 < len(self.starts) else END


def split_cigar(cigar: str, query_start: int, target_start: int, query: Runs, target: Runs, spacing: int) -> list[dict]:
    """Segments in the order of the walk, with the target's coordinates as walked."""
    out: list[dict] = []
    q, t, here, ops, at = query_start, target_start, None, [], (0, 0)

    def close() -> None:
        nonlocal here
        if here is None:
            return
        here, kept = None, list(ops)
        while kept[-1][1] in "ID":
            kept.pop()
        a, b = (sum(n for n, op in kept if op != skip) for skip in "DI")
        local = at[0] - query.starts[query.place(at[0])[0]]
        trace = [{"a": x, "b": y, "op": None} for x, y in spaced(cigar_text(kept), spacing, local)]
        out.append({"query_start": at[0], "query_end": at[0] + a, "target_start": at[1], "target_end": at[1] + b, "differences": sum(x["a"] for x in trace), "trace": trace})

    for n, op in operations(cigar):
        while n:
            (i, q_end), (j, t_end) = query.place(q), target.place(t)
            part = min(n, END if op == "D" else q_end - q, END if op == "I" else t_end - t)
            inside = (op == "D" or i >= 0) and (op == "I" or j >= 0)
            if here is not None and (not inside or (op != "D" and i != here[0]) or (op != "I" and j != here[1])):
                close()
            if here is None and inside and op in "=X":
                here, ops, at = (i, j), [], (q, t)
            if here is not None:
                ops.append((part, op))
            q, t, n = q + (part if op != "D" else 0), t + (part if op != "I" else 0), n - part
    close()
    return out


def _split(spacing: int):
    @arrow_udf(_OUT)
    def run(cigar: pa.Array, q: pa.Array, t: pa.Array, query: pa.Array, target: pa.Array) -> pa.Array:
        pairs = lambda x: Runs(None if x is None else [(r["start"], r["end"]) for r in x])
        out = []
        for c, a, b, x, y in zip(*[v.to_pylist() for v in (cigar, q, t, query, target)], strict=True):
            try:
                out.append(None if None in (c, a, b) else split_cigar(c, a, b, pairs(x), pairs(y), spacing))
            except ValueError:
                out.append(None)
        return pa.array(out, _ARROW)

    return run


def split_by_contigs(records: DataFrame, contigs: DataFrame, spacing: int = 100) -> DataFrame:
    """One row per segment, with `segment` (from 0). Records need the columns of PAF text with `cigar`. Matches are the query's span
    less the differences, the block length is the span, and only the first segment keeps the tags. A record with a null or
    malformed CIGAR, or without a segment, gives no row.

    The contigs of a scaffold come as one array, of which a record keeps those it overlaps before any Python sees them;
    adaptive execution broadcasts a small list and splits scaffolds with very many records otherwise."""
    runs = contigs.where("name IS NOT NULL AND start < end").groupBy("name").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"))
    for role in ("query", "target"):
        side = runs.select(F.col("name").alias(f"{role}_name"), F.col("runs").alias(f"__{role}"))
        records = records.join(side, f"{role}_name", "left")
    near = lambda role: F.filter(f"__{role}", lambda r: (r["start"] < F.col(f"{role}_end")) & (r["end"] > F.col(f"{role}_start")))
    back = F.col("strand") == "-"
    flipped = F.transform(near("target"), lambda r: F.struct((F.col("target_len") - r["end"]).alias("start"), (F.col("target_len") - r["start"]).alias("end")))
    begin = F.when(back, F.col("target_len") - F.col("target_end")).otherwise(F.col("target_start"))
    got = _split(spacing)(F.col("cigar"), F.col("query_start").cast("bigint"), begin.cast("bigint"), near("query"), F.when(back, flipped).otherwise(near("target")))
    old = ("query_start", "query_end", "target_start", "target_end", "residue_matches", "alignment_block_len", "trace", "tags", "cigar")
    kept = [c for c in records.columns if c not in old and not c.startswith("__")]
    rows = records.select(*kept, "tags", got.alias("__s")).select(*kept, "tags", F.posexplode("__s").alias("segment", "s"))
    back, length, span = F.col("strand") == "-", F.col("target_len"), F.col("s.query_end") - F.col("s.query_start")
    return rows.select(
        *kept,
        "segment",
        "s.query_start",
        "s.query_end",
        F.when(back, length - F.col("s.target_end")).otherwise(F.col("s.target_start")).alias("target_start"),
        F.when(back, length - F.col("s.target_start")).otherwise(F.col("s.target_end")).alias("target_end"),
        F.greatest(F.lit(0).cast("bigint"), span - F.col("s.differences")).alias("residue_matches"),
        span.alias("alignment_block_len"),
        F.col("s.trace").alias("trace"),
        F.when(F.col("segment") == 0, F.col("tags")).otherwise(F.slice("tags", 1, 0)).alias("tags"),
    )
