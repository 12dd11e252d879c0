"""Contig splitting against a walk base by base."""

import random

import pytest

from tracewright.functions.alignment import operations
from tracewright.operators.contigs import Runs, split_by_contigs, split_cigar


def brute(cigar, q, t, query, target):
    """Columns (op, q, t) grouped by the contigs of their bases, trimmed to aligned pairs."""
    find = lambda runs, x: 0 if runs is None else next((k for k, (s, e) in enumerate(runs) if s <= x < e), -1)
    groups, now = [], None
    for op in "".join(op * n for n, op in operations(cigar)):
        i, j = (find(query, q) if op != "D" else None), (find(target, t) if op != "I" else None)
        fits = -1 not in (i, j) and (now is None or (i in (None, now[0]) and j in (None, now[1])))
        if not fits:
            now = None
        if now is None and op in "=X" and -1 not in (i, j):
            now = (i, j)
            groups.append([])
        if now:
            groups[-1].append((op, q, t))
        q, t = q + (op != "D"), t + (op != "I")
    out = []
    for g in groups:
        while g[-1][0] in "ID":
            g.pop()
        out.append((g[0][1], g[-1][1] + 1, g[0][2], g[-1][2] + 1, sum(op != "=" for op, _, _ in g)))
    return out


@pytest.mark.parametrize("seed", range(200))
def test_split(seed):
    r = random.Random(seed)
    runs, x = [], 0
    for _ in range(r.randint(1, 6)):
        x += r.randint(0, 6)
        runs.append((x, x := x + r.randint(1, 12)))
    cigar = "".join(f"{r.randint(1, 7)}{r.choice('==XID')}" for _ in range(12))
    q, t = r.randint(0, 5), r.randint(0, 5)
    for a, b in ((runs, None), (None, runs), (runs, [(s + 2, e + 2) for s, e in runs]), (None, None)):
        got = split_cigar(cigar, q, t, Runs(a), Runs(b), 5)
        assert [tuple(s[c] for c in ("query_start", "query_end", "target_start", "target_end", "differences")) for s in got] == brute(cigar, q, t, a, b)
        for s in got:
            assert sum(x["b"] for x in s["trace"]) == s["target_end"] - s["target_start"]


def test_columns(spark):
    names = "record_id bigint, query_name string, query_len bigint, query_start bigint, query_end bigint, strand string, target_name string, target_len bigint, target_start bigint, target_end bigint, residue_matches bigint, alignment_block_len bigint, mapping_quality smallint, cigar string, tags array<string>, more string"
    row = lambda k, strand, target, cigar: (k, "q", 40, 0, 20, strand, target, 100, 10, 30, 20, 20, 60, cigar, ["x", "y"], "m")
    rows = [row(0, "+", "t", "20="), row(1, "-", "t", "5=2X13="), row(2, "+", "none", "20="), row(3, "+", "t", None), row(4, "+", "t", "bad"), row(5, "+", None, "20=")]
    contigs = spark.createDataFrame([("t", 0, 15), ("t", 20, 100), ("t", 20, 100), (None, 0, 5), ("u", 5, 5)], "name string, start bigint, end bigint")
    got = split_by_contigs(spark.createDataFrame(rows, names), contigs, 10).orderBy("record_id", "segment").collect()
    cut = [(r.record_id, r.segment, r.query_start, r.query_end, r.target_start, r.target_end, r.residue_matches, len(r.tags)) for r in got]
    assert cut == [(0, 0, 0, 5, 10, 15, 5, 2), (0, 1, 10, 20, 20, 30, 10, 0), (1, 0, 0, 10, 20, 30, 8, 2), (1, 1, 15, 20, 10, 15, 5, 0), (2, 0, 0, 20, 10, 30, 20, 2), (5, 0, 0, 20, 10, 30, 20, 2)]
    assert [(x.a, x.b) for x in got[2].trace] == [(2, 10)] and got[0].more == "m"
    none = split_by_contigs(spark.createDataFrame(rows[:1], names), contigs.limit(0))
    assert none.count() == 1
