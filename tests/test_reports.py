import itertools

import pytest

from tracewright.operators import reports
from tracewright.sources import paf

SCHEMA = "dataset_name string, compression_strategy string, strategy_first string, strategy_second string, compression_layer_first string, compression_layer_second string, ratio_tp_to_tpa double, ratio_orig_to_tpa double, direct_seek_avg_us double, compression_runtime_sec double, verification_passed string"


@pytest.fixture(scope="module")
def results(spark):
    row = lambda ds, name, first, layer, ratio, seek, took, ok="yes": (ds, name, first, "raw", layer, "nocomp", ratio, ratio, seek, took, ok)
    rows = [
        row("a", "rice", "rice", "nocomp", 3.0, 2.0, 5.0), row("a", "raw", "raw", "nocomp", 1.0, 0.5, 1.0, "no"), row("a", "raw-zstd", "raw", "zstd", 3.0, None, 1.0),
        row("a", "automatic,3", "raw", "zstd", 3.0, 9.0, 9.0), row("a", "benchmark", "rice", "nocomp", 3.0, 9.0, 9.0),
        row("b", "automatic", "rice", "nocomp", 3.0, None, None), row("c", "rice", "rice", "nocomp", None, 0.0, 1.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_automatic(results):
    got = {(r.dataset_name, r.compression_strategy): (r.best_strategy_first, r.best_compression_layer_first, r.same) for r in reports.best_and_automatic(results).collect()}
    assert got == {("a", "automatic,3"): ("raw", "zstd", True), ("a", "benchmark"): ("raw", "zstd", False), ("b", "automatic"): (None, None, None)}
    assert reports.best_and_automatic(results.limit(0)).count() == 0


def test_best_per_metric(results):
    got = {(r.dataset_name, r.metric): (r.strategy_first, r.value) for r in reports.best_per_metric(results).collect()}
    assert got == {
        ("a", "ratio"): ("raw", 3.0), ("a", "seek"): ("raw", 0.5), ("a", "compression_time"): ("raw", 1.0), ("a", "balance"): ("raw", 20.0),
        ("b", "ratio"): ("rice", 3.0), ("c", "seek"): ("rice", 0.0), ("c", "compression_time"): ("rice", 1.0),
    }
    assert {r.dataset_name: (r.n, r.pairs, r.pass_rate) for r in reports.summary(results).collect()} == {"a": (5, 2, 0.8), "b": (1, 1, 1.0), "c": (1, 1, 1.0)}


def test_seeks(spark):
    schema = "decoded boolean, valid boolean, us double"
    r = reports.seek_summary(spark.createDataFrame([(True, True, 2.0), (True, None, 4.0)], schema)).first()
    assert tuple(r) == (3.0, 1.0, 0.5)
    assert tuple(reports.seek_summary(spark.createDataFrame([], schema)).first()) == (0.0, 0.0, 0.0)
    state, want = 12345, []
    while len(want) < 5:
        state = (state * 1103515245 + 12345) % 2**64
        want += [k for k in [state % 1000] if k not in want]
    assert list(reports.seek_positions(5, 1000)) == want
    for wanted, n in itertools.product((0, 1, 7, 64), (1, 7, 64)):
        got = list(reports.seek_positions(wanted, n))
        assert len(got) == len(set(got)) == min(wanted, n) and all(0 <= k < n for k in got)


def test_normalize(spark):
    head = "q" + "\t1" * 11
    lines = [head, f"{head}\tzz:Z:b:f:7\tab:f:.0625\tzz:f:0.9876\tab:i:4\tcc:f:-1.5\tdd:f:2\tee:f:1e5\r", "short\tline", ""]
    got = [r.value for r in paf.normalize(spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, value string")).orderBy("k").collect()]
    assert got == [head, f"{head}\tab:f:0.062\tab:i:4\tcc:f:-1.5\tdd:f:2.000\tee:f:1e5\tzz:Z:b:f:7\tzz:f:0.988", "short\tline", ""]
