import pytest

from tracewright.__main__ import main
from tracewright.operators import selection
from tracewright.operators.selection import Strategy
from tracewright.plans import convert
from tracewright.sources import container

HEAD = "q{0}\t1000\t0\t20\t{1}\tt\t2000\t100\t120\t18\t20\t60"


def paf(tmp_path, lines):
    (tmp_path / "a.paf").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "a.paf")


@pytest.mark.parametrize("strategy", ["automatic", "benchmark,3,2", "rice-zstd"])
def test_pack_and_unpack(spark, tmp_path, capsys, strategy):
    lines = [f"{HEAD.format(k, '+-'[k % 2])}\tNM:i:{k}\ttp:Z:5,{k};7,0" for k in range(9)]
    source, path = paf(tmp_path, [*lines, "# no", "short"]), str(tmp_path / "x.bin")
    main(["pack", source, path, "--first", strategy, "--second", "raw"])
    assert dict(x.split("\t") for x in capsys.readouterr().out.split("\n") if x) == {"records": "9", "rejected": "0", "strings": "10", "lines_rejected": "1"}
    main(["unpack", path, str(tmp_path / "out")])
    assert sorted(spark.read.text(str(tmp_path / "out")).toPandas()["value"]) == lines
    main(["view", path])
    assert capsys.readouterr().out.rstrip("\n").split("\n")[-9:] == lines
    main(["view", path, "--strategies"])
    shown = capsys.readouterr().out.rstrip("\n").split("\t")
    assert shown[:2] == ["rice", "2d-delta"] if strategy == "automatic" else len(shown) == 4
    main(["sizes", path])
    assert "header\tall\t" in capsys.readouterr().out


def test_cigars_and_contigs(spark, tmp_path):
    given = [f"{HEAD.format(0, '+')}\tNM:i:1\tcg:Z:20=", f"{HEAD.format(1, '+')}\tcg:Z:8=4X8=", f"{HEAD.format(0, '+')}\tcg:Z:20=\ttp:Z:1,20"]
    contigs = spark.createDataFrame([("q0", 0, 5), ("q0", 10, 1000)], "name string, start bigint, end bigint")
    h = container.Header(Strategy("raw"), Strategy("raw"), "fastga", max_complexity=10)
    convert.paf_to_container(spark, paf(tmp_path, given), str(tmp_path / "x.bin"), h, contigs)
    got = container.read_resolved(spark, str(tmp_path / "x.bin")).orderBy("record_id").collect()
    assert [(r.query_name, r.query_start, r.query_end, r.target_start, r.residue_matches, len(r.tags), [(x.a, x.b) for x in r.trace]) for r in got] == [
        ("q0", 0, 5, 100, 5, 1, [(0, 5)]), ("q0", 10, 20, 110, 10, 0, [(0, 10)]), ("q1", 0, 20, 100, 18, 0, [(2, 10), (2, 10)]), ("q0", 0, 20, 100, 18, 0, [(1, 20)]),
    ]


def test_choice(spark):
    df = spark.createDataFrame([(0, [(7, 7, None)] * 50), (1, [(1 << 40, 3, None)] * 2), (2, None), (3, [])], "record_id bigint, trace array<struct<a:bigint,b:bigint,op:string>>")
    ask = Strategy("benchmark", "nocomp", 3, 1, True)
    names = selection.chosen(df, ask, ask, "standard")
    assert [x.layer for x in names] == ["nocomp", "nocomp"]
    pressed = selection.chosen(df, Strategy("benchmark", "bgzip", 3, 1, True), ask, "standard")
    assert [x.layer for x in pressed] == ["bgzip", "bgzip"]
    assert [x.layer for x in selection.chosen(df, Strategy("benchmark", sample=1), ask, "standard", all_records=True)] == ["zstd", "zstd"]
    totals = {r.strategy: r.total for r in selection.measured(df.where("record_id = 0").selectExpr("trace.a AS a"), "a", ("nocomp",)).collect()}
    assert totals[names[0].name] == min(v for v in totals.values() if v is not None)
    assert selection.chosen(df, Strategy("automatic"), ask, "mixed") == selection.automatic("mixed")
    assert selection.chosen(df, Strategy("raw"), Strategy("rle"), "mixed") == (Strategy("raw"), Strategy("rle"))
    with pytest.raises(ValueError, match="no encoding"):
        selection.best_measured(selection.measured(df.limit(0).selectExpr("trace.a AS a"), "a"))
