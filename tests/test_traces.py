import pytest
from pyspark.sql import functions as F

from tracewright.functions import streams as S
from tracewright.functions import traces as T
from tracewright.operators import dictionary, selection
from tracewright.sources import paf


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x array<bigint>" if isinstance(value, list) else "x string").select(f(F.col("x")).alias("r")).first()["r"]


def test_sizes_known(spark):
    assert one(spark, [0, 2, 3], S.elias_fano_size) == 2
    assert one(spark, [i % 32 for i in range(100)], S.bit_packed_size) < 80
    assert one(spark, [1, 1, 1, 2], S.rle_size) == 4
    assert one(spark, [127, 128, 1 << 62], S.raw_size) == 1 + 2 + 9
    assert one(spark, [5] * 300, S.selective_rle_size) == 4
    assert one(spark, list(range(256)), S.dictionary_size) == 2 + 128 + 256 + 256
    for f in S.SIZES.values():
        assert one(spark, [], f) in (0, 1)


@pytest.mark.parametrize(("variant", "text"), [("standard", "5,5;7,0"), ("single", "100;98"), ("variable", "5,6;9"), ("mixed", "5,6;10I")])
def test_trace_roundtrip(spark, variant, text):
    assert one(spark, text, lambda x: T.format_trace(T.parse_trace(x, variant))) == text


@pytest.mark.parametrize("text", ["5,5;", "5", "5,5,5", " 5,5", "a,1", ""])
def test_trace_rejects(spark, text):
    assert one(spark, text, lambda x: T.parse_trace(x, "standard")) is None


def test_cigar(spark):
    s = one(spark, "10=5X3I2D", lambda x: T.cigar_stats(T.parse_cigar(x)))
    assert (s["matches"], s["mismatches"], s["insertions"], s["deletions"]) == (10, 5, [3], [2])
    assert one(spark, "10=2X3I2D", lambda x: T.edit_score(T.cigar_stats(T.parse_cigar(x)))) == -7
    assert abs(one(spark, "10=3I2D", lambda x: T.gap_compressed_identity(T.cigar_stats(T.parse_cigar(x)))) - 10 / 12) < 0.01
    assert abs(one(spark, "10=3I2D", lambda x: T.block_identity(T.cigar_stats(T.parse_cigar(x)))) - 10 / 15) < 0.01


def test_paf(spark, tmp_path):
    good = "q\t100\t0\t50\t+\tt\t200\t10\t60\t45\t50\t60\tNM:i:3\tgi:f:0.98\txx:Z:a:b:c\tzz:A:c\tabc:i:1\ttp:Z:5,5;7,0"
    lines = [good, "# no", "", "q\t1", good.replace("\t60\tNM", "\t256\tNM"), good.replace("q\t100", "q\t+5"), good.replace("q\t100", "q\t 5"), good + ";", good.replace("tp:Z:5,5;7,0", "x"), good + "\r"]
    (tmp_path / "a.paf").write_bytes("\n".join(lines).encode() + b"\n\xff\xfe\n")
    rows = paf.parse(paf.read_lines(spark, str(tmp_path / "a.paf")))
    assert [r["reject"] for r in rows.orderBy("row").collect()] == [None, "fewer than 12 fields", "bad mapping_quality", None, "bad query_len", "bad trace", "neither trace nor cigar", None]
    text = [r[0] for r in paf.to_lines(rows.where("reject IS NULL")).collect()]
    assert good.replace("gi:f:0.98", "gi:f:0.98000002").replace("\tzz:A:c\tabc:i:1", "") in text


def test_dictionary(spark):
    names = [(2 * i + k, f"n{(i * 7 + k * 3) % 11}", i) for i in range(50) for k in (0, 1)]
    want, seen = [], {}
    for _, n, length in names:
        if n not in seen:
            seen[n] = len(seen)
            want.append((seen[n], n, length))
    df = spark.createDataFrame(names, "pos bigint, name string, length bigint")
    for width in (1, 3, 1000):
        assert [tuple(r) for r in dictionary.string_table(df, width).orderBy("id").collect()] == want


def test_strategies():
    assert selection.parse_strategy("rice-zstd,7") == selection.Strategy("rice", "zstd", 7)
    assert selection.parse_strategy("ef") == selection.Strategy("elias-fano", "nocomp", 0)
    assert selection.parse_strategy("raw-zstd").level == 3
    assert selection.parse_strategy("raw-bgzip,12").level == 12
    assert selection.parse_strategy("benchmark") == selection.Strategy("benchmark", "nocomp", 0, selection.SAMPLE)
    assert selection.parse_strategy("benchmark-nocomp,0,0") == selection.Strategy("benchmark", "nocomp", 0, 0, True)
    assert [s.level for s in selection.automatic("mixed", level=7)] == [7, 7]
    for bad in ("nope", "raw-bgzip,23", "raw,-1", "benchmark,3,-5", "raw,x", "raw,1,2,3", ""):
        with pytest.raises(ValueError):
            selection.parse_strategy(bad)
    assert [s.name for s in selection.automatic("standard")] == ["rice", "2d-delta"]
