import gzip
import io
import random

import pyarrow as pa
import pytest

from tracewright.functions import codecs as C
from tracewright.sources import paf, text
from tracewright.streaming import paf as stream


@pytest.mark.parametrize("seed", range(4))
def test_bgzf_ranges(spark, tmp_path, seed):
    """Blocks that end within lines and at their ends, long lines, empty lines, no newline at the end."""
    r = random.Random(seed)
    rows = [bytes(r.choices(b"abc\t;,019", k=r.choice([0, 1, 30, 300, 20_000]))) for _ in range(60)]
    data = b"\n".join(rows) + b"\n" * (seed % 2)
    cuts = sorted({0, len(data), *r.sample(range(len(data)), 40), *(k + 1 for k in range(len(data)) if data[k] == 10 and r.random() < 0.3)})
    blocks = b"".join(C.bgzf(data[a:b])[: -len(C.BGZF_END)] for a, b in zip(cuts, cuts[1:])) + C.BGZF_END
    (tmp_path / "a.bgz").write_bytes(blocks)
    want = data.split(b"\n")[: -1 if data.endswith(b"\n") else None]
    if want and not want[-1] and not data.endswith(b"\n"):
        want.pop()
    with pa.OSFile(str(tmp_path / "a.bgz")) as f:
        for width in (1 << 20, 5000, 700, 37):
            assert [x for lo in range(0, len(blocks), width) for x in text.lines_in(f, lo, min(lo + width, len(blocks)), len(blocks), True)] == want
    got = text.read_bgzf(spark, str(tmp_path / "a.bgz"), 20_000).orderBy("row").collect()
    assert [bytes(x["value"]) for x in got] == want


def test_other_gzip(spark, tmp_path, monkeypatch):
    line = "q\t100\t0\t50\t+\tt\t200\t10\t60\t45\t50\t60\ttp:Z:5,5;7,0"
    members = gzip.compress(f"{line}\r\n# no\n".encode()) + gzip.compress(f"\n{line}\n".encode() + b"\xff\xfe\n")
    (tmp_path / "b.bgz").write_bytes(members)
    (tmp_path / "b.paf.gz").write_bytes(members)
    for name in ("b.bgz", "b.paf.gz"):
        assert [r.value for r in paf.read_lines(spark, str(tmp_path / name)).collect()] == [line, line]
    (tmp_path / "none.bgz").write_bytes(C.BGZF_END)
    assert paf.read_lines(spark, str(tmp_path / "none.bgz")).count() == 0
    (tmp_path / "bad.bgz").write_bytes(C.bgzf(b"x\n" * 50000)[:-40] + b"junk" * 20)
    with pytest.raises(Exception, match="damaged|data check"):
        text.read_bgzf(spark, str(tmp_path / "bad.bgz")).collect()
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(f"{line}\n".encode())))
    assert [r.value for r in paf.read_lines(spark, "-").collect()] == [line]


def test_stream(spark, tmp_path):
    """What a stream gives over several triggers is what a batch gives."""
    line = "q\t100\t0\t50\t+\tt\t200\t10\t60\t45\t50\t60\ttp:Z:{},5;7,0"
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.paf").write_text("\n".join([line.format(k * 100 + j) for j in range(5)] + ["# no", "short"]) + "\n")
    records = stream.read_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    q = stream.running_totals(records).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = paf.parse(paf.read_lines(spark, str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, stream.running_totals(batch).collect()))
    q = records.where("reject IS NOT NULL").select("value", "reject").writeStream.format("memory").queryName("rejects").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [r.reject for r in spark.table("rejects").collect()] == ["fewer than 12 fields"] * 3
