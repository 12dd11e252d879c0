import random

import numpy as np
import pytest

from tracewright.operators.selection import STRATEGIES, Strategy
from tracewright.sources import container

SCHEMA = "record_id bigint, query_name string, query_len bigint, query_start bigint, query_end bigint, strand string, target_name string, target_len bigint, target_start bigint, target_end bigint, residue_matches bigint, alignment_block_len bigint, mapping_quality smallint, trace array<struct<a:bigint,b:bigint,op:string>>, tags array<struct<key:string,type:string,i:int,f:float,s:string>>"


def rows(variant, n=300, bad=False):
    rng, out = random.Random(variant), []
    for k in range(n):
        trace = []
        for _ in range(rng.randrange(1, 12)):
            a, b = rng.randrange(60), rng.randrange(60)
            one = rng.random() < 0.4
            trace.append((a, None, None) if variant == "single" or (variant == "variable" and one) else (a, None, rng.choice("=XID")) if variant == "mixed" and one else (a, b, None))
        tags = [("NM", "i", -3, None, None), ("gi", "f", None, 0.5, None), ("xx", "Z", None, None, "a:é")][: k % 4]
        q, t = f"q{k % 17}", f"t{k % 5}"
        out.append((3 * k, q, 1000 + k % 17, k, k + 50, "+-"[k % 2], t, 2000 + k % 5, 2 * k, 2 * k + 60, 40, 60, k % 256, [] if bad and k == 7 else trace, tags))
    return out


def plain(rows_):
    return [tuple(tuple(map(tuple, v)) if isinstance(v, list) else v for v in r) for r in rows_]


@pytest.mark.parametrize(("variant", "first", "second", "layers", "whole"), [
    ("standard", "rice", "2d-delta", ("nocomp", "nocomp"), False), ("fastga", "elias-fano", "huffman", ("zstd", "bgzip"), False), ("single", "huffman", "raw", ("nocomp", "nocomp"), True),
    ("variable", "zigzag-delta", "2d-delta", ("zstd", "nocomp"), False), ("mixed", "raw", "hybrid-rle", ("bgzip", "zstd"), False), ("mixed", "lz77", "cascaded", ("nocomp", "nocomp"), True),
])
def test_roundtrip(spark, tmp_path, variant, first, second, layers, whole, monkeypatch):
    monkeypatch.setattr(container, "SLICE", 64)
    monkeypatch.setattr(container, "PIECE", 1500)
    path, given = str(tmp_path / "x.bin"), rows(variant, bad=True)
    h = container.Header(Strategy(first, layers[0], 3), Strategy(second, layers[1], 3), variant, distance=("gap-affine", 5, 8, 2), all_records=whole)
    counts = container.write(spark.createDataFrame(given, SCHEMA).repartition(3), path, h)
    assert counts == {"records": 299, "rejected": 1, "strings": 22}
    assert container.is_container(path) and not container.is_container('-')
    got, _ = container.read_header(path)
    assert (got.num_records, got.first.name, got.second.layer, got.variant, got.distance, got.all_records) == (299, first, layers[1], variant, ("gap-affine", 5, 8, 2), whole)
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    want = [(k, *r[1:]) for k, r in enumerate(r for r in given if r[13])]
    back = container.read_resolved(spark, path).select(*cols).orderBy("record_id").collect()
    assert plain(map(list, map(tuple, back))) == plain(map(list, want))
    some = container.read(spark, path, [5, 298, 0]).orderBy("record_id").collect()
    assert [r["record_id"] for r in some] == [0, 5, 298]
    assert [plain([list(r["trace"])])[0] for r in some] == [plain([want[k][13]])[0] for k in (0, 5, 298)]
    meta = container.read(spark, path, [3], metadata_only=True).first()
    assert meta["trace"] is None and len(meta["tags"]) == len(want[3][14])
    assert np.array_equal(container.build_index(path), container.read_index(path + ".idx")[0])
    for k in (0, 150, 298):
        position = int(container.read_index(path + ".idx")[0][k])
        assert plain([container.record_at(path, position)["trace"] and [tuple(x.values()) for x in container.record_at(path, position)["trace"]]]) == plain([want[k][13]])
        assert [tuple(x.values()) for x in container.trace_at(path, container.trace_position(path, position), variant)] == want[k][13]
    whole_read = container.resolve(container.read_in_order(spark, path), container.read_strings(spark, path)).select(*cols).orderBy("record_id").collect()
    assert whole_read == back
    places = {r.record_id: (r.position, r.trace_position) for r in container.index_rows(spark, path).collect()}
    assert places[150] == (int(container.read_index(path + ".idx")[0][150]), container.position_of(path, 150))
    trace, metric, most = container.trace_of(path, 150)
    assert [tuple(x.values()) for x in trace] == want[150][13] and (metric, most) == (h.metric, h.max_complexity)
    with pytest.raises(IndexError):
        container.position_of(path, 299)
    kept = (tmp_path / "x.bin.idx").read_bytes()
    for damage in (None, kept[:-1], b"junk", container.index_bytes(np.arange(3), whole, 0)):
        (tmp_path / "x.bin.idx").unlink()
        if damage is not None:
            (tmp_path / "x.bin.idx").write_bytes(damage)
        assert container.read(spark, path, [5]).first()["record_id"] == 5
        assert (tmp_path / "x.bin.idx").read_bytes() == kept
    with pytest.raises(ValueError, match="are not"):
        container.trace_at(path, 0, "nothing")
    sizes = {(r.section, r.part): r.bytes for r in container.size_report(spark, path).collect()}
    assert sum(sizes.values()) == (tmp_path / "x.bin").stat().st_size and sizes["names", "names"] == sum(len(f"q{k}") for k in range(17)) + 2 * 5
    with pytest.raises(IndexError):
        container.read(spark, path, [299])


def test_unknown_names(spark):
    strings = spark.createDataFrame([(0, "a", 5)], "id bigint, name string, length bigint")
    ids = spark.createDataFrame([(0, 0), (0, 1)], "query_name_id bigint, target_name_id bigint")
    assert container.resolve(ids.where("target_name_id = 0"), strings).first()["target_name"] == "a"
    with pytest.raises(Exception, match="unknown target name id 1"):
        container.resolve(ids, strings).collect()


def test_damage(spark, tmp_path):
    path = str(tmp_path / "x.bin")
    container.write(spark.createDataFrame(rows("standard", 5), SCHEMA), path)
    data = (tmp_path / "x.bin").read_bytes()
    for bad in (data[:-1], b"XXXX" + data[4:], data[:5] + bytes([data[5] + 1]) + data[6:]):
        (tmp_path / "y.bin").write_bytes(bad)
        with pytest.raises(ValueError):
            container.read_header(str(tmp_path / "y.bin"))
    with pytest.raises(ValueError):
        container.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "z.bin"))


def test_header_codes():
    for name in STRATEGIES:
        h = container.Header(Strategy(name, "zstd"), Strategy(name, "bgzip"), num_records=300, num_strings=5, distance=("gap-affine-2p", 1, 2, 3, 4, 5))
        got = container.parse_header(container.C.Reader(h.data()))
        assert got == h


@pytest.mark.parametrize("variant", container.VARIANTS)
@pytest.mark.parametrize("whole", [False, True])
def test_in_order_is_decoded_by_many_tasks(spark, tmp_path, variant, whole, monkeypatch):
    monkeypatch.setattr(container, "PIECE", 1500)
    monkeypatch.setattr(container, "STRIDE", 64)
    path = str(tmp_path / "x.bin")
    container.write(spark.createDataFrame(rows(variant), SCHEMA), path, container.Header(Strategy("raw"), Strategy("rle", "zstd"), variant, all_records=whole))
    want, positions = container.read(spark, path).orderBy("record_id").collect(), container.read_index(path + ".idx")[0]
    assert list(container.flow(path, 7))[:-1] == positions[::7].tolist()
    (tmp_path / "x.bin.idx").unlink()
    got = container.read_in_order(spark, path)
    assert got.rdd.glom().map(len).collect().count(0) == 0 and got.rdd.getNumPartitions() == 5
    assert got.orderBy("record_id").collect() == want
    assert not (tmp_path / "x.bin.idx").exists()


@pytest.mark.parametrize("variant", container.VARIANTS)
def test_skip_ends_where_reading_ends(variant):
    h = container.Header(Strategy("raw"), Strategy("raw"), variant)
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    for r in rows(variant, 40):
        row = dict(zip(cols, r, strict=True)) | {"query_name_id": 300, "target_name_id": 1 << 40}
        row["trace"] = [dict(zip(("a", "b", "op"), x, strict=True)) for x in row["trace"] * 40]
        row["tags"] = [dict(zip(("key", "type", "i", "f", "s"), t, strict=True)) for t in row["tags"]] + [{"key": "zz", "type": "Z", "i": None, "f": None, "s": "x" * 200}]
        data = container.write_record(row, h)
        for read in (container.read_record, container.skip_record):
            reader = container.C.Reader(data + b"more")
            read(reader, h)
            assert reader.at == len(data)
            for cut in (0, 5, len(data) // 2, len(data) - 1):
                with pytest.raises(ValueError):
                    read(container.C.Reader(data[:cut]), h)
            with pytest.raises(ValueError, match="unknown type of tag"):
                read(container.C.Reader(data[:-203] + b"q" + data[-202:]), h)
