import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import codecs as C
from tracewright.functions import streams as S

ALL = (*C.VARINT, *C.PACKED)
CASES = [
    [], [0], [42], [0, 0, 0, 0], [7] * 300, [5, 6, 7, 9, 60, 61, 62, 80, 200, 301], [100, 8, 20, 11, 11, 8], [1, 2] * 20, list(range(100)), list(range(256)), list(range(500)),
    [42] * 70000, [3, 900_000_000, 1, 4_000_000_000], [i % 32 for i in range(100)], [1] * 7, [1] * 8 + [2] * 7, [10] * 126 + [10_000_000, 5], [0, 2, 3],
]


@pytest.mark.parametrize("name", ALL)
def test_roundtrip(name):
    rng = random.Random(name)
    more = [[rng.randrange(1 << rng.choice((1, 5, 8, 9, 16, 17, 31))) for _ in range(rng.randrange(1, 400))] for _ in range(20)]
    for x in CASES + [m for m in more if name != "elias-fano" or sum(m) < 1 << 40]:
        if name == "rice" and x and max(x) > 1 << 31:
            continue
        data = C.encode(name, x)
        assert C.decode(name, data, len(x)) == x
        assert x or data == b""


@pytest.mark.parametrize("name", ["raw", "zigzag-delta", "xor-delta", "rle", "delta-of-delta", "bit-packed", "frame-of-reference", "dictionary", "cascaded", "selective-rle", "lz77", "fastpfor"])
def test_wide(name):
    x = [0, (1 << 60) + 5, 3, 3, (1 << 62) - 1]
    assert C.decode(name, C.encode(name, x), len(x)) == x


def test_known_bytes():
    assert C.encode("elias-fano", [0, 2, 3]) == bytes([0x01, 0x2A])
    assert len(C.encode("bit-packed", [i % 32 for i in range(100)])) < 80
    assert C.encode("dictionary", list(range(10)))[0] == 1 and C.encode("dictionary", list(range(500)))[0] == 0
    assert C.encode("dictionary", list(range(256)))[:2] == b"\1\0"
    assert len(C.encode("simple8b-full", [1, 0, 1, 1, 0, 0, 1])) <= 16
    assert C.encode("rle", [300, 300, 1]) == b"\xac\x02\x02\x01\x01"
    assert C.encode("lz77", [4] * 5) == b"\0\x04\1\x01\x04"
    assert C.encode("cascaded", [9] * 300 + [4]) == b"\1\x02\x09\x04\x00\xff\x00\x2d\x01\x01"


def test_offsets_over_two_bytes(spark):
    """Offsets over 65,535 take four bytes, whole, and the size expression says so."""
    x = [70005, 5, 65541]
    want = bytes([5, 17, 0x70, 0x11, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0])
    assert C.encode("frame-of-reference", x) == want and C.decode("frame-of-reference", want, 3) == x
    df = spark.createDataFrame([(x,)], "x array<bigint>")
    assert df.select(C.encoded(F.col("x"), "frame-of-reference"), S.SIZES["frame-of-reference"](F.col("x"))).first()[:] == (want, len(want))


def test_patched_offsets_over_two_bytes():
    """Offsets over 65,535 are varints there, of one to five bytes."""
    x = [70005, 5, 65541]
    want = bytes([3, 5, 17, 0, 0xF0, 0xA2, 4, 0, 0x80, 0x80, 4])
    assert C.encode("fastpfor", x) == want and C.decode("fastpfor", want, 3) == x


def test_out_of_range():
    for name, v in (("stream-vbyte", 1 << 32), ("simple8b-full", 1 << 60), ("rice", 1 << 62)):
        with pytest.raises(ValueError):
            C.encode(name, [v])
    for name in ALL:
        with pytest.raises(ValueError):
            C.decode(name, C.encode(name, [5, 9, 1])[:-1], 3)


@pytest.mark.parametrize("name", ["zstd", "bgzip", "nocomp"])
def test_layers(name):
    for data in (b"", b"abc", bytes(200_000), np.random.default_rng(1).bytes(150_000)):
        squeeze, loose = C.layer(name, 3)
        assert loose(squeeze(data)) == data


def test_kept_compressors_and_few_numbers_give_the_same():
    import zstandard

    rng = random.Random(7)
    for _ in range(300):
        data, level = bytes(rng.choice((0, 1, 127, 128, 255)) for _ in range(rng.randrange(60))), rng.choice((1, 3, 9))
        squeeze, loose = C.layer("zstd", level)
        z = squeeze(data)
        assert z == zstandard.ZstdCompressor(level=level).compress(data)
        C.tried(loose, z[: rng.randrange(len(z))])
        assert loose(z) == data  # after a damaged frame, too
        many = C.tried(C.unvarints, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert C.tried(C.few_numbers, data) == (None if many is None else many[0].tolist())


def test_second():
    a, b = [5, 7, 100], [6, 0, 100]
    for name in ALL:
        assert C.decode_second(name, a, C.encode_second(name, a, b), 3) == b
    assert C.encode_second("2d-delta", a, b) == b"\x02\x0d\x00"


def test_columns(spark):
    rng = random.Random(3)
    rows = [(k, None if k % 11 == 5 else [] if k % 11 == 6 else [rng.randrange(2000) for _ in range(rng.randrange(1, 14))]) for k in range(200)]
    df = spark.createDataFrame(rows, "k bigint, x array<bigint>").repartition(3)
    for name in ALL:
        for lay in ("nocomp", "zstd") if name in ("raw", "rice") else ("nocomp",):
            got = df.withColumn("data", C.encoded(F.col("x"), name, lay)).withColumn("y", C.decoded(F.col("data"), F.size("x"), name, lay))
            size = S.SIZES[name](F.col("x")) if name in S.SIZES and lay == "nocomp" else F.octet_length("data")
            assert got.where((~F.col("x").eqNullSafe(F.col("y"))) | (F.octet_length("data") != size)).count() == 0, name
    big = spark.createDataFrame([([1 << 40],), ([1],)], "x array<bigint>")
    assert [r[0] is None for r in big.select(C.encoded(F.col("x"), "stream-vbyte")).collect()] == [True, False]
