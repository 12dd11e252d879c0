import random

import numpy as np
import pytest

from tracewright.functions import batches as B
from tracewright.functions import codecs as C


def streams(rng, k):
    out = [[], [0], [0] * 5, [7] * 70_000, list(range(300))]
    for _ in range(k):
        x = [rng.randrange(rng.choice((1, 2, 5, 200, 70_000, 1 << 30))) for _ in range(rng.choice((0, 1, 2, 4, 9, 61, 130, 400)))]
        out.append([v for v in x for _ in range(rng.choice((1, 1, 9)))] if rng.random() < 0.4 else x)
    return out


@pytest.mark.parametrize("name", B.PACKED)
@pytest.mark.parametrize("most", [1, 1000, 1 << 18])
def test_same_bytes_as_record_by_record(name, most):
    rows = streams(random.Random(most), 150)
    if name == "selective-rle":
        rows.remove([7] * 70_000)  # a run too long for one item: not for the whole batch
    if name == "cascaded":
        rows = [x for x in rows if C.encode(name, x)[:1] != b"\1"]  # nor are few distinct values
    v, off = np.array([y for x in rows for y in x], np.int64), B.ends_of(np.array([len(x) for x in rows]))
    data, to = B.encode(name, v, off, most)
    assert [data[a:b].tobytes() for a, b in zip(to[:-1], to[1:], strict=True)] == [C.encode(name, x) for x in rows]
    assert np.array_equal(B.decode(name, data, to, np.diff(off), most), v)


@pytest.mark.parametrize("name", B.PACKED)
def test_bad_bytes_are_unfit_or_read_alike(name):
    rng, rows = random.Random(name), streams(random.Random(5), 150)
    for x in rows[1:3] + rows[4:]:
        data = bytearray(C.encode(name, x))
        for _ in range(rng.randrange(3) if data else 0):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data, n = bytes(data[: rng.randrange(len(data) + 1)] if rng.random() < 0.5 else data), max(0, len(x) + rng.randrange(-1, 2))
        try:
            got = B.decode(name, np.frombuffer(data, np.uint8), np.array([0, len(data)]), np.array([n])).tolist()
        except B.Unfit:
            continue
        assert got == C.decode(name, data, n)


def test_columns_keep_nulls_and_bad_records_apart(spark):
    import pyarrow as pa

    rows = [[5, 9, 1], None, [], [1 << 61, 3], [7] * 20]
    for name in (*C.VARINT, *C.PACKED):
        data = C.encode_all(name, pa.array(rows, pa.list_(pa.int64()))).to_pylist()
        assert data == [None if x is None else C.tried(C.encode, name, x) for x in rows], name
        back = C.decode_all(name, pa.array(data, pa.binary()), pa.array([3, None, 0, 2, 20])).to_pylist()
        assert back == [None if d is None else x for x, d in zip(rows, data, strict=True)], name
        cut = C.decode_all(name, pa.array([data[0][:-1], data[4]], pa.binary()), pa.array([3, 20])).to_pylist()
        assert cut == [None, rows[4]], name
    with pytest.raises(ValueError):
        C.decode("frame-of-reference", b"\1\xff\0\0", 1)
