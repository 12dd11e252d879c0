"""Codecs over a whole Arrow batch: one flat int64 array and the offsets of its records, no loop over values.

`VARINT` codecs differ by a transform of the numbers before they are written as varints. `PACKED` ones place bits, and have an encoder
`(values, offsets) -> (bytes, offsets)` and a decoder `(bytes, offsets, lengths) -> values`. Where the next item's place depends on the item (rice,
selective-rle, simple8b-full), a short loop finds the places and all else is done at once. Each raises `Unfit` for a batch that it doesn't take
whole, because a record doesn't fit or its numbers are too wide for 64-bit sums; `codecs` then goes record by record, with the same bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Offsets = np.ndarray
#: Fixed values of the formats.
DICTIONARY_MOST, CASCADE_SHARE, RUN_LEAST, RUN_MOST, RICE_MOST = 256, 0.01, 8, 65535, 16
WORD_MODES = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: The widest number that fits a word of 64 bits wherever in a byte it begins.
WIDEST = 56


class Unfit(ValueError):
    """This batch must go record by record."""


def need(ok) -> None:
    if not ok:
        raise Unfit


# Whole batches.


def heads(off: Offsets) -> np.ndarray:
    """Where the records that aren't empty begin."""
    return off[:-1][off[:-1] < off[1:]]


def zigzag(v: np.ndarray) -> np.ndarray:
    return (v << 1) ^ (v >> 63)


def unzigzag(v: np.ndarray) -> np.ndarray:
    return (v.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(v & 1)


def before(v: np.ndarray, off: Offsets) -> np.ndarray:
    """The value before each in its record; 0 before the first."""
    out = np.zeros_like(v)
    out[1:] = v[:-1]
    out[heads(off)] = 0
    return out


def deltas(v: np.ndarray, off: Offsets) -> np.ndarray:
    return v - before(v, off)


def sums(v: np.ndarray, off: Offsets) -> np.ndarray:
    total, at = np.cumsum(v), heads(off)
    return total - np.repeat(total[at] - v[at], np.diff(off)[off[:-1] < off[1:]])


def xor_sums(v: np.ndarray, off: Offsets) -> np.ndarray:
    total, at = np.bitwise_xor.accumulate(v) if len(v) else v, heads(off)
    return total ^ np.repeat(total[at] ^ v[at], np.diff(off)[off[:-1] < off[1:]])


def runs(v: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    """Value and length of each run, in turn."""
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    new[heads(off)] = True
    at = np.flatnonzero(new)
    out = np.empty(2 * len(at), np.int64)
    out[0::2], out[1::2] = v[at], np.diff(np.append(at, len(v)))
    return out, 2 * np.append(0, np.cumsum(new))[off]


def unruns(v: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    if (off % 2).any() or (v[1::2] < 1).any():
        raise ValueError("bad runs")
    return np.repeat(v[0::2], v[1::2]), np.append(0, np.cumsum(v[1::2]))[off // 2]


def varint_sizes(v: np.ndarray) -> np.ndarray:
    u, n = v.view(np.uint64), np.ones(len(v), np.int64)
    for k in range(1, 10):
        n += u >= np.uint64(1 << 7 * k)
    return n


def varints(v: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    """Seven bits a byte, the lowest first; bytes and their offsets."""
    u, n = v.view(np.uint64), varint_sizes(v)
    ends = np.append(0, np.cumsum(n))
    out = np.empty(ends[-1], np.uint8)
    for k in range(10):
        more = np.flatnonzero(n > k)
        if not len(more):
            break
        seven = ((u[more] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[ends[more] + k] = seven | np.where(n[more] > k + 1, 128, 0).astype(np.uint8)
    return out, ends[off]


def unvarints(data: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    ends = np.flatnonzero(data < 128)
    at = np.searchsorted(ends, off)
    if len(data) and (data[off[1:][off[1:] > off[:-1]] - 1] > 127).any():
        raise ValueError("a varint is cut off")
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    n = ends - starts + 1
    if len(n) and n.max() > 10:
        raise ValueError("a varint is too long")
    k = np.arange(len(data)) - np.repeat(starts, n)
    part = (data & 127).astype(np.uint64) << (7 * k).astype(np.uint64)
    return (np.bitwise_or.reduceat(part, starts) if len(starts) else part).view(np.int64), at


#: Transforms of (numbers, offsets) to what is written as varints, and back.
VARINT: dict[str, tuple[Callable, Callable]] = {
    "raw": (lambda v, o: (v, o), lambda v, o: (v, o)),
    "zigzag-delta": (lambda v, o: (zigzag(deltas(v, o)), o), lambda v, o: (sums(unzigzag(v), o), o)),
    "delta-of-delta": (lambda v, o: (zigzag(deltas(deltas(v, o), o)), o), lambda v, o: (sums(sums(unzigzag(v), o), o), o)),
    "xor-delta": (lambda v, o: (v ^ before(v, o), o), lambda v, o: (xor_sums(v, o), o)),
    "rle": (runs, unruns),
}
VARINT |= {"2d-delta": VARINT["zigzag-delta"], "hybrid-rle": VARINT["raw"]}


# Bits and bytes in their places.


def ends_of(sizes: np.ndarray) -> Offsets:
    return np.append(0, np.cumsum(sizes)).astype(np.int64)


def per_record(reduce: np.ufunc, v: np.ndarray, off: Offsets) -> np.ndarray:
    """`reduce` over each record; 0 for empty ones."""
    out = np.zeros(len(off) - 1, v.dtype)
    full = off[:-1] < off[1:]
    if len(v):
        out[full] = reduce.reduceat(v, off[:-1][full])
    return out


def places(off: Offsets) -> np.ndarray:
    """The place of each value in its record."""
    return np.arange(off[-1]) - np.repeat(off[:-1], np.diff(off))


def bit_lengths(v: np.ndarray) -> np.ndarray:
    u, n = v.astype(np.uint64), np.zeros(len(v), np.int64)
    for k in (32, 16, 8, 4, 2, 1):
        wide = u >> np.uint64(k) > 0
        n += k * wide
        u = np.where(wide, u >> np.uint64(k), u)
    return n + (u > 0)


def put_bytes(out: np.ndarray, at: np.ndarray, v: np.ndarray, width: np.ndarray) -> None:
    """Numbers of `width` bytes, the lowest first."""
    for k in range(int(width.max(initial=0))):
        some = np.flatnonzero(width > k)
        out[at[some] + k] = (v[some] >> (8 * k)) & 255


def put_varints(out: np.ndarray, at: np.ndarray, v: np.ndarray, size: np.ndarray) -> None:
    u = v.view(np.uint64)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[at[some] + k] = ((u[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)


def put_bits(out: np.ndarray, at: np.ndarray, v: np.ndarray, width: np.ndarray) -> None:
    """Numbers of `width` bits, the highest first, at bit `at`; the bits there are 0 before."""
    need(width.max(initial=0) <= WIDEST)
    some = np.flatnonzero(width)
    at, width = at[some], width[some].astype(np.uint64)
    word = v[some].astype(np.uint64) << (np.uint64(64) - width - (at % 8).astype(np.uint64))
    reach = (at % 8 + width.astype(np.int64) + 7) // 8
    for k in range(int(reach.max(initial=0))):
        now = np.flatnonzero(reach > k)
        np.add.at(out, at[now] // 8 + k, (word[now] >> np.uint64(56 - 8 * k)).astype(np.uint8))


def windows(data: np.ndarray, order: str) -> np.ndarray:
    """The 64-bit number that begins at each byte; bytes beyond the end are 0."""
    padded = np.append(data, np.zeros(9, np.uint8))
    return np.ndarray(len(data) + 2, f"{order}u8", padded, strides=(1,))


def get_bits(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    need(width.max(initial=0) <= WIDEST)
    word = windows(data, ">")[at // 8].astype(np.uint64) << (at % 8).astype(np.uint64)
    return np.where(width > 0, word >> (64 - np.maximum(width, 1)).astype(np.uint64), 0).astype(np.int64)


def get_bytes(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    word = windows(data, "<")[at].astype(np.uint64)
    return (word & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * width).astype(np.uint64))).astype(np.int64)


def get_varints(data: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The varint at each place, and the place after it, which isn't beyond `limit`."""
    out, more, at = np.zeros(len(at), np.uint64), np.arange(len(at)), at.copy()
    for k in range(10):
        need((at[more] < limit[more]).all())
        b = data[at[more]]
        need(k < 9 or (b < 2).all())
        out[more] |= (b & 127).astype(np.uint64) << np.uint64(7 * k)
        at[more] += 1
        more = more[b > 127]
    need(not len(more))
    return out.view(np.int64), at


def get_rows(data: np.ndarray, at: np.ndarray, count: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`count` varints on end from each place, flat, and the places after them."""
    last = np.flatnonzero(data < 128)
    first = np.searchsorted(last, at)
    need((first + count <= len(last)).all())
    after = np.where(count > 0, np.append(last, 0)[np.maximum(first + count - 1, 0)] + 1, at)
    need((after <= limit).all())
    off = ends_of(count)
    which = np.repeat(first, count) + places(off)
    begin = np.append(0, last + 1)[which]
    head = off[:-1][count > 0]
    begin[head] = at[count > 0]
    return get_varints(data, begin, last[which] + 1)[0], after


def unary(bits: int, at: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Bytes in which `ones` bits from bit `at` are set; ranges don't touch."""
    mark = np.zeros(bits + 1, np.int8)
    some = ones > 0
    mark[at[some]] = 1
    mark[at[some] + ones[some]] = -1
    return np.packbits(np.cumsum(mark[:-1], dtype=np.int8).view(np.uint8))


def full_records(data: np.ndarray, off: Offsets, n: np.ndarray, head: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which records have values; their starts, ends and lengths. Each has `head` bytes at least."""
    full = np.flatnonzero(n > 0)
    at, end = off[:-1][full], off[1:][full]
    need((end - at >= head).all())
    return full, at, end, n[full]


# The codecs that pack bits.


def bit_packed(v: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    n = np.diff(off)
    width = np.maximum(1, bit_lengths(per_record(np.maximum, v, off)))
    to = ends_of(np.where(n > 0, 1 + (n * width + 7) // 8, 0))
    out, full = np.zeros(to[-1], np.uint8), n > 0
    w = np.repeat(width, n)
    put_bits(out, np.repeat(8 * to[:-1] + 8, n) + places(off) * w, v, w)
    out[to[:-1][full]] = width[full]
    return out, to


def unbit_packed(data: np.ndarray, off: Offsets, n: np.ndarray) -> np.ndarray:
    _, at, end, n = full_records(data, off, n)
    width = data[at].astype(np.int64)
    need((width > 0).all() and (at + 1 + (n * width + 7) // 8 <= end).all())
    w = np.repeat(width, n)
    return get_bits(data, np.repeat(8 * at + 8, n) + places(ends_of(n)) * w, w)


def byte_width(bits: np.ndarray) -> np.ndarray:
    return np.select([bits <= 8, bits <= 16, bits <= 32], [1, 2, 4], 8)


def frame(v: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    n, low = np.diff(off), per_record(np.minimum, v, off)
    bits = bit_lengths(per_record(np.maximum, v, off) - low)
    width, lead, full = byte_width(bits), varint_sizes(low), n > 0
    to = ends_of(np.where(full, lead + 1 + n * width, 0))
    out, w = np.zeros(to[-1], np.uint8), np.repeat(width, n)
    put_varints(out, to[:-1][full], low[full], lead[full])
    out[(to[:-1] + lead)[full]] = bits[full]
    put_bytes(out, np.repeat(to[:-1] + lead + 1, n) + places(off) * w, v - np.repeat(low, n), w)
    return out, to


def unframe(data: np.ndarray, off: Offsets, n: np.ndarray) -> np.ndarray:
    _, at, end, n = full_records(data, off, n)
    low, at = get_varints(data, at, end)
    need((at < end).all() and (data[at] <= 64).all())
    width = byte_width(data[at])
    need((at + 1 + n * width <= end).all())
    w = np.repeat(width, n)
    rest = get_bytes(data, np.repeat(at + 1, n) + places(ends_of(n)) * w, w)
    need((low >= 0).all() and (rest >= 0).all())
    return np.repeat(low, n) + rest


def dictionary(v: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    n, size = np.diff(off), varint_sizes(v)
    record = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((v, record))  # keeps equal values in their order
    new = np.ones(len(v), bool)
    new[1:] = (v[order][1:] != v[order][:-1]) | (record[order][1:] != record[order][:-1])
    seen = np.empty(len(v), np.int64)  # where a value's equal was first seen
    seen[order] = order[new][np.cumsum(new) - 1]
    first = np.zeros(len(v), bool)
    first[order[new]] = True
    rank = ends_of(first)
    count, known = rank[off[1:]] - rank[off[:-1]], ends_of(size * first)
    listed = known[off[1:]] - known[off[:-1]]
    short, full, all_size = count <= DICTIONARY_MOST, n > 0, ends_of(size)
    to = ends_of(np.where(full, np.where(short, 2 + listed + n, 1 + all_size[off[1:]] - all_size[off[:-1]]), 0))
    out, coded = np.zeros(to[-1], np.uint8), np.repeat(short, n)
    out[to[:-1][full]] = short[full]
    out[to[:-1][full & short] + 1] = count[full & short] % 256
    base = np.where(coded, np.repeat(to[:-1] + 2 - known[off[:-1]], n) + known[:-1], np.repeat(to[:-1] + 1 - all_size[off[:-1]], n) + all_size[:-1])
    written = first | ~coded
    put_varints(out, base[written], v[written], size[written])
    out[(np.repeat(to[:-1] + 2 + listed, n) + places(off))[coded]] = (rank[seen] - np.repeat(rank[off[:-1]], n))[coded]
    return out, to


def undictionary(data: np.ndarray, off: Offsets, n: np.ndarray) -> np.ndarray:
    _, at, end, n = full_records(data, off, n)
    coded = data[at] > 0
    need((at[coded] + 1 < end[coded]).all())
    named = np.append(data, 0)[at + 1].astype(np.int64)
    count = np.where(coded, np.where(named == 0, DICTIONARY_MOST, named), n)
    known, after = get_rows(data, at + 1 + coded, count, end)
    need((after[coded] + n[coded] == end[coded]).all())
    place = places(ends_of(n))
    code = np.where(np.repeat(coded, n), np.append(data, 0)[np.where(np.repeat(coded, n), np.repeat(after, n) + place, 0)], place)
    need((code < np.repeat(count, n)).all())
    return known[np.repeat(ends_of(count)[:-1], n) + code]


def cascaded(v: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    """Differences only: streams of few distinct values aren't taken."""
    n, z, first = np.diff(off), zigzag(deltas(v, off)), heads(off)
    order = np.lexsort((v, np.repeat(np.arange(len(n)), n)))
    new = np.ones(len(v), np.int64)
    new[1:] = v[order][1:] != v[order][:-1]
    new[first] = 1
    count = per_record(np.add, new, off)
    need(((n == 0) | (count / np.maximum(n, 1) >= CASCADE_SHARE) | (count > DICTIONARY_MOST)).all())
    z[first] = v[first]
    size = varint_sizes(z)
    within = ends_of(size)
    to = ends_of(np.where(n > 0, 1 + within[off[1:]] - within[off[:-1]], 0))
    out = np.zeros(to[-1], np.uint8)
    out[to[:-1][n > 0]] = 2
    put_varints(out, np.repeat(to[:-1] + 1 - within[off[:-1]], n) + within[:-1], z, size)
    return out, to


def uncascaded(data: np.ndarray, off: Offsets, n: np.ndarray) -> np.ndarray:
    _, at, end, n = full_records(data, off, n)
    need((data[at] == 2).all())
    z, to = get_rows(data, at + 1, n, end)[0], ends_of(n)
    need((z[to[:-1]] >= 0).all())
    z[to[:-1]] *= 2
    return sums(unzigzag(z), to)


def stream_vbyte(v: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    need(not (v >> 32).any())
    n, place = np.diff(off), places(off)
    size = np.maximum(1, (bit_lengths(v) + 7) // 8)
    control, body, full = (n + 3) // 4, ends_of(size), n > 0
    lead = varint_sizes(control)
    to = ends_of(np.where(full, lead + control + body[off[1:]] - body[off[:-1]], 0))
    out = np.zeros(to[-1], np.uint8)
    put_varints(out, to[:-1][full], control[full], lead[full])
    np.add.at(out, np.repeat(to[:-1] + lead, n) + place // 4, (size - 1 << 2 * (place % 4)).astype(np.uint8))
    put_bytes(out, np.repeat(to[:-1] + lead + control - body[off[:-1]], n) + body[:-1], v, size)
    return out, to


def unstream_vbyte(data: np.ndarray, off: Offsets, n: np.ndarray) -> np.ndarray:
    _, at, end, n = full_records(data, off, n)
    control, at = get_varints(data, at, end)
    need((control >= (n + 3) // 4).all() and (control <= end - at).all())
    to = ends_of(n)
    place = places(to)
    size = (data[np.repeat(at, n) + place // 4] >> 2 * (place % 4) & 3).astype(np.int64) + 1
    body = ends_of(size)
    need((at + control + body[to[1:]] - body[to[:-1]] <= end).all())
    return get_bytes(data, np.repeat(at + control - body[to[:-1]], n) + body[:-1], size)


def selective_runs(v: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    pairs, at = runs(v, off)
    value, length = pairs[0::2], pairs[1::2]
    need(length.max(initial=0) <= RUN_MOST)
    many = length >= RUN_LEAST
    each = np.where(many, 1, length)
    item, long = np.repeat(value, each), np.repeat(many, each)
    size, tail = varint_sizes(item), np.repeat(varint_sizes(length), each)
    to = ends_of(1 + size + np.where(long, tail, 0))
    out = np.zeros(to[-1], np.uint8)
    out[to[:-1]] = ~long
    put_varints(out, to[:-1] + 1, item, size)
    put_varints(out, (to[:-1] + 1 + size)[long], np.repeat(length, each)[long], tail[long])
    return out, to[ends_of(each)[at // 2]]


def unselective_runs(data: np.ndarray, off: Offsets, n: np.ndarray) -> np.ndarray:
    full, at, end, n = full_records(data, off, n)
    last = np.flatnonzero(data < 128)
    need((data[end - 1] < 128).all())
    after, before_it = memoryview(np.append(last + 1, len(data) + 1)), memoryview(ends_of(data < 128))
    begin, count, flags = [], [], memoryview(data)
    for a, b in zip(at.tolist(), end.tolist(), strict=True):
        had = len(begin)
        while a < b - 1:
            begin.append(a)
            k = before_it[a + 1]
            a = after[k] if flags[a] else after[min(k + 1, len(last))]
        need(a == b)
        count.append(len(begin) - had)
    begin = np.array(begin, np.int64)
    limit, run = np.repeat(end, count), np.ones(len(begin), np.int64)
    value, then = get_varints(data, begin + 1, limit)
    many = data[begin] == 0
    run[many] = get_varints(data, then[many], limit[many])[0]
    need((run > 0).all() and (run <= np.repeat(n, count)).all())
    need((per_record(np.add, run, ends_of(count)) == n).all())
    return np.repeat(value, run)


def rice(v: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    need(v.max(initial=0) < 1 << 31)
    n, z = np.diff(off), zigzag(deltas(v, off))
    costs = np.stack([per_record(np.add, z >> k, off) + n * (1 + k) for k in range(RICE_MOST + 1)])
    k, cost = costs.argmin(0), costs.min(0)
    need(cost.max(initial=0) < 1 << 31)
    to = ends_of(np.where(n > 0, 1 + (cost + 7) // 8, 0))
    low = np.repeat(k, n)
    ones = z >> low
    within = ends_of(ones + 1 + low)
    at = np.repeat(8 * to[:-1] + 8 - within[off[:-1]], n) + within[:-1]
    out = unary(8 * int(to[-1]), at, ones)
    put_bits(out, at + ones + 1, z & ((1 << low) - 1), low)
    out[to[:-1][n > 0]] = k[n > 0]
    return out, to


def unrice(data: np.ndarray, off: Offsets, n: np.ndarray) -> np.ndarray:
    _, at, end, n = full_records(data, off, n)
    k = data[at].astype(np.int64)
    need((k <= RICE_MOST).all())
    bits = np.unpackbits(data)
    clear = bits == 0
    # beyond the end, the next 0 is at the end, and the place after that is still in the table
    zeros = memoryview(np.append(np.flatnonzero(clear), len(bits)))
    seen = memoryview(np.pad(np.cumsum(clear) - clear, (0, RICE_MOST + 2), constant_values=len(zeros) - 1))
    stop, to = [], ends_of(n)
    for a, m, step, b in zip((8 * at + 8).tolist(), n.tolist(), (k + 1).tolist(), (8 * end).tolist(), strict=True):
        for _ in range(m):
            zero = zeros[seen[a]]
            stop.append(zero)
            a = zero + step
        need(a <= b)
    stop, low = np.array(stop, np.int64), np.repeat(k, n)
    begin = np.empty(len(stop), np.int64)
    begin[1:] = stop[:-1] + 1 + low[:-1]
    begin[to[:-1]] = 8 * at + 8
    return sums(unzigzag((stop - begin << low) | get_bits(data, stop + 1, low)), to)


def elias_fano(v: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    n = np.diff(off)
    need(int(v.max(initial=0)) * max(1, len(v)) < 1 << 62)
    total = sums(v, off)
    whole = per_record(np.add, v, off)
    low = np.maximum(0, bit_lengths((whole + 1) // np.maximum(n, 1)) - 1)
    w, place = np.repeat(low, n), places(off)
    high = total >> w
    need((whole >> low).max(initial=0) < 1 << 31)
    to = ends_of(np.where(n > 0, 1 + (n * low + (whole >> low) + n + 7) // 8, 0))
    base = np.repeat(8 * to[:-1] + 8, n)
    step = deltas(high, off)
    out = unary(8 * int(to[-1]), base + np.repeat(n * low, n) + high - step + place, step)
    put_bits(out, base + place * w, total & ((1 << w) - 1), w)
    out[to[:-1][n > 0]] = low[n > 0]
    return out, to


def unelias_fano(data: np.ndarray, off: Offsets, n: np.ndarray) -> np.ndarray:
    _, at, end, n = full_records(data, off, n)
    low, to = data[at].astype(np.int64), ends_of(n)
    need((low <= WIDEST).all())
    base = 8 * at + 8 + n * low
    need((base <= 8 * end).all())
    zeros = np.flatnonzero(np.unpackbits(data) == 0)
    first, place, w = np.searchsorted(zeros, base), places(to), np.repeat(low, n)
    need((first + n <= len(zeros)).all())
    zero = zeros[np.repeat(first, n) + place]
    need((zero < np.repeat(8 * end, n)).all())
    high = zero - np.repeat(base, n) - place
    need((high >> np.maximum(0, 62 - w) == 0).all())
    total = (high << w) | get_bits(data, np.repeat(8 * at + 8, n) + place * w, w)
    return deltas(total, to)


def words(v: np.ndarray, off: Offsets) -> tuple[np.ndarray, Offsets]:
    need(not (v >> 60).any())
    n, width, here = np.diff(off), bit_lengths(v), np.arange(len(v))
    end = np.repeat(off[1:], n)
    mode = np.full(len(v), len(WORD_MODES) - 1)
    for selector, (count, bits) in reversed(list(enumerate(WORD_MODES))):
        wide = np.where(width > bits, here, len(v))
        next_wide = np.minimum.accumulate(wide[::-1])[::-1]
        mode[next_wide >= np.minimum(here + count, end)] = selector
    take = memoryview(np.minimum(np.array([c for c, _ in WORD_MODES])[mode], end - here))
    begin, to = [], [0]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        while a < b:
            begin.append(a)
            a += take[a]
        to.append(8 * len(begin))
    begin = np.array(begin, np.int64)
    if not len(begin):
        return np.zeros(0, np.uint8), np.array(to, np.int64)
    held = np.diff(np.append(begin, len(v)))
    shift = np.array([b for _, b in WORD_MODES])[np.repeat(mode[begin], held)] * (here - np.repeat(begin, held))
    word = np.bitwise_or.reduceat(v.astype(np.uint64) << shift.astype(np.uint64), begin) | mode[begin].astype(np.uint64) << np.uint64(60)
    return word.astype("<u8").view(np.uint8), np.array(to, np.int64)


def unwords(data: np.ndarray, off: Offsets, n: np.ndarray) -> np.ndarray:
    _, at, end, n = full_records(data, off, n, 8)
    number = (end - at) // 8
    first = ends_of(number)
    word = windows(data, "<")[np.repeat(at, number) + 8 * places(first)].astype(np.uint64)
    mode = np.minimum((word >> np.uint64(60)).astype(np.int64), len(WORD_MODES) - 1)
    count, bits = (np.array(c)[mode] for c in zip(*WORD_MODES, strict=True))
    room = ends_of(count)
    need((room[first[1:]] - room[first[:-1]] >= n).all())
    held = np.clip(np.repeat(n + room[first[:-1]], number) - room[:-1], 0, count)
    width = np.repeat(bits, held)
    return (np.repeat(word, held) >> (width * places(ends_of(held))).astype(np.uint64) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


PACKED: dict[str, tuple[Callable, Callable]] = {
    "bit-packed": (bit_packed, unbit_packed), "frame-of-reference": (frame, unframe), "dictionary": (dictionary, undictionary), "stream-vbyte": (stream_vbyte, unstream_vbyte),
    "selective-rle": (selective_runs, unselective_runs), "rice": (rice, unrice), "elias-fano": (elias_fano, unelias_fano), "simple8b-full": (words, unwords),
    "cascaded": (cascaded, uncascaded),
}


# Slices of a batch.


def slices(off: Offsets, most: int) -> list[tuple[int, int]]:
    """Ranges of records with `most` values or bytes, or one record each."""
    out, a = [], 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def encode(name: str, v: np.ndarray, off: Offsets, most: int = 1 << 18) -> tuple[np.ndarray, Offsets]:
    """Bytes of all records and their offsets."""
    parts, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for a, b in slices(off, most):
        part, at = v[off[a] : off[b]], off[a : b + 1] - off[a]
        data, to = PACKED[name][0](part, at) if name in PACKED else varints(*VARINT[name][0](part, at))
        parts.append(data)
        sizes.append(np.diff(to))
    return np.concatenate(parts), ends_of(np.concatenate(sizes))


def decode(name: str, data: np.ndarray, off: Offsets, n: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The `n` values of each record."""
    parts = [np.zeros(0, np.int64)]
    for a, b in slices(off, most):
        part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        if name in PACKED:
            v = PACKED[name][1](part, at, n[a:b])
            need(v.min(initial=0) >= 0)
            parts.append(v)
        else:
            v, to = VARINT[name][1](*unvarints(part, at))
            need((np.diff(to) == n[a:b]).all())
            parts.append(v)
    return np.concatenate(parts)
