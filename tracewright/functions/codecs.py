"""Byte encoders and decoders of integer streams, over Arrow batches.

Columns go through `batches`, a whole batch at once, wherever it has the codec and takes the batch. Here is every codec that packs bits or
carries state from value to value, record by record (`PACKED`): what defines the bytes, and what takes the rest: fastpfor, huffman, lz77,
cascaded streams of few values, bytes that are cut off and numbers that are too wide. Bits are written from the highest to the lowest of a byte, the last byte filled with 0.

Values are 0 to 2^63 - 1. Empty streams are empty bytes. A stream that a codec can't hold (stream-vbyte from 2^32,
simple8b-full from 2^60, huffman codes over 63 bits, rice over 2^31 bits) is null as a column and a ValueError here;
so are bytes that don't decode to the number of values given.
"""

from __future__ import annotations

import heapq
import struct
import threading
import zlib
from collections import Counter
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from . import batches
from .batches import CASCADE_SHARE, DICTIONARY_MOST, RICE_MOST, RUN_LEAST, RUN_MOST, VARINT, WORD_MODES, Offsets, ends_of, need, unvarints, unzigzag, varint_sizes, varints, zigzag

#: Fixed values of the formats.
BLOCK, WINDOW, MATCH_LEAST = 128, 256, 3
BGZF_HEAD, BGZF_MOST = bytes.fromhex("1f8b08040000000000ff060042430200"), 65280
#: Streams of fewer numbers aren't worth an array.
SHORT, ONE_BYTE = 64, [bytes([k]) for k in range(128)]
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


# Record by record.


class Reader:
    """Numbers from bytes, in order."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bytes(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("bytes are cut off")
        self.at += n
        return out

    def number(self, n: int) -> int:
        return int.from_bytes(self.bytes(n), "little")

    def varint(self) -> int:
        out = shift = 0
        for b in self.data[self.at : self.at + 10]:
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                self.at += shift // 7
                return out
        raise ValueError("bytes are cut off" if shift < 70 else "a varint is too long")

    def bits(self) -> str:
        rest = self.data[self.at :]
        self.at = len(self.data)
        return bin(int.from_bytes(b"\1" + rest, "big"))[3:]

    def done(self) -> bool:
        return self.at == len(self.data)


def varint(v: int) -> bytes:
    if 0 <= v < 128:
        return ONE_BYTE[v]
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def pack(bits: str) -> bytes:
    n = -len(bits) % 8
    return int(bits + "0" * n, 2).to_bytes((len(bits) + n) // 8, "big") if bits else b""


def binary(v: int, width: int) -> str:
    return format(v, f"0{width}b") if width else ""


def steps(x: list[int]) -> list[int]:
    """Differences as zigzag numbers; the first value counts as a difference to 0."""
    return [2 * d if d >= 0 else -2 * d - 1 for d in (b - a for a, b in zip([0, *x], x))]  # noqa: B905


def unsteps(z: list[int]) -> list[int]:
    out, at = [], 0
    for v in z:
        at += v >> 1 if v % 2 == 0 else -(v + 1 >> 1)
        out.append(at)
    return out


def bit_packed(x: list[int]) -> bytes:
    w = max(1, max(x).bit_length())
    return bytes([w]) + pack("".join(binary(v, w) for v in x))


def unbit_packed(r: Reader, n: int) -> list[int]:
    w = r.number(1)
    s = r.bits()
    return [int(s[k * w : k * w + w], 2) for k in range(n)]


def offset_width(bits: int) -> int:
    if bits > 64:
        raise ValueError("bad width")
    return next(w for w in (1, 2, 4, 8) if bits <= 8 * w)


def frame(x: list[int]) -> bytes:
    low = min(x)
    bits = (max(x) - low).bit_length()
    w = offset_width(bits)
    return varint(low) + bytes([bits]) + b"".join((v - low).to_bytes(w, "little") for v in x)


def unframe(r: Reader, n: int) -> list[int]:
    low, w = r.varint(), offset_width(r.number(1))
    return [low + r.number(w) for _ in range(n)]


def dictionary(x: list[int]) -> bytes:
    at = {v: k for k, v in enumerate(dict.fromkeys(x))}
    if len(at) > DICTIONARY_MOST:
        return b"\0" + b"".join(map(varint, x))
    return bytes([1, len(at) % 256]) + b"".join(map(varint, at)) + bytes(at[v] for v in x)


def undictionary(r: Reader, n: int) -> list[int]:
    if not r.number(1):
        return [r.varint() for _ in range(n)]
    known = [r.varint() for _ in range(r.number(1) or 256)]
    return [known[k] for k in r.bytes(n)]


def stream_vbyte(x: list[int]) -> bytes:
    if max(x) >> 32:
        raise ValueError("stream-vbyte holds numbers below 2^32")
    size = [max(1, (v.bit_length() + 7) // 8) for v in x]
    control = bytes(sum(s - 1 << 2 * j for j, s in enumerate(size[k : k + 4])) for k in range(0, len(x), 4))
    return varint(len(control)) + control + b"".join(v.to_bytes(s, "little") for v, s in zip(x, size, strict=True))


def unstream_vbyte(r: Reader, n: int) -> list[int]:
    control = r.bytes(r.varint())
    return [r.number((control[k // 4] >> 2 * (k % 4) & 3) + 1) for k in range(n)]


def fastpfor(x: list[int]) -> bytes:
    """Blocks of 128 as offsets to their least value, most of which fit a width; the rest come as exceptions."""
    out = []
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        low = min(part)
        rest = [v - low for v in part]
        common = sorted(rest)[int(len(rest) * 0.95)]
        bits = min(max(1, common.bit_length()), 32)
        top = (1 << bits) - 1
        plain = varint if bits > 16 else partial(int.to_bytes, length=1 if bits <= 8 else 2, byteorder="little")
        over = [struct.pack("<H", k) + varint(v - top - 1) for k, v in enumerate(rest) if v > top]
        out += [varint(len(part)), varint(low), bytes([bits]), varint(len(over)), *(plain(min(v, top)) for v in rest), *over]
    return b"".join(out)


def unfastpfor(r: Reader, n: int) -> list[int]:
    out: list[int] = []
    while len(out) < n:
        size, low, bits, over = r.varint(), r.varint(), r.number(1), r.varint()
        part = [low + (r.varint() if bits > 16 else r.number(1 if bits <= 8 else 2)) for _ in range(size)]
        for _ in range(over):
            k = r.number(2)
            part[k] += r.varint() + 1
        if not part:
            raise ValueError("a block is empty")
        out += part
    return out


def cascaded(x: list[int]) -> bytes:
    """Few distinct values: by frequency, then value, as runs of codes; else differences."""
    count = Counter(x)
    if len(count) / len(x) >= CASCADE_SHARE or len(count) > DICTIONARY_MOST:
        return b"\2" + varint(x[0]) + b"".join(map(varint, steps(x)[1:]))
    code = {v: k for k, v in enumerate(sorted(count, key=lambda v: (-count[v], v)))}
    out = [b"\1", varint(len(code)), *map(varint, code)]
    at = 0
    while at < len(x):
        end = at
        while end < len(x) and x[end] == x[at] and end - at < 255:
            end += 1
        out.append(bytes([code[x[at]], end - at]))
        at = end
    return b"".join(out)


def uncascaded(r: Reader, n: int) -> list[int]:
    if r.number(1) == 2:
        first = r.varint()
        return unsteps([2 * first, *(r.varint() for _ in range(n - 1))])
    known, out = [r.varint() for _ in range(r.varint())], []
    while not r.done():
        code, run = r.bytes(2)
        out += [known[code]] * run
    return out


def words(x: list[int]) -> bytes:
    """As many values as fit a word of 60 bits and a selector of four."""
    if max(x) >> 60:
        raise ValueError("simple8b-full holds numbers below 2^60")
    out, at = [], 0
    while at < len(x):
        for selector, (count, bits) in enumerate(WORD_MODES):
            part = x[at : at + count]
            if not max(part) >> bits:
                break
        word = selector << 60
        for j, v in enumerate(part):
            word |= v << j * bits
        out.append(word)
        at += len(part)
    return struct.pack(f"<{len(out)}Q", *out)


def unwords(r: Reader, n: int) -> list[int]:
    out: list[int] = []
    while len(out) < n:
        word = r.number(8)
        count, bits = WORD_MODES[word >> 60] if word >> 60 < len(WORD_MODES) else (1, 60)
        out += [word >> j * bits & (1 << bits) - 1 for j in range(min(count, n - len(out)))]
    return out


def selective_runs(x: list[int]) -> bytes:
    out, at = [], 0
    while at < len(x):
        end = at
        while end < len(x) and x[end] == x[at] and end - at < RUN_MOST:
            end += 1
        n, v = end - at, varint(x[at])
        out.append(b"\0" + v + varint(n) if n >= RUN_LEAST else n * (b"\1" + v))
        at = end
    return b"".join(out)


def unselective_runs(r: Reader, n: int) -> list[int]:
    out: list[int] = []
    while not r.done():
        single, v = r.number(1), r.varint()
        out += [v] * (1 if single else min(r.varint(), n + 1))
    return out


def rice(x: list[int]) -> bytes:
    z = steps(x)
    cost, k = min((sum(v >> k for v in z) + len(z) * (1 + k), k) for k in range(RICE_MOST + 1))
    if cost >> 31:
        raise ValueError("too many bits for rice")
    return bytes([k]) + pack("".join("1" * (v >> k) + "0" + binary(v & (1 << k) - 1, k) for v in z))


def unrice(r: Reader, n: int) -> list[int]:
    k, s, at, z = r.number(1), r.bits(), 0, []
    for _ in range(n):
        zero = s.index("0", at)
        rest = s[zero + 1 : zero + 1 + k]
        if len(rest) < k:
            raise ValueError("bits are cut off")
        z.append(zero - at << k | (int(rest, 2) if k else 0))
        at = zero + 1 + k
    return unsteps(z)


def code_lengths(count: dict[int, int]) -> list[tuple[int, int]]:
    """(length, symbol) in canonical order; ties go to the smaller symbol."""
    if len(count) == 1:
        return [(1, next(iter(count)))]
    heap = [(c, k, [s]) for k, (s, c) in enumerate(sorted(count.items()))]
    depth, k = dict.fromkeys(count, 0), len(heap)
    heapq.heapify(heap)
    while len(heap) > 1:
        (c, _, s), (d, _, t) = heapq.heappop(heap), heapq.heappop(heap)
        for v in (both := s + t):
            depth[v] += 1
        heapq.heappush(heap, (c + d, k, both))
        k += 1
    return sorted((n, s) for s, n in depth.items())


def canonical(lengths: list[tuple[int, int]]) -> dict[str, int]:
    """Code to symbol: codes of one length count up, and a longer one goes on from the next."""
    out, code, had = {}, 0, lengths[0][0]
    for n, symbol in lengths:
        code <<= n - had
        out[binary(code, n)], had = symbol, n
        code += 1
    return out


def huffman(x: list[int]) -> bytes:
    z = steps(x)
    lengths = code_lengths(Counter(z))
    if lengths[-1][0] > 63:
        raise ValueError("a code is longer than 63 bits")
    code = {s: c for c, s in canonical(lengths).items()}
    return varint(len(lengths)) + b"".join(varint(s) + bytes([n]) for n, s in lengths) + pack("".join(code[v] for v in z))


def unhuffman(r: Reader, n: int) -> list[int]:
    lengths = []
    for _ in range(r.varint()):
        s = r.varint()
        lengths.append((r.number(1), s))
    known, sizes, s, at, z = canonical(lengths), sorted({m for m, _ in lengths}), r.bits(), 0, []
    for _ in range(n):
        m = next((m for m in sizes if s[at : at + m] in known), 0)
        if not m:
            raise ValueError("unknown code")
        z.append(known[s[at : at + m]])
        at += m
    return unsteps(z)


def lz77(x: list[int]) -> bytes:
    """The longest match of three values or more that begins in the 256 values before; of equal ones the nearest."""
    out, at, seen = [], 0, {}

    def learn(k: int) -> None:
        seen.setdefault(tuple(x[k : k + MATCH_LEAST]), []).append(k)

    while at < len(x):
        best, back = 0, 0
        for k in reversed(seen.get(tuple(x[at : at + MATCH_LEAST]), ())):
            if at - k > WINDOW:
                break
            n = MATCH_LEAST
            while at + n < len(x) and x[k + n] == x[at + n]:
                n += 1
            if n > best:
                best, back = n, at - k
                if at + n == len(x):
                    break
        out.append(b"\1" + varint(back) + varint(best) if best else b"\0" + varint(x[at]))
        for k in range(at, min(at + max(1, best), len(x) - MATCH_LEAST + 1)):
            learn(k)
        at += max(1, best)
    return b"".join(out)


def unlz77(r: Reader, n: int) -> list[int]:
    out: list[int] = []
    while not r.done():
        if r.number(1):
            back, size = r.varint(), r.varint()
            if not 0 < back <= len(out) or len(out) + size > n:
                raise ValueError("bad match")
            for _ in range(size):
                out.append(out[-back])
        else:
            out.append(r.varint())
    return out


def elias_fano(x: list[int]) -> bytes:
    """The running sums: low bits as they are, steps of the high bits in unary."""
    total = [int(v) for v in np.cumsum(np.array(x, object))]
    low = max(0, ((total[-1] + 1) // len(x)).bit_length() - 1)
    high = [v >> low for v in total]
    if high[-1] >> 31:
        raise ValueError("too many bits for elias-fano")
    lows = "".join(binary(v & (1 << low) - 1, low) for v in total)
    return bytes([low]) + pack(lows + "".join("1" * (b - a) + "0" for a, b in zip([0, *high], high)))  # noqa: B905


def unelias_fano(r: Reader, n: int) -> list[int]:
    low, s = r.number(1), r.bits()
    at, high, had, out = n * low, 0, 0, []
    for k in range(n):
        zero = s.index("0", at)
        high, at = high + zero - at, zero + 1
        total = high << low | (int(s[k * low : k * low + low], 2) if low else 0)
        out.append(total - had)
        had = total
    return out


PACKED: dict[str, tuple[Callable[[list[int]], bytes], Callable[[Reader, int], list[int]]]] = {
    "bit-packed": (bit_packed, unbit_packed), "frame-of-reference": (frame, unframe), "dictionary": (dictionary, undictionary),
    "stream-vbyte": (stream_vbyte, unstream_vbyte), "fastpfor": (fastpfor, unfastpfor), "cascaded": (cascaded, uncascaded),
    "simple8b-full": (words, unwords), "selective-rle": (selective_runs, unselective_runs), "rice": (rice, unrice), "huffman": (huffman, unhuffman),
    "lz77": (lz77, unlz77), "elias-fano": (elias_fano, unelias_fano),
}


# Layers.


def bgzf(data: bytes, level: int = 6) -> bytes:
    """Gzip members of at most 64 KiB that name their size, and an empty one at the end."""
    out = []
    for at in range(0, len(data), BGZF_MOST):
        part = data[at : at + BGZF_MOST]
        for n in (level, 0):
            z = zlib.compressobj(n, zlib.DEFLATED, -15)
            body = z.compress(part) + z.flush()
            if len(body) + 26 <= 1 << 16:
                break
        out += [BGZF_HEAD, struct.pack("<H", len(body) + 25), body, struct.pack("<II", zlib.crc32(part), len(part))]
    return b"".join([*out, BGZF_END])


def is_block(data: bytes, at: int = 0) -> bool:
    return data[at : at + 4] == BGZF_HEAD[:4] and at + 18 <= len(data)


def block_size(data: bytes, at: int = 0) -> int:
    """Bytes of the block that begins there."""
    return struct.unpack("<H", data[at + 16 : at + 18])[0] + 1


def unbgzf(data: bytes, partial: bool = False) -> bytes:
    """The contents of the blocks; partial: up to the first bytes that are no whole block."""
    out, at = [], 0
    while at < len(data):
        size = block_size(data, at) if is_block(data, at) else 0
        if not size or at + size > len(data):
            if partial:
                break
            raise ValueError("a block is cut off")
        out.append(zlib.decompress(data[at : at + size], 31))
        at += size
    return b"".join(out)


_KEPT = threading.local()


def kept(kind: type, **options):
    """One of a thread's own, as making one takes longer than a short stream."""
    key = (kind.__name__, *options.values())
    if key not in _KEPT.__dict__:
        _KEPT.__dict__[key] = kind(**options)
    return _KEPT.__dict__[key]


def zstd(data: bytes, level: int) -> bytes:
    return kept(zstandard.ZstdCompressor, level=level).compress(data)


def unzstd(data: bytes) -> bytes:
    return kept(zstandard.ZstdDecompressor).decompressobj().decompress(data)


def layer(name: str, level: int = 3) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    """Compression and its inverse by the name of the layer."""
    if name == "zstd":
        return partial(zstd, level=level), unzstd
    if name == "bgzip":
        return partial(bgzf, level=min(level, 9)), unbgzf
    if name == "nocomp":
        return bytes, bytes
    raise ValueError(f"unknown layer: {name}")


# One stream, and columns of streams.


def encode(name: str, x: list[int]) -> bytes:
    if not x:
        return b""
    if name in PACKED:
        return PACKED[name][0](x)
    v, off = VARINT[name][0](np.array(x, np.int64), np.array([0, len(x)]))
    return b"".join(map(varint, v.view(np.uint64).tolist())) if len(v) < SHORT else varints(v, off)[0].tobytes()


def numbers(data: bytes) -> tuple[np.ndarray, Offsets]:
    """All varints in the bytes."""
    if len(data) >= SHORT:
        return unvarints(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    out = few_numbers(data)
    return np.array(out, np.int64), np.array([0, len(out)])


def few_numbers(data: bytes) -> list[int]:
    out, v, shift = [], 0, 0
    for b in data:
        v |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(v if v < 1 << 63 else (v + (1 << 63)) % (1 << 64) - (1 << 63))
            v = shift = 0
        elif shift == 70:
            raise ValueError("a varint is too long")
    if shift:
        raise ValueError("a varint is cut off")
    return out


def decode(name: str, data: bytes, n: int) -> list[int]:
    """The n values of a stream; ValueError if the bytes hold another number of them."""
    if name in PACKED:
        try:
            out = PACKED[name][1](Reader(data), n) if n else []
        except IndexError as e:
            raise ValueError(f"bad {name} bytes") from e
        if out and (max(out) >> 63 or min(out) < 0):
            raise ValueError(f"{name}: a value is out of range")
    elif name in ("raw", "hybrid-rle") and len(data) < SHORT:
        out = few_numbers(data)
    else:
        out = VARINT[name][1](*numbers(data))[0].tolist()
    if len(out) != n:
        raise ValueError(f"{name}: {len(out)} values, not {n}")
    return out


def encode_second(name: str, first: list[int], second: list[int]) -> bytes:
    """The second stream of a pair: 2d-delta writes differences to the first, hybrid-rle runs."""
    if name == "2d-delta":
        return b"".join(varint(2 * d if d >= 0 else -2 * d - 1) for d in (b - a for a, b in zip(first, second, strict=True)))
    return encode("rle" if name == "hybrid-rle" else name, second)


def decode_second(name: str, first: list[int], data: bytes, n: int) -> list[int]:
    if name == "2d-delta":
        return [a + int(d) for a, d in zip(first, unzigzag(np.array(decode("raw", data, n), np.int64)), strict=True)]
    return decode("rle" if name == "hybrid-rle" else name, data, n)


def tried(f: Callable, *args):
    try:
        return f(*args)
    except (ValueError, zlib.error, zstandard.ZstdError):
        return None


def lists(a: pa.Array) -> tuple[np.ndarray, Offsets]:
    """Flat values and offsets from 0; a null list, which has no values, looks empty."""
    off = np.append(0, np.cumsum(np.asarray(a.value_lengths().fill_null(0)))).astype(np.int64)
    return np.asarray(a.flatten(), np.int64), off


def binary_of(data: np.ndarray, off: Offsets) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)])


def pieces(a: pa.Array) -> tuple[np.ndarray, Offsets]:
    """All bytes of a BINARY column and their offsets from 0; a null looks empty."""
    off = ends_of(np.asarray(pc.binary_length(a).fill_null(0)))
    whole = b"".join(x for x in a.to_pylist() if x is not None)
    return np.frombuffer(whole, np.uint8), off


def whole(name: str) -> bool:
    return name in VARINT or name in batches.PACKED


def encode_all(name: str, a: pa.Array, first: pa.Array | None = None) -> pa.Array:
    """BINARY of ARRAY<BIGINT>; null for a null stream and one that the codec can't hold. With `first`, `a` is the second stream of pairs."""
    at_once = {"hybrid-rle": "rle"}.get(name, name) if first is not None else name
    if whole(at_once):
        try:
            v, off = lists(a)
            if first is not None and name == "2d-delta":
                u, was = lists(first)
                need(not first.null_count and not a.null_count and np.array_equal(off, was))
                at_once, v = "raw", zigzag(v - u)
            out = binary_of(*batches.encode(at_once, v, off))
            gone = pc.is_null(a) if first is None else pc.or_(pc.is_null(a), pc.is_null(first))
            return pc.if_else(gone, pa.scalar(None, pa.large_binary()), out) if pc.any(gone).as_py() else out
        except batches.Unfit:
            pass
    if first is None:
        return pa.array([None if x is None else tried(encode, name, x) for x in a.to_pylist()], pa.large_binary())
    pairs = zip(first.to_pylist(), a.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else tried(encode_second, name, x, y) for x, y in pairs], pa.large_binary())


def decode_all(name: str, data: pa.Array, n: pa.Array) -> pa.Array:
    """ARRAY<BIGINT> of the n values in each BINARY; null where the bytes don't hold them."""
    if whole(name) and not data.null_count and not n.null_count:
        try:
            count = np.asarray(n, np.int64)
            need(count.min(initial=0) >= 0)
            v = batches.decode(name, *pieces(data), count)
            return pa.LargeListArray.from_arrays(pa.array(ends_of(count)), pa.array(v))
        except ValueError:
            pass  # some record is bad; below it alone is null
    rows = zip(data.to_pylist(), n.to_pylist(), strict=True)
    return pa.array([None if x is None or m is None else tried(decode, name, x, m) for x, m in rows], pa.large_list(pa.int64()))


def encoded(stream: Column, name: str, layer_name: str = "nocomp", level: int = 3) -> Column:
    """BINARY of an ARRAY<BIGINT>; null for a null stream and one that the codec can't hold."""

    @arrow_udf("binary")
    def run(a: pa.Array) -> pa.Array:
        out = encode_all(name, a)
        if layer_name != "nocomp":
            squeeze = layer(layer_name, level)[0]
            out = pa.array([None if r is None else squeeze(r) for r in out.to_pylist()], pa.binary())
        return out.cast(pa.binary())

    return run(stream)


def decoded(data: Column, n: Column, name: str, layer_name: str = "nocomp") -> Column:
    """ARRAY<BIGINT> of the n values in a BINARY; null where the bytes don't hold them."""

    @arrow_udf("array<bigint>")
    def run(b: pa.Array, n: pa.Array) -> pa.Array:
        if layer_name != "nocomp":
            loose = layer(layer_name)[1]
            b = pa.array([None if x is None else tried(loose, x) for x in b.to_pylist()], pa.binary())
        return decode_all(name, b, n).cast(pa.list_(pa.int64()))

    return run(data, n)


def encoded_second(first: Column, second: Column, name: str) -> Column:
    """BINARY of the second stream of a pair; null if either is null or the codec can't hold it."""

    @arrow_udf("binary")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return encode_all(name, b, a).cast(pa.binary())

    return run(first, second)


def decoded_second(first: Column, data: Column, name: str) -> Column:
    @arrow_udf("array<bigint>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        if name != "2d-delta":
            return decode_all("rle" if name == "hybrid-rle" else name, b, a.value_lengths()).cast(pa.list_(pa.int64()))
        steps = decode_all("raw", b, a.value_lengths())
        known = pc.is_valid(steps)
        u, off = lists(pc.if_else(known, a, pa.scalar(None, a.type)))
        v = u + unzigzag(np.asarray(steps.flatten(), np.int64))
        out = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(v))
        return pc.if_else(known, out, pa.scalar(None, out.type)) if steps.null_count else out

    return run(first, data)
