"""Hashes of the words of many texts at once, in numpy: no Python object per word."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are taken at once: what finding words holds beside the texts, some 40 times this, follows it.
SLICE = 250_000
_RNG = np.random.default_rng(20240601)
#: A random odd number for each byte value and for each place in a word.
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
PLACE = _RNG.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, np.uint8)
SPACE[[9, 10, 11, 12, 13, 32]] = 1
#: 0 space, 1 letter or a byte beyond ASCII, 2 digit, 3 other.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[65:91] = KIND[97:123] = KIND[128:] = 1
KIND[48:58] = 2
WORD_KIND = 1 - SPACE


@functools.cache
def _trim() -> Callable:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def trim() -> None:
    """Gives back to the system what this worker has freed: Python workers are many, live on, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def trimmed(run: Callable) -> Callable:
    """`run` of a mapInArrow with `trim` after each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins; null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return all_bytes[off[0] : off[-1]], off - off[0]


def parts(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    at = 0
    while at < len(sizes):
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
        yield at, stop
        at = stop


def runs(data: np.ndarray, doc_off: np.ndarray, kind: np.ndarray = WORD_KIND) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of one kind, but kind 0, within a text: hash of the lower-cased run, its text's number, its first byte's
    place and its length. Long data go in slices cut where a run ends, so memory follows the slice."""
    out, n, at = [], len(data), 0
    edge = np.zeros(n + 1, bool)
    edge[doc_off] = True
    while at < n:
        stop = min(n, at + 2 * SLICE)
        while stop < n and not edge[stop] and kind[data[stop]] == kind[data[stop - 1]]:
            stop += 1
        out.append(_runs(data[at:stop], edge[at:stop], kind, at))
        at = stop
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h, start, length = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, np.searchsorted(doc_off, start, "right") - 1, start, length


def _runs(data: np.ndarray, edge: np.ndarray, kind: np.ndarray, at: int):
    k = kind[data]
    begins = edge.copy()
    begins[0] = True
    begins[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(data)))
    place = np.arange(len(data), dtype=np.int64) - np.repeat(start, length)
    weight = PLACE[np.minimum(place, len(PLACE) - 1)]
    far = np.flatnonzero(place >= len(PLACE))  # by the byte's own place, so a word's hash is the same beside any other run
    weight[far] = mix(place[far] + 77) | np.uint64(1)
    h = np.add.reduceat(BYTE[LOWER[data]] * weight, start) if len(start) else np.empty(0, np.uint64)
    real = k[start] > 0
    return mix(h[real]), start[real] + at, length[real]


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words within a text and their texts; a text with fewer words is one shingle."""
    n = len(h)
    first = np.searchsorted(doc, np.unique(doc))
    words_left = np.append(first[1:], n) - first
    short = words_left < k
    g = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        g += h[i : n - k + 1 + i] * PLACE[i + 1] if n >= k else g
    inside = doc[: n - k + 1] == doc[k - 1 :] if n >= k else np.empty(0, bool)
    whole, owner = mix(g[inside]), doc[: max(0, n - k + 1)][inside]
    if short.any():
        rows = np.repeat(np.flatnonzero(short), words_left[short])
        at = np.concatenate([np.arange(f, f + w) for f, w in zip(first[short], words_left[short], strict=True)])
        place = at - first[rows]
        begin = np.flatnonzero(place == 0)
        g = mix(np.add.reduceat(h[at] * PLACE[place + 101], begin) + words_left[short].astype(np.uint64))
        whole, owner = np.concatenate([whole, g]), np.concatenate([owner, doc[first[short]]])
        order = np.argsort(owner, kind="stable")
        whole, owner = whole[order], owner[order]
    return whole, owner


def squeeze(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as planes of bytes of their differences; the planes of high bytes are mostly zeros, which shuffles compress."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def widen(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)
