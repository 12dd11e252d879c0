"""Hierarchical multi-length packing (operator 6).

Each document is tokenized and ends with `END_ID`. Documents go to tiers by token count: tier t (256, 512, 1024, 2048)
holds documents of at most t tokens; longer ones are cut into whole windows of the longest tier, and what is left goes
to the tier it fits. The tiers are packed from the longest down, each with windows of its own length, best fit decreasing;
the gap of a window is filled from its own tier and the shorter ones, whole pieces that fit best first, then a piece cut to the
gap. What the last window lacks is laid out in windows of falling powers of two. So every sequence is exactly as long as
a power of two up to 2048, and nothing is padded.

Sequences of a flush are dealt to step groups of `STEP_TOKENS` tokens, longest first: as lengths are powers of two, every
group but the last of a flush holds the same number of tokens.

Packing runs within a task: documents stream through it, and it packs whenever `FLUSH_TOKENS` tokens wait, so
memory is bounded and no row moves between tasks. Sequence ids carry the number of the input split in the upper
bits; a split that is read again, after an executor is lost, gives the same rows.

Ids come from the vocabulary that `tokenizers` loads from `byte_bpe_50k.json`, and are computed by `tiktoken` from the rank file
of the same vocabulary, about five times as fast. The tests hold the two against each other.

Defined results: a null or empty text is one piece of the end id; equal ids and repeated rows are packed one by one; an empty table
gives an empty table; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .hashing import trimmed
from .shared import table

TIERS, END_ID, FLUSH_TOKENS, STEP_TOKENS = (256, 512, 1024, 2048), 1, 2_000_000, 65_536
LONG_BLANKS = 50_000
VOCABULARY, SPECIALS = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint"


@functools.cache
def encoder(path: str | None = None):
    """The byte-level BPE vocabulary; path: of another rank file."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIALS)


@functools.cache
def _blanks():
    import regex

    return regex.compile(rf"\p{{White_Space}}{{{LONG_BLANKS},}}")


def token_ids(text: str | None, path: str | None = None) -> np.ndarray:
    enc = encoder(path)
    try:
        ids = enc.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)
    except ValueError:  # the pattern's stack is too small for a very long run of white space
        ids = np.array(beyond_pattern(text, path), np.uint32)
    return np.append(ids.astype(np.uint32), np.uint32(END_ID))


def beyond_pattern(text: str, path: str | None = None) -> list[int]:
    """The ids of a text with runs of white space that the pattern can't match. Such a run is one pre-token, but for its last character if
    something follows; so it's encoded without the pattern, and what is around it by itself."""
    enc, (special, special_id), out = encoder(path), *SPECIALS.items(), []
    for k, part in enumerate(text.split(special)):
        out += [special_id] * (k > 0)
        at = 0
        for m in _blanks().finditer(part):
            end = m.end() - (m.end() < len(part))
            out += enc.encode_ordinary(part[at : m.start()])
            out += enc._encode_single_piece(part[m.start() : end].encode())
            at = end
        out += enc.encode_ordinary(part[at:])
    return out


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Tier:
    """The waiting pieces of one tier, by length."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = sorted(pieces, key=lambda p: len(p.ids))
        self.lengths = [len(p.ids) for p in self.pieces]

    def best(self, room: int) -> Piece | None:
        """Takes the longest piece that fits."""
        k = bisect_right(self.lengths, room) - 1
        return self.take(k) if k >= 0 else None

    def take(self, k: int = -1) -> Piece:
        self.lengths.pop(k)
        return self.pieces.pop(k)

    def put(self, p: Piece) -> None:
        k = bisect_left(self.lengths, len(p.ids))
        self.lengths.insert(k, len(p.ids))
        self.pieces.insert(k, p)


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences whose lengths are powers of two up to the longest tier, from pieces of any length."""
    longest, out, routed = tiers[-1], [], {t: [] for t in tiers}
    for p in pieces:
        while len(p.ids) > longest:
            head, p = p.cut(longest)
            out.append([head])
        routed[next(t for t in tiers if len(p.ids) <= t)].append(p)
    waiting = {t: Tier(v) for t, v in routed.items()}
    left: list[Piece] = []
    for k in range(len(tiers) - 1, -1, -1):
        size, own = tiers[k], waiting[tiers[k]]
        below = [own, *(waiting[t] for t in reversed(tiers[:k]))]
        while own.pieces:
            first = own.take()
            window, room = [first], size - len(first.ids)
            while room:
                p = next((x for t in below if (x := t.best(room)) is not None), None)
                if p is None:  # nothing fits: cut the shortest piece that is longer than the gap
                    t = next((t for t in reversed(below) if t.pieces), None)
                    if t is None:
                        break
                    p, rest = t.take(0).cut(room)
                    next(waiting[x] for x in tiers if len(rest.ids) <= x).put(rest)
                window.append(p)
                room -= len(p.ids)
            if room:
                left += window
            else:
                out.append(window)
    # at most one window per tier is short: lay them end to end in falling powers of two
    size = longest
    while left:
        waits = sum(len(p.ids) for p in left)
        while size > waits:
            size //= 2
        window, room = [], size
        while room:
            p = left.pop(0)
            if len(p.ids) > room:
                p, rest = p.cut(room)
                left.insert(0, rest)
            window.append(p)
            room -= len(p.ids)
        out.append(window)
    return out


def pack_documents(docs: DataFrame, tiers: tuple[int, ...] = TIERS, path: str | None = None) -> DataFrame:
    """A row per piece of a document; see `SCHEMA`. tiers: powers of two, rising. path: of another rank file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        numbers = {"sequence": 0, "group": 0}

        def flush(pieces: list[Piece]) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in range(9)]
            room = 0
            for window in sorted(pack(pieces, tiers), key=lambda w: -sum(len(p.ids) for p in w)):
                n = sum(len(p.ids) for p in window)
                if n > room:
                    numbers["group"] += 1
                    room = max(STEP_TOKENS, n)
                room -= n
                offset = 0
                for p in window:
                    for column, value in zip(rows, (p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, first | numbers["sequence"], offset, n, first | numbers["group"]), strict=True):
                        column.append(value)
                    offset += len(p.ids)
                numbers["sequence"] += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], [x.split()[0] for x in SCHEMA.split(", ")])

        waiting, n = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = token_ids(text.as_py(), path)
                waiting.append(Piece(doc, 0, ids, len(ids)))
                n += len(ids)
                if n >= FLUSH_TOKENS:
                    yield flush(waiting)
                    waiting, n = [], 0
        if waiting:
            yield flush(waiting)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
