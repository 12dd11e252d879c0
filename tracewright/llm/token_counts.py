"""Token counts under a unigram model (operator 9): a trie of distinct pre-tokens, with the forward scores of its nodes.

The vocabulary is that of `byte_bpe_50k.tiktoken`, byte strings in order of rank; a piece of rank r has the Zipf log
probability -log(r + `SHIFT`) - log(sum of 1 / (k + `SHIFT`)). Any bytes can be split, as each single byte is a piece. A pre-token's
tokens are those of its best split (Viterbi): the highest score, and of equal scores the fewest tokens. Texts are split
into pre-tokens by the vocabulary's own pattern.

Distinct pre-tokens are inserted, byte by byte, in a trie. A node's forward score depends on its path alone, so it is
computed once for all pre-tokens that share the prefix, and the end of a pre-token stores its count. A document's count is
the sum over its pre-tokens. The trie lives in the Python worker, serves all tasks that it runs, and starts anew beyond
`MAX_NODES` nodes: memory is bounded and results don't depend on it. Nothing is shuffled.

Defined results: a null or empty text has no tokens; repeated rows are counted one by one; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .hashing import trimmed
from .shared import table

SHIFT, MAX_NODES, LONG = 10.0, 1_000_000, 4096
VOCABULARY = "byte_bpe_50k.tiktoken"


@functools.cache
def pieces(path: str | None = None) -> dict[bytes, float]:
    """Scores by byte string."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    norm = math.log(math.fsum(1 / (r + SHIFT) for r in ranks.values()))
    return {p: -math.log(r + SHIFT) - norm for p, r in ranks.items()}


@functools.cache
def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class Endings:
    """The vocabulary as a trie of reversed pieces: node k's child by byte c is `child[k << 8 | c]`, `score[k]` that of the piece that
    ends there, or None. From a place in a text, a walk back along it meets the pieces that end there and no other bytes."""

    def __init__(self, scores: dict[bytes, float]):
        self.child: dict[int, int] = {}
        self.score: list[float | None] = [None]
        for piece, s in scores.items():
            node = 0
            for c in reversed(piece):
                nxt = self.child.get(node << 8 | c)
                if nxt is None:
                    nxt = self.child[node << 8 | c] = len(self.score)
                    self.score.append(None)
                node = nxt
            self.score[node] = s
        self.longest = max(map(len, scores))

    def best(self, data: bytes, end: int, at) -> tuple[float, int]:
        """Score and tokens of the best split of data[:end], where `at(start)` gives those of data[:start]."""
        child, score, node, best, fewest = self.child, self.score, 0, -math.inf, 0
        for start in range(end - 1, -1, -1):
            node = child.get(node << 8 | data[start])
            if node is None:
                break
            s = score[node]
            if s is not None:
                total, n = at(start)
                if total + s > best or (total + s == best and n + 1 < fewest):
                    best, fewest = total + s, n + 1
        return best, fewest


class ForwardTrie:
    """Pre-tokens in a trie of bytes; node k has the children of `children[k]`, the score and the number of tokens `state[k]` of its path's best
    split. Pre-tokens of more than `LONG` bytes, which share no prefix worth keeping, are scored without a place in the trie."""

    def __init__(self, scores: dict[bytes, float]):
        self.endings = Endings(scores)
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[int, int] | None] = [None]
        self.state: list[tuple[float, int]] = [(0.0, 0)]
        self.terminals: dict[str, int] = {}

    def insert(self, pre_token: str) -> int:
        """The number of tokens; also kept in `terminals`."""
        data = pre_token.encode()
        if len(data) > LONG:
            return self.alone(data)
        state, children, path, node = self.state, self.children, [0], 0
        for end in range(1, len(data) + 1):
            below = children[node]
            nxt = below.get(data[end - 1]) if below else None
            if nxt is None:
                nxt = len(state)
                if below is None:
                    below = children[node] = {}
                below[data[end - 1]] = nxt
                children.append(None)
                state.append(self.endings.best(data, end, lambda start: state[path[start]]))
            node = nxt
            path.append(node)
        self.terminals[pre_token] = state[node][1]
        return state[node][1]

    def alone(self, data: bytes) -> int:
        """The number of tokens, with the states of as many places as a piece is long."""
        wide = self.endings.longest + 1
        ring = [(0.0, 0)] * wide
        for end in range(1, len(data) + 1):
            ring[end % wide] = self.endings.best(data, end, lambda start: ring[start % wide])
        return ring[len(data) % wide][1]


@functools.cache
def worker_trie(path: str | None = None) -> ForwardTrie:
    """One for all tasks of a Python worker."""
    return ForwardTrie(pieces(path))


def count_tokens(docs: DataFrame, path: str | None = None, max_nodes: int = MAX_NODES) -> DataFrame:
    """`(doc_id, n_pre_tokens, n_tokens, n_bytes)` per row. path: of another rank file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, find = worker_trie(path), pattern().findall
        for b in batches:
            pre, tokens, size = [], [], []
            for text in b.column(1):
                text = text.as_py() or ""
                n = total = 0
                for at, stop in spans(text):
                    found = Counter(find(text, at, stop))
                    known = trie.terminals
                    for word, k in found.items():
                        c = known.get(word)
                        if c is None:
                            c = trie.insert(word)
                        n += k
                        total += k * c
                    if len(trie.state) > max_nodes:
                        trie.clear()
                pre.append(n)
                tokens.append(total)
                size.append(len(text.encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (pre, tokens, size))], ["doc_id", "n_pre_tokens", "n_tokens", "n_bytes"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id bigint, n_pre_tokens bigint, n_tokens bigint, n_bytes bigint")


def spans(text: str, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts a long text between a letter and a space, where the pattern always ends a pre-token."""
    at = 0
    while at < len(text):
        stop = at + size
        while stop < len(text) and not (text[stop] == " " and text[stop - 1].isalpha() and stop + 1 < len(text) and text[stop + 1].isalpha()):
            stop += 1
        stop = min(stop, len(text))
        yield at, stop
        at = stop


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
