"""Stupid-backoff scores of all documents by a model of the same documents (operator 10).

Words are lower-cased (A-Z); n-grams are 64-bit hashes. A word with n - 1 words before it scores count(n-gram) / count(context) if
the n-gram occurs `MIN_COUNT` times or more in the corpus, else `BACKOFF` times the score by one word less; a single word scores
count / number of words of the corpus. A document's score is the mean natural log of its words' scores.

The relations are packed (see `exchange`). Documents are cut into blocks. The distinct n-grams of a block, of all orders, with their counts
are its part of the count tables, which are partitioned by hash; a partition adds up the parts of all blocks, and is joined back to the blocks
that hold its n-grams; each block joins the totals to the exploded n-grams of its documents and sums per document. What is sent grows with the
corpus, a frequent n-gram is one entry per block, and tasks hold a block or a table partition, whose numbers grow with the
input and whose sizes don't. No text is cut and no count approximated.

Defined results: a null or empty text, or one without words, has 0 words and a null score; repeated rows count in the model and are scored each;
a null doc_id stays null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import BLOCK_BYTES, FAN, column, fitting, ranked, with_totals
from .hashing import runs, shingles, text_bytes
from .shared import materialize, table

ORDER, MIN_COUNT, BACKOFF = 3, 2, 0.4


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each word's text and place in it; by order, the hash of the n-gram that ends at each word (0: too few words before it)."""
    h, doc, _, _ = runs(*text_bytes(texts))
    first = np.searchsorted(doc, doc, "left")
    place = np.arange(len(h)) - first
    out = [h]
    for o in range(2, order + 1):
        g = np.zeros(len(h), np.uint64)
        if (place >= o - 1).any():
            long_enough = np.bincount(doc)[doc] >= o  # shorter texts would give a shingle too
            g[place >= o - 1] = shingles(h[long_enough], doc[long_enough], o)[0]
        out.append(g)
    return doc, place, out


def score_documents(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """`(doc_id, n_words, n_backoff, score)` per row; n_backoff: words that did not score by the full order open to them."""

    def keys_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, place, by = grams(column(t, "text"), order)
        return np.unique(np.concatenate([g[place >= o - 1] for o, g in enumerate(by, 1)]), return_counts=True)

    def use(t: pa.Table, totals: np.ndarray) -> pa.Table:
        texts = column(t, "text")
        doc, place, by = grams(texts, order)
        full = [place >= o - 1 for o in range(1, order + 1)]
        values, at, _ = ranked(np.concatenate([g[f] for g, f in zip(by, full, strict=True)]))
        joined = fitting(values, totals)[at]
        del by, values, at
        count = []
        for f, c in zip(full, np.split(joined, np.cumsum([f.sum() for f in full])[:-1]), strict=True):
            count.append(np.zeros(len(doc), joined.dtype))
            count[-1][f] = c
        log = np.zeros(len(doc))
        open_ = np.ones(len(doc), bool)
        backed = np.zeros(len(doc), bool)
        for o in range(order, 1, -1):
            may = open_ & full[o - 1]
            hit = may & (count[o - 1] >= min_count)
            context = np.roll(count[o - 2], 1)  # a hit is never at the first word
            log[hit] += np.log(count[o - 1][hit] / context[hit].astype(np.float64))
            open_ &= ~hit
            log[may & ~hit] += math.log(backoff)
            backed |= may & ~hit
        log[open_] += np.log(count[0][open_].astype(np.float64))
        size = len(texts)
        sums = [np.bincount(doc, weights=w, minlength=size)[:size] for w in (np.ones(len(doc)), backed, open_, log)] if len(doc) else [np.zeros(size)] * 4
        return pa.table({"doc_id": column(t, "doc_id"), **{k: pa.array(v.astype(np.int64)) for k, v in zip(("n_words", "n_backoff", "n_single"), sums, strict=False)}, "log": pa.array(sums[3])})

    parts = with_totals(docs, ["doc_id", "text"], keys_of, use, "doc_id bigint, n_words bigint, n_backoff bigint, n_single bigint, log double", block_bytes, fan)
    parts = materialize(parts)
    words = parts.agg(F.sum("n_words")).first()[0] or 1
    mean = (F.col("log") - F.col("n_single") * F.lit(math.log(words))) / F.col("n_words")
    return parts.select("doc_id", "n_words", "n_backoff", F.when(F.col("n_words") > 0, mean).alias("score"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
