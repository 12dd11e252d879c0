"""A word's hash doesn't depend on what else is in its batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import hashing, lm_scoring, ngram_join, quality_classifier
from tracewright.llm.hashing import KIND, WORD_KIND, runs, text_bytes

BASE = " ".join(f"word{i}" for i in range(80))
NEAR = BASE.replace("word40 ", "")
LONG = ["x" * 5000, " " * 5000, "a" + " " * 5000 + "b", "é" * 2500 + "z", "x" * 4097, "x" * 4096]


@pytest.mark.parametrize("kind", [WORD_KIND, KIND])
@pytest.mark.parametrize("beside", LONG)
def test_hashes_beside_long_runs(beside, kind):
    alone = runs(*text_bytes(pa.array([BASE])), kind)[0]
    h, doc, _, _ = runs(*text_bytes(pa.array([beside, BASE])), kind)
    assert np.array_equal(h[doc == 1], alone)
    assert np.array_equal(ngram_join.shingle_sets(pa.array([BASE, beside]), 3)[0], ngram_join.shingle_sets(pa.array([BASE]), 3)[0])
    w, d = quality_classifier.word_buckets(pa.array([BASE, beside]))
    assert np.array_equal(w[d == 0], quality_classifier.word_buckets(pa.array([BASE]))[0])
    d, _, by = lm_scoring.grams(pa.array([BASE, beside]), 2)
    assert np.array_equal(by[1][d == 0], lm_scoring.grams(pa.array([BASE]), 2)[2][1])


def test_long_words_differ_by_their_ends():
    long = [("x" * 5000) + end for end in ("a", "b", "A", "ab", "ba")]
    h = runs(*text_bytes(pa.array(long)))[0]
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def test_copies_link_beside_long_runs(spark):
    rows = [(1, BASE), (2, BASE), (3, "other text of five words"), (4, BASE), (5, NEAR), (6, LONG[0]), (7, BASE), (8, LONG[1]), (9, NEAR + " " + LONG[0]), (10, LONG[0])]
    words = {i: t.split() for i, t in rows}
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()) for i, w in words.items()}
    want = {i: min([j for j in sets if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])] or [i]) for i in sets}
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df, 3, 90).collect()}
    assert got == want


def test_hashes_do_not_depend_on_slices(monkeypatch):
    texts = pa.array([BASE, None, *LONG, "", NEAR])
    want = runs(*text_bytes(texts))
    for most in (1, 7, 1000):
        monkeypatch.setattr(hashing, "SLICE", most)
        assert all(np.array_equal(a, b) for a, b in zip(runs(*text_bytes(texts)), want, strict=True))


def test_memory_of_shingle_sets_is_bounded():
    words = np.random.default_rng(6).integers(100, 30_000, (1_200, 500))
    texts = pa.array([" ".join(map(str, row)) for row in words])
    tracemalloc.start()
    try:
        sets = ngram_join.shingle_sets(texts, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak - sum(s.nbytes for s in sets) < 32e6
