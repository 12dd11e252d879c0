"""Word vectors are sums over all documents, not only over those the network is fitted on."""

import functools
import tracemalloc

import numpy as np
import pyarrow as pa

from tracewright.llm import hashing
from tracewright.llm import quality_classifier as qc


def brute_sums(texts, index):
    """Word by word, neighbour by neighbour."""
    out = np.zeros(index.shape)
    words, doc = qc.word_buckets(pa.array(texts))
    for i in range(len(words)):
        for j in range(max(0, i - qc.WINDOW), min(len(words), i + qc.WINDOW + 1)):
            if i != j and doc[i] == doc[j]:
                out[words[i]] += index[words[j]]
    return out


def test_vectors_of_all_documents(spark, monkeypatch):
    texts = [f"good text number {i}" for i in range(20)] + ["unseen words stand beside unlabelled neighbours", None, "", "one", "echo echo echo ECHO 12 ,, x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    index = qc.index_vectors()
    context = brute_sums(texts, index)
    for most in (4_000_000, 7):
        monkeypatch.setattr(qc, "MOST_PAIRS", most)
        own = qc.ContextSums()
        own.add(pa.array(texts, pa.string()))
        assert np.array_equal(own.sums(), context)
    want = context / (np.linalg.norm(context, axis=1, keepdims=True) + 1e-6) + index / np.sqrt(6).astype(np.float32)
    assert np.allclose(qc.fit(docs, labels, fit_rows=8).vectors, want, atol=1e-5)


def test_sums_do_not_depend_on_chunks(monkeypatch):
    texts = [f"text {i} of the Same same SAME words, {i % 3} more" for i in range(40)] + [None, "", "one"]
    want = brute_sums(texts, qc.index_vectors())
    for chunk, part, most in ((1, 1, 5), (3, 100, 1000), (7, 1_000_000, 20)):
        monkeypatch.setattr(qc, "CHUNK", chunk)
        monkeypatch.setattr(qc, "parts", functools.partial(hashing.parts, most=part))
        monkeypatch.setattr(qc, "MOST_PAIRS", most)
        own = qc.ContextSums()
        own.add(pa.array(texts, pa.string()))
        assert np.array_equal(own.sums(), want)


def test_memory_of_sums_and_pooling_is_bounded():
    words = np.random.default_rng(5).integers(100, 30_000, (2_000, 400))
    texts = pa.array([" ".join(map(str, row)) for row in words])
    vectors = qc.index_vectors()
    tracemalloc.start()
    try:
        own = qc.ContextSums()
        own.add(texts)
        own.sums()
        of_sums = tracemalloc.get_traced_memory()[1]
        del own
        tracemalloc.reset_peak()
        qc.pool(texts, vectors)
        of_pool = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert of_sums < 64e6 and of_pool < 48e6, (of_sums, of_pool)
