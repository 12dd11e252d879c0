"""Every query of the folder by its name, and the pipeline, over awkward tables."""

import math

import pytest
from test_llm import SCHEMA, rows

import __spark_entry__
import corpus_pipeline
from tracewright.llm.registry import QUERIES

COLUMNS = {
    "op1_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op2_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op4_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op6_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9_token_counts": {"doc_id": "bigint", "n_tokens": "bigint"},
    "op10_lm_scoring": {"doc_id": "bigint", "n_words": "bigint", "score": "double"},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 3 > 0) if r[0] is not None and r[0] % 5 else None, 0) for r in rows()], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    page = "<body><nav>n</nav><article><p>text {0}</p></article></body>"
    spark.createDataFrame([(i, f"http://a.example.net/de/{i}", page.format(i)) for i in range(12)] + [(None, None, None)], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    vectors = [(i, [math.cos(i % 5), math.sin(i % 5), 0.1], i % 2) for i in range(30)] + [(None, None, None)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_schema_and_rows(spark, tables, name):
    assert __spark_entry__.queries()[name] is QUERIES[name]
    df = QUERIES[name](spark, tables)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    key = next(c for c in ("doc_id", "page_id", "vec_id") if c in kinds)
    table = {"doc_id": "documents", "page_id": "pages", "vec_id": "embeddings"}[key]
    ids = [r[0] for r in spark.read.parquet(f"{tables}/{table}.parquet").select(key).collect()]
    got = [r[0] for r in df.select(key).collect()]
    assert set(got) == set(ids) and (name == "op6_packing" or len(got) == len(ids))


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        if k < 4:
            assert out.schema == docs.schema, name
        path = f"{tables}/stage{k}.parquet"
        out.write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        sizes.append(docs.count())
        if name in ("quality_classifier", "quality_rules", "ngram_jaccard"):
            assert not docs.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() and sizes[-1] <= sizes[-2], name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard", "mixing", "packing"]
    assert corpus_pipeline.run(spark, tables).columns == docs.columns


def test_pipeline_of_nothing(spark, tables):
    none = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, tables)
        assert out.count() == 0 and (k == 4 or out.schema == none.schema)
