"""The corpus pipeline, stage by stage, and the registered queries."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__  # noqa: E402
import oracle  # noqa: E402
import public_tokenizers  # noqa: E402

from eventloom.llm import bpe, decontaminate, jaccard, queries, secret_scan  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL).cache()
        assert after.columns == columns
        assert 0 < after.count() <= before.count()
        if name == "ngram_jaccard_join":
            assert {r.n_copies + r.n_links for r in jaccard.jaccard_join(after).collect()} == {1}
        if name == "benchmark_decontamination":
            assert decontaminate.contaminated(after, spark.read.parquet(f"{SMALL}/benchmark.parquet")).isEmpty()
        if name == "secret_scans":
            assert after.count() == before.count()
            assert secret_scan.report(after).filter("spans <> ''").isEmpty()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SMALL)
    assert last.count() == before.count()


def test_last_stage_holds_the_ids(spark):
    texts = {1: "one two three", 2: "", 3: "é😀 " * 6000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = corpus_pipeline.token_ids(spark, docs, SMALL).collect()
    assert {r.doc_id: vocabulary.codec().decode(r.ids).decode() for r in rows} == texts
    assert all(len(r.ids) == r.n_tokens for r in rows)


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for number in range(1, 14):
        assert sum(n.startswith(f"op{number}_") for n in names) == 1


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = oracle.connect(SMALL)
    assert oracle.compare(spark, con, SMALL, name, queries.QUERIES[name], queries.SQL[name]) is None
