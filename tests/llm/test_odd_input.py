"""Repeated ids, nulls, empty tables and clashing column names in the pipeline's stages and in vector search."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from eventloom.llm import ann, jaccard, secret_scan  # noqa: E402

SMALL = "/root/testdata/sf0.001"
CLASHING = ["__uid", "__set", "__sketch", "__root", "__rep", "__links", "__copies", "SPANS", "masked", "c0", "Band", "key"]


def extended(spark, rows):
    """Documents with further columns whose names operators might use themselves."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.createDataFrame(rows, schema).selectExpr("*", *[f"concat('{i}', doc_id) AS `{name}`" for i, name in enumerate(CLASHING)])


COPY = " ".join(f"word{i}" for i in range(40))
ROWS = [
    (1, COPY, "en", "a", 5), (2, COPY + " more", "en", "a", 5), (3, None, None, None, None), (4, "", "en", "a", 0), (4, "", "en", "a", 0),
    (None, COPY, "en", "a", 5), (5, "password = hunter2hunter2 and so on", "en", "b", 9), (5, "password = hunter2hunter2 and so on", "en", "b", 9),
    (6, "x " * 60_000, "en", "b", 9),
]


def test_one_of_each_group_stays_with_its_columns(spark):
    docs = extended(spark, ROWS)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema.names == docs.schema.names
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "4", "5", "6"]
    first = kept.filter("doc_id = 1").first()
    assert [first[c] for c in CLASHING] == [f"{i}1" for i in range(len(CLASHING))]


def test_masking_keeps_other_columns(spark):
    docs = extended(spark, ROWS)
    masked = secret_scan.redacted(docs)
    assert masked.columns == docs.columns and [t for _, t in masked.dtypes] == [t for _, t in docs.dtypes]
    rows = masked.filter("doc_id = 5").collect()
    assert len(rows) == 2 and all("hunter2" not in r.text and r.SPANS == "75" and r.n_chars == len(r.text) for r in rows)
    assert masked.filter("doc_id = 3").first().text is None


def test_stages_with_odd_documents(spark):
    docs = extended(spark, ROWS)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            after = stage(spark, table, SMALL)
            rows = after.collect()
            assert len(rows) <= len(ROWS)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns
            if table is not docs:
                assert not rows
        docs = stage(spark, docs, SMALL) if name == "ngram_jaccard_join" else docs


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(20, data[20].tolist()), (20, (-data[20]).tolist()), (40, data[7].tolist())]
    vecs = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), share=1.0).collect()
    assert len(got) == 20 * sum(i % 20 == 0 for i in ids)
    found = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got)
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = (vecs * vecs[q]).sum(axis=1)
        others = np.flatnonzero(np.arange(len(ids)) != q)
        best = others[np.lexsort((ids[others], -scores[others]))][:20]
        want += [(int(ids[q]), n + 1, int(ids[j]), round(float(scores[j]), 9)) for n, j in enumerate(best)]
    assert found == sorted(want)


def test_share_follows_the_data_and_acts(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(12, 16)) * 6
    tight = centers[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 16)) * 0.3
    loose = rng.normal(size=(2000, 16))
    shares, recalls = [], []
    for data in (tight, loose):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>").cache()
        exact = {(r.query_id, r.vec_id) for r in ann.search(table, share=1.0).collect()}
        few = {(r.query_id, r.vec_id) for r in ann.search(table, share=0.05).collect()}
        own = {(r.query_id, r.vec_id) for r in ann.search(table).collect()}
        shares.append(len(few & exact) / len(exact))
        recalls.append(len(own & exact) / len(exact))
    assert min(recalls) > 0.9
    assert shares[0] > 0.9 > 0.7 > shares[1]  # a small share is enough for clusters only
