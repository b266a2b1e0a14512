"""One query for each operator over its whole table, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import ann, bpe, decontaminate, hyperminhash, jaccard, licenses, lm, page_text, records, secret_scan, toxicity, treap, whitening
from eventloom.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
END = 2


def score_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(read(spark, folder, "documents"))


def extract_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract(read(spark, folder, "pages"))


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(read(spark, folder, "embeddings"))


def find_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read(spark, folder, "documents"))


def find_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(read(spark, folder, "documents"))


def score_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(read(spark, folder, "documents"), read(spark, folder, "labels"))


def find_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def token_records(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    place = records.new_folder(spark)
    parts = records.write_records(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), place, END)
    return records.read_back(spark, parts, place)


def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(bpe.encode(read(spark, folder, "documents"), vocabulary, raw=True))


def join_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_join(read(spark, folder, "documents"))


def rank_documents(spark: SparkSession, folder: str) -> DataFrame:
    return treap.rank(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.near_duplicates(read(spark, folder, "documents"))


def whiten_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_lm_scoring": score_language_model,
    "op2_html_extraction": extract_main_text,
    "op3_nearest_neighbours": nearest_vectors,
    "op4_secret_scans": find_secrets,
    "op5_toxicity": score_toxicity,
    "op6_benchmark_decontamination": find_benchmark,
    "op7_token_records": token_records,
    "op8_license_scans": find_licenses,
    "op9_byte_bpe": byte_bpe,
    "op10_ngram_jaccard_join": join_ngrams,
    "op11_ranked_search": rank_documents,
    "op12_minhash_near_dedup": near_duplicates,
    "op13_embedding_whitening": whiten_embeddings,
}


def _secrets_sql() -> str:
    """Matches and the pieces between them, as in the operator; their lengths give the places."""
    parts = []
    for number, rule in enumerate(secret_scan.RULES):
        regex = rule.regex.replace("'", "''")
        parts.append(
            f"""SELECT rid, '{rule.kind}' AS kind, {number} AS pos, unnest(regexp_extract_all(text, '{regex}')) AS hit,
                unnest(regexp_extract_all(text, '{regex}', {rule.group})) AS kept,
                unnest(string_split_regex(text, '{regex}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '{regex}'), 1) AS n,
                {rule.least} AS least FROM docs"""
        )
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        hits AS ({" UNION ALL ".join(parts)}),
        placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, pos ORDER BY n) AS stop FROM hits),
        spans AS (SELECT rid, kind, pos, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE length(kept) >= least),
        told AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex,
            coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, pos) FILTER (pos < {secret_scan.BASE}), '') AS base,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, pos) AS spans FROM spans GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN told USING (rid)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _ranked_sql() -> str:
    terms = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {terms} AS terms FROM documents),
        sized AS (SELECT rid, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
        stats AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM sized),
        tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM docs) GROUP BY ALL),
        asked AS (SELECT row_number() OVER () AS iid, item_id, {terms} AS terms FROM benchmark),
        wanted AS (SELECT iid, term, count(*) AS times FROM (SELECT iid, unnest(terms) AS term FROM asked) GROUP BY ALL),
        held AS (SELECT term, count(*) AS df FROM tf SEMI JOIN wanted USING (term) GROUP BY term),
        weights AS (SELECT term, floor(1000 * ln((2 * total + 2) / (2 * df + 1)))::BIGINT AS w FROM held, stats),
        lengths AS (SELECT rid, doc_id, 75 + (25 * n * total) // length AS m FROM sized, stats),
        scored AS (SELECT iid, rid, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (rid) GROUP BY iid, rid),
        ranked AS (SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
            FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked JOIN asked USING (iid) WHERE rank <= {treap.TOP}"""


def _near_sql() -> str:
    width = hyperminhash.WIDTH
    words = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
    return f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS words FROM documents),
        sets AS (SELECT rid, doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
            range(greatest(len(words) - {width - 1}, 1)), lambda i: array_to_string(words[i + 1 : i + {width}], ' ')))) END AS shingles FROM docs),
        classes AS (SELECT shingles, min(rid) AS id, len(shingles) AS n FROM sets WHERE len(shingles) > 0 GROUP BY shingles),
        held AS (SELECT id, unnest(shingles) AS shingle FROM classes),
        common AS (SELECT a.id AS a, b.id AS b, count(*) AS same FROM held a JOIN held b ON a.shingle = b.shingle AND a.id < b.id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN classes x ON x.id = a JOIN classes y ON y.id = b
            WHERE 100 * same >= {hyperminhash.PERCENT} * (x.n + y.n - same)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
        rows AS (SELECT sets.doc_id, sets.rid, len(sets.shingles) AS n, classes.id FROM sets LEFT JOIN classes USING (shingles)),
        least AS (SELECT reach.a AS id, min(rows.doc_id) AS doc_id FROM reach JOIN rows ON rows.id = reach.b GROUP BY ALL),
        told AS (SELECT rows.doc_id, n::BIGINT AS n_shingles, CASE WHEN n > 0 THEN least.doc_id ELSE rows.doc_id END AS component_id
            FROM rows LEFT JOIN least USING (id))
        SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM told"""


SQL: dict[str, str] = {
    "op4_secret_scans": _secrets_sql(),
    "op8_license_scans": licenses.scan_sql(),
    "op11_ranked_search": _ranked_sql(),
    "op12_minhash_near_dedup": _near_sql(),
}
