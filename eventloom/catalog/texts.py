"""Histories as text, prompts, scoring and answers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from eventloom.catalog.cohorts import HOSPITALISATION, stored_labels
from eventloom.catalog.events import TEXT_EVENTS, clean_hospital
from eventloom.catalog.registry import query, table, view
from eventloom.operators import narrative, prompts
from eventloom.plans import history
from eventloom.plans.cohorts import COHORTS
from eventloom.plans.timeline import lay_out, written

LINES = f"""(SELECT *, CASE WHEN a THEN '## Age ' || y || ' years ' || d || ' days\n' ELSE '' END || CASE WHEN a OR t THEN '### ' || tod || '\n' ELSE '' END
    || CASE WHEN a OR t OR p THEN '#### ' || prefix || '\n' ELSE '' END || code || '\n' AS line FROM (SELECT *,
      coalesce(y <> lag(y) OVER w, true) OR coalesce(d <> lag(d) OVER w, true) AS a, coalesce(tod <> lag(tod) OVER w, true) AS t,
      coalesce(prefix <> lag(prefix) OVER w, true) AS p FROM (SELECT *, coalesce(age_year, -1) AS y, coalesce(age_day, -1) AS d,
        coalesce(time_of_day, 'Time Unspecified') AS tod FROM {TEXT_EVENTS} WHERE time IS NOT NULL AND code IS NOT NULL AND prefix IS NOT NULL) WINDOW w AS (PARTITION BY subject_id ORDER BY event_seq)))"""
TITLE = "'# Patient''s Electronic Health Record\n\n'"
NARRATIVES = f"""(SELECT l.subject_id, l.prediction_time, {TITLE} || rtrim(string_agg(e.line, '' ORDER BY e.event_seq), chr(10) || ' ') AS text,
    any_value(l.boolean_value) AS boolean_value, CAST(NULL AS BIGINT) AS integer_value, CAST(NULL AS DOUBLE) AS float_value, CAST(NULL AS VARCHAR) AS categorical_value
    FROM {HOSPITALISATION} l JOIN {LINES} e ON e.subject_id = l.subject_id AND e.time <= l.prediction_time GROUP BY l.subject_id, l.prediction_time)"""


def lines(spark, folder):
    return narrative.render_lines(history.text_events(clean_hospital(spark, folder)))


@query(f"SELECT event_id, line FROM {LINES}")
def render_lines(spark, folder):
    """One line per event with the headers it opens."""
    return lines(spark, folder).rows().select("event_id", "line")


@query(f"SELECT subject_id, {TITLE} || rtrim(string_agg(line, '' ORDER BY event_seq), chr(10) || ' ') AS text FROM {LINES} GROUP BY subject_id")
def whole_histories(spark, folder):
    return narrative.patient_texts(history.text_events(clean_hospital(spark, folder)))


@query(f"SELECT * FROM {NARRATIVES}")
def narratives(spark, folder):
    """Flagship: every labelled subject's history up to the prediction time."""
    return history.text_dataset(clean_hospital(spark, folder), stored_labels(spark, folder, "hospitalisation"))


def stored_narratives(spark, folder):
    """The text data set as a stored table, as the prompt steps read it."""
    return written(narratives(spark, folder), "narratives")


@query(f"""SELECT l.subject_id, l.prediction_time, (e.event_seq - 1) // 10 AS page, string_agg(e.line, '' ORDER BY e.event_seq) AS text
    FROM {HOSPITALISATION} l JOIN {LINES} e ON e.subject_id = l.subject_id AND e.time <= l.prediction_time GROUP BY ALL""")
def narrative_pages(spark, folder):
    events = history.text_events(clean_hospital(spark, folder))
    pages = narrative.narrative_pages(events, stored_labels(spark, folder, "hospitalisation"), lines_per_page=10)
    return pages.select("subject_id", "prediction_time", "page", "text")


@query(f"SELECT subject_id, text || '\n\n# Task\nReadmission?' AS text, boolean_value AS label FROM {NARRATIVES}")
def training_rows(spark, folder):
    return narrative.training_rows(stored_narratives(spark, folder), "\n\n# Task\nReadmission?")


# --- prompts ------------------------------------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TASK_ROWS = " UNION ALL ".join(f"SELECT {quoted(n)} AS task, {quoted(s['description'])} AS task_description" for n, s in COHORTS.items())
DESCRIBED = f"(SELECT d.*, t.task_description FROM {{dataset}} d JOIN ({TASK_ROWS}) t USING (task))"
START, MIDDLE, END = (quoted(p) for p in prompts.TEMPLATE.replace("{task_description}", "{ehr}").split("{ehr}"))


def prompt_sql(text: str) -> str:
    return f"{START} || {text} || {MIDDLE} || task_description || {END}"


def described(spark, folder):
    return prompts.with_descriptions(view(spark, folder, "dataset"), prompts.task_table(spark, COHORTS))


@query(f"SELECT subject_id, task, {prompt_sql('text')} AS prompt, length({prompt_sql('text')}) AS prompt_length FROM {DESCRIBED}")
def format_prompts(spark, folder):
    return prompts.with_prompts(described(spark, folder)).select("subject_id", "task", "prompt", "prompt_length")


@query(f"SELECT * FROM {DESCRIBED}")
def task_descriptions(spark, folder):
    return described(spark, folder)


@query(f"SELECT task, count(*) AS n_rows FROM {{dataset}} WHERE task NOT IN (SELECT task FROM ({TASK_ROWS})) GROUP BY task")
def unknown_tasks(spark, folder):
    return prompts.unknown_tasks(view(spark, folder, "dataset"), prompts.task_table(spark, COHORTS))


WORDS = "len(regexp_extract_all({x}, '\\S+'))"
LIMITED = f"""(SELECT subject_id, task, n - (total - {{limit}}) AS available, text, total FROM (SELECT *, {WORDS.replace('{x}', 'text')} AS n,
    {WORDS.replace('{x}', prompt_sql('text'))} AS total FROM {DESCRIBED}))"""


@query(f"""SELECT subject_id, task, CASE WHEN total > 300 THEN available END AS available_tokens, CASE WHEN total <= 300 THEN text WHEN available > 0 THEN
    ltrim(array_to_string(regexp_extract_all(text, '\\s*\\S+')[-available:], ''), chr(10) || ' ') END AS text FROM {LIMITED.replace('{limit}', '300')}""")
def limit_history(spark, folder):
    """Histories cut to the last words that fit the prompt."""
    limited = prompts.limit_history(described(spark, folder), 300)
    return limited.select("subject_id", "task", F.col("available_tokens").cast("bigint").alias("available_tokens"), "text")


def word_tokenizer():
    """Stands in for a model's tokenizer: a token is a word with the white space before it."""
    return re.compile(r"\s*\S+").findall, "".join


@query(f"""SELECT subject_id, task, 'User: ' || {prompt_sql('kept')} AS prompt FROM (SELECT *, CASE WHEN total + 1 <= 300 THEN text WHEN available > 1 THEN
    array_to_string(regexp_extract_all(text, '\\s*\\S+')[-(available - 1):], '') END AS kept FROM (SELECT l.*, t.task_description
    FROM {LIMITED.replace('{limit}', '300')} l JOIN ({TASK_ROWS}) t USING (task))) WHERE kept IS NOT NULL""")
def prompts_with_tokenizer(spark, folder):
    """Prompts of at most 300 tokens of a given tokenizer, a chat wrapper included."""
    wrapped = prompts.with_prompts(described(spark, folder), 300, tokenizer=word_tokenizer, wrap=lambda p: F.concat(F.lit("User: "), p))
    return wrapped.select("subject_id", "task", "prompt")


@query(f"""SELECT task, 'unknown task' AS reason, count(*) AS n_rows FROM {{dataset}} WHERE task NOT IN (SELECT task FROM ({TASK_ROWS})) GROUP BY task
    UNION ALL SELECT task, 'too long', count(*) FROM {LIMITED.replace('{limit}', '70')} WHERE total > 70 AND available <= 0 GROUP BY task""")
def rows_left_out(spark, folder):
    return prompts.left_out(view(spark, folder, "dataset"), prompts.task_table(spark, COHORTS), 70)


@query(f"SELECT subject_id, task FROM {LIMITED.replace('{limit}', '70')} WHERE total > 70 AND available <= 0")
def rejected_prompts(spark, folder):
    return prompts.rejected(prompts.limit_history(described(spark, folder), 70)).select("subject_id", "task")


CUT = f"""(SELECT *, ltrim(array_to_string(regexp_extract_all(text, '\\s*\\S+')[-available:], ''), chr(10) || ' ') AS suffix FROM (SELECT *, n - (total - 120) AS available
    FROM (SELECT *, {WORDS.replace('{x}', 'text')} AS n, {WORDS.replace('{x}', prompt_sql('text'))} AS total
    FROM (SELECT *, {quoted(COHORTS['hospitalisation']['description'])} AS task_description FROM {NARRATIVES}))))"""


@query(f"""SELECT subject_id, prediction_time, CASE WHEN total <= 120 THEN text
    WHEN header = '' THEN suffix ELSE substr(suffix, CASE WHEN starts_with(suffix, header) THEN 1 ELSE strpos(suffix, chr(10) || header) + 1 END) END AS text
    FROM (SELECT *, regexp_extract(suffix, '(?m)^## Age \\d+ years \\d+ days$') AS header FROM {CUT}) WHERE total <= 120 OR available > 0""")
def narratives_cut_at_age_header(spark, folder):
    """Long histories start at an age header after the cut."""
    described = stored_narratives(spark, folder).withColumn("task_description", F.lit(COHORTS["hospitalisation"]["description"]))
    limited = prompts.limit_history(described, 120)
    return limited.filter("available_tokens IS NULL OR available_tokens > 0").select("subject_id", "prediction_time", "text")


def age_header_sql(limit: int) -> str:
    return f"""SELECT subject_id, prediction_time, CASE WHEN total > {limit} THEN available END AS available_tokens, CASE WHEN total <= {limit} THEN text WHEN available <= 0 THEN NULL
    WHEN header = '' THEN suffix ELSE substr(suffix, CASE WHEN starts_with(suffix, header) THEN 1 ELSE strpos(suffix, chr(10) || header) + 1 END) END AS text
    FROM (SELECT *, regexp_extract(suffix, '(?m)^## Age \\d+ years \\d+ days$') AS header FROM {CUT.replace('- 120)', f'- {limit})')})"""


def limited(spark, folder, limit: int):
    described = stored_labels(spark, folder, "hospitalisation").withColumn("task_description", F.lit(COHORTS["hospitalisation"]["description"]))
    events = history.text_events(clean_hospital(spark, folder))
    texts = prompts.limited_narratives(events, described, limit)
    return texts.select("subject_id", "prediction_time", F.col("available_tokens").cast("bigint").alias("available_tokens"), "text")


@query(age_header_sql(120))
def limited_narratives(spark, folder):
    """Histories cut by running counts of their lines, never written out in full."""
    return limited(spark, folder, 120)


@query(age_header_sql(85))
def limited_narratives_inside_lines(spark, folder):
    """The same with so few words that most cuts fall behind the last header."""
    return limited(spark, folder, 85)


@query(f"""SELECT subject_id, (event_seq - 1) // 10 AS page, string_agg(line, '' ORDER BY event_seq) AS text FROM {LINES} GROUP BY ALL""")
def history_pages(spark, folder):
    """The pages of all subjects, each once."""
    events = history.text_events(clean_hospital(spark, folder))
    return narrative.paged_histories(events, stored_labels(spark, folder, "hospitalisation"), 10)[0]


@query(f"""SELECT subject_id, prediction_time, page, text FROM (SELECT *, max(page) OVER (PARTITION BY subject_id, prediction_time) AS last FROM (
    SELECT l.subject_id, l.prediction_time, (e.event_seq - 1) // 10 AS page, string_agg(e.line, '' ORDER BY e.event_seq) AS text
    FROM {HOSPITALISATION} l JOIN {LINES} e ON e.subject_id = l.subject_id AND e.time <= l.prediction_time GROUP BY ALL)) WHERE page = last""")
def history_page_cuts(spark, folder):
    """Each label's last page, cut at its last line; with the pages before it this is the label's history."""
    events = history.text_events(clean_hospital(spark, folder))
    ends = narrative.paged_histories(events, stored_labels(spark, folder, "hospitalisation"), 10)[1]
    return ends.select("subject_id", "prediction_time", "page", "text")


THINKING = "CASE WHEN regexp_matches(model_output, '(?s)<think>(.*?)</think>') THEN trim(regexp_extract(model_output, '(?s)<think>(.*?)</think>', 1), chr(10) || ' ') END"
EXPLANATION = """CASE WHEN regexp_matches(model_output, '(?i)Explanation:') THEN trim(regexp_extract(regexp_replace(
    regexp_extract(model_output, '(?is)Explanation:\\s*(.*)$', 1), '(?is)(Answer:|Probability:).*$', ''), '(?s)^(.*)$', 1), chr(10) || ' ') END"""
ANSWER = "CASE WHEN regexp_matches(model_output, '(?i)Answer:\\s*(Yes|No)') THEN lower(regexp_extract(model_output, '(?i)Answer:\\s*(Yes|No)', 1)) = 'yes' END"
CHANCE = """CASE WHEN regexp_matches(model_output, 'Probability:\\s*(\\d+)')
    THEN CAST(least(100, CAST(regexp_extract(model_output, 'Probability:\\s*(\\d+)', 1) AS BIGINT)) AS INT) END"""
PARSED = f"SELECT conv_id, turn, {ANSWER} AS parsed_answer, {CHANCE} AS parsed_probability, {THINKING} AS parsed_thinking, {EXPLANATION} AS parsed_explanation FROM {{answers}}"


@query(PARSED)
def parse_answers(spark, folder):
    return prompts.parse_answers(view(spark, folder, "answers")).drop("model_output")


def length_model(batch: list[str]) -> dict[str, list[str]]:
    """Stands in for a model: the answer depends only on the prompt's length."""
    yes = ["Yes" if len(p) % 2 else "No" for p in batch]
    return {"model_output": [f"Explanation: long Answer: {a} Probability: {len(p) % 101}" for a, p in zip(yes, batch, strict=True)]}


@query(f"""SELECT subject_id, task, n AS prompt_length, n % 2 = 1 AS parsed_answer, CAST(n % 101 AS INT) AS parsed_probability
    FROM (SELECT subject_id, task, length({prompt_sql('text')}) AS n FROM {DESCRIBED})""")
def batched_scoring(spark, folder):
    """Prompts through a user function in batches, longest first, then parsed."""
    tasks = prompts.task_table(spark, COHORTS)
    scored = prompts.run_scoring(view(spark, folder, "dataset"), tasks, length_model)
    return scored.select("subject_id", "task", "prompt_length", "parsed_answer", "parsed_probability")


@query("SELECT doc_id, prompt_length, row_number() OVER (ORDER BY prompt_length DESC, doc_id) AS position FROM (SELECT doc_id, length(text) AS prompt_length FROM documents)")
def longest_prompts_first(spark, folder):
    """All prompts in order of length, with their positions."""
    rows = table(spark, folder, "documents").select("doc_id", F.length("text").alias("prompt_length"))
    return prompts.longest_first(rows, number="position", ties=["doc_id"])


BUCKET = "(length(bin(n)) - 1) * 4 + CASE WHEN length(bin(n)) < 3 THEN 0 ELSE (n >> (length(bin(n)) - 3)) & 3 END"
LARGEST = "CASE WHEN bucket < 8 THEN (2 << (bucket // 4)) - 1 ELSE ((bucket % 4 + 5) << (bucket // 4 - 2)) - 1 END"
BATCHES = f"""(SELECT doc_id, n, bucket, (place // capacity)::BIGINT AS batch, (place % capacity)::BIGINT AS row FROM (SELECT *, greatest(least(48, 60000 // greatest({LARGEST}, 1)), 1) AS capacity,
    row_number() OVER (PARTITION BY bucket ORDER BY n DESC, doc_id) - 1 AS place FROM (SELECT doc_id, n, ({BUCKET})::INT AS bucket FROM (SELECT doc_id, length(text) AS n FROM documents))))"""


def batches_of_documents(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.length("text").alias("prompt_length"))
    return prompts.length_batches(rows, 48, 60_000, ties=["doc_id"])


@query(f"SELECT doc_id, n AS prompt_length, bucket, batch, row FROM {BATCHES}")
def length_batches(spark, folder):
    """Batches of one length class, at most 48 documents and 60,000 padded characters."""
    return batches_of_documents(spark, folder)


@query(f"""SELECT 'by length' AS kind, round(1 - sum(used)::DOUBLE / sum(padded), 9) AS padding FROM (SELECT sum(n) AS used, count(*) * max(n) AS padded FROM {BATCHES} GROUP BY bucket, batch)
    UNION ALL SELECT 'as they come', round(1 - sum(used)::DOUBLE / sum(padded), 9) FROM (SELECT sum(n) AS used, count(*) * max(n) AS padded
      FROM (SELECT length(text) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 48 AS batch FROM documents) GROUP BY batch)""")
def padding_share(spark, folder):
    """How much of what a model reads is padding, with batches by length and with batches of 48 as they come."""
    by_length = batches_of_documents(spark, folder).groupBy("bucket", "batch").agg(F.sum("prompt_length").alias("used"), (F.count(F.lit(1)) * F.max("prompt_length")).alias("padded"))
    plain = table(spark, folder, "documents").select("doc_id", F.length("text").alias("n"))
    plain = lay_out(plain, [], ["doc_id"]).numbered("at").rows().groupBy(F.floor((F.col("at") - 1) / 48).alias("batch"))
    plain = plain.agg(F.sum("n").alias("used"), (F.count(F.lit(1)) * F.max("n")).alias("padded"))
    share = F.round(1 - F.sum("used") / F.sum("padded"), 9).alias("padding")
    return by_length.agg(share).select(F.lit("by length").alias("kind"), "padding").union(plain.agg(share).select(F.lit("as they come"), "padding"))
