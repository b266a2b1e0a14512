import random
import re

import pytest

from eventloom.operators import prompts
from pyspark.sql import functions as F

SHORT = "{ehr} tail"


def limited(spark, text, limit, template=SHORT):
    df = spark.createDataFrame([(text, "d")], "text string, task_description string")
    return prompts.limit_history(df, limit, template).first()


def test_whole_batches_and_long_numbers(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(batch):
        seen.add(1)
        return {"model_output": [f"Probability: {'0' * 21}{len(batch)}" for _ in batch]}

    rows = spark.range(250).selectExpr("id", "cast(id as string) AS prompt", "length(cast(id as string)) AS prompt_length").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    got = prompts.parse_answers(prompts.score(rows, model, batch_size=24)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted({r.parsed_probability for r in got}) == [10, 24] and seen.value == 11


def test_texts_are_not_shuffled_by_task(spark):
    tasks = spark.createDataFrame([("a", "about a")], "task string, task_description string")
    data = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "task string, text string")
    described = prompts.with_descriptions(data, tasks)
    assert "Exchange hashpartitioning" not in described._jdf.queryExecution().executedPlan().toString()
    assert [(r.task, r.text, r.task_description) for r in described.collect()] == [("a", "x", "about a")]
    assert sorted((str(r.task), r.n_rows) for r in prompts.unknown_tasks(data, tasks).collect()) == [("None", 1), ("b", 1)]


def test_tokenizer_gets_few_texts_at_once(spark):
    data = spark.range(1200).selectExpr("cast(id as string) AS text", "'d' AS task_description").coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = prompts.limit_history_with(data, 5, lambda: (str.split, " ".join), "{ehr} tail").collect()
    assert len(got) == 1200
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "500"


def test_fits_and_cuts(spark):
    assert limited(spark, "a b c", 10).text == "a b c" and limited(spark, "a b c", 10).available_tokens is None
    assert limited(spark, "a b c", None).text == "a b c"
    row = limited(spark, "word1 word2 word3 word4 word5", 5, "one {ehr}")
    assert row.text == "word2 word3 word4 word5"
    long = limited(spark, " ".join(["w"] * 100), 50)
    assert len(long.text.split()) + 1 <= 50
    assert limited(spark, "a b c", 1).text is None and limited(spark, "a b c", 1).available_tokens <= 0


def test_cut_starts_at_header(spark):
    text = "x\n## Age 1 years 2 days\na b c\n## Age 3 years 4 days\nd e f"
    assert limited(spark, text, 12).text == "## Age 3 years 4 days\nd e f"
    assert limited(spark, text.replace("3 years 4", "-1 years -1"), 11).text.startswith("c\n## Age -1")
    df = spark.createDataFrame([(text, "d"), ("a b c d e f", "d"), ("a", "d")], "text string, task_description string")
    got = prompts.limit_history_with(df, 5, lambda: (str.split, " ".join), "{ehr} tail").collect()
    assert [r.text for r in got] == ["days d e f", "c d e f", "a"]


def test_prompt_text_and_rejects(spark):
    df = spark.createDataFrame([("H", "hospitalisation"), ("H", "nope")], "text string, task string")
    tasks = spark.createDataFrame([("hospitalisation", "Describe.")], "task string, task_description string")
    described = prompts.with_descriptions(df, tasks)
    row = prompts.with_prompts(described).first()
    assert row.prompt == prompts.TEMPLATE.format(ehr="H", task_description="Describe.") and row.prompt_length == len(row.prompt)
    assert prompts.unknown_tasks(df, tasks).collect()[0].asDict() == {"task": "nope", "n_rows": 1}
    assert prompts.with_prompts(described, 3).count() == 0
    assert prompts.rejected(prompts.limit_history(described, 3)).count() == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<think>a\nb</think> Explanation: x\ny Answer: Yes\nProbability: 70%", (True, 70, "a\nb", "x\ny")),
        ("explanation: z answer: no", (False, None, None, "z")),
        ("answer: yes probability: 50", (True, None, None, None)),
        ("Probability: 250", (None, 100, None, None)),
        ("Probability: " + "9" * 40, (None, 100, None, None)),
        ("Explanation: one\ntwo Probability: 5", (None, 5, None, "one\ntwo")),
        ("Answer: maybe", (None, None, None, None)),
        ("", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_parse(spark, text, want):
    row = prompts.parse_answers(spark.createDataFrame([(text,)], "model_output string")).first()
    assert (row.parsed_answer, row.parsed_probability, row.parsed_thinking, row.parsed_explanation) == want


def test_batches(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("prompt"), F.col("id").alias("prompt_length"))

    def model(batch):
        assert len(batch) <= 7 and [len(p) for p in batch] == sorted((len(p) for p in batch), reverse=True)
        return {"model_output": [str(len(p)) for p in batch], "size": [len(batch)] * len(batch)}

    out = prompts.score(df.coalesce(2), model, "model_output string, size long", batch_size=7).collect()
    assert all(r.model_output == str(r.prompt_length) for r in out) and len(out) == 100 and max(r.size for r in out) == 7


@pytest.mark.parametrize(("size", "budget"), [(3, 10**9), (48, 400), (1, 1), (5, 100)])
def test_batches_of_one_length_class(spark, layout, size, budget):
    rng = random.Random(3)
    lengths = [rng.choice([1, 2, 3, 4, 7, 8, 31, 32, 33, 40, 63, 64, 100, 129]) for _ in range(120)] + [0, None, 100_000]
    rows = [(i, n) for i, n in enumerate(lengths)]
    table = spark.createDataFrame(rows, "id long, prompt_length int")
    found = prompts.length_batches(table, size, budget, ties=["id"]).collect()
    assert sorted(r.id for r in found) == [i for i, n in rows if n is not None]
    batches = {}
    for r in found:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    last = {}
    for (bucket, batch), own in batches.items():
        last[bucket] = max(last.get(bucket, -1), batch)
        own.sort(key=lambda r: r.row)
        assert [r.row for r in own] == list(range(len(own)))
        assert [(-r.prompt_length, r.id) for r in own] == sorted((-r.prompt_length, r.id) for r in own)
        longest, shortest = own[0].prompt_length, own[-1].prompt_length
        assert len(own) == 1 or (len(own) <= size and len(own) * longest <= budget)
        assert longest <= shortest * 1.25 or longest < 8
    for (bucket, batch), own in batches.items():  # only the last batch of a class may be smaller than the others
        if batch < last[bucket]:
            assert len(own) == len(batches[bucket, 0])


def test_numbered_order(spark, layout):
    rows = [(i, n, f"p{i % 3}") for i, n in enumerate([5, 3, 5, 9, 1, 3, 3])]
    table = spark.createDataFrame(rows, "id long, prompt_length int, prompt string")
    got = prompts.longest_first(table, number="position", ties=["prompt", "id"]).collect()
    assert [r.position for r in got] == list(range(1, 8))
    assert [r.id for r in got] == [i for i, n, p in sorted(rows, key=lambda r: (-r[1], r[2], r[0]))]


@pytest.mark.parametrize("words", [["a"] * 9, ["w" * 50] * 9, ["é\U0001f600", "b"] * 5, ["one"], []])
@pytest.mark.parametrize("blank", [" ", "\n \t", "\x0b\f\r", " " * 40])
def test_last_words_and_their_number(spark, words, blank):
    for text in (blank.join(words), blank + blank.join(words) + blank):
        row = spark.range(1).select(
            prompts.token_count(F.lit(text)).alias("n"), *[prompts.last_tokens(F.lit(text), F.lit(n)).alias(f"k{n}") for n in (1, 3, 9, 20)]
        ).first()
        assert row.n == len(words)
        pieces = re.findall(r"\s*\S+", text)
        for n in (1, 3, 9, 20):
            assert row[f"k{n}"] == "".join(pieces[-n:]).lstrip(), (text, n)


def test_words_are_counted_once(spark):
    df = spark.createDataFrame([("a b c " * 40, "t")], "text string, task_description string")
    limited = prompts.limit_history(df, 60).filter("available_tokens IS NULL OR available_tokens > 0")
    plan = limited._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", x, 1)") == 2  # the prompt's words and the history's
    assert len(limited.first().text.split()) == limited.first().available_tokens
