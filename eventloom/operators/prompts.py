"""Prompts from histories: template, length limit, scoring in batches, and parsing of the answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from eventloom.functions.numbers import clamp
from eventloom.functions.rows import computed_once
from eventloom.functions.text import extract_or_null, strip_text, strip_text_end
from eventloom.operators.narrative import TITLE, Pages, cut_texts, last_lines
from eventloom.plans.timeline import Run, Timeline, lay_out, written
from eventloom.session import small_batches
from eventloom.sources.tables import LABEL_COLUMNS

# The prompt and the header at which a history may be cut.
TEMPLATE = """# Patient's Electronic Health Record
{ehr}

# Task
{task_description}

# Response Format
You must respond with the following format. The final answer is either yes or no.

Explanation: Brief explanation of your answer
Answer: Yes/No
Probability: 0-100
"""
AGE_HEADER = r"^## Age \d+ years \d+ days$"

# The patterns of an answer.
THINKING = r"(?s)<think>(.*?)</think>"
EXPLANATION = r"(?isU)Explanation:\s*(.*?)(?=Answer:|Probability:|$)"
ANSWER = r"(?iU)Answer:\s*(Yes|No)"
PROBABILITY = r"(?U)Probability:\s*(\d+)"

TOKEN = r"\s*\S+"
BLANKS = " \t\n\x0b\f\r"  # what \s matches
TAIL_CHARS = 16  # a word with its blanks is rarely longer


def format_prompt(history: Column, task_description: Column, template: str = TEMPLATE) -> Column:
    pieces = re.split(r"(\{ehr\}|\{task_description\})", template)
    values = {"{ehr}": history, "{task_description}": task_description}
    return F.concat(*(values[p] if p in values else F.lit(p) for p in pieces))


def task_table(spark, cohorts: Mapping[str, Mapping]) -> DataFrame:
    """Task names and descriptions of cohort specifications."""
    rows = [(name, spec["description"]) for name, spec in cohorts.items()]
    return spark.createDataFrame(rows, "task string, task_description string")


def with_descriptions(dataset: DataFrame, tasks: DataFrame) -> DataFrame:
    """Add the description of each row's task; rows of unknown tasks are left out.

    The descriptions are few and are broadcast: tasks are as few, and a shuffle would deal all texts of a task to one place.
    """
    return dataset.join(F.broadcast(tasks), "task", "inner")


def unknown_tasks(dataset: DataFrame, tasks: DataFrame) -> DataFrame:
    """Row counts of the tasks that `with_descriptions` leaves out."""
    return dataset.join(F.broadcast(tasks), "task", "left_anti").groupBy("task").agg(F.count(F.lit(1)).alias("n_rows"))


def token_count(text: Column) -> Column:
    """Number of whitespace-separated words. Each becomes one character, which is cheaper than a list of them."""
    return F.length(F.rtrim(F.regexp_replace(text, TOKEN, "x"), F.lit(BLANKS)))


def last_tokens(text: Column, n: Column) -> Column:
    """The text from the n-th last word on; whitespace inside is kept.

    The end of the text is looked at first: with more than n words in it, of which the first may be cut, it has the last n whole.
    """

    def words(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(TOKEN), F.lit(0))

    # bound to lambda variables, the words are found once for all expressions that read them
    end = F.array(words(F.right(text, (n + 1) * TAIL_CHARS)))
    found = F.transform(end, lambda w: F.when(F.size(w) > n, w).otherwise(words(text)))
    kept = F.transform(found, lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - n, F.lit(0)) + 1, n), ""))
    return F.regexp_replace(F.get(kept, F.lit(0)), r"^\s+", "")


def from_age_header(text: Column) -> Column:
    """The text from its first age header on; unchanged without one."""
    return F.regexp_replace(text, rf"(?ms)\A.*?(?={AGE_HEADER})", "")


Wrap = Callable[[Column], Column]


def limited_narratives(
    events: DataFrame | Timeline,
    labels: DataFrame,
    max_prompt_length: int,
    template: str = TEMPLATE,
    wrap: Wrap = lambda prompt: prompt,
    keep: Sequence[str] = (),
    on_null: str = "skip",
) -> DataFrame:
    """`limit_history` over `narratives`, without writing out or counting any full history.

    `labels` need a `task_description`; `keep` names further columns of theirs. Words are counted once per line. The length of
    a history is the running count at its last line; where it must be cut is found by placing the count among the running
    counts of the subject's lines, in the same ordered pass as the next header of a known age. Only the lines that stay
    are then taken from their pages, and only a cut inside a line looks at words again, at most `max_prompt_length` of them
    and those of one line.
    """
    pages = Pages.of(events, on_null, tokens=token_count)
    columns = ["subject_id", "prediction_time", *LABEL_COLUMNS, "task_description", *keep]
    cuts = last_lines(pages, labels.select(*columns))
    left = F.lit(max_prompt_length) - token_count(wrap(format_prompt(F.lit(""), F.col("task_description"), template)))
    fits = len(TITLE.split()) + F.col("__last_tokens") <= left
    cuts = cuts.withColumn("available_tokens", F.when(~fits, left).cast("int"))
    lines = pages.line_rows().select(
        "subject_id", F.col("before").alias("__at"), F.lit(0).alias("__kind"), "line", F.when(F.col("head"), F.col("line")).alias("__head_line")
    )
    dropped = (F.col("__last_tokens") - F.col("available_tokens")).alias("__at")
    asked = cuts.filter("available_tokens > 0").select("subject_id", dropped, F.lit(-1).alias("__kind"), F.struct("*").alias("__row"))
    line = lay_out(lines.unionByName(asked, allowMissingColumns=True), ["subject_id"], ["__at", "__kind"])
    line = line.run(__before=Run("max", F.col("line"))).run(reverse=True, __next=Run("min", F.col("__head_line")))
    header = F.when(F.col("__next") <= F.col("__row.__last"), F.col("__next"))
    found = line.rows().filter("__kind = -1").select("__row.*", header.alias("__header"), "__before")
    whole = cuts.filter("available_tokens IS NULL").withColumns({"__header": F.lit(None).cast("bigint"), "__before": F.lit(None).cast("bigint")})
    spans = written(found.unionByName(whole), "spans")
    texts = cut_texts(pages, spans, F.coalesce("__header", "__before", F.lit(1)))
    kept = strip_text_end(F.col("__text"))
    from_title = F.concat(F.lit(TITLE), kept)
    part = last_tokens(F.when(F.col("__before").isNull(), from_title).otherwise(kept), F.col("available_tokens"))
    text = F.when(F.col("available_tokens").isNull(), from_title).when(F.col("__header").isNotNull(), kept).otherwise(part)
    out = [*columns, "available_tokens"]
    none = cuts.filter("available_tokens <= 0").select(*out, F.lit(None).cast("string").alias("text"))
    return texts.select(*out, text.alias("text")).unionByName(none)


Tokenizer = Callable[[], tuple[Callable[[str], list], Callable[[list], str]]]


def limit_history(
    dataset: DataFrame, max_prompt_length: int | None, template: str = TEMPLATE, text: str = "text", wrap: Wrap = lambda prompt: prompt
) -> DataFrame:
    """Shorten `text` so that the prompt has at most `max_prompt_length` words; adds `available_tokens`.

    A fitting history is unchanged and has a null `available_tokens`. Otherwise the last `available_tokens` words are
    kept and cut forward to the first age header. Rows with nothing left have `available_tokens <= 0` and a null text;
    `rejected` selects them. The length is that of the prompt after `wrap` (a chat wrapper, say).
    """
    if max_prompt_length is None:
        return dataset.withColumn("available_tokens", F.lit(None).cast("int"))
    history, description = F.col(text), F.col("task_description")
    total = token_count(wrap(format_prompt(history, description, template)))
    counted = computed_once(dataset, {"__total": total})
    excess = F.col("__total") - max_prompt_length
    sized = computed_once(counted, {"available_tokens": F.when(excess > 0, token_count(history) - excess)})
    left = F.col("available_tokens")
    shortened = F.when(left.isNull(), history).when(left > 0, from_age_header(last_tokens(history, left)))
    return sized.withColumn(text, shortened).drop("__total")


def limit_history_with(
    dataset: DataFrame,
    max_prompt_length: int,
    tokenizer: Tokenizer,
    template: str = TEMPLATE,
    text: str = "text",
    wrap: Wrap = lambda prompt: prompt,
) -> DataFrame:
    """`limit_history` for an external tokenizer. `tokenizer()` is called once per batch of rows on the executor and
    returns (encode, decode)."""
    small_batches(dataset)
    kind = StructType([StructField("text", StringType()), StructField("available_tokens", IntegerType())])

    @F.pandas_udf(kind)
    def shorten(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode, decode = tokenizer()
        for prompts, histories in batches:
            rows = []
            for prompt, history in zip(prompts, histories, strict=True):
                excess = len(encode(prompt)) - max_prompt_length
                if excess <= 0:
                    rows.append((history, None))
                    continue
                tokens = encode(history)
                left = len(tokens) - excess
                rows.append((decode(tokens[-left:]) if left > 0 else None, left))
            yield pd.DataFrame(rows, columns=["text", "available_tokens"]).astype({"available_tokens": "Int32"})

    prompt = wrap(format_prompt(F.col(text), F.col("task_description"), template))
    cut = dataset.withColumn("__cut", shorten(prompt, F.col(text)))
    left = F.col("__cut.available_tokens")
    shown = F.when(left.isNull(), F.col("__cut.text")).otherwise(from_age_header(F.col("__cut.text")))
    return cut.withColumns({text: shown, "available_tokens": left}).drop("__cut")


def rejected(limited: DataFrame) -> DataFrame:
    """Rows whose prompt cannot fit even without any history."""
    return limited.filter(F.col("available_tokens") <= 0)


def with_prompts(
    dataset: DataFrame,
    max_prompt_length: int | None = None,
    template: str = TEMPLATE,
    tokenizer: Tokenizer | None = None,
    wrap: Wrap = lambda prompt: prompt,
) -> DataFrame:
    """Add `prompt` and its length in characters; rows that cannot fit are left out (see `rejected` and `left_out`).

    Lengths are in words, or in the tokens of `tokenizer`; `wrap` is applied to every prompt and counted.
    """
    limited = _limited(dataset, max_prompt_length, template, tokenizer, wrap)
    fitting = limited.filter(F.col("available_tokens").isNull() | (F.col("available_tokens") > 0))
    prompt = wrap(format_prompt(F.col("text"), F.col("task_description"), template))
    return fitting.drop("available_tokens").withColumn("prompt", prompt).withColumn("prompt_length", F.length("prompt"))


def _limited(dataset: DataFrame, most: int | None, template: str, tokenizer: Tokenizer | None, wrap: Wrap) -> DataFrame:
    if tokenizer is None or most is None:
        return limit_history(dataset, most, template, wrap=wrap)
    return limit_history_with(dataset, most, tokenizer, template, wrap=wrap)


def left_out(
    dataset: DataFrame,
    tasks: DataFrame,
    max_prompt_length: int | None = None,
    template: str = TEMPLATE,
    tokenizer: Tokenizer | None = None,
    wrap: Wrap = lambda prompt: prompt,
) -> DataFrame:
    """How many rows `run_scoring` leaves out for each task: (task, reason, n_rows), for unknown tasks and prompts that cannot fit."""
    unknown = unknown_tasks(dataset, tasks).select("task", F.lit("unknown task").alias("reason"), "n_rows")
    limited = _limited(with_descriptions(dataset, tasks), max_prompt_length, template, tokenizer, wrap)
    unfit = rejected(limited).groupBy("task").agg(F.count(F.lit(1)).alias("n_rows"))
    return unknown.unionByName(unfit.select("task", F.lit("too long").alias("reason"), "n_rows"))


def longest_first(dataset: DataFrame, number: str | None = None, ties: Sequence[str] = ("prompt",)) -> DataFrame:
    """Longest prompts first within each partition, so that batches hold prompts of similar length.

    Equal lengths are ordered by `ties` and then by a hash of the row, so that batches are the same in every run. With
    `number` all prompts are put into one order and numbered from 1 in that column; a large table is divided into ranges.
    """
    ties = [c for c in ties if c in dataset.columns]
    plain = [f.name for f in dataset.schema if f.dataType.typeName() not in ("map", "variant")]
    if number is None:
        return dataset.sortWithinPartitions(F.desc("prompt_length"), *ties, F.xxhash64(*plain))
    hashed = dataset.withColumn("__tie", F.xxhash64(*plain))
    return lay_out(hashed, [], ["-prompt_length", *ties, "__tie"]).numbered(number).rows().drop("__tie").orderBy(number)


def length_bucket(length: Column) -> Column:
    """The length class: four classes between a power of two and the next, so lengths of a class differ by less than a fourth."""
    bits = F.length(F.bin(length)) - 1
    quarter = F.when(bits < 2, 0).otherwise(F.call_function("shiftright", length, F.greatest(bits - 2, F.lit(0))).bitwiseAND(3))
    return (bits * 4 + quarter).cast("int")


def length_batches(dataset: DataFrame, batch_size: int, token_budget: int, ties: Sequence[str] = ("prompt",)) -> DataFrame:
    """Deal prompts into batches of one length class: at most `batch_size` prompts, and as many as the class's largest length
    allows within `token_budget` once padded, but one at least. Adds `bucket`, `batch` and `row`, its place in the batch.

    Batches do not depend on one another, so every length class is numbered apart, longest first, and a class that holds many
    prompts is divided over tasks. Prompts without length have no batch and are left out.
    """
    sized = dataset.filter("prompt_length IS NOT NULL").withColumn("bucket", length_bucket(F.col("prompt_length")))
    line = lay_out(sized, ["bucket"], ["-prompt_length", *ties]).numbered("__n")
    bits, quarter = F.floor(F.col("bucket") / 4).cast("int"), F.col("bucket") % 4
    largest = F.when(bits < 2, F.call_function("shiftleft", F.lit(2), bits) - 1).otherwise(
        F.call_function("shiftleft", quarter + 5, F.greatest(bits - 2, F.lit(0))) - 1
    )
    capacity = F.greatest(F.least(F.lit(batch_size), F.floor(F.lit(token_budget) / F.greatest(largest, F.lit(1)))), F.lit(1))
    place = F.col("__n") - 1
    rows = line.rows().withColumns({"batch": F.floor(place / capacity).cast("bigint"), "row": (place % capacity).cast("bigint")})
    return rows.drop("__n")


def score(
    dataset: DataFrame,
    batch_fn: Callable[[list[str]], Mapping[str, Sequence]],
    columns: str = "model_output string",
    batch_size: int = 48,
    input_column: str = "prompt",
    partitions: int | None = None,
) -> DataFrame:
    """Run a user function over prompts in batches; it returns the new columns, given as a DDL string.

    `partitions` spreads the prompts evenly over that many tasks, for a function far more costly than the shuffle.

    Partitions stream through the function and exactly `batch_size` prompts are handed over at a time, save for the last
    batch of a partition. The function may be non-deterministic, so write the result before using it twice.
    """
    small_batches(dataset)
    added = StructType.fromDDL(columns)
    schema = StructType([*dataset.schema.fields, *added.fields])
    names = added.fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def answered(part: pd.DataFrame) -> pd.DataFrame:
            result = batch_fn(part[input_column].tolist())
            return part.assign(**{name: list(result[name]) for name in names})

        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            whole = len(frame) - len(frame) % batch_size
            for start in range(0, whole, batch_size):
                yield answered(frame.iloc[start : start + batch_size])
            rest = frame.iloc[whole:]
        if rest is not None and len(rest):
            yield answered(rest)

    spread = dataset.repartition(partitions) if partitions else dataset
    return longest_first(spread).mapInPandas(run, schema)


def parse_answers(dataset: DataFrame, column: str = "model_output") -> DataFrame:
    """Add the parsed answer, probability, thinking and explanation; what is absent is null."""
    text = F.col(column)
    digits = F.regexp_replace(extract_or_null(text, PROBABILITY), "^0+(?=.)", "")
    # without leading zeros, more than three digits are above the upper limit
    number = F.when(F.length(digits) > 3, F.lit(100)).otherwise(clamp(digits.try_cast("bigint"), 0, 100))
    return dataset.withColumns({
        "parsed_answer": F.lower(extract_or_null(text, ANSWER)) == "yes",
        "parsed_probability": number.cast("int"),
        "parsed_thinking": strip_text(extract_or_null(text, THINKING)),
        "parsed_explanation": strip_text(extract_or_null(text, EXPLANATION)),
    })


def run_scoring(
    dataset: DataFrame,
    tasks: DataFrame,
    batch_fn: Callable[[list[str]], Mapping[str, Sequence]],
    max_prompt_length: int | None = None,
    batch_size: int = 48,
    columns: str = "model_output string",
    post_process: Callable[[DataFrame], DataFrame] | None = parse_answers,
    template: str = TEMPLATE,
    tokenizer: Tokenizer | None = None,
    wrap: Wrap = lambda prompt: prompt,
) -> DataFrame:
    """Descriptions, prompts, batched scoring, then an optional DataFrame function on the result.

    `left_out` counts the rows of unknown tasks and those whose prompts cannot fit.
    """
    prompts = with_prompts(with_descriptions(dataset, tasks), max_prompt_length, template, tokenizer, wrap)
    scored = score(prompts, batch_fn, columns, batch_size)
    return scored.transform(post_process) if post_process else scored
