"""Histories as sectioned text: one line per event, headers where age, time or category change, cut at a label's time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import strip_text_end
from eventloom.plans.timeline import Run, Timeline, lay_out, written
from eventloom.sources.tables import LABEL_COLUMNS

# The formats of the text.
TITLE = "# Patient's Electronic Health Record\n\n"
AGE_HEADER = "## Age {} years {} days\n"
TIME_HEADER = "### {}\n"
CATEGORY_HEADER = "#### {}\n"
KNOWN_AGE = r"^## Age \d+ years \d+ days\n"  # a line that opens the section of a known age
NO_TIME = "Time Unspecified"
NO_AGE = -1

LINES_PER_PAGE = 50_000  # bounds the arrays of a page


NO_LINE = "code IS NULL OR prefix IS NULL"


def filled(template: str, *values: Column) -> Column:
    """A template with its `{}` replaced; null when any value is null."""
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def render_lines(timeline: Timeline, on_null: str = "skip") -> Timeline:
    """Add `line` to every event that has a time, a code and a category.

    An event without a code or category is left out before headers are set, so it neither opens nor swallows one
    (`without_line` selects such events); `on_null='fail'` raises instead. Rows must have been filtered before: the headers
    depend on the previous remaining row.
    """
    if on_null not in ("skip", "fail"):
        raise ValueError("on_null must be 'skip' or 'fail'")
    shown = F.struct(
        F.coalesce("age_year", F.lit(NO_AGE)).alias("y"),
        F.coalesce("age_day", F.lit(NO_AGE)).alias("d"),
        F.coalesce("time_of_day", F.lit(NO_TIME)).alias("t"),
        F.col("prefix").alias("p"),
    )
    shows = F.col("time").isNotNull() if on_null == "fail" else F.col("time").isNotNull() & ~F.expr(NO_LINE)
    timed = timeline.pipe(lambda df: df.filter(shows).withColumn("__now", shown))
    seen = timed.run(__before=Run("lag", F.col("__now")))

    def now(field: str) -> Column:
        return F.col(f"__now.{field}")

    def changed(field: str) -> Column:
        return ~now(field).eqNullSafe(F.col(f"__before.{field}")) | now(field).isNull()

    age = changed("y") | changed("d")
    section = age | changed("t")
    empty = F.lit("")
    line = F.concat(
        F.when(age, filled(AGE_HEADER, now("y"), now("d"))).otherwise(empty),
        F.when(section, filled(TIME_HEADER, now("t"))).otherwise(empty),
        F.when(section | changed("p"), filled(CATEGORY_HEADER, now("p"))).otherwise(empty),
        filled("{}\n", F.col("code")),
    )
    if on_null == "fail":
        line = F.coalesce(line, F.raise_error(F.lit("an event without code or category cannot be rendered")))
    return seen.pipe(lambda df: df.withColumn("line", line).drop("__now", "__before"))


def without_line(events: DataFrame | Timeline) -> DataFrame:
    """Events that have a time but no line, as they have no code or no category."""
    rows = events.rows() if isinstance(events, Timeline) else events
    return rows.filter(F.col("time").isNotNull() & F.expr(NO_LINE))


def history_text(lines: Column) -> Column:
    return F.concat(F.lit(TITLE), strip_text_end(F.array_join(lines, "")))


def as_timeline(events: DataFrame | Timeline) -> Timeline:
    """Events in the order of `event_seq`."""
    return events if isinstance(events, Timeline) else lay_out(events, ["subject_id"], ["event_seq"])


@dataclass(frozen=True)
class Pages:
    """The lines of all subjects, stored once as pages of `size` numbers of `event_seq`, so of at most as many lines.

    A row holds subject_id, page, text, and per line of the page: `lines`, its `event_seq`, `times`, and `chars` and (when asked for) `tokens`, the
    characters and tokens of the subject's lines up to and including it, and `heads`, whether it opens the section of a known age.
    `chars_before` and `tokens_before` count those of the earlier pages. So any run of lines is a substring of a page's text,
    and its length in characters and tokens a difference, without another look at the text.
    """

    table: DataFrame
    size: int

    @classmethod
    def of(cls, events: DataFrame | Timeline, on_null: str = "skip", size: int | None = None, tokens: Callable[[Column], Column] | None = None) -> Pages:
        """Render the events and store their lines. `tokens` counts the tokens of a line; they must add up over lines."""
        size = LINES_PER_PAGE if size is None else size
        counted = {"__tokens": F.lit(0) if tokens is None else tokens(F.col("line")), "__chars": F.length("line")}
        lines = render_lines(as_timeline(events), on_null).pipe(lambda df: df.withColumns({n: c.cast("bigint") for n, c in counted.items()}))
        lines = lines.run(__chars_upto=Run("sum", F.col("__chars")), __tokens_upto=Run("sum", F.col("__tokens")))
        head = F.col("line").rlike(KNOWN_AGE)
        entry = F.struct(
            F.col("event_seq").alias("n"), "time", "line", F.col("__chars_upto").alias("chars"), F.col("__tokens_upto").alias("tokens"), head.alias("head")
        )
        first = {"chars_before": "__chars_upto - __chars", "tokens_before": "__tokens_upto - __tokens"}

        def page(df: DataFrame) -> DataFrame:
            groups = df.groupBy("subject_id", _page(F.col("event_seq"), size).alias("page"))
            return groups.agg(F.sort_array(F.collect_list(entry)).alias("e"), *[F.min(F.expr(v)).alias(k) for k, v in first.items()])

        arrays = {
            "text": _text(F.col("e")),
            "lines": F.transform("e", lambda e: e["n"]),
            "times": F.transform("e", lambda e: e["time"]),
            "chars": F.transform("e", lambda e: e["chars"]),
            "tokens": F.transform("e", lambda e: e["tokens"]),
            "heads": F.transform("e", lambda e: e["head"]),
        }
        table = lines.gather(page).select("subject_id", "page", *[c.alias(n) for n, c in arrays.items()], *first)
        return cls(written(table, "pages"), size)

    def line_rows(self) -> DataFrame:
        """One narrow row per line: subject_id, line (its `event_seq`), time, tokens up to it, the tokens before it, head."""
        entries = F.posexplode(F.arrays_zip("lines", "times", "tokens", "heads")).alias("at", "e")
        rows = self.table.select("subject_id", "page", "tokens", "tokens_before", entries)
        before = F.when(F.col("at") == 0, F.col("tokens_before")).otherwise(F.get("tokens", F.col("at") - 1))
        return rows.select(
            "subject_id", F.col("e.lines").alias("line"), F.col("e.times").alias("time"),
            F.col("e.tokens").alias("tokens"), before.alias("before"), F.col("e.heads").alias("head"),
        )

    def part(self, first: Column, last: Column) -> Column:
        """The text of the lines from `first` to `last` that lie on the row's page."""
        skipped, stop = F.size(F.filter("lines", lambda n: n < first)), F.size(F.filter("lines", lambda n: n <= last))
        start = F.when(skipped == 0, 0).otherwise(F.get("chars", skipped - 1) - F.col("chars_before")).cast("int")
        return F.substring("text", start + 1, (F.get("chars", stop - 1) - F.col("chars_before")).cast("int") - start)


def _page(line: Column, size: int) -> Column:
    return F.floor((line - 1) / size).cast("bigint")


def _text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda e: e["line"]), "")


def patient_texts(events: DataFrame | Timeline, on_null: str = "skip") -> DataFrame:
    """The whole history of every subject as one text."""
    pages = Pages.of(events, on_null).table
    pieces = F.sort_array(F.collect_list(F.struct("page", F.col("text").alias("t"))))
    whole = pages.groupBy("subject_id").agg(pieces.alias("__pieces"))
    return whole.select("subject_id", history_text(F.transform("__pieces", lambda e: e["t"])).alias("text"))


def last_lines(pages: Pages, labels: DataFrame) -> DataFrame:
    """The rows of `labels` with `__label`, a number of their own, `__last`, the last line up to and including the prediction
    time, and `__last_tokens`, the tokens up to it. Labels without any earlier line are left out.

    The labels are placed among the lines' times and one ordered pass gives each the lines before it, so no label meets a
    line of its subject one by one. The result is stored.
    """
    columns = labels.columns
    lines = pages.line_rows().select("subject_id", F.col("time").alias("__time"), F.lit(0).alias("__kind"), "line", F.col("tokens").alias("__upto"))
    numbered = labels.withColumn("__label", F.monotonically_increasing_id())
    probes = numbered.select(
        "subject_id", F.col("prediction_time").alias("__time"), F.lit(1).alias("__kind"), F.struct("__label", *columns).alias("__row")
    ).filter("__time IS NOT NULL")
    line = lay_out(lines.unionByName(probes, allowMissingColumns=True), ["subject_id"], ["__time", "__kind"])
    seen = line.run(__last=Run("max", F.col("line")), __last_tokens=Run("max", F.col("__upto"))).rows()
    found = seen.filter("__kind = 1 AND __last IS NOT NULL")
    return written(found.select("__row.*", "__last", "__last_tokens"), "last-lines")


def cut_texts(pages: Pages, cuts: DataFrame, first: Column) -> DataFrame:
    """`cuts` (from `last_lines`) with `__text`, the lines from `first` to `__last`.

    Each row meets the pages it needs by an equi-join on (subject, page). Most need one page; the pieces of the others are put
    together per label, which is the size of the result.
    """
    spans = cuts.withColumns({"__first": first, "__from": _page(first, pages.size), "__to": _page(F.col("__last"), pages.size)})
    text = pages.part(F.col("__first"), F.col("__last"))
    one = spans.filter("__from = __to").withColumn("page", F.col("__to")).join(pages.table, ["subject_id", "page"])
    one = one.select(*cuts.columns, text.alias("__text"))
    more = spans.filter("__from < __to").withColumn("page", F.explode(F.sequence("__from", "__to"))).join(pages.table, ["subject_id", "page"])
    pieces = F.sort_array(F.collect_list(F.struct("page", text.alias("t"))))
    own = F.first(F.struct(*[c for c in cuts.columns if c != "__label"])).alias("__row")
    more = more.groupBy("__label").agg(own, pieces.alias("__pieces"))
    more = more.select("__label", "__row.*", F.array_join(F.transform("__pieces", lambda e: e["t"]), "").alias("__text"))
    return one.unionByName(more)


def narratives(
    events: DataFrame | Timeline, labels: DataFrame, keep: Sequence[str] = (), on_null: str = "skip"
) -> DataFrame:
    """One text per label: the subject's history up to and including the prediction time.

    Lines are rendered once per event and stored as pages; a history is its subject's pages up to the label's last line, of
    which one page is cut, so headers stay right. Equal label rows give a text each. Labels without any earlier event are
    left out. `keep` names further label columns (task, split, shard).
    """
    pages = Pages.of(events, on_null)
    cuts = last_lines(pages, labels.select("subject_id", "prediction_time", *LABEL_COLUMNS, *keep))
    texts = cut_texts(pages, cuts, F.lit(1))
    return texts.select("subject_id", "prediction_time", history_text(F.array("__text")).alias("text"), *LABEL_COLUMNS, *keep)


def paged_histories(
    events: DataFrame | Timeline, labels: DataFrame, lines_per_page: int = 10_000, on_null: str = "skip"
) -> tuple[DataFrame, DataFrame]:
    """The same histories without a repeated page, for histories too long for one text value.

    The first table has (subject_id, page, text), each page once. The second has each label with `page` and `text`, its last
    page up to its last line. A label's history is the pages of its subject before that one, then that text.
    """
    pages = Pages.of(events, on_null, lines_per_page)
    cuts = last_lines(pages, labels.select("subject_id", "prediction_time", *LABEL_COLUMNS))
    at = cuts.withColumn("page", _page(F.col("__last"), lines_per_page)).join(pages.table, ["subject_id", "page"])
    ends = at.select("subject_id", "prediction_time", *LABEL_COLUMNS, "page", pages.part(F.lit(1), F.col("__last")).alias("text"))
    return pages.table.select("subject_id", "page", "text"), ends


def narrative_pages(
    events: DataFrame | Timeline, labels: DataFrame, lines_per_page: int = 10_000, on_null: str = "skip"
) -> DataFrame:
    """(label, page, text) rows: the pages of `paged_histories` spelled out for each label."""
    pages = Pages.of(events, on_null, lines_per_page)
    cuts = last_lines(pages, labels.select("subject_id", "prediction_time", *LABEL_COLUMNS))
    spans = cuts.withColumn("page", F.explode(F.sequence(F.lit(0).cast("bigint"), _page(F.col("__last"), lines_per_page))))
    joined = spans.join(pages.table, ["subject_id", "page"])
    return joined.select("subject_id", "prediction_time", *LABEL_COLUMNS, "page", pages.part(F.lit(1), F.col("__last")).alias("text"))


EVENTS_PER_SECTION = 1_000


def events_before(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Every event paired with each label of its subject whose time has not passed.

    Events are numbered in time order and cut into sections. A label learns its last event from one ordered pass and meets
    the sections up to it by an equi-join on (subject, section), so no pair is formed that is not returned but those of one
    section, and a subject with many events and labels is spread over many tasks.
    """
    numbered = lay_out(events.filter("time IS NOT NULL"), ["subject_id"], ["time"]).numbered("__n")
    stored = written(numbered.rows().withColumn("__section", _page(F.col("__n"), EVENTS_PER_SECTION)), "numbered-events")
    probes = labels.select("subject_id", F.col("prediction_time").alias("__time"), F.lit(1).alias("__kind"), F.struct(*labels.columns).alias("__row"))
    times = stored.select("subject_id", F.col("time").alias("__time"), F.lit(0).alias("__kind"), "__n")
    line = lay_out(times.unionByName(probes, allowMissingColumns=True), ["subject_id"], ["__time", "__kind"])
    cuts = line.run(__last=Run("max", F.col("__n"))).rows().filter("__kind = 1 AND __time IS NOT NULL AND __last IS NOT NULL")
    sections = F.sequence(F.lit(0).cast("bigint"), _page(F.col("__last"), EVENTS_PER_SECTION))
    spans = cuts.select("__row.*", "__last", F.explode(sections).alias("__section"))
    return spans.join(stored, ["subject_id", "__section"]).filter(F.col("__n") <= F.col("__last")).drop("__section", "__last", "__n")


def labelled_subjects(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events of subjects that have a label, reduced before anything else is computed."""
    return events.join(labels.select("subject_id").distinct(), "subject_id", "left_semi")


def training_rows(dataset: DataFrame, task_text: str) -> DataFrame:
    """Subject, text with the task appended, and label."""
    return dataset.select(
        "subject_id", F.concat("text", F.lit(task_text)).alias("text"), F.col("boolean_value").alias("label")
    )
