"""Cohort labelling: named predicates, a trigger, windows bounded by events or durations, one label per trigger.

All lookups along a subject's history are done by placing probe rows among the event rows, ordering the union once and
running an aggregate over it. There is no range join, so the cost is linear in the history whatever the window lengths.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import unicode_regex
from eventloom.plans.timeline import Layout, Run, lay_out, layout_of, written

UNITS = {"h": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400, "m": 60, "min": 60, "minutes": 60}


def predicate_column(spec: Mapping) -> Column:
    """True where an event satisfies a predicate: each constrained column equals a text or contains a regex match."""
    hit = F.lit(True)
    for name, wanted in spec.items():
        if isinstance(wanted, Mapping):
            hit = hit & F.col(name).rlike(unicode_regex(wanted["regex"]))
        else:
            hit = hit & (F.col(name) == wanted)
    return F.coalesce(hit, F.lit(False))


def evaluate_predicates(df: DataFrame, predicates: Mapping[str, Mapping]) -> DataFrame:
    """Add one boolean column per predicate."""
    return df.withColumns({name: predicate_column(spec) for name, spec in predicates.items()})


def predicate_counts(df: DataFrame, predicates: Mapping[str, Mapping]) -> DataFrame:
    """How often each predicate holds per subject and time; only times at which one holds.

    Rows that satisfy nothing are dropped in the scan and counting is combined before the shuffle.
    """
    flags = evaluate_predicates(df.filter(F.col("time").isNotNull()), predicates)
    anything = F.greatest(*predicates) if len(predicates) > 1 else F.col(next(iter(predicates)))
    counts = [F.sum(F.col(name).cast("bigint")).alias(name) for name in predicates]
    return flags.filter(anything).groupBy("subject_id", "time").agg(*counts)


@dataclass(frozen=True)
class History:
    """Predicate counts per subject and time, with the layout decided once for all lookups."""

    counts: DataFrame
    layout: Layout

    @classmethod
    def of(cls, counts: DataFrame) -> History:
        """The counts are read once per lookup, so they are written first: the events are scanned a single time."""
        counts = written(counts, "predicates")
        return cls(counts, layout_of(counts, ["subject_id"]))

    def _union(self, values: dict[str, Column], probes: DataFrame):
        """Event rows (`__kind` 0) and probe rows of a subject in time order."""
        events = self.counts.select("subject_id", F.col("time").alias("__time"), F.lit(0).alias("__kind"), *(
            v.alias(k) for k, v in values.items()))
        both = events.unionByName(probes, allowMissingColumns=True)
        return lay_out(both, ["subject_id"], ["__time", "__kind"], self.layout)

    def next_time(self, points: DataFrame, start: str, predicate: str, name: str) -> DataFrame:
        """Add the first time strictly after `start` at which the predicate holds; null if there is none."""
        payload = F.struct(*points.columns)
        probes = points.select("subject_id", F.col(start).alias("__time"), F.lit(1).alias("__kind"), payload.alias("__row"))
        hit = F.when(F.col(predicate) > 0, F.col("time"))
        line = self._union({"__hit": hit}, probes).run(reverse=True, **{name: Run("min", F.col("__hit"))})
        return line.rows().filter("__kind = 1").select("__row.*", name)

    def count_between(
        self, points: DataFrame, start: str | None, end: str, predicate: str, name: str, inclusive=(True, True)
    ) -> DataFrame:
        """Add the number of predicate events between two time columns, as a difference of running counts.

        A probe sorts before the events of its own time to leave them out and after them to take them in.
        """
        payload = F.struct(*points.columns)
        ends = [("end", end, 1 if inclusive[1] else -1, 1)]
        if start is not None:
            ends.append(("start", start, -1 if inclusive[0] else 1, -1))
        sides = F.array(*(
            F.struct(F.col(c).alias("at"), F.lit(kind).alias("kind"), F.lit(sign).alias("sign")) for _, c, kind, sign in ends
        ))
        probes = points.select("subject_id", payload.alias("__row"), F.explode(sides).alias("__side")).select(
            "subject_id", F.col("__side.at").alias("__time"), F.col("__side.kind").alias("__kind"),
            "__row", F.col("__side.sign").alias("__sign"),
        )
        line = self._union({"__n": F.col(predicate)}, probes).run(__seen=Run("sum", F.col("__n")))
        signed = F.coalesce(F.col("__seen"), F.lit(0)) * F.col("__sign")
        sides_seen = line.rows().filter("__kind != 0").select("__row.*", signed.alias("__signed"))
        return sides_seen.groupBy(*points.columns).agg(F.sum("__signed").alias(name))


def duration_seconds(text: str) -> int:
    total = 0
    parts = re.findall(r"(\d+)\s*([A-Za-z]+)", text)
    if not parts:
        raise ValueError(f"not a duration: {text!r}")
    for amount, unit in parts:
        if unit not in UNITS:
            raise ValueError(f"unknown unit in {text!r}")
        total += int(amount) * UNITS[unit]
    return total


def label_cohort(events: DataFrame, spec: Mapping) -> DataFrame:
    """Label table of one cohort specification.

    One row per subject and trigger time. `start -> p` ends at the first time strictly after the start at which `p`
    holds, and rows without one are dropped. `start + d` ends a fixed time later. The label is true when the label
    predicate occurs in its window, boundaries counted as the inclusivity flags say. The prediction time is the window
    side named by `index_timestamp`.
    """
    return label_cohorts(events, {"cohort": spec}).drop("task")


@dataclass(frozen=True)
class Windows:
    """A specification's windows with all references resolved.

    `steps` add time columns in order: (name, "next", start, predicate) or (name, "plus", start, seconds). The label counts
    `predicate` from `start` (None: the record's start) to `end`.
    """

    steps: list[tuple[str, str, str, str | int]]
    index: str
    start: str | None
    end: str
    predicate: str
    inclusive: tuple[bool, bool]

    @classmethod
    def of(cls, spec: Mapping) -> Windows:
        bounds: dict[tuple[str, str], str | None] = {}  # (window, side) -> time column, None for the record's start

        def plain(reference: str | None) -> str | None:
            if reference is None or reference == "trigger":
                return reference
            window, side = reference.split(".")
            return bounds[window, side]

        steps, index, label = [], None, None
        for window, rule in spec["windows"].items():
            start, end, name = plain(rule.get("start")), rule["end"], f"{window}_end"
            bounds[window, "start"], bounds[window, "end"] = start, name
            if "->" in end:
                if start is None:
                    raise ValueError(f"window {window}: an event-bounded end needs a start")
                steps.append((name, "next", start, end.split("->")[1].strip()))
            elif "+" in end:
                steps.append((name, "plus", start, duration_seconds(end.split("+")[1])))
            else:
                bounds[window, "end"] = plain(end)
            if rule.get("index_timestamp"):
                index = bounds[window, rule["index_timestamp"]]
            if rule.get("label"):
                inclusive = (rule.get("start_inclusive", True), rule.get("end_inclusive", True))
                label = (bounds[window, "start"], bounds[window, "end"], rule["label"], inclusive)
        if index is None:
            raise ValueError("no window names an index_timestamp that is a time of the record")
        if label is None:
            raise ValueError("no window names a label")
        return cls(steps, index, *label)

    def sides(self, at: Mapping[str, Column]) -> list[tuple[Column, int, int]]:
        """(time, kind, sign) of the probes whose signed running counts add up to the label's count.

        A probe of kind -1 sorts before the events of its own time, one of kind 1 after them.
        """
        out = [(at[self.end], 1 if self.inclusive[1] else -1, 1)]
        if self.start is not None:
            out.append((at[self.start], -1 if self.inclusive[0] else 1, -1))
        return out


def _later(time: Column, seconds: int) -> Column:
    return time + F.make_dt_interval(secs=F.lit(seconds))


def _label_table(rows: DataFrame, index: Column, hits: Column, *first: Column) -> DataFrame:
    return rows.select(
        *first,
        "subject_id",
        index.alias("prediction_time"),
        (hits > 0).alias("boolean_value"),
        F.lit(None).cast("bigint").alias("integer_value"),
        F.lit(None).cast("double").alias("float_value"),
        F.lit(None).cast("string").alias("categorical_value"),
    )


def label_cohorts(events: DataFrame, specs: Mapping[str, Mapping]) -> DataFrame:
    """Several cohorts in one table with a `task` column.

    The predicates of all cohorts are evaluated in a single pass over the events. A window that ends at an event depends on
    the window that it starts at, and so on down to the trigger; the windows of all cohorts are answered level by level. The
    first level gives every time of a subject the next times of all predicates that end windows there; each further level is
    one ordered union of the events with the starts of all its windows. At the end the labels of all cohorts are counted
    together. A level costs at most two exchanges on the subject, whatever the number of cohorts.
    """
    flat = {f"{task}__{name}": rule for task, spec in specs.items() for name, rule in spec["predicates"].items()}
    windows = [Windows.of(spec) for spec in specs.values()]
    history = History.of(predicate_counts(events, flat))
    triggers = [f"{task}__{spec['trigger']}" for task, spec in specs.items()]
    return _label_levels(history, list(specs), windows, triggers)


def _level_steps(tasks: Sequence[str], windows: Sequence[Windows]) -> list[list[tuple[int, int, str, int, str | int]]]:
    """Per level (task number, place, kind, place of the start, predicate or seconds). Place 0 is the trigger."""
    levels: list[list[tuple[int, int, str, int, str | int]]] = [[], []]
    for number, (task, own) in enumerate(zip(tasks, windows, strict=True)):
        place, level = {"trigger": 0}, {"trigger": 0}
        for name, kind, start, value in own.steps:
            if start is None:
                raise ValueError(f"{task}: {name} is counted from the start of the record")
            place[name] = len(place)
            level[name] = level[start] + (kind == "next")
            levels += [[] for _ in range(len(levels), level[name] + 1)]
            levels[level[name]].append((number, place[name], kind, place[start], f"{task}__{value}" if kind == "next" else value))
    return levels


def _label_levels(history: History, tasks: list[str], windows: list[Windows], triggers: list[str]) -> DataFrame:
    levels = _level_steps(tasks, windows)
    width = 1 + max(len(own.steps) for own in windows)
    ends = sorted({step[4] for step in levels[1] if step[2] == "next"})
    runs = {f"__next_{p}": Run("min", F.when(F.col(p) > 0, F.col("time")), strict=True) for p in ends}
    line = lay_out(history.counts, ["subject_id"], ["time"], history.layout)
    rows = (line.run(reverse=True, **runs) if runs else line).rows()
    entries = []
    for number, trigger in enumerate(triggers):
        at, begun = {0: F.col("time")}, F.col(trigger) > 0
        for task, place, kind, start, value in levels[0] + levels[1]:
            if task == number:
                at[place] = F.col(f"__next_{value}") if kind == "next" else _later(at[start], value)
                begun = begun & at[place].isNotNull()
        times = F.array(*[at.get(place, F.lit(None)) for place in range(width)])
        entries.append(F.when(begun, F.struct(F.lit(number).alias("task"), F.col("time").alias("trigger"), times.alias("at"))))
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    points = rows.select("subject_id", F.explode(found).alias("p")).select("subject_id", "p.*")
    for steps in levels[2:]:
        points = _answer_level(history, points, steps)

    def sides(own: Windows) -> Column:
        place = {"trigger": 0} | {name: i + 1 for i, (name, *_) in enumerate(own.steps)}
        at = {name: F.get("at", F.lit(i)) for name, i in place.items()}
        probes = [F.struct(t.alias("at"), F.lit(k).alias("kind"), F.lit(sign).alias("sign")) for t, k, sign in own.sides(at)]
        return F.struct(at[own.index].alias("index"), F.array(*probes).alias("sides"))

    told = points.select("subject_id", "task", "trigger", _own([sides(own) for own in windows]).alias("s"))
    probes = told.select("subject_id", F.struct("task", "trigger", "s.index").alias("__row"), F.explode("s.sides").alias("s")).select(
        "subject_id", "__row", F.col("s.at").alias("__time"), F.col("s.kind").alias("__kind"), F.col("s.sign").alias("__sign")
    )
    counted = [f"{task}__{own.predicate}" for task, own in zip(tasks, windows, strict=True)]
    both = history._union({f"__n_{p}": F.col(p) for p in sorted(set(counted))}, probes)
    seen = both.run(**{f"__seen_{p}": Run("sum", F.col(f"__n_{p}")) for p in sorted(set(counted))})
    own_count = F.coalesce(_own([F.col(f"__seen_{p}") for p in counted], "__row.task"), F.lit(0))

    def total(part: DataFrame) -> DataFrame:
        seen_there = part.filter("__kind != 0").select("subject_id", "__row.*", (own_count * F.col("__sign")).alias("__signed"))
        return seen_there.groupBy("subject_id", "task", "trigger", "index").agg(F.sum("__signed").alias("__label"))

    name = F.element_at(F.array(*map(F.lit, tasks)), F.col("task") + 1).alias("task")
    return _label_table(seen.gather(total), F.col("index"), F.col("__label"), name)


def _own(values: Sequence[Column], task: str = "task") -> Column:
    """Of one value per task that of the row's task."""
    return F.coalesce(*(F.when(F.col(task) == i, value) for i, value in enumerate(values)))


def _answer_level(history: History, points: DataFrame, steps: Sequence[tuple[int, int, str, int, str | int]]) -> DataFrame:
    """`points` (subject_id, task, trigger, at) with the times of one level; points that lack one of their times go."""
    nexts = [step for step in steps if step[2] == "next"]
    ends = sorted({step[4] for step in nexts})
    entries = [
        F.when(F.col("task") == task, F.struct(F.lit(place).alias("place"), F.get("at", F.lit(start)).alias("from"), F.lit(ends.index(end)).alias("end")))
        for task, place, _, start, end in nexts
    ]
    # a point without a question here travels along with one that fills no place
    asked = F.col("task").isin(sorted({step[0] for step in nexts}))
    passing = F.when(~asked, F.struct(F.lit(-1).alias("place"), F.col("trigger").alias("from"), F.lit(0).alias("end")))
    wanted = F.explode(F.filter(F.array(*entries, passing), lambda e: e.isNotNull())).alias("e")
    probes = points.select("subject_id", F.struct("task", "trigger", "at").alias("__row"), wanted)
    probes = probes.select(
        "subject_id", "__row", F.col("e.from").alias("__time"), F.lit(1).alias("__kind"), F.col("e.place").alias("__place"), F.col("e.end").alias("__end")
    )
    line = history._union({f"__hit_{i}": F.when(F.col(p) > 0, F.col("time")) for i, p in enumerate(ends)}, probes)
    line = line.run(reverse=True, **{f"__next_{i}": Run("min", F.col(f"__hit_{i}")) for i in range(len(ends))})
    found = _own([F.col(f"__next_{i}") for i in range(len(ends))], "__end")

    def together(part: DataFrame) -> DataFrame:
        answers = part.filter("__kind = 1").select("subject_id", "__row.*", F.struct("__place", found.alias("time")).alias("answer"))
        own = F.map_from_entries(F.collect_list("answer")).alias("answers")
        return answers.groupBy("subject_id", "task", "trigger").agg(F.first("at").alias("at"), own)

    def filled(at: Column, values: Column) -> Column:
        return F.transform(at, lambda t, i: F.coalesce(t, F.element_at(values, i)))

    answered = line.gather(together).withColumn("at", filled(F.col("at"), F.col("answers"))).drop("answers")
    for task, place, kind, start, value in steps:
        if kind == "plus":
            later = F.create_map(F.lit(place), F.when(F.col("task") == task, _later(F.get("at", F.lit(start)), value)))
            answered = answered.withColumn("at", filled(F.col("at"), later))
    whole = [(F.col("task") != task) | F.get("at", F.lit(place)).isNotNull() for task, place, *_ in steps]
    return answered.filter(functools.reduce(Column.__and__, whole))


def combine_labels(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("subject_id", "prediction_time")) -> DataFrame:
    """Labels present in both tables, true when either is. Three-valued: true or null is true, false or null is null."""
    other = right.select(*keys, F.col("boolean_value").alias("__other"))
    joined = left.join(other, list(keys), "inner")
    return joined.withColumn("boolean_value", F.col("boolean_value") | F.col("__other")).drop("__other").select(*left.columns)


LABEL_KEYS = ["split", "shard", "subject_id", "prediction_time"]


def _fingerprints(labels: DataFrame) -> DataFrame:
    """Per task and shard the number of keys and sums of two hashes of them, whatever their order; stored, as it is small.

    The halves of a hash are added up apart, so a sum stays within 64 bits for some four billion keys of a shard.
    """
    sums = []
    for i in range(2):
        number = F.xxhash64(F.lit(i), *LABEL_KEYS)
        sums += [F.sum(number.bitwiseAND(0xFFFFFFFF)).alias(f"low_{i}"), F.sum(F.shiftrightunsigned(number, 32)).alias(f"high_{i}")]
    counted = labels.filter("task IS NOT NULL").groupBy("task", "split", "shard").agg(F.count(F.lit(1)).alias("n"), *sums)
    return written(counted, "fingerprints")


def _missing_keys(labels: DataFrame, first: str, shards: DataFrame) -> DataFrame:
    """How many keys of the reference each task lacks, in the given (task, split, shard) only."""
    where = shards.select(*[F.col(c).alias(f"__{c}") for c in ("task", "split", "shard")])
    there = F.col("split").eqNullSafe(F.col("__split")) & F.col("shard").eqNullSafe(F.col("__shard"))
    own = labels.join(where, there & (F.col("task") == F.col("__task")))
    reference = labels.filter(F.col("task") == first).join(where, there)
    is_own = F.when(F.col("task") == F.col("__task"), 1).otherwise(0)
    keys = own.unionByName(reference).groupBy("__task", *LABEL_KEYS).agg(F.sum(1 - is_own).alias("r"), F.sum(is_own).alias("t"))
    return keys.groupBy("__task", "split", "shard").agg(F.sum(F.greatest(F.col("r") - F.col("t"), F.lit(0))).alias("only")).select(
        F.col("__task").alias("task"), "split", "shard", "only"
    )


def validate_labels(labels: DataFrame, reference_task: str | None = None) -> DataFrame:
    """One verdict per other task and shard of the reference task (the first by name): ok, missing or mismatch.

    Shards are compared by their fingerprints, one small aggregate. Keys are exchanged only for the shards of a task that
    hold keys but not those of the reference, in order to count the ones that it lacks. Two shards with equal fingerprints
    are taken for equal.
    """
    prints = _fingerprints(labels.select("task", *LABEL_KEYS))
    names = sorted(r.task for r in prints.select("task").distinct().collect())  # one name per task
    first = reference_task or (names[0] if names else None)
    others = F.array(*[F.lit(name) for name in names if name != first]).cast("array<string>")
    values = [c for c in prints.columns if c not in ("task", "split", "shard")]
    reference = prints.filter(F.col("task") == F.lit(first)).select("split", "shard", *[F.col(c).alias(f"ref_{c}") for c in values])
    reference = reference.withColumn("task", F.explode(others))
    own = prints.select(*[F.col(c).alias(f"own_{c}") for c in prints.columns])
    same_shard = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in ("task", "split", "shard")]
    pairs = reference.join(own, functools.reduce(Column.__and__, same_shard), "left")
    n_task = F.coalesce("own_n", F.lit(0)).cast("bigint")
    equal = functools.reduce(Column.__and__, [F.col(f"ref_{c}").eqNullSafe(F.col(f"own_{c}")) for c in values])
    pairs = pairs.select("task", "split", "shard", F.col("ref_n").alias("n_reference"), n_task.alias("n_task"), equal.alias("equal"))
    unequal = pairs.filter("n_task > 0 AND NOT equal")
    known = F.when(F.col("n_task") == 0, F.col("n_reference")).when(F.col("equal"), 0)
    if not unequal.isEmpty():
        counted = _missing_keys(labels.select("task", *LABEL_KEYS), first, unequal).select(
            *[F.col(c).alias(f"of_{c}") for c in ("task", "split", "shard")], "only"
        )
        here = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in ("task", "split", "shard")]
        pairs = pairs.join(counted, functools.reduce(Column.__and__, here), "left")
        known = F.coalesce(known, "only")
    rows = pairs.withColumn("n_only_in_reference", known.cast("bigint"))
    verdict = (
        F.when(F.col("n_task") == 0, "missing")
        .when((F.col("n_only_in_reference") == 0) & (F.col("n_task") == F.col("n_reference")), "ok")
        .otherwise("mismatch")
    )
    return rows.select("task", "split", "shard", verdict.alias("status"), "n_reference", "n_task", "n_only_in_reference")


def labels_are_valid(labels: DataFrame, reference_task: str | None = None) -> bool:
    """False when there are no labels or some shard differs from the reference; true for a single task."""
    if labels.isEmpty():
        return False
    return validate_labels(labels, reference_task).filter("status != 'ok'").isEmpty()


def keys_without_partner(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of `left` that `right` lacks, one row for each row of `left`."""
    return left.select(*keys).join(right.select(*keys), list(keys), "left_anti")


def mismatched_keys(labels: DataFrame, task: str, reference_task: str, n: int | None = 5) -> DataFrame:
    """Reference keys that another task lacks, in key order; the report shows the first five."""
    missing = keys_without_partner(labels.filter(F.col("task") == reference_task), labels.filter(F.col("task") == task), LABEL_KEYS)
    return missing if n is None else missing.orderBy(*LABEL_KEYS).limit(n)
