"""Secrets in texts: regex rules behind a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query of trigrams is derived: a conjunction for each way the regex can go, of the trigrams
that every match must hold in lower case. The index has the postings (trigram, row) of all trigrams that some query names;
a query's postings are intersected by counting, and its rows are the candidates. A rule without mandatory trigrams (a run of
hexadecimal digits) has no query and scans every text. The regex then decides on the candidates.

Spans are in code points, end exclusive. Spark has no function for the places of all matches; they follow from the lengths
of the matches and of the pieces between them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import absent, text_of


@dataclass(frozen=True)
class Rule:
    """`least` characters are needed in regex group `group`, or the match is dropped; the span is that of the whole match."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
# The first three are the base rules. All characters are ASCII, so that every engine reads them alike.
RULES = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 39),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)
BASE = 3
MASKED = "[SECRET]"
MOST_WAYS = 64


def ways(regex: str) -> list[list[str]] | None:
    """Every way through the regex as the literal runs, in lower case, that it must contain; None if there are too many."""

    def join(left: list[list[str]], right: list[list[str]]) -> list[list[str]]:
        return [[*a[:-1], a[-1] + b[0], *b[1:]] for a in left for b in right]

    def walk(parsed) -> list[list[str]]:
        out = [[""]]
        for op, value in parsed:
            if op is C.LITERAL:
                step = [[chr(value).lower()]]
            elif op is C.IN and (letter := _letter(value)):
                step = [[letter]]
            elif op is C.BRANCH:
                step = [way for branch in value[1] for way in walk(branch)]
            elif op is C.SUBPATTERN:
                step = walk(value[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[:2] == (0, 1) and all(len(way) == 1 for way in walk(value[2])):
                step = [[""], *walk(value[2])]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
                step = [[*way, ""] for way in walk(value[2])]  # the first time round
            else:
                step = [["", ""]]
            out = join(out, step)
            if len(out) > MOST_WAYS:
                raise OverflowError
        return out

    try:
        return walk(_parser.parse(regex))
    except OverflowError:
        return None


def _letter(options) -> str:
    """The one character, in lower case, that a class stands for; empty for other classes."""
    found = {chr(v).lower() if op is C.LITERAL else "" for op, v in options}
    return found.pop() if len(found) == 1 else ""


def query(regex: str) -> list[list[str]]:
    """The regex's trigram query, an alternative of conjunctions; empty if some way through it has no trigram."""
    found = [sorted({run[i : i + 3] for run in way for i in range(len(run) - 2)}) for way in ways(regex) or [[""]]]
    if not all(found):
        return []
    return [list(x) for x in sorted({tuple(x) for x in found})]


def candidates(rows: DataFrame, key: str, text: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(`key`, `rules`): for every row that some query finds, the numbers of the rules to verify."""
    clauses = [(number, clause, way) for number, rule in enumerate(rules) for clause, way in enumerate(query(rule.regex))]
    trigrams = sorted({t for _, _, way in clauses for t in way})
    lower = F.col("lower")
    held = F.filter(F.array(*[F.when(F.contains(lower, F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    postings = rows.select(F.col(key), F.lower(text).alias("lower")).select(key, F.explode(held).alias("trigram")).distinct()
    wanted = rows.sparkSession.createDataFrame(
        [(number, clause, t, len(way)) for number, clause, way in clauses for t in way], "rule int, clause int, trigram string, size int"
    )
    met = postings.join(F.broadcast(wanted), "trigram").groupBy(key, "rule", "clause").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    return met.filter("n = size").groupBy(key).agg(F.collect_set("rule").alias("rules"))  # at most one entry per rule


def _spans(rule: Rule, text: Column) -> Column:
    """array<struct<start, end, kind>> of the rule's matches that are long enough."""
    regex = F.lit(rule.regex)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    sizes = F.transform(matches, F.char_length)
    long_enough = sizes if rule.group == 0 else F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.char_length)
    gaps = F.transform(F.split(text, rule.regex, -1), F.char_length)
    steps = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), long_enough.alias("least"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        own = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = x["size"].isNotNull() & (x["least"] >= rule.least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(rule.regex), F.aggregate(steps, state, step)["spans"]).otherwise(empty)


def _scan_rule(rule: Rule) -> Rule:
    """A rule that scans every text looks for runs that are long enough, rather than dropping short ones."""
    simple = re.fullmatch(r"(\[[^\]]+\])\+", rule.regex)
    return Rule(rule.kind, f"{simple[1]}{{{rule.least},}}") if simple else rule


def with_spans(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with `spans`: array<struct<start, end, kind>> by start, then by the order of the rules.

    Rows are told apart by a hash of their text, so equal texts are looked up once and ids may be null or repeated. Null and
    empty texts have no spans. A candidate that a hash collision adds costs a scan and changes nothing.
    """
    key, found, text = absent(docs, "__text"), absent(docs, "__rules"), text_of(text_col)
    keyed = docs.withColumn(key, F.xxhash64(text))
    wanted = candidates(keyed, key, text, rules).withColumnRenamed("rules", found)
    rows = keyed.join(wanted, key, "left")
    parts = []
    for number, rule in enumerate(rules):
        if query(rule.regex):
            spans = _spans(rule, text)
            parts.append(F.when(F.array_contains(found, number), spans))
        else:
            parts.append(_spans(_scan_rule(rule), text))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    order = F.create_map(*[x for i, rule in enumerate(rules) for x in (F.lit(rule.kind), F.lit(i))])
    ranked = F.transform(
        F.concat(*[F.coalesce(p, empty) for p in parts]),
        lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.withColumn("spans", spans).drop(key, found)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text."""
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = [rule.kind for rule in RULES[:BASE]]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    return rows.select("doc_id", *counts, F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every secret replaced by a mark, overlapping ones by one; `count_col`, if there is one, follows the new text.

    Texts without secrets stay as they are, null texts null. Other columns may have any names: they go by their numbers in
    here.
    """
    names = [c.lower() for c in docs.columns]
    own = [f"c{i}" for i in range(len(names))]
    of_text = own[names.index(text_col.lower())]
    counted = own[names.index(count_col.lower())] if count_col is not None and count_col.lower() in names else None
    rows = with_spans(docs.toDF(*own), of_text)
    text = F.col(of_text)
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASKED))
        return F.struct(
            F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at")
        )

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))

    rows = rows.withColumn("masked", F.aggregate("spans", state, step, rest))
    changed, values = F.size("spans") > 0, {c: F.col(c) for c in own}
    values[of_text] = F.when(changed, F.col("masked")).otherwise(text)
    if counted is not None:
        kind = docs.schema.fields[own.index(counted)].dataType
        values[counted] = F.when(changed, F.char_length("masked").cast(kind)).otherwise(F.col(counted))
    return rows.select(*[values[c].alias(c) for c in own]).toDF(*docs.columns)
