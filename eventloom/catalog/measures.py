"""Evaluation of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog.registry import query, table, view
from eventloom.functions import draws
from eventloom.operators import evaluate

SCORED = """(SELECT CAST(boolean_value AS INT) AS label, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN (SELECT max(TRY_CAST(parsed_probability AS DOUBLE)) FROM {predictions}) > 1
    THEN TRY_CAST(parsed_probability AS DOUBLE) / 100 ELSE TRY_CAST(parsed_probability AS DOUBLE) END)) AS prob FROM {predictions}
    WHERE boolean_value IS NOT NULL AND TRY_CAST(parsed_probability AS DOUBLE) IS NOT NULL)"""
# prices as continuous scores: nearly every value is distinct
CONTINUOUS = "(SELECT CAST(o_orderstatus = 'F' AS INT) AS label, o_totalprice / 1000000.0::DOUBLE AS prob FROM orders)"


def cumulative(source: str) -> str:
    return f"""(SELECT *, sum(pos) OVER (ORDER BY prob DESC) AS tp, sum(neg) OVER (ORDER BY prob DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
        FROM (SELECT prob, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY prob))"""


def metrics_sql(source: str) -> str:
    table = cumulative(source)
    return f"""SELECT 'AUROC' AS metric, round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (any_value(p)::DOUBLE * any_value(n)), 9) AS value FROM {table}
        UNION ALL SELECT 'AUPRC', round(sum(pos * tp::DOUBLE / (tp + fp)) / any_value(p), 9) FROM {table}
        UNION ALL SELECT 'Brier', round(avg((label - prob) ** 2), 9) FROM {source}"""


def scored(spark, folder):
    return evaluate.normalise_probabilities(view(spark, folder, "predictions"))


def continuous(spark, folder):
    label = (F.col("o_orderstatus") == "F").cast("int").alias("label")
    return table(spark, folder, "orders").select(label, (F.col("o_totalprice") / 1_000_000).alias("prob"))


def rounded(df, *names: str, digits: int = 9):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"SELECT label, prob FROM {SCORED}")
def normalise_probabilities(spark, folder):
    return scored(spark, folder)


@query(metrics_sql(SCORED))
def score_metrics(spark, folder):
    return rounded(evaluate.metrics(scored(spark, folder)), "value")


@query(metrics_sql(CONTINUOUS))
def score_metrics_continuous(spark, folder):
    return rounded(evaluate.metrics(continuous(spark, folder)), "value")


@query(metrics_sql(SCORED).split("UNION ALL")[0])
def auroc(spark, folder):
    return rounded(evaluate.auroc(scored(spark, folder)), "value")


@query(metrics_sql(SCORED).split("UNION ALL")[1].replace("'AUPRC', round", "'AUPRC' AS metric, round").replace("any_value(p), 9)", "any_value(p), 9) AS value"))
def average_precision(spark, folder):
    return rounded(evaluate.auprc(scored(spark, folder)), "value")


@query(f"SELECT 'Brier' AS metric, round(avg((label - prob) ** 2), 9) AS value FROM {SCORED}")
def brier_score(spark, folder):
    return rounded(evaluate.brier(scored(spark, folder)), "value")


@query(f"SELECT prob, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM {cumulative(SCORED)}")
def threshold_running_sums(spark, folder):
    return evaluate.thresholds(scored(spark, folder)).rows().select("prob", "pos", "neg", "tp", "fp")


@query(f"SELECT prob AS threshold, fp::DOUBLE / n AS fpr, tp::DOUBLE / p AS tpr FROM {cumulative(CONTINUOUS)} UNION ALL SELECT 'infinity'::DOUBLE, 0, 0")
def roc_curve(spark, folder):
    return evaluate.roc_curve(continuous(spark, folder))


@query(f"SELECT prob AS threshold, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / p AS recall FROM {cumulative(SCORED)} UNION ALL SELECT NULL, 1, 0")
def precision_recall_curve(spark, folder):
    return evaluate.precision_recall_curve(scored(spark, folder))


@query(f"""SELECT len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: e < prob)) AS bin, count(*) AS n,
    round(avg(prob), 9) AS prob_pred, round(avg(label), 9) AS prob_true FROM {SCORED} GROUP BY 1""")
def calibration_table(spark, folder):
    rows = evaluate.calibration_table(scored(spark, folder)).withColumn("bin", F.col("bin").cast("bigint"))
    return rounded(rows, "prob_pred", "prob_true")


# --- resampling: the draws of functions/draws.py, for tables of one block and at most DIRECT_ROWS rows ---------------


def _layer(rows: str, keep: str, expression: str, name: str) -> str:
    return f"(SELECT {keep}{', ' if keep else ''}{expression} AS {name} FROM {rows})"


def _mixed_sql(rows: str, keep: str, value: str, name: str) -> str:
    for shift, by in zip(draws.SHIFTS, draws.MULTIPLIERS, strict=False):
        rows, value = _layer(rows, keep, f"(xor({value}, {value} >> {shift}) * {by}) & {draws.MASK}", "h"), "h"
    return _layer(rows, keep, f"xor(h, h >> {draws.SHIFTS[-1]})", name)


def _chained_sql(rows: str, keep: str, key: str, value: str, name: str) -> str:
    started = _layer(rows, keep, f"(xor({key}, {value}) + {draws.STEP}) & {draws.MASK}", "x")
    return _mixed_sql(started, keep, "x", name)


def drawn_sql(source: str, n_replicates: int, seed: int = 42) -> str:
    """(replicate, prob, pos, neg): the cells that each replicate draws, with tp, fp, p and n of the replicate."""
    totals = f"(SELECT sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, count(DISTINCT prob)::BIGINT AS n_cells FROM {source})"
    seeded = _mixed_sql(f"(SELECT range AS r, {seed}::BIGINT AS s FROM range({n_replicates}))", "r", "s", "k")
    replicate = _chained_sql(seeded, "r", "k", "r", "k")
    classes = _chained_sql(_chained_sql(_chained_sql(replicate, "r", "k", "0", "k"), "r", "k", "0", "k"), "r", "k", "2", "k")
    draws_of = f"(SELECT r, k, n_pos, n_neg, unnest(range(n_pos + n_neg)) AS j FROM {classes}, {totals})"
    classed = _chained_sql(draws_of, "r, n_pos, n_neg", "k", "j", "h")
    shares = f"(SELECT r, count(*) FILTER ((h * (n_pos + n_neg)) >> 32 < n_pos) AS pos, count(*) AS n FROM {classed} GROUP BY r)"
    inside = _chained_sql(replicate, "r", "k", "1", "k")
    parts = []
    for number, (label, size, many) in enumerate([("1", "n_pos", "pos"), ("0", "n_neg", "n - pos")]):
        keys = _chained_sql(_chained_sql(inside, "r", "k", str(number), "k"), "r", "k", "0", "k")
        keys = _chained_sql(f"(SELECT r, k, n_cells FROM {keys}, {totals})", "r", "k", "n_cells", "k")
        each = f"(SELECT r, k, {size} AS size, unnest(range({many})) AS j FROM {keys} JOIN {shares} USING (r), {totals})"
        picked = f"(SELECT r, (h * size) >> 32 AS place FROM {_chained_sql(each, 'r, size', 'k', 'j', 'h')})"
        ranked = f"(SELECT prob, row_number() OVER (ORDER BY prob DESC) - 1 AS place FROM {source} WHERE label = {label})"
        parts.append(f"SELECT r AS replicate, prob, {label} AS label FROM {picked} JOIN {ranked} USING (place)")
    cells = f"(SELECT replicate, prob, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)"
    sums = f"(SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS p, sum(neg) OVER a AS n FROM {cells} WINDOW w AS (PARTITION BY replicate ORDER BY prob DESC), a AS (PARTITION BY replicate))"
    return f"(SELECT * FROM {sums} WHERE p > 0 AND n > 0)"


def intervals_sql(source: str) -> str:
    replicates = f"""(SELECT sum(neg * (tp - pos / 2.0::DOUBLE)) / (any_value(p)::DOUBLE * any_value(n)) AS AUROC, sum(pos * tp::DOUBLE / (tp + fp)) / any_value(p) AS AUPRC,
        sum(pos * (1 - prob) ** 2 + neg * prob ** 2) / any_value(p + n) AS Brier FROM {drawn_sql(source, 1000)} GROUP BY replicate)"""
    ends = f"(SELECT metric, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM (UNPIVOT {replicates} ON AUROC, AUPRC, Brier INTO NAME metric VALUE v) GROUP BY metric)"
    return f"SELECT metric, value, round(lo, 9) AS lo, round(hi, 9) AS hi FROM ({metrics_sql(source)}) JOIN {ends} USING (metric)"


@query(intervals_sql(SCORED))
def bootstrap_intervals(spark, folder):
    """1,000 resamples of every metric."""
    return rounded(evaluate.bootstrap_metrics(scored(spark, folder)), "value", "lo", "hi")


@query(intervals_sql(CONTINUOUS))
def bootstrap_intervals_continuous(spark, folder):
    return rounded(evaluate.bootstrap_metrics(continuous(spark, folder)), "value", "lo", "hi")


def bounds_sql(source: str) -> str:
    point = metrics_sql(source)
    return f"SELECT metric, round(value, 6) AS value, true AS bounded FROM ({point})"


@query(bounds_sql(SCORED))
def bootstrap_bounds(spark, folder):
    """Every interval holds its metric."""
    found = evaluate.bootstrap_metrics(scored(spark, folder))
    held = (F.col("lo") < F.col("value")) & (F.col("value") < F.col("hi")) & (F.col("hi") - F.col("lo") < 0.5)
    return found.select("metric", F.round("value", 6).alias("value"), held.alias("bounded"))


@query(f"SELECT r.range AS replicate, (SELECT count(*) FROM {CONTINUOUS}) AS n, true AS within FROM range(1000) r")
def bootstrap_replicates_continuous(spark, folder):
    """A thousand replicates, each of as many rows as the table, with metrics between 0 and 1."""
    rows = continuous(spark, folder)
    tables = evaluate.resampled_calibration(rows, 1000).groupBy("replicate").agg(F.sum("n").alias("n"))
    within = F.greatest("AUROC", "AUPRC", "Brier").between(0, 1) & (F.least("AUROC", "AUPRC", "Brier") >= 0)
    return evaluate.bootstrap_replicates(rows).select("replicate", within.alias("within")).join(tables, "replicate")


@query(f"""SELECT (SELECT count(*) FROM {SCORED}) AS n_drawn, r.range AS replicate, true AS full_recall, true AS rising FROM range(60) r""")
def resampled_curve_shape(spark, folder):
    """Each resampled curve ends at recall 1, and sixty asked for are sixty; calibration tables hold every row."""
    rows = scored(spark, folder)
    curve = evaluate.resampled_precision_recall(rows, 60).groupBy("replicate").agg(
        (F.abs(F.max("recall") - 1) < 1e-12).alias("full_recall"),
        (F.max_by("recall", "threshold") == F.min("recall")).alias("rising"),
    )
    drawn = evaluate.resampled_calibration(rows, 60).groupBy("replicate").agg(F.sum("n").alias("n_drawn"))
    return curve.join(drawn, "replicate")


@query("SELECT r.range / 100.0::DOUBLE AS fpr, true AS ordered FROM range(101) r")
def roc_band_shape(spark, folder):
    """The band has a point for every rate, and its mean lies inside it."""
    band = evaluate.roc_band(scored(spark, folder))
    inside = (F.col("lower") <= F.col("mean_tpr") + 1e-9) & (F.col("mean_tpr") <= F.col("upper") + 1e-9)
    return band.select("fpr", inside.alias("ordered"))


CURVES = f"""(SELECT replicate, fp::DOUBLE / n AS fpr, tp::DOUBLE / p AS tpr FROM {drawn_sql(SCORED, 100)}
    UNION ALL SELECT range, 0, 0 FROM range(100))"""


@query(f"""WITH curves AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY fpr, tpr) AS place FROM {CURVES}),
    steps AS (SELECT *, lead(fpr) OVER w AS next_fpr, lead(tpr) OVER w AS next_tpr FROM curves WINDOW w AS (PARTITION BY replicate ORDER BY place)),
    grid AS (SELECT range / 100.0::DOUBLE AS g FROM range(101)),
    found AS (SELECT replicate, g, arg_max(struct_pack(fpr, tpr, next_fpr, next_tpr), place) AS s FROM grid JOIN steps ON fpr <= g GROUP BY ALL),
    at_grid AS (SELECT g, CASE WHEN g = 0 THEN 0 WHEN s.next_fpr IS NULL THEN s.tpr
        ELSE s.tpr + (g - s.fpr) * (s.next_tpr - s.tpr) / (s.next_fpr - s.fpr) END AS v FROM found)
    SELECT g AS fpr, round(avg(v), 9) AS mean_tpr, round(greatest(avg(v) - 2 * stddev_pop(v), 0), 9) AS lower,
        round(least(avg(v) + 2 * stddev_pop(v), 1), 9) AS upper FROM at_grid GROUP BY g""")
def roc_band(spark, folder):
    return rounded(evaluate.roc_band(scored(spark, folder)), "mean_tpr", "lower", "upper")


@query(f"SELECT replicate, prob AS threshold, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / p, 9) AS recall FROM {drawn_sql(SCORED, 50)}")
def resampled_precision_recall(spark, folder):
    return rounded(evaluate.resampled_precision_recall(scored(spark, folder)), "precision", "recall")


@query(f"""SELECT replicate, len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: e < prob)) AS bin, sum(pos + neg)::BIGINT AS n,
    round(sum((pos + neg) * prob) / sum(pos + neg), 9) AS prob_pred, round(sum(pos)::DOUBLE / sum(pos + neg), 9) AS prob_true FROM {drawn_sql(SCORED, 50)} GROUP BY ALL""")
def resampled_calibration(spark, folder):
    return rounded(evaluate.resampled_calibration(scored(spark, folder)), "prob_pred", "prob_true")
