"""Evaluation of scores against labels.

Scores are first compressed to counts of positives and negatives per distinct probability (combined before the shuffle).
Metrics and curves are running sums over those counts. With integer percentages there are at most 101 of them; with
continuous scores there may be as many as rows, and the timeline then spreads them over slices.

Resampling n rows with replacement is drawing multinomial counts for the cells. Cells form blocks; how many rows fall in
each block and class is drawn first, then within a block how many fall in each cell. Every (block, group of replicates) is
an independent task, and no row is ever repeated a thousand times. The numbers come from no generator with a state: each is
a hash of the seed, the replicate, the block and a counter (see `functions/draws.py`), so another engine can repeat a draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.draws import chained, mixed, multinomial
from eventloom.plans.timeline import Run, Timeline, lay_out, written

METRICS = ("AUROC", "AUPRC", "Brier")


def normalise_probabilities(df: DataFrame, label: str = "boolean_value", probability: str = "parsed_probability") -> DataFrame:
    """Columns `label` (0/1) and `prob` in [0, 1].

    Text that is no number counts as missing. If any value exceeds 1 the whole column is taken as percentages. Rows
    without a label or probability are dropped.
    """
    number = F.col(probability).try_cast("double")
    cleaned = df.select(F.col(label).cast("int").alias("label"), F.nanvl(number, F.lit(None).cast("double")).alias("prob"))
    largest = cleaned.agg(F.max("prob")).scalar()
    scaled = F.when(largest > 1, F.col("prob") / 100).otherwise(F.col("prob"))
    kept = cleaned.filter(F.col("label").isNotNull() & F.col("prob").isNotNull())
    return kept.select("label", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)).alias("prob"))


def cells(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct probability, written once so that the scores are read a single time."""
    positive = F.col("label").cast("bigint")
    counts = scored.groupBy("prob").agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    return written(counts, "cells")


def thresholds(scored: DataFrame) -> Timeline:
    """Cells in falling order of probability with true and false positives at each threshold and the class totals."""
    table = cells(scored)
    line = lay_out(table, [], ["-prob"]).run(tp=Run("sum", F.col("pos")), fp=Run("sum", F.col("neg")))
    totals = table.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return line.pipe(lambda d: d.withColumns({"n_pos": totals.getField("p"), "n_neg": totals.getField("n")}))


def metrics(scored: DataFrame) -> DataFrame:
    """AUROC (ties averaged), average precision (step form) and Brier score, one row each.

    With a single class the first two are null.
    """
    line = thresholds(scored).rows()
    p, n = F.max("n_pos"), F.max("n_neg")
    both = (p > 0) & (n > 0)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (p * n)
    precision = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / p
    squares = F.sum(F.col("pos") * F.pow(1 - F.col("prob"), 2) + F.col("neg") * F.pow("prob", 2)) / (p + n)
    wide = line.agg(
        F.when(both, area).alias("AUROC"), F.when(both, precision).alias("AUPRC"), squares.alias("Brier")
    )
    return wide.unpivot([], list(METRICS), "metric", "value")


def auroc(scored: DataFrame) -> DataFrame:
    return metrics(scored).filter("metric = 'AUROC'")


def auprc(scored: DataFrame) -> DataFrame:
    return metrics(scored).filter("metric = 'AUPRC'")


def brier(scored: DataFrame) -> DataFrame:
    """Mean squared error, straight from the rows."""
    return scored.agg(F.avg(F.pow(F.col("label") - F.col("prob"), 2)).alias("value")).select(F.lit("Brier").alias("metric"), "value")


def roc_curve(scored: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct threshold, starting at (0, 0)."""
    line = thresholds(scored).rows()
    points = line.select(
        F.col("prob").alias("threshold"),
        (F.col("fp") / F.col("n_neg")).alias("fpr"),
        (F.col("tp") / F.col("n_pos")).alias("tpr"),
    )
    start = _one_row(scored.sparkSession, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def precision_recall_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall at every distinct threshold, ending at precision 1 and recall 0 (no threshold)."""
    line = thresholds(scored).rows()
    points = line.select(
        F.col("prob").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("n_pos")).alias("recall"),
    )
    end = _one_row(
        scored.sparkSession, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def _one_row(spark: SparkSession, *columns: Column) -> DataFrame:
    return spark.range(1).select(*columns)


def probability_bin(prob: Column, n_bins: int = 10) -> Column:
    """Equal-width bin from 0; a value on an inner edge belongs to the lower bin."""
    above = [F.when(prob > F.lit(i / n_bins), 1).otherwise(0) for i in range(1, n_bins)]
    total = F.lit(0)
    for step in above:
        total = total + step
    return total


def calibration_table(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """Mean predicted probability and fraction of positives per bin; empty bins are absent."""
    return scored.groupBy(probability_bin(F.col("prob"), n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("prob").alias("prob_pred"), F.avg("label").alias("prob_true")
    )


# --- resampling ---------------------------------------------------------------------------------------------------

Replicate = Callable[[np.ndarray, np.ndarray, dict], dict[str, np.ndarray]]
GROUPS = 256  # of (block, replicates), at least, as far as there are replicates; no part of the definition of a draw
CELLS_PER_BLOCK = 50_000  # of equal probability; part of the definition of a draw, as seeds follow blocks
SHARES = "replicate long, block long, pos_here long, neg_here long, pos_above long, neg_above long, n_pos long, n_neg long"


def _key(seed: int, replicate: int, block: int) -> int:
    """The key of a draw: block 0 is the draw among the blocks, block b + 1 the one inside block b."""
    return int(chained(chained(mixed(seed), replicate), block))


def _shares(table: DataFrame, n_replicates: int, seed: int) -> DataFrame:
    """How many positives and negatives each replicate draws from each block, and how many from the blocks above.

    The totals per block form one array with an entry for every CELLS_PER_BLOCK cells. In a table of one block each row is
    drawn here; among several blocks the counts are binomial, so that no task draws all rows of a large table.
    """
    per_block = table.groupBy("block").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = per_block.agg(F.sort_array(F.collect_list(F.struct("block", "pos", "neg")))).scalar()

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tables = []
            for replicate, blocks in zip(frame["id"], frame["totals"], strict=True):
                ids = np.array([b["block"] for b in blocks], dtype=np.int64)
                counts = np.array([[b["pos"], b["neg"]] for b in blocks], dtype=np.int64).reshape(-1, 2)
                total = counts.sum()
                if total == 0:
                    continue
                limit = None if len(ids) == 1 else 0
                drawn = multinomial(int(total), counts.ravel(), _key(seed, int(replicate), 0), limit).reshape(-1, 2)
                above = np.cumsum(drawn, axis=0) - drawn
                both = drawn.sum(axis=0)
                fixed = [np.full(len(ids), v) for v in (replicate, *both)]
                tables.append(np.column_stack([fixed[0], ids, drawn, above, *fixed[1:]]))
            if tables:
                yield pd.DataFrame(np.concatenate(tables), columns=[part.split()[0] for part in SHARES.split(", ")])

    replicates = table.sparkSession.range(n_replicates).withColumn("totals", totals)
    return replicates.mapInPandas(draw, SHARES)


def resample(scored: DataFrame, n_replicates: int, seed: int, schema: str, summarise: Callable[[np.ndarray], Replicate]) -> DataFrame:
    """Apply `summarise(prob)(pos, neg, shares)` to every replicate of every block of cells.

    Cells are numbered in falling order of probability and CELLS_PER_BLOCK of them form a block, so a draw depends on the
    data, the seed and the replicate, and on no setting of the cluster. The arrays are the drawn counts of one block in
    falling order of probability; `shares` has the counts drawn above the block and in total. Replicates with a single
    class are skipped. The result has `replicate` and the columns of `schema`; combine them over the blocks of a replicate.
    """
    numbered = lay_out(cells(scored), [], ["-prob"]).numbered("__cell").rows()
    block = F.floor((F.col("__cell") - 1) / CELLS_PER_BLOCK).cast("long")
    table = written(numbered.select("prob", "pos", "neg", block.alias("block")), "cell-blocks")
    blocks = (table.agg(F.max("block")).first()[0] or 0) + 1
    tasks = max(1, min(-(-GROUPS // blocks), n_replicates))
    spread = table.withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    shares = _shares(table, n_replicates, seed).filter("n_pos > 0 and n_neg > 0")
    shares = shares.withColumn("task", (F.col("replicate") % tasks).cast("long"))
    names = [part.split()[0] for part in schema.split(",")]

    def run(table: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("prob", ascending=False)
        prob = table["prob"].to_numpy()
        pos, neg = table["pos"].to_numpy(dtype=np.int64), table["neg"].to_numpy(dtype=np.int64)
        summary, out = summarise(prob), []
        for share in draws.sort_values("replicate").to_dict("records"):
            key = _key(seed, share["replicate"], share["block"] + 1)
            drawn_pos = multinomial(share["pos_here"], pos, int(chained(key, 0)))
            drawn_neg = multinomial(share["neg_here"], neg, int(chained(key, 1)))
            part = {name: np.asarray(values) for name, values in summary(drawn_pos, drawn_neg, share).items()}
            out.append(part | {"replicate": np.full(len(part[names[0]]), share["replicate"])})
        columns = ["replicate", *names]
        if not out:
            return pd.DataFrame(columns=columns)
        return pd.DataFrame({c: np.concatenate([part[c] for part in out]) for c in columns})

    # by number, as the groups are small in bytes and would be put together into few tasks, but each takes long
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread, shares = (df.repartition(partitions, "block", "task") for df in (spread, shares))
    grouped = spread.groupBy("block", "task").cogroup(shares.groupBy("block", "task"))
    return grouped.applyInPandas(run, f"replicate long, {schema}")


def _metric_parts(prob: np.ndarray) -> Replicate:
    square_pos, square_neg = (1 - prob) ** 2, prob**2

    def parts(pos, neg, share) -> dict[str, np.ndarray]:
        pos, neg = pos.astype(float), neg.astype(float)
        tp, fp = share["pos_above"] + np.cumsum(pos), share["neg_above"] + np.cumsum(neg)
        seen = np.maximum(tp + fp, 1)
        return {
            "area": [float(neg @ tp - neg @ pos / 2)],
            "precision": [float(pos @ (tp / seen))],
            "squares": [float(pos @ square_pos + neg @ square_neg)],
            "n_pos": [share["n_pos"]],
            "n_neg": [share["n_neg"]],
        }

    return parts


def bootstrap_replicates(scored: DataFrame, n_replicates: int = 1000, seed: int = 42) -> DataFrame:
    """The three metrics of every resample."""
    schema = "area double, precision double, squares double, n_pos long, n_neg long"
    parts = resample(scored, n_replicates, seed, schema, _metric_parts)
    p, n = F.max("n_pos"), F.max("n_neg")
    return parts.groupBy("replicate").agg(
        (F.sum("area") / (p * n)).alias("AUROC"),
        (F.sum("precision") / p).alias("AUPRC"),
        (F.sum("squares") / (p + n)).alias("Brier"),
    )


def bootstrap_metrics(scored: DataFrame, n_replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Each metric with its 2.5 and 97.5 percentiles over the resamples."""
    replicates = bootstrap_replicates(scored, n_replicates, seed).unpivot(["replicate"], list(METRICS), "metric", "v")
    ends = replicates.groupBy("metric").agg(F.percentile("v", [0.025, 0.975]).alias("ends"))
    bounds = ends.select("metric", F.col("ends")[0].alias("lo"), F.col("ends")[1].alias("hi"))
    return metrics(scored).join(bounds, "metric", "left")


def _curve_at(grid: np.ndarray) -> Replicate:
    def at(pos, neg, share) -> dict[str, np.ndarray]:
        fp = np.concatenate([[share["neg_above"]], share["neg_above"] + np.cumsum(neg)]) / share["n_neg"]
        tp = np.concatenate([[share["pos_above"]], share["pos_above"] + np.cumsum(pos)]) / share["n_pos"]
        inside = (grid >= fp[0]) & (grid <= fp[-1])
        return {"point": np.flatnonzero(inside), "tpr": np.interp(grid[inside], fp, tp)}

    return at


def roc_band(scored: DataFrame, n_replicates: int = 100, n_points: int = 101, seed: int = 42) -> DataFrame:
    """Mean of the resampled curves at evenly spaced rates, plus and minus two standard deviations, within [0, 1]."""
    grid = np.arange(n_points) / (n_points - 1)
    parts = resample(scored, n_replicates, seed, "point long, tpr double", lambda prob: _curve_at(grid))
    # two blocks may meet at a grid point: the later one has the final rate
    curves = parts.groupBy("replicate", "point").agg(F.max("tpr").alias("tpr"))
    curves = curves.withColumn("tpr", F.when(F.col("point") == 0, 0.0).otherwise(F.col("tpr")))
    mean, spread = F.avg("tpr"), 2 * F.stddev_pop("tpr")
    return curves.groupBy("point").agg(
        mean.alias("mean_tpr"),
        F.greatest(mean - spread, F.lit(0.0)).alias("lower"),
        F.least(mean + spread, F.lit(1.0)).alias("upper"),
    ).select((F.col("point") / (n_points - 1)).alias("fpr"), "mean_tpr", "lower", "upper")


def _recall_points(prob: np.ndarray) -> Replicate:
    def points(pos, neg, share) -> dict[str, np.ndarray]:
        tp, fp = share["pos_above"] + np.cumsum(pos), share["neg_above"] + np.cumsum(neg)
        drawn = (pos + neg) > 0
        return {"threshold": prob[drawn], "precision": tp[drawn] / (tp + fp)[drawn], "recall": tp[drawn] / share["n_pos"]}

    return points


def resampled_precision_recall(scored: DataFrame, n_replicates: int = 50, seed: int = 42) -> DataFrame:
    """The precision-recall curve of every resample."""
    schema = "threshold double, precision double, recall double"
    return resample(scored, n_replicates, seed, schema, _recall_points)


def _bin_parts(prob: np.ndarray) -> Replicate:
    bins = np.searchsorted(np.arange(1, 10) / 10, prob)

    def parts(pos, neg, share) -> dict[str, np.ndarray]:
        n = pos + neg
        return {
            "bin": np.arange(10),
            "n": np.bincount(bins, n, 10).astype(np.int64),
            "prob_sum": np.bincount(bins, n * prob, 10),
            "pos": np.bincount(bins, pos, 10).astype(np.int64),
        }

    return parts


def resampled_calibration(scored: DataFrame, n_replicates: int = 50, seed: int = 42) -> DataFrame:
    """The calibration table of every resample."""
    parts = resample(scored, n_replicates, seed, "bin long, n long, prob_sum double, pos long", _bin_parts)
    summed = parts.groupBy("replicate", "bin").agg(F.sum("n").alias("n"), F.sum("prob_sum").alias("s"), F.sum("pos").alias("k"))
    used = summed.filter("n > 0")
    return used.select("replicate", "bin", "n", (F.col("s") / F.col("n")).alias("prob_pred"), (F.col("k") / F.col("n")).alias("prob_true"))
