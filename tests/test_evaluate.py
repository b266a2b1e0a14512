import numpy as np
import pytest

from eventloom.functions import draws
from eventloom.operators import evaluate
from eventloom.plans.timeline import DEFAULT_MAX_ROWS, MAX_ROWS_CONF


def table(spark, labels, probs):
    return spark.createDataFrame(list(zip(map(int, labels), map(float, probs), strict=True)), "label int, prob double")


def values(df):
    return {r.metric: r.value for r in df.collect()}


def brute(y, p):
    y, p = np.asarray(y), np.asarray(p)
    pos, neg = p[y == 1], p[y == 0]
    pairs = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    average, seen = 0.0, 0
    for cut in sorted(set(p), reverse=True):
        chosen = p >= cut
        tp = int(y[chosen].sum())
        average += (tp - seen) / len(pos) * tp / chosen.sum()
        seen = tp
    return {"AUROC": pairs / (len(pos) * len(neg)), "AUPRC": average, "Brier": float(((y - p) ** 2).mean())}


@pytest.mark.parametrize("kind", ["perfect", "reversed", "tied", "percent", "continuous"])
def test_metrics(spark, layout, kind):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    p = {
        "perfect": y * 0.8 + 0.1, "reversed": 0.9 - y * 0.8, "tied": np.full(200, 0.4), "percent": rng.integers(0, 11, 200) / 10,
        "continuous": rng.random(200),
    }[kind]
    got, want = values(evaluate.metrics(table(spark, y, p))), brute(y, p)
    assert all(abs(got[m] - want[m]) < 1e-12 for m in want)


def test_one_class(spark):
    got = values(evaluate.metrics(table(spark, [1, 1], [0.5, 0.7])))
    assert got["AUROC"] is None and got["AUPRC"] is None and abs(got["Brier"] - (0.25 + 0.09) / 2) < 1e-12


def test_normalisation(spark):
    rows = [(True, "80"), (False, "x"), (None, "10"), (True, None), (False, "150"), (True, "NaN")]
    df = spark.createDataFrame(rows, "boolean_value boolean, parsed_probability string")
    assert sorted((r.label, r.prob) for r in evaluate.normalise_probabilities(df).collect()) == [(0, 1.0), (1, 0.8)]
    small = spark.createDataFrame([(True, 0.5), (False, 1.0)], "boolean_value boolean, parsed_probability double")
    assert sorted(r.prob for r in evaluate.normalise_probabilities(small).collect()) == [0.5, 1.0]


def test_calibration_edges(spark):
    got = {r.bin: (r.n, r.prob_true) for r in evaluate.calibration_table(table(spark, [0, 1, 0, 1, 1], [0.0, 0.1, 0.3, 1.0, 0.31])).collect()}
    assert got == {0: (2, 0.5), 2: (1, 0.0), 3: (1, 1.0), 9: (1, 1.0)}


def test_bootstrap(spark, layout):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 150)
    p = np.clip(rng.integers(0, 60, 150) / 100 + y * 0.2, 0, 1)
    df = table(spark, y, p)
    got = {r.metric: r for r in evaluate.bootstrap_metrics(df, 300, seed=1).collect()}
    again = {r.metric: r for r in evaluate.bootstrap_metrics(df, 300, seed=1).collect()}
    samples = [rng.integers(0, 150, 150) for _ in range(300)]
    reference = [brute(y[s], p[s]) for s in samples]
    for metric in evaluate.METRICS:
        low, high = np.percentile([r[metric] for r in reference], [2.5, 97.5])
        assert got[metric].lo < got[metric].value < got[metric].hi
        assert abs(got[metric].lo - low) < 0.03 and abs(got[metric].hi - high) < 0.03
        assert (got[metric].lo, got[metric].hi) == pytest.approx((again[metric].lo, again[metric].hi))


def test_draws_depend_on_data_and_seed_only(spark, monkeypatch):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 120)
    df = table(spark, y, rng.random(120).round(2))
    monkeypatch.setattr(evaluate, "CELLS_PER_BLOCK", 20)
    results = []
    for rows, partitions in ((200_000, 8), (2, 8), (2, 4)):
        spark.conf.set(MAX_ROWS_CONF, str(rows))
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        results.append(sorted((r.metric, round(r.lo, 12), round(r.hi, 12)) for r in evaluate.bootstrap_metrics(df, 50).collect()))
    spark.conf.set(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]
    assert evaluate.resampled_calibration(df, 70).select("replicate").distinct().count() == 70


@pytest.mark.parametrize(("n", "p"), [(5, 0.3), (400, 0.01), (400, 0.97), (3000, 0.5), (10**7, 0.2), (10**9, 1e-8), (0, 0.5), (7, 0.0), (7, 1.0)])
def test_binomial_counts(n, p):
    keys = draws.chained(draws.mixed(7), np.arange(40_000))
    got = draws.binomial(np.full(len(keys), n), np.full(len(keys), p), keys)
    assert got.min() >= 0 and got.max() <= n
    spread = np.sqrt(n * p * (1 - p))
    assert abs(got.mean() - n * p) <= 4 * spread / 200 + 1e-9
    assert abs(got.std() - spread) <= 0.03 * spread + 1e-9
    want = np.random.default_rng(1).binomial(n, p, 200_000)
    for q in (0.01, 0.25, 0.5, 0.9, 0.99):
        assert abs(np.quantile(got, q) - np.quantile(want, q)) <= 0.06 * spread + 1


@pytest.mark.parametrize("direct", [draws.DIRECT_ROWS, 50, 1])
def test_multinomial_counts(monkeypatch, direct):
    monkeypatch.setattr(draws, "DIRECT_ROWS", direct)
    weights = np.array([3, 0, 40, 1, 1, 200, 7, 0, 30])
    total = int(weights.sum())
    made = np.array([draws.multinomial(total, weights, int(k)) for k in draws.chained(3, np.arange(3000))])
    assert (made.sum(axis=1) == total).all() and (made[:, weights == 0] == 0).all()
    assert np.abs(made.mean(axis=0) - weights).max() < 0.8
    variance = weights * (1 - weights / total)
    assert np.abs(made.var(axis=0) - variance).max() < 0.1 * variance.max()
    covariance = np.cov(made[:, 2], made[:, 5])[0, 1]
    assert abs(covariance + weights[2] * weights[5] / total) < 6
    assert (draws.multinomial(total, weights, 5) == draws.multinomial(total, weights, 5)).all()


def test_groups_of_more_rows_are_drawn_row_by_row():
    weights = np.array([70_000, 40_000])
    rows, key = int(weights.sum()), draws.chained(draws.chained(9, 0), 2)
    places = draws.chained(key, np.arange(rows)) * np.uint64(rows) >> np.uint64(32)
    want = np.bincount((places >= 70_000).astype(int), minlength=2)
    assert (draws.multinomial(rows, weights, 9) == want).all()


def test_draws_are_made_some_at_a_time(monkeypatch):
    weights, sizes, counted = np.array([30, 0, 70, 900]), [], draws._counted
    want = draws.multinomial(1000, weights, 3)
    monkeypatch.setattr(draws, "DRAWS_AT_ONCE", 64)
    monkeypatch.setattr(draws, "_counted", lambda key, start, stop: sizes.append(stop - start) or counted(key, start, stop))
    assert (draws.multinomial(1000, weights, 3) == want).all()
    assert max(sizes) == 64 and sum(sizes) == 1000
    assert (draws.multinomial(1000, weights, 3, 0).sum(), len(sizes)) == (1000, 16)  # no row drawn by itself


def test_hash_numbers_are_even():
    numbers = draws.chained(draws.chained(draws.mixed(42), 3), np.arange(200_000)).astype(float) / 2**32
    assert abs(numbers.mean() - 0.5) < 0.003 and abs(numbers.var() - 1 / 12) < 0.001
    assert abs(np.corrcoef(numbers[:-1], numbers[1:])[0, 1]) < 0.01
    counts = np.bincount((numbers * 100).astype(int), minlength=100)
    assert ((counts - 2000) ** 2 / 2000).sum() < 160


def test_replicates_hold_every_row(spark, layout):
    rng = np.random.default_rng(3)
    df = table(spark, rng.integers(0, 2, 80), rng.random(80))
    sizes = evaluate.resampled_calibration(df, 20).groupBy("replicate").sum("n").collect()
    assert len(sizes) == 20 and {r["sum(n)"] for r in sizes} == {80}
    curve = evaluate.resampled_precision_recall(df, 5).groupBy("replicate").agg({"recall": "max"}).collect()
    assert len(curve) == 5 and all(r["max(recall)"] == 1.0 for r in curve)


def test_roc_band(spark, layout):
    y = [0, 1] * 60
    df = table(spark, y, [0.3 + 0.4 * v + 0.001 * i for i, v in enumerate(y)])
    band = evaluate.roc_band(df, 30).orderBy("fpr").collect()
    assert len(band) == 101 and band[0].mean_tpr == 0.0 and band[-1].mean_tpr == 1.0
    assert all(0 <= r.lower <= r.mean_tpr <= r.upper + 1e-12 and r.upper <= 1 for r in band)


def test_curves_start_and_end(spark):
    df = table(spark, [0, 1, 1, 0], [0.1, 0.4, 0.35, 0.8])
    roc = sorted((r.fpr, r.tpr) for r in evaluate.roc_curve(df).collect())
    assert roc == [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    end = evaluate.precision_recall_curve(df).filter("threshold is null").first()
    assert (end.precision, end.recall) == (1.0, 0.0)
