import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.operators import ordered, thresholds
from formline.plans import models, search, training
from formline.plans.models import Candidate

COLUMNS = ["elo_diff", "home_win_rate_last5", "away_win_rate_last5", "neutral"]
CANDIDATES = [
    Candidate("plain", "logistic", {"c": 0.5}),
    Candidate("boosted", "logistic", {"c": 2.0}, 1.2),
    Candidate("staged", "two_stage", {"stage1_c": 2.0, "stage2_c": 1.0, "scale": 1.08}, 1.8),
    Candidate("low", "hybrid_override", {"uncertainty": 0.42, "conviction": 0.30}, 1.2),
    Candidate("high", "hybrid_override", {"uncertainty": 0.60, "conviction": 0.20}, 1.2),
    Candidate("by_segment", "segment_aware_hybrid", {"segments": {"friendlies": (0.9, 0.05)}}, 1.2),
]


@pytest.fixture(scope="module")
def scores(features):
    return search.out_of_fold(CANDIDATES, features, COLUMNS, training.TARGET, training.ORDER, 3)


def test_equal_fits_are_learned_once(scores):
    # Two logistic fits (one is the generalist of all ensembles), two stages, a specialist's two stages.
    assert len(scores.fits) == 6 and len(scores.learned) == 18
    assert all(f.gradient <= search.TOLERANCE for f in scores.learned)


def test_shared_fits_equal_separate_ones(features, scores, monkeypatch):
    """Against the library's solver with a strict stopping rule, in every family and a middle fold."""
    made = models._classifier
    monkeypatch.setattr(models, "_classifier", lambda kind, **p: made(kind, tol=1e-13, **p))
    past, valid = ordered.expanding_folds(features, training.ORDER, 3)[1]
    for candidate in CANDIDATES[:3] + CANDIDATES[4:]:
        alone = models.fit(candidate, past, COLUMNS).score(valid).select(
            "match_id", F.col("predicted").alias("label"), *[F.col(p).alias("x_" + p) for p in models.ROW])
        both = scores.rows(candidate).filter("fold = 2").join(alone, "match_id")
        off = F.greatest(*[F.abs(F.col(p) - F.col("x_" + p)) for p in models.ROW])
        found = both.agg(F.count("*").alias("n"), F.max(off).alias("off"), F.count_if(F.col("label") != F.col("predicted")).alias("moved")).first()
        assert found["n"] == valid.count() and found["off"] < 1e-5 and found["moved"] == 0, candidate.name


def test_no_row_counts_for_its_own_fold(features, scores):
    """Other outcomes in the last fold change no score."""
    last = ordered.expanding_folds(features, training.ORDER, 3)[2][1].select("match_id").withColumn("late", F.lit(True))
    turned = features.join(last, "match_id", "left").withColumn(
        training.TARGET, F.when(F.col("late"), -F.col(training.TARGET)).otherwise(F.col(training.TARGET))).drop("late")
    again = search.out_of_fold(CANDIDATES[:1], turned, COLUMNS, training.TARGET, training.ORDER, 3)
    both = scores.rows(CANDIDATES[0]).select("match_id", "p_draw").join(
        again.rows(CANDIDATES[0]).select("match_id", F.col("p_draw").alias("other")), "match_id")
    assert both.count() > 700 and both.filter("abs(p_draw - other) > 1e-7").isEmpty()


def test_backtest_reads_the_table(features, scores, monkeypatch):
    def none(*_):
        raise AssertionError("a candidate was fitted again")

    monkeypatch.setattr(models, "fit", none)
    folds, ranking = training.backtest(CANDIDATES, features, COLUMNS, 3, scores=scores)
    assert folds.count() == 18 and ranking.count() == 6
    tuned = training.tuned_segments(scores.pairs(training.PROBE))
    assert set(tuned) == {"friendlies", "worldcup", "continental", "qualifiers"}
    assert set(tuned.values()) <= {(u, c) for u in thresholds.UNCERTAINTY_GRID for c in thresholds.CONVICTION_GRID} | {thresholds.NEVER}


@pytest.mark.parametrize("fan_in", [2, 32])
def test_sums_meet_in_a_tree(spark, monkeypatch, fan_in):
    monkeypatch.setattr(search, "FAN_IN", fan_in)
    rng = np.random.default_rng(fan_in)
    values, actual = rng.normal(size=(400, 3)), rng.integers(-1, 2, 400)
    values[rng.random((400, 3)) < 0.1] = np.nan
    rows = spark.createDataFrame(
        [(v.tolist(), int(i % 4), int(a)) for i, (v, a) in enumerate(zip(values, actual))],
        "_values array<double>, _fold int, _actual int").repartition(7)
    fits = [search.Learned(search.Fit(kind, 1.0, 1.3), fold, np.arange(3), np.zeros(3), np.zeros(3), np.ones(3), np.array([1.0, 1.5, 0.5]), 400)
            for kind in ("classes", "draw", "home") for fold in (1, 3)]
    for f in fits:
        f.beta = rng.normal(size=f.beta.shape)
    found = search._pass(rows, fits)
    for number, f in enumerate(fits):
        chosen = (np.arange(400) % 4 < f.fold) & ((actual != 0) | (f.fit.kind != "home"))
        assert np.allclose(found[number], f.sums(f.prepared(values[chosen]), actual[chosen]))
        # The gradient is the slope of the loss.
        step = np.zeros_like(f.beta)
        step[0, 1] = 1e-6
        moved = []
        for sign in (1, -1):
            f.beta = f.beta + sign * step
            moved.append(f.sums(f.prepared(values[chosen]), actual[chosen])[0])
            f.beta = f.beta - sign * step
        assert abs((moved[0] - moved[1]) / 2e-6 - found[number][2]) < 1e-3


def test_a_fold_without_a_class_goes_apart(spark):
    rows = spark.createDataFrame(
        [(i, i, float(i % 7), 0 if i >= 40 and i % 3 == 0 else (1 if i % 2 else -1)) for i in range(80)],
        "match_id int, kickoff_ts int, x double, target_multiclass int")
    assert search.out_of_fold(CANDIDATES[:1], rows, ["x"], training.TARGET, training.ORDER, 3) is None
    folds, _ = training.backtest(CANDIDATES[:1], rows, ["x"], 3)
    assert folds.count() == 3


def test_candidates_with_own_limits_stay_apart():
    assert not search.shared(Candidate("short", "logistic", {"c": 1.0, "max_iter": 3}))
    assert not search.shared(Candidate("tree", "forest", {"trees": 3, "depth": 3, "leaf": 1}))


def test_later_folds_start_from_the_first(features, monkeypatch):
    taken, plain = [], search._pass
    monkeypatch.setattr(search, "_pass", lambda rows, fits: taken.append({f.fold for f in fits}) or plain(rows, fits))
    found = search.out_of_fold(CANDIDATES[:1], features, COLUMNS, training.TARGET, training.ORDER, 3)
    assert taken[0] == {1} and not any(1 in folds and len(folds) > 1 for folds in taken)
    assert all(f.gradient <= search.TOLERANCE for f in found.learned)
