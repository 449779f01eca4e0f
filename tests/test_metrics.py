import pytest
from pyspark.sql import functions as F

from formline.functions import outcomes
from formline.operators import metrics, report, thresholds

FRAME = "actual int, predicted int, p_away double, p_draw double, p_home double"


def suite(spark, rows):
    return metrics.evaluate(spark.createDataFrame(rows, FRAME)).first()


def test_perfect_predictions(spark):
    row = suite(spark, [(-1, -1, 1.0, 0.0, 0.0), (0, 0, 0.0, 1.0, 0.0), (1, 1, 0.0, 0.0, 1.0), (1, 1, 0.0, 0.0, 1.0)])
    for name in ("accuracy", "macro_f1", "weighted_f1", "balanced_accuracy", "matthews_corrcoef", "cohen_kappa", "draw_f1", "draw_recall"):
        assert row[name] == pytest.approx(1.0)
    for name in ("log_loss", "multiclass_brier_score", "expected_calibration_error"):
        assert row[name] == pytest.approx(0.0, abs=1e-9)


def test_constant_prediction(spark):
    row = suite(spark, [(-1, 1, 0.2, 0.2, 0.6), (0, 1, 0.2, 0.2, 0.6), (1, 1, 0.2, 0.2, 0.6)])
    assert row["matthews_corrcoef"] == 0.0 and row["draw_recall"] == 0.0
    assert row["macro_f1"] == pytest.approx((0 + 0 + 0.5) / 3)
    assert row["expected_calibration_error"] == pytest.approx(abs(1 / 3 - 0.6))


def test_macro_f1_counts_only_classes_seen(spark):
    row = suite(spark, [(1, 1, 0.0, 0.0, 1.0), (-1, -1, 1.0, 0.0, 0.0)])
    assert row["macro_f1"] == pytest.approx(1.0)


@pytest.mark.parametrize("value,wanted", [(0.3, 2), (0.30000000000000004, 3), (0.6, 5), (0.7, 6), (1.0, 9), (0.0, 0)])
def test_bin_edges_are_the_evenly_spaced_doubles(spark, value, wanted):
    assert spark.range(1).select(metrics.confidence_bin(F.lit(value))).first()[0] == wanted


def test_small_groups_are_left_out(spark):
    rows = [("2024-01-01", seg, 1, 1, 0.1, 0.1, 0.8) for seg in ("a", "a", "b", "b", "c")]
    df = spark.createDataFrame(rows, f"match_date string, seg string, {FRAME}")
    assert {r["segment_value"] for r in metrics.segment_analysis(df, "seg", 2).collect()} == {"a", "b"}


def test_class_weights_sum_to_rows(spark):
    df = spark.createDataFrame([(c,) for c in [1] * 6 + [0] * 3 + [-1]], "t int")
    weighted = metrics.with_class_weights(df, "t", 1.3)
    assert weighted.agg(F.sum("weight")).first()[0] == pytest.approx(10.0)
    raised = metrics.specialist_weights(weighted, "t", "weight")
    assert raised.agg(F.sum("weight")).first()[0] == pytest.approx(10.0)


def test_feature_columns_leave_out_ids_and_targets(features):
    names = metrics.feature_columns(features)
    assert "neutral" in names and "elo_diff" in names
    assert not {"match_id", "home_goals", "target", "target_multiclass", "goal_diff", "pool_id"} & set(names)


def _variants(spark, calibrated):
    rows = [("uncalibrated", 0.50, 0.55, 0.95, 0.05, 0.30), ("sigmoid", *calibrated)]
    return report.deployment_decisions(spark.createDataFrame(
        rows, "variant string, macro_f1 double, weighted_f1 double, log_loss double, expected_calibration_error double, draw_recall double"))


def test_variant_that_loses_draws_is_rejected(spark):
    out = _variants(spark, (0.49, 0.54, 0.90, 0.02, 0.10))
    assert out.filter("is_chosen").first()["variant"] == "uncalibrated"


def test_variant_that_keeps_balance_is_chosen(spark):
    out = _variants(spark, (0.495, 0.545, 0.90, 0.02, 0.28))
    assert out.filter("is_chosen").first()["variant"] == "sigmoid"


@pytest.mark.parametrize("second,decision", [
    ((0.9005, 0.5005), "EQUIVALENT_PROMOTE_V2"), ((0.88, 0.52), "PROMOTE_V2"),
    ((0.95, 0.52), "KEEP_V1"), ((0.88, 0.45), "KEEP_V1"),
])
def test_promotion_gate(spark, second, decision):
    v1, v2 = (spark.createDataFrame([pair], "log_loss double, macro_f1 double") for pair in ((0.90, 0.50), second))
    row = report.promotion_gate(v1, v2).first()
    assert row["decision"] == decision
    assert (row["failing"] != "") == (decision == "KEEP_V1")


TUNE = "match_segment string, actual int, g_away double, g_draw double, g_home double, s_away double, s_draw double, s_home double"


def test_tuning_falls_back_when_nothing_improves(spark):
    df = spark.createDataFrame([("friendlies", 1, 0.1, 0.1, 0.8, 0.3, 0.4, 0.3)] * 100, TUNE)
    row = thresholds.tune_thresholds(df).first()
    assert (row["uncertainty"], row["conviction"]) == thresholds.NEVER


def test_tuning_finds_an_improvement(spark):
    rows = [("friendlies", 0, 0.275, 0.275, 0.45, 0.2, 0.6001, 0.1999)] * 10 + [("friendlies", 1, 0.1, 0.1, 0.8, 0.3, 0.3, 0.4)] * 20
    row = thresholds.tune_thresholds(spark.createDataFrame(rows, TUNE)).first()
    assert row["uncertainty"] > 0.45 and row["conviction"] <= 0.60 + 1e-9


def test_grid_equals_brute_force(spark, sample):
    from formline import views
    from formline.operators.standard import with_segment
    from tests.conftest import SMALL

    scored = with_segment(views.predictions(spark, SMALL)).filter("match_segment is not null").persist()
    grid = {(r["match_segment"], r["i"], r["j"]): r for r in thresholds.grid_statistics(scored).collect()}
    rows = scored.collect()
    for i, j in ((0, 0), (5, 3), (9, 7), (17, 12), (17, 0)):
        u, c = thresholds.UNCERTAINTY_GRID[i], thresholds.CONVICTION_GRID[j]
        for seg in {r["match_segment"] for r in rows}:
            fired = sum(
                1 for r in rows if r["match_segment"] == seg and max(r["g_away"], r["g_draw"], r["g_home"]) < u
                and r["s_draw"] > r["s_away"] and r["s_draw"] >= r["s_home"] and r["s_draw"] >= c
            )
            assert grid[seg, i, j]["overrides"] == fired


def test_invalid_thresholds(spark):
    df = spark.createDataFrame([("a", 0.4, 0.5), ("b", 1.2, 0.5), ("c", 0.4, None)], "match_segment string, uncertainty double, conviction double")
    assert {r["match_segment"] for r in thresholds.invalid_thresholds(df).collect()} == {"b", "c"}


def test_argmax_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.3, 0.3, 0.4)], "a double, d double, h double")
    got = [r[0] for r in df.select(outcomes.argmax_class(F.col("a"), F.col("d"), F.col("h"))).collect()]
    assert got == [-1, 0, 1]


def test_zero_rows_stay_zero(spark):
    row = spark.range(1).select(*outcomes.normalise(F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()
    assert tuple(row) == (0.0, 0.0, 0.0)
