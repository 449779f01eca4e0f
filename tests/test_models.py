import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from formline.operators import metrics, snapshots
from formline.plans import calibration, formulas, models, preparation, scoring, training
from formline.plans.models import Candidate

COLUMNS = ["elo_diff", "home_win_rate_last5", "away_win_rate_last5"]
FOREST = Candidate("forest", "forest", {"trees": 3, "depth": 3, "leaf": 2})
SEGMENTS = Candidate("seg", "segment_aware_hybrid", {"segments": {"friendlies": (0.9, 0.05)}, "max_iter": 3}, 1.2)


@pytest.fixture(scope="module")
def fitted(features):
    return {c.name: models.fit(c, features, COLUMNS) for c in (FOREST, SEGMENTS)}


def test_rows_sum_to_one(features, fitted):
    for model in fitted.values():
        off = model.score(features).filter(F.abs(F.col("p_away") + F.col("p_draw") + F.col("p_home") - 1) > 1e-9)
        assert off.isEmpty()


def test_overrides_only_in_the_configured_segment(features, fitted):
    fired = fitted["seg"].score(features).filter("is_override")
    assert fired.filter("match_segment is null or match_segment <> 'friendlies'").isEmpty()
    assert fired.filter("predicted <> 0").isEmpty()


def test_saved_model_scores_the_same(spark, features, fitted, tmp_path):
    for name, model in fitted.items():
        models.save(model, str(tmp_path / name), spark)
        loaded, calibrator, about = models.load(str(tmp_path / name), spark)
        assert calibrator is None and about["model"]["family"] == model.candidate.family
        left, right = (m.score(features).select("match_id", "p_draw") for m in (model, loaded))
        assert left.exceptAll(right).isEmpty()


def test_scoring_with_shadow_and_swap(features, fitted):
    history = snapshots.team_snapshots(features)
    asked = features.select("match_id", "match_date", F.lower("home_team").alias("home_team"), "away_team", "tournament", "neutral")
    scored, rejected = scoring.score_requests(asked, history, fitted["forest"], fitted["seg"])
    assert scored.count() == asked.count() and rejected.isEmpty()
    assert scored.filter("shadow_predicted_outcome is null").isEmpty()
    swapped, _ = scoring.score_requests(asked, history, fitted["forest"], fitted["seg"], swap=True)
    assert swapped.first()["shadow_model_name"] == "forest"
    as_of, _ = scoring.score_requests(asked, history, fitted["forest"], as_of_request=True)
    assert as_of.first()["feature_source"] == "snapshots_as_of"


def test_calibration_improves_log_loss(spark):
    rows = [(i, a, 0.05, 0.05, 0.9) for i, a in enumerate([1, 0, -1, 1, 0, -1] * 20)]
    df = spark.createDataFrame(rows, "match_id int, target_multiclass int, p_away double, p_draw double, p_home double")
    df = df.withColumns({"actual": F.col("target_multiclass"), "predicted": F.lit(1)})
    before = metrics.evaluate(df).first()["log_loss"]
    for method in ("sigmoid", "isotonic"):
        after = metrics.evaluate(models.calibrate(df, method).apply(df)).first()["log_loss"]
        assert after < before


def test_candidate_names_are_unique():
    names = [c.name for c in models.candidate_list()]
    assert len(names) == len(set(names)) == 26
    assert len(models.candidate_list({"friendlies": (0.4, 0.5)})) == 23


def test_backtest_ranks_every_candidate(features):
    folds, ranking = training.backtest([Candidate("prior", "dummy"), FOREST], features, COLUMNS, splits=3)
    assert folds.count() == 6
    assert sorted(r["selection_rank"] for r in ranking.collect()) == [1, 2]


def test_two_stage_needs_decided_matches(spark):
    df = spark.createDataFrame([(i, 0, float(i)) for i in range(5)], "match_id int, target_multiclass int, x double")
    with pytest.raises(ValueError, match="not draws"):
        models.fit(Candidate("t", "two_stage", {"stage1_c": 1.0, "stage2_c": 1.0}), df, ["x"])


def test_edition_slice_falls_back(sample):
    assert scoring.edition_slice(sample, "FIFA World Cup", 1930).count() == 64
    assert scoring.edition_slice(sample, "FIFA World Cup", 2024).filter("tournament <> 'FIFA World Cup'").isEmpty()


def test_job_skips_stages_and_keeps_layers(spark, sample, tmp_path):
    from formline.plans import job

    folder = str(tmp_path / "layers")
    first = {r["stage"]: r for r in job.run(spark, sample, None, folder, ["pool_id"], skip=("train",), run_id="r1").collect()}
    assert first["train"]["status"] == "skipped" and first["process"]["rows"] == first["ingest"]["rows"] > 900
    gold = spark.read.parquet(f"{folder}/gold")
    assert gold.filter("pipeline_run_id <> 'r1'").isEmpty()
    second = {r["stage"]: r["status"] for r in job.run(spark, sample, None, folder, skip=job.STAGES).collect()}
    assert set(second.values()) == {"skipped"}
    with pytest.raises(ValueError, match="unknown stages"):
        job.run(spark, sample, None, folder, skip=("deploy",))


def test_both_feeds_meet_in_silver(spark, sample, tmp_path):
    from formline.plans import job

    api = sample.withColumn("match_id", F.col("match_id") + 10_000)
    out = job.run(spark, sample, api, str(tmp_path / "both"), ["pool_id"], skip=("process", "train")).first()
    keys = sample.select("match_date", "home_team", "away_team", "home_goals", "away_goals").distinct().count()
    assert out["rows"] == keys


def test_job_from_the_feeds_files(spark, sample, tmp_path):
    from formline.plans import job

    text = sample.select(
        F.col("match_date").cast("string").alias("date"), "home_team", "away_team",
        F.when(F.col("match_id") % 10 == 0, "NA").otherwise(F.col("home_goals").cast("string")).alias("home_score"),
        F.col("away_goals").cast("string").alias("away_score"), "tournament", F.lit("T").alias("city"), "country",
        F.col("neutral").cast("string").alias("neutral"))
    text.write.option("header", True).csv(str(tmp_path / "csv"))
    folder = str(tmp_path / "layers")
    out = job.from_sources(spark, str(tmp_path / "csv"), None, folder, skip=("train",)).collect()
    scored = sample.filter("match_id % 10 <> 0").select("match_date", "home_team", "away_team", "home_goals", "away_goals").distinct().count()
    assert [(r["stage"], r["status"], r["rows"]) for r in out] == [
        ("ingest", "done", scored), ("process", "done", scored), ("train", "skipped", None)]
    silver = spark.read.parquet(f"{folder}/silver")
    assert silver.select("match_id").distinct().count() == scored
    assert spark.read.parquet(f"{folder}/bronze/historical").count() == sample.count()


def max_min(hits, n):
    """Isotonic fit by the max-min formula."""
    m = len(hits)
    return [max(min(sum(hits[j:k + 1]) / sum(n[j:k + 1]) for k in range(i, m)) for j in range(i + 1)) for i in range(m)]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_isotonic_equals_the_max_min_formula(spark, ranges):
    rnd = random.Random(ranges)
    counts = [("p_away", i / 50, float(rnd.randrange(3)), 2.0 + rnd.randrange(3)) for i in range(50)] + [("p_draw", 0.5, 1.0, 4.0)]
    knots = calibration.isotonic(spark.createDataFrame(counts, "class string, score double, hits double, n double"), ranges)
    want = max_min([c[2] for c in counts[:50]], [c[3] for c in counts[:50]])
    got = np.interp([c[1] for c in counts[:50]], knots["p_away"]["x"], knots["p_away"]["y"])
    assert np.allclose(got, want)
    assert knots["p_draw"] == {"x": [0.5], "y": [0.25]}


def test_sigmoid_is_a_stationary_point(spark):
    rnd = random.Random(2)
    rows = [("p_away", i / 40, float(rnd.random() < i / 40), 1.0) for i in range(40)]
    fit = calibration.sigmoid(spark.createDataFrame(rows, "class string, score double, hits double, n double"))["p_away"]
    hits = sum(r[2] for r in rows)
    aims = [(hits + 1) / (hits + 2) if r[2] else 1 / (40 - hits + 2) for r in rows]
    rest = [t - 1 / (1 + np.exp(-(fit["slope"] * r[1] + fit["offset"]))) for r, t in zip(rows, aims)]
    assert abs(sum(rest)) < 1e-9 and abs(sum(e * r[1] for e, r in zip(rest, rows))) < 1e-9
    # Separated scores and a single score still give finite values.
    for some in ([("p_away", 0.1, 0.0, 9.0), ("p_away", 0.9, 9.0, 9.0)], [("p_away", 0.4, 3.0, 9.0)]):
        fit = calibration.sigmoid(spark.createDataFrame(some, "class string, score double, hits double, n double"))["p_away"]
        assert np.isfinite([fit["slope"], fit["offset"]]).all()


def test_saved_calibrators_map_the_same(spark, features, fitted, tmp_path):
    scored = fitted["forest"].score(features)
    for method in ("sigmoid", "isotonic"):
        calibrator = models.calibrate(scored, method)
        models.save(fitted["forest"], str(tmp_path / method), spark, calibrator)
        model, loaded, _ = models.load(str(tmp_path / method), spark)
        left, right = (c.apply(m.score(features)).select("match_id", *models.ROW) for c, m in ((calibrator, fitted["forest"]), (loaded, model)))
        assert left.exceptAll(right).isEmpty()
        assert left.filter("abs(p_away + p_draw + p_home - 1) > 1e-9").isEmpty()


def test_preparation_is_exact_and_survives_saving(spark, tmp_path):
    rows = [(1.0, None, 5.0), (2.0, 4.0, 5.0), (10.0, 8.0, None), (None, None, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    model = Pipeline(stages=models.preparation(["a", "b", "c"], True)).fit(df)
    model.write().save(str(tmp_path / "prepared"))
    for fitted in (model, PipelineModel.load(str(tmp_path / "prepared"))):
        got = np.array([r["_features"].toArray() for r in fitted.transform(df).collect()])
        filled = np.array([[1, 6, 5], [2, 4, 5], [10, 8, 5], [2, 6, 5]], float)
        deviation = filled.std(axis=0)
        assert np.allclose(got, (filled - filled.mean(axis=0)) / np.where(deviation > 0, deviation, 1))


def test_a_changed_coefficient_shows(spark, features, fitted):
    model = fitted["seg"]
    assert formulas.same_scores(model.score(features), formulas.scores(model, features)).filter("not equals_formula").isEmpty()
    stage = model.parts["generalist"].parts["model"].stages[0]
    means = stage.getOrDefault(stage.means)
    changed = stage.copy()._set(means=[means[0] + 0.01, *means[1:]])
    part = model.parts["generalist"]
    other = models.Fitted(part.candidate, part.features, {"model": PipelineModel([changed, part.parts["model"].stages[1]])})
    wrong = models.Fitted(model.candidate, model.features, {**model.parts, "generalist": other})
    assert not formulas.same_scores(model.score(features), formulas.scores(wrong, features)).filter("not equals_formula").isEmpty()


def test_a_fit_draws_its_sample_once(features, monkeypatch):
    from catalog import learning

    drawn = []
    monkeypatch.setattr(learning, "learned_from", lambda rows: drawn.append(rows) or rows.limit(300))
    monkeypatch.setattr(learning, "stored", lambda rows: drawn.append("stored") or rows.persist())
    learning.fitted(models.Candidate("prior", "dummy"), features)
    assert len(drawn) == 2 and drawn[1] == "stored"


def test_a_fit_learns_from_every_labelled_row(spark):
    from catalog import learning

    rows = spark.range(2500).selectExpr("id as match_id", "cast(nullif(id % 4, 3) - 1 as int) as target_multiclass", "cast(id as double) as elo_diff")
    counted = []

    def weights(df, target, boost):
        counted.append(df.count())
        return models.weighted(df, target, boost)

    learning.fitted(Candidate("prior", "dummy", {"weights": weights}), rows)
    assert counted == [1875]


def test_single_fits_reach_their_optimum_in_passes_of_their_own(features, monkeypatch):
    def short_jobs(*_, **__):
        raise AssertionError("the library's solver takes hundreds of passes")

    monkeypatch.setattr(models, "_classifier", short_jobs)
    rows = models.weighted(models.as_doubles(features, COLUMNS), "target_multiclass", 1.2).toPandas()
    for candidate in (Candidate("one", "logistic", {"c": 1.0}, 1.2), Candidate("two", "two_stage", {"stage1_c": 2.0, "stage2_c": 1.0}, 1.2),
                      Candidate("both", "hybrid_override", {"uncertainty": 0.45, "conviction": 0.55}, 1.2)):
        fitted = models.fit(candidate, features, COLUMNS)
        parts = fitted.parts if candidate.family != "hybrid_override" else fitted.parts["generalist"].parts
        for name, part in parts.items():
            own = rows[rows["target_multiclass"] != 0] if name == "home" else rows
            stage, model = part.stages
            medians, means, deviations = (np.array(stage.getOrDefault(p)) for p in (stage.medians, stage.means, stage.deviations))
            raw = own[COLUMNS].to_numpy(float)
            x = (np.where(np.isnan(raw), medians, raw) - means) / deviations
            assert np.abs(x.mean(axis=0)).max() < 1e-9 and np.abs(x.std(axis=0) - 1).max() < 1e-9
            beta, actual = model.coefficientMatrix.toArray(), own["target_multiclass"].to_numpy()
            z = x @ beta.T + model.interceptVector.toArray()
            if name == "model":
                e = np.exp(z - z.max(axis=1, keepdims=True))
                wrong = e / e.sum(axis=1, keepdims=True) - (actual[:, None] == [-1, 0, 1])
            else:
                wrong = 1 / (1 + np.exp(-z)) - (actual == (0 if name == "draw" else 1))[:, None]
            weight = own["_weight"].to_numpy()[:, None]
            c = candidate.params.get({"draw": "stage1_c", "home": "stage2_c"}.get(name, "c"), 2.0)
            gradient = np.c_[(weight * wrong).T @ x + beta / c, (weight * wrong).sum(axis=0)]
            assert np.abs(gradient).max() < 1e-7 * len(own)


def test_groups_are_prepared_as_if_apart(spark):
    rows = spark.range(600, numPartitions=4).select(
        (F.col("id") % 4).cast("int").alias("part"), F.sin(F.col("id") * 1.0).alias("a"),
        F.when(F.col("id") % 3 > 0, F.col("id") * 0.1).alias("b"), F.lit(0.1).alias("c"),
        F.when(F.col("id") % 4 == 3, 1.0 + F.col("id")).alias("d"))
    groups = [[0], [0, 1], [0, 1, 2, 3], [9]]
    found = preparation.prepared_by(rows, ["a", "b", "c", "d"], F.col("part"), groups, True)
    assert found[3] is None
    for group, got in zip(groups[:3], found):
        used = ["a", "b", "c", "d"] if 3 in group else ["a", "b", "c"]
        assert got.getInputCols() == used
        part = rows.filter(F.col("part").isin(group)).toPandas()[used].to_numpy(float)
        medians = np.nanmedian(part, axis=0)
        filled = np.where(np.isnan(part), medians, part)
        deviations = np.where(np.ptp(filled, axis=0) > 0, filled.std(axis=0), 1.0)
        for value, want in ((got.medians, medians), (got.means, filled.mean(axis=0)), (got.deviations, deviations)):
            assert got.getOrDefault(value) == pytest.approx(want.tolist(), rel=1e-12)


def test_a_chosen_shadow_is_fitted_once(features, monkeypatch):
    fits, plain = [], models.fit
    monkeypatch.setattr(models, "fit", lambda c, *rest: fits.append(c.name) or plain(c, *rest))
    segments = Candidate("seg", "segment_aware_hybrid", {"segments": {"friendlies": (0.9, 0.05)}}, 1.2)
    out = training.train_and_select(features, [segments], splits=3, calibration_size=0.25)
    # Before and after the calibration window joins the rows; the backtest has fits of its own.
    assert fits == ["seg", "seg"] and out["shadow"].candidate == out["model"].candidate == segments
