"""Model families on pyspark.ml, with probabilities as three columns.

Every family turns a prepared frame (features plus the class column) into a
`Fitted` object that scores any frame with the same feature columns. Class
weights enter once, through `weightCol`.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions import outcomes
from formline.operators import metrics, thresholds
from formline.plans import boosting
from formline.plans.calibration import Calibrator, calibrate
from formline.plans.preparation import InputPreparation, PreparedInputs
from formline.sources.folders import stored

SEED = 42
MAX_ITER = 2500  # fixed value of the search space
DRAW_CAP = 0.999
SPECIALIST_MULTIPLIER = 4 / 3
ROW = metrics.PROBABILITIES
WORK = ("_features", "_raw", "_probability", "_prediction", "_label", "_weight")
STACK_PARALLELISM = 4
ROWS_PER_TASK = 100_000
DEEPEST = 30  # the deepest tree the library grows; stands for "no limit"


@dataclass(frozen=True)
class Candidate:
    """A model to try: family, hyperparameters and the draw boost of its weights."""

    name: str
    family: str
    params: dict = field(default_factory=dict)
    draw_boost: float = 1.0


@dataclass
class Fitted:
    candidate: Candidate
    features: list[str]
    parts: dict[str, object] = field(default_factory=dict)
    constants: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """Adds p_away, p_draw, p_home and predicted (and is_override for ensembles)."""
        if self.candidate.family in ("hybrid_override", "segment_aware_hybrid"):
            return _score_hybrid(self, df)
        scored = _row_of(self, df, ROW)
        return scored.withColumn("predicted", outcomes.argmax_class(*[F.col(c) for c in ROW]))


# ---- preparation ------------------------------------------------------------


def usable_features(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least one value; an all-NULL column cannot be imputed."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] > 0]


def as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Model inputs as doubles, NaN as NULL."""
    clean = {}
    for c in columns:
        value = F.col(c).cast("double")
        clean[c] = F.when(~F.isnan(value), value)
    return df.withColumns(clean)


def preparation(columns: list[str], scaled: bool) -> list:
    """Exact median imputation and, for linear models, standardisation by the population deviation."""
    return [InputPreparation(inputCols=columns, outputCol="_features", scaled=scaled)]


def _drop_work(df: DataFrame) -> DataFrame:
    return df.drop(*WORK)


def _classifier(kind: str, **params):
    common = {
        "featuresCol": "_features", "labelCol": "_label", "weightCol": "_weight",
        "predictionCol": "_prediction", "rawPredictionCol": "_raw",
    }
    if kind == "logistic":
        return LogisticRegression(
            **common, probabilityCol="_probability", standardization=False, **params
        )
    return RandomForestClassifier(**common, probabilityCol="_probability", seed=SEED, **params)


def _penalty(total_weight: float, c: float) -> float:
    """regParam of an average loss that equals a summed loss with inverse strength C."""
    return 1.0 / (c * total_weight)


def weighted(df: DataFrame, target: str, draw_boost: float = 1.0) -> DataFrame:
    """Balanced, draw-boosted row weights in `_weight` and the label in `_label`."""
    return metrics.with_class_weights(df, target, draw_boost).withColumnRenamed("weight", "_weight").withColumn(
        "_label", F.col(target) + 1.0
    )


# ---- fitting ----------------------------------------------------------------


def fit(candidate: Candidate, df: DataFrame, columns: list[str], target: str = "target_multiclass") -> Fitted:
    """Fits one candidate. A weight builder may be given as params["weights"]."""
    used = usable_features(df, columns)
    builder: Callable = candidate.params.get("weights") or weighted
    rows = builder(as_doubles(df, used), target, candidate.draw_boost)
    return _FIT[candidate.family](candidate, rows, used, target)


def _fit_prior(candidate: Candidate, rows: DataFrame, columns: list[str], target: str) -> Fitted:
    shares = rows.groupBy(target).agg(F.sum("_weight").alias("w")).collect()
    total = sum(r["w"] for r in shares)
    prior = {str(r[target]): r["w"] / total for r in shares}
    return Fitted(candidate, columns, constants={"prior": prior})


def _converged(model: PipelineModel, name: str) -> PipelineModel:
    """Says so if a logistic fit ended at its iteration limit."""
    last = model.stages[-1]
    if isinstance(last, LogisticRegressionModel) and last.hasSummary and last.summary.totalIterations >= last.getMaxIter():
        warnings.warn(f"{name}: stopped after {last.getMaxIter()} iterations", stacklevel=2)
    return model


def _given(candidate: Candidate, kind: str) -> PreparedInputs | None:
    """A preparation of the same rows that the caller has: params["prepared"] is (of all rows, of the decided ones)."""
    return candidate.params["prepared"][kind == "home"] if "prepared" in candidate.params else None


def _learned(estimator, columns: list[str], scaled: bool, rows: DataFrame, name: str, stage: PreparedInputs | None = None) -> PipelineModel:
    """Preparation and the library's fit. Its hundreds of short jobs cost by the task, so tasks get ROWS_PER_TASK rows each."""
    stage = stage or preparation(columns, scaled)[0].fit(rows)
    filled = stage.transform(rows).select("_features", "_label", "_weight")
    model = estimator.fit(filled.coalesce(max(1, -(-rows.count() // ROWS_PER_TASK))))
    return _converged(PipelineModel([stage, model]), name)


def _fit_one(kind: str, scaled: bool, params: Callable[[dict, float], dict]):
    def run(candidate: Candidate, rows: DataFrame, columns: list[str], target: str) -> Fitted:
        total = rows.agg(F.sum("_weight")).first()[0]
        estimator = _classifier(kind, **params(candidate.params, total))
        return Fitted(candidate, columns, {"model": _learned(estimator, columns, scaled, rows, candidate.name, _given(candidate, "classes"))})

    return run


def _settled(candidate: Candidate, rows: DataFrame, columns: list[str], target: str,
             wanted: dict[str, tuple[str, float, str]]) -> dict[str, PipelineModel] | None:
    """Logistic parts brought to their optimum in passes that they share: name -> (kind, inverse penalty, weight column). None
    for a given iteration limit and where there is no such optimum; the library's solver does those."""
    from formline.plans import search

    if "max_iter" in candidate.params:
        return None
    found = search.converged(rows, columns, target, wanted)
    return found and {name: PipelineModel([stage, _logistic_model(beta)]) for name, (stage, beta) in found.items()}


def _logistic_model(beta: np.ndarray) -> LogisticRegressionModel:
    """The library's model from coefficients with the intercept last, a row a class or one row for two classes."""
    sc, several = SparkContext._active_spark_context, len(beta) > 1
    offsets = beta[:, -1] - (beta[:, -1].mean() if several else 0.0)
    weights = DenseMatrix(*beta[:, :-1].shape, beta[:, :-1].ravel(), True)
    made = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"LogisticRegression_{uuid.uuid4().hex[:12]}", _py2java(sc, weights), _py2java(sc, DenseVector(offsets)), max(2, len(beta)), several)
    model = LogisticRegressionModel(made)
    model._resetUid(made.uid())
    return model._set(featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_prediction",
                      rawPredictionCol="_raw", probabilityCol="_probability")


def _fit_logistic(candidate: Candidate, rows: DataFrame, columns: list[str], target: str) -> Fitted:
    parts = _settled(candidate, rows, columns, target, {"model": ("classes", candidate.params["c"], "_weight")})
    return Fitted(candidate, columns, parts) if parts else _fit_one("logistic", True, _logistic_params)(candidate, rows, columns, target)


def _fit_two_stage(candidate: Candidate, rows: DataFrame, columns: list[str], target: str) -> Fitted:
    """Draw against the rest, then home against away on the rest."""
    rest = rows.filter(F.col(target) != 0)
    if rest.limit(1).isEmpty():
        raise ValueError("the second stage needs matches that are not draws")
    stages = {
        "draw": (rows.withColumn("_label", (F.col(target) == 0).cast("double")), candidate.params["stage1_c"]),
        "home": (rest.withColumn("_label", (F.col(target) == 1).cast("double")), candidate.params["stage2_c"]),
    }
    constants = {"scale": candidate.params.get("scale", 1.0)}
    parts = _settled(candidate, rows, columns, target, {name: (name, c, "_weight") for name, (_, c) in stages.items()})
    if parts:
        return Fitted(candidate, columns, parts, constants)
    parts = {}
    for name, (part, c) in stages.items():
        total = part.agg(F.sum("_weight")).first()[0]
        estimator = _classifier(
            "logistic", family="binomial", regParam=_penalty(total, c),
            maxIter=candidate.params.get("max_iter", MAX_ITER),
        )
        parts[name] = _learned(estimator, columns, True, part, candidate.name, _given(candidate, name))
    return Fitted(candidate, columns, parts, constants)


def _fit_hybrid(candidate: Candidate, rows: DataFrame, columns: list[str], target: str) -> Fitted:
    """A generalist and, with raised draw weights, a two-stage specialist."""
    p = candidate.params
    for name in ("uncertainty", "conviction"):
        if not p.get("segments") and not 0 < p.get(name, 0.5) < 1:
            raise ValueError(f"{name} must lie between 0 and 1")
    steps = {k: p[k] for k in ("max_iter", "prepared") if k in p}
    generalist = Candidate("generalist", "logistic", {"c": p.get("generalist_c", 2.0), **steps})
    stages = {"stage1_c": p.get("stage1_c", 2.0), "stage2_c": p.get("stage2_c", 1.0)}
    specialist = Candidate("specialist", "two_stage", {**stages, **steps})
    multiplier = p.get("multiplier", SPECIALIST_MULTIPLIER)
    together = rows if steps else metrics.specialist_weights(rows.withColumn("_raised", F.col("_weight")), target, "_raised", multiplier)
    parts = _settled(candidate, together, columns, target, {
        "model": ("classes", generalist.params["c"], "_weight"), "draw": ("draw", stages["stage1_c"], "_raised"),
        "home": ("home", stages["stage2_c"], "_raised")})
    if parts:
        return Fitted(candidate, columns, {
            "generalist": Fitted(generalist, columns, {"model": parts.pop("model")}),
            "specialist": Fitted(specialist, columns, parts, {"scale": 1.0})})
    raised = metrics.specialist_weights(rows, target, "_weight", multiplier)
    return Fitted(
        candidate,
        columns,
        {
            "generalist": _FIT["logistic"](generalist, rows, columns, target),
            "specialist": _fit_two_stage(specialist, raised, columns, target),
        },
    )


def _logistic_params(p: dict, total: float) -> dict:
    return {
        "family": "multinomial", "regParam": _penalty(total, p["c"]), "maxIter": p.get("max_iter", MAX_ITER),
    }


def _forest_params(p: dict, total: float) -> dict:
    return {
        "numTrees": p["trees"], "maxDepth": p["depth"] or DEEPEST, "minInstancesPerNode": p["leaf"],
    }


def _fit_boosting(candidate: Candidate, rows: DataFrame, columns: list[str], target: str) -> Fitted:
    """One joint softmax: three trees a round; the trees are part of the model's description."""
    p = candidate.params
    prepared = Pipeline(stages=preparation(columns, False)).fit(rows)
    names = [f"_input{i}" for i in range(len(columns))]
    filled = rows.select("_label", "_weight", *[v.alias(n) for v, n in zip(prepared.stages[0].values(), names)])
    trees = boosting.learn(filled, names, "_label", "_weight", p["trees"], p["depth"], p["rate"], p.get("penalty", 1.0), seed=SEED)
    return Fitted(candidate, columns, {"preparation": prepared}, {"boosting": trees})


def _fit_stack(candidate: Candidate, rows: DataFrame, columns: list[str], target: str) -> Fitted:
    """Base models, out-of-fold rows for the meta model, then base models on all rows."""
    bases: list[Candidate] = candidate.params["bases"]
    folds = candidate.params.get("folds", 5)
    key = candidate.params.get("key", "match_id")
    fold = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(folds))
    source = stored(rows.drop("_weight", "_label").withColumn("_fold", fold))
    inputs = [f"_{i}_{p}" for i in range(len(bases)) for p in ROW]
    tasks = [(k, i) for k in [*range(folds), None] for i in range(len(bases))]

    def one(task: tuple[int | None, int]) -> Fitted:
        k, i = task
        return fit(bases[i], source if k is None else source.filter(F.col("_fold") != k), columns, target)

    # The fits do not need each other.
    with ThreadPool(STACK_PARALLELISM) as pool:
        fitted = dict(zip(tasks, pool.map(one, tasks, 1)))
    scored = []
    for k in range(folds):
        part = source.filter(F.col("_fold") == k)
        for i in range(len(bases)):
            part = _row_of(fitted[k, i], part, tuple(f"_{i}_{p}" for p in ROW))
        scored.append(part)
    steps = {"max_iter": candidate.params["max_iter"]} if "max_iter" in candidate.params else {}
    # Written, so that the passes of the meta model do not score again.
    meta = fit(Candidate("meta", "logistic", {"c": 1.0, **steps}), stored(reduce(DataFrame.unionByName, scored)), inputs, target)
    return Fitted(candidate, columns, {**{f"base{i}": fitted[None, i] for i in range(len(bases))}, "meta": meta})


_FIT = {
    "dummy": _fit_prior,
    "logistic": _fit_logistic,
    "forest": _fit_one("forest", False, _forest_params),
    "boosting": _fit_boosting,
    "two_stage": _fit_two_stage,
    "hybrid_override": _fit_hybrid,
    "segment_aware_hybrid": _fit_hybrid,
    "stacking": _fit_stack,
}


# ---- scoring ----------------------------------------------------------------


def _array_of(model: PipelineModel, df: DataFrame, columns: list[str], output: str) -> DataFrame:
    out = model.transform(as_doubles(df, columns))
    return _drop_work(out.withColumn(output, vector_to_array(F.col("_probability"))))


def _row_of(fitted: Fitted, df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    family, columns = fitted.candidate.family, fitted.features
    if family == "dummy":
        prior = {int(float(k)): F.lit(v) for k, v in fitted.constants["prior"].items()}
        return df.withColumns(dict(zip(names, outcomes.align(prior))))
    if family == "two_stage":
        staged = _array_of(fitted.parts["draw"], df, columns, "_draw_row")
        staged = _array_of(fitted.parts["home"], staged, columns, "_home_row")
        draw = F.least(F.greatest(F.col("_draw_row")[1] * fitted.constants["scale"], F.lit(0.0)), F.lit(DRAW_CAP))
        away, home = (1 - draw) * F.col("_home_row")[0], (1 - draw) * F.col("_home_row")[1]
        return staged.withColumns(dict(zip(names, outcomes.normalise(away, draw, home)))).drop("_draw_row", "_home_row")
    if family == "stacking":
        bases = fitted.candidate.params["bases"]
        inputs = tuple(tuple(f"_{i}_{p}" for p in ROW) for i in range(len(bases)))
        stacked = df
        for i, base_names in enumerate(inputs):
            stacked = _row_of(fitted.parts[f"base{i}"], stacked, base_names)
        return _row_of(fitted.parts["meta"], stacked, names).drop(*[n for group in inputs for n in group])
    if family in ("hybrid_override", "segment_aware_hybrid"):
        scored = _score_hybrid(fitted, df)
        return scored.withColumnsRenamed(dict(zip(ROW, names))).drop("predicted", "is_override")
    if family == "boosting":
        # Columns of the frame keep their values: they go beside the doubles and come back.
        wide = as_doubles(df.withColumn("_kept", F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])), columns)
        values = fitted.parts["preparation"].stages[0].values()
        scored = wide.withColumn("_row", boosting.probabilities(df.sparkSession, fitted.constants["boosting"], values))
        scored = scored.withColumns({c: F.col(f"_kept._{i}") for i, c in enumerate(columns)}).drop("_kept")
        return scored.withColumns({n: F.col("_row")[k] for k, n in enumerate(names)}).drop("_row")
    scored = _array_of(fitted.parts["model"], df, columns, "_row")
    cells = [F.coalesce(F.try_element_at("_row", F.lit(k + 1)), F.lit(0.0)) for k in range(3)]
    return scored.withColumns(dict(zip(names, outcomes.normalise(*cells)))).drop("_row")


def score_pair(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Generalist and specialist rows of an ensemble side by side."""
    both = _row_of(fitted.parts["generalist"], df, thresholds.GENERALIST)
    return _row_of(fitted.parts["specialist"], both, thresholds.SPECIALIST)


def _score_hybrid(fitted: Fitted, df: DataFrame) -> DataFrame:
    p = fitted.candidate.params
    both = score_pair(fitted, df)
    if fitted.candidate.family == "segment_aware_hybrid":
        table = thresholds.threshold_table(df.sparkSession, p["segments"])
        limited = thresholds.with_thresholds(both, table, tuple(p.get("default", thresholds.DEFAULTS)))
    else:
        limited = both.withColumns(
            {"uncertainty": F.lit(p["uncertainty"]), "conviction": F.lit(p["conviction"])}
        )
    blended = thresholds.with_override(limited)
    return blended.drop(*thresholds.GENERALIST, *thresholds.SPECIALIST, "uncertainty", "conviction")


# ---- candidate list ---------------------------------------------------------


def _name(prefix: str, **values) -> str:
    return "_".join([prefix, *[f"{k}{v:g}" if isinstance(v, float) else f"{k}{v}" for k, v in values.items()]])


# Thresholds of the hand-made segment variants as (uncertainty, conviction).
HAND_MADE_SEGMENTS = {
    "conservative": {"friendlies": (0.38, 0.58), "worldcup": (0.52, 0.62), "continental": (0.44, 0.58),
                     "qualifiers": (0.48, 0.60), "default": (0.45, 0.55)},
    "friendlies_focus": {"friendlies": (0.32, 0.52), "worldcup": (0.55, 0.65), "continental": (0.46, 0.58),
                         "qualifiers": (0.50, 0.60), "default": (0.48, 0.58)},
    "balanced": {"friendlies": (0.36, 0.55), "worldcup": (0.50, 0.60), "continental": (0.42, 0.56),
                 "qualifiers": (0.46, 0.58), "default": (0.44, 0.55)},
    "narrow_band": {"friendlies": (0.40, 0.60), "worldcup": (0.55, 0.65), "continental": (0.48, 0.60),
                    "qualifiers": (0.50, 0.62), "default": (0.48, 0.58)},
}


def candidate_list(tuned: dict[str, tuple[float, float]] | None = None) -> list[Candidate]:
    """The search space: 23 candidates, plus one tuned or four hand-made segment ensembles."""
    out = [Candidate("dummy_prior", "dummy")]
    # Hyperparameters of the search space.
    for c, boost in ((0.5, 1.0), (1.0, 1.0), (2.0, 1.0), (1.0, 1.25), (2.0, 1.2)):
        out.append(Candidate(_name("logistic", c=c, draw=boost), "logistic", {"c": c}, boost))
    for trees, depth, leaf, boost in ((300, None, 2, 1.0), (400, 12, 2, 1.0), (300, 12, 4, 1.15)):
        name = _name("random_forest", n=trees, d=depth or "none", leaf=leaf, draw=boost)
        out.append(Candidate(name, "forest", {"trees": trees, "depth": depth, "leaf": leaf}, boost))
    for trees, depth, rate, penalty, boost in ((300, 6, 0.05, 1.0, 1.0), (350, 4, 0.05, 1.0, 1.0), (400, 4, 0.03, 2.0, 1.0), (350, 5, 0.05, 1.5, 1.15)):
        name = _name("boosting", n=trees, d=depth, lr=rate, penalty=penalty, draw=boost)
        out.append(Candidate(name, "boosting", {"trees": trees, "depth": depth, "rate": rate, "penalty": penalty}, boost))
    for first, second, boost, scale in ((2.0, 1.0, 1.6, 1.0), (2.0, 1.0, 1.8, 1.08), (1.0, 2.0, 2.0, 1.1)):
        name = _name("two_stage", s1c=first, s2c=second, draw=boost, scale=scale)
        out.append(Candidate(name, "two_stage", {"stage1_c": first, "stage2_c": second, "scale": scale}, boost))
    for u in (0.42, 0.45, 0.48):
        for c in (0.50, 0.60):
            out.append(Candidate(_name("hybrid_override", u=u, d=c), "hybrid_override",
                                 {"uncertainty": u, "conviction": c}, 1.2))
    if tuned is not None:
        out.append(Candidate("seg_hybrid_auto_tuned", "segment_aware_hybrid", {"segments": tuned}, 1.2))
    else:
        for tag, limits in HAND_MADE_SEGMENTS.items():
            segments = {s: v for s, v in limits.items() if s != "default"}
            out.append(Candidate(f"seg_hybrid_{tag}", "segment_aware_hybrid",
                                 {"segments": segments, "default": limits["default"]}, 1.2))
    return out


# ---- saving -----------------------------------------------------------------


def _describe(fitted: Fitted) -> dict:
    c = fitted.candidate
    params = {k: v for k, v in c.params.items() if k not in ("weights", "bases", "prepared")}
    if "bases" in c.params:
        params["bases"] = [[b.name, b.family, b.params, b.draw_boost] for b in c.params["bases"]]
    return {
        "name": c.name, "family": c.family, "params": params, "draw_boost": c.draw_boost,
        "features": fitted.features, "constants": fitted.constants,
        "parts": {k: _describe(v) if isinstance(v, Fitted) else "spark_ml" for k, v in fitted.parts.items()},
    }


def _save_parts(fitted: Fitted, path: str) -> None:
    for name, part in fitted.parts.items():
        if isinstance(part, Fitted):
            _save_parts(part, f"{path}/{name}")
        else:
            part.write().overwrite().save(f"{path}/{name}")


def save(fitted: Fitted, path: str, spark: SparkSession, calibrator: Calibrator | None = None, **facts) -> None:
    """Models below `path`, the description as one JSON line in path/about."""
    _save_parts(fitted, f"{path}/model")
    values = {"method": calibrator.method, "parts": calibrator.parts} if calibrator else None
    about = {"model": _describe(fitted), "calibration": values, **facts}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def _load_parts(about: dict, path: str) -> Fitted:
    params = dict(about["params"])
    if "bases" in params:
        params["bases"] = [Candidate(*b) for b in params["bases"]]
    fitted = Fitted(
        Candidate(about["name"], about["family"], params, about["draw_boost"]),
        about["features"], constants=about["constants"],
    )
    for name, part in about["parts"].items():
        fitted.parts[name] = (
            PipelineModel.load(f"{path}/{name}") if part == "spark_ml" else _load_parts(part, f"{path}/{name}")
        )
    return fitted


def load(path: str, spark: SparkSession) -> tuple[Fitted, Calibrator | None, dict]:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    fitted = _load_parts(about["model"], f"{path}/model")
    return fitted, Calibrator(**about["calibration"]) if about["calibration"] else None, about


def feature_importances(fitted: Fitted, spark: SparkSession, limit: int = 15) -> DataFrame:
    """Largest importances of a fitted forest (one value per feature)."""
    weights = fitted.parts["model"].stages[-1].featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(fitted.features, weights)), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(limit)
