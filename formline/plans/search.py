"""Backtests of the linear families together: shared fits, stacked Newton passes, one out-of-fold table.

Candidates are made of fits: a logistic candidate of one, a two-stage candidate of two, an ensemble of three. Ensembles that
differ in thresholds only have the same three, and a generalist may be a logistic candidate's fit as well, so
every distinct fit is learned once per fold. All fits of all folds advance together: one pass over the rows gives loss,
gradient and curvature of each at its present coefficients (a row counts for every fold after its own), sums meet
in a tree, and the driver takes one damped Newton step per fit. What the driver holds grows with the number of
fits and the square of the number of features, never with the rows.

The scores of each validation row by the fits of its fold are kept as a table. Thresholds, pairs of generalist and specialist
and the rows of every candidate read it; trying other thresholds needs no new fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import outcomes
from formline.operators import ordered, thresholds
from formline.plans import models
from formline.plans.models import Candidate
from formline.plans.preparation import PreparedInputs, prepared_by
from formline.sources.folders import stored

LINEAR = ("logistic", "two_stage", "hybrid_override", "segment_aware_hybrid")
ENSEMBLES = ("hybrid_override", "segment_aware_hybrid")
TOLERANCE = 1e-9  # of the largest gradient entry, as a share of the rows
MOST_PASSES = 100
FAN_IN = 32
RIDGE = 1e-10  # on intercepts, which are only determined up to a shift; a share of the rows


@dataclass(frozen=True)
class Fit:
    """One logistic fit: all classes, draw against the rest, or home against away without draws."""

    kind: str
    c: float
    draw_boost: float
    multiplier: float = 1.0  # raises draw weights of a specialist

    def label(self, actual: np.ndarray) -> np.ndarray:
        return {"classes": actual + 1, "draw": actual == 0, "home": actual == 1}[self.kind].astype(int)

    def weights(self, counts: dict[int, int]) -> np.ndarray:
        """Weight by class: balanced, boosted, raised, each time with the row count as their sum."""
        n = np.array([counts[c] for c in outcomes.CLASSES], float)
        weight = n.sum() / (3 * n)
        for factor in (self.draw_boost, self.multiplier):
            weight = weight * np.array([1.0, factor, 1.0])
            weight *= n.sum() / (weight * n).sum()
        return weight


def shared(candidate: Candidate) -> bool:
    """Whether the candidate can be put together from shared, converged fits."""
    return candidate.family in LINEAR and not {"weights", "max_iter"} & set(candidate.params)


def fits_of(candidate: Candidate) -> dict[str, Fit]:
    p, boost = candidate.params, candidate.draw_boost
    if candidate.family == "logistic":
        return {"generalist": Fit("classes", p["c"], boost)}
    if candidate.family == "two_stage":
        return {"draw": Fit("draw", p["stage1_c"], boost), "home": Fit("home", p["stage2_c"], boost)}
    raised = p.get("multiplier", models.SPECIALIST_MULTIPLIER)
    return {"generalist": Fit("classes", p.get("generalist_c", 2.0), boost),
            "draw": Fit("draw", p.get("stage1_c", 2.0), boost, raised),
            "home": Fit("home", p.get("stage2_c", 1.0), boost, raised)}


@dataclass
class Learned:
    """A fit of one fold: its inputs' preparation, class weights, and coefficients with the intercept last."""

    fit: Fit
    fold: int
    inputs: np.ndarray
    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    weights: np.ndarray
    rows: int
    beta: np.ndarray = field(default=None)
    gradient: float = math.inf  # largest entry, as a share of the rows
    weight_at: int | None = None  # the rows' own weights, in place of weights by class

    def __post_init__(self):
        if self.beta is None:
            self.beta = np.zeros((3 if self.fit.kind == "classes" else 1, len(self.inputs) + 1))

    @property
    def prepared_as(self) -> tuple[int, bool]:
        return self.fold, self.fit.kind == "home"

    def prepared(self, values: np.ndarray) -> np.ndarray:
        x = values[:, self.inputs]
        x = (np.where(np.isnan(x), self.medians, x) - self.means) / self.deviations
        return np.c_[x, np.ones(len(x))]

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.beta.T
        return z if z.shape[1] > 1 else np.c_[np.zeros(len(z)), z]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def sums(self, x: np.ndarray, actual: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """Loss, gradient and curvature over the rows, end to end."""
        label, w = self.fit.label(actual), self.weights[actual + 1] if given is None else given[:, self.weight_at]
        z = self.logits(x)
        top = z.max(axis=1)
        norm = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
        loss = (w * (norm - z[np.arange(len(z)), label])).sum()
        p = np.exp(z - norm[:, None])
        free = p[:, -len(self.beta):]
        hit = (label[:, None] == np.arange(p.shape[1]))[:, -len(self.beta):]
        gradient = (w[:, None] * (free - hit)).T @ x
        k, m = self.beta.shape
        curvature = np.empty((k, m, k, m))
        for i in range(k):
            for j in range(i + 1):
                share = w * free[:, i] * ((i == j) - free[:, j])
                curvature[i, :, j, :] = block = x.T @ (share[:, None] * x)
                curvature[j, :, i, :] = block.T
        return np.concatenate([[loss], gradient.ravel(), curvature.ravel()])


class _Newton:
    """Damped Newton steps of one fit; the penalty leaves intercepts out."""

    def __init__(self, learned: Learned):
        self.learned, self.best, self.step, self.done = learned, math.inf, None, False
        k, m = learned.beta.shape
        self.penalty = np.tile(np.r_[np.full(m - 1, 1 / learned.fit.c), 0.0], k)
        self.ridge = np.tile(np.r_[np.zeros(m - 1), RIDGE * learned.rows], k)

    def take(self, sums: np.ndarray) -> None:
        beta = self.learned.beta.ravel()
        loss = sums[0] + (self.penalty * beta**2).sum() / 2
        if loss > self.best + 1e-11 * abs(self.best):
            self.step /= 2  # too far: back half of the way
            self.learned.beta = (beta - self.step).reshape(self.learned.beta.shape)
            return
        gradient = sums[1:1 + len(beta)] + self.penalty * beta
        self.learned.gradient = float(np.abs(gradient).max() / self.learned.rows)
        if self.learned.gradient <= TOLERANCE:
            self.done = True
            return
        curvature = sums[1 + len(beta):].reshape(len(beta), len(beta)) + np.diag(self.penalty + self.ridge)
        self.best, self.step = loss, -np.linalg.solve(curvature, gradient)
        self.learned.beta = (beta + self.step).reshape(self.learned.beta.shape)


def _added(parts: list[bytes]) -> bytes:
    total = np.frombuffer(parts[0]).copy()
    for part in parts[1:]:
        total += np.frombuffer(part)
    return total.tobytes()


def _pass(rows: DataFrame, fits: list[Learned]) -> dict[int, np.ndarray]:
    """The sums of every fit over the rows before its fold."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            values, fold = np.stack(batch["_values"].to_numpy()), batch["_fold"].to_numpy()
            actual, made = batch["_actual"].to_numpy(), {}
            given = np.stack(batch["_weights"].to_numpy()) if "_weights" in batch else None
            for number, learned in enumerate(fits):
                key = learned.prepared_as
                if key not in made:
                    chosen = (fold < key[0]) & ((actual != 0) | (not key[1]))
                    made = {key: (learned.prepared(values[chosen]), actual[chosen], None if given is None else given[chosen])}
                if len(made[key][1]):
                    part = learned.sums(*made[key])
                    totals[number] = totals[number] + part if number in totals else part
        yield pd.DataFrame({"fit": list(totals), "part": TaskContext.get().partitionId(),
                            "sums": [t.tobytes() for t in totals.values()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fit": group["fit"].iloc[:1], "part": group["part"].iloc[:1] // FAN_IN,
                             "sums": [_added(list(group["sums"]))]})

    schema = "fit int, part int, sums binary"
    sums = rows.mapInPandas(run, schema)
    tasks = rows.rdd.getNumPartitions()
    while True:
        sums = sums.groupBy("fit", F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(add, schema)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return {r["fit"]: np.frombuffer(r["sums"]) for r in sums.collect()}


def learn(rows: DataFrame, fits: list[Learned]) -> list[Learned]:
    """Brings every fit to its optimum. `rows`: _values (NaN: missing), _fold, _actual.

    The first fold has the fewest rows and goes alone; the same fits of later folds start from its coefficients, which
    saves passes over all rows and leaves the optimum as it is."""
    first = min((f.fold for f in fits), default=0)
    early, late = [f for f in fits if f.fold == first], [f for f in fits if f.fold != first]
    done = _optimum(rows.filter(F.col("_fold") < first), early)
    for f in late:
        start = next((e for e in done if e.fit == f.fit and np.array_equal(e.inputs, f.inputs)), None)
        if start is not None:
            f.beta = start.beta.copy()
    return done + _optimum(rows, late)


def _optimum(rows: DataFrame, fits: list[Learned]) -> list[Learned]:
    states = [_Newton(f) for f in sorted(fits, key=lambda f: f.prepared_as)]
    for _ in range(MOST_PASSES):
        moving = [s for s in states if not s.done]
        if not moving:
            return [s.learned for s in states]
        for number, sums in _pass(rows, [s.learned for s in moving]).items():
            moving[number].take(sums)
    raise ArithmeticError(f"{len(moving)} fits moved after {MOST_PASSES} passes")


def converged(rows: DataFrame, columns: list[str], target: str, wanted: dict[str, tuple[str, float, str]]
              ) -> dict[str, tuple[PreparedInputs, np.ndarray]] | None:
    """Fits over all `rows` together: name -> (kind, inverse penalty, weight column) gives name -> (preparation, coefficients
    with the intercept last). None where a class is missing or the steps do not settle."""
    weights = list(dict.fromkeys(w for _, _, w in wanted.values()))
    missing = F.lit(float("nan"))
    table = stored(rows.select(
        F.col(target).cast("int").alias("_actual"), F.lit(0).alias("_fold"), *columns,
        F.array(*[F.coalesce(c, missing) for c in columns]).alias("_values"), F.array(*weights).alias("_weights")))
    counts = {r["_actual"]: r["n"] for r in table.groupBy("_actual").agg(F.count("*").alias("n")).collect()}
    if not columns or set(counts) != set(outcomes.CLASSES):
        return None
    # Draws are part 1: the fit of the decided matches has a preparation of its own.
    kinds = sorted({kind == "home" for kind, _, _ in wanted.values()})
    prepared = dict(zip(kinds, prepared_by(table, columns, (F.col("_actual") == 0).cast("int"), [[0] if k else [0, 1] for k in kinds], True)))
    if None in prepared.values():
        return None
    fits = {name: learned_from(prepared[kind == "home"], columns, Fit(kind, c, 1.0), 1, np.ones(3),
                               counts[-1] + counts[1] + (counts[0] if kind != "home" else 0), weights.index(w))
            for name, (kind, c, w) in wanted.items()}
    try:
        _optimum(table.select("_actual", "_fold", "_values", "_weights"), list(fits.values()))
    except (ArithmeticError, np.linalg.LinAlgError):
        return None
    return {name: (prepared[f.fit.kind == "home"], f.beta) for name, f in fits.items()}


def learned_from(stage: PreparedInputs, columns: list[str], fit: Fit, fold: int, weights: np.ndarray, rows: int,
                 weight_at: int | None = None) -> Learned:
    values = [np.array(stage.getOrDefault(getattr(stage, n))) for n in ("medians", "means", "deviations")]
    inputs = np.array([columns.index(c) for c in stage.getInputCols()], int)
    return Learned(fit, fold, inputs, *values, weights, rows, weight_at=weight_at)


class OutOfFold:
    """Validation rows with the scores of every distinct fit of their fold, as a table."""

    def __init__(self, scores: DataFrame, fits: list[Fit], learned: list[Learned]):
        self.scores, self.fits, self.learned = scores, fits, learned

    def _row(self, fit: Fit) -> Column:
        return F.col(f"fit{self.fits.index(fit)}")

    def _two_stage(self, parts: dict[str, Fit], scale: float) -> tuple[Column, ...]:
        draw = F.least(F.greatest(self._row(parts["draw"])[1] * scale, F.lit(0.0)), F.lit(models.DRAW_CAP))
        home = self._row(parts["home"])
        return outcomes.normalise((1 - draw) * home[0], draw, (1 - draw) * home[1])

    def pairs(self, ensemble: Candidate) -> DataFrame:
        """Generalist and specialist rows of every validation match."""
        parts = fits_of(ensemble)
        both = [*[self._row(parts["generalist"])[i] for i in range(3)], *self._two_stage(parts, 1.0)]
        named = zip(both, thresholds.GENERALIST + thresholds.SPECIALIST)
        return self.scores.select("match_id", "fold", "match_segment", "actual", *[v.alias(n) for v, n in named])

    def rows(self, candidate: Candidate) -> DataFrame:
        """model_name, fold, match_id, match_segment, actual, predicted and the probability row."""
        keys = [F.lit(candidate.name).alias("model_name"), "fold", "match_id", "match_segment", "actual"]
        if candidate.family in ENSEMBLES:
            p = candidate.params
            if candidate.family == "hybrid_override":
                u, c = F.lit(p["uncertainty"]), F.lit(p["conviction"])
            else:
                u, c = (F.lit(x) for x in p.get("default", thresholds.DEFAULTS))
                for segment, (su, sc) in p["segments"].items():
                    here = F.col("match_segment") == segment
                    u, c = F.when(here, su).otherwise(u), F.when(here, sc).otherwise(c)
            limited = self.pairs(candidate).withColumns({"uncertainty": u.cast("double"), "conviction": c.cast("double")})
            return thresholds.with_override(limited).select(*keys, "predicted", *models.ROW)
        parts = fits_of(candidate)
        if candidate.family == "two_stage":
            row = self._two_stage(parts, candidate.params.get("scale", 1.0))
        else:
            row = outcomes.normalise(*[self._row(parts["generalist"])[i] for i in range(3)])
        scored = self.scores.select(*keys, *[v.alias(n) for v, n in zip(row, models.ROW)])
        return scored.withColumn("predicted", outcomes.argmax_class(*[F.col(n) for n in models.ROW]))


def _chunks(train: DataFrame, columns: list[str], target: str, order: list[str], splits: int) -> DataFrame:
    """Rows with the fold that validates them (0: none) and their inputs, written once."""
    segment = F.col("match_segment") if "match_segment" in train.columns else F.lit(None)
    folds = ordered.expanding_folds(train, order, splits)
    parts = [folds[0][0], *[valid for _, valid in folds]]
    missing = F.lit(float("nan"))
    return stored(reduce(DataFrame.unionByName, [
        models.as_doubles(part.select("match_id", segment.cast("string").alias("_segment"), F.col(target).cast("int").alias("_actual"), *columns), columns)
        .select("match_id", "_segment", "_actual", F.lit(number).alias("_fold"), *columns,
                F.array(*[F.coalesce(c, missing) for c in columns]).alias("_values"))
        for number, part in enumerate(parts)]))


def out_of_fold(candidates: list[Candidate], train: DataFrame, columns: list[str], target: str, order: list[str],
                splits: int = 5) -> OutOfFold | None:
    """The distinct fits of the candidates (all `shared`) in every fold. None where a fold lacks a class to learn."""
    fits = list(dict.fromkeys(f for c in candidates for f in fits_of(c).values()))
    rows = _chunks(train, columns, target, order, splits)
    held = rows.groupBy("_fold", "_actual").agg(F.count("*").alias("n")).collect()
    counts = {k: {c: sum(r["n"] for r in held if r["_fold"] < k and r["_actual"] == c) for c in outcomes.CLASSES}
              for k in range(1, splits + 1)}
    if any(n == 0 for by_class in counts.values() for n in by_class.values()):
        return None
    # A fold's draws and its decided matches are parts; each preparation counts the parts before its fold, with or without draws.
    keys = [(k, d) for k in counts for d in sorted({f.kind == "home" for f in fits})]
    groups = [[2 * f + e for f in range(k) for e in ((0,) if decided else (0, 1))] for k, decided in keys]
    part = 2 * F.col("_fold") + (F.col("_actual") == 0).cast("int")
    inputs = dict(zip(keys, prepared_by(rows, columns, part, groups, True)))
    small = rows.select("match_id", "_segment", "_actual", "_fold", "_values")
    learned = learn(small, [
        learned_from(inputs[k, fit.kind == "home"], columns, fit, k, fit.weights(counts[k]),
                     counts[k][-1] + counts[k][1] + (counts[k][0] if fit.kind != "home" else 0))
        for k in counts for fit in fits])
    places = {(f.fold, fits.index(f.fit)): f for f in learned}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, part in batch.groupby("_fold"):
                values = np.stack(part["_values"].to_numpy())
                out = pd.DataFrame({"match_id": part["match_id"], "fold": int(fold), "match_segment": part["_segment"], "actual": part["_actual"]})
                for number in range(len(fits)):
                    f = places[int(fold), number]
                    out[f"fit{number}"] = list(f.probabilities(f.prepared(values)))
                yield out

    key = rows.schema["match_id"].dataType.simpleString()
    schema = f"match_id {key}, fold int, match_segment string, actual int" + "".join(f", fit{i} array<double>" for i in range(len(fits)))
    return OutOfFold(stored(small.filter("_fold > 0").mapInPandas(score, schema)), fits, learned)
