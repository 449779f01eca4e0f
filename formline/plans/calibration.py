"""One-vs-rest calibration of probability rows: sigmoid and isotonic, fitted on a later window.

Rows become (class, score, hit), one for each class, and are counted by distinct score first, so both fits see one row per
score. Sigmoid takes Newton steps, each one aggregation that serves all classes. Isotonic pools adjacent violators
inside ranges of scores, and then the blocks of neighbouring ranges together, until one range is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import outcomes
from formline.operators import metrics
from formline.sources.folders import stored

ROW = metrics.PROBABILITIES
STEPS = 100
# A step is taken as the last one when it moves no score's margin by more than this.
SETTLED = 1e-11
FAN_IN = 16
BLOCK = "class string, low double, high double, hits double, n double"


@dataclass
class Calibrator:
    """For each probability column the fitted values: slope and offset, or knots x and y."""

    method: str
    parts: dict[str, dict]

    def apply(self, scored: DataFrame) -> DataFrame:
        new = {f"_new_{name}": self._mapped(name) for name in ROW}
        out = scored.withColumns(new)
        row = outcomes.normalise(*[F.col(n) for n in new])
        out = out.withColumns(dict(zip(ROW, row))).drop(*new)
        return out.withColumn("predicted", outcomes.argmax_class(*[F.col(c) for c in ROW]))

    def _mapped(self, name: str) -> Column:
        part = self.parts[name]
        if self.method == "sigmoid":
            return 1 / (1 + F.exp(-(F.col(name) * part["slope"] + part["offset"])))
        x, y = np.array(part["x"]), np.array(part["y"])

        @F.pandas_udf("double")
        def interpolated(score: pd.Series) -> pd.Series:
            return pd.Series(np.where(score.isna(), np.nan, np.interp(score.to_numpy(float), x, y))).replace({np.nan: None})

        return interpolated(F.col(name))


def score_counts(scored: DataFrame, target: str) -> DataFrame:
    """class (the column's name), score, hits, n: one row for each distinct score of a class; NULL scores are left out."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("class"), F.col(name).alias("score"), (F.col(target) == cls).cast("double").alias("hit"))
        for cls, name in zip(outcomes.CLASSES, ROW)])
    long = scored.filter(F.col(target).isNotNull()).select(F.inline(rows)).filter(F.col("score").isNotNull())
    return long.groupBy("class", "score").agg(F.sum("hit").alias("hits"), F.count("*").cast("double").alias("n"))


def calibrate(scored: DataFrame, method: str, target: str = "target_multiclass") -> Calibrator:
    """`sigmoid` or `isotonic`, per class on that class's probability."""
    if method not in ("sigmoid", "isotonic"):
        raise ValueError(f"unknown calibration method {method!r}")
    counts = stored(score_counts(scored, target))
    parts = sigmoid(counts) if method == "sigmoid" else isotonic(counts)
    missing = set(ROW) - set(parts)
    if missing:
        raise ValueError(f"no scores to calibrate {sorted(missing)} on")
    return Calibrator(method, parts)


# ---- sigmoid ----------------------------------------------------------------


def sigmoid(counts: DataFrame) -> dict[str, dict]:
    """Logistic loss of slope * score + offset against smoothed targets: (hits + 1) / (hits + 2) for hits
    and 1 / (misses + 2) for misses. Newton steps from slope 0, halved while the loss rises."""
    totals = {r["class"]: (r["hits"], r["n"]) for r in
              counts.groupBy("class").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()}
    high = {k: (hits + 1) / (hits + 2) for k, (hits, n) in totals.items()}
    low = {k: 1 / (n - hits + 2) for k, (hits, n) in totals.items()}
    now = {k: (0.0, math.log((hits + 1) / (n - hits + 1))) for k, (hits, n) in totals.items()}
    best: dict[str, tuple] = {}
    tried = dict(now)
    for _ in range(STEPS):
        sums = _sums(counts, tried, high, low)
        open_classes = False
        for k, (loss, g0, g1, h00, h01, h11) in sums.items():
            if k in best and loss > best[k][0]:
                step = tuple((t - n) / 2 for t, n in zip(tried[k], now[k]))
            else:
                now[k], best[k] = tried[k], (loss,)
                det = h00 * h11 - h01 * h01
                if det > 1e-12 * max(h00 * h11, 1e-300):
                    step = ((h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det)
                else:
                    # One distinct score: only the offset can be learned.
                    step = (0.0, g0 / h00 if h00 > 0 else 0.0)
            tried[k] = tuple(n + s for n, s in zip(now[k], step))
            open_classes |= max(map(abs, step)) > SETTLED * (1 + max(map(abs, now[k])))
        if not open_classes:
            break
    return {k: {"slope": slope, "offset": offset} for k, (slope, offset) in now.items()}


def _sums(counts: DataFrame, at: dict, high: dict, low: dict) -> dict[str, tuple]:
    """Loss, gradient and curvature sums of every class at (slope, offset)."""
    def of(values: dict, place: int | None = None) -> Column:
        pick = F.lit(None).cast("double")
        for k, v in values.items():
            pick = F.when(F.col("class") == k, F.lit(float(v if place is None else v[place]))).otherwise(pick)
        return pick

    margin = F.col("score") * of(at, 0) + of(at, 1)
    rows = counts.select("class", "score", "n", margin.alias("m"),
                         (F.col("hits") * of(high) + (F.col("n") - F.col("hits")) * of(low)).alias("t"))
    # log(1 + exp(m)) without overflow.
    soft = F.greatest("m", F.lit(0.0)) + F.log1p(F.exp(-F.abs("m")))
    rows = rows.withColumns({"p": 1 / (1 + F.exp(-F.col("m"))), "soft": soft})
    rest, bend = F.col("t") - F.col("n") * F.col("p"), F.col("n") * F.col("p") * (1 - F.col("p"))
    found = rows.groupBy("class").agg(
        F.sum(F.col("n") * F.col("soft") - F.col("t") * F.col("m")), F.sum(rest), F.sum(rest * F.col("score")),
        F.sum(bend), F.sum(bend * F.col("score")), F.sum(bend * F.col("score") * F.col("score")))
    return {r[0]: tuple(r)[1:] for r in found.collect()}


# ---- isotonic ---------------------------------------------------------------


def pooled(low: np.ndarray, high: np.ndarray, hits: np.ndarray, n: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Blocks (low, high, hits, n) of rising means, by pooling adjacent violators."""
    out: list[tuple[float, float, float, float]] = []
    for block in zip(low.tolist(), high.tolist(), hits.tolist(), n.tolist()):
        while out and out[-1][2] * block[3] >= block[2] * out[-1][3]:
            before = out.pop()
            block = (before[0], block[1], before[2] + block[2], before[3] + block[3])
        out.append(block)
    return out


def _pooled_ranges(blocks: DataFrame) -> DataFrame:
    """Blocks pooled inside every (part, class) of `blocks`; a group is a stretch of scores."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("low")
        found = pooled(*(g[c].to_numpy(float) for c in ("low", "high", "hits", "n")))
        return pd.DataFrame(found, columns=["low", "high", "hits", "n"]).assign(part=g["part"].iloc[0], **{"class": g["class"].iloc[0]})[
            ["part", "class", "low", "high", "hits", "n"]]

    return blocks.groupBy("part", "class").applyInPandas(run, f"part int, {BLOCK}")


def isotonic(counts: DataFrame, ranges: int | None = None) -> dict[str, dict]:
    """Knots of the rising least-squares fit: both ends of every block at its mean.

    Blocks of a range are pooled in one task, then those of FAN_IN neighbouring ranges, until one is left. The remaining
    blocks are the model and reach the driver."""
    parts = ranges or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(parts, "class", "score").withColumn("part", F.spark_partition_id())
    blocks = dealt.select("part", "class", F.col("score").alias("low"), F.col("score").alias("high"), "hits", "n")
    blocks = stored(_pooled_ranges(stored(blocks)))
    while parts > 1:
        parts = -(-parts // FAN_IN)
        blocks = stored(_pooled_ranges(blocks.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))))
    out: dict[str, dict] = {}
    for row in blocks.orderBy("class", "low").toLocalIterator():
        part = out.setdefault(row["class"], {"x": [], "y": []})
        mean = row["hits"] / row["n"]
        for x in dict.fromkeys((row["low"], row["high"])):
            part["x"].append(x)
            part["y"].append(mean)
    return out
