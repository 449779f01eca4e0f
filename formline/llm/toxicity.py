"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive set; texts taken without regard to any label are the unlabelled set, a
mixture with the class prior p of toxic ones. The risk of a linear scorer is
    p R+(positives) + max(0, R-(unlabelled) - p R-(positives)),
with the logistic loss. Where the second part would fall below zero, which only overfitting can do, its gradient
is turned round. p is estimated over all labelled rows outside the held-out fold.

Features are the presence of runs of 4 to 6 characters inside lower-case words, the word's two ends being characters of
their own, so that rare, inflected and altered words share features with the ones seen. The two training sets are
bounded samples (`positives`, `unlabelled`: rows at most, chosen by a hash of the id); scoring reads all rows and
whole texts. A feature takes part if the two sets differ in its frequency by SCREEN standard errors, MOST_FEATURES at
most, the clearest first; both are counted in Spark before any row of features reaches the driver. So what is broadcast does
not grow with the data. The penalty and the cut are chosen by margins of rows that the weights behind them have not seen.

Defined cases: null and empty texts get the score of no words; without positives every score is 0; a doc_id
with several labels counts as toxic if one says so; null labels and ids label nothing; repeated rows keep a
row each, and texts with equal features are learned from once; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import id_and_text, remainder

POSITIVES = 6_000
UNLABELLED = 12_000
LEAST_ROWS = 3
SCREEN = 4.0  # among a million features chance passes about sixty
MOST_FEATURES = 4_000
RUNS = 4, 5, 6
PENALTIES = 0.5, 1.0, 2.0, 4.0
PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the runs of characters in the words of the text."""
    text = " " + (text or "").lower() + " "
    # Very long texts go in pieces that overlap by a run less one.
    step = PIECE - max(RUNS) + 1
    found = [_runs(text[at:at + PIECE]) for at in range(0, max(1, len(text) - max(RUNS) + 1), step)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _runs(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.char.isalnum(codes.view("<U1"))
    codes = np.where(inside, codes, 32).astype(np.uint64)
    out, hashed = [], codes
    for n in range(2, max(RUNS) + 1):
        if len(codes) < n:
            break
        hashed = hashed[:-1] * _ODD + codes[n - 1:]
        if n == 2:
            whole = inside[1:]  # the run's characters after the first are letters or digits
        else:
            whole = whole[:-1] & inside[n - 2:-1]
        if n in RUNS:
            out.append((hashed[whole[:len(hashed)]] * _ODD) >> np.uint64(32))
    if not out:
        return np.empty(0, np.int32)
    return np.unique(np.concatenate(out).astype(np.uint32).view(np.int32))


@dataclass
class Model:
    """Features with a weight other than zero (sorted), their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, found: np.ndarray) -> float:
        if not len(self.features):
            return self.bias
        at = np.searchsorted(found, self.features)
        at[at == len(found)] = 0
        return self.bias + float(self.weights[found[at] == self.features].sum()) if len(found) else self.bias


class _Rows:
    """Rows of column numbers end to end; features outside `columns` take no part."""

    def __init__(self, rows: list[np.ndarray], columns: np.ndarray):
        found = np.concatenate(rows) if rows else np.empty(0, np.int32)
        at = np.minimum(np.searchsorted(columns, found), max(len(columns) - 1, 0))
        known = columns[at] == found if len(columns) else np.zeros(len(found), bool)
        self.index = at[known].astype(np.int32)
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[known]
        self.n = len(rows)

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.owner, weights[self.index], self.n)

    def pull(self, per_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, per_row[self.owner], size)


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative risk of margins, logistic loss: log(1 + e^-m) for a positive, log(1 + e^m) for a negative."""
    rest = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    return float(prior * np.logaddexp(0, -positive).mean() + max(0.0, rest))


def pulls(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The direction of descent by margin: the gradient of the risk, or, where the second part is below
    zero, the gradient of that part turned round."""
    up = 1 / (1 + np.exp(-np.clip(positive, -50, 50))) / len(positive)
    uu = 1 / (1 + np.exp(-np.clip(unlabelled, -50, 50))) / len(unlabelled)
    if np.logaddexp(0, unlabelled).mean() >= prior * np.logaddexp(0, positive).mean():
        # p (sigma(m) - 1) from R+ less p sigma(m) from R-.
        return np.full(len(positive), -prior / len(positive)), uu
    return prior * up, -uu


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, folds: int = 3,
          keys: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """Weights from all rows, with the penalty whose unseen rows have the least risk; the cut is where their
    prior-corrected error is least. Rows with equal keys (by default equal features) count once and share a fold."""
    positive, own = _different(positive, None if keys is None else keys[0])
    unlabelled, mixed = _different(unlabelled or positive, None if keys is None or not unlabelled else keys[1])
    if not positive or not 0 < prior < 1:
        return Model(np.empty(0, np.int32), np.empty(0), -np.inf, 0.0)
    columns, rows = np.unique(np.concatenate(positive + unlabelled), return_counts=True)
    columns = columns[rows >= LEAST_ROWS] if (rows >= LEAST_ROWS).any() else columns
    size = len(columns)
    both = _Rows(positive, columns), _Rows(unlabelled, columns)
    unseen: dict[float, list] = {penalty: [] for penalty in PENALTIES}

    def compare(p: _Rows, u: _Rows, p_out: _Rows, u_out: _Rows) -> None:
        for penalty, found in unseen.items():
            weights, bias = _descend(p, u, prior, size, penalty)
            found.append((p_out.margins(weights, bias), u_out.margins(weights, bias)))

    for fold in range(folds):
        # A copy's fold is that of its key, so that no row is known from the other set.
        out = [k % np.uint64(folds) == fold for k in (own, mixed)]
        if not any(o.all() or not o.any() for o in out):
            compare(*(_Rows([r for r, o in zip(rows, out[at]) if o == side], columns)
                      for side in (False, True) for at, rows in enumerate((positive, unlabelled))))
    if not unseen[PENALTIES[0]]:
        compare(*both, *both)
    margins = {penalty: [np.concatenate(m) for m in zip(*found)] for penalty, found in unseen.items()}
    penalty = min(PENALTIES, key=lambda at: (risk(*margins[at], prior), at))
    weights, bias = _descend(*both, prior, size, penalty)
    used = weights != 0
    return Model(columns[used], weights[used], bias - _threshold(*margins[penalty], prior), prior)


def _descend(p: _Rows, u: _Rows, prior: float, size: int, penalty: float, steps: int = 80,
             pace: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal gradient descent on the non-negative risk with a one-norm penalty.

    Each weight has a step of its own (one over the feature's frequency), and a penalty of `penalty` standard errors
    of its pull, so that features which chance gave to a few positives stay at zero. The result
    is the mean over all steps.
    """
    weights, mean, mean_bias = np.zeros(size), np.zeros(size), 0.0
    usual = (np.bincount(u.index, minlength=size) + 1) / (u.n + 2)
    often = (np.bincount(p.index, minlength=size) * prior / p.n + usual) / 2
    # Runs of one word come together: the step is shared among the features a row holds on average.
    step = pace / np.maximum(often, 0.5 / (p.n + u.n)) / max(1.0, np.sqrt(len(p.index) / p.n))
    least = penalty * prior * np.sqrt(usual * (1 - usual) * (1 / p.n + 1 / u.n))
    bias = float(np.log(prior / (1 - prior)))
    for _ in range(steps):
        pull_p, pull_u = pulls(p.margins(weights, bias), u.margins(weights, bias), prior)
        moved = weights - step * (p.pull(pull_p, size) + u.pull(pull_u, size))
        weights = np.sign(moved) * np.maximum(np.abs(moved) - step * least, 0)
        bias -= pace * float(pull_p.sum() + pull_u.sum())
        mean += weights / steps
        mean_bias += bias / steps
    return mean, mean_bias


def _threshold(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The cut with the least prior-corrected error, 2 p (missed positives) + (unlabelled above) - p; the middle of
    the gap between margins where that error is least, the highest one among equals."""
    cuts = np.unique(np.r_[positive, unlabelled])
    cuts = np.r_[cuts, cuts[-1] + 2.0]  # the last one calls no text toxic
    missed = np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    above = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    error = 2 * prior * missed + above
    best = len(error) - 1 - int(np.argmin(error[::-1]))
    return float((cuts[max(best - 1, 0)] + cuts[best]) / 2)


def _different(rows: list[np.ndarray], keys: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    rows = [np.asarray(r, np.int32) for r in rows]
    if keys is None:
        keys = np.array([_key(r) for r in rows], np.uint64)
    keys, at = np.unique(np.asarray(keys).astype(np.uint64), return_index=True)
    return [rows[i] for i in at], keys


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def _screened(rows: DataFrame) -> tuple[np.ndarray, list, list, np.ndarray, np.ndarray]:
    """Features that tell the two sets of `rows` (own, text) apart, then each set's rows of them and their keys."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for own in (True, False):
                found = [features(t) for t in batch["text"][batch["own"] == own]]
                hashed, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int32),) * 2
                parts.append(pd.DataFrame({"f": hashed, "p": n * own, "u": n * (not own)}))
            yield pd.concat(parts).astype({"f": "int32", "p": "int64", "u": "int64"})

    def kept(columns):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [features(t) for t in batch["text"]]
                key = np.array([_key(r) for r in found], np.uint64).view(np.int64)
                at = [np.intersect1d(r, columns.value, assume_unique=True).tobytes() for r in found]
                yield pd.DataFrame({"own": batch["own"], "key": key, "at": at})
        return run

    spark = rows.sparkSession
    size = {r["own"]: r["n"] for r in rows.groupBy("own").agg(F.count("*").alias("n")).collect()}
    if not size.get(True) or not size.get(False):
        empty = np.empty(0, np.int32)
        return empty, [empty] * min(size.get(True, 0), 1), [], np.zeros(min(size.get(True, 0), 1), np.uint64), np.empty(0, np.uint64)
    p, u = F.col("p") / size[True], F.col("u") / size[False]
    usual = (F.col("p") + F.col("u") + 1) / (size[True] + size[False] + 2)
    lift = F.abs(p - u) / F.sqrt(usual * (1 - usual) * (1 / size[True] + 1 / size[False]))
    chosen = (rows.mapInPandas(counted, "f int, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
              .filter(F.col("p") + F.col("u") >= LEAST_ROWS).withColumn("lift", lift).filter(F.col("lift") >= SCREEN)
              .orderBy(F.desc("lift"), "f").limit(MOST_FEATURES).select("f").toPandas()["f"])
    columns = np.sort(chosen.to_numpy(np.int32))
    got = rows.mapInPandas(kept(spark.sparkContext.broadcast(columns)), "own boolean, key long, at binary").toPandas()
    sets = [got[got["own"] == own] for own in (True, False)]
    lists = [[np.frombuffer(bytes(b), np.int32) for b in s["at"]] for s in sets]
    return columns, *lists, *(s["key"].to_numpy(np.int64).view(np.uint64) for s in sets)


def fit(docs: DataFrame, labels: DataFrame, learn, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """`learn` is a function from the id column to the condition that a row may be learned from."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
        .filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    prior = marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    texts = id_and_text(docs).filter(F.col("doc_id").isNotNull() & learn(F.col("doc_id")))

    def drawn(rows: DataFrame, most: int, own: bool) -> DataFrame:
        # Ids are chosen before texts are fetched: at most `most` of them, so the broadcast is bounded.
        ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        return texts.join(F.broadcast(ids), "doc_id").select(F.lit(own).alias("own"), "text")

    rows = drawn(marked.filter("toxic = 1"), positives, True).union(drawn(texts, unlabelled, False))
    _, positive, mixed, *keys = _screened(rows)
    return train(positive, mixed, prior, keys=tuple(keys))


def scorer(spark: SparkSession, model: Model):
    """A function from a text column to the score column, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        model = shared.value
        margins = np.array([model.margin(features(t)) for t in texts], float)
        scores = 1 / (1 + np.exp(-np.clip(margins, -700, 700)))
        return pd.Series(np.where(np.isneginf(margins), 0.0, scores), dtype=float)

    return scored


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labels of rows whose id is not in fold `out`."""
    model = fit(docs, labels, lambda doc_id: remainder(doc_id, folds) != out)
    scored = id_and_text(docs).withColumn("score", scorer(docs.sparkSession, model)(F.col("text")))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), folds) == out).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
