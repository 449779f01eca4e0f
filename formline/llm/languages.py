"""Language of texts by multinomial naive Bayes over hashed character n-grams.

Counts are gathered over all training rows: tasks add up bucket counts per language, Spark sums them, and the
driver gets languages x buckets numbers, which do not grow with the rows. The matrix of log probabilities is
broadcast; a batch of texts is scored as a sparse count vector per text times the matrix.

Defined cases: texts that are null or have no letter are `und` with score 0; equal scores go to the language
that sorts first; rows without a language train nothing; without training rows every text is `und`; repeated
rows and null ids keep a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import id_and_text, remainder

BUCKETS = 2**15
SIZES = (1, 2, 3)
NONE = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def grams(text: str, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the n-grams of the lower-cased text; everything but letters counts as one space."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower()
    points = np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), np.uint32).copy()
    points[(points < 97) | ((points > 122) & (points < 128))] = 32
    points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
    out = []
    for size in sizes:
        if len(points) >= size:
            value = np.full(len(points) - size + 1, size, np.uint32)
            for k in range(size):
                value = (value ^ points[k:len(points) - size + 1 + k]) * _MULTIPLIERS[k]
                value ^= value >> np.uint32(15)
            out.append(value % np.uint32(buckets))
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(rows: DataFrame, label: str, sizes=SIZES, buckets: int = BUCKETS) -> DataFrame:
    """label, bucket, n over all rows; partial sums leave each task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch["label"], batch["text"]):
                held = total.setdefault(name, np.zeros(buckets, np.int64))
                held += np.bincount(grams(text, sizes, buckets), minlength=buckets)
        for name, counts in total.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"label": name, "bucket": used.astype(np.int32), "n": counts[used]})

    held = rows.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).alias("label"), "text")
    return held.mapInPandas(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, label: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (buckets x languages) and log priors."""
    counts = gram_counts(rows, label).toPandas()
    sizes = rows.filter(F.col(label).isNotNull()).groupBy(label).count().collect()
    names = sorted(r[label] for r in sizes)
    table = np.full((BUCKETS, len(names)), smoothing)
    at = {name: i for i, name in enumerate(names)}
    np.add.at(table, (counts["bucket"].to_numpy(np.int64), counts["label"].map(at).to_numpy(np.int64)),
              counts["n"].to_numpy(float))
    prior = np.array([next(r["count"] for r in sizes if r[label] == n) for n in names], float)
    return names, np.log(table / table.sum(axis=0)) if names else table, np.log(prior / prior.sum())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, table, prior = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch["text"]:
                if not names or not has_letter(text):
                    langs.append(NONE)
                    scores.append(0.0)
                    continue
                counts = np.bincount(grams(text), minlength=BUCKETS)
                used = np.flatnonzero(counts)
                points = prior + counts[used] @ table[used]
                best = int(np.argmax(points))
                langs.append(names[best])
                scores.append(float(1 / np.exp(points - points[best]).sum()))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": langs, "score": scores})

    return id_and_text(docs).mapInPandas(run, "doc_id long, lang_pred string, score double")


def held_out_languages(docs: DataFrame, folds: int = 4, out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows whose id is not in fold `out`."""
    fold = remainder(F.col("doc_id"), folds) == out
    learned = docs.select("doc_id", "text", "lang").filter(~fold)
    return predict(docs, fit(learned)).select("doc_id", fold.alias("held_out"), "lang_pred", "score")
