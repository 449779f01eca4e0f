"""Exact top-k inner products by MaxScore over sharded postings.

Components become integers floor(scale * x). A term is a dimension with a sign; its postings are the vectors
whose component has that sign. For a query, the terms of matching sign add to a score and the others
only take away, so the sum of the matching terms' bounds is a bound on the score.

Spark deals vectors into shards and queries into blocks, and each (shard, block) is one group: a stated query
set against all rows, in blocks. In a group, each query orders its terms by their bounds. Terms whose
bounds together stay below the k-th best score so far are non-essential: a vector that has only those cannot
compete. The postings of the essential terms are traversed, then the non-essential ones are
probed from the largest bound down, for those vectors only whose bound still reaches the threshold.
Vectors that remain are scored in full. The best k of each shard are merged.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an
id; an empty vector scores 0; shorter vectors are filled with zeros; a query is never compared with rows of its
own id; repeated ids are candidates each, and the one with the smallest vector (element by element) is the query; a group in
which an integer or a sum of products may leave 64 bits counts with Python's integers, so every score within a long is exact,
and one beyond it ends the job with an error; ties go to the smaller id; empty tables give an empty result; only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 4096
BLOCK_ROWS = 1024


def integers(vectors: DataFrame, scale: int = 1024, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array of integers) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    # Products that a long cannot hold would be cut without a word: such a component ends the job.
    fits = F.forall(x, lambda c: F.abs(c * scale) < F.lit(2.0**62))
    scaled = F.when(fits, scaled).otherwise(F.raise_error(F.lit("a scaled component is beyond 64 bits")))
    return (vectors.select(F.col(vector_id).cast("long").alias("vec_id"), F.col(vector).alias(vector))
            .filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & whole).select("vec_id", scaled.alias("v")))


class Shard:
    """Vectors of a shard with postings by term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.columns = np.ascontiguousarray(self.rows.T)
        n, dims = self.rows.shape
        self.postings = [(np.flatnonzero(c > 0), np.flatnonzero(c < 0)) for c in self.columns]
        self.most = np.stack([self.rows.max(axis=0, initial=0), -self.rows.min(axis=0, initial=0)]) if n else None

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k, by score, then id."""
        none = np.empty(0, np.int64)
        own = self.ids == query_id
        if own.all():
            return none, none
        used = np.flatnonzero(query)
        side = (query[used] < 0).astype(int)
        bounds = np.abs(query[used]) * self.most[side, used]
        rising = np.argsort(bounds, kind="stable")
        used, side, bounds = used[rising], side[rising], bounds[rising]
        below = np.cumsum(bounds)
        # First threshold: full scores of the vectors in the strongest terms, some of each.
        seeds = np.unique(np.concatenate(
            [none, *(self._strong(d, s, k) for d, s in zip(used[-4:], side[-4:]))]))
        seeds = seeds[~own[seeds]]
        scores = self.rows[seeds] @ query
        threshold = np.partition(scores, -k)[-k] if len(scores) >= k else -np.iinfo(np.int64).max
        # Non-essential: their bounds together stay below the threshold.
        first = int(np.searchsorted(below, threshold, side="left"))
        gathered = np.zeros(len(self.ids), self.rows.dtype)
        if threshold <= 0:
            competing = np.arange(len(self.ids))  # a vector without any matching term may still be among the best
        else:
            met = np.zeros(len(self.ids), bool)
            for d, s in zip(used[first:], side[first:]):
                met[self.postings[d][s]] = True
            competing = np.flatnonzero(met)
        for d, s in zip(used[first:], side[first:]):
            rows = self.postings[d][s]
            gathered[rows] += self.columns[d][rows] * query[d]
        competing = competing[~own[competing]]
        for at in range(first - 1, -1, -1):
            competing = competing[gathered[competing] + below[at] >= threshold]
            d = used[at]
            gathered[competing] += np.maximum(self.columns[d][competing] * query[d], 0)
        competing = competing[gathered[competing] >= threshold]
        scores = self.rows[competing] @ query
        best = np.lexsort((self.ids[competing], -scores.astype(np.int64)))[:k]
        return self.ids[competing[best]], scores[best]

    def _strong(self, dim: int, side: int, k: int) -> np.ndarray:
        rows = self.postings[dim][side]
        if len(rows) <= 2 * k:
            return rows
        return rows[np.argpartition(np.abs(self.columns[dim][rows]), -2 * k)[-2 * k:]]


def _matrix(rows: pd.Series, dims: int, kind=np.int64) -> np.ndarray:
    out = np.zeros((len(rows), dims), kind)
    for at, row in enumerate(rows):
        out[at, :len(row)] = row if kind is np.int64 else [int(x) for x in row]
    return out


def _largest(rows: pd.Series) -> int:
    return max((int(np.abs(np.asarray(row, np.int64)).max(initial=0)) for row in rows), default=0)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10,
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs are (vec_id, v) as from `integers`."""
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    left = vectors.select(
        spread.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    right = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(rows) or not len(asked):
            return pd.DataFrame({n: np.empty(0, np.int64) for n in names})
        dims = int(max(rows["v"].map(len).max(), asked["v"].map(len).max()))
        # The largest sum of products any pair of the group may have, as Python's integers.
        kind = np.int64 if dims * _largest(rows["v"]) * _largest(asked["v"]) < 2**62 else object
        shard = Shard(rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"], dims, kind))
        out = []
        for query_id, query in zip(asked["vec_id"], _matrix(asked["v"], dims, kind)):
            ids, scores = shard.top(query_id, query, k)
            # A score beyond a long raises here.
            out.append(np.stack([np.full(len(ids), query_id), ids, scores.astype(np.int64)], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=names)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
