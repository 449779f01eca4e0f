"""Softmax boosting: three trees a round, one a class, grown level by level from histograms that Spark sums.

Inputs are cut once into bins between exact quantiles and stored with label, weight and margins. A level of a round's
three trees is one job: each task finds margins, gradients and curvatures of its rows and adds them up by (class, node,
input, bin); the parts of one input meet in a group, which gives the best cut of each class's nodes; the driver
compares one row per (class, node, input). Margins are written every REWRITE rounds, so a task adds few trees and a lost
executor costs one re-read. What reaches the driver depends on inputs and depth only.

For class k with probability p_k, gradient w (p_k - [label = k]) and curvature 2 w p_k (1 - p_k); a node with sums G, H is worth
G^2 / (H + penalty) and gives -rate G / (H + penalty). A cut needs LEAST_CURVATURE on both sides and a gain.
Ties go to the smaller input, then the smaller cut.

Defined cases: inputs are filled before; no rows, no inputs or no gain anywhere give trees of one leaf or none, and probabilities
of one third each; the same stored rows give the same trees up to rounding in the order of the sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.operators import ordered
from formline.sources.folders import drop_folder, shared_folder

BINS = 32
REWRITE = 4
LEAST_CURVATURE = 1.0
LEAST_GAIN = 1e-6
CLASSES = 3
_SUMS = "cls int, input int, part int, g binary, h binary"
_CUTS = "cls int, input int, node int, cut int, gain double, left_g double, left_h double, all_g double, all_h double"


def edges_of(rows: DataFrame, inputs: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Ends of the bins of every input: bin b holds the values up to edge b, the last bin the rest."""
    found = ordered.exact_quantiles(rows, inputs, [b / bins for b in range(1, bins)])
    return [np.unique(np.array([v for v in found[c] if v is not None], float)) for c in inputs]


def _stored(rows: DataFrame, inputs: list[str], label: str, weight: str, edges: list[np.ndarray], path: str) -> DataFrame:
    """key, label (0 to 2), weight, bins (a byte an input) and margins, written."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            binned = np.stack([np.searchsorted(e, batch[c].to_numpy(float), side="left")
                               for c, e in zip(inputs, edges)], axis=1).astype(np.uint8)
            yield pd.DataFrame({
                "key": batch["key"], "label": batch["label"], "weight": batch["weight"],
                "bins": [b.tobytes() for b in binned], "margins": [bytes(8 * CLASSES)] * len(batch)})

    prepared = rows.select(
        F.xxhash64(F.monotonically_increasing_id()).alias("key"), F.col(label).cast("int").alias("label"),
        F.col(weight).cast("double").alias("weight"), *inputs)
    prepared.mapInPandas(run, "key long, label int, weight double, bins binary, margins binary").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _matrix(cells: pd.Series, kind, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), columns)


def _leaves(tree: dict, x: np.ndarray, cuts: str, depth: int) -> np.ndarray:
    """The node of a tree that each row ends in; `cuts` names what the columns of x are compared with."""
    node = np.zeros(len(x), np.int32)
    inputs, limits, every = np.asarray(tree["input"]), np.asarray(tree[cuts]), np.arange(len(x))
    for _ in range(depth):
        at = inputs[node]
        right = x[every, np.maximum(at, 0)] > limits[node]
        node = np.where(at < 0, node, 2 * node + 1 + right)
    return node


def _raised(margins: np.ndarray, x: np.ndarray, rounds: list, cuts: str, depth: int) -> np.ndarray:
    margins = margins.copy()
    for trees in rounds:
        for cls, tree in enumerate(trees):
            margins[:, cls] += np.asarray(tree["value"])[_leaves(tree, x, cuts, depth)]
    return margins


def softmax(margins: np.ndarray) -> np.ndarray:
    raised = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _sums(rows: DataFrame, recent: list, trees: list, used: list, level: int, number: int, p: dict) -> DataFrame:
    """Gradient and curvature sums by (class, input): one row a task, with nodes of the level times bins in it. At the
    first level also the loss, as class -1."""
    columns, first, nodes, share = p["columns"], 2**level - 1, 2**level, p["subsample"]
    depth, bins, seed = p["depth"], p["bins"], np.uint64(p["seed"] * 1_000_003 + number)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen, loss = TaskContext.get().partitionId(), False, np.zeros(2)
        sums = np.zeros((2, CLASSES, nodes * columns * bins))
        for batch in batches:
            if not len(batch):
                continue
            seen = True
            x = _matrix(batch["bins"], np.uint8, columns)
            margins = _raised(_matrix(batch["margins"], float, CLASSES), x, recent, "cut", depth)
            chances, label, weight = softmax(margins), batch["label"].to_numpy(), batch["weight"].to_numpy(float)
            loss += [-(weight * np.log(np.maximum(chances[np.arange(len(x)), label], 1e-300))).sum(), weight.sum()]
            mixed = (batch["key"].to_numpy(np.int64).view(np.uint64) ^ seed) * np.uint64(0x9E3779B97F4A7C15)
            taken = (mixed >> np.uint64(11)) / 2.0**53 < share
            for cls in range(CLASSES):
                node = _leaves(trees[cls], x, "cut", level)
                rows_in = np.flatnonzero(taken & (node >= first))
                place = ((node[rows_in] - first)[:, None] * columns + np.arange(columns)) * bins + x[rows_in]
                chance = chances[rows_in, cls]
                g = weight[rows_in] * (chance - (label[rows_in] == cls))
                h = np.maximum(2 * weight[rows_in] * chance * (1 - chance), 1e-16)
                for out, values in zip(sums, (g, h)):
                    out[cls] += np.bincount(place.ravel(), np.repeat(values, columns), out.shape[1])
        if not seen:
            return
        shaped = sums.reshape(2, CLASSES, nodes, columns, bins)
        found = [(cls, at, part, *(s[cls, :, at].tobytes() for s in shaped)) for cls in range(CLASSES) for at in used[cls]]
        if not level:
            found.append((-1, 0, part, loss[:1].tobytes(), loss[1:].tobytes()))
        yield pd.DataFrame(found, columns=["cls", "input", "part", "g", "h"])

    return rows.mapInPandas(run, _SUMS)


def best_cuts(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Gain and cut of each node (rows) over the bins (columns); no allowed cut gives minus infinity."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    worth = lambda a, b: a * a / (b + penalty)
    gain = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h)
    gain = np.where((left_h >= LEAST_CURVATURE) & (all_h - left_h >= LEAST_CURVATURE), gain, -np.inf)
    cut = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), cut], cut


def _best(bins: int, penalty: float):
    """The best cut of each class's nodes by one input, from the tasks' sums in the order of the tasks."""
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (cls, at), own in parts.sort_values("part").groupby(["cls", "input"]):
            g, h = (np.sum([np.frombuffer(b, float) for b in own[c]], axis=0) for c in ("g", "h"))
            if cls < 0:
                out.append(pd.DataFrame([(cls, at, 0, 0, -np.inf, 0.0, 0.0, g[0], h[0])], columns=names))
                continue
            g, h = g.reshape(-1, bins), h.reshape(-1, bins)
            gain, cut = best_cuts(g, h, penalty)
            every = np.arange(len(g))
            out.append(pd.DataFrame({
                "cls": cls, "input": at, "node": every, "cut": cut, "gain": gain,
                "left_g": np.cumsum(g, axis=1)[every, cut], "left_h": np.cumsum(h, axis=1)[every, cut],
                "all_g": g.sum(axis=1), "all_h": h.sum(axis=1)}))
        return pd.concat(out)

    names = [c.split()[0] for c in _CUTS.split(", ")]
    return run


def learn(rows: DataFrame, inputs: list[str], label: str, weight: str, rounds: int, depth: int, rate: float,
          penalty: float = 1.0, subsample: float = 0.9, column_share: float = 0.9, bins: int = BINS, seed: int = 42) -> dict:
    """{"depth", "rounds": a list of three trees each, "losses": mean log loss before each round}. A tree has, by node
    (children of n are 2n + 1 and 2n + 2), the input (-1: a leaf), the cut as a bin and as a limit (up to it goes left) and the
    value. `rows` has filled inputs, the label as 0, 1 or 2, and the weight."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    edges = edges_of(rows, inputs, bins)
    table, written = _stored(rows, inputs, label, weight, edges, f"{folder}/0"), f"{folder}/0"
    p = {"columns": len(inputs), "depth": depth, "bins": bins, "seed": seed, "subsample": subsample}
    done: list = []
    recent: list = []
    losses: list[float] = []
    for number in range(rounds):
        size = 2 ** (depth + 1) - 1
        trees = [{"input": [-1] * size, "cut": [0] * size, "limit": [0.0] * size, "value": [0.0] * size} for _ in range(CLASSES)]
        draw = np.random.default_rng([seed, number])
        used = [np.sort(draw.permutation(len(inputs))[:max(1, int(column_share * len(inputs)))]) for _ in range(CLASSES)]
        for level in range(depth):
            sums = _sums(table, recent, trees, used, level, number, p)
            cuts = sums.groupBy("input").applyInPandas(_best(bins, penalty), _CUTS).toPandas()
            if not len(cuts):
                return {"depth": depth, "rounds": [], "losses": []}
            if not level:
                total = cuts[cuts["cls"] < 0].iloc[0]
                losses.append(float(total["all_g"] / total["all_h"]))
            grown = _grow(trees, cuts[cuts["cls"] >= 0], level, edges, rate, penalty)
            if not grown:
                break
        done.append(trees)
        recent.append(trees)
        if len(recent) == REWRITE and number + 1 < rounds:
            table, recent = _advanced(spark, table, recent, p, f"{folder}/{number + 1}"), []
            drop_folder(spark, written)
            written = f"{folder}/{number + 1}"
    drop_folder(spark, folder)
    return {"depth": depth, "rounds": done, "losses": losses}


def _grow(trees: list, cuts: pd.DataFrame, level: int, edges: list, rate: float, penalty: float) -> bool:
    """Puts the best cut of every open node into the trees; says whether any node was cut."""
    first, grown = 2**level - 1, False
    value = lambda g, h: float(-rate * g / (h + penalty))
    ordered_cuts = cuts.sort_values(["gain", "input", "cut"], ascending=[False, True, True])
    for row in ordered_cuts.drop_duplicates(["cls", "node"]).itertuples():
        tree, node = trees[row.cls], first + row.node
        if not level:
            tree["value"][0] = value(row.all_g, row.all_h)
        if row.gain <= LEAST_GAIN or row.cut >= len(edges[row.input]):
            continue
        grown = True
        tree["input"][node], tree["cut"][node] = int(row.input), int(row.cut)
        tree["limit"][node] = float(edges[row.input][row.cut])
        tree["value"][2 * node + 1] = value(row.left_g, row.left_h)
        tree["value"][2 * node + 2] = value(row.all_g - row.left_g, row.all_h - row.left_h)
    return grown


def _advanced(spark: SparkSession, table: DataFrame, recent: list, p: dict, path: str) -> DataFrame:
    """The stored rows with the recent trees in their margins."""
    columns, depth = p["columns"], p["depth"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                margins = _raised(_matrix(batch["margins"], float, CLASSES), _matrix(batch["bins"], np.uint8, columns), recent, "cut", depth)
                batch["margins"] = [m.tobytes() for m in margins]
            yield batch

    table.mapInPandas(run, table.schema).write.parquet(path)
    return spark.read.parquet(path)


def probabilities(spark: SparkSession, model: dict, values: list[Column]) -> Column:
    """The three probabilities as an array, from filled inputs in the order of learning."""
    shared, width = spark.sparkContext.broadcast(model), len(values)

    @F.pandas_udf("array<double>")
    def scored(cells: pd.Series) -> pd.Series:
        model = shared.value
        x = np.stack(cells.to_numpy()).reshape(len(cells), width) if len(cells) else np.zeros((0, width))
        return pd.Series(list(softmax(_raised(np.zeros((len(x), CLASSES)), x, model["rounds"], "limit", model["depth"]))))

    return scored(F.array(*values))
