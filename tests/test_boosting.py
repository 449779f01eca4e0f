"""Softmax boosting against a learner that looks at every row in plain Python."""

import math
import random

import numpy as np
import pytest

from formline.plans import boosting, models
from formline.plans.models import Candidate


def plain_tree(x, g, h, edges, depth, rate, penalty):
    """Value of every row after one tree, by trying every edge of every input on every node's rows."""
    out = [0.0] * len(x)

    def grow(rows, left):
        sum_g, sum_h = math.fsum(g[i] for i in rows), math.fsum(h[i] for i in rows)
        best = None
        for at, limits in enumerate(edges) if left else ():
            for limit in limits:
                low = [i for i in rows if x[i][at] <= limit]
                lg, lh = math.fsum(g[i] for i in low), math.fsum(h[i] for i in low)
                if min(lh, sum_h - lh) < 1.0:
                    continue
                gain = lg**2 / (lh + penalty) + (sum_g - lg)**2 / (sum_h - lh + penalty) - sum_g**2 / (sum_h + penalty)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = gain, at, limit
        if best is None:
            for i in rows:
                out[i] = -rate * sum_g / (sum_h + penalty)
            return
        _, at, limit = best
        grow([i for i in rows if x[i][at] <= limit], left - 1)
        grow([i for i in rows if x[i][at] > limit], left - 1)

    grow(list(range(len(x))), depth)
    return out


@pytest.fixture
def labelled():
    rnd = random.Random(5)
    rows = []
    for i in range(240):
        a, b, c = rnd.gauss(0, 1), rnd.randrange(5) / 2, rnd.random()
        label = min(2, max(0, round(1 + a + (b - 1) * (c > 0.4) + rnd.gauss(0, 0.4))))
        rows.append((i, a, b, c, float(label), 0.5 + rnd.random()))
    return rows


def test_first_trees_equal_brute_force(spark, labelled, monkeypatch):
    monkeypatch.setattr(boosting, "REWRITE", 2)
    names, rounds, depth, rate, penalty = ["a", "b", "c"], 5, 3, 0.3, 1.5
    frame = spark.createDataFrame(labelled, "id int, a double, b double, c double, label double, weight double").repartition(4, "id")
    got = boosting.learn(frame, names, "label", "weight", rounds, depth, rate, penalty, 1.0, 1.0, bins=8)
    assert len(got["rounds"]) == rounds and all(len(trees) == 3 for trees in got["rounds"])
    edges = [e.tolist() for e in boosting.edges_of(frame, names, 8)]
    x = [row[1:4] for row in labelled]
    label, weight = [int(r[4]) for r in labelled], [r[5] for r in labelled]
    margins, losses = [[0.0] * 3 for _ in x], []
    for _ in range(rounds):
        p = [[math.exp(m) / sum(map(math.exp, row)) for m in row] for row in margins]
        losses.append(-sum(w * math.log(q[k]) for w, q, k in zip(weight, p, label)) / sum(weight))
        added = []
        for cls in range(3):
            g = [w * (q[cls] - (k == cls)) for w, q, k in zip(weight, p, label)]
            h = [2 * w * q[cls] * (1 - q[cls]) for w, q in zip(weight, p)]
            added.append(plain_tree(x, g, h, edges, depth, rate, penalty))
        margins = [[m + a[i] for m, a in zip(row, added)] for i, row in enumerate(margins)]
    assert got["losses"] == pytest.approx(losses)
    assert losses == sorted(losses, reverse=True)
    raised = boosting._raised(np.zeros((len(x), 3)), np.array(x), got["rounds"], "limit", depth)
    assert raised == pytest.approx(np.array(margins), abs=1e-9)


def test_empty_and_constant_rows(spark):
    schema = "a double, label double, weight double"
    assert boosting.learn(spark.createDataFrame([], schema), ["a"], "label", "weight", 2, 2, 0.1)["rounds"] == []
    same = spark.createDataFrame([(1.0, float(i % 2), 1.0) for i in range(20)], schema)
    got = boosting.learn(same, ["a"], "label", "weight", 2, 2, 0.1)
    assert all(tree["input"] == [-1] * 7 for trees in got["rounds"] for tree in trees)


def test_fit_save_load_and_score(spark, labelled, tmp_path):
    rows = [(i, a if i % 9 else None, int(2 * b), c, int(k) - 1) for i, a, b, c, k, _ in labelled]
    frame = spark.createDataFrame(rows, "match_id int, a double, b int, c double, target_multiclass int")
    candidate = Candidate("boosting", "boosting", {"trees": 8, "depth": 3, "rate": 0.3, "penalty": 1.0})
    fitted = models.fit(candidate, frame, ["a", "b", "c"])
    scored = fitted.score(frame)
    assert scored.columns[:5] == frame.columns and dict(scored.dtypes)["b"] == "int"
    got = {r["match_id"]: r for r in scored.collect()}
    assert all(abs(r["p_away"] + r["p_draw"] + r["p_home"] - 1) < 1e-12 for r in got.values())
    assert [got[i]["a"] for i in range(240)] == [r[1] for r in rows]
    assert sum(r["predicted"] == r["target_multiclass"] for r in got.values()) > 0.75 * len(got)
    models.save(fitted, str(tmp_path / "m"), spark)
    again = models.load(str(tmp_path / "m"), spark)[0].score(frame)
    assert {r["match_id"]: r["p_home"] for r in again.collect()} == {i: r["p_home"] for i, r in got.items()}
