"""Operators on vectors against numpy and plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import embedding_copies, hard_negatives, whitening

VECTORS = "vec_id long, embedding array<double>, label int, v string, node long, block int, n_links string"


def make(spark, rows):
    """rows: (vec_id, vector[, label]); further columns have names that the operators use themselves."""
    full = [(r[0], None if r[1] is None else [None if x is None else float(x) for x in r[1]],
             r[2] if len(r) > 2 else 1, "v", 7, 3, "n") for r in rows]
    return spark.createDataFrame(full, VECTORS)


def triangle(a):
    r = np.zeros((a.shape[1], a.shape[1]))
    part = np.linalg.qr(a, mode="r")
    r[:len(part)] = part
    return r


def cases():
    rnd = np.random.default_rng(0)
    constant = rnd.normal(size=(200, 20))
    constant[:, 5], constant[:, 9] = 0, constant[:, 10]
    turn = np.linalg.qr(rnd.normal(size=(32, 32)))[0]
    return {
        "random": rnd.normal(size=(300, 40)), "graded": rnd.normal(size=(200, 30)) * np.logspace(0, -8, 30),
        "few rows": rnd.normal(size=(8, 24)), "constant and equal": constant, "identity": np.eye(16),
        "blocks": np.kron(np.eye(6), rnd.normal(size=(5, 5))), "clusters": turn * np.repeat([5, 3, 1, 1e-3], 8) @ turn.T,
        "one": rnd.normal(size=(9, 1)), "two": rnd.normal(size=(9, 2)), "zero": np.zeros((4, 3)),
        "hilbert": 1.0 / (np.arange(12)[:, None] + np.arange(12) + 1),
    }


@pytest.mark.parametrize("name", cases())
def test_singular_values_and_vectors(name):
    a = cases()[name]
    values, vectors = whitening.right_singular(triangle(a))
    want = np.zeros(a.shape[1])
    found = np.linalg.svd(a, compute_uv=False) ** 2
    want[:len(found)] = found
    scale = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max() <= 1e-12 * scale


def test_small_singular_values_are_accurate_relative_to_themselves():
    # A bidiagonal with entries over many magnitudes determines all its singular values to high relative accuracy.
    diagonal, above = np.logspace(0, -12, 13), np.logspace(-1, -13, 12)
    values = whitening.squared_singular_values(diagonal, above)
    assert math.isclose(np.prod(values / np.sort(diagonal**2)[::-1]), 1, rel_tol=1e-12)


def test_whitening_equals_numpy(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(400, 10)) * np.linspace(1, 3, 10)
    rows = [(i, x) for i, x in enumerate(base)]
    rows += [(5, base[5]), (None, base[7]), (900, [1.0, 2.0]), (901, [])]
    dropped = [(910, None), (911, [math.nan] * 10), (912, [1.0, None]), (913, [math.inf] * 10)]
    out = whitening.whiten(make(spark, rows + dropped).repartition(9), components=4)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.toPandas()
    filled = np.stack([np.pad(np.asarray(x, float), (0, 10 - len(x))) for _, x in rows])
    x = np.floor(64 * filled).astype(np.int64) + 1_000_000
    n = len(x)
    assert len(got) == 4 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-10
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    for k in range(1, 5):
        value, vector = values[-k], vectors[:, -k]
        want = (x - x.mean(axis=0)) @ vector / math.sqrt(value)
        part = got[got["component"] == k]
        best = min(np.abs(np.sort(part["whitened"].to_numpy()) - np.sort(sign * want)).max() for sign in (1, -1))
        assert best < 1e-9 and np.allclose(part["explained"], value / values.sum(), rtol=1e-9)
    exact = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert sorted(got[got["component"] == 1]["deviation"]) == sorted(exact.tolist())
    assert got["vec_id"].isna().sum() == 4


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(make(spark, [])).collect() == []
    assert whitening.whiten(make(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(make(spark, [(1, []), (2, [])])).collect() == []
    line = whitening.whiten(make(spark, [(i, [i, 2 * i, 5]) for i in range(5)])).toPandas()
    assert set(line["component"]) == {1} and np.allclose(line["explained"], 1)


def test_whitening_of_very_large_components(spark):
    rows = [(i, [1e300 * (-1) ** i, i]) for i in range(6)]
    got = whitening.whiten(make(spark, rows)).toPandas()
    assert got["deviation"].isna().all() and len(got)


def brute_links(rows, least):
    keep = [i for i, (_, x) in enumerate(rows) if x is not None and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    width = max((len(rows[i][1]) for i in keep), default=1)
    u = np.array([np.pad(np.asarray(rows[i][1], float), (0, width - len(rows[i][1]))) for i in keep]).reshape(len(keep), width)
    u = u / np.abs(u).max(axis=1, keepdims=True) if len(u) else u
    u = u / np.linalg.norm(u, axis=1, keepdims=True) if len(u) else u
    near = u @ u.T >= least
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for a, b in zip(*np.nonzero(near)):
        if a != b:
            links[keep[a]] += 1
            root[find(keep[a])] = find(keep[b])
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        least_id = min(ids) if ids else None
        out.append((vec_id, links[i], least_id, vec_id == least_id))
    return sorted(out, key=str)


def planted(rnd, dims=32):
    rows = [(i, rnd.normal(size=dims).tolist()) for i in range(150)]
    centre = rnd.normal(size=dims)
    rows += [(1000 + i, (centre + 0.12 * rnd.normal(size=dims)).tolist()) for i in range(80)]
    rows += [(2000 + i, rows[3][1]) for i in range(30)]
    rows += [(2100, (np.array(rows[3][1]) * 1e200).tolist()), (2101, (np.array(rows[4][1]) * -1).tolist())]
    rows += [(3000, None), (3001, [0.0] * dims), (3002, []), (3003, [math.nan] * dims), (3004, [1.0, None]), (3005, [math.inf])]
    rows += [(None, rows[5][1]), (None, None), (3010, [1.0]), (3011, [2.0, 0.0]), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("bound", [10_000, 20])
def test_near_copies_equal_brute_force(spark, bound):
    rows = planted(np.random.default_rng(4))
    out = embedding_copies.near_copies(make(spark, rows), bound=bound)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted([tuple(r) for r in out.collect()], key=str) == brute_links(rows, 0.9)


def test_near_copies_recall_at_the_threshold(spark):
    rnd = np.random.default_rng(6)
    rows, found = [], 0
    for i in range(400):
        a = rnd.normal(size=64)
        a /= np.linalg.norm(a)
        b = rnd.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.901 * a + math.sqrt(1 - 0.901**2) * b).tolist())]
    out = embedding_copies.near_copies(make(spark, rows))
    found = out.filter("n_links = 1").count() / len(rows)
    assert found > 0.98
    assert out.filter("n_links > 1").count() == 0


def test_near_copies_of_nothing(spark):
    assert embedding_copies.near_copies(make(spark, [])).collect() == []
    assert [tuple(r) for r in embedding_copies.near_copies(make(spark, [(4, None)])).collect()] == [(4, 0, 4, True)]


def test_rotations_keep_lengths_and_forests_span():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(embedding_copies.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    forest = embedding_copies._Forest(6)
    forest.add(np.array([0, 1, 0, 4]), np.array([2, 2, 1, 5]))
    forest.add(np.array([2, 3]), np.array([4, 3]))
    assert len(forest.edges) == 4 and forest.root.tolist() == [0, 0, 0, 3, 0, 0]


def brute_negatives(rows, is_anchor, scale=256):
    rows = [(i, x, label) for i, x, label in rows
            if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    x = {n: [math.floor(scale * c) for c in row[1]] for n, row in enumerate(rows)}

    def score(a, b):
        return max(min(sum(p * q for p, q in zip(x[a], x[b])), 2**63 - 1), -(2**63))

    out = []
    for anchor in sorted({r[0] for r in rows if is_anchor(r[0])}):
        a = min((n for n, r in enumerate(rows) if r[0] == anchor), key=lambda n: (rows[n][2], rows[n][1]))
        ranked = sorted((-score(a, n), rows[n][0], n) for n in range(len(rows)) if rows[n][0] != anchor)
        positives = [t for t in ranked if rows[t[2]][2] == rows[a][2]][:5]
        for p, pid, _ in positives:
            window = [t for t in ranked if rows[t[2]][2] != rows[a][2] and 80 * -p <= 100 * -t[0] <= 100 * -p]
            out += [(anchor, pid, k + 1, t[1], -p, -t[0]) for k, t in enumerate(window[:5])]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.5 * rnd.normal(size=12)).tolist(), int(rnd.integers(4))) for i in range(600)]
    rows += [(700 + i, rows[10][1], i % 3) for i in range(40)]
    rows += [(3, rows[3][1], 2), (3, rows[4][1], 2), (10, rows[11][1], 0), (800, [0.5, 1.0], 1), (801, [], 1)]
    rows += [(802, None, 1), (810, [math.nan] * 12, 1), (811, [None], 1), (820, rows[1][1], None), (None, rows[1][1], 2)]
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    for block_rows, slice_rows in ((1024, 2048), (7, 5)):
        vectors = make(spark, rows)
        out = hard_negatives.hard_negatives(vectors, vectors.filter("vec_id % 10 = 0"), block_rows=block_rows, slice_rows=slice_rows)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(tuple(r) for r in out.collect()) == want


def test_hard_negatives_of_large_components_and_few_rows(spark):
    rows = [(0, [1e9, 3.0], 1), (1, [2e9, 1.0], 1), (2, [1.7e9, 5.0], 2), (3, [-1e9, 0.0], 2), (10, [1e40, 0.0], 3), (11, [1e-3, 9.0], 3)]
    vectors = make(spark, rows)
    out = hard_negatives.hard_negatives(vectors, vectors.filter("vec_id in (0, 3)"))
    assert sorted(tuple(r) for r in out.collect()) == brute_negatives(rows, lambda i: i in (0, 3))
    empty = make(spark, [])
    assert hard_negatives.hard_negatives(empty, empty).collect() == []
    assert hard_negatives.hard_negatives(vectors, empty).collect() == []
    assert hard_negatives.hard_negatives(empty, vectors).collect() == []


def test_hilbert_order_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (5, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = hard_negatives.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(keys)
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_interval_bounds_hold_all_scores():
    rnd = np.random.default_rng(3)
    x, a = rnd.integers(-500, 500, size=(40, 8)), rnd.integers(-500, 500, size=(9, 8))
    least, most = hard_negatives.interval_bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    scores = a @ x.T
    assert (least <= scores).all() and (scores <= most).all()


def test_a_far_zone_is_not_read(spark):
    rows = [(i, [100.0, float(i % 5)], i % 2) for i in range(64)] + [(64 + i, [-100.0, 0.0], i % 2) for i in range(64)]
    blocks = hard_negatives.candidate_blocks(
        make(spark, rows).select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("v")), 2, 8, 2)
    zones = hard_negatives.zone_maps(blocks, 2, 256)
    # One anchor at the positive end with a window of positive scores.
    anchors = spark.createDataFrame([(0, 0, 0, [100.0, 0.0], [1], [10**9])],
                                    "slice int, anchor_id long, label long, v array<double>, low array<long>, high array<long>")
    read = {r["block"] for r in hard_negatives._needed(anchors, zones, 2, 256, False).collect()}
    far = {r["block"] for r in blocks.filter("vec_id >= 64").collect()} - {r["block"] for r in blocks.filter("vec_id < 64").collect()}
    assert read and far and not read & far
