"""Near-copies among vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A rotation is three rounds of random signs and a Walsh-Hadamard transform. The hash of a rotated unit vector is its
nearest signed unit vector: the coordinate of largest absolute value and its sign. A table's bucket joins the hashes of
some rotations; each vector lies in the `probes` buckets of least loss. Spark deals vectors out by
(table, bucket), and tasks compare the rows of each bucket block by block in double precision. Pairs never leave a task:
it returns a count of links for each row and a spanning forest of the bucket's links. A pair may meet in several buckets;
it is counted only where it meets first, which a task knows from both vectors alone.

Equal vectors are one row with a number of copies. A bucket above `bound` rows is cut into stretches, and every
pair of stretches is a Spark group of its own, so no task is unbounded and nothing is left out. Rows of such a bucket are
ordered by their first bucket: two stretches that lie whole in one bucket of an earlier table have met there.
Different near copies of one vector still cost a comparison for each pair, since links are counted exactly.

Defined cases: vectors that are null, zero or hold null, NaN or infinite components link with nothing and form components
of their own; shorter vectors are filled with zeros, and an empty one is zero; repeated rows and repeated ids are rows
of their own and link like others; a null id never becomes a component's id (a component of null ids only has a null
id); an empty table gives an empty result; only the id and vector columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import store
from formline.llm.vectors import groups_in_tasks, id_and_vector, is_finite, longest, matrix
from formline.operators.components import components

# At a cosine of 0.9 a pair of 64 components misses all tables with a probability of about 0.002, at 0.95 below 0.0001.
TABLES, PROBES, ROTATIONS = 6, 4, 2
BOUND = 8192
# Choices of each rotation that probes combine.
WIDTH = 4
TILE = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Walsh-Hadamard matrix (a power of two wide), scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


class Hashes:
    """Buckets of unit vectors in all tables."""

    def __init__(self, dims: int, tables: int, probes: int, rotations: int, seed: int = 11):
        self.width = 1 << max(1, dims - 1).bit_length()
        self.tables, self.probes, self.rotations = tables, probes, rotations
        draw = np.random.default_rng(seed)
        self.signs = draw.choice([-1.0, 1.0], size=(tables, rotations, 3, self.width))
        width = min(WIDTH, self.width)
        self.choices = np.array(list(itertools.product(range(width), repeat=rotations)))
        if len(self.choices) < probes:
            raise ValueError("more probes than buckets")

    def buckets(self, units: np.ndarray, table: int) -> np.ndarray:
        """The buckets of each row, best first."""
        padded = np.zeros((len(units), self.width))
        padded[:, :units.shape[1]] = units
        code = np.zeros((len(units), len(self.choices)), np.int64)
        loss = np.zeros(code.shape)
        for k in range(self.rotations):
            y = padded
            for signs in self.signs[table, k]:
                y = hadamard(y * signs)
            # Equal absolute values: the lower coordinate first, so that a vector's buckets are the same in every task.
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :WIDTH]
            value = np.take_along_axis(y, best, axis=1)
            pick = self.choices[:, k]
            code = code * (2 * self.width) + (2 * best + (value < 0))[:, pick]
            loss += (np.abs(value[:, :1]) - np.abs(value))[:, pick]
        order = np.argsort(loss, axis=1, kind="stable")[:, :self.probes]
        return np.take_along_axis(code, order, axis=1)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 (no row is zero); divided by their largest component first, so that no square overflows."""
    x = x / np.max(np.abs(x), axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _linked(u: np.ndarray, side: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """i < j with a cosine of `least` or more; with both sides 0 and 1, pairs across only."""
    n, across = len(u), bool(side.any() and not side.all())
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            if across and not (side[a:a + TILE].min() < side[b:b + TILE].max() or side[b:b + TILE].min() < side[a:a + TILE].max()):
                continue
            i, j = np.nonzero(u[a:a + TILE] @ u[b:b + TILE].T >= least)
            i, j = i + a, j + b
            good = i < j
            if across:
                good &= side[i] != side[j]
            if good.any():
                yield i[good], j[good]


def _first_meeting(hashes: Hashes, u: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, bucket: np.ndarray,
                   known: dict[int, np.ndarray]) -> np.ndarray:
    """Whether pairs that share `bucket` of `table` share no bucket of an earlier table and none below it in this one."""
    first = np.ones(len(i), bool)
    for t in range(table + 1):
        if t not in known:
            known[t] = hashes.buckets(u, t)
        mine, other = known[t][i], known[t][j]
        for p in range(mine.shape[1]):
            shared = other == mine[:, p:p + 1]
            if t == table:
                shared &= mine[:, p:p + 1] < bucket[:, None]
            first &= ~shared.any(axis=1)
    return first


class _Forest:
    """Spanning forest of the links seen so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            # Each root joins its lowest neighbour: pointers fall, so no circle closes.
            order = np.lexsort((a, b))
            _, once = np.unique(b[order], return_index=True)
            at = order[once]
            self.edges += zip(i[at].tolist(), j[at].tolist())
            to = np.arange(len(self.root))
            to[b[at]] = a[at]
            while True:
                further = to[to]
                if (further == to).all():
                    break
                to = further
            self.root = to[self.root]


FOUND = "node long, other long, links long"


def _look(hashes: Hashes, dims: int, least: float):
    """Links of whole groups of dealt rows (table_no, bucket, node, copies, v and maybe side)."""
    def look(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        stops = np.append(starts[1:], rows.num_rows)
        several = stops - starts > 1
        if not several.any():
            return
        node, copies = (rows.column(n).to_numpy() for n in ("node", "copies"))
        number, bucket = (rows.column(n).to_numpy() for n in ("table_no", "bucket"))
        side = rows.column("side").to_numpy() if "side" in rows.column_names else np.zeros(len(node), np.int32)
        u = units(matrix(rows.column("v"), dims))
        links = np.zeros(len(node), np.int64)
        edges: list[np.ndarray] = []
        pending: dict[int, list[np.ndarray]] = {}
        size = 0

        def count() -> None:
            """First meetings of the pairs gathered so far; hashes are computed once for the rows concerned."""
            for table, parts in pending.items():
                i, j = np.concatenate(parts, axis=1)
                some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                known: dict[int, np.ndarray] = {}
                for at in range(0, len(i), 200_000):
                    to = slice(at, at + 200_000)
                    first = _first_meeting(hashes, u[some], place[:len(i)][to], place[len(i):][to], table, bucket[i[to]], known)
                    a, b = i[to][first], j[to][first]
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
            pending.clear()

        for lo, hi in zip(starts[several].tolist(), stops[several].tolist()):
            forest = _Forest(hi - lo)
            for i, j in _linked(u[lo:hi], side[lo:hi], least):
                forest.add(i, j)
                pending.setdefault(int(number[lo]), []).append(np.stack([i, j]) + lo)
                size += len(i)
                if size > 500_000:
                    count()
                    size = 0
            if forest.edges:
                edges.append(np.array(forest.edges) + lo)
        count()
        linked = np.flatnonzero(links)
        if len(linked):
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[linked]), pa.nulls(len(linked), pa.int64()), pa.array(links[linked])], ["node", "other", "links"])
        if edges:
            a, b = np.concatenate(edges).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[a]), pa.array(node[b]), pa.nulls(len(a), pa.int64())], ["node", "other", "links"])

    return look


def _dealt(distinct: DataFrame, hashes: Hashes, dims: int) -> DataFrame:
    """table_no, bucket, home (first bucket of the first table), node, copies, v: one row for each bucket of a vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = units(matrix(batch.column("v"), dims))
            rows = pa.array(np.repeat(np.arange(len(u)), hashes.probes))
            copied = [batch.column(n).take(rows) for n in ("node", "copies", "v")]
            home = None
            for table in range(hashes.tables):
                buckets = hashes.buckets(u, table)
                home = buckets[:, 0] if home is None else home
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(buckets.size, table, np.int32)), pa.array(buckets.ravel()),
                     pa.array(np.repeat(home, hashes.probes)), *copied],
                    ["table_no", "bucket", "home", "node", "copies", "v"])

    kind = distinct.schema["v"].dataType.simpleString()
    return distinct.select("node", "copies", "v").mapInArrow(
        run, f"table_no int, bucket long, home long, node long, copies long, v {kind}")


def _stretches(dealt: DataFrame, rows: int) -> DataFrame:
    """`dealt` with `sub`, a number for each stretch of at most `rows` rows of a bucket in order of home."""
    order = ["table_no", "bucket", "home", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, sub, size, last = TaskContext.get().partitionId() << 40, 0, 0, None
        for batch in batches:
            subs = np.empty(batch.num_rows, np.int64)
            for at, key in enumerate(zip(batch.column("table_no").to_pylist(), batch.column("bucket").to_pylist())):
                if key != last or size == rows:
                    sub, size, last = sub + 1, 0, key
                size += 1
                subs[at] = base + sub
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(subs)], [*batch.schema.names, "sub"])

    spread = dealt.repartitionByRange(max(1, dealt.sparkSession.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    return spread.mapInArrow(run, f"{columns}, sub long")


def _found(distinct: DataFrame, hashes: Hashes, dims: int, least: float, bound: int) -> DataFrame:
    """node, other, links: forests (links null) and first meetings of each row (other null)."""
    look, by = _look(hashes, dims, least), ["table_no", "bucket"]
    dealt = _dealt(distinct, hashes, dims)
    heavy = store(dealt.groupBy(*by).count().filter(F.col("count") > bound).select(*by), "heavy")
    if not heavy.take(1):
        return groups_in_tasks(dealt, by, look, FOUND)
    light = dealt.join(heavy, by, "left_anti")
    subs = store(_stretches(dealt.join(heavy, by, "left_semi"), max(1, bound // 2)), "stretches")
    ends = store(subs.groupBy(*by, "sub").agg(F.min("home").alias("lo"), F.max("home").alias("hi")), "ends")
    left, right = (ends.select(*by, *(F.col(c).alias(f"{c}_{n}") for c in ("sub", "lo", "hi"))) for n in "ab")
    met = (F.col("table_no") > 0) & (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_a") == F.col("lo_b")) & (F.col("lo_b") == F.col("hi_b"))
    # One row for each pair of stretches, that is of up to bound / 2 rows each.
    pairs = store(left.join(right, by).filter((F.col("sub_a") <= F.col("sub_b")) & ~met).select("sub_a", "sub_b"), "pairs")
    sides = [subs.withColumnRenamed("sub", name).join(some, name).withColumn("side", F.lit(number))
             for number, (name, some) in enumerate((("sub_a", pairs), ("sub_b", pairs.filter("sub_a < sub_b"))))]
    across = groups_in_tasks(sides[0].unionByName(sides[1]), ["sub_a", "sub_b"], look, FOUND)
    return groups_in_tasks(light, by, look, FOUND).union(across)


def near_copies(vectors: DataFrame, least: float = 0.9, tables: int = TABLES, probes: int = PROBES,
                rotations: int = ROTATIONS, bound: int = BOUND,
                vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; pairs of cosine `least` or more are linked."""
    x = F.col(vector).cast("array<double>")
    takes_part = is_finite(F.col(vector)) & F.coalesce(F.exists(x, lambda c: c != 0), F.lit(False))
    rows = id_and_vector(vectors, vector_id, vector, takes_part.alias("part"))
    alone = rows.filter(~F.col("part")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.filter("part").select("vec_id", "v")
    # Numbers are fixed when the table is written.
    distinct = store(rows.groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
                     .withColumn("node", F.monotonically_increasing_id()), "distinct")
    dims = longest(distinct)
    if not dims:
        return alone
    found = store(_found(distinct, Hashes(dims, tables, probes, rotations), dims, least, bound), "found")
    members = components(found.filter(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.filter(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
    named = (distinct.select("node", "first", "copies", "v").join(members, "node", "left").join(links, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    # Written, so that the last join reads exchanges of its own and a frequent vector can be split.
    ids = store(named.join(smallest, "root").select(
        "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "ids")
    joined = rows.join(ids, "v").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return joined.union(alone)
