"""Hard negatives: for each anchor and positive, the best rows of other labels in a score window.

Components become integers floor(scale * c) and a score is an inner product, so scores are exact. Candidates are sorted
along a Hilbert curve over all dimensions (those of largest spread first), cut into blocks and written as Parquet; a zone
map holds each block's smallest and largest component per dimension and its range of labels. Interval arithmetic on a
zone gives a lower and an upper bound of an anchor's scores with the block, and a block is read for an anchor only if the
bounds meet one of the anchor's windows and the labels allow it.

Positives are a window without ends over the anchor's label, negatives a window for each positive over other labels, so both
are one search. Anchors are dealt into slices along the curve. Spark pairs slices with zones in blocks (a stated query set
against all rows), keeps the (slice, block) pairs that some anchor needs, and brings blocks and slices together in
groups of bounded size. One group in SHARE goes first: its results raise the lower ends of the windows for the rest.

Defined cases: rows without id, without label or whose vector is null or holds null, NaN or infinite components
take no part; shorter vectors are filled with zeros; of several rows with one anchor id the smallest by label and vector is
the anchor; rows with the anchor's id are not its candidates; repeated rows are candidates each; ties go to the smaller
id; integers and scores outside the long range become its ends; a negative positive score has no negatives; empty tables
give an empty result; only the id, vector and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import partitions, store
from formline.llm.vectors import id_and_vector, is_finite, longest, matrix, scaled_integers
from formline.operators.ordered import with_row_index

BLOCK_ROWS, GROUP_BLOCKS, SLICE_ROWS, ZONE_ROWS = 1024, 8, 2048, 1024
BITS = 2
SHARE = 16
LONG = np.iinfo(np.int64)
HELD = 1_000_000
FOUND = "anchor_id long, place int, vec_id long, score long"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of cells (columns are dimensions, values below 2**bits) on the Hilbert curve, as sortable bytes."""
    x = cells.T.astype(np.uint8)
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(dims):
            turned = (x[i] & bit) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below).astype(np.uint8)
            x[i] ^= swap
            x[0] ^= np.where(turned, below, swap).astype(np.uint8)
    x = np.bitwise_xor.accumulate(x, axis=0)
    fix = np.zeros(x.shape[1], np.uint8)
    for level in range(bits - 1, 0, -1):
        fix ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0).astype(np.uint8)
    x ^= fix
    planes = np.concatenate([(x >> level) & 1 for level in range(bits - 1, -1, -1)])
    return [row.tobytes() for row in np.packbits(planes.T, axis=1)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exactly: in doubles where every sum fits, else in Python integers."""
    most = float(np.max(np.abs(a.astype(float)), initial=0)) * float(np.max(np.abs(b.astype(float)), initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def interval_bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of `a` with any vector between lo and hi (one box a row)."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    if max(float(np.max(np.abs(m.astype(float)), initial=0)) for m in (lo, hi)) * float(np.max(np.abs(a.astype(float)), initial=0)) * a.shape[1] < 2**53:
        return product(up, lo) + product(down, hi), product(up, hi) + product(down, lo)
    up, down, lo, hi = (m.astype(object) for m in (up, down, lo, hi))
    ends = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    return tuple(np.clip(m, LONG.min, LONG.max).astype(np.int64) for m in ends)


def _spread(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest component of each dimension, and the dimensions by falling variance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), dims)
                parts = [x.min(axis=0), x.max(axis=0), np.full(dims, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(dims), pa.int32()), *map(pa.array, parts)], ["dim", "lo", "hi", "n", "s", "ss"])

    # One row for each dimension.
    found = (rows.select("v").mapInArrow(run, "dim int, lo double, hi double, n double, s double, ss double").groupBy("dim")
             .agg(F.min("lo"), F.max("hi"), (F.sum("ss") / F.sum("n") - (F.sum("s") / F.sum("n")) ** 2)).orderBy("dim").collect())
    table = np.array([list(r)[1:] for r in found], float)
    return table[:, 0], table[:, 1], np.argsort(-table[:, 2], kind="stable")


def candidate_blocks(rows: DataFrame, dims: int, block_rows: int, group_blocks: int) -> DataFrame:
    """Stored rows (vec_id, label, v) with curve (place on the Hilbert curve), block and grp (some neighbouring blocks)."""
    lo, hi, order = _spread(rows, dims)
    width = np.where(hi > lo, hi - lo, 1.0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.clip((matrix(batch.column("v"), dims) - lo) / width * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hilbert_keys(cells[:, order].astype(np.uint8), BITS), pa.binary())],
                [*batch.schema.names, "curve"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, at = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            place = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base + place // block_rows), pa.array(base + place // (block_rows * group_blocks))],
                [*batch.schema.names, "block", "grp"])

    kind = rows.schema["v"].dataType.simpleString()
    schema = f"vec_id long, label long, v {kind}, curve binary"
    curve = rows.mapInArrow(keyed, schema)
    ordered = curve.repartitionByRange(partitions(rows.sparkSession), "curve", "vec_id").sortWithinPartitions("curve", "vec_id")
    return store(ordered.mapInArrow(numbered, f"{schema}, block long, grp long"), "blocks")


def zone_maps(blocks: DataFrame, dims: int, scale: int) -> DataFrame:
    """block, grp, lo, hi (arrays over the dimensions), first_label, last_label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled_integers(matrix(batch.column("v"), dims), scale)
            block = batch.column("block").to_numpy()
            for starts in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
                if len(starts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(dims, block[starts[0]])), pa.array(range(dims), pa.int32()),
                         pa.array(x[starts].min(axis=0)), pa.array(x[starts].max(axis=0))], ["block", "dim", "lo", "hi"])

    sides = (blocks.select("block", "v").mapInArrow(run, "block long, dim int, lo long, hi long")
             .groupBy("block", "dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
             .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("dim", "lo", "hi"))).alias("box")))
    labels = blocks.groupBy("block", "grp").agg(F.min("label").alias("first_label"), F.max("label").alias("last_label"))
    return store(sides.join(labels, "block").select(
        "block", "grp", F.col("box.lo").alias("lo"), F.col("box.hi").alias("hi"), "first_label", "last_label"), "zones")


def _ends(column, missing: int) -> np.ndarray:
    """Lists of longs as a matrix, `missing` where a list has fewer."""
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=0)), missing, np.int64)
    for row, values in enumerate(lists):
        out[row, :len(values)] = values
    return out


class _Asked:
    """Anchors of a slice with their windows."""

    def __init__(self, rows: pa.Table, dims: int, scale: int, same: bool):
        self.id, self.label = rows.column("anchor_id").to_numpy(), rows.column("label").to_numpy()
        self.x = scaled_integers(matrix(rows.column("v"), dims), scale)
        self.low, self.high, self.same = _ends(rows.column("low"), LONG.max), _ends(rows.column("high"), LONG.min), same

    def needs(self, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Anchors by boxes: whether a window meets the bounds and the labels allow a candidate."""
        label = self.label[:, None]
        allowed = (first <= label) & (label <= last) if self.same else ~((first == label) & (label == last))
        least, most = interval_bounds(self.x, lo, hi)
        meets = np.zeros(least.shape, bool)
        for low, high in zip(self.low.T, self.high.T):
            meets |= (low[:, None] <= most) & (least <= high[:, None]) & (low <= high)[:, None]
        return allowed & meets

    def best(self, anchor: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> list[np.ndarray]:
        """Of pairs (anchor number, id, score): anchor number, window, id, score of the first k of each window."""
        order = np.lexsort((ids, -scores, anchor))
        anchor, ids, scores = anchor[order], ids[order], scores[order]
        out = []
        starts = np.searchsorted(anchor, np.arange(len(self.id)))
        stops = np.append(starts[1:], len(anchor))
        some = np.flatnonzero(stops > starts)
        for place in range(self.low.shape[1]):
            # Scores fall within an anchor: those above the window's upper end come first.
            over = np.add.reduceat(scores > self.high[anchor, place], starts[some]) if len(some) else np.empty(0, np.int64)
            first = starts[some] + over
            at = first[:, None] + np.arange(k)
            good = at < stops[some][:, None]
            at = np.where(good, at, 0)
            good &= scores[at] >= self.low[some, place][:, None] if len(scores) else False
            who = np.broadcast_to(some[:, None], at.shape)[good]
            out.append(np.stack([who, np.full(len(who), place), ids[at[good]], scores[at[good]]]))
        return out


def _needed(anchors: DataFrame, zones: DataFrame, dims: int, scale: int, same: bool) -> DataFrame:
    """slice, block, grp: the blocks that some anchor of the slice must read."""
    slices = (anchors.agg(F.max("slice")).first()[0] or 0) + 1
    chunks = max(1, -(-zones.count() // ZONE_ROWS))
    left = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = zones.withColumns({"chunk": F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int"),
                               "slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))})

    def run(key: tuple, asked: pa.Table, boxes: pa.Table) -> pa.Table:
        if not asked.num_rows or not boxes.num_rows:
            some = np.empty(0, np.int64)
        else:
            x = [np.stack([np.asarray(v, np.int64) for v in boxes.column(n).to_pylist()]) for n in ("lo", "hi")]
            labels = [boxes.column(n).to_numpy() for n in ("first_label", "last_label")]
            some = np.flatnonzero(_Asked(asked, dims, scale, same).needs(*x, *labels).any(axis=0))
        return pa.table({"slice": pa.array([key[0].as_py()] * len(some), pa.int32()),
                         "block": boxes.column("block").take(some), "grp": boxes.column("grp").take(some)})

    return left.groupBy("slice", "chunk").cogroup(right.groupBy("slice", "chunk")).applyInArrow(
        run, "slice int, block long, grp long")


def _search(anchors: DataFrame, blocks: DataFrame, needed: DataFrame, dims: int, scale: int, same: bool, k: int) -> DataFrame:
    """anchor_id, place, vec_id, score: the first k rows of each window in each group of blocks."""
    needed = store(needed, "needed")
    # Columns of their own for each side of the grouping.
    groups = needed.select(F.col("slice").alias("slice"), F.col("grp").alias("grp")).distinct()
    left = anchors.join(groups, "slice").select("slice", F.col("grp").alias("grp"), "anchor_id", "label", "v", "low", "high")
    right = blocks.select("vec_id", "label", "v", "block").join(needed, "block")

    def run(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if asked.num_rows and rows.num_rows:
            who = _Asked(asked, dims, scale, same)
            rows = rows.take(pc.sort_indices(rows.column("block")))
            block, ids, labels = (rows.column(n).to_numpy() for n in ("block", "vec_id", "label"))
            x = scaled_integers(matrix(rows.column("v"), dims), scale)
            least, most = who.low.min(axis=1, initial=LONG.max), who.high.max(axis=1, initial=LONG.min)
            held, size = [], 0
            for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
                box = x[part].min(axis=0)[None], x[part].max(axis=0)[None], labels[part].min()[None], labels[part].max()[None]
                some = np.flatnonzero(who.needs(*box)[:, 0])
                if not len(some):
                    continue
                scores = product(who.x[some], x[part])
                good = (scores >= least[some, None]) & (scores <= most[some, None]) & (ids[part] != who.id[some, None])
                good &= (labels[part] == who.label[some, None]) == same
                i, j = np.nonzero(good)
                held.append(np.stack([some[i], ids[part][j], scores[i, j]]))
                size += len(i)
                if size > HELD:
                    held, size = [_once(who.best(*np.concatenate(held, axis=1), k))], 0
            if held:
                out = who.best(*np.concatenate(held, axis=1), k)
        found = np.concatenate(out, axis=1) if out else np.empty((4, 0), np.int64)
        anchor = who.id[found[0]] if out else np.empty(0, np.int64)
        return pa.table({"anchor_id": anchor, "place": pa.array(found[1], pa.int32()), "vec_id": found[2], "score": found[3]})

    return left.groupBy("slice", "grp").cogroup(right.groupBy("slice", "grp")).applyInArrow(run, FOUND)


def _once(found: list[np.ndarray]) -> np.ndarray:
    """Rows anchor, id, score; those in several windows stay as often as they occur in the one with most of them."""
    every = np.concatenate(found, axis=1)
    order = np.lexsort((every[2], -every[3], every[0], every[1]))
    place, rest = every[1][order], every[[0, 2, 3]][:, order]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (rest[:, 1:] != rest[:, :-1]).any(axis=0)
    start = np.flatnonzero(new)
    nth = np.arange(len(place)) - np.repeat(start, np.diff(np.append(start, len(place))))
    return np.unique(np.vstack([rest, nth]), axis=1)[:3]


def first_in_windows(anchors: DataFrame, blocks: DataFrame, zones: DataFrame, dims: int, scale: int, same: bool, k: int) -> DataFrame:
    """place (number of the window), rank, vec_id, score of the first k candidates in each window of each anchor.

    `anchors` has slice, anchor_id, label, v and the windows' ends low and high (arrays of long)."""
    wave = F.pmod(F.xxhash64("grp"), F.lit(SHARE)) == 0
    best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    begun = store(ranked(_search(anchors, blocks, _needed(anchors, zones.filter(wave), dims, scale, same), dims, scale, same, k)).drop("rank"), "begun")
    full = begun.groupBy("anchor_id", "place").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    # At most one entry for each window.
    raised = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("raised"))
    higher = store(anchors.join(raised, "anchor_id", "left").withColumn("low", F.transform(
        "low", lambda low, i: F.greatest(low, F.coalesce(F.element_at("raised", i), low)))).drop("raised"), "anchors")
    rest = _search(higher, blocks, _needed(higher, zones.filter(~wave), dims, scale, same), dims, scale, same, k)
    return store(ranked(begun.union(rest)), "found")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, scale: int = 256,
                   block_rows: int = BLOCK_ROWS, slice_rows: int = SLICE_ROWS,
                   vector_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of `anchors` against `vectors`.

    Negatives satisfy 80 * positive_score <= 100 * negative_score <= 100 * positive_score."""
    def taking_part(rows: DataFrame) -> DataFrame:
        some = rows.filter(is_finite(F.col(vector)) & F.col(label).isNotNull() & F.col(vector_id).isNotNull())
        return id_and_vector(some, vector_id, vector, F.col(label).cast("long").alias("label")).select("vec_id", "label", "v")

    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, asked = taking_part(vectors), taking_part(anchors)
    dims = max(longest(rows), longest(asked))
    if not dims:
        rows = rows.withColumn("v", F.array(F.lit(0.0)))
        asked, dims = asked.withColumn("v", F.array(F.lit(0.0))), 1
    if not rows.take(1):
        return vectors.sparkSession.createDataFrame([], schema)
    blocks = candidate_blocks(rows, dims, block_rows, GROUP_BLOCKS)
    zones = zone_maps(blocks, dims, scale)
    one = asked.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select(
        F.col("vec_id").alias("anchor_id"), "row.label", "row.v")
    # Anchors that lie together on the curve need the same blocks.
    place = blocks.select(F.col("vec_id").alias("anchor_id"), "curve").join(one.select("anchor_id"), "anchor_id", "left_semi")
    place = place.groupBy("anchor_id").agg(F.min("curve").alias("curve"))
    placed = with_row_index(one.join(place, "anchor_id", "left"), ["curve", "anchor_id"], "place")
    asked = store(placed.select(
        F.floor(F.col("place") / slice_rows).cast("int").alias("slice"), "anchor_id", "label", "v"), "anchors")

    everything = asked.withColumns({"low": F.array(F.lit(int(LONG.min))), "high": F.array(F.lit(int(LONG.max)))})
    near = first_in_windows(everything, blocks, zones, dims, scale, True, positives).select(
        "anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The least integer of 80 % or more of a score that is not negative.
    ends = F.struct("place", (F.col("positive_score") - F.expr("positive_score div 5")).alias("low"), F.col("positive_score").alias("high"))
    windows = near.filter("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_list(ends)).alias("w"))
    # Scores fall with the place, so windows that are left out are the last ones.
    narrowed = store(asked.join(windows, "anchor_id").select(
        "slice", "anchor_id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high")), "windows")
    far = first_in_windows(narrowed, blocks, zones, dims, scale, False, negatives)
    return near.join(far, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
