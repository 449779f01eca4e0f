"""SimHash groups: fingerprints of word shingles, linked by a binary trie self-join.

Fingerprints are reduced to distinct values first, so exact copies cost one row. Links are searched
in tables: each table puts some bits first as its key, and Spark deals the fingerprints out by
(table, key). Within a key, all fingerprints lie below one node of the trie over the remaining
bits. The self-join starts with that node paired with itself and goes down both sides together: a child
pair that differs in its bit has one difference more, and a pair above the budget is dropped with
all below it. Small nodes are compared leaf by leaf.

With pigeonhole tables (`exact_tables`) the join is exact: `budget` differing bits touch at most
`budget` of `budget + 2` blocks, so two blocks are equal and some table has both as its key.
For near copies by similarity, whose fingerprints differ in many bits, a table's key is two least hashes of the
set of shingles (`least_hash_keys`): sets of similarity s share a key with probability s * s, at any number of rows.

`simhash_groups` only wants components, so pairs of nodes whose fingerprints are connected already are skipped
and each task returns a star per component: never more rows than it has read. `near_copy_groups` takes
links for candidates only, and confirms them by the shingles themselves.

No task holds a key of more than CHUNK rows: it is cut into sub-nodes, and pairs of these are searched as groups of their own.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts with fewer
words than a shingle count as one shingle; null ids keep their row and never become a component's id
(a component of null ids only has a null id); repeated rows stay repeated; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import NO_ID, drop_folder, id_and_text, partitions, scratch, store
from formline.operators.components import components

SEED = 42
LEAF = 256
CHUNK = 50_000
# Rows of whole groups that a task looks at together, and pairs that it holds before it reduces them.
HELD, HELD_PAIRS = 16_384, 200_000
GROWTH = 16
# Bits of a parity sketch: about four for each shingle, between these. More only refuse more pairs unseen.
SKETCH_BITS = 512, 8192
# Odd multipliers that derive further 64-bit lanes from a shingle's hash.
LANES = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_MIX = np.random.default_rng(5).integers(0, 2**63, size=64, dtype=np.uint64) | np.uint64(1)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the word shingles; ASCII letters lower-cased, words split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = list(itertools.accumulate(words, lambda at, word: at + len(word) + 1, initial=0))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b - 1], SEED) for a, b in zip(ends, ends[size:])], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """Big-endian bytes; a bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return bytes(8 * lanes)
    out = b""
    for lane in range(lanes):
        mixed = hashes
        if lane:
            mixed = hashes * np.uint64(LANES[lane])
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(LANES[lane + 1])
            mixed ^= mixed >> np.uint64(29)
        columns = mixed.astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        counts = np.bincount(columns.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        out += np.packbits(counts.ravel() * 2 > len(hashes)).tobytes()
    return out


def fingerprints(docs: DataFrame, shingle: int, lanes: int = 1) -> DataFrame:
    """doc_id, text_hash, fp (binary) for every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(text, shingle), lanes) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "fp": fps})

    rows = id_and_text(docs).select("doc_id", text_hash("text").alias("text_hash"), "text")
    return rows.mapInPandas(run, "doc_id long, text_hash long, fp binary")


def exact_tables(bits: int, budget: int) -> list[list[int]]:
    """Key bits of each table: every pair of `budget + 2` blocks."""
    blocks = np.array_split(np.arange(bits), budget + 2)
    return [[*map(int, one), *map(int, two)] for one, two in itertools.combinations(blocks, 2)]


def least_hash_keys(hashes: np.ndarray, tables: int) -> list[int]:
    """A key for each table: the two least values of the shingles' hashes under two further hash functions."""
    if not len(hashes):
        return [0] * tables
    with np.errstate(over="ignore"):
        mixed = hashes[None, :] * _MIX[:2 * tables, None]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(LANES[1])
        mixed ^= mixed >> np.uint64(29)
        least = mixed.min(axis=1)
        return (least[0::2] * np.uint64(LANES[2]) + least[1::2]).astype(np.int64).tolist()


def _keys(bits: np.ndarray, key: list[int]) -> np.ndarray:
    padded = np.zeros((len(bits), 64), np.uint8)
    padded[:, 64 - len(key):] = bits[:, key]
    return np.packbits(padded, axis=1).view(">u8").ravel().astype(np.int64)


def _dealt(rows: DataFrame, tables: list[list[int]]) -> DataFrame:
    """table_no, key and the columns of `rows` for every table; keys come from the first bits of fp."""
    width = -(-(max(map(max, tables)) + 1) // 8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            bits = np.unpackbits(_raw(batch["fp"], width), axis=1)
            for number, key in enumerate(tables):
                yield batch.assign(table_no=np.int32(number), key=_keys(bits, key))[["table_no", "key", *batch.columns]]

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"table_no int, key long, {columns}")


def _raw(fps: pd.Series, width: int) -> np.ndarray:
    """The first `width` bytes of each."""
    return np.ascontiguousarray(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1)[:, :width])


def _find(parent: dict, x):
    while parent.get(x, x) != x:
        parent[x] = x = parent.get(parent[x], parent[x])
    return x


def _near(raw: np.ndarray, first: np.ndarray, budget: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """i, j, distance of all rows of different labels within the budget below pairs of sorted ranges (columns of `first`:
    two starts and ends, and the differences so far). Node pairs of one label are skipped."""
    bits = np.unpackbits(raw, axis=1)
    words = raw.view(">u8").astype(np.uint64)
    depth_end = bits.shape[1]
    same_label = np.cumsum(np.r_[False, label[1:] != label[:-1]])
    ones: dict[int, np.ndarray] = {}

    def split(depth, lo, hi):
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum(bits[:, depth], dtype=np.int32)]
        return hi - (ones[depth][hi] - ones[depth][lo])

    stack = [(0, first)] if first.shape[1] else []
    while stack:
        depth, pairs = stack.pop()
        a0, a1, b0, b1, diff = pairs
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (depth == depth_end)
        for chunk in _slices(pairs[:, small]):
            i, j = _leaf_pairs(chunk)
            different = label[i] != label[j]
            i, j = i[different], j[different]
            distance = _distance(words, i, j)
            near = distance <= budget
            yield i[near], j[near], distance[near]
        if small.all():
            continue
        a0, a1, b0, b1, diff = pairs[:, ~small]
        am, bm = split(depth, a0, a1), split(depth, b0, b1)
        same = (a0 == b0) & (a1 == b1)
        cross = np.stack([am, a1, b0, bm, diff + 1])[:, ~same]
        made = np.concatenate([
            np.stack([a0, am, b0, bm, diff]), np.stack([am, a1, bm, b1, diff]),
            np.stack([a0, am, bm, b1, diff + 1]), cross], axis=1)
        a0, a1, b0, b1, diff = made
        made = made[:, (a0 < a1) & (b0 < b1) & (diff <= budget)]
        a0, a1, b0, b1, diff = made
        joined = (same_label[a0] == same_label[a1 - 1]) & (same_label[b0] == same_label[b1 - 1]) & (label[a0] == label[b0])
        made = made[:, ~joined]
        stack += [(depth + 1, part) for part in _slices(made, HELD_PAIRS)]


def _distance(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)


def trie_forest(raw: np.ndarray, group: np.ndarray, budget: int,
                side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints (rows of bytes; groups adjacent): indices of pairs within the budget, each a real link,
    that connect what the group's links connect. A group with both sides 0 and 1 only has to connect across."""
    side = np.zeros(len(raw), np.int64) if side is None else side.astype(np.int64)
    order = np.lexsort((*raw.T[::-1], side, group))
    raw, group, side = raw[order], group[order], side[order]
    n = len(raw)
    if not n:
        return order, order
    # Neighbours in trie order first: runs of links. A pair inside one run needs no visit.
    breaks = np.ones(n, bool)
    step = np.arange(n - 1)
    breaks[1:] = (group[1:] != group[:-1]) | (_distance(raw.view(">u8").astype(np.uint64), step, step + 1) > budget)
    runs = np.cumsum(breaks) - 1
    left = [step[~breaks[1:]]]
    right = [left[0] + 1]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    stops = np.r_[starts[1:], n]
    second = np.add.reduceat(side, starts)
    both = (second > 0) & (second < stops - starts)
    first = np.stack([starts, np.where(both, stops - second, stops), np.where(both, stops - second, starts), stops,
                      np.zeros(len(starts), int)])[:, runs[starts] != runs[stops - 1]]
    parent: dict[int, int] = {}
    for i, j, _ in _near(raw, first, budget, runs):
        _, once = np.unique(runs[i] * n + runs[j], return_index=True)
        for x, y in zip(i[once].tolist(), j[once].tolist()):
            a, b = _find(parent, int(runs[x])), _find(parent, int(runs[y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(np.array([x]))
                right.append(np.array([y]))
    return order[np.concatenate(left)], order[np.concatenate(right)]


def trie_components(raw: np.ndarray, group: np.ndarray, budget: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each row the index of the first row of its component among the rows of its group."""
    parent: dict[int, int] = {}
    for a, b in zip(*(x.tolist() for x in trie_forest(raw, group, budget, side))):
        a, b = _find(parent, a), _find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    root = np.arange(len(raw))
    for x in list(parent):
        root[x] = _find(parent, x)
    return root


def nearest_others(raw: np.ndarray, group: np.ndarray, label: np.ndarray, budget: int, most: int,
                   side: np.ndarray | None = None, allowed: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indices and distances of pairs of different labels within the budget: those among the `most` nearest of one of their
    rows. The last array has a row for each pair that was left out. `allowed` (i, j) is a further condition on pairs."""
    side = np.zeros(len(raw), np.int64) if side is None else side.astype(np.int64)
    # The group's most frequent label apart: its rows need not be compared with each other.
    counts = pd.DataFrame({"group": group, "label": label}).value_counts(sort=False).rename("n").reset_index()
    top = counts.sort_values("n").drop_duplicates("group", keep="last").set_index("group")["label"]
    usual = (pd.Series(group).map(top).to_numpy() == label).astype(np.int64)
    several = pd.Series(group).map(counts["group"].value_counts()).to_numpy() > 1
    order = np.lexsort((*raw.T[::-1], usual, side, group))
    order = order[several[order]]
    none = np.empty(0, np.int64)
    if not len(order):
        return none, none, none, none
    part = np.stack([group, side, usual])[:, order]
    starts = np.flatnonzero(np.r_[True, (part[:, 1:] != part[:, :-1]).any(axis=0)])
    stops = np.r_[starts[1:], len(order)]
    ranges: dict[int, list] = {}
    for lo, hi in zip(starts.tolist(), stops.tolist()):
        ranges.setdefault(int(part[0, lo]), []).append((lo, hi, int(part[1, lo]), int(part[2, lo])))
    first = []
    for some in ranges.values():
        across = len({s for _, _, s, _ in some}) > 1
        for one, two in itertools.combinations_with_replacement(some, 2):
            if not (one[3] and two[3]) and not (across and one[2] == two[2]):
                first.append((*one[:2], *two[:2], 0))
    held, size, cut = [np.empty((3, 0), np.int64)], 0, [none]
    first = np.array(first, np.int64).reshape(-1, 5).T
    for i, j, distance in _near(raw[order], first, budget, label[order]):
        i, j = order[i], order[j]
        good = allowed(i, j) if allowed else np.ones(len(i), bool)
        held.append(np.stack([i, j, distance])[:, good])
        size += int(good.sum())
        if size >= HELD_PAIRS:
            kept, left_out = _most(np.concatenate(held, axis=1), most)
            held, size = [kept], 0
            cut.append(np.unique(left_out))
    kept, left_out = _most(np.concatenate(held, axis=1), most)
    return *kept, np.concatenate([*cut, left_out])


def _most(pairs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j, distance) that are among the `most` nearest of i or of j, and i of the others."""
    n = pairs.shape[1]
    row, at = np.r_[pairs[0], pairs[1]], np.tile(np.arange(n), 2)
    other = np.r_[pairs[1], pairs[0]]
    order = np.lexsort((other, np.tile(pairs[2], 2), row))
    row, at = row[order], at[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.empty(0, np.int64)
    place = np.arange(2 * n) - np.repeat(starts, np.diff(np.r_[starts, 2 * n]))
    near = np.zeros(n, bool)
    near[at[place < most]] = True
    return pairs[:, near], pairs[0, ~near]


def _slices(pairs: np.ndarray, width: int = 1024) -> list[np.ndarray]:
    return [pairs[:, at:at + width] for at in range(0, pairs.shape[1], width)]


def _leaf_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all leaf pairs below the node pairs."""
    a0, a1, b0, b1, _ = pairs
    wide = b1 - b0
    count = (a1 - a0) * wide
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    i, j = a0[owner] + at // wide[owner], b0[owner] + at % wide[owner]
    upper = (i < j) | (a0[owner] != b0[owner])
    return i[upper], j[upper]


def _stars(rows: pd.DataFrame, group: np.ndarray, side: np.ndarray, width: int, budget: int) -> pd.DataFrame:
    root = trie_components(_raw(rows["fp"], width), group, budget, side)
    far = root != np.arange(len(rows))
    fps = rows["fp"].to_numpy()
    return pd.DataFrame({"a": fps[root[far]], "b": fps[far]})


def _looked(rows: DataFrame, by: list[str], look: Callable, schema: str) -> DataFrame:
    """`look` (rows, group numbers, sides) on whole groups of `rows`, about HELD rows at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(held: pd.DataFrame) -> pd.DataFrame:
            group = held.groupby(by, sort=False).ngroup().to_numpy()
            return look(held, group, held["side"].to_numpy() if "side" in held else np.zeros(len(held), np.int64))

        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= HELD:
                rows = pd.concat(held, ignore_index=True)
                open_group = (rows[by] == rows[by].iloc[-1]).all(axis=1).to_numpy()
                if not open_group.all():
                    yield found(rows[~open_group].reset_index(drop=True))
                held, size = [rows[open_group]], int(open_group.sum())
        if held:
            yield found(pd.concat(held, ignore_index=True))

    dealt = rows.repartition(partitions(rows.sparkSession), *by)
    return dealt.sortWithinPartitions(*by).mapInPandas(run, schema)


def _apart(width: int, budget: int):
    """Whether the trie nodes of two ranges (first and last fingerprint each) differ in more than `budget` bits."""
    def one(*ends: bytes) -> bool:
        a, b, c, d = (int.from_bytes(x[:width], "big") for x in ends)
        below = max((a ^ b).bit_length(), (c ^ d).bit_length())
        return ((a >> below) ^ (c >> below)).bit_count() > budget

    @F.pandas_udf("boolean")
    def far(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([one(*ends) for ends in zip(a, b, c, d)], dtype=bool)

    return far


def _sub_nodes(dealt: DataFrame, rows: int) -> DataFrame:
    """`dealt` with `sub`, a number for each stretch of at most `rows` rows of a key in trie order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        base, sub, size, last = TaskContext.get().partitionId() << 32, 0, 0, None
        for batch in batches:
            subs = np.empty(len(batch), np.int64)
            for at, key in enumerate(zip(batch["table_no"], batch["key"])):
                if key != last or size == rows:
                    sub, size, last = sub + 1, 0, key
                size += 1
                subs[at] = base + sub
            yield batch.assign(sub=subs)

    order = ["table_no", "key", "fp"]
    spread = dealt.repartitionByRange(partitions(dealt.sparkSession), *order).sortWithinPartitions(*order)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    return spread.mapInPandas(run, f"{columns}, sub long")


def _searched(dealt: DataFrame, width: int, budget: int, look: Callable, schema: str, bound: int,
              folder: str | None = None) -> DataFrame:
    """What `look` finds in all keys. `dealt` has table_no, key, fp (its first `width` bytes are the bits) and maybe label.

    A key with more than `bound` rows is cut into sub-nodes of at most half of that. Each is searched with itself and with
    every other within the budget, as a Spark group of its own. Two sub-nodes whose rows all have one label, or
    without labels are all connected by then, are not searched."""
    by = ["table_no", "key"]
    heavy = store(dealt.groupBy(*by).count().filter(F.col("count") > bound).select(*by), "heavy", folder)
    if not heavy.take(1):
        return _looked(dealt, by, look, schema)
    # One row for each heavy key, that is at most one for each `bound` dealt rows.
    light = dealt.join(heavy, by, "left_anti")
    subs = store(_sub_nodes(dealt.join(heavy, by, "left_semi"), max(1, bound // 2)), "subs", folder)
    inside = store(_looked(light, by, look, schema).union(_looked(subs, ["sub"], look, schema)), "inside", folder)
    if "label" in dealt.columns:
        labelled = subs
    else:
        roots = components(inside.select("a", "b"), folder).withColumnsRenamed({"node": "fp", "root": "label"})
        labelled = subs.join(roots, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ends = store(labelled.groupBy(*by, "sub").agg(
        F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min("label").alias("one"), F.max("label").alias("two")), "ends", folder)
    left, right = (ends.select(*by, *(F.col(c).alias(f"{c}_{n}") for c in ("sub", "lo", "hi", "one", "two"))) for n in "ab")
    joined = (F.col("one_a") == F.col("two_a")) & (F.col("one_a") == F.col("one_b")) & (F.col("one_a") == F.col("two_b"))
    pairs = store(
        left.join(right, by).filter((F.col("sub_a") < F.col("sub_b")) & ~joined)
        .filter(~_apart(width, budget)("lo_a", "hi_a", "lo_b", "hi_b")).select("sub_a", "sub_b"), "pairs", folder)
    sides = [subs.withColumnRenamed("sub", name).join(pairs, name).withColumn("side", F.lit(number))
             for number, name in enumerate(("sub_a", "sub_b"))]
    across = _looked(sides[0].unionByName(sides[1]), ["sub_a", "sub_b"], look, schema)
    return inside.union(across)


def links(distinct: DataFrame, budget: int, tables: list[list[int]], width: int = 8, bound: int = CHUNK,
          folder: str | None = None) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (`width` bytes) that the tables' links connect."""
    def look(rows, group, side):
        return _stars(rows, group, side, width, budget)

    return _searched(_dealt(distinct, tables), width, budget, look, "a binary, b binary", bound, folder).distinct()


def text_hash(column) -> Column:
    return F.xxhash64(column)


def simhash_groups(docs: DataFrame, shingle: int = 4, lanes: int = 1, budget: int = 4) -> DataFrame:
    """doc_id, text_hash, fp (binary), component_id (smallest doc_id of the component), first_hash (the text hash
    of the component's first row by id, nulls last, and hash) for every row of `docs`."""
    spark = docs.sparkSession
    folder = scratch(spark)
    fps = store(fingerprints(docs, shingle, lanes), "fingerprints")
    distinct = _distinct(fps, folder)
    found = store(links(distinct.select("fp"), budget, exact_tables(64 * lanes, budget), 8 * lanes, folder=folder), "links", folder)
    groups = _groups(fps, distinct, components(found, folder), folder)
    drop_folder(spark, folder)
    return groups


def set_nodes(docs: DataFrame, shingle: int, lanes: int, tables: int) -> DataFrame:
    """doc_id, text_hash, fp and key_0, key_1 ... for every row. fp names the set of shingles: the fingerprint of the distinct
    shingles, their number (4 bytes) and a digest of them (8 bytes)."""
    names = [f"key_{t}" for t in range(tables)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps, keys = [], []
            for text in batch["text"]:
                hashes = np.unique(shingle_hashes(text, shingle))
                fps.append(_node(hashes, lanes))
                keys.append(least_hash_keys(hashes, tables))
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "fp": fps})
            out[names] = np.array(keys, np.int64).reshape(-1, tables)
            yield out

    rows = id_and_text(docs).select("doc_id", text_hash("text").alias("text_hash"), "text")
    return rows.mapInPandas(run, "doc_id long, text_hash long, fp binary, " + ", ".join(f"{n} long" for n in names))


def _node(hashes: np.ndarray, lanes: int) -> bytes:
    return fingerprint(hashes, lanes) + len(hashes).to_bytes(4, "big") + xxhash.xxh64_digest(hashes.tobytes(), SEED)


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Bit b is set if an odd number of the hashes leaves b modulo the width, a power of two. In sketches folded to one width,
    an element of both sets cancels out: they differ in at most as many bits as the sets differ in elements."""
    low, high = SKETCH_BITS
    width = min(max(1 << (4 * len(hashes)).bit_length(), low), high)
    counts = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def least_differences(sketches: list[bytes]) -> Callable:
    """A function of row numbers i, j: how many elements the sets of these pairs differ in at least."""
    widths = np.array([len(s) for s in sketches], np.int64)
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def fold(width):
        if width not in folded:
            rows = np.flatnonzero(widths >= width)
            words = np.empty((len(rows), width // 8), np.uint64)
            for at, row in enumerate(rows.tolist()):
                np.bitwise_xor.reduce(np.frombuffer(sketches[row], np.uint64).reshape(-1, width // 8), axis=0, out=words[at])
            place = np.zeros(len(widths), np.int64)
            place[rows] = np.arange(len(rows))
            folded[width] = place, words
        return folded[width]

    def differ(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        narrow = np.minimum(widths[i], widths[j])
        least = np.zeros(len(i), np.int64)
        for width in np.unique(narrow).tolist():
            place, words = fold(width)
            pairs = np.flatnonzero(narrow == width)
            step = 2**23 // width
            for at in range(0, len(pairs), step):
                some = pairs[at:at + step]
                least[some] = _distance(words, place[i[some]], place[j[some]])
        return least

    return differ


def _shingle_sets(docs: DataFrame, firsts: DataFrame, shingle: int) -> DataFrame:
    """node, hashes (its distinct shingles), sketch for each of `firsts` (node, first), from its first document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at:at + 200]
                hashes = [np.unique(shingle_hashes(text, shingle)) for text in part["text"]]
                yield pd.DataFrame({"node": part["node"], "hashes": [h.view(np.int64) for h in hashes],
                                    "sketch": [parity_sketch(h) for h in hashes]})

    wanted = firsts.select("node", F.coalesce("first.doc_id", F.lit(NO_ID)).alias("k"), F.col("first.text_hash").alias("h"))
    texts = id_and_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), text_hash("text").alias("h"), "text")
    # Only wanted texts are dealt out; repeated rows of one document give one text.
    found = texts.join(wanted, ["k", "h"]).dropDuplicates(["node"])
    return found.select("node", "text").mapInPandas(run, "node binary, hashes array<long>, sketch binary")


def _compared(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """a, b, near: whether the sets have a Jaccard similarity of at least least[0] / least[1]."""
    above, below = least
    first, second = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"hashes_{n}")) for n in "ab")
    both = pairs.select("a", "b").join(first, "a").join(second, "b")
    shared = F.size(F.array_intersect("hashes_a", "hashes_b")).cast("long")
    either = F.size("hashes_a") + F.size("hashes_b") - shared
    return both.select("a", "b", (shared * below >= either * above).alias("near"))


def _per_row(found: DataFrame, most: int) -> DataFrame:
    """Distinct pairs a, b, distance with kept: whether the pair is among the `most` nearest of one of its rows."""
    pairs = found.groupBy("a", "b").agg(F.min("distance").alias("distance"))
    ends = pairs.select("a", "b", "distance", F.explode(F.array("a", "b")).alias("row"))
    nth = F.row_number().over(Window.partitionBy("row").orderBy("distance", "a", "b"))
    return ends.withColumn("nth", nth).groupBy("a", "b").agg((F.min("nth") <= most).alias("kept"))


def near_copy_groups(docs: DataFrame, shingle: int = 5, lanes: int = 4, budget: int = 52, tables: int = 6,
                     least: tuple[int, int] = (4, 5), most: int = 8, bound: int = CHUNK) -> DataFrame:
    """Columns as `simhash_groups`; components of the pairs that the trie self-join finds (`budget` bits of the
    distinct shingles' fingerprints, in groups by least hashes) and whose sets of shingles have a Jaccard similarity of
    least[0] / least[1] or more.

    A group of n near copies has n * n candidates, so they are compared in rounds. First come a spanning forest's links, for
    each row the nearest one. In later rounds only pairs of rows that are not connected by then are
    candidates, for each row the `most` nearest over all tables, GROWTH times as many each round; pairs once refused are not
    compared again, and only keys that left a candidate out are searched again. Rounds end when none is left out, so
    each found pair is confirmed, refused or within a component."""
    above, below = least
    width = 8 * lanes
    spark = docs.sparkSession
    folder = scratch(spark)
    names = [f"key_{t}" for t in range(tables)]
    fps = store(set_nodes(docs, shingle, lanes, tables), "fingerprints")
    distinct = _distinct(fps, folder, *names)
    dealt = distinct.select("fp", F.posexplode(F.array(*names)).alias("table_no", "key")).select("table_no", "key", "fp")
    shared = dealt.groupBy("table_no", "key").count().filter("count > 1").select("table_no", "key")
    # Rows that are alone with their key have no candidate there.
    dealt = store(dealt.join(shared, ["table_no", "key"]), "dealt", folder)

    def forest(rows, group, side):
        raw = _raw(rows["fp"], width)
        i, j = trie_forest(raw, group, budget, side)
        distance = np.bitwise_count(raw[i] ^ raw[j]).sum(axis=1, dtype=np.int32)
        return _pairs(rows, i, j).assign(distance=distance)

    found = store(_searched(dealt, width, budget, forest, "a binary, b binary, distance int", bound, folder), "forest", folder)
    ends = found.select(F.col("a").alias("node"), F.col("b").alias("other"), "distance").union(
        found.select(F.col("b").alias("node"), F.col("a").alias("other"), "distance"))
    nearest = store(ends.groupBy("node").agg(F.min(F.struct("distance", "other")).alias("to")), "nearest", folder)
    # Every row with a candidate has an end in the forest.
    nodes = nearest.select("node")
    firsts = nodes.join(distinct.select(F.col("fp").alias("node"), "first"), "node")
    sets = store(_shingle_sets(docs, firsts, shingle), "sets", folder)
    to = F.col("to.other")
    pairs = nearest.select(F.least("node", to).alias("a"), F.greatest("node", to).alias("b")).distinct()
    compared = store(_compared(pairs, sets, least), "compared", folder)
    # Rows with a candidate, of which each has a set.
    searched = dealt.join(sets.select(F.col("node").alias("fp"), "sketch"), "fp")
    search = searched
    while True:
        members = components(compared.filter("near").select("a", "b"), folder)
        labels = members.select(F.col("node").alias("fp"), F.col("root").alias("label"))
        labelled = store(search.join(labels, "fp", "left").select(
            "table_no", "key", "fp", F.coalesce("label", "fp").alias("label"), "sketch"), "labelled", folder)

        def others(rows, group, side, most=most):
            raw, label = rows["fp"], pd.factorize(rows["label"])[0]
            sizes = np.ascontiguousarray(_raw(raw, width + 4)[:, width:]).view(">u4").ravel().astype(np.int64)
            differ = least_differences(rows["sketch"].tolist())

            def allowed(i, j):
                good = np.minimum(sizes[i], sizes[j]) * below >= np.maximum(sizes[i], sizes[j]) * above
                i, j = i[good], j[good]
                # Sets that differ in d of s elements have a similarity of (s - d) / (s + d).
                good[good] = differ(i, j) * (above + below) <= (sizes[i] + sizes[j]) * (below - above)
                return good

            i, j, distance, left_out = nearest_others(_raw(raw, width), group, label, budget, most, side, allowed)
            cut = np.isin(group, np.unique(group[left_out]))
            return _pairs(rows, i, j).assign(
                distance=distance.astype(np.int32), table_no=rows["table_no"].to_numpy()[i], key=rows["key"].to_numpy()[i], cut=cut[i])

        found = store(_searched(labelled, width, budget, others,
                                "a binary, b binary, distance int, table_no int, key long, cut boolean", bound, folder), "others", folder)
        fresh = store(_per_row(found.join(compared, ["a", "b"], "left_anti"), most), "fresh", folder)
        new = store(_compared(fresh.filter("kept"), sets, least), "compared", folder)
        # Keys with a pair that waits: left out by a task, or beyond the nearest of both its rows.
        waiting = found.filter("cut").select("table_no", "key").union(
            found.join(fresh.filter("not kept"), ["a", "b"], "left_semi").select("table_no", "key")).distinct()
        waiting = store(waiting, "waiting", folder)
        compared = compared.union(new)
        if not waiting.take(1):
            break
        search = searched.join(waiting, ["table_no", "key"], "left_semi")
        most *= GROWTH
    groups = _groups(fps, distinct, components(compared.filter("near").select("a", "b"), folder), folder)
    drop_folder(spark, folder)
    return groups


def _pairs(rows: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Names of the pairs, the smaller first."""
    fps = rows["fp"].to_numpy()
    return pd.DataFrame({"a": np.minimum(fps[i], fps[j]), "b": np.maximum(fps[i], fps[j])})


def _distinct(fps: DataFrame, folder: str, *keys: str) -> DataFrame:
    """fp, first (its first row by id, nulls last, and text hash) and the keys, which are those of every row of the fingerprint."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    return store(fps.groupBy("fp").agg(F.min(row).alias("first"), *[F.min(k).alias(k) for k in keys]), "distinct", folder)


def _groups(fps: DataFrame, distinct: DataFrame, members: DataFrame, folder: str) -> DataFrame:
    linked = members.join(distinct, members["node"] == distinct["fp"]).select("node", "root", "first")
    least = store(linked.groupBy("root").agg(F.min("first").alias("least")), "least", folder)
    named = linked.join(least, "root").select(F.col("node").alias("fp"), "least")
    # Written, so that the last join reads both sides through exchanges of its own and a frequent one can be split.
    ids = store(distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("least")), "ids")
    return fps.join(ids, "fp").select(
        "doc_id", "text_hash", "fp", F.col("least.doc_id").alias("component_id"),
        F.col("least.text_hash").alias("first_hash"))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of `docs` for each component of `groups`: its first by id (nulls last) and text hash. Columns of `docs`
    keep names and values, whatever they are called."""
    chosen = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash")))
    chosen = chosen.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                       text_hash("text").alias("hash"))
    # Rows equal in id and text are repeats of one document.
    nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy("id"))
    return rows.join(chosen, ["id", "hash"], "left_semi").withColumn("nth", nth).filter("nth = 1").select("row.*")
