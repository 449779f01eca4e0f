"""Long repeated word spans by a compacted de Bruijn graph of token k-mers.

An edge of the graph is a window of `window` consecutive words; a repeated edge occurs at two or more
places. Edges are never listed one by one at first. Every edge has an anchor, the word k-mer in it with the
least hash, and the edges of consecutive positions that share one anchor place form a nonbranching path.
A path is one row: anchor hash, digest of all its words, document, first position, number of edges.

1. Paths meet through Spark joins on the anchor, equal ones of a task counted first. An anchor that occurs once has no repeated edge.
2. An anchor whose paths are all equal gives repeated edges only: the whole path is a repeated span.
3. The edges of the other paths with a repeated anchor (ends of spans, variants) are opened: each gets a
   128-bit digest of its words, and equal digests are counted, within each task first.
4. The coordinates of repeated spans go back to their documents, where covered words are removed.

Two occurrences of one edge have the same anchor at the same distance, because the anchor depends on
nothing but the edge's words (ties: the leftmost). So no repeated edge is lost.

Defined cases: null text has no words; a document with fewer words than a window keeps all; copies of a
document lose all words (if a window fits); repeated rows count as separate places and each gets a result row;
null ids are a value like any other; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import NO_ID, id_and_text, store

ANCHOR_WORDS = 8
WORDS_AT_ONCE = 1_000_000
_PLACE = np.uint64(2**28 - 1)
_BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA24BAED4963EE407))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


class _Words:
    """Word hashes of several documents end to end, and digests of any slice of them."""

    def __init__(self, texts: list[list[bytes]]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        digest = xxhash.xxh64_intdigest
        self.hashes = np.array([digest(w) for words in texts for w in words], dtype=np.uint64)
        n = len(self.hashes) + 1
        other = self.hashes * _BASES[2]
        other ^= other >> np.uint64(31)
        self._sums = []
        for values, base in ((self.hashes, _BASES[0]), (other * _BASES[1], _BASES[1])):
            powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base)])
            back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _inverse(base))])
            self._sums.append((np.r_[np.uint64(0), np.cumsum(values * powers[:-1])], back))

    def digest(self, lo: np.ndarray, hi: np.ndarray, lane: int) -> np.ndarray:
        """64-bit digest of the words lo..hi-1."""
        sums, back = self._sums[lane]
        value = (sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64)
        value = (value ^ (value >> np.uint64(32))) * _BASES[2]
        return value ^ (value >> np.uint64(29))

    def window_starts(self, window: int) -> np.ndarray:
        counts = np.maximum(self.lengths - window + 1, 0)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return at + np.repeat(self.starts, counts)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _paths(words: _Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """document index, first position, edges, anchor hash, digest of each path."""
    starts = words.window_starts(window)
    if not len(starts):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    grams = np.arange(len(words.hashes) - anchor + 1)
    hashes = words.digest(grams, grams + anchor, 0)
    ranked = (hashes & ~_PLACE) | grams.astype(np.uint64)
    chosen = (_least(ranked, window - anchor + 1)[starts] & _PLACE).astype(np.int64)
    owner = np.searchsorted(words.starts, starts, side="right") - 1
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])]
    first = np.flatnonzero(new)
    edges = np.diff(np.r_[first, len(starts)])
    lo = starts[first]
    return (owner[first], lo - words.starts[owner[first]], edges, hashes[chosen[first]],
            words.digest(lo, lo + edges + window - 1, 1))


def _in_parts(texts_of: list[list[bytes]] | Iterator[list[bytes]]) -> Iterator[tuple[np.ndarray, list[list[bytes]]]]:
    """Row numbers and words of some rows at a time, so that arrays stay small."""
    rows, texts, size = [], [], 0
    for row, words in enumerate(texts_of):
        rows.append(row)
        texts.append(words)
        size += len(texts[-1])
        if size >= WORDS_AT_ONCE:
            yield np.array(rows), texts
            rows, texts, size = [], [], 0
    if rows:
        yield np.array(rows), texts


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with equal id and text share a key; their results are equal."""
    return id_and_text(docs).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("k2"), "doc_id", "text")


def _merged(at: np.ndarray, edges: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner, start and length of the runs that adjoining stretches form (sorted by owner and place)."""
    if not len(at):
        return owner, at, edges
    new = np.r_[True, (at[1:] != (at + edges)[:-1]) | (owner[1:] != owner[:-1])]
    first = np.flatnonzero(new)
    return owner[first], at[first], np.add.reduceat(edges, first)


def _carried(docs: DataFrame) -> DataFrame:
    """Keyed rows with compressed texts: what the joins move and keep on disk."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pd.DataFrame({
                "k1": batch["k1"], "k2": batch["k2"], "doc_id": batch["doc_id"].astype("Int64"),
                "packed": [packer.compress((text or "").encode()) for text in batch["text"]]})

    return _keyed(docs).mapInPandas(run, "k1 long, k2 long, doc_id long, packed binary")


def _unpacked(batch: pd.DataFrame) -> Iterator[list[bytes]]:
    opener = zstandard.ZstdDecompressor()
    return (opener.decompress(packed).split() for packed in batch["packed"])


def paths(docs: DataFrame, window: int, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """Rows of paths with a weight. A path that several documents of a part share is one row with its count as
    weight; its places are known to be repeated and follow as runs of weight 0."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            for rows, texts in _in_parts(map(split_words, batch["text"])):
                owner, lo, edges, anchors, digests = _paths(_Words(texts), window, anchor)
                if not len(owner):
                    continue
                order = np.lexsort((digests, anchors))
                new = (anchors[order][1:] != anchors[order][:-1]) | (digests[order][1:] != digests[order][:-1])
                first = np.flatnonzero(np.r_[True, new])
                count = np.diff(np.r_[first, len(order)])
                known = np.empty(len(order), bool)
                known[order] = np.repeat(count > 1, count)
                chosen = order[first]
                run_owner, run_lo, run_edges = _merged(lo[known], edges[known], owner[known])
                none = np.zeros(len(run_lo), np.int64)
                place = rows[np.r_[owner[chosen], run_owner]]
                yield pd.DataFrame({
                    "anchor": np.r_[anchors[chosen].view(np.int64), none],
                    "digest": np.r_[digests[chosen].view(np.int64), none], "k1": k1[place], "k2": k2[place],
                    "lo": np.r_[lo[chosen], run_lo], "edges": np.r_[edges[chosen], run_edges],
                    "weight": np.r_[count, none]})

    return _keyed(docs).select("k1", "k2", "text").mapInPandas(
        run, "anchor long, digest long, k1 long, k2 long, lo int, edges int, weight int")


def _counted(words: _Words, lo: np.ndarray, owner: np.ndarray, window: int) -> pd.DataFrame:
    """The edges at the sorted places `lo` as rows: those that occur once here (weight 1), one row for each
    edge that occurs more often (its count as weight), and the runs of the latter (weight 0), which are known to
    be repeated. So an edge that very many documents share leaves a task once."""
    w1, w2 = (words.digest(lo, lo + window, lane).view(np.int64) for lane in (0, 1))
    order = np.lexsort((w2, w1))
    new = np.r_[True, (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(lo)])
    known = np.empty(len(lo), bool)
    known[order] = np.repeat(count > 1, count)
    own = lo - words.starts[owner]
    chosen = order[first]
    edges = pd.DataFrame({"w1": w1[chosen], "w2": w2[chosen], "owner": owner[chosen], "lo": own[chosen],
                          "edges": 1, "weight": count})
    run_owner, run_lo, run_edges = _merged(own[known], np.ones(known.sum(), np.int64), owner[known])
    return pd.concat([edges, pd.DataFrame({
        "w1": 0, "w2": 0, "owner": run_owner, "lo": run_lo, "edges": run_edges, "weight": 0})], ignore_index=True)


def _open_edges(open_paths: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """w1, w2 (digest), k1, k2, lo, edges, weight of the edges on the open paths, as `_counted` gives them."""
    ranges = open_paths.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "edges")).alias("ranges"))
    held = _carried(docs).join(ranges, ["k1", "k2"]).select("k1", "k2", "packed", "ranges")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            for rows, texts in _in_parts(_unpacked(batch)):
                words = _Words(texts)
                at, owner = [], []
                for index, row in enumerate(rows):
                    for r in sorted(batch["ranges"].iat[row], key=lambda r: r["lo"]):
                        at.append(np.arange(r["lo"], r["lo"] + r["edges"]))
                        owner.append(np.full(r["edges"], index))
                owner = np.concatenate(owner)
                made = _counted(words, np.concatenate(at) + words.starts[owner], owner, window)
                place = rows[made.pop("owner").to_numpy()]
                yield made.assign(k1=k1[place], k2=k2[place])

    return held.mapInPandas(run, "w1 long, w2 long, lo int, edges int, weight int, k1 long, k2 long")


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """k1, k2, spans: for each document key the (lo, edges) runs of repeated edges; runs may overlap."""
    all_paths = store(paths(docs, window), "paths")
    weighted = all_paths.filter("weight > 0")
    anchors = (
        weighted.groupBy("anchor")
        .agg(F.sum("weight").alias("n"), F.min("digest").alias("least"), F.max("digest").alias("most"))
        .filter("n > 1").select("anchor", (F.col("least") == F.col("most")).alias("whole")))
    found = store(weighted.join(anchors, "anchor").select("k1", "k2", "lo", "edges", "whole"), "repeated-paths")
    edges = store(_open_edges(found.filter("not whole"), docs, window), "edges")
    repeated = edges.filter("weight > 0").groupBy("w1", "w2").agg(F.sum("weight").alias("n")).filter("n > 1").drop("n")
    single = edges.filter("weight = 1").join(repeated, ["w1", "w2"])
    spans = (
        found.filter("whole").select("k1", "k2", "lo", "edges")
        .union(all_paths.filter("weight = 0").select("k1", "k2", "lo", "edges"))
        .union(single.select("k1", "k2", "lo", "edges"))
        .union(edges.filter("weight = 0").select("k1", "k2", "lo", "edges")))
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "edges")).alias("spans"))


def keep_mask(n: int, spans, window: int) -> np.ndarray:
    """True for the words that no repeated window covers."""
    depth = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        lo = np.array([s["lo"] for s in spans])
        np.add.at(depth, lo, 1)
        np.add.at(depth, lo + np.array([s["edges"] for s in spans]) + window - 1, -1)
    return np.cumsum(depth)[:n] == 0


def remove_repeats(docs: DataFrame, window: int = 35, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (`with_text`) kept, the words left over joined by spaces."""
    joined = _carried(docs).join(repeated_spans(docs, window), ["k1", "k2"], "left").select("doc_id", "packed", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for words, spans in zip(_unpacked(batch), batch["spans"]):
                kept = words
                if spans is not None:
                    kept = [w for w, k in zip(words, keep_mask(len(words), spans, window).tolist()) if k]
                joined_words = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined_words).hexdigest())
                           + ((joined_words.decode(),) if with_text else ()))
            made = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"][: 3 + with_text])
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield made

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return joined.mapInPandas(run, schema)
