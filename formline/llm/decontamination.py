"""Benchmark passages in documents: exact pieces first, then bit-parallel edit distance.

Texts and items are compared as lower-case runs of letters and digits joined by single spaces. An item of m
characters may differ by k = floor(share * m) edits. It is split into k + 1 pieces; k edits spoil at most k
of them, so every occurrence within the budget has one piece unchanged. One automaton finds all pieces
of a block of items in a document, each hit opens the stretch where the item can lie,
and Myers' bit-parallel distance over that stretch decides. Overlapping stretches of one item are joined,
so an item costs one pass over a document at most.

Items are handled in blocks of a stated size in characters (`block_chars`), which bounds what is broadcast;
all documents meet every block.

Defined cases: null and empty texts contain nothing; items without letters or digits match nothing; an item
may be shorter than the budget allows pieces (then k falls until each piece has a character); repeated rows
and null ids keep their rows; empty tables give an empty result; only doc_id, item_id and text are read.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import id_and_text

SHARE = 0.06
BLOCK_CHARS = 16_000_000
_words = re.compile(r"[^\W_]+").findall


def normal(text: str | None) -> str:
    return " ".join(_words((text or "").lower()))


def budget(length: int, share: float) -> int:
    return max(0, min(int(share * length), length - 1))


def cut(text: str, count: int) -> list[tuple[int, str]]:
    """`count` pieces of nearly equal length with their offsets."""
    edges = [len(text) * i // count for i in range(count + 1)]
    return [(a, text[a:b]) for a, b in zip(edges, edges[1:])]


def myers(pattern: str, text: str) -> int:
    """Least edit distance between the pattern and any stretch of the text."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for at, char in enumerate(pattern):
        masks[char] |= 1 << at
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for char in text:
        eq = masks.get(char, 0)
        vertical = eq | minus
        level = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(level | plus) & full)
        down = plus & level
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
    return best


class Matcher:
    """The pieces of some items, searched together."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.items = [(item_id, text, budget(len(text), share)) for item_id, text in items if text]
        places = defaultdict(list)
        for number, (_, text, k) in enumerate(self.items):
            for offset, piece in cut(text, k + 1):
                places[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, least distance) of the items that lie in the text within their budgets."""
        if not self.items:
            return []
        plain = normal(text)
        stretches: dict[int, list[list[int]]] = {}
        for end, (length, found) in self.automaton.iter(plain):
            for number, offset in found:
                _, item, k = self.items[number]
                lo = max(0, end + 1 - length - offset - k)
                hi = end + 1 - length - offset + len(item) + k
                held = stretches.setdefault(number, [])
                # Hits come by their ends, so starts of an item's stretches may step back a little.
                while held and held[-1][1] >= lo:
                    last = held.pop()
                    lo, hi = min(lo, last[0]), max(hi, last[1])
                held.append([lo, hi])
        out = []
        for number, held in stretches.items():
            item_id, item, k = self.items[number]
            least = min(0 if item in plain[a:b] else myers(item, plain[a:b]) for a, b in held)
            if least <= k:
                out.append((item_id, least))
        return out


_matchers: dict = {}


def _matcher(shared, share: float) -> Matcher:
    """One matcher per worker and block."""
    key = (shared.value[0], share)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(shared.value[1], share)
    return _matchers[key]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block, size = [], 0
    for row in items.toLocalIterator():
        text = normal(row["text"])
        block.append((row["item_id"], text))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    yield block


def _shared(spark: SparkSession, number: int, block: list):
    """A block as a broadcast with a name of its own; its size is bounded by the block's characters."""
    return spark.sparkContext.broadcast(((uuid.uuid4().hex, number), block))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits for every pair of a document row and an item row within the item's budget."""
    spark, texts, found = docs.sparkSession, id_and_text(docs), None
    for number, block in enumerate(_blocks(benchmark, block_chars)):
        shared = _shared(spark, number, block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = _matcher(shared, share)
            for batch in batches:
                rows = [(doc_id, item_id, edits) for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"])
                        for item_id, edits in matcher.find(text)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits"]).astype("Int64")

        part = texts.mapInPandas(run, "doc_id long, item_id long, edits int")
        found = part if found is None else found.union(part)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: float = SHARE,
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs` without any item; block by block, so that texts are read in place and not joined."""
    spark = docs.sparkSession
    for number, block in enumerate(_blocks(benchmark, block_chars)):
        docs = docs.filter(_free_of(_shared(spark, number, block), share)(F.col("text")))
    return docs


def _free_of(shared, share: float):
    @F.pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        matcher = _matcher(shared, share)
        return texts.map(lambda text: not matcher.find(text)).astype(bool)

    return free
