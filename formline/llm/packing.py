"""Token packing: length patterns fitted by non-negative least squares, residuals by best fit.

1. Every document is encoded once; its ids plus the end id are cut into pieces of at most `size` tokens.
2. The histogram of piece lengths (at most `size` numbers) goes to the driver. Lengths are grouped in steps of
   `step` tokens; patterns are all sums of up to `parts` steps that fill a sequence. Non-negative least
   squares finds how often each pattern should occur, and the counts are rounded.
3. Patterns are given real lengths that fill a sequence exactly; what no pattern took is the residual, packed by
   best fit, longest first, still on counts. The plan lists, for each length, runs of
   equal places; its size depends on `size`, not on the data.
4. Pieces are numbered within their length (numbers per written file, plus offsets by file), and the plan
   turns length and number into sequence and offset.

Defined cases: null and empty texts are one piece that holds the end id; very long texts give many
pieces; rows with equal text or id are packed one by one; an empty table gives an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import id_and_text, store

SIZE = 2048
END_ID = 0
REMEMBERED = 400_000
_memory: dict[str, dict] = {}
_TAIL = ".,!?%&$*#|;"
_other = re.compile("[^\x00-\u024f]|\u0130").search


def encoder(path: str, remembered: int = REMEMBERED):
    """A function from texts to the bytes of their ids (little-endian, 32 bits), by the tokenizer file at `path`.

    The pre-tokenizer of this vocabulary never joins characters across white space, nor letters
    and punctuation, and it lower-cases; so lower-case words without their trailing punctuation are encoded once and
    remembered per worker. Words of letters are encoded many at a time: each ends with a token of the vocabulary's
    word ends.
    """
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    if path not in _memory:
        tokenizer = Tokenizer.from_file(path)
        last = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        last[[number for token, number in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        _memory[path] = {"tokenizer": tokenizer, "words": {}, "last": last}
    tokenizer, memory, last = (_memory[path][k] for k in ("tokenizer", "words", "last"))

    def learn_each(words: list[str]) -> None:
        for word, coded in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            memory[word] = np.array(coded.ids, "<u4").tobytes()

    def learn(words: list[str]) -> None:
        letters = [word for word in words if word.isalpha()]
        groups = [letters[at:at + 200] for at in range(0, len(letters), 200)]
        for group, coded in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            ends = 4 * (np.flatnonzero(last[ids]) + 1)
            if len(ends) != len(group):
                learn_each(group)
                continue
            data = ids.tobytes()
            memory.update(zip(group, map(data.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))))
        learn_each([word for word in words if not word.isalpha()])

    def encode(texts: list[str]) -> list[bytes]:
        if len(memory) > remembered:
            memory.clear()
        # Lower-casing here is that of the tokenizer for the characters below U+0250 but one.
        split = [(text if _other(text) else text.lower()).replace("\n", " ").split(" ") for text in texts]
        new = set(itertools.chain.from_iterable(split)).difference(memory)
        bodies = {}
        for word in new:
            body = word.rstrip(_TAIL)
            # The last character after lower-casing: U+0130 becomes two, of which the second is no letter.
            if body != word and body and body.lower()[-1].isalpha() and "<|" not in word:
                bodies[word] = body
        needed = {*new.difference(bodies), *bodies.values(), *(w[len(b):] for w, b in bodies.items())}
        learn(list(needed.difference(memory)))
        for word, body in bodies.items():
            memory[word] = memory[body] + memory[word[len(body):]]
        return [b"".join(map(memory.__getitem__, words)) for words in split]

    return encode


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = True,
           remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth (and ids): nth counts a length within a part."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, remembered)
        part, seen = TaskContext.get().partitionId(), Counter()
        end = np.uint32(END_ID).tobytes()
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at:at + 512]
                out = []
                for doc_id, coded in zip(some["doc_id"].astype("Int64"), encode(some["text"].fillna("").tolist())):
                    coded += end
                    for number, lo in enumerate(range(0, len(coded), 4 * size)):
                        piece = coded[lo:lo + 4 * size]
                        length = len(piece) // 4
                        out.append((doc_id, number, lo // 4, length, zlib.crc32(piece), part, seen[length])
                                   + ((np.frombuffer(piece, "<i4"),) if with_ids else ()))
                        seen[length] += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
                made = pd.DataFrame(out, columns=names[: 7 + with_ids])
                made["doc_id"] = made["doc_id"].astype("Int64")
                yield made

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return id_and_text(docs).mapInPandas(run, schema + ", ids array<int>" * with_ids)


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """min |a x - b| with x >= 0: Lawson and Hanson's active set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    enough = 1e-9 * (1 + np.abs(a.T @ b).max(initial=0))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        enter = int(np.argmax(gradient))
        if gradient[enter] <= enough:
            break
        passive[enter] = True
        while True:
            rows = np.flatnonzero(passive)
            solved = np.linalg.lstsq(a[:, rows], b, rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[rows] = solved
                break
            low = solved <= 0
            old = x[rows]
            step = np.min(old[low] / np.maximum(old[low] - solved[low], 1e-300))
            x[rows] = np.maximum(old + step * (solved - old), 0)
            x[rows[low & (x[rows] <= 1e-9 * (1 + old.max()))]] = 0
            passive &= x > 0
            if not passive.any():
                break
    return x


def patterns(units: int, parts: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to `parts` steps with sum `units`."""
    def below(rest, most, left):
        if rest == 0:
            yield ()
        elif left:
            for unit in range(min(rest, most), 0, -1):
                if unit * left < rest:
                    break
                for tail in below(rest - unit, unit, left - 1):
                    yield (unit, *tail)
    return list(below(units, units, parts))


class _Bins:
    """Kinds of equal bins: contents -> count, found by free room."""

    def __init__(self):
        self.by_room: dict[int, Counter] = defaultdict(Counter)

    def put(self, contents: tuple[int, ...], room: int, count: int) -> None:
        if count:
            self.by_room[room][contents] += count

    def best(self, length: int) -> int | None:
        return min((room for room, kinds in self.by_room.items() if room >= length and kinds), default=None)

    def add(self, length: int, count: int, size: int) -> None:
        """Best fit for `count` pieces of one length."""
        while count:
            room = self.best(length)
            if room is None:
                each = size // length
                full, rest = divmod(count, each)
                self.put((length,) * each, size - each * length, full)
                if rest:
                    self.put((length,) * rest, size - rest * length, 1)
                return
            contents, there = next(iter(self.by_room[room].items()))
            used = min(count, there)
            each = min(room // length, count // used)
            if there == used:
                del self.by_room[room][contents]
            else:
                self.by_room[room][contents] = there - used
            self.put(contents + (length,) * each, room - each * length, used)
            count -= used * each


def shapes_of(units: int, parts: int) -> list[tuple[int, ...]]:
    """Patterns of steps whose lengths can fill `units` steps exactly: rounding up adds up to a step a part."""
    return [shape for p in range(1, parts + 1) for more in range((p + 1) // 2 if p > 1 else 1)
            for shape in patterns(units + (p // 2) + more, p) if len(shape) == p]


def _fill(shape: tuple[int, ...], of_unit: dict[int, list[int]], left: dict[int, int], size: int):
    """Choices of real lengths for a pattern that fill a sequence exactly, as (contents, most times)."""
    for head in itertools.product(*(of_unit[unit] for unit in shape[:-1])):
        last = size - sum(head)
        contents = (*head, last)
        if left.get(last) and all(left[x] for x in head):
            yield contents, min(left[x] // k for x, k in Counter(contents).items())


def plan(histogram: dict[int, int], size: int = SIZE, step: int = 32, parts: int = 3) -> list[tuple]:
    """(contents, count) for kinds of sequences that hold exactly the pieces of the histogram."""
    left = {k: v for k, v in histogram.items() if v}
    done: Counter = Counter({(size,): left.pop(size)}) if size in left else Counter()
    of_unit: dict[int, list[int]] = defaultdict(list)
    for length in sorted(left, reverse=True):
        of_unit[-(-length // step)].append(length)
    shapes = [s for s in shapes_of(size // step, parts) if all(unit in of_unit for unit in s)]
    if shapes:
        rows = sorted(of_unit)
        at = {unit: i for i, unit in enumerate(rows)}
        matrix = np.zeros((len(rows), len(shapes)))
        for column, shape in enumerate(shapes):
            for unit in shape:
                matrix[at[unit], column] += 1
        wanted = np.array([sum(left[x] for x in of_unit[unit]) for unit in rows], float)
        counts = np.floor(least_squares(matrix, wanted) + 0.5).astype(int)
        for column in np.argsort([-max(s) for s in shapes], kind="stable"):
            todo = int(counts[column])
            if todo:
                for contents, most in _fill(shapes[column], of_unit, left, size):
                    take = min(todo, most)
                    for length in contents:
                        left[length] -= take
                    done[contents] += take
                    todo -= take
                    if not todo:
                        break
    bins = _Bins()
    for length in sorted(left, reverse=True):
        bins.add(length, left[length], size)
    for kinds in bins.by_room.values():
        done.update(kinds)
    return [(contents, count) for contents, count in done.items() if count]


def runs(kinds: list[tuple]) -> pd.DataFrame:
    """For each length, runs of numbers: length, first number, first sequence, offset."""
    used, sequence, out = Counter(), 0, []
    for contents, count in kinds:
        offset = 0
        for length in contents:
            out.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return pd.DataFrame(out, columns=["length", "number", "sequence", "offset"]).sort_values(
        ["length", "number"], ignore_index=True)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = True,
           remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document."""
    spark = docs.sparkSession
    cut = store(pieces(docs, tokenizer, size, with_ids, remembered), "pieces")
    counts = store(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = runs(plan(histogram, size))
    before = counts.withColumn("base", F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    numbered = cut.join(before.withColumn("base", F.coalesce("base", F.lit(0))), ["part", "length"])
    # Runs, at most a few per length: their number is bounded by the size of a sequence.
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy(np.int64) for c in table))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        lengths, numbers, sequences, offsets = shared.value
        first = np.searchsorted(lengths, length.to_numpy(), side="left")
        wide = 2**40  # above any count of one length
        at = np.searchsorted(lengths * wide + numbers, length.to_numpy() * wide + number.to_numpy(), side="right") - 1
        at = np.maximum(at, first)
        return pd.DataFrame({"sequence_id": sequences[at] + number.to_numpy() - numbers[at], "offset": offsets[at]})

    placed = numbered.withColumn("_place", place("length", F.col("base") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset",
                         *(["ids"] if with_ids else []))
