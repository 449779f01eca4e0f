"""Secret scans by one combined deterministic automaton.

The rules' regular expressions become one nondeterministic automaton with a free start, subset
construction makes it deterministic, partition refinement makes it minimal, and the result is an array
of transitions by byte class. A text is scanned once, byte by byte, for all rules together. Each state
knows the rules that accept in it; where a rule stops to accept, a match ended. The start
of that match comes from the rule's reversed automaton, run back from the end to the end of the rule's
match before it: the leftmost start wins, so matches of one rule are leftmost, longest and do not overlap. This
equals a backtracking search for rules whose matches end where a run of characters ends (all rules here).

Every code point is one byte for the scan (others than ASCII become `?`, which no rule accepts), so
spans count code points.

Defined cases: null is the empty text and has no spans; long texts are scanned whole; repeated rows and
null ids keep a row each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as ops
from re import _parser as parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import id_and_text

Span = tuple[str, int, int]


@dataclass(frozen=True)
class Rule:
    """A match counts if `group` of it (0: all of it) has `least` characters or more."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The three base rules. The scan pattern of hex has the least length in it; a run of
# 16 or more is the same either way.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
FURTHER = (
    Rule("private_key", r"-----BEGIN [A-Z ]+PRIVATE KEY-----"),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]+", 24),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 20),
)
RULES = BASE + FURTHER


class _Nfa:
    """States with byte-set moves and free moves; `reverse` builds the automaton of the reversed words."""

    def __init__(self, reverse: bool = False):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.reverse = reverse

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def build(self, tree, start: int, fold: bool) -> int:
        """Adds the parsed expression after `start`; the state after it."""
        for op, arg in (reversed(list(tree)) if self.reverse else tree):
            start = self._one(op, arg, start, fold)
        return start

    def _one(self, op, arg, start: int, fold: bool) -> int:
        if op in (ops.LITERAL, ops.IN):
            chars = _set(arg) if op is ops.IN else {arg}
            if fold:
                chars = {ord(x) for c in chars for x in (chr(c).lower(), chr(c).upper())}
            end = self.state()
            self.moves[start].append((frozenset(chars), end))
            return end
        if op is ops.SUBPATTERN:
            _, on, _, tree = arg
            return self.build(tree, start, fold or bool(on & re.IGNORECASE))
        if op is ops.BRANCH:
            end = self.state()
            for tree in arg[1]:
                self.free[self.build(tree, self._after(start), fold)].append(end)
            return end
        if op is ops.MAX_REPEAT:
            low, high, tree = arg
            for _ in range(low):
                start = self.build(tree, start, fold)
            if high is ops.MAXREPEAT:
                loop = self._after(start)
                self.free[self.build(tree, loop, fold)].append(loop)
                return self._after(loop)
            end = self.state()
            self.free[start].append(end)
            for _ in range(high - low):
                start = self.build(tree, start, fold)
                self.free[start].append(end)
            return end
        raise ValueError(f"rules may not use {op}")

    def _after(self, state: int) -> int:
        new = self.state()
        self.free[state].append(new)
        return new

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.free[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


def _set(items) -> set[int]:
    chars: set[int] = set()
    for op, arg in items:
        if op is ops.LITERAL:
            chars.add(arg)
        elif op is ops.RANGE:
            chars.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"rules may not use {op} in a set")
    return chars


@dataclass(frozen=True)
class Automaton:
    """classes: 256 bytes that map a byte to its class; moves[state][class]; accepts[state]: rule bits."""

    classes: bytes
    moves: list[list[int]]
    accepts: list[int]


def _determine(nfa: _Nfa, start: int, ends: dict[int, int], free_start: bool) -> Automaton:
    """Subset construction over byte classes."""
    sets = sorted({chars for moves in nfa.moves for chars, _ in moves}, key=sorted)
    signature = [tuple(byte in chars for chars in sets) for byte in range(256)]
    number = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    sample = {number[s]: byte for byte, s in enumerate(signature)}
    first = nfa.closure([start])
    found, order, moves = {first: 0}, [first], []
    for states in order:
        row = []
        for klass in range(len(number)):
            byte = sample[klass]
            into = {end for s in states for chars, end in nfa.moves[s] if byte in chars}
            target = nfa.closure(into | ({start} if free_start else set()))
            if target not in found:
                found[target] = len(order)
                order.append(target)
            row.append(found[target])
        moves.append(row)
    accepts = [sum(bit for end, bit in ends.items() if end in states) for states in order]
    return _minimal(Automaton(bytes(number[s] for s in signature), moves, accepts))


def _minimal(a: Automaton) -> Automaton:
    """Merges states that no continuation tells apart, by refining the partition until it is stable."""
    block = {s: a.accepts[s] for s in range(len(a.moves))}
    count = len(set(block.values()))
    while True:
        key = {s: (block[s], *(block[t] for t in row)) for s, row in enumerate(a.moves)}
        number = {k: i for i, k in enumerate(dict.fromkeys(key.values()))}
        block = {s: number[k] for s, k in key.items()}
        if len(number) == count:
            break
        count = len(number)
    moves, accepts = [[]] * count, [0] * count
    for s, row in enumerate(a.moves):
        moves[block[s]], accepts[block[s]] = [block[t] for t in row], a.accepts[s]
    return Automaton(a.classes, moves, accepts)


@lru_cache(maxsize=8)
def combined(rules: tuple[Rule, ...]) -> Automaton:
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for number, rule in enumerate(rules):
        ends[nfa.build(parser.parse(rule.pattern), nfa._after(start), False)] = 1 << number
    return _determine(nfa, start, ends, free_start=True)


@lru_cache(maxsize=32)
def backwards(rule: Rule) -> Automaton:
    nfa = _Nfa(reverse=True)
    start = nfa.state()
    end = nfa.build(parser.parse(rule.pattern), start, False)
    return _determine(nfa, start, {end: 1}, free_start=False)


def _linked(a: Automaton) -> list[list]:
    """Rows that hold the next rows themselves and, last, the accepted rules: one lookup per byte."""
    rows = [[None] * len(row) + [accepted] for row, accepted in zip(a.moves, a.accepts)]
    for row, targets in zip(rows, a.moves):
        row[: len(targets)] = [rows[t] for t in targets]
    return rows


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...]) -> Callable[[str | None], list[Span]]:
    """A function from a text to its spans (kind, start, end) by start, then rule order."""
    automaton = combined(rules)
    first, classes = _linked(automaton)[0], automaton.classes
    back = [(_linked(b)[0], b.classes) for b in map(backwards, rules)]
    whole = [re.compile(rule.pattern) for rule in rules]

    def start_of(number: int, data: bytes, end: int, floor: int) -> int | None:
        row, kinds = back[number]
        start = None
        for at in range(end - 1, floor - 1, -1):
            row = row[kinds[data[at]]]
            if row[-1]:
                start = at
        return start

    def scan(text: str | None) -> list[Span]:
        if not text:
            return []
        data = text.encode("ascii", "replace")
        state, held, ended = first, 0, []
        for at, klass in enumerate(data.translate(classes)):
            state = state[klass]
            if state[-1] != held:
                if held & ~state[-1]:
                    ended.append((at, held & ~state[-1]))
                held = state[-1]
        if held:
            ended.append((len(data), held))
        spans, floors = [], [0] * len(rules)
        for end, which in ended:
            for number, rule in enumerate(rules):
                if which >> number & 1:
                    start = start_of(number, data, end, floors[number])
                    if start is None:
                        continue
                    floors[number] = end
                    part = end - start
                    if rule.group:
                        part = len(whole[number].fullmatch(data[start:end].decode())[rule.group])
                    if part >= rule.least:
                        spans.append((start, number, end))
        return [(rules[number].kind, start, end) for start, number, end in sorted(spans)]

    return scan


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of kind, start, end) for every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = scanner(rules)
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(text)] for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "spans": spans})

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    return id_and_text(docs).mapInPandas(run, schema)


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) for every row."""
    base = [rule.kind for rule in BASE]

    def text_of(spans):
        return F.array_join(F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count_of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return scan_documents(docs, rules).select(
        "doc_id",
        *map(count_of, base),
        F.sha2(text_of(own).cast("binary"), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The rows of `docs` with every span replaced (overlapping spans as one); texts without spans stay as they are."""
    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        scan = scanner(rules)
        return texts.map(lambda text: None if text is None else _replace(text, scan(text), mark))

    return docs.withColumn("text", cleaned(F.col("text")))


def _replace(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text
