"""Token counts of the sections of documents, by offsets of one encoding of the whole text.

A document is encoded once as a whole, so counts add up to what a model sees. The tokens' byte spans, from the
lengths of the vocabulary's entries, are joined to the sections' spans by binary search. A token that lies
over a boundary goes to the section of its first byte that is not white space; a token of nothing but white space
goes to the section of its first byte.

Sections are consecutive spans that cover the text; `head_body_tail` (first line, lines between, last line) is the
default, and any function from a text to (name, start) pairs in code points will do.

Defined cases: null and empty texts have one section without tokens; very long texts are encoded whole;
repeated rows and null ids keep their rows; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from formline.llm.common import id_and_text

Sections = Callable[[str], list[tuple[str, int]]]
_SPACE = b" \t\n\r\x0b\x0c"


def head_body_tail(text: str) -> list[tuple[str, int]]:
    """The first line with its line end, the last line, and what lies between, as far as there is such."""
    first, last = text.find("\n") + 1, text.rfind("\n") + 1
    out = [("head", 0)]
    if first and last > first:
        out.append(("body", first))
    if first and last < len(text):
        out.append(("tail", last))
    return out


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoder of a rank file, and by token id its bytes' count and its leading white space."""
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths, leading = np.zeros(max(ranks.values()) + 1, np.int64), np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
        leading[rank] = (len(token) - len(token.lstrip(_SPACE))) % len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths, leading


def attribute(text: str, sections: list[tuple[str, int]], coder) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section."""
    encoder, lengths, leading = coder
    ids = np.array(encoder.encode_ordinary(text), np.int64)
    starts, at = [], 0
    for _, start in sections:
        starts.append((starts[-1] if starts else 0) + len(text[at:start].encode("utf-8", "replace")))
        at = start
    ends = np.cumsum(lengths[ids])
    begins = ends - lengths[ids]
    home = np.searchsorted(starts, begins + leading[ids], side="right") - 1
    crossing = np.searchsorted(starts, begins, side="right") != np.searchsorted(starts, ends - 1, side="right")
    return np.bincount(home, minlength=len(starts)), np.bincount(home[crossing], minlength=len(starts))


def token_counts(docs: DataFrame, path: str, pattern: str, sections: Sections = head_body_tail) -> DataFrame:
    """doc_id, section, section_no, start (code point), n_tokens, n_crossing for every section of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(path, pattern)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                found = sections(text or "")
                own, crossing = attribute(text or "", found, coder)
                out += [(doc_id, name, number, start, own[number], crossing[number])
                        for number, (name, start) in enumerate(found)]
            made = pd.DataFrame(out, columns=["doc_id", "section", "section_no", "start", "n_tokens", "n_crossing"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    return id_and_text(docs).mapInPandas(
        run, "doc_id long, section string, section_no int, start long, n_tokens long, n_crossing long")
