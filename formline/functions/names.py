"""Column expressions for team names: keys, accent folding, word counts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def alias_key(name: Column) -> Column:
    """Lookup key of an alias: trimmed, lower case, blanks as underscores."""
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))


def fold_key(name: Column) -> Column:
    """Case-insensitive comparison key."""
    return F.lower(F.trim(name))


def _latin_fold() -> tuple[str, str, dict[str, str]]:
    """Latin letters whose compatibility decomposition has an ASCII part."""
    single_from, single_to, longer = [], [], {}
    blocks = [range(0x00A0, 0x0250), range(0x1E00, 0x1F00)]
    for block in blocks:
        for code in block:
            char = chr(code)
            plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
            if len(plain) == 1:
                single_from.append(char)
                single_to.append(plain)
            elif len(plain) > 1:
                longer[char] = plain
    return "".join(single_from), "".join(single_to), longer


_FROM, _TO, _LONGER = _latin_fold()


def ascii_fold(name: Column) -> Column:
    """Accents stripped; letters without an ASCII base (such as the o with stroke) are dropped."""
    out = F.translate(name, _FROM, _TO)
    for char, plain in _LONGER.items():
        out = F.replace(out, F.lit(char), F.lit(plain))
    return F.regexp_replace(out, "[^\\x00-\\x7F]", "")


def word_count(name: Column) -> Column:
    """Number of blank-separated words; 0 for an empty name."""
    words = F.split(F.trim(name), "\\s+")
    return F.size(F.filter(words, lambda w: w != ""))


def contains_any(text: Column, tokens: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for token in tokens:
        hit = hit | text.contains(token)
    return hit
