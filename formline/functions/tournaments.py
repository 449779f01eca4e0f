"""Tournament flags, segment routing and report labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formline.functions.names import contains_any

# Flag patterns (case-insensitive) of the training data set.
TRAINING_FLAG_PATTERNS = {
    "is_friendly": "Friendly",
    "is_world_cup": "World Cup|WC|FIFA",
    "is_qualifier": "Qualification|Qualifier|WCQ|ECQ|COPAAQ|ACNQ|AFC|AFCQ|OFC|OFCQ|UEFAQ|CONMEBOLQ",
    "is_continental": "Championship|Euro|COPA|Africa|Asian|Confederation",
}

# Substrings of the narrower serving flags (no bare afc / ofc).
SERVING_FLAG_TOKENS = {
    "is_friendly": ("friendly",),
    "is_world_cup": ("world cup", "wc", "fifa"),
    "is_qualifier": (
        "qualification", "qualifier", "wcq", "ecq", "copaaq", "acnq", "afcq", "ofcq", "uefaq",
        "conmebolq",
    ),
    "is_continental": ("championship", "euro", "copa", "africa", "asian", "confederation"),
}

# Segment routing keywords.
QUALIFIER_KEYWORDS = ("qualification", "qualifier", "playoff", "repechage")
CONTINENTAL_KEYWORDS = (
    "copa am", "euro", "africa cup", "african cup", "asian cup", "confederations", "gold cup",
    "nations league",
)

# Segment and confederation names of the data, in the order reports use.
SEGMENTS = ("worldcup", "friendlies", "qualifiers", "continental")
COMPETITION_SEGMENTS = ("World Cup", "Qualifier", "Continental", "Friendly", "Other")
CONFEDERATION_ORDER = ("UEFA", "AFC", "CAF", "CONCACAF", "CONMEBOL")


def training_flags(tournament: Column) -> dict[str, Column]:
    """Flags from the regular expressions; NULL tournament gives 0. Not exclusive."""
    return {
        name: F.coalesce(tournament.rlike(f"(?i)({pattern})"), F.lit(False)).cast("int")
        for name, pattern in TRAINING_FLAG_PATTERNS.items()
    }


def serving_flags(tournament: Column) -> dict[str, Column]:
    """Flags from trimmed lower-case substrings; NULL tournament gives 0."""
    text = F.lower(F.trim(F.coalesce(tournament, F.lit(""))))
    return {name: contains_any(text, tokens).cast("int") for name, tokens in SERVING_FLAG_TOKENS.items()}


def match_segment(tournament: Column) -> Column:
    """Routed segment, NULL when nothing fits. The order of the tests matters."""
    text = F.lower(tournament)
    return (
        F.when(text.contains("world cup") & ~text.contains("qualification"), "worldcup")
        .when(text.contains("friendly"), "friendlies")
        .when(contains_any(text, QUALIFIER_KEYWORDS), "qualifiers")
        .when(contains_any(text, CONTINENTAL_KEYWORDS), "continental")
    )


def competition_segment(
    is_world_cup: Column, is_qualifier: Column, is_continental: Column, is_friendly: Column
) -> Column:
    return (
        F.when(is_world_cup == 1, "World Cup")
        .when(is_qualifier == 1, "Qualifier")
        .when(is_continental == 1, "Continental")
        .when(is_friendly == 1, "Friendly")
        .otherwise("Other")
    )


def two_year_window(date: Column) -> Column:
    """Label such as 2025-2026; windows start in odd years."""
    start = F.year(date) - (1 - F.year(date) % 2)
    return F.concat_ws("-", start.cast("string"), (start + 1).cast("string"))


def rank_in_order(value: Column, order: tuple[str, ...]) -> Column:
    """Position in a fixed display order; values outside it sort last."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(position == 0, len(order) + 1).otherwise(position)
