
from __future__ import annotations


def all_queries() -> dict:
    from catalog import evaluation, features, learning, monitoring, standard, storage

    merged: dict = {}
    for module in (standard, features, evaluation, monitoring, storage, learning):
        for name, pair in module.QUERIES.items():
            if name in merged:
                raise ValueError(f"query {name} registered twice")
            merged[name] = pair
    return merged
