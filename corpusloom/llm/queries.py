"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

AREAS = (
    "chat", "fixity", "jaccard", "kneser_ney", "language", "licenses", "mixing", "packing", "pivots",
    "dense_search", "prefix_trie", "sharding", "topk",
)


def load() -> dict:
    """name -> (run, sql or None)."""
    found = {}
    for area in AREAS:
        found |= import_module(f"corpusloom.llm.queries_{area}").QUERIES
    return found
