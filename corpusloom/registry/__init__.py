"""All registered queries, by area."""

from importlib import import_module

from corpusloom.registry.base import REGISTRY, Query

AREAS = ("sources", "cleaning", "chunking", "models", "search", "reports", "stored")


def load() -> dict[str, Query]:
    for area in AREAS:
        import_module(f"corpusloom.registry.{area}")
    return REGISTRY
