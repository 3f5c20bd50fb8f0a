"""The registered queries, by area."""

from importlib import import_module

AREAS = ("rows", "joins", "aggregates", "windows", "recipes", "quality", "nested", "merges", "io", "profiles", "scalars", "streams", "flagship")


def load() -> dict:
    for area in AREAS:
        import_module(f"millrace.plans.{area}")
    from millrace.plans.registry import REGISTRY

    return REGISTRY
