"""Registered queries, by area."""

from importlib import import_module

AREAS = ("relational", "joins", "aggregates", "scalar", "functions", "temporal", "vector", "streams", "extension", "analytics", "privacy")


def load_all() -> None:
    """Registers every area's queries."""
    for area in AREAS:
        import_module(f"tidemill.plans.{area}")
