"""Queries over the driver's tables, built from the operators."""

from importlib import import_module

from cuefold.plans.registry import ORACLES, QUERIES

MODULES = ("timeline_queries", "media_queries", "candidate_queries", "editorial_queries")


def load_queries():
    """All registered queries and oracles, by name."""
    for module in MODULES:
        import_module(f"cuefold.plans.{module}")
    return QUERIES, ORACLES
