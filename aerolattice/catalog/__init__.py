"""Registered queries over the test tables, each with its SQL twin where SQL can say it."""

from importlib import import_module

from aerolattice.catalog.registry import ORACLES, QUERIES

MODULES = ["geometry", "planning", "records", "events", "globe", "clusters"]


def load_all():
    for name in MODULES:
        import_module(f"aerolattice.catalog.{name}")
    return QUERIES, ORACLES
