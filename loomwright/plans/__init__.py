"""Registered plans: each module wires operators to tables and gives the SQL to compare with."""

import importlib

MODULES = ("corpus", "scoring", "validation", "tokens", "ingest", "tables", "corpora", "generated")


def load() -> None:
    """Import every module here that registers queries."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
