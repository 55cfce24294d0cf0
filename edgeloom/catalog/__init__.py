"""Registered queries: every operator on the star-schema tables, with its SQL twin."""

import importlib

from edgeloom.catalog.registry import ORACLES, QUERIES  # noqa: F401

MODULES = (
    "graphs",
    "links",
    "mutations",
    "archives",
    "experiments",
    "statistics",
    "texts",
    "corpus",
    "formulas",
    "storage",
    "streams",
)


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"edgeloom.catalog.{name}")
