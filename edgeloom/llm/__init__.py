"""Operators of a training-data pipeline; nothing outside this folder imports them."""

import importlib

MODULES = (
    "simhash",
    "suffix_dedup",
    "knn_join",
    "ann",
    "chat",
    "html_text",
    "secret_scan",
    "mixing",
    "packing",
    "langid",
    "divergence",
    "ngram_jaccard",
    "centroids",
)


def load_all() -> tuple[dict, dict]:
    """Queries and SQL of every operator."""
    for name in MODULES:
        importlib.import_module(f"edgeloom.llm.{name}")
    from edgeloom.llm.common import ORACLES, QUERIES

    return QUERIES, ORACLES
