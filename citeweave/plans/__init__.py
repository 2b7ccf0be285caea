"""Registered queries by topic."""

from __future__ import annotations

import importlib

from .registry import ORACLE, QUERIES

_TOPICS = ("ingest", "sync", "matching", "search", "answers", "ledger", "evals", "streams", "tables")


def _load() -> None:
    for topic in _TOPICS:
        importlib.import_module(f"{__name__}.{topic}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLE)
