"""The checked queries."""

from __future__ import annotations

from importlib import import_module

from tenc.suite.registry import ORACLES, QUERIES

MODULES = ("encoding", "cleaning", "relations", "evaluation", "files", "modelling")


def _load() -> None:
    for name in MODULES:
        import_module(f"tenc.suite.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
