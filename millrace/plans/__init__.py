"""Whole queries over a data directory, each registered with its oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text", "corpus", "metrics", "conversations", "audit", "records", "scoring")


def load() -> None:
    """Import every module of queries, so that all are registered."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
