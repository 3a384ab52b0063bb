"""Registered queries: each module pairs operators with the supplied tables."""

import importlib

MODULES: tuple[str, ...] = ("text", "qa", "rank", "corpus", "layout", "checks", "documents", "forms", "places", "planning", "figures", "passages", "citations", "jobs")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
