"""Registered queries over the test tables, each with its reference SQL where one exists."""

from importlib import import_module

MODULES = (
    "text", "chunking", "search", "shaping", "judge", "context", "citations", "conversations", "catalog",
    "evaluation", "live", "pipeline",
)


def load():
    """Import every module that registers queries and return the registry."""
    for m in MODULES:
        import_module(f"hitweave.plans.{m}_queries")
    return import_module("hitweave.plans.registry")
