"""Named queries over the given tables, each next to its SQL check."""

import importlib

_MODULES = ("market", "series", "trading", "pairs", "market_structure", "surveillance", "texts", "evaluation", "learning", "storage", "live")


def load():
    """Import every query module and return (queries, SQL checks)."""
    from tidemark.plans import registry

    for name in _MODULES:
        importlib.import_module(f"tidemark.plans.{name}")
    return registry.QUERIES, registry.ORACLES
