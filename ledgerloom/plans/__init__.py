"""Registered queries: operators applied to the archive tables."""

import importlib

MODULES = ("listing", "lookups", "sheets", "extraction", "upkeep", "answers", "searching", "intake")


def load_all() -> None:
    """Import every plan module so that its queries are registered."""
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
