"""Registered queries: every module here pairs Spark plans with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("aggregates", "filters", "ordering", "sources", "joins", "scalars", "dates", "dupes", "places", "tags", "windows", "search", "generation", "corrections",
           "organize", "lifecycle", "stream")


def load_all():
    from . import registry

    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return registry
