"""Registered queries. Importing the modules fills the registry."""

from __future__ import annotations

import importlib

from feedlake.plans.registry import QUERIES, SQL, Query

_MODULES = ("cleaning", "loading", "ranking", "usage")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
