"""All registered queries of the library and the SQL that states each of them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

FLAGSHIP = "search_name_similar"
MODULES = ("register", "reading", "exchange", "ledger")


def queries() -> dict[str, Callable]:
    return {k: q for m in MODULES for k, q in import_module(f"rollkeep.queries.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"rollkeep.queries.{m}").SQL.items()}
