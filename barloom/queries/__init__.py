"""Registered queries: each operator on a natural analogue in the driver's tables, and the same in DuckDB SQL."""

from importlib import import_module

MODULES = ("bars", "records", "partitions", "portfolio", "orders", "stored")


def _modules():
    return [import_module(f"{__name__}.{m}") for m in MODULES]


def all_queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.ORACLES.items()}
