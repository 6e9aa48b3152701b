"""The queries of the core engine by name, each with its DuckDB SQL."""

from __future__ import annotations

import importlib

from chronoframe.sources.fixtures import ORACLE, Fixtures

_QUERIES: dict = {}
_ORACLES: dict = {}
_MODULES = ("reads", "txns", "ranges", "upkeep", "rates", "placement", "audits", "replay")


def query(name: str, sql: str | None = None, plain: bool = False):
    """Registers a function of Fixtures; sql may use the derived tables, unless it is plain."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            _ORACLES[name] = sql if plain else ORACLE + sql
        return f

    return add


def _load() -> None:
    for name in _MODULES:
        if importlib.util.find_spec(f"chronoframe.plans.{name}") is not None:
            importlib.import_module(f"chronoframe.plans.{name}")


def queries():
    _load()
    return dict(_QUERIES)


def oracle_sql():
    _load()
    return dict(_ORACLES)
