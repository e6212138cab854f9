"""Every query of the engine with its SQL twin, by name."""

from __future__ import annotations

from . import keeping, models, records, series, streams
from .common import Query

_MODULES = (series, models, keeping, streams, records)


def queries() -> dict[str, Query]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
