"""Query catalogue of the lineage engine: (spark, sf_dir) -> DataFrame, and the DuckDB text of each."""

from __future__ import annotations

from .plans import micro, stored, tpch

FLAGSHIP = "q3_lineage_lineitem"


def _entries() -> dict[str, micro.Entry]:
    rules = micro.entries()
    return rules | stored.entries(rules["sketch_large"].sql) | tpch.entries()


def queries():
    return {name: e.run for name, e in _entries().items()}


def oracle_sql():
    return {name: e.sql for name, e in _entries().items() if e.sql}
