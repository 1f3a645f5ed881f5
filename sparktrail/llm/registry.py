"""The queries and DuckDB texts of this subpackage."""

from __future__ import annotations

from . import ann, decontamination, lm_scoring, minhash, packing, pii, sharding, token_output, toxicity, warc

MODULES = (packing, lm_scoring, toxicity, warc, pii, ann, decontamination, token_output, minhash, sharding)


def queries():
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
