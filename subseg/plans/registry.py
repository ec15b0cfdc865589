"""All registered queries and oracle SQL, gathered from the plan modules."""

from __future__ import annotations


def _modules():
    from . import catalog, model_queries, stream_queries, treebank_queries
    return [catalog, treebank_queries, model_queries, stream_queries]


def all_queries() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.SPARK_QUERIES)
    return out


def all_oracle_sql() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.ORACLE_SQL)
    return out
