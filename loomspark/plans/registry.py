"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from loomspark.plans import code, extra, graphs, history, logs, more, retrieval, review, spans, surface

MODULES: tuple = (retrieval, logs, graphs, review, more, extra, code, spans, surface, history)


def queries() -> dict:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
