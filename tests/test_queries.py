"""Every registered query outside the corpus operators against DuckDB at the smallest scale, and what the registry promises."""

from collections import Counter

import duckdb
import pytest

from loomspark.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return Counter(repr(tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = con.sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(got.columns)
    assert plain(df.collect(), df.columns, order) == plain(got.fetchall(), got.columns, order)


def test_queries_read_their_tables():
    assert len(registry.queries()) > 50 and set(registry.oracle_sql()) <= set(registry.queries())


def test_layers_has_no_window_over_all_rows(spark):
    from loomspark.plans.more import layers
    from tests.conftest import SF

    assert "Window" not in layers(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
