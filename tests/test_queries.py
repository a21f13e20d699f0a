"""Every registered query that SQL can express gives the rows of its SQL; here on the smallest tables."""

import math

import duckdb
import pytest

import valuegate.plans  # noqa: F401
from valuegate.plans.registry import ORACLE, QUERIES, TABLES

CHOSEN = sorted(ORACLE)


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = con.execute(ORACLE[name])
    theirs_names = [d[0] for d in cursor.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_every_query_without_sql_has_a_brute_force_test():
    assert set(QUERIES) - set(ORACLE) == {"search_fuzzy", "value_search", "nearest_examples", "entity_resolution", "missed_values", "understand_batch"}
