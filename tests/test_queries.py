"""All registered queries against their SQL counterparts on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, (bool, str)):
        return repr(v)
    return repr(float(v))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_corrected_p_differs_only_in_p(spark):
    by = lambda name: {(r.alert_id, r.feature_name): r for r in entry.queries()[name](spark, SF).collect()}
    a, b = by("feature_drift"), by("feature_drift_corrected")
    assert a.keys() == b.keys()
    assert all(a[k].ks_stat == b[k].ks_stat and math.isclose(a[k].p_value, b[k].p_value, abs_tol=.05) for k in a)


def test_entry(spark, duck):
    alerts = duck.execute("select count(distinct c_mktsegment) from events join customer on user_id = c_custkey "
                          "where event_type <> 'purchase'").fetchone()[0]
    assert entry.entry(spark).count() == alerts > 1
