import duckdb
import pytest

import __spark_entry__ as e

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in e.oracle_sql() if not n.startswith("op")]


def test_registered():
    assert len(OWN) >= 60 and set(e.oracle_sql()) <= set(e.queries())


def plain(rows):
    return sorted(repr([round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", ["daily_features", "enriched_features", "monthly_rollup", "warm_streak", "hopping_windows", "bin_assign", "pair_support", "regime_labels", "rf_features", "run_log_state"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    got, want = e.queries()[name](spark, DIR), con.sql(e.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(columns).collect()) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert e.entry(spark).count() > 0
