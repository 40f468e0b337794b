"""Registered queries against their SQL twins (the full set: tools/check_oracle.py)."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# one per family; tools/check_oracle.py runs all
NAMES = [
    "regime_hit_rate",
    "moving_averages",
    "ema_weighted",
    "candle_patterns",
    "cross_series_features",
    "asof_higher_trend",
    "filter_funnel",
    "trades_one_at_a_time",
    "risk_metrics",
    "walk_forward_metrics",
    "confusion_auc",
    "stream_bars",
    "kline_pages",
    "scalar_functions",
]


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple("NULL" if r[i] is None else repr(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


def test_every_sql_twin_has_a_query_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
