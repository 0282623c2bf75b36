"""Registered queries against their SQL on the smallest tables, and the stored catalogue against the code."""

import json
import math
from pathlib import Path

import duckdb
import pytest

from barframe.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = [
    "ohlcv_1h", "ohlcv_1d_orders", "resample_1w_monday", "sma_with_nulls", "bb", "linreg", "rci", "mode", "highestbars_lowestbars", "pivot_high_low", "valuewhen", "vwap_anchored_bands", "pivot_levels_camarilla", "dmi", "supertrend", "macd",
    "na_comparisons", "math_scalars", "str_scalars", "color_scalars", "array_reducers", "array_edits", "map_functions", "matrix_basic", "matrix_linear_algebra", "security_htf_off", "security_cross_symbol", "security_injected_close", "security_lower_tf",
    "trade_ledger", "metrics_summary", "portfolio_union_clock", "portfolio_merged_ledger", "broker_backtest", "broker_equity", "bars_stream_vs_batch", "ema_stream_vs_batch", "stream_sessions", "drawing_final_state",
    "sar", "math_random", "script_security_off_columns", "script_security_off_kernel", "script_security_on_columns", "script_security_on_kernel", "script_security_other", "script_lower_tf", "script_dates_columns", "script_dates_kernel", "script_flow", "script_matrix",
    "script_arrays", "script_libraries", "script_libraries_kernel", "script_trades", "script_reads", "script_live", "magnifier_buckets", "clock_names", "array_kinds", "array_lookups", "matrix_small", "script_drawings", "script_outputs", "strategy_report", "portfolio_weights", "portfolio_extremes",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6))
    return x == y


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple((v is not None, str(v) if not isinstance(v, float) else "") for v in row)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    order = [want.columns.index(c) for c in columns]
    b = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
    assert len(a) == len(b) and all(same(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


def test_stored_catalogue_is_current(spark):
    if not catalogue.QUERIES:
        catalogue._build()
    assert json.loads(catalogue.STORED.read_text()) == {n: catalogue.ORACLE_SQL.get(n) for n in catalogue.QUERIES}


def test_queries_without_sql_run(spark):
    rows_only = set(catalogue.queries()) - set(catalogue.oracle_sql())
    for name in sorted(rows_only):
        assert catalogue.queries()[name](spark, SF).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["symbol", "time", "over", "under", "any_cross"]
    assert set(catalogue.queries()) <= set(__spark_entry__.queries()) and set(catalogue.oracle_sql()) <= set(__spark_entry__.oracle_sql())
