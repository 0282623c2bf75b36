"""Finer bars of chart bars: the envelope, the cap, broken rows, and a broker that fills on them."""

import pandas as pd
import pytest

from barframe.operators import broker as B
from barframe.operators import magnifier as M

COLUMNS = "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume double"


def table(spark, rows):
    return spark.createDataFrame([("s", pd.Timestamp(t).to_pydatetime(), o, h, lo, c, 1.0) for t, o, h, lo, c in rows], COLUMNS)


CHART = [("2024-01-01 00:00", 10.0, 14.0, 8.0, 9.0), ("2024-01-01 01:00", 9.0, 12.0, 9.0, 12.0), ("2024-01-01 04:00", 12.0, 13.0, 11.0, 11.0)]
FINE = [("2023-12-31 23:50", 1.0, 1.0, 1.0, 1.0), ("2024-01-01 00:00", 10.0, 11.0, 8.0, 8.0), ("2024-01-01 00:30", 8.0, 14.0, 8.0, 9.0), ("2024-01-01 01:50", 9.0, 12.0, 9.0, 12.0), ("2024-01-01 02:10", 5.0, 5.0, 5.0, 5.0), ("2024-01-01 05:10", 7.0, 7.0, 7.0, 7.0)]


def test_timeframes():
    want = {"1T": "1T", "500T": "10T", "1000T": "100T", "10S": "1S", "30S": "5S", "1": "10S", "5": "30S", "10": "1", "15": "2", "30": "5", "60": "10", "240": "30", "1D": "60", "3D": "240", "1W": "1D", "6M": "1D"}
    assert {tf: M.magnifier_timeframe(tf) for tf in want} == want


def test_envelope_and_cap(spark):
    chart, fine = table(spark, CHART), table(spark, FINE)
    for cap, want in ((M.CAP, ["available", "available", "none"]), (3, ["available", "available", "none"]), (2, ["cap", "available", "none"]), (1, ["cap", "available", "none"]), (0, ["cap", "cap", "none"])):
        got = M.magnified(chart, fine, "60", cap=cap).orderBy("time").collect()
        assert [r["coverage"] for r in got] == want and [len(r["lower"]) for r in got] == [2 * (want[0] == "available"), int(want[1] == "available"), 0]
    with pytest.raises(ValueError):
        M.magnified(chart, fine, "60", "5")


@pytest.mark.parametrize("row", [("2024-01-01 00:40", 9.0, 8.0, 7.0, 8.0), ("2024-01-01 00:40", 9.0, float("nan"), 7.0, 8.0), ("2024-01-01 00:30", 9.0, 9.0, 9.0, 9.0)])
def test_broken_rows(spark, row):
    with pytest.raises(Exception, match="broken or there twice"):
        M.magnified(table(spark, CHART), table(spark, [*FINE, row]), "60").collect()


def test_fills_follow_the_finer_bars(spark):
    """The chart bar alone would reach the goal first; inside it the stop comes first."""

    def program():
        def on_bar(account, bar):
            account.entry("long", 1, when=bar.index == 0)
            account.exit("out", limit=13.5, stop=8.5)

        return on_bar

    rows = [("2023-12-31 23:00", 10.0, 10.0, 10.0, 10.0), ("2024-01-01 00:00", 10.0, 14.0, 8.0, 13.0)]
    fine = [("2024-01-01 00:00", 10.0, 11.0, 8.0, 8.0), ("2024-01-01 00:30", 8.0, 14.0, 8.0, 13.0)]
    plain = B.backtest(table(spark, rows), program).collect()
    inner = B.backtest(M.magnified(table(spark, rows), table(spark, fine), "60"), program).collect()
    assert [t["exit_price"] for t in inner] == [8.5] and plain[0]["exit_price"] in (8.5, 13.5)
