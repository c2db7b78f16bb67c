"""Bars, panel and labels on hand-made rows."""

from datetime import date, timedelta

import pytest

from tapeloom.operators import bars, labels, panel

BAR = "ticker string, date date, open double, high double, low double, close double, volume long, adjustment_epoch long"
D = date(2024, 1, 1)


def bar(day, close, volume=100, high=None, low=None, ticker="T"):
    return (ticker, D + timedelta(day), close, high or close, low or close, close, volume, 1)


def statuses(spark, rows, exchange="HOSE"):
    prices = spark.createDataFrame(rows, BAR)
    symbols = spark.createDataFrame([("T", exchange, "active")], "ticker string, exchange string, status string")
    return [r["bar_status"] for r in bars.classify(prices, symbols).orderBy("date").collect()]


@pytest.mark.parametrize(
    ("second", "status"),
    [
        (bar(1, 60000.0), "normal"),
        (bar(1, 60000.0, volume=0), "no_trade"),
        (bar(1, 60000.0, volume=None), "no_trade"),
        (bar(1, 60000.0, high=59000.0), "suspect_ohlc"),
        (bar(1, 60000.0, low=61000.0), "suspect_ohlc"),
        (bar(6, 60000.0), "unknown"),
        (bar(1, 90000.0), "suspect_move"),
        (bar(1, 64200.0), "limit_up"),
        (bar(1, 55800.0), "limit_down"),
        (bar(1, 66000.0), "band_anomaly"),
        (bar(6, 60000.0, volume=0), "no_trade"),  # the first reason that holds
        (bar(1, 90000.0, high=59000.0), "suspect_ohlc"),
        (bar(6, 90000.0), "unknown"),
    ],
)
def test_each_status(spark, second, status):
    assert statuses(spark, [bar(0, 60000.0), second]) == ["unknown", status]


def test_low_reference_is_unknown(spark):
    assert statuses(spark, [bar(0, 900.0), bar(1, 950.0)])[1] == "unknown"


def test_unlisted_ticker_has_the_default_band(spark):
    prices = spark.createDataFrame([bar(0, 60000.0, ticker="X"), bar(1, 69000.0, ticker="X")], BAR)
    none = spark.createDataFrame([], "ticker string, exchange string, status string")
    assert [r["bar_status"] for r in bars.classify(prices, none).orderBy("date").collect()][1] == "limit_up"


def test_empty_bars(spark):
    assert statuses(spark, []) == []


def test_trading_days_and_gaps(spark):
    calendar = spark.createDataFrame([(D, True), (D + timedelta(1), False)], "date date, is_trading_day boolean")
    index = spark.createDataFrame([("I", D + timedelta(2)), ("J", D + timedelta(3))], "index_code string, date date")
    prices = spark.createDataFrame([(D + timedelta(9),)], "date date")
    days = bars.trading_days(calendar, index, prices, "I")
    assert sorted(r["date"] for r in days.collect()) == [D, D + timedelta(2), D + timedelta(9)]
    assert [tuple(r) for r in bars.session_gaps(days, 5).collect()] == [(D + timedelta(9), 7)]


def test_universe_needs_a_full_window(spark):
    rows = [bar(i, 60000.0, volume=100_000) for i in range(25)]
    prices = spark.createDataFrame(rows, BAR)
    symbols = spark.createDataFrame([("T", "HOSE", "active")], "ticker string, exchange string, status string")
    index = spark.createDataFrame([("I", D, 100.0), ("I", D + timedelta(1), 110.0)], "index_code string, date date, close double")
    out = panel.build(bars.classify(prices, symbols), panel.market_returns(index, "I")).orderBy("date").collect()
    assert [r["in_universe"] for r in out] == [False] * 19 + [True] * 6
    assert out[1]["mkt_ret"] == pytest.approx(0.1) and out[2]["mkt_ret"] is None
    loose = panel.build(bars.classify(prices, symbols), panel.market_returns(index, "I"), full_window=False)
    assert loose.filter("in_universe").count() == 25


PANEL = "ticker string, date date, open double, close double, in_universe boolean, tradeable boolean, bar_status string, adtv double"


def panel_of(spark, changes=(), tickers=(("AAA", 100.0),), days=10):
    rows = []
    for ticker, step in tickers:
        for i in range(days):
            row = {"ticker": ticker, "date": date(2026, 1, 5) + timedelta(i), "open": 10000.0 + step * i, "close": 10000.0 + step * i, "in_universe": True, "tradeable": True, "bar_status": "normal", "adtv": 5e9}
            rows.append(row | dict(changes).get(i, {}))
    return spark.createDataFrame([tuple(r.values()) for r in rows], PANEL)


def first_label(spark, changes=(), h=2, **more):
    return labels.build(panel_of(spark, changes, **more), (h,), h).orderBy("date").first()


def test_entry_is_the_next_open_and_exit_h_later(spark):
    r = first_label(spark)
    assert (r["entry_px"], r["exit_px_2"], r["fwd_ret_2"]) == (10100, 10300, 10300 / 10100 - 1)
    assert r["fwd_ret"] == r["fwd_ret_2"] and r["label_ok"]


def test_untradeable_entry_is_dropped(spark):
    r = first_label(spark, {1: {"tradeable": False, "bar_status": "limit_up"}})
    assert not r["label_ok_2"] and r["fwd_ret_2"] is None


def test_untradeable_exit_is_kept(spark):
    r = first_label(spark, {3: {"tradeable": False}})
    assert r["label_ok_2"] and not r["exit_tradeable_2"]


def test_long_suspension_is_dropped(spark):
    later = {i: {"date": date(2026, 6, i)} for i in (1, 2, 3)}
    assert not first_label(spark, later, days=4)["label_ok_2"]


def test_rank_within_the_day(spark):
    rows = labels.build(panel_of(spark, tickers=(("UP", 500.0), ("DN", -300.0)), days=6), (2,), 2)
    day = {r["ticker"]: r["fwd_rank_2"] for r in rows.filter("date = date'2026-01-05'").collect()}
    assert day == {"UP": 1.0, "DN": 0.0}


def test_the_last_sessions_have_no_label(spark):
    rows = labels.build(panel_of(spark), (2,), 2).orderBy("date").collect()
    assert [r["fwd_ret"] is None for r in rows] == [False] * 7 + [True] * 3
