import math
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.windows import corr
from tapeloom.operators import alpha, backtest
from tapeloom.operators.cv import PurgedWalkForward

D = date(2020, 1, 1)
DAYS = [d.date() for d in pd.bdate_range("2015-01-01", periods=1200)]


def test_corr_of_a_constant_is_null_and_of_pairs_is_pairwise(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (1.0, 6.0, 2.0), (1.0, None, 3.0), (1.0, 9.0, None)], "c double, x double, y double")
    r = df.select(corr("c", "x"), corr("x", "y")).first()
    assert r[0] is None and r[1] == pytest.approx(1.0)


def joined(spark, days=8, names=40):
    rows = [(f"N{j:02}", D + timedelta(i), j / names, True, (j * 7 % names) / names - 0.3, j / names) for i in range(days) for j in range(names)]
    return spark.createDataFrame(rows, "ticker string, date date, f double, label_ok_5 boolean, fwd_ret_5 double, fwd_rank_5 double")


def test_ic_of_the_answer_is_one_and_small_days_are_left_out(spark):
    d = joined(spark)
    row = alpha.daily_ic(d, ["f"]).agg(F.count(F.lit(1)), F.min("ic")).first()
    assert row[0] == 8 and row[1] == pytest.approx(1.0)
    assert alpha.daily_ic(joined(spark, names=29), ["f"]).count() == 0


def test_spread_of_an_ordered_feature_is_monotonic(spark):
    d = joined(spark).withColumn("fwd_ret_5", F.col("f"))
    got = alpha.spread_summary(alpha.spread(d, "f"), "f").first()
    assert got["monotonic"] and got["spread_pct"] > 0
    none = alpha.spread_summary(alpha.spread(d.limit(0), "f"), "f").first()
    assert none["spread_pct"] is None and not none["monotonic"]


def test_turnover_counts_new_names(spark):
    rows = [("a", D, 1.0), ("b", D, 0.9), ("a", D + timedelta(1), 1.0), ("c", D + timedelta(1), 0.9)]
    d = spark.createDataFrame(rows, "ticker string, date date, f double")
    assert alpha.turnover(d, "f", 0.2, 1).first()["turnover"] == 0.5
    assert alpha.turnover(d, "f", 0.2, 5).first()["turnover"] is None


def test_spearman_averages_tied_ranks(spark):
    rows = [(D, float(i // 2), float(i * i)) for i in range(24)]
    df = spark.createDataFrame(rows, "date date, x double, y double")
    want = pd.Series([r[1] for r in rows]).rank().corr(pd.Series([r[2] for r in rows]).rank())
    assert alpha.daily_spearman(df, "x", "y").first()["ic"] == pytest.approx(want)


@pytest.mark.parametrize("horizon", [1, 5, 21])
def test_folds_are_ordered_disjoint_and_purged(horizon):
    folds = PurgedWalkForward(6, horizon, 5, 750).folds(DAYS)
    at = {d: i for i, d in enumerate(DAYS)}
    assert len(folds) == 6
    for f in folds:
        assert at[f.first] - at[f.train_before] == horizon + 1
        assert f.train_before < f.first <= f.last
    assert all(a.last < b.first and a.train_before < b.train_before for a, b in zip(folds, folds[1:], strict=False))
    assert folds[0].first == DAYS[750] and folds[-1].last == DAYS[-1]


def test_embargo_counts_when_asked_for():
    plain, wide = (PurgedWalkForward(3, 5, 5, 750, apply_embargo=x).folds(DAYS) for x in (False, True))
    assert wide[0].train_before < plain[0].train_before


def test_too_short_a_history_is_refused():
    with pytest.raises(ValueError, match="not enough"):
        PurgedWalkForward(6, 5, 5, 750).folds(DAYS[:50])


def test_costs():
    c = backtest.Costs()
    assert c.round_trip == pytest.approx(0.006) and c.symmetric_fee == pytest.approx(0.002)
    assert c.breakeven_spread(0.5) == pytest.approx(0.003) and c.breakeven_spread(0.5) < c.breakeven_spread(0.9)


def test_cagr():
    assert backtest.cagr(100, 121, 2) == pytest.approx(10)
    assert math.isnan(backtest.cagr(100, 121, 0)) and math.isnan(backtest.cagr(0, 1, 1))


def market(spark, adtv=1e12, days=12):
    rows = [(t, D + timedelta(i), 100.0, 100.0, adtv if t != "A" else min(adtv, 1e8), True) for t in "ABC" for i in range(days)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, open double, adtv double, tradeable boolean")


def weights(spark, preds, hold="carry", adtv=1e12, top=2):
    panel = market(spark, adtv)
    days = backtest.sessions(panel, preds)
    chosen = backtest.picks(preds, days, top, 5)
    rows = backtest.weights(backtest.sized(chosen, panel, 1e9, 0.1), days, hold, lag=0)
    return {(r["date"], r["ticker"]): r["weight"] for r in rows.collect()}


def constant(spark):
    return spark.createDataFrame([(D + timedelta(i), t, float(ord(t))) for i in range(12) for t in "ABC"], "date date, ticker string, pred double")


def test_top_names_are_equal_and_held(spark):
    w = weights(spark, constant(spark))
    assert set(w.values()) == {0.5} and {t for _, t in w} == {"B", "C"} and len(w) == 24


def test_capacity_caps_a_weight(spark):
    assert weights(spark, constant(spark), adtv=1e8)[D, "C"] == pytest.approx(0.01)


def test_names_no_longer_picked(spark):
    late = [(D + timedelta(i), t, float(i < 5) if t == "A" else 0.5) for i in range(12) for t in "AB"]
    preds = spark.createDataFrame(late, "date date, ticker string, pred double")
    kept, sold = (weights(spark, preds, hold, top=1) for hold in ("carry", "rebalance"))
    assert (D + timedelta(7), "A") in kept and (D + timedelta(7), "A") not in sold
    assert (D + timedelta(7), "B") in kept and (D + timedelta(7), "B") in sold


def test_simulation_pays_costs_and_skips_untradeable_days(spark):
    panel = market(spark).withColumn("tradeable", F.col("date") != F.lit(D))
    rows = spark.createDataFrame([(D + timedelta(i), "B", 1.0) for i in range(12)], "date date, ticker string, weight double")
    curve = backtest.simulate(panel, rows)
    one = {(r["scenario"], r["date"]): r for r in curve.collect()}
    assert one["tradeable", D]["trades"] == 0 and one["tradeable", D]["equity"] == 1e9
    bought = one["any", D]
    assert bought["trades"] == 1 and bought["equity"] == pytest.approx(1e9 / 1.001 / 1.002)
    s = {r["scenario"]: r for r in backtest.stats(curve).collect()}
    assert s["any"]["total_return_pct"] == pytest.approx(0.0, abs=1e-6) and s["tradeable"]["total_return_pct"] < 0
    assert backtest.compare(curve).first()["phantom_pp"] > 0
