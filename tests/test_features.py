import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import features, xsec

SCHEMA = (
    "ticker string, date date, open double, high double, low double, close double, volume long, exchange string, symbol_status string, bar_status string,"
    "prev_close double, ret double, turnover double, adtv double, adtv_obs long, tradeable boolean, in_universe boolean, mkt_ret double"
)
N = 320


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = random.Random(0), []
    market = [rng.gauss(0, 0.01) for _ in range(N)]
    for k in range(4):
        price, before = 20000.0, None
        for i in range(N):
            price = max(1000.0, price * (1 + 0.8 * market[i] + rng.gauss(0, 0.015)))
            volume = rng.randrange(50_000, 500_000)
            ret = None if before is None else price / before - 1
            rows.append((f"T{k}", date(2023, 1, 2) + timedelta(i), price * 0.999, price * 1.01, price * 0.99, price, volume, "HOSE", "active", "normal", before, ret, price * volume, 5e9, 20, True, True, market[i]))
            before = price
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def raw(panel):
    return features.raw(panel).cache()


def test_there_are_28_features_and_names_are_unique():
    assert len(features.all_features()) == 28
    assert {f.name for f in features.by_category("market")} == {"beta_60", "alpha_60", "idio_vol_60", "excess_ret_5", "excess_ret_21", "excess_ret_63"}
    with pytest.raises(ValueError, match="registered"):
        features.register("gap", "price", 1, lambda: F.lit(1.0))


def test_a_feature_can_be_sql(panel):
    features.register("sql_made", "price", 3, "close / open")
    try:
        got = features.raw(panel, ["sql_made"]).filter("sql_made is null").count()
    finally:
        features._REGISTRY.pop("sql_made")
    assert got == 4 * 2


def test_cutting_off_the_future_changes_nothing(panel, raw):
    cut = date(2023, 11, 1)
    names = features.names(ranked=False)
    whole = {(r["ticker"], r["date"]): r for r in raw.filter(F.col("date") < F.lit(cut)).collect()}
    for r in features.raw(panel.filter(F.col("date") < F.lit(cut))).collect():
        other = whole[r["ticker"], r["date"]]
        for n in names:
            assert (r[n] is None) == (other[n] is None) and (r[n] is None or math.isclose(r[n], other[n], rel_tol=1e-9, abs_tol=1e-12)), n


def test_every_feature_has_values_after_its_lookback(raw):
    names = features.names(ranked=False)
    first = raw.agg(*[F.min(F.when(F.col(n).isNotNull(), F.col("session_idx"))).alias(n) for n in names]).first()
    for n in names:
        assert first[n] is not None and first[n] >= features.all_features()[n].lookback, n


def test_coverage_reports_thin_features(raw):
    got = {r["feature"]: r for r in features.coverage(raw).collect()}
    assert got["hl_range"]["pct"] == 100.0 and not got["hl_range"]["thin"]
    assert got["ret_252"]["thin"]


def ranks(spark, null_rank):
    rows = [("a", 1.0, True), ("b", 2.0, True), ("c", None, True), ("d", None, True), ("e", 9.0, False)]
    df = spark.createDataFrame(rows, "ticker string, x double, in_universe boolean").withColumn("date", F.lit("2024-01-01").cast("date"))
    return {r["ticker"]: r["r"] for r in df.select("ticker", xsec.rank("x", null_rank).alias("r")).collect()}


def test_nulls_rank_last_by_default(spark):
    assert ranks(spark, "last") == {"a": 0.0, "b": 1 / 3, "c": 2 / 3, "d": 2 / 3, "e": None}


def test_nulls_can_go_without_rank(spark):
    assert ranks(spark, "null") == {"a": 0.0, "b": 1.0, "c": None, "d": None, "e": None}


def test_zscore_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "ticker string, x double").withColumns({"in_universe": F.lit(True), "date": F.lit("2024-01-01").cast("date")})
    assert [r[0] for r in df.select(xsec.zscore("x")).collect()] == [None, None]


def test_one_shuffle_by_ticker_for_all_raw_features(spark, sf_dir):
    from tapeloom.plans.stages import Market

    plan = Market.synthetic(spark, sf_dir).raw._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1
