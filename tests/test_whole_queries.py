"""Queries over all names and features, beside those over a few."""

import threading

import numpy as np
import pytest

from tapeloom.operators import features, model
from tapeloom.plans import queries
from tapeloom.plans.queries import QUERIES


def dates(df):
    return {r["date"] for r in df.select("date").collect()}


def test_gaps_of_the_market(spark, sf_dir):
    days = sorted(dates(QUERIES["calendar_days"](spark, sf_dir)))
    want = [(b, (b - a).days) for a, b in zip(days, days[1:], strict=False) if (b - a).days >= 2]
    assert sorted(map(tuple, QUERIES["calendar_gaps_market"](spark, sf_dir).collect())) == want


def test_benchmark_covers_the_sessions_of_the_back_test(spark, sf_dir):
    rebalanced = dates(QUERIES["bt_topn"](spark, sf_dir))
    covered = dates(QUERIES["bt_benchmark"](spark, sf_dir))
    assert rebalanced and rebalanced <= covered


def test_daily_coefficients_of_all_features_equal_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables have too few names a day
    rows = QUERIES["joined_d_all"](spark, sf_dir).toPandas()
    rows = rows[rows["label_ok_5"].eq(True)]
    got = {(r["date"], r["feature"]): r["ic"] for r in QUERIES["ic_daily_all"](spark, sf_dir).collect()}
    assert {f for _, f in got} == set(features.names()) and len(features.names()) == 28
    for day, group in rows.groupby("date"):
        if len(group) >= 30:
            for f in features.names():
                both = group[[f, "fwd_rank_5"]].astype(float).dropna()
                if len(both) > 1 and both[f].std() > 1e-9 and both["fwd_rank_5"].std() > 1e-9:
                    assert got[day, f] == pytest.approx(np.corrcoef(both[f], both["fwd_rank_5"])[0, 1], abs=1e-5)


def test_correlations_of_all_pairs(spark, sf_dir):
    assert QUERIES["corr_matrix_all"](spark, sf_dir).count() == 28 * 27 // 2


def test_trainings_take_all_features_and_the_production_model(spark, sf_dir, monkeypatch):
    asked = []
    monkeypatch.setattr(queries.model, "walk_forward", lambda data, names, splitter, kind: asked.append((tuple(names), kind)) or type("Run", (), {"oos": data, "summary": lambda self, spark: data})())
    monkeypatch.setattr(queries.model, "leakage_controls", lambda data, names, splitter, kind: asked.append((tuple(names), kind)) or data)
    for name in ("train_gbt_oos_all", "train_gbt_folds_all", "leakage_controls_all"):
        QUERIES[name](spark, sf_dir)
    assert asked == [(tuple(features.names()), "gbt")] * 3


def test_fits_run_side_by_side_and_keep_their_order(spark):
    meet = threading.Barrier(3)
    assert model.at_once(lambda x: (meet.wait(30) >= 0, x), [3, 1, 2]) == [(True, 3), (True, 1), (True, 2)]
