from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import bars, features
from tapeloom.plans import cli, report
from tapeloom.plans.stages import Market
from tapeloom.sources import synth
from tapeloom.sources.mirror import Manifest, project
from tapeloom.streaming import bars as stream

SF = "/root/testdata/sf0.01"


def test_stages_end_to_end(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("TAPELOOM_HOME", str(tmp_path))
    (tmp_path / "config").mkdir()
    (tmp_path / "config/data.yaml").write_text("tables: [daily_prices, symbols, index_series]\n")
    (tmp_path / "config/model.yaml").write_text("cv: {n_splits: 2, min_train_days: 200}\n")
    (tmp_path / "config/features.yaml").write_text("label: {horizons: [5]}\n")
    (tmp_path / "config/backtest.yaml").write_text("portfolio: {top_n: 5}\n")
    tables = {"daily_prices": synth.daily_prices(spark, SF), "symbols": synth.symbols(spark, SF), "index_series": synth.index_series(spark, SF)}
    monkeypatch.setattr(cli.mirror, "jdbc", lambda *_: tables.__getitem__)
    assert cli.main(["pipeline"], spark) == 0
    assert cli.main(["info"], spark) == 0
    assert cli.main(["train", "--model", "gbt_small"], spark) == 0
    assert cli.main(["backtest", "--model", "gbt_small"], spark) == 0
    assert cli.main(["backtest", "--model", "gbt_small", "--compare"], spark) == 0
    assert cli.main(["backtest", "--model", "gbt"], spark) == 2
    said = capsys.readouterr().out
    assert "28 features" in said and "no_trade" in said and "round trip 0.60 %" in said


def test_report(spark):
    names = ("hl_range", "ret_1", "ret_5")
    joined = Market.synthetic(spark, SF, feature_names=names, horizons=(1, 5)).joined.cache()
    text = report.build(joined, Manifest("2026-07-29T07:19:42", {"x": 5}, [1]), [f"{n}_rank" for n in names], 5, (1, 5), 3, datetime(2026, 1, 1, tzinfo=UTC))
    assert "# Alpha report, 5 sessions" in text and "| hl_range_rank |" in text and "## Suspected leaks" in text
    assert report.table(["a", "b"], [("x", 0.123456), (None, 2)]).splitlines()[2:] == ["| x | 0.1235 |", "|  | 2 |"]


def test_streamed_bars_equal_one_batch(spark, sf_dir, tmp_path):
    prices = project(synth.daily_prices(spark, sf_dir), "daily_prices").cache()
    symbols = synth.symbols(spark, sf_dir)
    folder = str(tmp_path / "in")
    for k, (lo, hi) in enumerate((("2014-01-01", "2015-05-01"), ("2015-05-01", "2015-09-01"), ("2015-09-01", "2030-01-01"))):
        prices.filter(F.col("date").between(lo, hi) & (F.col("date") < hi)).coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        import glob
        import os
        import shutil

        os.makedirs(folder, exist_ok=True)
        shutil.copy(glob.glob(f"{tmp_path}/part{k}/*.parquet")[0], f"{folder}/{k}.parquet")
        stream.classified(stream.prices(spark, folder), symbols, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("ticker", "date", "bar_status")
    want = bars.classify(prices, symbols).select("ticker", "date", "bar_status")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_unknown_model_and_feature_names(spark):
    from tapeloom.operators import model

    with pytest.raises(ValueError, match="unknown model"):
        model.make_model("other")
    assert features.names()[0].endswith("_rank")
