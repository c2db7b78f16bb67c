"""Command line: ``python -m tapeloom STAGE``; each stage reads what the ones before wrote."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alpha, backtest, bars, features, labels, model, panel
from ..operators.cv import PurgedWalkForward
from ..sources import config, mirror
from . import report

STAGES = ("mirror", "clean", "panel", "label", "features")


class Project:
    """Stage tables under the project folder."""

    def __init__(self, spark: SparkSession, say=print):
        self.spark, self.say = spark, say
        self.data = config.load("data")
        self.snapshot = str(config.path(self.data["mirror_dir"]))

    def _path(self, name: str) -> str:
        return str(config.path(f"data/{name}.parquet"))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self._path(name))
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        if not config.path(f"data/{name}.parquet").exists():
            raise FileNotFoundError(f"{self._path(name)} is missing: run its stage first")
        return self.spark.read.parquet(self._path(name))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.snapshot}/{name}.parquet")

    def mirror(self, read=None) -> None:
        made = mirror.mirror(self.spark, read or mirror.jdbc(self.spark, config.dsn()), self.data["tables"], self.snapshot)
        made.check_single_epoch()
        self.say(f"{made.id}: {sum(made.row_counts.values()):,} rows")

    def clean(self) -> None:
        rows = self.save(bars.classify(self.table("daily_prices"), self.table("symbols")), "bars")
        for r in bars.status_shares(rows).orderBy("n", ascending=False).collect():
            self.say(f"{r['bar_status']:<14}{r['n']:>12,}{r['pct']:>8.2f} %")

    def panel(self) -> None:
        u = config.load("features")["universe"]
        market = panel.market_returns(self.table("index_series"), self.data["index_code"])
        rows = self.save(panel.build(self.load("bars"), market, u["adtv_window"], u["adtv_min"], u["require_full_window"]), "panel")
        self.say(panel.summary(rows).first().asDict())

    def label(self) -> None:
        c = config.load("features")["label"]
        rows = self.save(labels.build(self.load("panel"), c["horizons"], c["horizon"], c["entry_price"]), "labels")
        for r in labels.stats(rows, c["horizons"]).orderBy("horizon").collect():
            self.say(f"h={r['horizon']:<3} labelled {r['n_labelled']:,}/{r['n_universe']:,}  mean {r['mean_pct']} %  sd {r['sd_pct']} %")

    def features(self) -> None:
        rows = self.save(features.build(self.load("panel")), "features")
        thin = [r["feature"] for r in features.coverage(rows).filter("thin").collect()]
        self.say(f"{len(features.names(False))} features, thin: {', '.join(thin) or 'none'}")

    def joined(self) -> DataFrame:
        return alpha.join_labels(self.load("features"), self.load("labels"))

    def alpha(self, horizon: int, top: int) -> str:
        made = mirror.load_manifest(self.spark, self.snapshot)
        text = report.build(self.joined().persist(), made, features.names(), horizon, tuple(config.load("features")["label"]["horizons"]), top)
        out = config.path(f"reports/alpha-{made.id}-h{horizon}.md")
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_text(text)
        return str(out)

    def train(self, name: str, controls: bool) -> None:
        settings, horizon = config.load("model"), config.load("features")["label"]["horizon"]
        splitter = PurgedWalkForward(horizon=horizon, **settings["cv"])
        data = model.matrix(self.joined(), features.names(), horizon, settings["dataset"]["start_date"])
        if controls:
            model.leakage_controls(data, features.names(), splitter, name).show(truncate=False)
            return
        run = model.walk_forward(data, features.names(), splitter, name)
        self.save(run.oos, f"oos_{name}")
        run.summary(self.spark).show()
        for feature, weight in run.importance[:15]:
            self.say(f"{feature:<28}{weight:8.4f}")

    def backtest(self, name: str, compare: bool) -> None:
        c = config.load("backtest")
        p, costs = c["portfolio"], backtest.Costs(**c["costs"])
        rules = backtest.Settings(p["top_n"], p["rebalance_every"], float(p["init_cash"]), p["max_adtv_frac"])
        preds, rows = self.load(f"oos_{name}").select("date", "ticker", "pred"), self.load("panel")
        days = backtest.sessions(rows, preds)
        sized = backtest.sized(backtest.picks(preds, days, rules.top_n, rules.every), rows, rules.init_cash, rules.max_adtv_frac)
        curve = backtest.simulate(rows, backtest.weights(sized, days, rules.hold), rules, costs).persist()
        (backtest.compare(curve) if compare else backtest.stats(curve).filter("scenario = 'tradeable'")).show(truncate=False)
        known = backtest.against_index(curve, backtest.benchmark(self.table("index_series"), c["benchmark"], days))
        for r in known.orderBy(F.desc("name")).collect():
            growth = "unknown" if r["cagr_pct"] is None else f"{r['cagr_pct']:.2f} %"
            self.say(f"{c['benchmark'] if r['name'] == 'index' else 'strategy':<12} total {r['total_return_pct']:.2f} %  a year {growth}")
        self.say(f"round trip {100 * costs.round_trip:.2f} %")

    def info(self) -> None:
        made = mirror.load_manifest(self.spark, self.snapshot)
        self.say(f"{made.id}, epochs {made.adjustment_epochs}")
        for name, n in sorted(made.row_counts.items()):
            self.say(f"{name:<20}{n:>12,}")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tapeloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in (*STAGES, "pipeline", "info"):
        commands.add_parser(name)
    one = commands.add_parser("alpha")
    one.add_argument("--horizon", type=int, default=5)
    one.add_argument("--top", type=int, default=10)
    one = commands.add_parser("train")
    one.add_argument("--model", default="gbt", choices=sorted({**model.MODELS, **model.LIBRARIES}))
    one.add_argument("--controls", action="store_true")
    one = commands.add_parser("backtest")
    one.add_argument("--model", default="gbt", choices=sorted({**model.MODELS, **model.LIBRARIES}))
    one.add_argument("--compare", action="store_true")
    args = parser.parse_args(argv)
    project = Project(spark or SparkSession.builder.appName("tapeloom").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    try:
        if args.command == "pipeline":
            for name in STAGES:
                getattr(project, name)()
        elif args.command == "alpha":
            print(project.alpha(args.horizon, args.top))
        elif args.command == "train":
            project.train(args.model, args.controls)
        elif args.command == "backtest":
            project.backtest(args.model, args.compare)
        else:
            getattr(project, args.command)()
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    return 0
