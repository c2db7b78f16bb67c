"""How well features order the names of a day: information coefficients, spreads, turnover."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import corr

LEAST_NAMES = 30


def join_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Universe rows of features with their labels; both sides come partitioned by ticker."""
    return features.filter("in_universe").join(labels.drop("in_universe", "adtv", "close"), ["ticker", "date"])


def daily_ic(joined: DataFrame, features: Iterable[str], horizons: Iterable[int] = (5,)) -> DataFrame:
    """(date, feature, horizon, n, ic) for days with enough labelled names.

    Features go long before one aggregation by (date, feature), which is summed up within
    tasks first; all horizons share the pass.
    """
    spans = list(horizons)
    kept = [*(f"label_ok_{h}" for h in spans), *(f"fwd_rank_{h}" for h in spans)]
    long = joined.select("date", *kept, *features).unpivot(["date", *kept], list(features), "feature", "value")
    each: list[Column] = []
    for h in spans:
        ok = F.col(f"label_ok_{h}")
        each.append(F.struct(F.lit(h).alias("horizon"), F.count_if(ok).alias("n"), corr(F.when(ok, F.col("value")), F.when(ok, F.col(f"fwd_rank_{h}"))).alias("ic")))
    rows = long.groupBy("date", "feature").agg(F.array(*each).alias("by")).select("date", "feature", F.inline("by"))
    return rows.filter(F.col("n") >= LEAST_NAMES)


def summarize(daily: DataFrame) -> DataFrame:
    """Per feature and horizon: days, mean_ic, sd_ic, ir, t_stat, hit_rate."""
    known = daily.filter("ic is not null")
    rows = known.groupBy("feature", "horizon").agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("ic").alias("mean_ic"),
        F.stddev_samp("ic").alias("sd_ic"),
        F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )
    rows = rows.withColumn("ir", F.try_divide("mean_ic", "sd_ic"))
    return rows.withColumn("t_stat", F.col("ir") * F.sqrt("days"))


def ic_table(joined: DataFrame, features: Iterable[str], horizon: int = 5) -> DataFrame:
    rows = summarize(daily_ic(joined, features, [horizon])).drop("horizon")
    return rows.orderBy(F.desc(F.abs("mean_ic")), "feature")


def ic_decay(joined: DataFrame, features: Iterable[str], horizons: Iterable[int]) -> DataFrame:
    """One row per feature with ic_h and ir_h for each horizon."""
    spans = list(horizons)
    rows = summarize(daily_ic(joined, features, spans))
    one = lambda h, c: F.max(F.when(F.col("horizon") == h, F.col(c)))
    return rows.groupBy("feature").agg(*[one(h, c).alias(f"{n}_{h}") for h in spans for c, n in (("mean_ic", "ic"), ("ir", "ir"))])


def _day_correlations(values: np.ndarray) -> np.ndarray:
    """Pearson correlations of columns, each over the rows where both are known; NaN where
    there are none, or either side is constant there."""
    known = ~np.isnan(values)
    x = np.where(known, values, 0.0)
    x = np.where(known, x - x.sum(axis=0) / np.maximum(known.sum(axis=0), 1), 0.0)  # far from 0, sums of squares lose digits
    m = known.astype(float)
    n, s, q = m.T @ m, x.T @ m, (x * x).T @ m  # of each pair: rows, and sums over the first's values
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = q - s * s / n
        least = 1e-20 * n * np.square(np.abs(np.where(known, values, 0.0)).max(axis=0, initial=0.0))[:, None]
        spread = np.where(spread > least, spread, np.nan)
        return (x.T @ x - s * s.T / n) / np.sqrt(spread * spread.T)


def correlations(joined: DataFrame, features: Iterable[str]) -> DataFrame:
    """(a, b, corr): mean over days of the correlation across names, for pairs a < b.

    One pass and one shuffle, by date: all pairs of a day come from one matrix of its names,
    some thousand rows whatever the span; days are then averaged, summed up in tasks first.
    """
    names = sorted(features)
    pairs = list(combinations(range(len(names)), 2))

    def day(table: pa.Table) -> pa.Table:
        values = np.column_stack([table.column(c).to_numpy().astype(float) for c in names])
        found = _day_correlations(values)
        corr_ = [found[i, j] for i, j in pairs]
        return pa.table({"a": [names[i] for i, _ in pairs], "b": [names[j] for _, j in pairs], "corr": pa.array(corr_, pa.float64(), from_pandas=True)})

    rows = joined.select("date", *[F.col(c).cast("double").alias(c) for c in names])
    return rows.groupBy("date").applyInArrow(day, "a string, b string, corr double").groupBy("a", "b").agg(F.avg("corr").alias("corr"))


def spread(joined: DataFrame, feature: str, horizon: int = 5, buckets: int = 5) -> DataFrame:
    """Per bucket of the feature: days, mean forward return and its deviation, in percent.

    One shuffle by date serves the day's size and the buckets; the ticker breaks ties.
    """
    rows = joined.filter(F.col(f"label_ok_{horizon}") & F.col(feature).isNotNull()).select("date", "ticker", F.col(feature).alias("f"), F.col(f"fwd_ret_{horizon}").alias("r"))
    day = Window.partitionBy("date")
    rows = rows.withColumns({"names": F.count(F.lit(1)).over(day), "bucket": F.ntile(buckets).over(day.orderBy("f", "ticker"))})
    daily = rows.filter(F.col("names") >= LEAST_NAMES).groupBy("date", "bucket").agg(F.avg("r").alias("r"))
    return daily.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("days"), (100 * F.avg("r")).alias("mean_fwd_pct"), (100 * F.stddev_samp("r")).alias("sd_pct")
    )


def spread_summary(buckets: DataFrame, feature: str) -> DataFrame:
    """Top less bottom bucket, and whether the buckets' means go one way all along."""
    step = F.col("mean_fwd_pct") - F.lag("mean_fwd_pct").over(Window.partitionBy(F.lit(0)).orderBy("bucket"))
    rows = buckets.select("bucket", "mean_fwd_pct", step.alias("step"))
    top, bottom = F.max_by("mean_fwd_pct", "bucket"), F.min_by("mean_fwd_pct", "bucket")
    one_way = (F.coalesce(F.min("step") >= 0, F.lit(True)) | F.coalesce(F.max("step") <= 0, F.lit(True))) & (F.count(F.lit(1)) > 0)
    return rows.agg((top - bottom).alias("spread_pct"), one_way.alias("monotonic"), top.alias("top_pct"), bottom.alias("bottom_pct")).withColumn("feature", F.lit(feature))


def turnover(joined: DataFrame, feature: str, top_frac: float = 0.2, step: int = 5) -> DataFrame:
    """Mean share of names at the top that were not there ``step`` sessions before.

    The sessions, one row each, are numbered in one task and sent to all executors.
    """
    held = joined.filter(F.col(feature) >= 1 - top_frac).select("date", "ticker")
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1
    days = held.select("date").distinct().withColumn("turn", turn).filter(F.col("turn") % step == 0)
    now = held.join(F.broadcast(days.select("date", F.expr(f"turn div {step}").alias("k"))), "date").select("k", "ticker")
    before = now.select((F.col("k") + 1).alias("k"), "ticker", F.lit(1).alias("stayed"))
    share = now.filter("k > 0").join(before, ["k", "ticker"], "left").groupBy("k").agg((1 - F.count("stayed") / F.count(F.lit(1))).alias("new"))
    return share.agg(F.avg("new").alias("turnover")).withColumn("feature", F.lit(feature))


def daily_spearman(rows: DataFrame, x: str, y: str, least: int = 20) -> DataFrame:
    """(date, n, ic): rank correlation with tied ranks averaged; days of few rows left out."""
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def average_rank(name: str) -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy("date", name))
        return F.rank().over(Window.partitionBy("date").orderBy(name)) + (ties - 1) / 2

    ranks = known.select("date", average_rank(x).alias("rx"), average_rank(y).alias("ry"))
    return ranks.groupBy("date").agg(F.count(F.lit(1)).alias("n"), corr("rx", "ry").alias("ic")).filter(F.col("n") >= least)
