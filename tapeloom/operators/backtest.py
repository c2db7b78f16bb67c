"""From predictions to an equity curve: picks, weights, costs, simulation, statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Costs:
    """Rates of one side's brokerage, the tax on sales, and slippage."""

    brokerage: float = 0.0015
    sell_tax: float = 0.0010
    slippage: float = 0.0010

    @property
    def symmetric_fee(self) -> float:
        """The fee of a side, half of the sales tax each way."""
        return self.brokerage + self.sell_tax / 2

    @property
    def round_trip(self) -> float:
        return 2 * (self.symmetric_fee + self.slippage)

    def breakeven_spread(self, turnover: float) -> float:
        """What a period must earn to pay for replacing such a share."""
        return turnover * self.round_trip


@dataclass(frozen=True)
class Settings:
    """Portfolio rules; ``hold`` is "carry" (a name keeps its weight until it is picked
    anew, as in the published results) or "rebalance" (names not picked are sold)."""

    top_n: int = 30
    every: int = 5
    init_cash: float = 1e9
    max_adtv_frac: float = 0.10
    hold: str = "carry"
    periods_per_year: int = 252


def sessions(panel: DataFrame, preds: DataFrame) -> DataFrame:
    """(date, idx): sessions of the predicted names from the first prediction to the last.

    One row a session: numbered in one task and small enough to send to all.
    """
    span = preds.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    rows = panel.join(preds.select("ticker").distinct(), "ticker", "left_semi").filter(F.col("date").between(F.lit(span["lo"]), F.lit(span["hi"])))
    order = Window.partitionBy(F.lit(0)).orderBy("date")
    return rows.select("date").distinct().withColumn("idx", (F.row_number().over(order) - 1).cast("long"))


def picks(preds: DataFrame, days: DataFrame, top_n: int, every: int) -> DataFrame:
    """(date, idx, ticker, k): the best ``top_n`` names of each rebalancing session.

    Ties go to the first ticker; k is how many names the session picks.
    """
    turn = F.broadcast(days.filter(F.col("idx") % every == 0))
    day = Window.partitionBy("date")
    ranked = preds.join(turn, "date").withColumn("rn", F.row_number().over(day.orderBy(F.desc("pred"), "ticker"))).filter(F.col("rn") <= top_n)
    return ranked.select("date", "idx", "ticker", F.count(F.lit(1)).over(day).alias("k"))


def sized(chosen: DataFrame, panel: DataFrame, init_cash: float, max_adtv_frac: float) -> DataFrame:
    """Picks with weight: equal, but no more than a share of the name's daily turnover."""
    rows = chosen.join(panel.select("ticker", "date", "adtv"), ["ticker", "date"], "left")
    cap = F.coalesce(max_adtv_frac * F.col("adtv") / init_cash, F.lit(0.0))
    return rows.select("date", "idx", "ticker", F.least(1.0 / F.col("k"), cap).alias("weight"))


def weights(sized_picks: DataFrame, days: DataFrame, hold: str = "carry", lag: int = 1) -> DataFrame:
    """(date, ticker, weight) for every session a name is held, ``lag`` sessions after the signal.

    A pick is stretched over session numbers up to the one that ends it, so only rows with
    a weight are made and no grid of dates and names. A pick of weight 0 counts as none.
    """
    n = F.broadcast(days.agg(F.count(F.lit(1)).alias("n")))
    if hold == "carry":
        real = sized_picks.filter("weight > 0")
        ends = F.lead("idx").over(Window.partitionBy("ticker").orderBy("idx"))
        held = real.withColumn("until", ends)
    else:
        turns = sized_picks.select("idx").distinct()
        ended = turns.withColumn("until", F.lead("idx").over(Window.partitionBy(F.lit(0)).orderBy("idx")))
        held = sized_picks.filter("weight > 0").join(F.broadcast(ended), "idx")
    held = held.crossJoin(n).withColumn("until", F.coalesce("until", "n"))
    rows = held.select("ticker", "weight", F.explode(F.sequence("idx", F.col("until") - 1)).alias("at")).withColumn("idx", F.col("at") + lag)
    return rows.join(F.broadcast(days), "idx").select("date", "ticker", "weight")


def benchmark(index: DataFrame, code: str, days: DataFrame) -> DataFrame:
    """(date, value): the index on each session, carried on where it has no value."""
    rows = days.join(index.filter(F.col("index_code") == code).select("date", "close"), "date", "left")
    order = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("date", F.last("close", ignorenulls=True).over(order).alias("value"))


def _simulate(prices: pd.DataFrame, held: pd.DataFrame, settings: Settings, costs: Costs) -> pd.DataFrame:
    """Trade to target weights each session at the execution price, sales before purchases.

    Shares are fractional; sizes are set on the value before trading, with shares valued
    at the execution price where there is one; a purchase that cash does not cover is cut.
    """
    close = prices.pivot(index="date", columns="ticker", values="close").ffill()
    price = prices.pivot(index="date", columns="ticker", values="price").reindex_like(close)
    target = held.pivot(index="date", columns="ticker", values="weight").reindex(index=close.index, columns=close.columns).fillna(0.0)
    c, p, w = close.to_numpy(), price.to_numpy(float), target.to_numpy()
    shares, cash, rows = np.zeros(c.shape[1]), settings.init_cash, []
    fee, slip = costs.symmetric_fee, costs.slippage
    for t in range(len(c)):
        fills = np.isfinite(p[t])
        worth = np.where(fills, p[t], np.nan_to_num(c[t]))
        equity = cash + float(shares @ worth)
        delta = np.where(fills, w[t] * equity / np.where(fills & (p[t] > 0), p[t], np.inf) - shares, 0.0)
        trades = 0
        sells = np.flatnonzero(delta < -1e-9)
        for i in sells:
            cash += -delta[i] * p[t, i] * (1 - slip) * (1 - fee)
            shares[i] += delta[i]
        for i in np.flatnonzero(delta > 1e-9):
            unit = p[t, i] * (1 + slip) * (1 + fee)
            n = min(delta[i], max(cash, 0.0) / unit)
            if n > 1e-9:
                cash -= n * unit
                shares[i] += n
                trades += 1
        rows.append((close.index[t], cash + float(shares @ np.nan_to_num(c[t])), cash, trades + len(sells)))
    return pd.DataFrame(rows, columns=["date", "equity", "cash", "trades"])


def simulate(panel: DataFrame, weight_rows: DataFrame, settings: Settings = Settings(), costs: Costs = Costs()) -> DataFrame:
    """Equity by session for each scenario: "tradeable" fills only, and "any" fills.

    Each session depends on the one before, so a scenario runs in one task; it holds the
    prices of the names ever picked.
    """
    names = weight_rows.select("ticker").distinct()
    span = weight_rows.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    rows = panel.join(names, "ticker", "left_semi").crossJoin(F.broadcast(span)).filter("date between lo and hi")
    rows = rows.join(weight_rows, ["ticker", "date"], "left").select("ticker", "date", "close", "open", "tradeable", "weight")
    kinds = F.explode(F.array(F.struct(F.lit("tradeable").alias("scenario"), F.lit(False).alias("any")), F.struct(F.lit("any").alias("scenario"), F.lit(True).alias("any"))))
    both = rows.withColumn("s", kinds).select("s.scenario", "ticker", "date", "close", F.when(F.col("s.any") | F.col("tradeable"), F.col("open")).alias("price"), "weight")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _simulate(pdf, pdf[pdf["weight"].notna()], settings, costs)
        out.insert(0, "scenario", pdf["scenario"].iloc[0])
        return out

    return both.groupBy("scenario").applyInPandas(run, "scenario string, date date, equity double, cash double, trades long")


def cagr(first: float, last: float, years: float) -> float:
    if years <= 0 or first <= 0:
        return math.nan
    return 100 * ((last / first) ** (1 / years) - 1)


def stats(equity: DataFrame, periods_per_year: int = 252) -> DataFrame:
    """Per scenario: span, total return, growth, drawdown, Sharpe, Sortino, win rate, trades.

    A window over one scenario's sessions; ``periods_per_year`` scales the ratios.
    """
    order = Window.partitionBy("scenario").orderBy("date")
    rows = equity.withColumns({"r": F.col("equity") / F.lag("equity").over(order) - 1, "peak": F.max("equity").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("down", 1 - F.col("equity") / F.col("peak"))
    first, last = F.min_by("equity", "date"), F.max_by("equity", "date")
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    scale = math.sqrt(periods_per_year)
    downside = F.sqrt(F.avg(F.when(F.col("r").isNotNull(), F.pow(F.least("r", F.lit(0.0)), F.lit(2.0)))))  # least() passes nulls over
    return rows.groupBy("scenario").agg(
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        (100 * (last / first - 1)).alias("total_return_pct"),
        F.when((years > 0) & (first > 0), 100 * (F.pow(last / first, 1 / years) - 1)).alias("cagr_pct"),
        (100 * F.max("down")).alias("max_drawdown_pct"),
        (scale * F.try_divide(F.avg("r"), F.stddev_samp("r"))).alias("sharpe"),
        (scale * F.try_divide(F.avg("r"), downside)).alias("sortino"),
        (100 * F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0))).alias("win_rate_pct"),
        F.sum("trades").alias("trades"),
    )


def against_index(curve: DataFrame, index: DataFrame) -> DataFrame:
    """(name, total_return_pct, cagr_pct) of the strategy and the index, each over the
    sessions on which it has a value, from the first to the last."""
    series = curve.filter("scenario = 'tradeable'").select(F.lit("strategy").alias("name"), "date", F.col("equity").alias("value"))
    series = series.unionByName(index.select(F.lit("index").alias("name"), "date", "value")).filter("value is not null")
    first, last = F.min_by("value", "date"), F.max_by("value", "date")
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    growth = F.when((years > 0) & (first > 0), 100 * (F.pow(last / first, 1 / years) - 1))
    return series.groupBy("name").agg((100 * (F.try_divide(last, first) - 1)).alias("total_return_pct"), growth.alias("cagr_pct"))


def compare(curve: DataFrame) -> DataFrame:
    """How much of the return comes from fills that nobody could have had."""
    s = stats(curve)
    one = lambda k: F.max(F.when(F.col("scenario") == k, F.col("total_return_pct")))
    rows = s.agg(one("tradeable").alias("tradeable_pct"), one("any").alias("any_pct"))
    return rows.withColumns({"phantom_pp": F.col("any_pct") - F.col("tradeable_pct"), "phantom_rel": F.try_divide(F.col("any_pct"), F.col("tradeable_pct")) - 1})
