"""The registry of features and the 28 that come with it.

A feature is a Column over one ticker's own past, built from ``back`` and ``previous``
only. It is null until the ticker has ``lookback`` sessions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import back, by_ticker, previous, ratio
from .xsec import rank

KEYS = ("ticker", "date", "close", "adtv", "exchange", "symbol_status", "bar_status", "tradeable", "in_universe")


@dataclass(frozen=True)
class Feature:
    name: str
    expr: Callable[[], Column]
    category: str
    lookback: int

    def column(self) -> Column:
        return F.when(F.col("session_idx") >= self.lookback, self.expr()).alias(self.name)


_REGISTRY: dict[str, Feature] = {}


def register(name: str, category: str, lookback: int, expr: Callable[[], Column] | str) -> Feature:
    """Add a feature; a string is a Spark SQL expression."""
    if name in _REGISTRY:
        raise ValueError(f"feature {name} is registered already")
    feature = Feature(name, (lambda text=expr: F.expr(text)) if isinstance(expr, str) else expr, category, lookback)
    _REGISTRY[name] = feature
    return feature


def all_features() -> dict[str, Feature]:
    return dict(_REGISTRY)


def by_category(category: str) -> list[Feature]:
    return [f for f in _REGISTRY.values() if f.category == category]


def names(ranked: bool = True) -> list[str]:
    return sorted(f"{n}_rank" if ranked else n for n in _REGISTRY)


def _c(name: str) -> Column:
    return F.col(name)


def _growth(a: Column, b: Column) -> Column:
    return ratio(a, b) - 1


def _compound(name: str, n: int) -> Column:
    return F.exp(F.sum(F.ln(1 + _c(name))).over(back(n))) - 1


def _regression(function: Callable, n: int = 60) -> Column:
    return function("ret", "mkt_ret").over(back(n))


def _unexplained(n: int = 60) -> Column:
    """Volatility that the market leaves: null without a fit, not 0."""
    fit = _regression(F.regr_r2, n)
    return F.when(fit.isNotNull(), F.stddev_samp("ret").over(back(n)) * F.sqrt(F.greatest(1 - fit, F.lit(0.0))))


for _n in (1, 5, 21, 63, 126, 252):
    register(f"ret_{_n}", "momentum", _n, lambda n=_n: _growth(_c("close"), previous("close", n)))
register("mom_12_1", "momentum", 252, lambda: _growth(previous("close", 21), previous("close", 252)))
register("dist_52w_high", "momentum", 252, lambda: _growth(_c("close"), F.max("close").over(back(252))))
register("dist_52w_low", "momentum", 252, lambda: _growth(_c("close"), F.min("close").over(back(252))))
for _n in (21, 63):
    register(f"vol_{_n}", "price", _n, lambda n=_n: F.stddev_samp("ret").over(back(n)))
register("downside_vol_21", "price", 21, lambda: F.sqrt(F.avg(F.pow(F.least(_c("ret"), F.lit(0.0)), F.lit(2.0))).over(back(21))))
register("gap", "price", 2, lambda: _growth(_c("open"), previous("close")))
register("hl_range", "price", 1, lambda: ratio(_c("high") - _c("low"), _c("close")))
register("close_location", "price", 1, lambda: ratio(_c("close") - _c("low"), _c("high") - _c("low")))
register("trade_freq_21", "price", 21, lambda: F.avg(F.when(_c("volume") > 0, 1.0).otherwise(0.0)).over(back(21)))
register("log_adtv", "volume", 20, lambda: F.ln(F.when(_c("adtv") != 0, _c("adtv"))))
register("turnover_ratio", "volume", 20, lambda: ratio(_c("turnover"), _c("adtv")))
for _n in (5, 21):
    register(f"turnover_ratio_{_n}", "volume", max(_n, 20), lambda n=_n: ratio(F.avg("turnover").over(back(n)), _c("adtv")))
register("amihud_21", "volume", 21, lambda: F.avg(ratio(F.abs("ret"), _c("turnover"))).over(back(21)) * 1e9)
register("untradeable_frac_21", "volume", 21, lambda: F.avg(F.when(_c("tradeable"), 0.0).otherwise(1.0)).over(back(21)))
register("beta_60", "market", 60, lambda: _regression(F.regr_slope))
register("alpha_60", "market", 60, lambda: _regression(F.regr_intercept))
register("idio_vol_60", "market", 60, _unexplained)
for _n in (5, 21, 63):
    register(f"excess_ret_{_n}", "market", _n, lambda n=_n: _compound("ret", n) - _compound("mkt_ret", n))


def raw(panel: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Keys, session_idx and features of every panel row: one shuffle and sort by ticker."""
    chosen = [_REGISTRY[n] for n in (only or _REGISTRY)]
    indexed = panel.withColumn("session_idx", F.row_number().over(by_ticker()).cast("long"))
    ordered = sorted(chosen, key=lambda f: (f.category, f.name))
    return indexed.select(*KEYS, "session_idx", *[f.column() for f in ordered])


def ranked(raw_rows: DataFrame, only: list[str] | None = None, null_rank: str = "last") -> DataFrame:
    """Universe rows with features and their daily ranks: one shuffle, by date."""
    chosen = only or [n for n in _REGISTRY if n in raw_rows.columns]
    rows = raw_rows.filter("in_universe").drop("session_idx")
    return rows.withColumns({f"{n}_rank": rank(n, null_rank) for n in chosen})


def build(panel: DataFrame, only: list[str] | None = None) -> DataFrame:
    return ranked(raw(panel, only), only)


def coverage(rows: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Share of universe rows, in percent, where each feature is known: feature, pct, thin."""
    chosen = sorted(only or _REGISTRY)
    inside = rows.filter("in_universe")
    counts = inside.agg(F.count(F.lit(1)).alias("n"), *[F.count(n).alias(n) for n in chosen])
    long = counts.unpivot("n", chosen, "feature", "known")
    pct = F.round(F.lit(100.0) * F.col("known") / F.when(F.col("n") != 0, F.col("n")), 1)
    return long.select("feature", pct.alias("pct"), (pct.isNull() | (pct < 90)).alias("thin"))
