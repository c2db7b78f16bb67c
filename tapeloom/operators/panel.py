"""The (ticker, date) panel: liquidity, universe membership and market return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import back, ratio

TRADEABLE = "normal"
ADTV_SESSIONS, ADTV_LEAST = 20, 1e9
COLUMNS = (
    "ticker", "date", "open", "high", "low", "close", "volume", "exchange", "symbol_status", "bar_status",
    "prev_close", "ret", "turnover", "adtv", "adtv_obs", "tradeable", "in_universe", "mkt_ret",
)


def market_returns(index: DataFrame, index_code: str) -> DataFrame:
    """One row a session of the index: date and return on the session before."""
    one = index.filter(F.col("index_code") == index_code)
    last = F.lag("close").over(Window.partitionBy("index_code").orderBy("date"))
    return one.select("date", (ratio(F.col("close"), last) - 1).alias("mkt_ret"))


def build(bars: DataFrame, market: DataFrame, sessions: int = ADTV_SESSIONS, least: float = ADTV_LEAST, full_window: bool = True) -> DataFrame:
    """Panel rows for all bars, partitioned by ticker like the bars.

    ``market`` is sent to all executors: it has one row a session, some 250 a year.
    """
    value = F.col("turnover")
    rows = bars.withColumn("turnover", F.col("close") * F.col("volume")).withColumns(
        {"adtv": F.avg(value).over(back(sessions)), "adtv_obs": F.count(value).over(back(sessions))}
    )
    member = F.col("adtv") >= least
    if full_window:
        member = member & (F.col("adtv_obs") == sessions)
    rows = rows.withColumns({"tradeable": F.col("bar_status") == TRADEABLE, "in_universe": member})
    return rows.join(F.broadcast(market), "date", "left").select(*COLUMNS)


def summary(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("tradeable").alias("n_tradeable"),
        F.count_if("in_universe").alias("n_universe"),
        F.count_if(F.col("mkt_ret").isNotNull()).alias("n_market"),
    )


def distinct_names(panel: DataFrame, since: str) -> DataFrame:
    recent = panel.filter(F.col("in_universe") & (F.col("date") >= F.lit(since).cast("date")))
    return recent.agg(F.countDistinct("ticker").alias("names"))
