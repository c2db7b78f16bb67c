"""Daily bars with a status, the trading calendar, and gaps in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bands
from ..functions.windows import by_ticker, previous, ratio

OHLC_SLACK = 0.01
COLUMNS = (
    "ticker", "date", "open", "high", "low", "close", "volume", "adjustment_epoch",
    "exchange", "symbol_status", "prev_close", "ret", "ref_gap_days", "bar_status",
)


def status() -> Column:
    """The first of these that holds: no trade, impossible prices, no usable reference,
    a move that no venue allows, at a limit, outside this venue's band; else normal."""
    c = F.col
    band, tol, move = bands.band_col(c("exchange")), bands.tolerance_col(c("prev_close"), c("exchange")), c("ret")
    usable = (
        c("prev_close").isNotNull()
        & (c("prev_close") >= bands.LEAST_REFERENCE)
        & (c("ref_gap_days") <= bands.LONGEST_REFERENCE_GAP)
    )
    return (
        F.when(c("volume").isNull() | (c("volume") == 0), "no_trade")
        .when((c("high") < F.greatest("open", "close") - OHLC_SLACK) | (c("low") > F.least("open", "close") + OHLC_SLACK), "suspect_ohlc")
        .when(~usable, "unknown")
        .when(F.abs(move) > bands.LARGEST_LEGAL_MOVE, "suspect_move")
        .when(move.between(band - tol, band + tol), "limit_up")
        .when(move.between(-band - tol, -band + tol), "limit_down")
        .when(F.abs(move) > band + tol, "band_anomaly")
        .otherwise("normal")
    )


def classify(prices: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bars with reference price, return, venue and status; one shuffle, by ticker.

    ``symbols`` has one row per ticker; a ticker that it lacks has a null exchange.
    """
    listed = symbols.select("ticker", "exchange", F.col("status").alias("symbol_status"))
    lagged = prices.withColumns({"prev_close": previous("close"), "prev_date": F.lag("date").over(by_ticker())})
    joined = lagged.join(listed, "ticker", "left").withColumns(
        {"ret": ratio(F.col("close"), F.col("prev_close")) - 1, "ref_gap_days": F.datediff("date", "prev_date")}
    )
    return joined.withColumn("bar_status", status()).select(*COLUMNS)


def status_shares(bars: DataFrame) -> DataFrame:
    """Bars of each status and their share in percent; a window over eight rows at most."""
    counts = bars.groupBy("bar_status").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / whole, 2))


def trading_days(calendar: DataFrame, index: DataFrame, prices: DataFrame, index_code: str) -> DataFrame:
    """Dates of any source: marked in the calendar, with an index value, or with a bar."""
    marked = calendar.filter("is_trading_day").select("date")
    valued = index.filter(F.col("index_code") == index_code).select("date")
    return marked.union(valued).union(prices.select("date")).distinct()


def session_gaps(days: DataFrame, least: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Steps of at least ``least`` days between sessions, of the whole market or each ``by``.

    The market has one row a session, so a single ordered task holds some 10,000 rows a
    market's life.
    """
    step = F.datediff("date", F.lag("date").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("date")))
    return days.select(*by, "date", step.alias("gap_days")).filter(F.col("gap_days") >= least)
