"""Forward returns: the one stage that looks ahead."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import by_ticker, rank_in

ENTRY_GAP, EXIT_GAP = 12, 3  # days: to the entry, and more for each session held
HORIZONS, PRIMARY = (1, 5, 10, 21), 5


def _ahead(name: str, sessions: int) -> Column:
    return F.lead(name, sessions).over(by_ticker())


def _priced(price: Column) -> Column:
    return price.isNotNull() & (price > 0)


def entries(panel: DataFrame, price: str = "open") -> DataFrame:
    """Panel rows with the next session's price, date and tradeability, and whether an
    entry there is valid."""
    rows = panel.withColumns({"entry_px": _ahead(price, 1), "entry_date": _ahead("date", 1), "entry_tradeable": _ahead("tradeable", 1)})
    valid = _priced(F.col("entry_px")) & F.col("entry_tradeable") & (F.datediff("entry_date", "date") <= ENTRY_GAP)
    return rows.withColumn("entry_ok", valid)


def build(panel: DataFrame, horizons: Iterable[int] = HORIZONS, primary: int = PRIMARY, price: str = "open") -> DataFrame:
    """Labels of every horizon: exit price, date and tradeability, validity, return, rank.

    All leads share one window; ranks share one shuffle by date when asked for together.
    An exit need not be tradeable, else labels would only keep what could be sold.
    """
    spans = sorted({*horizons, primary})
    ahead = {}
    for h in spans:
        ahead |= {f"exit_px_{h}": _ahead(price, 1 + h), f"exit_date_{h}": _ahead("date", 1 + h), f"exit_tradeable_{h}": _ahead("tradeable", 1 + h)}
    rows = entries(panel.withColumns(ahead), price)
    days = {h: F.datediff(f"exit_date_{h}", "entry_date") <= ENTRY_GAP + EXIT_GAP * h for h in spans}
    rows = rows.withColumns({f"label_ok_{h}": F.col("entry_ok") & _priced(F.col(f"exit_px_{h}")) & days[h] for h in spans})
    rows = rows.withColumns({f"fwd_ret_{h}": F.when(F.col(f"label_ok_{h}"), F.col(f"exit_px_{h}") / F.col("entry_px") - 1) for h in spans})
    counted = {h: F.col(f"label_ok_{h}") & F.col("in_universe") for h in spans}
    rows = rows.withColumns({f"fwd_rank_{h}": F.when(counted[h], rank_in(F.col(f"fwd_ret_{h}"), "date", counted[h])) for h in spans})
    base = ["ticker", "date", "entry_date", "entry_px", "entry_tradeable", "entry_ok", "in_universe", "adtv", "close"]
    each = [f"{c}_{h}" for h in spans for c in ("exit_px", "exit_date", "exit_tradeable", "label_ok", "fwd_ret", "fwd_rank")]
    main = [F.col(f"{c}_{primary}").alias(c) for c in ("fwd_ret", "fwd_rank", "label_ok")]
    return rows.select(*base, *each, *main)


def stats(labels: DataFrame, horizons: Iterable[int] = (PRIMARY,)) -> DataFrame:
    """Per horizon: universe rows, those with a label and those without, and the mean and
    deviation of their returns in percent; all from one pass."""
    each = []
    for h in sorted(horizons):
        kept = F.col(f"label_ok_{h}") & F.col("in_universe")
        value = F.when(kept, 100 * F.col(f"fwd_ret_{h}"))
        row = {
            "horizon": F.lit(h).cast("long"),
            "n_universe": F.count_if(F.col("in_universe")),
            "n_labelled": F.count_if(kept),
            "n_unlabelled": F.count_if(F.col("in_universe") & ~F.coalesce(F.col(f"label_ok_{h}"), F.lit(False))),
            "mean_pct": F.round(F.avg(value), 3),
            "sd_pct": F.round(F.stddev_samp(value), 3),
        }
        each.append(F.struct(*[c.alias(n) for n, c in row.items()]))
    return labels.agg(F.array(*each).alias("by")).select(F.inline("by"))
