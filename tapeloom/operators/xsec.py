"""Cross-sectional transforms: over the universe of one date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import rank_in


def rank(name: str, null_rank: str = "last") -> Column:
    """Percent rank in the universe of the day, null outside it.

    By default a null value is ranked behind all others, like the published results; with
    ``null_rank="null"`` it has no rank and the others are ranked without it.
    """
    value = F.col(name)
    if null_rank == "null":
        known = F.col("in_universe") & value.isNotNull()
        return F.when(known, rank_in(value, "date", known))
    return F.when(F.col("in_universe"), rank_in(value, "date", "in_universe"))


def zscore(name: str) -> Column:
    day = Window.partitionBy("date", "in_universe")
    sd = F.stddev_samp(name).over(day)
    return F.when(F.col("in_universe"), (F.col(name) - F.avg(name).over(day)) / F.when(sd != 0, sd))


def winsorize(name: str, low: float = 0.01, high: float = 0.99) -> Column:
    """Values cut to percentiles of the universe of the day."""
    day = Window.partitionBy("date", "in_universe")
    cut = F.percentile(name, F.array(F.lit(low), F.lit(high))).over(day)
    return F.when(F.col("in_universe") & F.col(name).isNotNull(), F.greatest(F.least(F.col(name), cut[1]), cut[0]))
