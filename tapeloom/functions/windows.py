"""Windows and null-safe statistics that every stage shares.

Time is counted in sessions: frames are rows of one ticker, ordered by date, and only
:func:`back` makes a frame, so no expression built from it can see a later session.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def back(sessions: int) -> WindowSpec:
    """This session and the ones before it, ``sessions`` in all."""
    return by_ticker().rowsBetween(1 - sessions, 0)


def previous(name: str, sessions: int = 1) -> Column:
    return F.lag(name, sessions).over(by_ticker())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.when(b != 0, b)


def rank_in(order: Column, *partition: Column | str) -> Column:
    """Percent rank with nulls last, as SQL engines other than Spark sort them."""
    return F.percent_rank().over(Window.partitionBy(*partition).orderBy(order.asc_nulls_last()))


def corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of the rows where both are known; null where either is constant.

    Spark's own corr() raises on a constant side under ANSI rules.
    """
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
