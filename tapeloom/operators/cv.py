"""Walk-forward folds with a purge between training and test sessions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    """Trains on sessions before ``train_before``, tests on first to last."""

    number: int
    train_before: date
    first: date
    last: date

    def trains(self) -> Column:
        return F.col("date") < F.lit(self.train_before)

    def tests(self) -> Column:
        return F.col("date").between(F.lit(self.first), F.lit(self.last))


@dataclass(frozen=True)
class PurgedWalkForward:
    """Expanding folds over sessions.

    A label of ``horizon`` sessions looks horizon + 1 ahead, so training ends that much
    before the test. ``embargo`` counts only with ``apply_embargo``, as the published
    results did without.
    """

    n_splits: int = 6
    horizon: int = 5
    embargo: int = 5
    min_train_days: int = 750
    apply_embargo: bool = False

    def folds(self, sessions: list[date]) -> list[Fold]:
        days = sorted(set(sessions))
        spare = len(days) - self.min_train_days
        if spare < self.n_splits:
            raise ValueError(f"not enough sessions: {len(days)} for {self.min_train_days} and {self.n_splits} splits")
        size, longer = divmod(spare, self.n_splits)
        purge = self.horizon + 1 + (self.embargo if self.apply_embargo else 0)
        out, at = [], self.min_train_days
        for k in range(self.n_splits):
            end = at + size + (k < longer)
            if (cut := max(at - purge, 0)) > 0:
                out.append(Fold(k, days[cut], days[at], days[end - 1]))
            at = end
        return out

    def split(self, rows: DataFrame) -> list[Fold]:
        """Folds over the dates of ``rows``; the driver gets one value a session."""
        return self.folds([r["date"] for r in rows.select("date").distinct().collect()])


def describe(rows: DataFrame, folds: list[Fold]) -> DataFrame:
    """Per fold: first and last date to train and to test, rows of each, and the gap in days."""
    parts = []
    for f in folds:
        last_train = F.max(F.when(f.trains(), F.col("date")))
        row = {
            "fold": F.lit(f.number).cast("long"),
            "train_start": F.min(F.when(f.trains(), F.col("date"))),
            "train_end": last_train,
            "test_start": F.lit(f.first),
            "test_end": F.lit(f.last),
            "n_train": F.count_if(f.trains()),
            "n_test": F.count_if(f.tests()),
            "gap_days": F.datediff(F.lit(f.first), last_train).cast("long"),
        }
        parts.append(F.struct(*[c.alias(n) for n, c in row.items()]))
    return rows.agg(F.array(*parts).alias("folds")).select(F.inline("folds"))
