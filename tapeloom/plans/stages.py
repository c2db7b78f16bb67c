"""The chain of stages, each a DataFrame of the ones before, over any source tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import alpha, bars, features, labels, panel
from ..sources import synth
from ..sources.mirror import materialized


@dataclass
class Market:
    """Source tables and, lazily, all that is derived from them."""

    prices: DataFrame
    symbols: DataFrame
    index: DataFrame
    calendar: DataFrame | None = None
    index_code: str = synth.INDEX_CODE
    horizons: tuple[int, ...] = labels.HORIZONS
    feature_names: tuple[str, ...] | None = None

    def stored(self, *stages: str) -> Market:
        """This market, with the named stages written once for all that follows from them."""
        for name in stages:
            self.__dict__[name] = materialized(getattr(self, name))
        return self

    @classmethod
    def synthetic(cls, spark: SparkSession, sf_dir: str, **settings) -> Market:
        made = (f(spark, sf_dir) for f in (synth.daily_prices, synth.symbols, synth.index_series, synth.trading_calendar))
        return cls(*made, **settings)

    @cached_property
    def bars(self) -> DataFrame:
        return bars.classify(self.prices, self.symbols)

    @cached_property
    def panel(self) -> DataFrame:
        return panel.build(self.bars, panel.market_returns(self.index, self.index_code))

    @cached_property
    def labels(self) -> DataFrame:
        return labels.build(self.panel, self.horizons)

    @cached_property
    def raw(self) -> DataFrame:
        return features.raw(self.panel, list(self.feature_names) if self.feature_names else None)

    @cached_property
    def features(self) -> DataFrame:
        return features.ranked(self.raw, list(self.feature_names) if self.feature_names else None)

    @cached_property
    def joined(self) -> DataFrame:
        return alpha.join_labels(self.features, self.labels)
