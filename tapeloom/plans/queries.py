"""The named queries over the test tables, one per operator of the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands
from ..operators import alpha, backtest, bars, features, labels, model, panel
from ..operators.cv import PurgedWalkForward, describe
from ..operators.xsec import winsorize, zscore
from ..sources import mirror as snapshots
from ..sources import synth
from .stages import Market

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Features that are one or two divisions of whole numbers, and so equal in every engine.
EXACT = ("close_location", "dist_52w_high", "dist_52w_low", "gap", "hl_range", "mom_12_1", "ret_1", "ret_21", "ret_5", "ret_63")
STUDIED = EXACT
HORIZONS = (1, 5, 10, 21)
SPLITTER = PurgedWalkForward(n_splits=3, horizon=5, embargo=5, min_train_days=150)
RULES = backtest.Settings(top_n=10, every=5, init_cash=1e9, max_adtv_frac=0.10)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits of long sums do not matter; exact ones stay."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and not exact(c) else F.col(c) for c, t in df.dtypes])


def exact(name: str) -> bool:
    """Features that every engine computes to the same bits."""
    return name in features.all_features() and name.startswith(("ret_", "mom_", "dist_", "gap", "hl_", "close_", "trade_", "turnover_"))


def market(spark: SparkSession, sf_dir: str, *names: str, horizons: tuple[int, ...] = HORIZONS) -> Market:
    return Market.synthetic(spark, sf_dir, horizons=horizons, feature_names=names or None)


def _study(spark: SparkSession, sf_dir: str, *names: str, horizons: tuple[int, ...] = (5,)) -> DataFrame:
    return market(spark, sf_dir, *names, horizons=horizons).joined


# -- price-limit rules and bars


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market(spark, sf_dir).bars.select("ticker", "date", "close", "exchange")


@query
def bands_tick(spark, sf_dir):
    price, venue = F.col("close"), F.col("exchange")
    return _quotes(spark, sf_dir).select(
        "ticker", "date", bands.band_col(venue).alias("band"), bands.tick_col(price, venue).cast("long").alias("tick"), F.round(bands.tolerance_col(price, venue), 9).alias("tol")
    )


@query
def bands_ceiling_floor(spark, sf_dir):
    price, venue = F.col("close"), F.col("exchange")
    return _quotes(spark, sf_dir).select("ticker", "date", bands.limit_col(price, venue, up=True).alias("ceiling"), bands.limit_col(price, venue, up=False).alias("floor"))


@query
def bars_status(spark, sf_dir):
    return rounded(market(spark, sf_dir).bars.withColumn("ref_gap_days", F.col("ref_gap_days").cast("long")), 9)


@query
def bars_status_histogram(spark, sf_dir):
    return bars.status_shares(market(spark, sf_dir).bars)


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = market(spark, sf_dir)
    return bars.trading_days(m.calendar, m.index, m.prices, m.index_code)


@query
def calendar_days(spark, sf_dir):
    return _days(spark, sf_dir)


@query
def calendar_gaps(spark, sf_dir):
    """Gaps in every name's own sessions."""
    own = market(spark, sf_dir).prices.select("ticker", "date")
    return bars.session_gaps(own, 2, by=("ticker",)).withColumn("gap_days", F.col("gap_days").cast("long"))


@query
def calendar_gaps_market(spark, sf_dir):
    """Gaps of the whole market's trading days."""
    return bars.session_gaps(_days(spark, sf_dir), 2).withColumn("gap_days", F.col("gap_days").cast("long"))


# -- panel


@query
def panel_liquidity(spark, sf_dir):
    return rounded(market(spark, sf_dir).panel.select("ticker", "date", "turnover", "adtv", "adtv_obs"), 3)


@query
def panel_universe(spark, sf_dir):
    return market(spark, sf_dir).panel.select("ticker", "date", "tradeable", "in_universe")


@query
def panel_mkt_ret(spark, sf_dir):
    return rounded(market(spark, sf_dir).panel.select("ticker", "date", "mkt_ret"), 9)


@query
def panel_summary_filter_counts(spark, sf_dir):
    return panel.summary(market(spark, sf_dir).panel)


@query
def panel_distinct_names(spark, sf_dir):
    return panel.distinct_names(market(spark, sf_dir).panel, "2015-06-01")


# -- labels


@query
def labels_entry(spark, sf_dir):
    return market(spark, sf_dir).labels.select("ticker", "date", "entry_date", "entry_px", "entry_tradeable", "entry_ok", "in_universe")


def _labels_at(h: int) -> Query:
    def at(spark, sf_dir):
        rows = market(spark, sf_dir, horizons=(h,)).labels
        return rounded(rows.select("ticker", "date", *[f"{c}_{h}" for c in ("exit_px", "exit_date", "exit_tradeable", "label_ok", "fwd_ret")]), 9)

    return at


for _h in HORIZONS:
    QUERIES[f"labels_h{_h}"] = _labels_at(_h)


@query
def labels_rank_h5(spark, sf_dir):
    rows = market(spark, sf_dir, horizons=(5,)).labels
    return rounded(rows.select("ticker", "date", "fwd_ret", "fwd_rank", "label_ok"), 9)


@query
def labels_stats(spark, sf_dir):
    return labels.stats(market(spark, sf_dir).labels, HORIZONS)


# -- features


def _feature(name: str) -> Query:
    return lambda spark, sf_dir: rounded(market(spark, sf_dir, name).raw.select("ticker", "date", name))


for _n in features.all_features():
    QUERIES[f"feat_{_n}"] = _feature(_n)


@query
def feat_all(spark, sf_dir):
    """All 28 in one pass, as the stage computes them."""
    rows = market(spark, sf_dir).raw
    return rounded(rows.select("ticker", "date", "session_idx", *features.names(ranked=False)))


@query
def feat_coverage(spark, sf_dir):
    return features.coverage(market(spark, sf_dir).raw)


def _rank(name: str) -> Query:
    def of(spark, sf_dir):
        return rounded(market(spark, sf_dir, name).features.select("ticker", "date", f"{name}_rank"), 9)

    return of


for _n in EXACT:
    QUERIES[f"xsec_rank_{_n}"] = _rank(_n)


@query
def xsec_zscore(spark, sf_dir):
    rows = market(spark, sf_dir, "hl_range").raw
    return rounded(rows.select("ticker", "date", zscore("hl_range").alias("z")).filter("z is not null"))


@query
def xsec_winsorize(spark, sf_dir):
    rows = market(spark, sf_dir, "hl_range").raw
    return rounded(rows.select("ticker", "date", winsorize("hl_range").alias("cut")).filter("cut is not null"), 9)


# -- alpha


def _ranks(names: tuple[str, ...] = STUDIED) -> list[str]:
    return [f"{n}_rank" for n in names]


@query
def joined_d(spark, sf_dir):
    rows = _study(spark, sf_dir, *STUDIED)
    return rounded(rows.select("ticker", "date", "in_universe", "fwd_ret_5", "fwd_rank_5", "label_ok_5", *_ranks()), 9)


@query
def ic_daily(spark, sf_dir):
    rows = alpha.daily_ic(_study(spark, sf_dir, *STUDIED), _ranks())
    return rounded(rows.select("date", "feature", "n", "ic"))


@query
def ic_table(spark, sf_dir):
    return rounded(alpha.ic_table(_study(spark, sf_dir, *STUDIED), _ranks()))


@query
def ic_decay(spark, sf_dir):
    return rounded(alpha.ic_decay(_study(spark, sf_dir, *STUDIED, horizons=HORIZONS), _ranks(), HORIZONS))


@query
def corr_matrix(spark, sf_dir):
    return rounded(alpha.correlations(_study(spark, sf_dir, *STUDIED), _ranks()))


@query
def spread_quintile(spark, sf_dir):
    return rounded(alpha.spread(_study(spark, sf_dir, "hl_range"), "hl_range_rank"))


@query
def spread_summary(spark, sf_dir):
    buckets = alpha.spread(_study(spark, sf_dir, "hl_range"), "hl_range_rank")
    return rounded(alpha.spread_summary(buckets, "hl_range_rank"))


@query
def turnover_signal(spark, sf_dir):
    return rounded(alpha.turnover(_study(spark, sf_dir, "hl_range"), "hl_range_rank"))


@query
def spearman_daily(spark, sf_dir):
    rows = _study(spark, sf_dir, "hl_range").filter("label_ok_5 and fwd_rank_5 is not null")
    return rounded(alpha.daily_spearman(rows, "hl_range_rank", "fwd_rank_5"))


# -- model


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.matrix(_study(spark, sf_dir, *STUDIED), _ranks())


def _unpacked(rows: DataFrame, names: list[str]) -> DataFrame:
    values = vector_to_array("features")
    return rounded(rows.select("ticker", "date", "y", "fwd_ret", *[values[i].alias(n) for i, n in enumerate(names)]), 9)


@query
def train_matrix(spark, sf_dir):
    return _unpacked(_matrix(spark, sf_dir), _ranks())


@query
def cv_folds(spark, sf_dir):
    rows = _study(spark, sf_dir, "hl_range").filter("label_ok_5 and fwd_rank_5 is not null").select("date")
    return describe(rows, SPLITTER.split(rows))


@query
def train_gbt_oos(spark, sf_dir):
    run = model.walk_forward(_matrix(spark, sf_dir), _ranks(), SPLITTER, "gbt_small")
    return run.oos


@query
def train_gbt_folds(spark, sf_dir):
    return model.walk_forward(_matrix(spark, sf_dir), _ranks(), SPLITTER, "gbt_small").summary(spark)


@query
def leakage_controls(spark, sf_dir):
    return model.leakage_controls(_matrix(spark, sf_dir), _ranks(), SPLITTER, "gbt_small")


# -- the same over all features, with the production model


@query
def joined_d_all(spark, sf_dir):
    ranks = features.names()
    return rounded(_study(spark, sf_dir).select("ticker", "date", "in_universe", "fwd_ret_5", "fwd_rank_5", "label_ok_5", *ranks), 9)


@query
def ic_daily_all(spark, sf_dir):
    rows = alpha.daily_ic(_study(spark, sf_dir), features.names())
    return rounded(rows.select("date", "feature", "n", "ic"))


@query
def ic_table_all(spark, sf_dir):
    return rounded(alpha.ic_table(_study(spark, sf_dir), features.names()))


@query
def ic_decay_all(spark, sf_dir):
    return rounded(alpha.ic_decay(_study(spark, sf_dir, horizons=HORIZONS), features.names(), HORIZONS))


@query
def corr_matrix_all(spark, sf_dir):
    return rounded(alpha.correlations(_study(spark, sf_dir), features.names()))


def _matrix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.matrix(_study(spark, sf_dir), features.names())


@query
def train_matrix_all(spark, sf_dir):
    return _unpacked(_matrix_all(spark, sf_dir), features.names())


@query
def train_gbt_oos_all(spark, sf_dir):
    return model.walk_forward(_matrix_all(spark, sf_dir), features.names(), SPLITTER, "gbt").oos


@query
def train_gbt_folds_all(spark, sf_dir):
    return model.walk_forward(_matrix_all(spark, sf_dir), features.names(), SPLITTER, "gbt").summary(spark)


@query
def leakage_controls_all(spark, sf_dir):
    return model.leakage_controls(_matrix_all(spark, sf_dir), features.names(), SPLITTER, "gbt")


# -- back-test


def _signal(spark: SparkSession, sf_dir: str) -> tuple[Market, DataFrame]:
    """A market and predictions from it, both written once for all steps of the back-test."""
    m = market(spark, sf_dir, "hl_range", horizons=(5,)).stored("panel")
    rows = m.joined.filter("label_ok_5 and fwd_rank_5 is not null")
    return m, snapshots.materialized(rows.select("date", "ticker", (-F.col("hl_range_rank")).alias("pred")))


def _sized(spark: SparkSession, sf_dir: str) -> tuple[Market, DataFrame, DataFrame]:
    m, preds = _signal(spark, sf_dir)
    days = snapshots.materialized(backtest.sessions(m.panel, preds))
    chosen = backtest.picks(preds, days, RULES.top_n, RULES.every)
    return m, days, snapshots.materialized(backtest.sized(chosen, m.panel, RULES.init_cash, RULES.max_adtv_frac))


@query
def bt_topn(spark, sf_dir):
    m, preds = _signal(spark, sf_dir)
    days = backtest.sessions(m.panel, preds)
    return backtest.picks(preds, days, RULES.top_n, RULES.every)


@query
def bt_weights_sized(spark, sf_dir):
    return rounded(_sized(spark, sf_dir)[2].select("date", "ticker", "weight"), 9)


@query
def bt_weights_ref(spark, sf_dir):
    _, days, rows = _sized(spark, sf_dir)
    return rounded(backtest.weights(rows, days, "carry"), 9)


@query
def bt_weights_rebalance(spark, sf_dir):
    _, days, rows = _sized(spark, sf_dir)
    return rounded(backtest.weights(rows, days, "rebalance"), 9)


@query
def bt_costs(spark, sf_dir):
    c = backtest.Costs()
    row = [(c.symmetric_fee, c.round_trip, c.breakeven_spread(0.5))]  # half of the names replaced
    return rounded(spark.createDataFrame(row, "symmetric_fee double, round_trip double, breakeven_spread double"))


@query
def bt_benchmark(spark, sf_dir):
    """The index on all sessions of the back-test."""
    m, days, _ = _sized(spark, sf_dir)
    return backtest.benchmark(m.index, m.index_code, days.select("date"))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, days, rows = _sized(spark, sf_dir)
    return backtest.simulate(m.panel, backtest.weights(rows, days, RULES.hold), RULES)


@query
def bt_equity(spark, sf_dir):
    return rounded(_curve(spark, sf_dir), 2)


@query
def bt_stats(spark, sf_dir):
    return rounded(backtest.stats(_curve(spark, sf_dir)))


@query
def bt_compare(spark, sf_dir):
    return rounded(backtest.compare(_curve(spark, sf_dir)))


# -- snapshots


def _mirrored(spark: SparkSession, sf_dir: str) -> snapshots.Manifest:
    m = market(spark, sf_dir)
    tables = {"daily_prices": m.prices, "symbols": m.symbols, "index_series": m.index, "trading_calendar": m.calendar}
    return snapshots.mirror(spark, tables.__getitem__, list(tables), snapshots.scratch(spark))


@query
def mirror_counts(spark, sf_dir):
    counts = _mirrored(spark, sf_dir).row_counts
    return spark.createDataFrame(sorted(counts.items()), "table_name string, n long")


@query
def manifest_epochs(spark, sf_dir):
    manifest = _mirrored(spark, sf_dir)
    manifest.check_single_epoch()
    return spark.createDataFrame([(e,) for e in manifest.adjustment_epochs], "adjustment_epoch long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of three features in the universe of its last session."""
    rows = market(spark, sf_dir, "ret_21", "vol_21", "log_adtv").features
    last = rows.agg(F.max("date").alias("date"))
    return rows.join(F.broadcast(last), "date").select("date", "ticker", "ret_21_rank", "vol_21_rank", "log_adtv_rank")
