"""The operators over the adapter's tape, under the names of the inventory."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import adapters
from ..functions import expressions as X
from ..operators import bars as B
from ..operators import stats as G
from ..operators import tape as T
from ..operators import ticks as K
from ..operators import zones as Z
from ..schemas import KEY
from ..sources import store, tape_files

Query = Callable[[SparkSession, str], DataFrame]


def _averages(trades: DataFrame) -> DataFrame:
    one = B.bars(trades, {"1m": B.WIDTHS["1m"]})
    return B.atr(B.with_emas(one)).select(*KEY, "end_ts", "ema9", "ema20", "ema30", "ema200", "atr", "atr_status")


def _longer(trades: DataFrame) -> DataFrame:
    bars = B.with_emas(B.bars(trades, {tf: B.WIDTHS[tf] for tf in ("1m", "2m", "3m")}).where("tf <> '1m'"))
    columns = [F.max(F.when(F.col("tf") == tf, F.col(f"ema{p}"))).alias(f"ema{p}_{tf}") for tf in ("2m", "3m") for p in B.PERIODS]
    at = bars.groupBy(*KEY, "end_ts").agg(*columns)
    w = Window.partitionBy(*KEY).orderBy("end_ts").rowsBetween(Window.unboundedPreceding, 0)
    names = [c for c in at.columns if c.startswith("ema")]
    return at.select(*KEY, "end_ts", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in names])


class Tape:
    """The tape of a folder of tables and what operators make of it, each as a lazy frame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.trades, self.quotes = adapters.trades(spark, sf_dir), adapters.quotes(spark, sf_dir)
        self._kept: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A frame that several operators read: written once, then scanned."""
        if name not in self._kept:
            self._kept[name] = store.kept(make())
        return self._kept[name]

    @property
    def quoted(self) -> DataFrame:
        return self.once("quoted", lambda: T.asof_quote(self.trades, self.quotes))

    @property
    def sided(self) -> DataFrame:
        return self.once("sided", lambda: T.lee_ready(self.quoted))

    @property
    def bars(self) -> DataFrame:
        return B.bars(self.trades)

    @property
    def averages(self) -> DataFrame:
        return _averages(self.trades)

    @property
    def longer(self) -> DataFrame:
        """Averages of two and three minutes, each at the ends of its own bars."""
        return _longer(self.trades)

    @property
    def grid(self) -> DataFrame:
        return K.tick_grid(K.session_extent(self.trades, self.quotes))

    @property
    def state(self) -> DataFrame:
        return K.tick_state(self.grid, B.vwap(self.trades), self.averages)

    @property
    def flow(self) -> DataFrame:
        return K.tick_flow(self.grid, self.sided)

    @property
    def stream(self) -> DataFrame:
        def make() -> DataFrame:
            trades = self.sided.select(self.trades.columns)  # the trades as they are kept: not made from events each time
            return K.session_stream(B.vwap(trades), self.quotes, self.sided, _averages(trades), _longer(trades))

        return self.once("stream", make)

    @property
    def levels(self) -> DataFrame:
        return Z.active_levels(adapters.levels(self.spark, self.sf_dir))

    @property
    def events(self) -> DataFrame:
        return Z.zone_events(Z.zone_distance(self.state, self.levels))

    @property
    def episodes(self) -> DataFrame:
        return Z.episodes(self.events)


_tapes: dict[tuple[str, str], Tape] = {}


def tape_of(spark: SparkSession, sf_dir: str) -> Tape:
    """The session's tape of a folder: what one query has stored (sides, the stream, packets) the next one reads."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tapes:
        _tapes.clear()
        _tapes[key] = Tape(spark, sf_dir)
    return _tapes[key]


def forget() -> None:
    """Drop what queries have stored, so that the next one computes all of it."""
    _tapes.clear()


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _bars(tf: str, t: Tape) -> DataFrame:
    return B.bars(t.trades, {tf: B.WIDTHS[tf]}).drop("tf", "width", "end_ts")


def _landed(t: Tape, fmt: str = "parquet") -> str:
    """The trades as recorded files: with a list of conditions, or in CSV with their first as text."""
    path = store.scratch(t.spark)
    if fmt == "csv":
        t.trades.withColumn("conditions", F.get("conditions", 0)).drop("session_id").write.option("header", "true").csv(path)
    else:
        t.trades.drop("session_id").write.parquet(path)
    return path


def _conditions(t: Tape) -> DataFrame:
    found = tape_files.scan_trades(t.spark, _landed(t, "csv"), "csv")
    return found.groupBy(F.array_contains("conditions", "W").alias("has_w"), F.size("conditions").alias("n_conditions")).agg(F.count("*").alias("n"))


def _quotes(t: Tape) -> DataFrame:
    path = store.scratch(t.spark)
    t.quotes.write.option("header", "true").csv(path)
    return rounded(tape_files.scan_quotes(t.spark, path, "csv"), "bid", "ask")


def _merged(t: Tape) -> DataFrame:
    commands = adapters.markers(t.spark, t.sf_dir).withColumn("seq", F.substring("marker_id", 2, 20).cast("long"))
    return T.event_merge(t.quotes, t.trades, commands).select("seq", "kind", *KEY, "position")


def _absorption(t: Tape) -> DataFrame:
    out = K.absorption(t.state.withColumn("last_price", F.round("last_price", 4)).join(t.flow, K.TICK))
    return out.select(*K.TICK, F.round(X.asinh(F.col("absorption_index")), 4).alias("absorption"))


def _aggr(t: Tape) -> DataFrame:
    out = K.aggr_z(t.flow)
    return rounded(out.select(*K.TICK, F.col("relative_aggression_zscore_60s").alias("z")), "z")


def _baseline(t: Tape) -> DataFrame:
    return Z.baseline_ticks(t.episodes, t.events).groupBy(*Z.LEVEL, "zone_entry_time").agg(F.count("*").alias("ticks"), F.round(F.min("signed_distance_atr"), 6).alias("lowest"))


PLANS: dict[str, Callable[[Tape], DataFrame]] = {
    "scan_trades": lambda t: tape_files.scan_trades(t.spark, _landed(t)).withColumn("conditions", F.array_join("conditions", ",")),
    "scan_quotes": _quotes,
    "norm_conditions": _conditions,
    "range_scan": lambda t: tape_files.range_scan(tape_files.scan_trades(t.spark, _landed(t)), "S0", 1704207600000, 1704218400000).select("ts_ms", "price", "size"),
    "stable_order": lambda t: T.stable_order(t.trades).select("seq", *KEY, "position"),
    "event_merge": _merged,
    "session_extent": lambda t: K.session_extent(t.trades, t.quotes),
    "exch_date": lambda t: t.trades.groupBy(X.exchange_date(F.col("ts_ms")).alias("date"), X.local_minute(F.col("ts_ms")).alias("minute")).agg(F.count("*").alias("n")),
    "tape_preview": lambda t: T.tape_preview(t.trades, t.quotes),
    "asof_quote": lambda t: rounded(T.asof_quote(t.trades, t.quotes).select("seq", *KEY, "ts_ms", "price", "quote_ts_ms", "bid", "ask"), "bid", "ask"),
    "quote_rule": lambda t: t.quoted.select("seq", *KEY, X.quote_rule(F.col("price"), F.col("bid"), F.col("ask")).alias("side")),
    "lee_ready": lambda t: t.sided.select("seq", *KEY, "ts_ms", "price", "size", "side"),
    "lee_ready_noquote": lambda t: T.lee_ready(t.quoted, need_quote=False).select("seq", *KEY, "side"),
    **{f"bars_{tf}": partial(_bars, tf) for tf in B.WIDTHS},
    "candles": lambda t: t.bars.select(*KEY, "tf", "end_ts", X.local_minute(F.col("bar_ts")).alias("minute"), "open", "high", "low", "close"),
    "true_range": lambda t: rounded(B.atr(t.bars.where("tf = '1m'")).select(*KEY, "bar_ts", "tr"), "tr"),
    "vwap": lambda t: rounded(B.vwap(t.trades).select("seq", *KEY, "vwap"), "vwap"),
    "ema_1m": lambda t: rounded(B.with_emas(t.bars.where("tf = '1m'")).select(*KEY, "bar_ts", "ema9", "ema20", "ema30", "ema200"), "ema9", "ema20", "ema30", "ema200"),
    "ema_tf": lambda t: rounded(B.with_emas(t.bars).select(*KEY, "tf", "bar_ts", "ema9", "ema20", "ema30", "ema200"), "ema9", "ema20", "ema30", "ema200"),
    "atr": lambda t: rounded(B.atr(t.bars.where("tf = '1m'")).select(*KEY, "bar_ts", F.col("bar_no").cast("long").alias("bar_no"), "tr", "atr", "atr_status"), "tr", "atr"),
    "atr_seed": lambda t: B.atr(t.bars.where("tf = '3m'")).select(*KEY, "bar_ts", F.round(X.daily_atr_seed(F.col("atr") * 20), 6).alias("seed")),
    "atr_seed_chain": lambda t: rounded(B.atr_seeds(B.atr(t.bars.where("tf = '1m'"))), "seed"),
    "tick_grid": lambda t: t.grid.withColumn("sequence_id", F.col("sequence_id").cast("long")),
    "tick_state": lambda t: rounded(t.state.select(*K.TICK, "last_price", "vwap_session", "ema9", "ema200", "atr"), "vwap_session", "ema9", "ema200", "atr"),
    "tick_quote": lambda t: rounded(K.tick_quote(t.grid, t.quotes), "bid", "ask", "mid_price", "spread_abs", "spread_pct"),
    "spread": lambda t: t.quotes.where("bid > 0 AND ask > 0").select("seq", *KEY, F.expr("round((bid + ask) / 2, 6) AS mid_price"), F.expr("round(ask - bid, 6) AS spread_abs"), F.expr("round((ask - bid) / ((bid + ask) / 2), 6) AS spread_pct")),
    "tick_flow": lambda t: rounded(t.flow.drop("_high", "_low", "pct_at_bid"), "pct_at_ask", "relative_aggression"),
    "tick_hilo": lambda t: t.stream.select(*K.TICK, "high_10s", "low_10s"),
    "filter_w": lambda t: t.flow.select(*K.TICK, F.col("_high").alias("high"), F.col("_low").alias("low")),
    "spread_vol": lambda t: rounded(K.spread_vol(K.tick_quote(t.grid, t.quotes)).select(*K.TICK, "spread_volatility_60s", F.round("spread_zscore", 4).alias("spread_zscore")), "spread_volatility_60s"),
    "aggr_z": _aggr,
    "delta_deriv": lambda t: K.delta_deriv(t.flow).select(*K.TICK, "delta_velocity", "delta_acceleration"),
    "absorption": _absorption,
    "trade_size": lambda t: rounded(K.trade_size(t.sided), "avg_trade_size", "trade_size_std", "trade_size_cv", "top_decile_volume_share"),
    "realized_vol": lambda t: rounded(K.realized_vol(t.state).select(*K.TICK, "realized_vol_60s"), "realized_vol_60s"),
    "approach_ret": lambda t: rounded(K.approach_return(t.state).select(*K.TICK, "approach_return_60s"), "approach_return_60s"),
    "ema_mask": lambda t: K.ema_structure(t.state).select(*K.TICK, "stack_state", "price_vs_emas"),
    "ema_structure": lambda t: rounded(K.ema_structure(t.state).select(*K.TICK, "slope_ema9_60s", "ema_spread_9_20", "compression_index", "ema_confluence_score", "stretch_200_atr"), "slope_ema9_60s", "ema_spread_9_20", "compression_index", "ema_confluence_score", "stretch_200_atr"),
    "vwap_context": lambda t: rounded(K.vwap_context(t.state).select(*K.TICK, "price_minus_vwap", "price_minus_vwap_atr", "vwap_state"), "price_minus_vwap", "price_minus_vwap_atr"),
    "large_threshold": lambda t: K.large_threshold(t.grid, t.sided),
    "large_trades": lambda t: rounded(K.large_trades(K.large_threshold(t.grid, t.sided), t.sided).drop("large_trade_threshold_size"), "large_trade_buy_ratio", "large_trade_share_of_total_vol_10s"),
    "session_stream": lambda t: rounded(
        t.stream.select(*K.TICK, "ema9_2m", "ema200_3m", "sequence_id", "compression_index", "ema_confluence_score", "stack_state", "vwap_state", "price_minus_vwap_atr", "realized_vol_60s", "delta_velocity", "last_price", "vwap_session", "atr", "ema9", "spread_pct", "relative_aggression", "trade_count", "total_volume", "delta", "high_10s", "low_10s", "large_trade_threshold_size", "large_trade_count_10s"),
        "vwap_session", "atr", "ema9", "ema9_2m", "ema200_3m", "spread_pct", "relative_aggression", "compression_index", "ema_confluence_score", "price_minus_vwap_atr", "realized_vol_60s",
    ).withColumn("sequence_id", F.col("sequence_id").cast("long")),
    "active_levels": lambda t: t.levels.select(*Z.LEVEL, "level_price", "created_ts_ms"),
    "zone_distance": lambda t: rounded(t.events.select(*Z.LEVEL, "ts_ms", "signed_distance", "signed_distance_atr", "in_zone"), "signed_distance", "signed_distance_atr"),
    "zone_events": lambda t: t.events.where("event IS NOT NULL").select(*Z.LEVEL, "ts_ms", "event"),
    "touch_count": lambda t: t.events.groupBy(*Z.LEVEL).agg(F.max("touch_count").alias("touches"), F.count(F.when(F.col("event") == "enter", 1)).alias("entries")),
    "resolution": lambda t: t.episodes.groupBy(*Z.LEVEL, "resolution_trigger").agg(F.count("*").alias("n")),
    "episodes": lambda t: t.episodes.select(*Z.LEVEL, "start_time", "zone_entry_time", "zone_exit_time", "resolution_time", "resolution_trigger", "level_entry_side"),
    "outcome_metrics": lambda t: rounded(t.episodes.select(*Z.LEVEL, "zone_entry_time", "outcome", "mfe", "mae", "time_to_mfe_ms", "time_to_failure_ms"), "mfe", "mae"),
    "outcome_counts": lambda t: t.episodes.groupBy("session_id", "outcome").agg(F.count("*").alias("n")),
    "episode_stats": lambda t: rounded(G.episode_stats(t.episodes), "min", "p50", "p90", "max", "mean"),
    "baseline_backfill": _baseline,
}


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLANS[name](tape_of(spark, sf_dir))


QUERIES: dict[str, Query] = {name: partial(_run, name) for name in PLANS}
