"""Queries of levels, touches, scores, sessions, streams and stored tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..functions import expressions as X
from ..operators import scoring as S
from ..operators import stats as G
from ..operators import ticks as K
from ..operators import timeline as L
from ..operators import zones as Z
from ..schemas import KEY
from ..sources import store
from ..streaming import engine, sinks
from ..streaming import tape_stream as ST
from .queries import Query, Tape, rounded, tape_of


def base(t: Tape) -> DataFrame:
    """The stream with its levels."""
    return L.level_ticks(t.stream, t.levels)


def packets(t: Tape) -> DataFrame:
    return t.once("packets", lambda: L.touch_packets(L.interaction_timeline(base(t))))


def heavy_stream(t: Tape) -> DataFrame:
    return adapters.heavy(t.stream)


def heavy(t: Tape) -> DataFrame:
    """Touch packets of the stream with large volumes, for rules that ask for them."""
    return t.once("heavy", lambda: L.touch_packets(L.interaction_timeline(L.level_ticks(heavy_stream(t), t.levels))))


PACKET = ["approach_delta_60s", "approach_velocity_atr_per_min", "band_delta_0_30s", "band_delta_0_60s", "rel_aggr_0_30s", "touch_dwell_s", "bounce_return_30s_pct", "bounce_return_60s_pct", "max_penetration_pct", "touch_volume_z"]


def _timeline(t: Tape) -> DataFrame:
    e = L.interaction_timeline(base(t)).where("event IS NOT NULL")
    return e.select(*L.LEVEL, "ts_ms", "event", "from_side", "to_side", "wick_touch", "cross_through", "reclaim_attempt")


def _packets(t: Tape) -> DataFrame:
    return rounded(packets(t).select(*L.LEVEL, "ts_ms", F.col("touch_number").cast("long").alias("touch_number"), "approach_type", "delta_flip_flag", "wick_recovered_flag", *PACKET), *PACKET)


def _scores(t: Tape) -> DataFrame:
    scored = S.touch_score(heavy(t))
    return scored.select(*L.LEVEL, "ts_ms", F.col("score").cast("long").alias("score"), F.col("bucket").cast("long").alias("bucket"), "label")


def _stats(t: Tape) -> DataFrame:
    names = ["hold_rate", "flip_rate", "compression_mean", "compression_median", "compression_max", "bounce_mean", "bounce_median", "positive_bounce_rate", "aggression_rate"]
    best = F.array_join(F.transform("top_bounces", lambda x: F.format_string("%.4f", F.round(x["bounce"], 6) * 100)), " ")
    return rounded(S.level_stats(heavy(t)).select(*L.LEVEL, "touches", "breaks", "quality", *names, best.alias("best")), *names)


def minutes(t: Tape) -> DataFrame:
    return S.minutes(heavy(t), heavy_stream(t))


def _dumps(t: Tape) -> DataFrame:
    counts = [F.col(c).cast("long").alias(c) for c in ("accelerations", "late_buy", "score")]
    out = S.wash_dumps(minutes(t)).select(*L.LEVEL, "minute_ts", "buy", "sell", "recovery_buy", "recovery_ratio", "hard_stop_a", "hard_stop_b", "absorbed", *counts)
    return rounded(out, "recovery_ratio")


def wash(t: Tape) -> DataFrame:
    m = minutes(t)
    return S.wash_verdict(m, S.wash_dumps(m))


WINDOW = ["relative_aggression_mean", "spread_pct_mean", "compression_mean", "confluence_mean", "atr_mean", "absorption_mean_asinh", "return_abs", "return_pct", "price_first", "price_last"]


def _window(t: Tape) -> DataFrame:
    ticks = t.stream.where("last_price IS NOT NULL")
    out = L.window_summary(ticks, KEY)
    return rounded(out.select(*KEY, "points", "duration_s", "trades", "volume", "buy_volume", "sell_volume", "unknown_volume", "delta", "price_min", "price_max", *WINDOW), *WINDOW)


def _snapshots(t: Tape) -> DataFrame:
    return t.once("snapshots", lambda: Z.smart_money(Z.level_spine(Z.episode_ticks(t.episodes, t.events, t.stream))))


def _spine(t: Tape) -> DataFrame:
    out = _snapshots(t).select(*Z.LEVEL, "zone_entry_time", "ts_ms", "phase", "max_penetration_atr", F.col("cross_count_60s").cast("long").alias("cross_count_60s"), "oscillation_amplitude_60s", "time_in_zone_60s", "time_in_zone_total")
    return rounded(out, "max_penetration_atr", "oscillation_amplitude_60s")


def _money(t: Tape) -> DataFrame:
    names = ["price_return_10s", "price_return_60s", "return_norm", "baseline_vol_mean", "delta_norm"]
    return rounded(_snapshots(t).select(*Z.LEVEL, "zone_entry_time", "ts_ms", "cvd_10s", "cvd_30s", "cvd_60s", "cvd_30s_slope", "cvd_60s_slope", "volume_60s", "trade_count_60s", *names), *names)


def _z(t: Tape) -> DataFrame:
    names = ["baseline_vol_mean", "vol_zscore", "baseline_trade_mean", "trade_zscore"]
    return rounded(_snapshots(t).select(*Z.LEVEL, "zone_entry_time", "ts_ms", *names), *names, digits=4)


def _divergence(t: Tape) -> DataFrame:
    names = ["divergence_score", "buy_on_red", "sell_on_green"]
    out = _snapshots(t).select(*Z.LEVEL, "zone_entry_time", "ts_ms", F.col("divergence_flag").cast("long").alias("divergence_flag"), *names)
    return rounded(out.withColumns({n: X.asinh(F.col(n)) for n in names}), *names, digits=4)


def _ranking(t: Tape) -> DataFrame:
    out = G.feature_ranking(_snapshots(t), t.episodes).drop("diff")
    return rounded(out.withColumns({c: X.asinh(F.col(c)) for c in ("win_mean", "loss_mean")}), "win_mean", "loss_mean", "effect", digits=4)


def _markers(t: Tape) -> DataFrame:
    return adapters.markers(t.spark, t.sf_dir)


def _marker_episodes(t: Tape) -> DataFrame:
    out = Z.marker_episodes(_markers(t), t.state)
    return rounded(out.select("marker_id", *KEY, "marker_type", "direction_bias", "level_price", "resolution_time", "resolution_trigger", "mfe", "mae"), "mfe", "mae")


def _level_tags(t: Tape) -> DataFrame:
    notes = _markers(t).withColumn("n", X.parse_notes(F.col("notes")))
    tag = X.first_tag(F.col("n.price_tags"))
    return notes.select("marker_id", tag["price"].alias("price"), tag["kind"].alias("kind"), F.size(X.level_tags(F.col("n.price_tags"))).cast("long").alias("n_tags"), F.col("n.end_ts_ms").alias("end_ts_ms"))


def _stored(t: Tape) -> tuple[str, DataFrame]:
    path = store.scratch(t.spark)
    flow = t.flow.select(*K.TICK, "trade_count", "total_volume", "pct_at_ask")
    store.write(flow, path, "session_stream")
    return path, flow


def _sink(t: Tape) -> DataFrame:
    path, _ = _stored(t)
    return store.read(t.spark, path, "session_stream").groupBy("date", "ticker", "session").agg(F.count("*").alias("rows"), F.sum("trade_count").alias("trades"))


def _replaced(t: Tape) -> DataFrame:
    """One symbol's sessions written again with every count doubled; the others stay."""
    path, flow = _stored(t)
    store.write(flow.where("symbol = 'S0'").withColumn("trade_count", F.col("trade_count") * 2), path, "session_stream", replace=True)
    return store.read(t.spark, path, "session_stream").groupBy("ticker", "session").agg(F.count("*").alias("rows"), F.sum("trade_count").alias("trades"))


def _published(t: Tape) -> DataFrame:
    """Two kinds published together; one symbol's sessions are published again with every count doubled."""
    path = store.scratch(t.spark)
    flow, events = t.flow.select(*K.TICK, "trade_count", "total_volume"), t.events.where("event IS NOT NULL").select(*Z.LEVEL, "ts_ms", "event")
    store.publish({"session_stream": (flow, "ts_ms"), "episodes": (events, "ts_ms")}, path)
    again = F.col("symbol") == "S0"
    twice = events.where(again).unionByName(events.where(again))
    store.publish({"session_stream": (flow.where(again).withColumn("trade_count", F.col("trade_count") * 2), "ts_ms"), "episodes": (twice, "ts_ms")}, path)
    at = store.manifest(t.spark, path)
    ticks = store.read_published(t.spark, path, "session_stream", at).groupBy("ticker", "session").agg(F.count("*").alias("rows"), F.sum("trade_count").alias("trades"))
    found = store.read_published(t.spark, path, "episodes", at).groupBy("ticker", "session").agg(F.count("*").alias("events"))
    return ticks.join(found, ["ticker", "session"], "left").fillna(0, ["events"])


def _sessions(t: Tape) -> DataFrame:
    path, _ = _stored(t)
    return store.list_sessions(t.spark, path, ("session_stream",))


def _streamed(t: Tape, make: Callable[[DataFrame], DataFrame], frame: DataFrame | None = None) -> DataFrame:
    """A frame dropped as files into a folder, in order of time, and drained by a stream in several batches."""
    path = store.scratch(t.spark)
    df = t.trades.drop("session_id") if frame is None else frame
    ST.drop_files(df, f"{path}/in")
    ST.drain(make(ST.source(t.spark, f"{path}/in", schema=df.schema, files_each=1)), f"{path}/out", f"{path}/state")
    return t.spark.read.parquet(f"{path}/out")


def _st_flow(t: Tape) -> DataFrame:
    sided = t.sided.select("seq", "symbol", "ts_ms", "price", "size", "side")
    return _streamed(t, ST.st_flow, sided)


def _engine(t: Tape) -> DataFrame:
    """Ticks, zones and episodes of the live tape, its levels added by commands."""
    return t.once("engine", lambda: _streamed(t, engine.tape_engine, engine.events(t.trades, t.quotes, t.levels)))


def _st_engine(t: Tape) -> DataFrame:
    names = ["last_price", "trade_count", "total_volume", "buy_volume", "sell_volume", "unknown_volume", "ema9", "atr"]
    return rounded(engine.ticks(_engine(t)).select(*K.TICK, *names), "ema9", "atr", "last_price")


def _st_zones(t: Tape) -> DataFrame:
    return engine.zone_events(_engine(t)).select(*Z.LEVEL, "ts_ms", "event")


def _st_episodes(t: Tape) -> DataFrame:
    names = ["zone_entry_time", "zone_exit_time", "resolution_time", "resolution_trigger", "level_entry_side", "outcome", "mfe", "mae", "time_to_mfe_ms", "time_to_failure_ms"]
    return rounded(engine.episodes(_engine(t)).select(*Z.LEVEL, *names), "mfe", "mae")


class _Dies(sinks.BatchSink):
    """Fails once between a batch's tables and its entry in the ledger."""

    died = False

    def commit(self, batch: DataFrame, number: int) -> None:
        if number == 1 and not _Dies.died:
            _Dies.died = True
            raise RuntimeError("cut off")
        super().commit(batch, number)


def _st_sink(t: Tape) -> DataFrame:
    """Trades through the partitioned sink; the stream is cut off in its second batch and started again."""
    path = store.scratch(t.spark)
    frame = t.trades
    ST.drop_files(frame, f"{path}/in")
    stream = ST.source(t.spark, f"{path}/in", schema=frame.schema, files_each=1)
    sink = _Dies(f"{path}/out", {"tape": lambda df: df.where("price IS NOT NULL").drop("t")})
    _Dies.died = False
    try:
        sinks.drain_to(stream, sink, f"{path}/state")
    except StreamingQueryException:
        pass
    sinks.drain_to(stream, sink, f"{path}/state")
    return sinks.read(t.spark, f"{path}/out", "tape").groupBy("ticker", "session").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("n_different"), F.sum("size").alias("size"))


def _st_watermark(t: Tape) -> DataFrame:
    """Trades of which one in fifty of the first quarter comes once more after the third: what is kept as late."""
    path = store.scratch(t.spark)
    low, high = t.trades.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    quarter = (high + 1 - low) // 4
    again = t.trades.where((F.col("seq") % 50 == 7) & (F.col("ts_ms") < low + quarter)).withColumn("seq", -F.col("seq"))
    for k in range(4):
        part = t.trades.where(F.col("ts_ms").between(low + k * quarter, low + (k + 1) * quarter - 1 if k < 3 else high))
        (part.unionByName(again) if k == 3 else part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = ST.source(t.spark, f"{path}/in", schema=t.trades.schema, files_each=1)
    sinks.drain_to(stream, sinks.LateSink(f"{path}/out", 10_000), f"{path}/state")
    kept = sinks.read(t.spark, f"{path}/out", "tape").groupBy().agg(F.count("*").alias("on_time"))
    late = sinks.read(t.spark, f"{path}/out", "late")
    return late.select((-F.col("seq")).alias("seq"), "symbol", "ts_ms").join(kept)  # a single row


def _parity(t: Tape) -> DataFrame:
    """The live tape against the replayed one, in every column that is stored of a tick.

    A stream keeps as many cores busy as it has sessions of a day, so the batch is made beside it.
    """
    with ThreadPoolExecutor(1) as beside:
        batch = beside.submit(inheritable_thread_target(t.spark)(lambda: t.stream))
        live = engine.ticks(_engine(t))
        return engine.parity(live, batch.result())


def _st_phases(t: Tape) -> DataFrame:
    touches = packets(t).select("symbol", "ts_ms", "level_id")
    return _streamed(t, ST.st_phases, touches)


def _anti(t: Tape) -> DataFrame:
    return G.dq_missing(t.trades, t.episodes.where("resolution_trigger = 'timeout'"))


DISTS = ["last_price", "ema9", "atr"]
PLANS: dict[str, Callable[[Tape], DataFrame]] = {
    "interaction_timeline": _timeline,
    "timeline_summary": lambda t: L.timeline_summary(L.interaction_timeline(base(t))),
    "role_flip": lambda t: L.role_flip(L.interaction_timeline(base(t))),
    "band_summary": lambda t: L.band_summary(base(t)).select(*L.LEVEL, "time_in_band_s", "band_volume", "band_delta", "touch_count", "cross_count", "reclaim_attempts", "reclaim_holds_30s", F.col("band_large_count").cast("long").alias("band_large_count"), "band_large_delta", F.round("band_large_buy_ratio", 6).alias("band_large_buy_ratio"), F.round("reclaim_hold_rate", 6).alias("reclaim_hold_rate")),
    "session_wide": _window,
    "touch_packets": _packets,
    "touch_outcome": lambda t: packets(t).select(*L.LEVEL, "ts_ms", "break_confirmed_30s", "reclaim_after_break", "reclaim_hold_30s", "touch_outcome"),
    "touch_score": _scores,
    "level_stats": _stats,
    "level_flags": lambda t: S.level_flags(S.level_stats(packets(t))),
    "gap_phases": lambda t: S.gap_phases(packets(t)).groupBy(*L.LEVEL, F.col("phase_id").cast("long").alias("phase_id")).agg(F.count("*").alias("touches"), F.min("ts_ms").alias("start_ts_ms")),
    "phases": lambda t: S.phases(heavy(t)).select(*L.LEVEL, F.col("phase").cast("long").alias("phase"), "touches", F.col("first_touch").cast("long").alias("first_touch"), "buy", "sell", "delta", "inst_buy", "inst_sell", "absorbed", "winner"),
    "minute_breakdown": minutes,
    "wash_dumps": _dumps,
    "wash_verdict": lambda t: wash(t).withColumn("score", F.col("score").cast("long")),
    "episode_snapshots": _spine,
    "cvd": _money,
    "baseline_z": _z,
    "divergence": _divergence,
    "feature_ranking": _ranking,
    "reports_index": lambda t: rounded(G.reports_index(t.episodes), "mfe_p50", "mae_p90", "win_rate"),
    "marker_episodes": _marker_episodes,
    "level_tag": _level_tags,
    "marker_bias": lambda t: _markers(t).select("marker_id", X.marker_bias(F.col("marker_type"), F.col("direction_bias")).alias("bias")),
    "dq_counts": lambda t: G.dq_counts({"trades": t.trades, "quotes": t.quotes}),
    "dq_nulls": lambda t: rounded(G.dq_nulls(t.state, DISTS), "null_rate"),
    "dq_dists": lambda t: rounded(G.dq_dists(t.state, DISTS), "min", "max", "mean", "p50", "p90"),
    "dq_value_counts": lambda t: G.dq_value_counts(t.sided, ["side", "symbol"]),
    "dq_cadence": lambda t: rounded(G.dq_cadence(_snapshots(t), [*Z.LEVEL, "zone_entry_time"]), "regular"),
    "dq_missing": _anti,
    "max_drop": lambda t: rounded(G.minute_extremes(t.stream), "drop_pct"),
    "sink_partitioned": _sink,
    "sink_replace_session": _replaced,
    "list_sessions": _sessions,
    "sink_published": _published,
    "st_bars": lambda t: _streamed(t, ST.st_bars),
    "st_flow": _st_flow,
    "st_phases": _st_phases,
    "st_engine": _st_engine,
    "st_sink": _st_sink,
    "st_watermark": _st_watermark,
    "st_zones": _st_zones,
    "st_episodes": _st_episodes,
    "st_parity": _parity,
    "st_source": lambda t: _streamed(t, lambda x: x.where("size > 0").select("seq", "symbol", "ts_ms", "price", "size")),
}


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLANS[name](tape_of(spark, sf_dir))


QUERIES: dict[str, Query] = {name: partial(_run, name) for name in PLANS}
