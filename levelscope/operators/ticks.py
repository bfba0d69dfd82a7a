"""The ten-second grid of a session and what each tick knows.

A tick is named by its end ``ts_ms``, the last millisecond of its ten seconds. Ticks without
a trade or quote are there too. All operators keep the partitioning by symbol and session.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import EPS, bucket, clamp01, price_mask, regular, stack_state
from ..functions.sliding import window_ranks
from ..schemas import KEY

TICK_MS = 10_000
TICK = [*KEY, "ts_ms"]
CONFLUENCE_REF = 0.25


def _over(lo: int, hi: int) -> Window:
    return Window.partitionBy(*KEY).orderBy("ts_ms").rangeBetween(lo, hi)


def _rows(lo: int, hi: int) -> Window:
    return Window.partitionBy(*KEY).orderBy("ts_ms").rowsBetween(lo, hi)


def _order() -> Window:
    return Window.partitionBy(*KEY).orderBy("ts_ms")


def tick_of(ts: Column) -> Column:
    return bucket(ts, TICK_MS) + (TICK_MS - 1)


def session_extent(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """First and last time of each session over trades and quotes."""
    both = trades.select(*KEY, "ts_ms").unionByName(quotes.select(*KEY, "ts_ms"))
    return both.groupBy(*KEY).agg(F.min("ts_ms").alias("start_ts_ms"), F.max("ts_ms").alias("end_ts_ms"))


def tick_grid(extent: DataFrame) -> DataFrame:
    """Every tick end from the session's first tick to its last, gaps included."""
    first, last = tick_of(F.col("start_ts_ms")), tick_of(F.col("end_ts_ms"))
    return extent.select(*KEY, F.explode(F.sequence(first, last, F.lit(TICK_MS))).alias("ts_ms")).withColumn("sequence_id", F.row_number().over(_order()) - 1)


def tick_quote(grid: DataFrame, quotes: DataFrame) -> DataFrame:
    """The last quote inside each tick, with mid, spread and age; null where there is none."""
    last = quotes.groupBy(*KEY, tick_of(F.col("ts_ms")).alias("tick")).agg(F.max_by(F.struct("ts_ms", "bid", "ask"), F.struct("ts_ms", "seq")).alias("q"))
    found = grid.join(last.withColumnRenamed("tick", "ts_ms"), TICK, "left")
    valid = (F.col("q.bid") > 0) & (F.col("q.ask") > 0)
    mid = F.when(valid, (F.col("q.bid") + F.col("q.ask")) / 2)
    spread = F.when(valid, F.col("q.ask") - F.col("q.bid"))
    return found.select(*TICK, "q.bid", "q.ask", mid.alias("mid_price"), spread.alias("spread_abs"), (spread / mid).alias("spread_pct"), (F.col("ts_ms") - F.col("q.ts_ms")).alias("quote_age_ms"))


def tick_flow(grid: DataFrame, sided: DataFrame) -> DataFrame:
    """Trades of each tick by side, and the high and low of its regular prints."""
    by = sided.groupBy(*KEY, tick_of(F.col("ts_ms")).alias("tick")).agg(
        F.count("*").alias("trade_count"), F.sum("size").alias("total_volume"),
        *[F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0.0)).alias(f"{s}_volume") for s in ("buy", "sell", "unknown")],
        F.max(F.when(regular(F.col("conditions")), F.col("price"))).alias("_high"), F.min(F.when(regular(F.col("conditions")), F.col("price"))).alias("_low"),
    )
    zero = {c: 0.0 for c in ("total_volume", "buy_volume", "sell_volume", "unknown_volume")} | {"trade_count": 0}
    out = grid.join(by.withColumnRenamed("tick", "ts_ms"), TICK, "left").fillna(zero)
    delta = F.col("buy_volume") - F.col("sell_volume")
    some = F.col("total_volume") > 0
    return out.select(
        *TICK, "trade_count", "total_volume", "buy_volume", "sell_volume", "unknown_volume", delta.alias("delta"),
        F.when(some, F.col("buy_volume") / F.col("total_volume")).otherwise(0.0).alias("pct_at_ask"),
        F.when(some, F.col("sell_volume") / F.col("total_volume")).otherwise(0.0).alias("pct_at_bid"),
        F.when(some, delta / (F.col("total_volume") + EPS)).otherwise(0.0).alias("relative_aggression"), "_high", "_low",
    )


def tick_state(grid: DataFrame, trades: DataFrame, averages: DataFrame) -> DataFrame:
    """Last price and VWAP as of each tick's end, and the averages of bars that have ended.

    ``trades`` has a ``vwap``; ``averages`` has end_ts and any columns to carry, by session.
    """
    values = [c for c in averages.columns if c not in (*KEY, "end_ts")]
    price = trades.groupBy(*KEY, tick_of(F.col("ts_ms")).alias("ts_ms")).agg(F.max_by(F.struct("price", "vwap"), F.struct("ts_ms", "seq")).alias("_p"))
    bar = averages.groupBy(*KEY, tick_of(F.col("end_ts")).alias("ts_ms")).agg(F.max_by(F.struct(*values), "end_ts").alias("_b"))
    all_ = grid.join(price, TICK, "left").join(bar, TICK, "left")
    w = _rows(Window.unboundedPreceding, 0)
    p, b = F.last("_p", ignorenulls=True).over(w), F.last("_b", ignorenulls=True).over(w)
    return all_.withColumn("_p", p).withColumn("_b", b).select(*TICK, F.col("_p.price").alias("last_price"), F.col("_p.vwap").alias("vwap_session"), *[F.col(f"_b.{v}").alias(v) for v in values])


def bars_asof(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """Ticks plus the columns of the last bar that has ended (``bars`` has end_ts and what to carry, by session)."""
    values = [c for c in bars.columns if c not in (*KEY, "end_ts")]
    bar = bars.groupBy(*KEY, tick_of(F.col("end_ts")).alias("ts_ms")).agg(F.max_by(F.struct(*values), "end_ts").alias("_b"))
    out = ticks.join(bar, TICK, "left").withColumn("_b", F.last("_b", ignorenulls=True).over(_rows(Window.unboundedPreceding, 0)))
    return out.select(*ticks.columns, *[F.col(f"_b.{v}").alias(v) for v in values])


def spread_vol(ticks: DataFrame) -> DataFrame:
    """Population deviation of the spread over 60 s and the tick's z-score in it."""
    w = _over(-60_000, 0)
    vol, mean, n = F.stddev_pop("spread_pct").over(w), F.avg("spread_pct").over(w), F.count("spread_pct").over(w)
    vol = F.coalesce(F.when(n > 1, vol), F.lit(0.0))
    z = F.when((n < 2) | (vol <= EPS), 0.0).otherwise((F.coalesce("spread_pct", F.lit(0.0)) - mean) / (vol + EPS))
    return ticks.withColumn("spread_volatility_60s", vol).withColumn("spread_zscore", z)


def aggr_z(ticks: DataFrame) -> DataFrame:
    w = _over(-60_000, 0)
    vol, n = F.stddev_pop("relative_aggression").over(w), F.count("*").over(w)
    z = F.when((n < 2) | (vol <= EPS), 0.0).otherwise((F.col("relative_aggression") - F.avg("relative_aggression").over(w)) / (vol + EPS))
    return ticks.withColumn("relative_aggression_zscore_60s", z)


def delta_deriv(ticks: DataFrame) -> DataFrame:
    one = ticks.withColumn("delta_velocity", F.coalesce(F.col("delta") - F.lag("delta").over(_order()), F.lit(0.0)))
    return one.withColumn("delta_acceleration", F.coalesce(F.col("delta_velocity") - F.lag("delta_velocity").over(_order()), F.lit(0.0)))


def absorption(ticks: DataFrame) -> DataFrame:
    """Selling that didn't move the price; without a price before, the move is 0."""
    move = F.coalesce(F.col("last_price") - F.lag("last_price").over(_order()), F.lit(0.0))
    return ticks.withColumn("absorption_index", F.greatest(F.lit(0.0), -F.col("delta")) / (F.abs(move) + EPS))


def trade_size(sided: DataFrame) -> DataFrame:
    """Mean, deviation, variation and top-decile share of the trade sizes of each tick."""
    t = sided.where("size > 0").withColumn("tick", tick_of(F.col("ts_ms")))
    part = Window.partitionBy(*KEY, "tick")
    ranked = t.withColumn("_rank", F.row_number().over(part.orderBy(F.desc("size"), "seq"))).withColumn("_n", F.count("*").over(part))
    top = F.sum(F.when(F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.1)), F.col("size")))
    out = ranked.groupBy(*KEY, F.col("tick").alias("ts_ms")).agg(F.avg("size").alias("avg_trade_size"), F.stddev_pop("size").alias("trade_size_std"), (top / F.sum("size")).alias("top_decile_volume_share"))
    return out.withColumn("trade_size_cv", F.col("trade_size_std") / F.col("avg_trade_size"))


def realized_vol(ticks: DataFrame) -> DataFrame:
    """Deviation of the log returns between the positive prices of the last 60 s."""
    price, before = F.col("last_price"), F.lag("last_price").over(_order())
    step = F.when((price > 0) & (before > 0), F.ln(price / before))
    return ticks.withColumn("_r", step).withColumn("realized_vol_60s", F.coalesce(F.stddev_pop("_r").over(_over(-50_000, 0)), F.lit(0.0))).drop("_r")


def approach_return(ticks: DataFrame) -> DataFrame:
    """Log return against the price 60 s before, or the latest before that within five minutes."""
    before = F.last("last_price", ignorenulls=True).over(_over(-300_000, -60_000))
    return ticks.withColumn("approach_return_60s", F.coalesce(F.when((before > 0) & (F.col("last_price") > 0), F.ln(F.col("last_price") / before)), F.lit(0.0)))


def ema_structure(ticks: DataFrame, confluence_ref: float = CONFLUENCE_REF) -> DataFrame:
    """Slopes a second, spreads, compression, confluence, stack, mask and stretch of the averages."""
    e9, e20, e30, e200, atr, price = (F.col(c) for c in ("ema9", "ema20", "ema30", "ema200", "atr", "last_price"))
    w = _over(-300_000, -60_000)
    at = F.last(F.when(e9.isNotNull(), F.struct("ts_ms", "ema9", "ema20", "ema30")), ignorenulls=True).over(w)
    one = ticks.withColumn("_then", at)
    seconds = (F.col("ts_ms") - F.col("_then.ts_ms")) / 1000.0
    for p in (9, 20, 30):
        one = one.withColumn(f"slope_ema{p}_60s", F.coalesce((F.col(f"ema{p}") - F.col(f"_then.ema{p}")) / seconds, F.lit(0.0)))
    moving = e9.isNotNull() & atr.isNotNull()
    # equal prices have no range; by convention what is measured by it is 0 then
    compression = F.when(atr > 0, (F.abs(e9 - e20) + F.abs(e20 - e30)) / atr).when(moving, 0.0)
    return (
        one.drop("_then").withColumn("ema_spread_9_20", e9 - e20).withColumn("ema_spread_20_30", e20 - e30)
        .withColumn("compression_index", compression).withColumn("ema_confluence_score", clamp01(1 - compression / confluence_ref))
        .withColumn("stack_state", F.when(e9.isNotNull(), stack_state(price, e9, e20, e30)))
        .withColumn("price_vs_emas", F.when(price.isNotNull(), price_mask(price, e9, e20, e30, e200)).otherwise(0))
        .withColumn("stretch_200_atr", F.coalesce(F.when(atr > 0, (price - e200) / atr), F.lit(0.0)))
    )


def vwap_context(ticks: DataFrame) -> DataFrame:
    d = F.col("last_price") - F.col("vwap_session")
    state = F.when(d > 1e-12, "above").when(d < -1e-12, "below").when(d.isNotNull(), "at")
    return ticks.withColumn("price_minus_vwap", d).withColumn("price_minus_vwap_atr", F.when(F.col("atr") > 0, d / F.col("atr")).when(d.isNotNull() & F.col("atr").isNotNull(), 0.0)).withColumn("vwap_state", state)


#: Time of which a task slides the window over the trade sizes at once; what its first windows need is sent to it as well.
RANK_SLICE_MS = 1_800_000


def large_threshold(grid: DataFrame, sided: DataFrame, share: float = 0.95, window_ms: int = 300_000) -> DataFrame:
    """The 95th percentile (nearest rank) of the trade sizes of the five minutes to each tick.

    Sessions are cut into slices of time; a trade goes to the slices whose windows hold it, two
    at most. In a slice one histogram of sizes is added to and taken from as the window slides.
    """
    first = tick_of(F.col("ts_ms"))
    farthest = first + F.floor((F.col("ts_ms") + window_ms - first) / TICK_MS) * TICK_MS
    sizes = sided.where("size > 0").select(*KEY, "ts_ms", "size", F.explode(F.sequence(F.floor(first / RANK_SLICE_MS), F.floor(farthest / RANK_SLICE_MS))).alias("_slice"))

    def ranks(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ts, begin = group["ts_ms"].to_numpy(), key[-1] * RANK_SLICE_MS
        low, high = max(begin, int(ts.min())), min(begin + RANK_SLICE_MS - 1, int(ts.max()) + window_ms)
        ends = np.arange(low // TICK_MS * TICK_MS + TICK_MS - 1, high + 1, TICK_MS)
        found = window_ranks(ts, group["size"].to_numpy(), ends, share, window_ms)
        there = ~np.isnan(found)
        return pd.DataFrame({"symbol": key[0], "session_id": key[1], "ts_ms": ends[there], "large_trade_threshold_size": found[there]})

    out = sizes.groupBy(*KEY, "_slice").applyInPandas(ranks, "symbol string, session_id string, ts_ms long, large_trade_threshold_size double")
    return grid.join(out, TICK, "left").select(*TICK, F.coalesce("large_trade_threshold_size", F.lit(0.0)).alias("large_trade_threshold_size"))


def large_trades(thresholds: DataFrame, sided: DataFrame) -> DataFrame:
    """Trades of at least the threshold in each tick, by side."""
    t = sided.select(*KEY, tick_of(F.col("ts_ms")).alias("ts_ms"), "size", "side")
    big = (F.col("large_trade_threshold_size") > 0) & (F.col("size") >= F.col("large_trade_threshold_size"))
    joined = thresholds.join(t, TICK, "left")
    sums = [F.sum(F.when(big & (F.col("side") == s), F.col("size")).otherwise(0.0)).alias(f"large_{s}_volume_10s") for s in ("buy", "sell", "unknown")]
    out = joined.groupBy(*TICK, "large_trade_threshold_size").agg(F.count(F.when(big, 1)).alias("large_trade_count_10s"), *sums, F.sum(F.coalesce("size", F.lit(0.0))).alias("_all"))
    buy, sell, rest = F.col("large_buy_volume_10s"), F.col("large_sell_volume_10s"), F.col("large_unknown_volume_10s")
    return out.select(
        *TICK, "large_trade_threshold_size", "large_trade_count_10s", buy, sell, rest, (buy - sell).alias("large_trade_delta"),
        F.when(buy + sell > 0, buy / (buy + sell + EPS)).otherwise(0.0).alias("large_trade_buy_ratio"),
        F.when(F.col("_all") > 0, (buy + sell + rest) / (F.col("_all") + EPS)).otherwise(0.0).alias("large_trade_share_of_total_vol_10s"),
    )


def session_stream(trades: DataFrame, quotes: DataFrame, sided: DataFrame, averages: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """All that a tick knows, a row a tick. ``trades`` has a vwap, ``averages`` as in tick_state.

    ``more`` has averages of longer time frames (end_ts and columns of other names), to be carried too.

    Every join is on (symbol, session, tick) and stays within that partitioning.
    """
    grid = tick_grid(session_extent(trades, quotes))
    base = grid.join(tick_state(grid, trades, averages), TICK).join(tick_quote(grid, quotes), TICK).join(tick_flow(grid, sided), TICK)
    base = base.join(trade_size(sided), TICK, "left").join(large_trades(large_threshold(grid, sided), sided), TICK)
    base = base.withColumn("high_10s", F.coalesce("_high", "last_price")).withColumn("low_10s", F.coalesce("_low", "last_price")).drop("_high", "_low")
    if more is not None:
        base = bars_asof(base, more)
    base = base.fillna(0.0, ["avg_trade_size", "trade_size_std", "top_decile_volume_share", "trade_size_cv"])
    for step in (spread_vol, aggr_z, delta_deriv, absorption, realized_vol, approach_return, ema_structure, vwap_context):
        base = step(base)
    return base
