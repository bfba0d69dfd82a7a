"""How price interacts with a level's band: events, touches and what comes of them.

Everything is a window over the ticks of one level in one session; a level's band is a
fraction of its price, or of the tick's own ``level_price`` where that moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import asinh
from ..schemas import KEY

BAND = 0.0015
LEVEL = [*KEY, "level_id"]


def _w() -> Window:
    return Window.partitionBy(*LEVEL).orderBy("ts_ms")


def _later() -> Window:
    """The rows after each one, the nearest last: a frame to the end would be read anew for every row."""
    return Window.partitionBy(*LEVEL).orderBy(F.desc("ts_ms")).rowsBetween(Window.unboundedPreceding, -1)


def level_ticks(stream: DataFrame, levels: DataFrame, band: float = BAND) -> DataFrame:
    """Priced ticks with each level of their session, its band and the price's place in it."""
    kept = levels.select(*LEVEL, "level_price", "level_type")
    base = stream.where("last_price IS NOT NULL").join(kept, KEY)
    low, high = F.col("level_price") * (1 - band), F.col("level_price") * (1 + band)
    pos = F.when(F.col("last_price") < low, -1).when(F.col("last_price") > high, 1).otherwise(0)
    return base.withColumn("lower", low).withColumn("upper", high).withColumn("pos", pos).withColumn("rn", F.row_number().over(_w()))


def interaction_timeline(base: DataFrame) -> DataFrame:
    """``base`` plus event, from_side, to_side, wick_touch, cross_through and reclaim_attempt.

    A wick into the band comes before a change of place; the first tick emits nothing.
    """
    price, before, pos = F.col("last_price"), F.lag("pos").over(_w()), F.col("pos")
    above = (F.col("low_10s") <= F.col("upper")) & (price > F.col("upper"))
    below = (F.col("high_10s") >= F.col("lower")) & (price < F.col("lower"))
    later = F.col("rn") > 1
    wick = later & (above | below)
    moved = later & (before != pos)
    through = moved & (before != 0) & (pos != 0)
    broke = F.when(F.col("level_type") == "support", pos < 0).when(F.col("level_type") == "resistance", pos > 0)
    left = F.when(broke, "break").when(~broke, "reject").otherwise("exit")
    event = F.when(wick, "touch").when(moved & (before == 0), left).when(moved, "touch")
    side = F.when(wick, F.when(above, "above").otherwise("below")).when(moved & (before != 0), F.when(before > 0, "above").otherwise("below"))
    to = F.when(~wick & moved & (pos != 0), F.when(pos > 0, "above").otherwise("below"))
    one = base.withColumn("event", event).withColumn("from_side", side).withColumn("to_side", to).withColumn("wick_touch", wick).withColumn("cross_through", ~wick & through)
    last_break = F.last(F.when(F.col("event") == "break", F.col("to_side")), ignorenulls=True).over(_w().rowsBetween(Window.unboundedPreceding, -1))
    return one.withColumn("reclaiming_from", F.when(F.col("event") == "touch", last_break)).withColumn("reclaim_attempt", F.col("reclaiming_from").isNotNull())


def timeline_summary(timeline: DataFrame) -> DataFrame:
    def many(cond: Column, name: str) -> Column:
        return F.count(F.when(cond, 1)).alias(name)

    return timeline.where("event IS NOT NULL").groupBy(*LEVEL).agg(
        *[many(F.col("event") == e, n) for e, n in (("touch", "touches"), ("break", "breaks"), ("reject", "rejects"))],
        many(F.col("reclaim_attempt"), "reclaim_attempts"), many(F.col("cross_through"), "cross_throughs"), F.count("*").alias("events"),
    )


def role_flip(timeline: DataFrame) -> DataFrame:
    """Whether, after a break, price turned away on the level's old side again."""
    broken = F.max(F.when(F.col("event") == "break", 1)).over(_w().rowsBetween(Window.unboundedPreceding, -1))
    flipped = F.coalesce(F.max(F.when((F.col("event") == "reject") & (F.col("_b") == 1), True)), F.lit(False))
    return timeline.withColumn("_b", broken).groupBy(*LEVEL).agg(flipped.alias("role_flip"))


def _mean_of(values: Column) -> Column:
    """Mean of an array's elements that aren't null."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def touch_packets(timeline: DataFrame, interval_s: float = 10.0) -> DataFrame:
    """A row a touch: approach, reaction, dwell, bounce, penetration, large trades, context and outcome.

    What leads to a touch is the six ticks before it, what follows starts with its own tick.
    """
    price, lower = F.col("last_price"), F.col("lower")
    early, soon, minute = _w().rowsBetween(-6, -1), _w().rowsBetween(0, 2), _w().rowsBetween(0, 5)
    dozen, whole, ever = _w().rowsBetween(0, 11), Window.partitionBy(*LEVEL), _w().rowsBetween(Window.unboundedPreceding, 0)

    def ahead(n: int) -> Column:
        last = F.last("last_price").over(_w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return F.coalesce(F.lead("last_price", n).over(_w()), last)

    def six_before(name: str) -> Column:
        """The value six ticks before, or the session's first where fewer went before."""
        return F.coalesce(F.lag(name, 6).over(_w()), F.first(name).over(ever))

    def sums(name: str, window) -> Column:
        return F.coalesce(F.sum(name).over(window), F.lit(0.0))

    has = set(timeline.columns)
    optional = {
        "absorption_mean_0_30s": ("absorption_index", lambda c: F.avg(c).over(soon)),
        "spread_pct_at_touch": ("spread_pct", F.col),
        "_spread_pre": ("spread_pct", lambda c: F.avg(c).over(_w().rowsBetween(-6, -4))),
        "_spread_post": ("spread_pct", lambda c: F.avg(c).over(soon)),
        "_spread_all": ("spread_pct", lambda c: F.avg(c).over(whole)),
        "ema_stack_at_touch": ("stack_state", F.col),
        "large_threshold_at_touch": ("large_trade_threshold_size", F.col),
        "large_buy_ratio_at_touch": ("large_trade_buy_ratio", F.col),
        "_vwap": ("vwap_session", F.col),
    }
    support = F.col("level_type") == "support"
    one = timeline.withColumns({"_held": F.min(price).over(soon) >= lower, "_under": F.max(price).over(soon) < lower, "_cvd": sums("delta", _w().rowsBetween(-5, 0))})
    touch = F.when(F.col("event") == "touch", F.struct("ts_ms", "_held"))
    one = one.withColumn("_next_touch", F.last(touch, ignorenulls=True).over(_later()))
    broke = F.when(F.col("event") == "break", F.struct("ts_ms", "_under", "_next_touch"))
    atr = F.avg("atr").over(early)
    out_at = F.min(F.when(F.col("pos") != 0, F.col("rn"))).over(dozen)
    one = one.withColumns({
        "_break": F.last(broke, ignorenulls=True).over(_later()),
        "_in30": ahead(3), "_in60": ahead(6), "_lowest": F.min(price).over(minute),
        "_before": F.collect_list(F.struct("compression_index")).over(early),
        "approach_delta_60s": sums("delta", early),
        "approach_rel_aggr_60s": F.avg("relative_aggression").over(early),
        "approach_velocity_atr_per_min": F.when(atr > 0, F.abs(price - six_before("last_price")) / atr),
        "band_delta_0_30s": F.sum("delta").over(soon), "band_delta_0_60s": F.sum("delta").over(minute),
        "rel_aggr_0_30s": F.avg("relative_aggression").over(soon), "rel_aggr_0_60s": F.avg("relative_aggression").over(minute),
        "touch_dwell_s": (F.coalesce(out_at, F.col("rn") + F.count("*").over(dozen)) - F.col("rn")) * interval_s,
        "touch_volume_z": (F.col("total_volume") - F.avg("total_volume").over(whole)) / (F.stddev_samp("total_volume").over(whole) + 1e-9),
        "_volume_30s": F.sum("total_volume").over(soon),
        "large_count_30s": F.sum("large_trade_count_10s").over(soon), "_large_count_before": sums("large_trade_count_10s", early),
        "large_buy_30s": F.sum("large_buy_volume_10s").over(soon), "large_sell_30s": F.sum("large_sell_volume_10s").over(soon),
        "_cvd_before": six_before("_cvd"),
        **{name: make(column) if column in has else F.lit(None) for name, (column, make) in optional.items()},
    })
    return _touch_columns(one.where("event = 'touch'"), support, interval_s)


def _touch_columns(touches: DataFrame, support: Column, interval_s: float) -> DataFrame:
    """What follows from a touch's own row, once only touches are left."""
    price, lower, lowest, speed = F.col("last_price"), F.col("lower"), F.col("_lowest"), F.col("approach_velocity_atr_per_min")
    buy, sell, many = F.col("large_buy_30s"), F.col("large_sell_30s"), F.col("large_count_30s")
    before = F.transform("_before", lambda x: x["compression_index"])
    first, last = F.slice(before, 1, 3), F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), F.lit(3))
    confirmed = F.coalesce(F.col("_break._under") & (F.col("_break.ts_ms") - F.col("ts_ms") <= 120_000), F.lit(False))
    again, held = F.col("_break._next_touch").isNotNull(), F.col("_break._next_touch._held")
    rate = many / (3 * interval_s / 60.0)
    change = F.col("_change")
    one = touches.withColumns({
        "touch_number": F.row_number().over(_w()), "minute_start_ms": F.col("ts_ms") - F.pmod("ts_ms", F.lit(60_000)),
        "time_since_last_touch_s": (F.col("ts_ms") - F.lag("ts_ms").over(_w())) / 1000.0,
        "level_at_touch": F.col("level_price"),
        "approach_type": F.when(speed >= 1.5, "crash").when(speed >= 0.75, "fast").when(speed >= 0.25, "normal").when(speed.isNotNull(), "grind"),
        "delta_flip_flag": (F.signum("approach_delta_60s") * F.signum("band_delta_0_30s")) < 0,
        "div_flag_at_touch": (F.col("approach_delta_60s") < 0) & (F.col("band_delta_0_30s") > 0),
        "bounce_return_30s_pct": F.try_divide(F.col("_in30") - price, price), "bounce_return_60s_pct": F.try_divide(F.col("_in60") - price, price),
        "max_penetration_pct": F.when(support, F.try_divide(lower - lowest, F.col("level_price"))),
        "wick_recovered_flag": F.when(support, (lower > lowest) & (F.col("_in30") >= lower)),
        "large_count_at_touch": F.col("large_trade_count_10s"), "large_delta_at_touch": F.col("large_trade_delta"),
        "large_delta_30s": buy - sell, "large_buy_ratio_30s": F.when(buy + sell > 0, buy / (buy + sell)),
        "large_rate_30s": rate, "large_vs_baseline_ratio": F.when((F.col("_large_count_before") > 0) & (rate > 0), rate / F.col("_large_count_before")),
        "large_buy_vs_sell_ratio": F.when((buy > 0) & (sell > 0), buy / sell),
        "compression_at_touch": _mean_of(before), "_change": _mean_of(last) - _mean_of(first),
        "cvd_60s_at_touch": F.col("_cvd"), "cvd_slope_into_touch": F.col("_cvd") - F.col("_cvd_before"),
        "spread_widening_into_touch": F.when(F.col("_spread_all") > 0, F.col("_spread_pre") > F.col("_spread_all") * 1.1),
        "spread_narrowing_after_touch": F.col("_spread_post") < F.col("spread_pct_at_touch") * 0.9,
        "price_vs_vwap_at_touch": F.when(price > F.col("_vwap") * 1.001, "above").when(price < F.col("_vwap") * 0.999, "below").when(F.col("_vwap").isNotNull(), "at"),
        "break_confirmed_30s": confirmed, "reclaim_after_break": F.when(confirmed, again), "reclaim_hold_30s": F.when(confirmed & again, held),
        "touch_outcome": F.when(~confirmed, "hold").when(again & held, "break_reclaim_hold").when(again, "break_reclaim_fail").otherwise("break"),
    })
    ratio = F.col("large_buy_ratio_30s")
    one = one.withColumns({
        "institutional_buy": F.coalesce((many >= 5) & (ratio > 0.6), F.lit(False)), "institutional_sell": F.coalesce((many >= 5) & (ratio < 0.4), F.lit(False)),
        "large_size_imbalance": F.coalesce(F.col("large_buy_vs_sell_ratio") > 1.5, F.lit(False)),
        "compression_trend_into_touch": F.when(change > 0.05, "tightening").when(change < -0.05, "loosening").when(change.isNotNull(), "flat"),
        "price_efficiency_0_30s": F.when(F.col("_volume_30s") > 0, F.abs(F.col("bounce_return_30s_pct") * price) / (F.col("_volume_30s") + 1e-9)),
    })
    return one.drop(*[c for c in one.columns if c.startswith("_")])


def _window_columns(has: set[str]) -> list[Column]:
    """What ``window_summary`` aggregates, as far as the stream has the columns."""
    order = F.when(F.col("last_price").isNotNull(), F.col("ts_ms"))
    means = {"relative_aggression_mean": "relative_aggression", "pct_at_ask_mean": "pct_at_ask", "pct_at_bid_mean": "pct_at_bid", "spread_pct_mean": "spread_pct", "compression_mean": "compression_index"}
    means |= {"confluence_mean": "ema_confluence_score", "atr_mean": "atr", "absorption_mean": "absorption_index"}
    sums = {"trades": "trade_count", "volume": "total_volume", "buy_volume": "buy_volume", "sell_volume": "sell_volume", "unknown_volume": "unknown_volume", "delta": "delta"}
    stable = [F.avg(asinh(F.col("absorption_index"))).alias("absorption_mean_asinh")] if "absorption_index" in has else []
    return [
        F.count("*").alias("points"), ((F.max("ts_ms") - F.min("ts_ms")) / 1000.0).alias("duration_s"),
        *[F.sum(c).alias(n) for n, c in sums.items() if c in has], *[F.avg(c).alias(n) for n, c in means.items() if c in has], *stable,
        F.min_by("last_price", order).alias("price_first"), F.max_by("last_price", order).alias("price_last"),
        F.min("last_price").alias("price_min"), F.max("last_price").alias("price_max"),
    ]


def _returns(out: DataFrame) -> DataFrame:
    change = F.col("price_last") - F.col("price_first")
    return out.withColumns({"return_abs": change, "return_pct": F.try_divide(change, F.col("price_first"))})


def window_summary(ticks: DataFrame, part: list[str]) -> DataFrame:
    """Flow, quality and price of the ticks of each window, as far as the stream has the columns."""
    return _returns(ticks.groupBy(*part).agg(*_window_columns(set(ticks.columns))))


def _marked(base: DataFrame, part: list[str]) -> DataFrame:
    """Ticks with what they begin or end in their level's band; a window's first row has nothing before it."""
    w = Window.partitionBy(*part).orderBy("ts_ms")
    inside = F.col("pos") == 0
    before = F.coalesce(F.lag(inside).over(w), F.lit(False))
    side = F.when(F.col("last_price") > F.col("level_price"), 1).when(F.col("last_price") < F.col("level_price"), -1).otherwise(0)
    below, above = F.col("level_type") == "support", F.col("level_type") == "resistance"
    beyond = F.when(below, F.col("pos") < 0).when(above, F.col("pos") > 0).otherwise(False)
    ahead = w.rowsBetween(0, 2)
    one = base.withColumns({"_side": side, "_in": inside, "_touch": inside & ~before}).withColumn("_was", F.lag("_side").over(w))
    return one.withColumns({
        "_cross": (F.col("_side") != 0) & (F.col("_was") != 0) & (F.col("_side") != F.col("_was")),
        "_again": inside & F.coalesce(F.lag(beyond).over(w), F.lit(False)),
        "_hold": (F.min(inside).over(ahead)) & (F.count("*").over(ahead) == 3),
    })


_LARGE = {"large_trade_count_10s": "band_large_count", "large_buy_volume_10s": "band_large_buy", "large_sell_volume_10s": "band_large_sell"}


def _band_columns(has: set[str], interval_s: float) -> list[Column]:
    """What ``band_summary`` aggregates of marked ticks."""
    inside = F.col("_in")

    def many(c: Column, name: str) -> Column:
        return F.count(F.when(c, 1)).alias(name)

    def total(c: str, name: str) -> Column:
        return F.sum(F.when(inside, F.col(c)).otherwise(0.0)).alias(name)

    return [
        (F.count(F.when(inside, 1)) * interval_s).alias("time_in_band_s"), (F.count("*") * interval_s / 60.0).alias("_minutes"),
        total("trade_count", "band_trades"), total("total_volume", "band_volume"), total("buy_volume", "band_buy_volume"), total("sell_volume", "band_sell_volume"), total("delta", "band_delta"),
        F.avg(F.when(inside, F.col("relative_aggression"))).alias("band_relative_aggression_mean"), *[total(c, n) for c, n in _LARGE.items() if c in has],
        many(F.col("_touch"), "touch_count"), many(F.col("_cross"), "cross_count"), many(F.col("_again"), "reclaim_attempts"), many(F.col("_again") & F.col("_hold"), "reclaim_holds_30s"),
    ]


def _band_rates(out: DataFrame) -> DataFrame:
    if set(_LARGE.values()) <= set(out.columns):
        buy, sell, n = F.col("band_large_buy"), F.col("band_large_sell"), F.col("band_large_count")
        out = out.withColumns({
            "band_large_delta": buy - sell, "band_large_buy_ratio": F.when(buy + sell > 0, buy / (buy + sell)),
            "band_large_rate_per_min": F.try_divide(n, F.col("_minutes")), "band_large_size": F.when(n > 0, (buy + sell) / n),
        })
    return out.drop("_minutes").withColumn("reclaim_hold_rate", F.try_divide(F.col("reclaim_holds_30s"), F.col("reclaim_attempts")))


def band_summary(base: DataFrame, interval_s: float = 10.0, part: list[str] = LEVEL) -> DataFrame:
    """What happened inside each level's band: time, flow, large trades, touches, crosses, reclaims and holds.

    ``part`` names the windows; a window's first row has nothing before it.
    """
    return _band_rates(_marked(base, part).groupBy(*part).agg(*_band_columns(set(base.columns), interval_s)))


def level_summary(ticks: DataFrame, part: list[str], interval_s: float = 10.0) -> DataFrame:
    """``window_summary`` and ``band_summary`` of each window, and its level, in one aggregation."""
    has = set(ticks.columns)
    level = [F.avg("level_price").alias("level_price"), F.first("level_type").alias("level_type")]
    out = _marked(ticks, part).groupBy(*part).agg(*_window_columns(has), *_band_columns(has, interval_s), *level)
    return _band_rates(_returns(out))


def band_rates(summary: DataFrame, minutes: Column) -> DataFrame:
    """Volume and trades a minute, shares a trade and the share of selling in large volume of a band summary."""
    sell = F.col("band_large_sell")
    return summary.withColumns({
        "volume_per_min": F.try_divide(F.col("band_volume"), minutes), "trades_per_min": F.try_divide(F.col("band_trades"), minutes),
        "shares_per_trade": F.try_divide(F.col("band_volume"), F.col("band_trades")), "large_sell_pct": F.try_divide(sell * 100, sell + F.col("band_large_buy")),
    })


def infer_interval(ticks: DataFrame) -> DataFrame:
    """Seconds between the ticks of each session: the median, or 10 where there are fewer than three ticks."""
    step = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy(*KEY).orderBy("ts_ms"))
    out = ticks.withColumn("_step", step).groupBy(*KEY).agg(F.percentile("_step", F.lit(0.5)).alias("_median"), F.count("*").alias("_n"))
    seconds = F.bround(F.col("_median") / 1000).cast("long")
    return out.select(*KEY, F.when((F.col("_n") >= 3) & (seconds > 0), seconds).otherwise(F.lit(10)).alias("interval_s"))
