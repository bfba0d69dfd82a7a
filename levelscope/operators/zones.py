"""Ticks against price levels: distance, zone events, touches and the episodes they open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clamp01, level_tags, marker_bias, parse_notes, price_mask, stack_state
from ..schemas import KEY
from .tape import carried, in_reach
from .ticks import tick_of

LEVEL = [*KEY, "level_id"]
SUCCESS_ATR, FAILURE_ATR, TIMEOUT_MS, BASELINE_MS = 0.50, 0.35, 300_000, 300_000


def _order() -> Window:
    return Window.partitionBy(*LEVEL).orderBy("ts_ms")


def active_levels(static: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """Levels in force from ``created_ts_ms`` on; of equal ids the first made counts."""
    every = static if added is None else static.unionByName(added, allowMissingColumns=True)
    first = Window.partitionBy(*LEVEL).orderBy("created_ts_ms", "level_price")
    return every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def zone_distance(ticks: DataFrame, levels: DataFrame) -> DataFrame:
    """Each priced tick with each level of its session that is in force.

    Sessions have few levels; the join is on the session, so ticks stay where they are.
    """
    t = ticks.where("last_price IS NOT NULL AND atr > 0").select(*KEY, "ts_ms", "last_price", "atr")
    joined = t.join(levels.select(*LEVEL, "level_price", "level_type", "level_width_atr", "created_ts_ms"), KEY).where("created_ts_ms <= ts_ms")
    d = F.col("last_price") - F.col("level_price")
    return joined.select(
        *LEVEL, "level_price", "level_type", "level_width_atr", "ts_ms", "last_price", "atr", d.alias("signed_distance"), (d / F.col("atr")).alias("signed_distance_atr"),
        F.abs(d / F.col("atr")).alias("abs_distance_atr"), (F.abs(d / F.col("atr")) <= F.col("level_width_atr")).alias("in_zone"),
    )


def zone_events(zone: DataFrame) -> DataFrame:
    """``event`` enter or exit, the side of the last entry, and touches confirmed so far."""
    one = F.lag("in_zone", 1, False).over(_order())
    two = F.lag("in_zone", 2, False).over(_order())
    event = F.when(F.col("in_zone") & ~one, "enter").when(~F.col("in_zone") & one, "exit")
    left = F.when(two & ~one & ~F.col("in_zone"), 1).otherwise(0)
    with_event = zone.withColumn("event", event).withColumn("_touch", left)
    side = F.when(F.col("event") == "enter", F.when(F.col("signed_distance") >= 0, "above").otherwise("below"))
    so_far = _order().rowsBetween(Window.unboundedPreceding, 0)
    return with_event.withColumn("entry_side", F.last(side, ignorenulls=True).over(so_far)).withColumn("touch_count", F.sum("_touch").over(so_far)).drop("_touch")


def resolution(ts: Column, move_atr: Column, exit_ts: Column, bias: Column, success: float = SUCCESS_ATR, failure: float = FAILURE_ATR, timeout_ms: int = TIMEOUT_MS) -> Column:
    """Why an episode ends at a tick: timeout first, then success, then failure; else null."""
    thesis = F.when(bias == "short", -move_atr).otherwise(move_atr)
    late = F.coalesce(ts >= exit_ts + timeout_ms, F.lit(False))
    return F.when(late, "timeout").when(thesis >= success, "threshold_hit").when(thesis <= -failure, "invalidation")


def outcome(trigger: Column) -> Column:
    return F.when(trigger == "threshold_hit", "win").when(trigger == "invalidation", "loss").when(trigger == "timeout", "scratch")


def episodes(events: DataFrame, bias: str = "long") -> DataFrame:
    """An episode for each zone visit that is resolved before the next one, with its metrics."""
    so_far = _order().rowsBetween(Window.unboundedPreceding, 0)
    seg = events.withColumn("seg", F.sum(F.when(F.col("event") == "enter", 1).otherwise(0)).over(so_far)).where("seg > 0")
    part = Window.partitionBy(*LEVEL, "seg").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    one = seg.withColumn("zone_entry_time", F.min("ts_ms").over(part)).withColumn("zone_exit_time", F.min(F.when(F.col("event") == "exit", F.col("ts_ms"))).over(part)).withColumn("entry_atr", F.first("atr").over(part))
    trigger = resolution(F.col("ts_ms"), F.col("signed_distance_atr"), F.col("zone_exit_time"), F.lit(bias))
    one = one.withColumn("trigger", trigger)
    first = F.first(F.when(F.col("trigger").isNotNull(), F.struct("ts_ms", "trigger")), ignorenulls=True).over(part)
    one = one.withColumn("_res", first).where("_res IS NULL OR ts_ms = _res.ts_ms")
    move = (F.col("last_price") - F.col("level_price")) / F.col("entry_atr") * (-1 if bias == "short" else 1)
    return (
        one.withColumn("move", move).groupBy(*LEVEL, "seg", "level_price", "level_type", "level_width_atr", "zone_entry_time", "entry_atr")
        .agg(
            F.max("zone_exit_time").alias("zone_exit_time"), F.min_by("entry_side", "ts_ms").alias("level_entry_side"),
            F.max("_res.ts_ms").alias("resolution_time"), F.max("_res.trigger").alias("resolution_trigger"),
            F.greatest(F.lit(0.0), F.max("move")).alias("mfe"), F.greatest(F.lit(0.0), -F.min("move")).alias("mae"),
            F.max_by("ts_ms", F.struct("move", -F.col("ts_ms"))).alias("_mfe_ts"), F.min(F.when(-F.col("move") >= FAILURE_ATR, F.col("ts_ms"))).alias("_fail_ts"),
        )
        .where("resolution_time IS NOT NULL")
        .select(
            F.sha2(F.concat_ws("|", "session_id", "level_id", F.col("zone_entry_time").cast("string")), 256).alias("episode_id"), *LEVEL, "level_price", "level_type", "level_width_atr", "level_entry_side",
            (F.col("zone_entry_time") - BASELINE_MS).alias("start_time"), "zone_entry_time", "zone_exit_time", "resolution_time", "resolution_trigger", outcome(F.col("resolution_trigger")).alias("outcome"),
            F.lit(bias).alias("direction_bias"), F.col("entry_atr").alias("atr_value"), "mfe", "mae", (F.col("_mfe_ts") - F.col("zone_entry_time")).alias("time_to_mfe_ms"), (F.col("_fail_ts") - F.col("zone_entry_time")).alias("time_to_failure_ms"),
        )
    )


def episode_ticks(found: DataFrame, events: DataFrame, stream: DataFrame) -> DataFrame:
    """The ticks of each episode from its baseline to its end, with their phase.

    Episodes meet ticks on their level and the slices of time that they cover.
    """
    e = found.select("episode_id", *LEVEL, "start_time", "zone_entry_time", "zone_exit_time", "resolution_time", "level_entry_side")
    z = events.select(*LEVEL, "ts_ms", "level_width_atr", "signed_distance_atr", "in_zone", "touch_count")
    inside = in_reach(e, z, F.col("start_time"), F.col("resolution_time"), keys=LEVEL)
    phase = F.when(F.col("ts_ms") < F.col("zone_entry_time"), "baseline").when(F.col("zone_exit_time").isNull() | (F.col("ts_ms") <= F.col("zone_exit_time")), "stress").otherwise("resolution")
    more = ("absorption_index", "spread_pct", "compression_index", "ema_confluence_score")
    s = stream.select(*KEY, "ts_ms", "last_price", "atr", "delta", "total_volume", "trade_count", "buy_volume", "sell_volume", "relative_aggression", *[c for c in more if c in stream.columns])
    return inside.withColumn("phase", phase).join(s, [*KEY, "ts_ms"])


def level_spine(ticks: DataFrame, interval_s: float = 10.0) -> DataFrame:
    """Penetration, crosses, oscillation and time in zone, by episode."""
    order = Window.partitionBy("episode_id").orderBy("ts_ms")
    so_far, minute = order.rowsBetween(Window.unboundedPreceding, 0), order.rangeBetween(-60_000, 0)
    d = F.col("signed_distance_atr")
    depth = F.when(F.col("level_entry_side") == "above", F.greatest(F.lit(0.0), -d)).when(F.col("level_entry_side") == "below", F.greatest(F.lit(0.0), d)).otherwise(F.abs(d))
    sign = F.when(d > 1e-12, 1).when(d < -1e-12, -1)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    changed = F.when(sign.isNotNull(), F.coalesce((sign != F.last(sign, ignorenulls=True).over(before)).cast("int"), F.lit(0)))
    one = ticks.withColumn("_chg", changed).withColumn("_in", F.when(F.abs(d) <= F.col("level_width_atr"), interval_s).otherwise(0.0))
    crosses = F.coalesce(F.sum("_chg").over(minute) - F.first("_chg", ignorenulls=True).over(minute), F.lit(0))
    total = F.sum("_in").over(so_far)
    return (
        one.withColumn("max_penetration_atr", F.max(depth).over(so_far)).withColumn("cross_count_60s", crosses).withColumn("cross_density", F.col("cross_count_60s") / 60.0)
        .withColumn("oscillation_amplitude_60s", F.max(d).over(minute) - F.min(d).over(minute)).withColumn("time_in_zone_60s", F.sum("_in").over(minute))
        .withColumn("time_in_zone_total", total).withColumn("avg_time_in_zone_per_touch", F.when(F.col("touch_count") > 0, total / F.col("touch_count")).otherwise(0.0)).drop("_chg", "_in")
    )


def smart_money(ticks: DataFrame, part: list[str] | None = None, floor_atr: float = 0.02, eps: float = 1e-9) -> DataFrame:
    """Cumulative delta, returns, volume against the baseline, divergence and trades against the move."""
    order = Window.partitionBy(*(part or ["episode_id"])).orderBy("ts_ms")
    three, six = order.rowsBetween(-2, 0), order.rowsBetween(-5, 0)
    has = F.lag("ts_ms").over(order).isNotNull()
    one = ticks.withColumn("cvd_10s", F.col("delta")).withColumn("cvd_30s", F.sum("delta").over(three)).withColumn("cvd_60s", F.sum("delta").over(six))
    for n in (30, 60):
        one = one.withColumn(f"cvd_{n}s_slope", F.when(has, F.col(f"cvd_{n}s") - F.lag(f"cvd_{n}s").over(order)).otherwise(0.0))
    one = one.withColumn("price_return_10s", F.coalesce(F.col("last_price") - F.lag("last_price").over(order), F.lit(0.0)))
    one = one.withColumn("price_return_60s", F.coalesce(F.col("last_price") - F.lag("last_price", 6).over(order), F.lit(0.0)))
    one = one.withColumn("return_norm", F.col("price_return_60s") / (F.col("atr") + eps)).withColumn("volume_60s", F.sum("total_volume").over(six)).withColumn("trade_count_60s", F.sum("trade_count").over(six))
    if part is None:
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        base = F.col("phase") == "baseline"
        for n, name in (("volume_60s", "vol"), ("trade_count_60s", "trade")):
            mean, dev = F.avg(F.when(base, F.col(n))).over(so_far), F.stddev_pop(F.when(base, F.col(n))).over(so_far)
            one = one.withColumn(f"baseline_{name}_mean", F.coalesce(mean, F.lit(0.0))).withColumn(f"{name}_zscore", F.when(dev > 0, (F.col(n) - mean) / (dev + eps)).otherwise(0.0))
        norm = F.when(F.col("baseline_vol_mean") > 0, F.col("cvd_60s") / (F.col("baseline_vol_mean") + eps)).otherwise(0.0)
        one = one.withColumn("delta_norm", norm)
        signs = [F.when(F.col(c) > 1e-12, 1).when(F.col(c) < -1e-12, -1).otherwise(0) for c in ("delta_norm", "return_norm")]
        one = one.withColumn("divergence_flag", (signs[0] != signs[1]).cast("int")).withColumn("divergence_score", F.when((F.abs("return_norm") > 0) | (F.abs("delta_norm") > 0), F.abs("delta_norm") / (F.abs("return_norm") + eps)).otherwise(0.0))
    move = F.greatest(F.abs("price_return_10s"), floor_atr * F.col("atr")) + eps
    return one.withColumn("buy_on_red", F.when(F.col("price_return_10s") < 0, F.col("buy_volume") / move).otherwise(0.0)).withColumn("sell_on_green", F.when(F.col("price_return_10s") > 0, F.col("sell_volume") / move).otherwise(0.0))


def dedup_markers(markers: DataFrame) -> DataFrame:
    """Of markers with the same time and type the first by id."""
    first = Window.partitionBy(*KEY, "ts_ms", "marker_type").orderBy("marker_id")
    return markers.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def marker_episodes(markers: DataFrame, ticks: DataFrame) -> DataFrame:
    """Episodes round markers: a level at the anchor tick's price, scanned from two minutes on."""
    m = dedup_markers(markers).withColumn("direction_bias", marker_bias(F.col("marker_type"), F.col("direction_bias"))).where("direction_bias IS NOT NULL").withColumnRenamed("ts_ms", "marker_ts_ms")
    t = ticks.where("last_price IS NOT NULL AND atr > 0").select(*KEY, "ts_ms", "last_price", "atr")
    tick = F.struct("last_price", "atr")
    both = m.withColumn("ts_ms", F.col("marker_ts_ms")).withColumn("_kind", F.lit(1)).unionByName(t.select(*KEY, "ts_ms", F.lit(0).alias("_kind"), tick.alias("_tick")), allowMissingColumns=True)
    first = t.groupBy(*KEY).agg(F.min_by(tick, "ts_ms").alias("_first"))
    anchored = carried(both, "_a", F.col("_tick"), ["ts_ms", "_kind"]).where("_kind = 1").join(first, KEY).withColumn("_a", F.coalesce("_a", "_first"))
    anchored = anchored.select(*m.columns, F.col("_a.last_price").alias("level_price"), F.col("_a.atr").alias("atr_value"))
    start, end = F.col("marker_ts_ms") - 120_000, F.col("marker_ts_ms") + 600_000
    timed = anchored.withColumn("zone_entry_time", start).withColumn("zone_exit_time", F.col("marker_ts_ms") + 120_000)
    inside = in_reach(timed, t.drop("atr"), start, end)
    move = (F.col("last_price") - F.col("level_price")) / F.col("atr_value")
    why = resolution(F.col("ts_ms"), move, F.col("zone_exit_time"), F.col("direction_bias"), timeout_ms=480_000)
    inside = inside.withColumn("trigger", F.when(F.col("ts_ms") >= F.col("zone_exit_time"), why)).withColumn("move", F.when(F.col("direction_bias") == "short", -move).otherwise(move))
    part = Window.partitionBy("marker_id")
    inside = inside.withColumn("_res", F.min(F.when(F.col("trigger").isNotNull(), F.struct("ts_ms", "trigger"))).over(part)).where("_res IS NULL OR ts_ms <= _res.ts_ms")
    out = inside.groupBy("marker_id", *KEY, "marker_type", "marker_ts_ms", "direction_bias", "level_price", "atr_value", "zone_entry_time", "zone_exit_time").agg(
        F.max("_res.ts_ms").alias("resolution_time"), F.max("_res.trigger").alias("resolution_trigger"), F.greatest(F.lit(0.0), F.max("move")).alias("mfe"), F.greatest(F.lit(0.0), -F.min("move")).alias("mae"),
        (F.max_by("ts_ms", F.struct("move", -F.col("ts_ms"))) - F.col("zone_entry_time")).alias("time_to_mfe_ms"), (F.min(F.when(-F.col("move") >= FAILURE_ATR, F.col("ts_ms"))) - F.col("zone_entry_time")).alias("time_to_failure_ms"),
    )
    return out.withColumn("end_time", F.coalesce("resolution_time", F.col("marker_ts_ms") + 600_000)).withColumn("outcome", outcome(F.col("resolution_trigger")))


def baseline_ticks(found: DataFrame, events: DataFrame) -> DataFrame:
    """The ticks of each episode before its entry at which its level was in force."""
    e = found.select("episode_id", *LEVEL, "start_time", "zone_entry_time")
    return in_reach(e, events.select(*LEVEL, "ts_ms", "signed_distance_atr"), F.col("start_time"), F.col("zone_entry_time") - 1, keys=LEVEL)


def tf_rows(ticks: DataFrame, confluence_ref: float = 0.25) -> DataFrame:
    """Structure of the averages of one time frame at each tick of an episode (EMA 9, 20, 30, 200; an ATR).

    Slopes are over the episode's own ticks: against the one 60 s before or the latest before that.
    """
    e9, e20, e30, e200, price, atr = (F.col(c) for c in ("ema9", "ema20", "ema30", "ema200", "last_price", "atr"))
    w = Window.partitionBy("episode_id", "timeframe").orderBy("ts_ms").rangeBetween(-300_000, -60_000)
    one = ticks.withColumn("_then", F.last(F.struct("ts_ms", "ema9", "ema20", "ema30")).over(w))
    seconds = (F.col("ts_ms") - F.col("_then.ts_ms")) / 1000.0
    slopes = {f"slope_ema{p}_60s": F.coalesce((F.col(f"ema{p}") - F.col(f"_then.ema{p}")) / seconds, F.lit(0.0)) for p in (9, 20, 30)}
    compression = F.when(atr > 0, (F.abs(e9 - e20) + F.abs(e20 - e30)) / atr).otherwise(0.0)
    return one.withColumns(slopes | {
        "ema_spread_9_20": e9 - e20, "ema_spread_20_30": e20 - e30, "compression_index": compression, "ema_confluence_score": clamp01(1 - compression / confluence_ref),
        "stack_state": stack_state(price, e9, e20, e30), "price_vs_emas": price_mask(price, e9, e20, e30, e200), "stretch_200_atr": F.when(atr > 0, (price - e200) / atr).otherwise(0.0),
    }).drop("_then")


def episode_tick(found: DataFrame, stream: DataFrame, trades: DataFrame) -> DataFrame:
    """An episode's ticks on their own: the last price is that of trades since its start, carried from tick to tick.

    ``stream`` gives what the ticks know besides; before the first trade of an episode the price is null.
    """
    e = found.select("episode_id", *KEY, "start_time", "zone_entry_time", "zone_exit_time", "resolution_time")
    inside = in_reach(e, stream.drop("last_price"), F.col("start_time"), F.col("resolution_time"))
    last = trades.groupBy(*KEY, tick_of(F.col("ts_ms")).alias("ts_ms")).agg(F.max_by(F.struct(F.col("price").alias("price"), F.col("ts_ms").alias("at")), F.struct("ts_ms", "seq")).alias("_p"))
    w = Window.partitionBy("episode_id").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("_p.at") >= F.col("start_time"), F.col("_p.price"))
    phase = F.when(F.col("ts_ms") < F.col("zone_entry_time"), "baseline").when(F.col("zone_exit_time").isNull() | (F.col("ts_ms") <= F.col("zone_exit_time")), "stress").otherwise("resolution")
    out = inside.join(last, [*KEY, "ts_ms"], "left").withColumns({"last_price": F.last(own, ignorenulls=True).over(w), "phase": phase, "sequence_id": F.row_number().over(Window.partitionBy("episode_id").orderBy("ts_ms")) - 1})
    return out.drop("_p", "start_time", "zone_entry_time", "zone_exit_time", "resolution_time")


def marker_commands(markers: DataFrame) -> DataFrame:
    """Commands for markers: a level for each price tag from the marker's start on, and the marker itself.

    A marker whose notes ask for it (``skip_episode``) gets a blank bias, which keeps it from
    opening an episode unless its type implies one. At equal times levels come before markers.
    """
    n = parse_notes(F.col("notes"))
    one = markers.withColumn("n", n)
    none = F.lit(None)
    level = one.select(*KEY, "ts_ms", "marker_type", F.explode(F.coalesce("n.price_tags", F.array().cast("array<struct<price:double,kind:string>>"))).alias("t")).where("t.price IS NOT NULL")
    kind = F.coalesce(F.nullif("t.kind", F.lit("")), F.lit("manual"))
    levels = level.select(
        *KEY, "ts_ms", F.lit("add_level").alias("type"), none.cast("string").alias("marker_type"), none.cast("string").alias("marker_id"), none.cast("string").alias("direction_bias"),
        F.concat(F.lit("from_marker:"), "marker_type").alias("notes"), F.col("t.price").alias("level_price"), kind.alias("level_type"), F.lit(0.25).alias("level_width_atr"),
        F.concat_ws(":", F.lit("marker_level"), "symbol", F.col("ts_ms").cast("string"), F.col("t.price").cast("string"), kind).alias("level_id"),
    )
    bias = F.when(~F.coalesce(F.col("n.skip_episode"), F.lit(False)), F.coalesce("direction_bias", "n.direction_bias"))
    own = one.select(
        *KEY, "ts_ms", F.lit("add_marker").alias("type"), "marker_type", F.concat_ws(":", F.lit("marker"), "symbol", F.col("ts_ms").cast("string"), "marker_type").alias("marker_id"), bias.alias("direction_bias"), "notes",
        none.cast("double").alias("level_price"), none.cast("string").alias("level_type"), none.cast("double").alias("level_width_atr"), none.cast("string").alias("level_id"),
    )
    return levels.unionByName(own)


def commanded(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The levels and the markers that commands add, in the schemas of levels and markers."""
    made = F.coalesce("level_id", F.concat_ws(":", F.lit("manual"), "symbol", F.col("ts_ms").cast("string"), F.col("level_price").cast("string")))
    levels = commands.where("type = 'add_level'").select(*KEY, made.alias("level_id"), "level_price", "level_type", F.coalesce("level_width_atr", F.lit(0.25)).alias("level_width_atr"), F.col("ts_ms").alias("created_ts_ms"))
    named = F.coalesce("marker_id", F.concat_ws(":", F.lit("marker"), "symbol", F.col("ts_ms").cast("string"), "marker_type"))
    markers = commands.where("type = 'add_marker'").select(named.alias("marker_id"), *KEY, "ts_ms", "marker_type", "direction_bias", "notes")
    return levels, markers


def merge_labels(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Episodes plus manual labels (episode_id, manual_outcome, setup_type, confidence)."""
    return found.join(labels.select("episode_id", "manual_outcome", "setup_type", "confidence"), "episode_id", "left")
