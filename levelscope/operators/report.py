"""The session report's second layer: reclaims, main support, positive touches, checklists and moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import first_tag, level_tags, parse_notes, scenario, velocity_bucket
from ..schemas import KEY
from .tape import in_reach
from .timeline import BAND, LEVEL, level_summary, window_summary
from .windows import COUNTDOWN

#: A touch is positive if price is this much further in the level's direction 30 s later.
POSITIVE_BOUNCE = 0.005
SNAPBACK_MS = 120_000


def level_pairs(levels: DataFrame) -> DataFrame:
    """Each level with the next deeper one of its session."""
    down = Window.partitionBy(*KEY).orderBy(F.desc("level_price"), "level_id")
    deeper = F.lead(F.struct("level_id", "level_price")).over(down)
    out = levels.where("level_price > 0").withColumn("_deeper", deeper).where("_deeper IS NOT NULL")
    return out.select(*LEVEL, "level_price", F.col("_deeper.level_id").alias("deeper_id"), F.col("_deeper.level_price").alias("deeper_price"))


def reclaim_packets(stream: DataFrame, levels: DataFrame, band: float = BAND) -> DataFrame:
    """A row for each level that price came back to after it had tagged the next deeper one.

    The tag is the first tick in the deeper band; the reclaim is the first later tick at or over
    the level's own band's lower edge after one below it.
    """
    ticks = stream.where("last_price IS NOT NULL").join(level_pairs(levels), KEY)
    part = Window.partitionBy(*LEVEL)
    w = part.orderBy("ts_ms")
    price, lower, deeper = F.col("last_price"), F.col("level_price") * (1 - band), F.col("deeper_price")
    tagged = price.between(deeper * (1 - band), deeper * (1 + band))
    one = ticks.withColumns({"_tag": F.min(F.when(tagged, F.col("ts_ms"))).over(part), "_atr6": F.avg("atr").over(w.rowsBetween(0, 5))})
    after = F.col("ts_ms") >= F.col("_tag")
    below = F.max(F.when(after & (price < lower), 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    soon, minute = w.rowsBetween(0, 2), w.rowsBetween(0, 5)
    one = one.withColumns({
        "_back": after & (below == 1) & (price >= lower), "_tag_atr": F.max(F.when(F.col("ts_ms") == F.col("_tag"), F.col("_atr6"))).over(part),
        "band_delta_30s": F.sum("delta").over(soon), "band_delta_60s": F.sum("delta").over(minute),
        "rel_aggr_30s": F.avg("relative_aggression").over(soon), "rel_aggr_60s": F.avg("relative_aggression").over(minute),
        "hold_30s": F.min(price).over(soon) >= lower, "hold_60s": F.min(price).over(minute) >= lower,
    })
    first = one.where("_back").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    took = F.col("ts_ms") - F.col("_tag")
    drop = F.when(F.col("_tag_atr") > 0, F.abs(deeper - F.col("level_price")) / F.col("_tag_atr"))
    out = first.select(
        *LEVEL, "level_price", "deeper_id", "deeper_price", F.col("_tag").alias("tag_ts_ms"), F.col("ts_ms").alias("reclaim_ts_ms"), took.alias("time_to_reclaim_ms"), (took <= SNAPBACK_MS).alias("snapback"),
        "band_delta_30s", "band_delta_60s", "rel_aggr_30s", "rel_aggr_60s", "hold_30s", "hold_60s", (deeper / F.col("level_price") - 1).alias("drop_pct"), drop.alias("drop_atr"),
    )
    speed = F.col("drop_atr") / F.greatest(F.lit(1e-9), F.col("time_to_reclaim_ms") / 60_000.0)
    return out.withColumn("flush", (F.col("drop_atr") >= 1.0) & (speed >= 0.75))


def reclaim_id(level: Column, deeper: Column, ts: Column) -> Column:
    return F.concat_ws(":", F.lit("reclaim"), level.cast("string"), deeper.cast("string"), ts.cast("string"))


def main_support(levels: DataFrame, summary: DataFrame, flips: DataFrame, reclaims: DataFrame) -> DataFrame:
    """Points of each level as a support, the session's main one, and the level snapped back to.

    ``summary`` and ``flips`` are those of the timeline. Of equal levels the first created, then the first by id, is the main one.
    """
    flow = (F.col("band_delta_30s") > 0) & (F.col("rel_aggr_30s") > 0.10)
    back = reclaims.groupBy(*LEVEL).agg(F.sum(
        F.when(F.col("hold_30s"), 2).otherwise(0) + F.when(flow, 1).otherwise(0) + F.when(F.col("snapback"), 1).otherwise(0)
    ).alias("_back"), F.max(F.when(F.col("snapback") & F.col("hold_30s"), 1)).alias("_snapped"))
    one = levels.select(*LEVEL, "level_price", "level_type", "created_ts_ms").join(summary.select(*LEVEL, "rejects", "breaks"), LEVEL, "left").join(flips, LEVEL, "left").join(back, LEVEL, "left")
    one = one.fillna(0, ["rejects", "breaks", "_back"])
    turned = (F.col("level_type") == "support") & F.coalesce("role_flip", F.lit(False))
    score = F.when(F.col("rejects") - F.col("breaks") >= 2, 1).otherwise(0) - F.when(turned, 2).otherwise(0) - F.col("breaks") + F.col("_back")
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), "created_ts_ms", "level_id"))
    focus = F.when(F.col("_snapped") == 1, F.row_number().over(Window.partitionBy(*KEY, "_snapped").orderBy(F.desc("level_price"))) == 1)
    one = one.withColumn("score", score).withColumns({"main": rank == 1, "focus": F.coalesce(focus, F.lit(False))})
    return one.select(*LEVEL, "level_price", "score", "main", "focus")


def touch_flags() -> dict[str, Column]:
    return {
        "pos_aggr": F.col("rel_aggr_0_30s") > 0, "pos_delta": F.col("band_delta_0_30s") > 0, "high_compression": F.col("compression_at_touch") >= 1.0, "delta_flip": F.col("delta_flip_flag"),
        "div": F.col("div_flag_at_touch"), "controlled_approach": F.col("approach_type").isin("grind", "normal"), "from_above": F.col("from_side") == "above",
    }


def positive_touches(packets: DataFrame, outcomes: DataFrame, least: float = POSITIVE_BOUNCE) -> DataFrame:
    """Touches that price bounced from, with their scenario, flags and combination of flags.

    ``outcomes`` (LEVEL, level_outcome) tells how each level ended; a level without one is pending.
    """
    one = packets.join(outcomes.select(*LEVEL, "level_outcome"), LEVEL, "left").withColumn("scenario", scenario(F.coalesce("level_type", F.lit("")), F.coalesce("level_outcome", F.lit(""))))
    bounce = F.col("bounce_return_30s_pct")
    short = F.startswith(F.col("scenario"), F.lit("short_"))
    flags = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in touch_flags().items()])))
    good = one.where(F.when(short, bounce <= -least).otherwise(bounce >= least))
    return good.withColumn("flags", flags).withColumn("combo", F.array_join("flags", "+"))


def positive_ledger(positive: DataFrame, part: list[str] = KEY, most: int = 10) -> DataFrame:
    """Per session and scenario: how many touches, each flag's count, and the most frequent combinations.

    A row has kind ``touches``, ``flag`` or ``combo``, a name and a count; combos have a rank too.
    """
    keys = [*part, "scenario"]
    touches = positive.groupBy(*keys).agg(F.count("*").alias("n")).withColumns({"kind": F.lit("touches"), "name": F.lit("all"), "rank": F.lit(None).cast("int")})
    flags = positive.select(*keys, F.explode("flags").alias("name")).groupBy(*keys, "name").agg(F.count("*").alias("n")).withColumns({"kind": F.lit("flag"), "rank": F.lit(None).cast("int")})
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "name")
    combos = positive.where("combo <> ''").groupBy(*keys, F.col("combo").alias("name")).agg(F.count("*").alias("n")).withColumns({"kind": F.lit("combo"), "rank": F.row_number().over(w)}).where(F.col("rank") <= most)
    columns = [*keys, "kind", "name", "n", "rank"]
    return touches.select(columns).unionByName(flags.select(columns)).unionByName(combos.select(columns))


def pattern_index(positive: DataFrame, most: int = 20) -> DataFrame:
    """Flags and combinations of positive touches over all sessions, by scenario: counts, sessions, tickers; the top combinations."""
    tall = positive.select("scenario", "session_id", "symbol", F.explode(F.concat(
        F.array(F.struct(F.lit("touches").alias("kind"), F.lit("all").alias("name"))), F.transform("flags", lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("name"))),
        F.when(F.col("combo") != "", F.array(F.struct(F.lit("combo").alias("kind"), F.col("combo").alias("name")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")),
    )).alias("x"))
    out = tall.groupBy("scenario", "x.kind", "x.name").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("symbol").alias("tickers"))
    w = Window.partitionBy("scenario", "kind").orderBy(F.desc("n"), "name")
    return out.withColumn("rank", F.row_number().over(w)).where((F.col("kind") != "combo") | (F.col("rank") <= most))


def pattern_compare(positive: DataFrame) -> DataFrame:
    """Share of a scenario's positive touches with each flag, session by session.

    Only scenarios that every session has are compared; if there is none, all of them are.
    """
    sessions = positive.select("session_id").distinct()
    per = positive.groupBy("scenario", "session_id").agg(F.count("*").alias("touches"), *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in touch_flags().items()])
    wide = F.expr(f"stack({len(touch_flags())}, {', '.join(f"'{n}', {n}" for n in touch_flags())}) AS (flag, rate)")
    n = sessions.agg(F.count("*").alias("_all"))
    shared = per.groupBy("scenario").agg(F.count("*").alias("_has")).crossJoin(F.broadcast(n)).withColumn("_shared", F.col("_has") == F.col("_all"))
    some = shared.agg(F.max("_shared").alias("_some"))
    kept = shared.crossJoin(F.broadcast(some)).where(F.col("_shared") | ~F.col("_some")).select("scenario", "_shared")
    return per.select("scenario", "session_id", "touches", wide).join(kept, "scenario").withColumnRenamed("_shared", "shared")


def summary_flags(summary: DataFrame) -> DataFrame:
    """Hints for an auditor from a band summary, with a score of -3 to 3."""
    delta, hold, touches = F.col("band_delta"), F.col("reclaim_hold_rate"), F.col("touch_count")
    aggression = F.coalesce("band_relative_aggression_mean", "relative_aggression_mean") if "relative_aggression_mean" in summary.columns else F.col("band_relative_aggression_mean")
    tests = [
        (delta > 0, "green: band_delta_positive", 1), (delta < 0, "red: band_delta_negative", -1), (aggression > 0.10, "green: aggression_positive", 1), (aggression < -0.10, "red: aggression_negative", -1),
        (hold >= 0.70, "green: reclaim_hold_rate_high", 1), (hold <= 0.30, "red: reclaim_hold_rate_low", -1), (touches >= 3, "info: multiple_touches", 0),
    ]
    score = sum((F.when(t, p).otherwise(0) for t, _, p in tests), F.lit(0))
    return summary.withColumns({"flag_score": score, "flags": F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n, _ in tests]))})


def checklist(between: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Compression before a moment and its trend into it, and the reaction of the last window.

    ``between`` has compression_mean of the whole watch; ``windows`` has a row a countdown window
    (``window`` counts up to the moment) with compression_mean, band_delta and relative_aggression_mean.
    """
    reaction = F.struct("band_delta", "relative_aggression_mean")
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("window")))
    own = windows.withColumn("_back", back).groupBy(*keys).agg(
        F.min_by("compression_mean", "window").alias("_early"), F.max_by("compression_mean", "window").alias("_late"),
        F.max(F.when(F.col("_back") == 1, reaction)).alias("_last"), F.max(F.when(F.col("_back") == 2, reaction)).alias("_before"),
    )
    one = between.select(*keys, "compression_mean").join(own, keys, "left")
    mean, change = F.col("compression_mean"), F.col("_late") - F.col("_early")
    delta, aggression = F.col("_last.band_delta"), F.col("_last.relative_aggression_mean")
    known = delta.isNotNull() & aggression.isNotNull()
    return one.select(
        *keys, "compression_mean", F.when(mean >= 0.75, "high").when(mean <= 0.35, "low").when(mean.isNotNull(), "mid").alias("compression_level"), change.alias("compression_change"),
        F.when(change > 0.05, "tightening").when(change < -0.05, "loosening").when(change.isNotNull(), "flat").alias("compression_trend"),
        delta.alias("band_delta_last30s"), aggression.alias("rel_aggr_last30s"), F.col("_before.band_delta").alias("band_delta_last60s"), F.col("_before.relative_aggression_mean").alias("rel_aggr_last60s"),
        F.when(known, F.when((delta > 0) & (aggression > 0.10), "bullish").when((delta < 0) & (aggression < -0.10), "bearish").otherwise("mixed")).alias("reaction"),
    )


#: Averages that a moving level can follow, and their columns; a longer time frame has a suffix.
INDICATORS = {"vwap": "vwap_session", "ema9": "ema9", "ema20": "ema20", "ema30": "ema30", "ema200": "ema200"}
SUFFIXES = {"2m": "_2m", "3m": "_3m"}
CHAIN_SCHEMA = "level_chain_v1"


def indicator_value(name: Column, timeframe: Column, columns: list[str]) -> Column:
    """The tick's value of a named average in its time frame; null where it isn't set or unknown."""
    out = F.lit(None).cast("double")
    for indicator, base in INDICATORS.items():
        for tf, suffix in [("", ""), *SUFFIXES.items()]:
            column = base if indicator == "vwap" else base + suffix
            if column in columns:
                in_frame = timeframe == tf if tf else ~F.coalesce(timeframe, F.lit("1m")).isin(*SUFFIXES)
                out = F.when((name == indicator) & in_frame, F.when(F.col(column) > 0, F.col(column))).otherwise(out)
    return out


def chain_nodes(markers: DataFrame, band: float = BAND) -> DataFrame:
    """Levels that markers watch, chained in order of their watch's start and price.

    A marker whose notes name the chain schema qualifies, or one with a chain, watch times and a
    level; its end must lie after its start. A marker of indicators is a node for each of them.
    """
    n = parse_notes(F.col("notes"))
    one = markers.withColumn("n", n).withColumns({"_tag": first_tag(F.col("n.price_tags")), "watch_start_ts_ms": F.col("ts_ms"), "watch_end_ts_ms": F.col("n.end_ts_ms")})
    moving = (F.col("n.level_type") == "indicator") & (F.size("n.indicators") > 0)
    moving = F.coalesce(moving, F.lit(False))
    watched = F.col("n.watch_start_ts_ms").isNotNull() & F.col("n.watch_end_ts_ms").isNotNull() & (F.col("_tag.price").isNotNull() | moving)
    chained = (F.col("n.schema") == CHAIN_SCHEMA) | watched
    kept = one.where(F.coalesce(chained, F.lit(False)) & (F.col("watch_end_ts_ms") > F.col("watch_start_ts_ms")) & (moving | F.col("_tag.price").isNotNull()))
    indicators = F.when(moving, F.col("n.indicators")).otherwise(F.array(F.lit(None).cast("string")))
    tall = kept.withColumn("_moving", moving).withColumn("indicator", F.explode(indicators))
    out = tall.select(
        *KEY, F.coalesce(F.nullif(F.trim("n.chain_id"), F.lit("")), F.lit("default")).alias("chain_id"), "marker_id", "watch_start_ts_ms", "watch_end_ts_ms",
        F.when(~F.col("_moving"), F.col("_tag.price")).alias("level_price"), F.lower("_tag.kind").alias("level_type"), F.col("n.level_outcome").alias("level_outcome"),
        F.coalesce("n.band_pct", F.lit(band)).alias("band_pct"), "indicator", F.coalesce("n.indicator_timeframe", F.lit("1m")).alias("indicator_timeframe"),
    )
    order = Window.partitionBy(*KEY, "chain_id").orderBy("watch_start_ts_ms", F.coalesce("level_price", F.lit(0.0)), "marker_id", "indicator")
    return out.withColumn("position", F.row_number().over(order))


NODE = [*KEY, "chain_id", "position"]


def node_ticks(stream: DataFrame, nodes: DataFrame, whole: bool = False) -> DataFrame:
    """Priced ticks of each node's watch (or of its whole session), with its band at that tick.

    The band of an indicator moves with it; ticks at which it isn't set are left out. Watches
    meet the ticks of the slices of time that they cover.
    """
    watch = nodes.select(*NODE, "watch_start_ts_ms", "watch_end_ts_ms", F.col("level_price").alias("_fixed"), "level_type", "band_pct", "indicator", "indicator_timeframe")
    priced = stream.where("last_price IS NOT NULL").drop("level_price", "level_type")
    ticks = priced.join(watch, KEY) if whole else in_reach(watch, priced, F.col("watch_start_ts_ms"), F.col("watch_end_ts_ms"))
    price = F.coalesce("_fixed", indicator_value(F.col("indicator"), F.col("indicator_timeframe"), stream.columns))
    ticks = ticks.withColumn("level_price", price).where("level_price IS NOT NULL").drop("_fixed", "indicator", "indicator_timeframe")
    ticks = ticks.withColumns({"lower": F.col("level_price") * (1 - F.col("band_pct")), "upper": F.col("level_price") * (1 + F.col("band_pct"))})
    pos = F.when(F.col("last_price") < F.col("lower"), -1).when(F.col("last_price") > F.col("upper"), 1).otherwise(0)
    return ticks.withColumn("pos", pos)


def watch_summary(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Flow, price and band of each watch, with the auditor's flags: one pass over its ticks."""
    return summary_flags(level_summary(ticks, keys))


def watch_countdown(ticks: DataFrame, keys: list[str], windows: tuple = COUNTDOWN) -> DataFrame:
    """The summary of each countdown window to the watch's end, clipped to the watch."""
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("window"), F.lit(a).alias("begin_s"), F.lit(b).alias("end_s")) for k, (a, b) in enumerate(windows)])).alias("w")
    own = ticks.select("*", table)
    end = F.col("watch_end_ts_ms")
    low, high = F.greatest("watch_start_ts_ms", end - F.col("w.begin_s") * 1000), end - F.col("w.end_s") * 1000
    inside = own.where((low < high) & F.col("ts_ms").between(low, high)).withColumn("window", F.col("w.window")).drop("w")
    return watch_summary(inside, [*keys, "window"])


def tag_windows(markers: DataFrame, band: float = BAND) -> DataFrame:
    """A watch for each price tag of each marker that has an end after its start; ``position`` numbers the tags."""
    one = markers.withColumn("n", parse_notes(F.col("notes"))).where(F.col("n.end_ts_ms") > F.col("ts_ms"))
    tall = one.select(*KEY, "marker_id", F.col("ts_ms").alias("watch_start_ts_ms"), F.col("n.end_ts_ms").alias("watch_end_ts_ms"), F.coalesce("n.band_pct", F.lit(band)).alias("band_pct"), F.posexplode(level_tags(F.col("n.price_tags"))).alias("_at", "t"))
    none = F.lit(None).cast("string")
    return tall.select(*KEY, F.col("marker_id").alias("chain_id"), (F.col("_at") + 1).alias("position"), "marker_id", "watch_start_ts_ms", "watch_end_ts_ms", F.col("t.price").alias("level_price"), F.col("t.kind").alias("level_type"), "band_pct", none.alias("indicator"), none.alias("indicator_timeframe"))


def watch_report(stream: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each node's watch: its summary, its countdown, and its checklist."""
    ticks = node_ticks(stream, nodes)
    between, windows = watch_summary(ticks, NODE), watch_countdown(ticks, NODE)
    return between, windows, checklist(between, windows, NODE)


#: Windows round a moment, in seconds from it.
MOMENT = (("pre_60s", -60, 0), ("during_30s", 0, 30), ("post_90s", 30, 120))


def event_markers(stream: DataFrame, markers: DataFrame, band: float = BAND) -> DataFrame:
    """Summaries before, during and after each marker without an end after its start, round its level."""
    n = parse_notes(F.col("notes"))
    one = markers.withColumn("n", n).where(~F.coalesce(F.col("n.end_ts_ms") > F.col("ts_ms"), F.lit(False)))
    tag = first_tag(F.col("n.price_tags"))
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(a).alias("begin_s"), F.lit(b).alias("end_s")) for k, a, b in MOMENT])).alias("w")
    none = F.lit(None).cast("string")
    moments = one.select(*KEY, "marker_id", "ts_ms", tag["price"].alias("level_price"), F.lower(tag["kind"]).alias("level_type"), table)
    nodes = moments.select(
        *KEY, F.concat_ws(":", "marker_id", "w.name").alias("chain_id"), F.lit(1).alias("position"), (F.col("ts_ms") + F.col("w.begin_s") * 1000).alias("watch_start_ts_ms"), (F.col("ts_ms") + F.col("w.end_s") * 1000).alias("watch_end_ts_ms"),
        "level_price", "level_type", F.lit(band).alias("band_pct"), none.alias("indicator"), none.alias("indicator_timeframe"),
    )
    out = watch_summary(node_ticks(stream, nodes), NODE).drop("position")
    return out.withColumns({"marker_id": F.substring_index("chain_id", ":", 1), "window": F.substring_index("chain_id", ":", -1)}).drop("chain_id")


def move_verdict(moves: DataFrame) -> DataFrame:
    """Speed, direction and flow of moves (a window summary each), in one line."""
    minutes = F.greatest(F.lit(1e-9), (F.col("end_ts_ms") - F.col("start_ts_ms")) / 60_000.0)
    by_atr = F.when(F.col("atr_mean") > 0, F.abs("return_abs") / F.col("atr_mean") / minutes)
    speed = F.when(by_atr.isNotNull() | F.col("return_pct").isNotNull(), velocity_bucket(by_atr, F.col("return_pct") / minutes))
    imbalance = F.abs("delta") / (F.col("volume") + 1e-9)
    side = F.when(F.col("delta") > 0, "buy").when(F.col("delta") < 0, "sell").otherwise("flat")
    strength = F.when(imbalance >= 0.35, "strong").when(imbalance >= 0.15, "moderate").otherwise("balanced")
    direction = F.when(F.col("return_abs") > 0, "up").when(F.col("return_abs") < 0, "down").when(F.col("return_abs") == 0, "flat")
    one = moves.withColumns({"velocity_bucket": speed, "direction": direction, "flow_side": side, "flow_strength": strength, "flow_imbalance": imbalance})
    return one.withColumn("verdict", F.concat_ws(" / ", "velocity_bucket", "direction", F.concat_ws("_", "flow_side", "flow_strength")))


def chain_moves(stream: DataFrame, nodes: DataFrame) -> DataFrame:
    """The move from each node's end to the next one's start, where there is a gap."""
    before = F.lag("watch_end_ts_ms").over(Window.partitionBy(*KEY, "chain_id").orderBy("position"))
    gaps = nodes.withColumn("_from", before).where(F.col("_from") < F.col("watch_start_ts_ms")).select(*NODE, F.col("_from").alias("start_ts_ms"), F.col("watch_start_ts_ms").alias("end_ts_ms"))
    inside = in_reach(gaps, stream.where("last_price IS NOT NULL"), F.col("start_ts_ms"), F.col("end_ts_ms"))
    out = window_summary(inside, [*NODE, "start_ts_ms", "end_ts_ms"])
    return move_verdict(out)


def level_chains(stream: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row a node, flat: its watch, its checklist, the move to it and its whole session.

    Columns of the watch carry no prefix, those of the move ``move_`` and of the session ``session_``.
    """
    between, _, checks = watch_report(stream, nodes)
    whole = watch_summary(node_ticks(stream, nodes, whole=True), NODE)
    moves = chain_moves(stream, nodes)

    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*NODE, *[F.col(c).alias(prefix + c) for c in df.columns if c not in NODE])

    head = nodes.select(*NODE, "marker_id", "watch_start_ts_ms", "watch_end_ts_ms", "level_outcome", "band_pct", "indicator", "indicator_timeframe")
    out = head.join(between, NODE, "left").join(checks.drop("compression_mean"), NODE, "left")
    return out.join(prefixed(moves, "move_"), NODE, "left").join(prefixed(whole, "session_"), NODE, "left")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that any flat file format can hold the table."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
    return df.withColumns({n: F.to_json(n) for n in nested})
