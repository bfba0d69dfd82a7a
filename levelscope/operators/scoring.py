"""Rule tables over touch packets: touch scores, level statistics, flags and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import asinh, bucket
from ..schemas import KEY
from .timeline import LEVEL


def _w() -> Window:
    return Window.partitionBy(*LEVEL).orderBy("touch_number")


def steps(x: Column, *rules: tuple[str, float, int]) -> Column:
    """Points of the first rule (comparison, bound, points) that holds; 0 if none does."""
    out = None
    for side, bound, points in rules:
        test = x >= bound if side == ">=" else x <= bound if side == "<=" else x < bound if side == "<" else x > bound
        out = F.when(test, points) if out is None else out.when(test, points)
    return F.coalesce(out, F.lit(0))


def touch_points() -> dict[str, Column]:
    """Points of a touch of a support, by rule."""
    bounce, aggr, large = F.col("bounce_return_30s_pct"), F.col("rel_aggr_0_30s"), F.col("large_count_30s")
    flow = asinh(F.col("band_delta_0_30s") / 50000.0) * 4
    sell = F.col("institutional_sell")
    ratio = F.coalesce(F.col("large_buy_ratio_30s") >= 0.55, F.lit(False))
    by_ratio = F.when(ratio, 3).otherwise(0) + F.when(ratio & (aggr > 0), 4).otherwise(0)
    return {
        "delta30": F.bround(F.greatest(F.lit(-6.0), F.least(F.lit(6.0), flow))).cast("int"),
        "aggression": steps(aggr, (">=", 0.20, 3), ("<=", -0.20, -3), (">=", 0.05, 1), ("<=", -0.05, -1)),
        "bounce30": steps(bounce, (">=", 0.02, 6), (">=", 0.01, 3), (">=", 0.005, 1), ("<=", -0.01, -6), ("<=", -0.005, -2)),
        "large ratio": by_ratio,
        "large delta": steps(F.col("large_delta_30s"), (">=", 20_000, 3), ("<=", -20_000, -4)),
        "large count": steps(large, (">=", 50, 3), (">=", 20, 2)),
        "institutions": F.when(F.col("institutional_buy"), 4).otherwise(0) + F.when(sell, -6).otherwise(0),
        "absorbed selling": F.when(sell & (bounce > 0), 8).when(sell & (bounce < 0), -3).otherwise(0),
        "break": F.when(F.col("break_confirmed_30s"), F.when(F.coalesce(F.col("reclaim_hold_30s"), F.lit(False)), -2).otherwise(-8)).otherwise(0),
        "compression": steps(F.col("compression_at_touch"), (">=", 1.0, 3), (">=", 0.8, 2), ("<", 0.5, -1)),
        "trend": F.when(F.col("compression_trend_into_touch") == "tightening", 1).when(F.col("compression_trend_into_touch") == "loosening", -1).otherwise(0),
        "wick": F.when(F.coalesce(F.col("wick_recovered_flag"), F.lit(False)), 2).otherwise(0),
        "dwell": F.when((F.col("touch_dwell_s") <= 20) & (bounce > 0), 1).otherwise(0),
        "thin": F.when((large < 10) & (by_ratio > 0), -2).otherwise(0),
    }


def label(bucket: Column) -> Column:
    return F.when(bucket <= 1, "STRONG_SELL").when(bucket <= 3, "SELL").when(bucket <= 4, "CAUTION").when(bucket <= 6, "NEUTRAL").when(bucket <= 8, "BUY").otherwise("STRONG_BUY")


def bucket_of(score: Column) -> Column:
    """1 to 10 for a score of -20 to 20 and what lies beyond."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.bround((score + 20) / 40.0 * 9 + 1).cast("int")))


def touch_score(packets: DataFrame) -> DataFrame:
    """Packets plus score (within 20 either way), bucket 1 to 10, label and the first six reasons for and against."""
    points = touch_points()
    total = sum(points.values(), F.lit(0))
    one = packets.withColumn("score", F.greatest(F.lit(-20), F.least(F.lit(20), total)))
    bucket = bucket_of(F.col("score"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("points")) for k, v in points.items()])

    def named(holds) -> Column:
        return F.transform(F.slice(F.filter(rules, holds), 1, 6), lambda x: F.concat_ws(" ", x["rule"], x["points"].cast("string")))

    one = one.withColumn("reasons_plus", named(lambda x: x["points"] > 0)).withColumn("reasons_minus", named(lambda x: x["points"] < 0))
    return one.withColumn("bucket", bucket).withColumn("label", label(F.col("bucket")))


def touch_cum_score(scored: DataFrame) -> DataFrame:
    """Running sum of a level's scores with its own bucket, its range so far apart from 0, and its height in percent of it."""
    whole = Window.partitionBy(*LEVEL)
    one = scored.withColumn("cum_score", F.sum("score").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    one = one.withColumns({"cum_min": F.min("cum_score").over(whole), "cum_max": F.max("cum_score").over(whole)})
    reach = F.greatest(F.abs("cum_min"), F.abs("cum_max"), F.lit(1))
    return one.withColumns({"cum_bucket": bucket_of(F.col("cum_score")), "cum_label": label(bucket_of(F.col("cum_score"))), "cum_height_pct": F.abs("cum_score") / reach * 100.0})


#: What a notch down makes of a verdict.
WEAKER = {"STRONG_BUY": "BUY", "BUY": "NEUTRAL", "STRONG_SELL": "SELL", "SELL": "NEUTRAL", "NEUTRAL": "NEUTRAL"}


def level_verdict(scored: DataFrame, shares_per_trade: DataFrame | None = None, most: int = 6) -> DataFrame:
    """Each level's verdict: its best touch, taken down a notch by how the level ended.

    ``shares_per_trade`` (LEVEL, shares_per_trade) tells where trading was thin: under 50 shares.
    """
    back = Window.partitionBy(*LEVEL).orderBy(F.desc("touch_number"))
    one = scored.withColumn("_back", F.row_number().over(back))
    late = F.col("_back") <= 3

    def any_late(name: str) -> Column:
        return F.coalesce(F.max(F.when(late, F.col(name))), F.lit(False))

    first = F.struct(-F.col("score"), "touch_number")  # of equal peaks the earlier
    lowest = F.struct("score", "touch_number")
    out = one.groupBy(*LEVEL).agg(
        F.count("*").alias("touches"), F.avg("score").alias("avg_score"), F.avg(F.when(F.col("_back") <= 5, F.col("score"))).alias("last5_avg_score"),
        F.max("score").alias("peak_score"), F.min_by("touch_number", first).alias("peak_touch_number"), F.min("score").alias("trough_score"), F.min_by("touch_number", lowest).alias("trough_touch_number"),
        F.sum("score").alias("cum_final_score"), any_late("institutional_sell").alias("late_inst_sell"), any_late("institutional_buy").alias("late_inst_buy"), any_late("break_confirmed_30s").alias("late_break"),
        F.flatten(F.collect_list("reasons_plus")).alias("_plus"), F.flatten(F.collect_list("reasons_minus")).alias("_minus"),
    )
    rise = F.col("last5_avg_score") - F.col("avg_score")
    out = out.withColumns({"ending_strong": rise >= 2.0, "ending_weak": rise <= -2.0})
    peak, last = F.col("peak_score"), F.col("last5_avg_score")
    base = F.when(peak >= 16, "STRONG_BUY").when(peak >= 10, "BUY").when(peak <= -16, "STRONG_SELL").when(peak <= -10, "SELL").otherwise("NEUTRAL")
    worse = F.col("_base").isin("STRONG_BUY", "BUY") & (F.col("late_break") | (F.col("ending_weak") & (last <= -2)))
    better = F.col("_base").isin("STRONG_SELL", "SELL") & F.col("ending_strong") & (last >= 2)
    weaker = F.element_at(F.create_map(*[F.lit(x) for pair in WEAKER.items() for x in pair]), F.col("_base"))
    out = out.withColumn("_base", base).withColumn("verdict", F.when(worse | better, weaker).otherwise(F.col("_base")))
    out = out.withColumns({f"top{side}": _most_frequent(F.col(side), most) for side in ("_plus", "_minus")})
    if shares_per_trade is not None:
        out = out.join(shares_per_trade.select(*LEVEL, (F.col("shares_per_trade") < 50).alias("thin_liquidity")), LEVEL, "left")
    return out.drop("_base", "_plus", "_minus")


def _most_frequent(names: Column, most: int) -> Column:
    """The names that come most often in an array, of equals the first by name, with their counts."""
    counted = F.transform(F.array_distinct(names), lambda n: F.struct((F.size(F.array_remove(names, n)) - F.size(names)).alias("less"), n.alias("name")))
    return F.transform(F.slice(F.array_sort(counted), 1, most), lambda x: F.concat_ws(" x", x["name"], (-x["less"]).cast("string")))


def level_stats(packets: DataFrame, most: int = 3) -> DataFrame:
    """Outcomes, flips, compression and bounces of each level, its best bounces and its quality.

    A break counts where it wasn't reclaimed for good; rates are rounded to three digits, half to even.
    """
    def many(*outcomes: str) -> Column:
        return F.count(F.when(F.col("touch_outcome").isin(*outcomes), 1))

    def rate(test: Column) -> Column:
        return F.bround(F.avg(test.cast("double")), 3)

    bounce, compression = F.col("bounce_return_30s_pct"), F.col("compression_at_touch")
    best = F.struct((-bounce).alias("less"), "ts_ms", bounce.alias("bounce"), compression.alias("compression"), F.col("touch_outcome").alias("outcome"), F.col("approach_type").alias("approach"))
    out = packets.groupBy(*LEVEL).agg(
        F.count("*").alias("touches"), *[many(o).alias(f"n_{o}") for o in ("hold", "break", "break_reclaim_hold", "break_reclaim_fail")], many("break", "break_reclaim_fail").alias("breaks"),
        (many("hold") / F.count("*")).alias("hold_rate"), F.bround(F.count(F.when(F.col("delta_flip_flag"), 1)) / F.count("*"), 3).alias("flip_rate"),
        F.avg(compression).alias("compression_mean"), F.percentile(compression, F.lit(0.5)).alias("compression_median"), F.bround(F.max(compression), 3).alias("compression_max"),
        F.avg(bounce).alias("bounce_mean"), F.percentile(bounce, F.lit(0.5)).alias("bounce_median"), rate(bounce > 0).alias("positive_bounce_rate"),
        F.avg("rel_aggr_0_30s").alias("aggression_mean"), rate(F.col("rel_aggr_0_30s") > 0).alias("aggression_rate"),
        F.slice(F.sort_array(F.collect_list(F.when(bounce.isNotNull(), best))), 1, most).alias("top_bounces"),
    )
    n, h, p = F.col("touches"), F.col("hold_rate"), F.coalesce("positive_bounce_rate", F.lit(0.0))
    quality = F.when(((n <= 3) & (h >= 0.8)) | ((n <= 7) & (h >= 0.7) & (p >= 0.6)), "strong").when((n > 10) & ((F.col("breaks") >= 2) | (p < 0.5)), "exhausted").when(h >= 0.6, "moderate").otherwise("weak")
    return out.withColumn("quality", quality)


def level_flags(stats: DataFrame) -> DataFrame:
    """Green and red flags of level statistics, as comma-separated names."""
    def names(*rules: tuple[Column, str]) -> Column:
        return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])), ",")

    c, p, a, n = F.col("compression_max"), F.col("positive_bounce_rate"), F.col("aggression_rate"), F.col("touches")
    green = names((c >= 1, "compression"), (p >= 0.6, "bounces"), (F.col("flip_rate") >= 0.5, "flips"), (a >= 0.6, "aggression"), (F.col("quality") == "strong", "quality"))
    red = names((c < 0.5, "compression"), (p < 0.5, "bounces"), (a < 0.4, "aggression"), (n > 10, "touches"), (F.col("breaks") >= 2, "breaks"), (F.col("quality").isin("exhausted", "weak"), "quality"))
    return stats.select(*LEVEL, green.alias("green"), red.alias("red"))


def minutes(packets: DataFrame, stream: DataFrame) -> DataFrame:
    """The minutes of each level that have touches: touches, institutions, and all that was bought and sold in them."""
    own = packets.groupBy(*LEVEL, bucket(F.col("ts_ms"), 60_000).alias("minute_ts")).agg(
        F.count("*").alias("touches"), F.count(F.when(F.col("institutional_buy"), 1)).alias("inst_buy"), F.count(F.when(F.col("institutional_sell"), 1)).alias("inst_sell"),
    )
    flow = stream.groupBy(*KEY, bucket(F.col("ts_ms"), 60_000).alias("minute_ts")).agg(F.sum("buy_volume").alias("buy"), F.sum("sell_volume").alias("sell"))
    out = own.join(flow, [*KEY, "minute_ts"], "left").fillna(0.0, ["buy", "sell"])
    winner = F.when(F.col("buy") > 1.1 * F.col("sell"), "buyers").when(F.col("sell") > 1.1 * F.col("buy"), "sellers").otherwise("even")
    return out.withColumns({"winner": winner, "delta": F.col("buy") - F.col("sell")})


def wash_dumps(by_minute: DataFrame) -> DataFrame:
    """Minutes of heavy selling and how the level's next five minutes with touches took it.

    A dump is stopped hard if selling goes on in the next minute, or if buyers take back less than
    30 % of it; only else it has a score, and it is absorbed from 2 points on.
    """
    w = Window.partitionBy(*LEVEL).orderBy("minute_ts")
    five = w.rowsBetween(1, 5)
    faster = F.when(F.col("buy") > 1.1 * F.lag("buy").over(w), 1).otherwise(0)
    one = by_minute.withColumn("_faster", faster).withColumns({
        "recovery_buy": F.coalesce(F.sum("buy").over(five), F.lit(0.0)), "recovery_sell": F.coalesce(F.sum("sell").over(five), F.lit(0.0)),
        "late_buy": F.coalesce(F.sum("inst_buy").over(five), F.lit(0)), "late_sell": F.coalesce(F.sum("inst_sell").over(five), F.lit(0)),
        "accelerations": F.coalesce(F.sum("_faster").over(five), F.lit(0)),
        "hard_stop_a": F.coalesce(F.lead("sell").over(w) > 1.2 * F.lead("buy").over(w), F.lit(False)),
    }).where("sell > 2 * buy AND sell > 20000")
    ratio = F.col("recovery_buy") / F.col("sell")
    shift = (F.col("inst_sell") >= 1) & (F.col("late_buy") >= 1) & (F.col("late_sell") == 0)
    score = steps(ratio, (">=", 0.75, 2), (">=", 0.5, 1)) + steps(F.col("accelerations"), (">=", 2, 2), (">=", 1, 1)) + steps(F.col("late_buy"), (">=", 2, 2), (">=", 1, 1)) + F.when(shift, 2).otherwise(0)
    one = one.withColumns({"recovery_ratio": ratio, "hard_stop_b": ratio < 0.30})
    stopped = F.col("hard_stop_a") | F.col("hard_stop_b")
    one = one.withColumns({"hard_stop": stopped, "score": F.when(stopped, 0).otherwise(score)})
    return one.withColumn("absorbed", F.col("score") >= 2).drop("_faster")


def wash_verdict(by_minute: DataFrame, dumps: DataFrame) -> DataFrame:
    """Each level's dumps and last minute summed up; a level without a dump has a verdict too.

    The stop's reason is the last dump's, of its two reasons the lack of buyers.
    """
    last = F.max_by(F.struct("buy", "sell", "inst_buy"), "minute_ts")
    levels = by_minute.groupBy(*LEVEL).agg(last.alias("_last"))
    reason = F.when(F.col("hard_stop_b"), "NO_BUYERS").when(F.col("hard_stop_a"), "BREAKDOWN_CONTINUES")
    total = dumps.groupBy(*LEVEL).agg(
        F.count("*").alias("dumps"), F.sum("score").alias("_score"), F.max_by(reason, F.when(F.col("hard_stop"), F.col("minute_ts"))).alias("hard_stop"),
        F.count(F.when(F.col("absorbed"), 1)).alias("absorbed"), F.count(F.when(~F.col("absorbed") & ~F.col("hard_stop"), 1)).alias("failed"),
    )
    one = levels.join(total, LEVEL, "left").fillna(0, ["dumps", "_score", "absorbed", "failed"])
    closing = F.when(F.col("_last.buy") > 1.2 * F.col("_last.sell"), 1).otherwise(0) + F.when(F.col("_last.inst_buy") >= 1, 1).otherwise(0)
    one = one.withColumn("score", F.col("_score") + closing).drop("_last", "_score")
    s = F.col("score")
    verdict = F.when(F.col("hard_stop").isNotNull(), "HARD_STOP").when(s >= 5, "STRONG_WASH").when(s >= 3, "DECENT_WASH").when(s >= 1, "WEAK_WASH").otherwise("NO_WASH")
    return one.withColumn("verdict", verdict)


def gap_phases(packets: DataFrame, gap_ms: int = 180_000) -> DataFrame:
    """Touches with the number of their phase; a gap of more than ``gap_ms`` starts a new one."""
    late = F.col("ts_ms") - F.lag("ts_ms").over(_w()) > gap_ms
    return packets.withColumn("_new", F.coalesce(late, F.lit(True)).cast("int")).withColumn("phase_id", F.sum("_new").over(_w().rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def phases(packets: DataFrame, by: Column | None = None, margin: float = 0.0) -> DataFrame:
    """A level's touches in phases with their large volume, institutions and winner (delta beyond ``margin``).

    By default runs of a quarter of the touches (at least one), of which a rest makes one more;
    ``by`` is another phase number, for instance ``phase_id`` of ``gap_phases``.
    """
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(*LEVEL)) / 4))
    at = F.floor((F.col("touch_number") - 1) / size) + 1 if by is None else by
    sold = F.col("institutional_sell")
    bounced = F.coalesce(F.col("bounce_return_30s_pct") > 0, F.lit(False))
    out = packets.withColumn("phase", at.cast("int")).groupBy(*LEVEL, "phase").agg(
        F.count("*").alias("touches"), F.min("touch_number").alias("first_touch"), F.max("touch_number").alias("last_touch"), F.min("ts_ms").alias("start_ts_ms"), F.max("ts_ms").alias("end_ts_ms"),
        F.sum("large_buy_30s").alias("buy"), F.sum("large_sell_30s").alias("sell"), F.count(F.when(F.col("institutional_buy"), 1)).alias("inst_buy"), F.count(F.when(sold, 1)).alias("inst_sell"),
        F.count(F.when(sold & bounced, 1)).alias("absorbed"), F.count(F.when(sold & ~bounced, 1)).alias("confirmed"),
    )
    out = out.withColumn("delta", F.col("buy") - F.col("sell"))
    return out.withColumn("winner", F.when(F.col("delta") > margin, "+").when(F.col("delta") < -margin, "-").otherwise("="))
