"""The ``events`` table as a tape: 30 days squeezed into two sessions of two symbols.

Integer arithmetic only, so any engine gets the same tape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import exchange_date

_ZERO, _OPEN, _DAY = 1704067200000, 1704196800000, 86_400_000


def events_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    ts_ms = F.expr(f"(timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) - {_ZERO}) div 60 + {_OPEN} + ((user_id div 2) % 2) * {_DAY}")
    tape = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("S"), (F.col("user_id") % 2).cast("string")).alias("symbol"), ts_ms.alias("ts_ms"), "event_type", k.alias("k"))
    cents = F.expr("10000 + abs((ts_ms div 60000) % 120 - 60) * 2 + (k % 11 - 5) * 2")
    return tape.withColumn("price", cents / 100.0).withColumn("session_id", F.concat_ws("_", "symbol", exchange_date(F.col("ts_ms"))))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events_tape(spark, sf_dir).where(F.col("event_type").isin("click", "purchase", "error"))
    conditions = F.when(F.col("event_type") == "error", F.array(F.lit("W"))).otherwise(F.array().cast("array<string>"))
    return t.select("seq", "symbol", "session_id", "ts_ms", "price", (1 + (F.col("seq") * 37) % 400).cast("double").alias("size"), conditions.alias("conditions"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = events_tape(spark, sf_dir).where(F.col("event_type").isin("view", "signup"))
    return q.select(
        "seq", "symbol", "session_id", "ts_ms", (F.col("price") - 0.02).alias("bid"), (1 + F.col("seq") % 9).cast("double").alias("bid_size"),
        (F.col("price") + 0.02).alias("ask"), (1 + F.col("seq") % 7).cast("double").alias("ask_size"),
    )


#: level_id, price, type and ms after the session's start.
LEVELS = (("L1", 100.20, "support", 0), ("L2", 101.00, "resistance", 0), ("L3", 100.60, "support", 7_200_000))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels in every session, from the sessions' own extents."""
    sessions = events_tape(spark, sf_dir).groupBy("symbol", "session_id").agg(F.min("ts_ms").alias("start"))
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("level_id"), F.lit(p).alias("level_price"), F.lit(t).alias("level_type"), F.lit(a).cast("long").alias("after")) for i, p, t, a in LEVELS])).alias("l")
    every = sessions.select("symbol", "session_id", "start", rows)
    created = F.when(F.col("l.after") > 0, F.col("start") + F.col("l.after")).otherwise(F.lit(0).cast("long"))
    return every.select("symbol", "session_id", "l.level_id", "l.level_price", "l.level_type", F.lit(0.25).alias("level_width_atr"), created.alias("created_ts_ms"))


#: How the levels ended, for scenarios; one that isn't here is pending.
LEVEL_OUTCOMES = {"L1": "win", "L2": "loss"}
#: Sizes of this tape are far below the share counts that rules on large volume ask for.
HEAVY = 1000.0
#: Bounces of this tape are a tenth of those that count as positive on real ones.
BOUNCE = 0.0005


def level_outcomes(every: DataFrame) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in LEVEL_OUTCOMES.items() for x in pair])
    return every.select("symbol", "session_id", "level_id", F.get(F.map_values(F.map_filter(known, lambda k, _: k == F.col("level_id"))), F.lit(0)).alias("level_outcome"))


def heavy(stream: DataFrame) -> DataFrame:
    """The stream with its volumes and deltas times ``HEAVY``."""
    names = [c for c in stream.columns if "volume" in c and "share" not in c and "vol_" not in c or c in ("delta", "large_trade_delta")]
    return stream.withColumns({c: F.col(c) * HEAVY for c in names})


def chain_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain a session: its levels and two averages, watched in the session's thirds, less ten minutes each."""
    extent = events_tape(spark, sf_dir).groupBy("symbol", "session_id").agg(F.min("ts_ms").alias("start"), F.max("ts_ms").alias("end"))
    third = F.expr("(end - start) div 3")
    spots = [F.struct(F.lit(k).alias("k"), F.lit(p).cast("double").alias("price"), F.lit(t).alias("kind")) for k, (_, p, t, _) in enumerate(LEVELS)]
    every = extent.select("*", third.alias("third"), F.explode(F.array(*spots, F.struct(F.lit(2).alias("k"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("kind")))).alias("x"))
    begin = F.col("start") + F.col("third") * F.col("x.k")
    tags = F.when(F.col("x.price").isNotNull(), F.array(F.struct(F.col("x.price").alias("price"), F.col("x.kind").alias("kind"))))
    moving = F.col("x.price").isNull()
    notes = F.to_json(F.struct(
        F.lit("level_chain_v1").alias("schema"), F.lit("c1").alias("chain_id"), (begin + F.col("third") - 600_000).alias("end_ts_ms"), tags.alias("price_tags"),
        F.when(moving, "indicator").otherwise("price").alias("level_type"), F.when(moving, F.array(F.lit("ema9"), F.lit("vwap"))).alias("indicators"), F.lit(0.0015).alias("band_pct"),
    ))
    return every.select(F.concat_ws("-", F.lit("c"), "session_id", F.col("x.k").cast("string"), F.when(moving, "i").otherwise("p")).alias("marker_id"), "symbol", "session_id", begin.alias("ts_ms"), F.lit("level").alias("marker_type"), F.lit("long").alias("direction_bias"), notes.alias("notes"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marker with two price tags from every signup."""
    tape = events_tape(spark, sf_dir).where(F.col("event_type") == "signup")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("consolidation", "support_bounce", "breakdown", "downtrend_break")]), F.expr("CAST(seq % 4 + 1 AS INT)"))
    notes = F.to_json(F.struct((F.col("ts_ms") + 600_000).alias("end_ts_ms"), F.array(*[F.struct(F.lit(p).alias("price"), F.lit(t).alias("kind")) for _, p, t, _ in LEVELS[:2]]).alias("price_tags")))
    typed = tape.withColumn("marker_type", kind)
    bias = F.when(F.col("marker_type") == "consolidation", "long")
    return typed.select(F.concat(F.lit("m"), F.col("seq").cast("string")).alias("marker_id"), "symbol", "session_id", "ts_ms", "marker_type", bias.alias("direction_bias"), notes.alias("notes"))
