"""Time windows round anchors: countdowns, anchor statistics, gaps between levels, tape minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import bucket, price_zone
from ..schemas import KEY
from .tape import in_reach
from .timeline import window_summary

#: Seconds before an anchor at which the countdown's windows begin and end.
COUNTDOWN = ((240, 180), (180, 120), (120, 60), (60, 30), (30, 0))
INSTITUTIONAL_SIZE = 500


def countdown(anchors: DataFrame, ticks: DataFrame, name: str = "marker_id", windows: tuple = COUNTDOWN) -> DataFrame:
    """A summary of each window before each anchor (``name``, symbol, session_id, anchor_ts).

    Ticks meet anchors on their session and slice of time.
    """
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("window"), F.lit(a).alias("begin_s"), F.lit(b).alias("end_s")) for k, (a, b) in enumerate(windows)])).alias("w")
    every = anchors.select(name, *KEY, "anchor_ts", table)
    inside = in_reach(every, ticks, F.col("anchor_ts") - F.col("w.begin_s") * 1000 + 1, F.col("anchor_ts") - F.col("w.end_s") * 1000)
    return window_summary(inside.withColumn("window", F.col("w.window")), [name, *KEY, "window"])


def anchor_stats(anchors: DataFrame, ticks: DataFrame, columns: list[str], name: str = "marker_id", before_ms: int = 300_000) -> DataFrame:
    """p10, p50, p90 and mean of columns over the time before each anchor, a row a column."""
    inside = in_reach(anchors, ticks, F.col("anchor_ts") - before_ms + 1, F.col("anchor_ts"))
    tall = inside.select(name, F.expr(f"stack({len(columns)}, {', '.join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)}) AS (column, x)")).where("x IS NOT NULL")
    p = F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = tall.groupBy(name, "column").agg(p.alias("p"), F.avg("x").alias("mean"))
    return out.select(name, "column", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p90"), "mean")


def level_gaps(levels: DataFrame, atr: DataFrame) -> DataFrame:
    """Distance of each level to the next lower one, in ATR (``atr``: symbol, session_id, atr)."""
    down = Window.partitionBy(*KEY).orderBy(F.desc("level_price"))
    gap = F.col("level_price") - F.lead("level_price").over(down)
    out = levels.withColumn("gap", gap).join(atr, KEY).withColumn("gap_atr", F.try_divide(F.col("gap"), F.col("atr")))
    return out.select(*KEY, "level_id", "level_price", "gap", "gap_atr", F.coalesce(F.col("gap_atr") < 0.5, F.lit(False)).alias("cluster"))


def tape_minutes(sided: DataFrame, low: Column, high: Column) -> DataFrame:
    """Minute by zone of the band: volume by side, large prints, with totals of each minute."""
    t = sided.withColumn("minute_ts", bucket(F.col("ts_ms"), 60_000)).withColumn("zone", price_zone(F.col("price"), low, high))
    big = F.col("size") >= INSTITUTIONAL_SIZE

    def total(cond: Column, name: str) -> Column:
        return F.sum(F.when(cond, F.col("size")).otherwise(0.0)).alias(name)

    out = t.groupingSets([[*(F.col(k) for k in KEY), F.col("minute_ts"), F.col("zone")], [*(F.col(k) for k in KEY), F.col("minute_ts")]], *KEY, "minute_ts", "zone").agg(
        F.count("*").alias("trades"), total(F.col("side") == "buy", "buy"), total(F.col("side") == "sell", "sell"), total(big & (F.col("side") == "buy"), "inst_buy"), total(big & (F.col("side") == "sell"), "inst_sell"),
    )
    return out.withColumn("zone", F.coalesce("zone", F.lit("ALL")))


def session_range(windows: DataFrame, by: list[str] = ["ticker"]) -> DataFrame:  # noqa: B006
    """First start and last end of the watch windows of each request, and a session id of ticker and start.

    ``by`` names a request (the ticker among it); of requests with the same id the later ones by
    ``by`` get a number.
    """
    span = windows.groupBy(*by).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    base = F.concat_ws("_", "ticker", F.date_format(F.timestamp_millis("start_ts"), "yyyyMMdd_HHmmss"))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(*by))
    named = span.withColumn("_base", base).withColumn("_n", n)
    return named.withColumn("session_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", "_n"))).drop("_base", "_n")
