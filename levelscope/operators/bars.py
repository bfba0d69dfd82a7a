"""Bars of any width, session VWAP, exponential averages and average true range."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import EXCHANGE_ZONE, bucket, local, true_range
from ..schemas import KEY
from .tape import accumulated

WIDTHS = {"30s": 30_000, "1m": 60_000, "2m": 120_000, "3m": 180_000}
PERIODS = (9, 20, 30, 200)
ATR_PERIOD = 14
ATR_SEED = 0.5
#: Share of the seed in the average until a period of bars is there.
BLEND = 0.7


def bars(trades: DataFrame, widths: dict[str, int] = WIDTHS) -> DataFrame:
    """OHLCV and the number of trades by bucket; a bucket without a trade has no bar.

    Trades go to the narrowest width first; wider bars are made of its bars where they can be.
    """
    first, narrow = min(widths.items(), key=lambda x: x[1])
    order = F.struct("ts_ms", "seq")
    base = trades.groupBy(*KEY, bucket(F.col("ts_ms"), narrow).alias("bar_ts")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("trade_count"),
    )
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("tf"), F.lit(w).cast("long").alias("width")) for n, w in widths.items()]))
    if any(w % narrow for w in widths.values()):
        raise ValueError("widths must be multiples of the narrowest one")
    every = base.select("*", kinds.alias("k")).withColumn("start", F.expr("bar_ts - pmod(bar_ts, k.width)"))
    return every.groupBy(*KEY, F.col("k.tf").alias("tf"), F.col("k.width").alias("width"), F.col("start").alias("bar_ts")).agg(
        F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_ts").alias("close"), F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"),
    ).select(*KEY, "tf", "width", "bar_ts", (F.col("bar_ts") + F.col("width")).alias("end_ts"), "open", "high", "low", "close", "volume", "trade_count")


def vwap(trades: DataFrame, premarket: bool = False, zone: str = EXCHANGE_ZONE, opens: str = "09:30:00") -> DataFrame:
    """Trades plus ``vwap`` of the exchange day so far; null before the first trade that counts."""
    when = local(F.col("ts_ms"), zone)
    counts = F.col("size") > 0
    if not premarket:
        counts = counts & (F.date_format(when, "HH:mm:ss") >= opens)
    value = {"_money": F.when(counts, F.col("price") * F.col("size")), "_size": F.when(counts, F.col("size"))}
    dated = trades.withColumn("_day", F.date_format(when, "yyyy-MM-dd"))
    summed = accumulated(dated, value, ["ts_ms", "seq"], ["symbol", "_day"])
    return summed.withColumn("vwap", F.try_divide("_money", "_size")).drop("_day", "_money", "_size")


def with_emas(bar: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """Bars plus an exponential average of the closes for each period, started at the first close.

    The recursion runs over one symbol, session and width at a time: at most 2 880 bars.
    """
    schema = bar.schema.simpleString()[7:-1] + "".join(f",ema{p}:double" for p in periods)

    def averaged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bar_ts")
        for p in periods:
            group[f"ema{p}"] = group["close"].ewm(alpha=2 / (p + 1), adjust=False).mean()
        return group

    return bar.groupBy(*KEY, "tf").applyInPandas(averaged, schema)


def atr(bar: DataFrame, seed: float = ATR_SEED, period: int = ATR_PERIOD, blend: float = BLEND) -> DataFrame:
    """Bars plus ``tr``, ``bar_no``, ``atr`` and ``atr_status``.

    The first true ranges are averaged and blended with the seed; from the ``period``-th on
    the average counts alone, and Wilder's smoothing goes on from it (status ``live``).
    """
    w = Window.partitionBy(*KEY, "tf").orderBy("bar_ts")
    one = bar.withColumn("bar_no", F.row_number().over(w)).withColumn("tr", true_range(F.col("high"), F.col("low"), F.lag("close").over(w)))
    schema = one.schema.simpleString()[7:-1] + ",atr:double,atr_status:string"

    def smoothed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bar_ts")
        tr, out = group["tr"].to_numpy(), np.empty(len(group))
        total = value = 0.0
        for k, x in enumerate(tr, 1):
            if k <= period:
                total += x
                value = total / k
                out[k - 1] = blend * seed + (1 - blend) * value if k < period else value
            else:
                value = (value * (period - 1) + x) / period
                out[k - 1] = value
        group["atr"] = out
        group["atr_status"] = np.where(group["bar_no"] >= period, "live", "blending")
        return group

    return one.groupBy(*KEY, "tf").applyInPandas(smoothed, schema)


def atr_seeds(averages: DataFrame, daily: DataFrame | None = None, fixed: float = ATR_SEED) -> DataFrame:
    """symbol, session_id and seed: the ATR that the session before ended with, else a daily
    one by minute (``daily``: symbol, session_id, daily_atr), else ``fixed``."""
    last = averages.groupBy(*KEY).agg(F.max_by("atr", "bar_ts").alias("atr"), F.min("bar_ts").alias("start"))
    prior = F.lag("atr").over(Window.partitionBy("symbol").orderBy("start"))
    if daily is None:
        return last.select(*KEY, F.coalesce(prior, F.lit(fixed)).alias("seed"))
    joined = last.withColumn("prior", prior).join(daily, KEY, "left")
    return joined.select(*KEY, F.coalesce("prior", F.col("daily_atr") / F.sqrt(F.lit(390.0)), F.lit(fixed)).alias("seed"))
