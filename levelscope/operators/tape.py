"""Trades with their quotes, and the side of each trade.

Values are carried along a session in slices of time: a window covers one slice, and what
the slices before it leave is joined to it. A hot symbol's day is so many tasks, not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import quote_rule
from ..schemas import KEY

SLICE_MS = 3_600_000
#: Slices in which anchors meet ticks: windows round an anchor are minutes long.
REACH_MS = 300_000


def carried(df: DataFrame, name: str, value: Column, order: list[str], inclusive: bool = True, keys: list[str] = KEY, slice_ms: int = SLICE_MS) -> DataFrame:
    """``df`` plus ``name``: the last ``value`` that isn't null up to (or before) each row."""
    part = [*keys, "_slice"]
    df = df.withColumn("_slice", F.expr(f"ts_ms div {slice_ms}")).withColumn("_value", value)
    w = Window.partitionBy(*part).orderBy(*order)
    near = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    ends = df.groupBy(*part).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    left = ends.select(*part, before.alias("_before"))
    return df.withColumn(name, near).join(left, part).withColumn(name, F.coalesce(name, "_before")).drop("_slice", "_value", "_before")


def accumulated(df: DataFrame, values: dict[str, Column], order: list[str], keys: list[str] = KEY, slice_ms: int = SLICE_MS) -> DataFrame:
    """``df`` plus running sums of ``values`` up to each row: within its slice, on top of all slices before."""
    part = [*keys, "_slice"]
    df = df.withColumn("_slice", F.expr(f"ts_ms div {slice_ms}")).withColumns({f"_{n}": v for n, v in values.items()})
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*part).agg(*[F.sum(f"_{n}").alias(f"_all_{n}") for n in values])
    left = totals.select(*part, *[F.sum(f"_all_{n}").over(before).alias(f"_before_{n}") for n in values])
    near = df.withColumns({n: F.sum(f"_{n}").over(w) for n in values}).join(left, part)
    # a sum without any value is null, not 0
    both = {n: F.when(F.col(n).isNull(), F.col(f"_before_{n}")).otherwise(F.col(n) + F.coalesce(f"_before_{n}", F.lit(0))) for n in values}
    return near.withColumns(both).drop("_slice", *[f"_{n}" for n in values], *[f"_before_{n}" for n in values])


def stable_order(events: DataFrame, order: list[str] = ["ts_ms", "seq"]) -> DataFrame:  # noqa: B006
    """``position`` of each row in its session by time and arrival."""
    return accumulated(events, {"position": F.lit(1).cast("long")}, order)


def event_merge(quotes: DataFrame, trades: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """Quotes, commands and trades of a session in one order: by time, at equal times in this order, then by arrival."""
    kinds = [("quote", 0, quotes), ("command", 1, commands), ("trade", 2, trades)]
    parts = [df.select("seq", *KEY, "ts_ms", F.lit(name).alias("kind"), F.lit(k).alias("_kind")) for name, k, df in kinds if df is not None]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return stable_order(every, ["ts_ms", "_kind", "seq"]).drop("_kind")


def tape_preview(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """How many trades and quotes each session has, and its first and last price."""
    order = F.struct("ts_ms", "seq")
    a = trades.groupBy(*KEY).agg(F.count("*").alias("n_trades"), F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"))
    return a.join(quotes.groupBy(*KEY).agg(F.count("*").alias("n_quotes")), KEY, "full").fillna(0, ["n_trades", "n_quotes"])


def in_reach(anchors: DataFrame, ticks: DataFrame, begin: Column, end: Column, slice_ms: int = REACH_MS, keys: list[str] = KEY) -> DataFrame:
    """Anchors with the ticks of their session from ``begin`` to ``end``, both included.

    An anchor goes to the few slices that its window covers and meets their ticks, not the session's.
    """
    near = anchors.withColumn("_begin", begin).withColumn("_end", end)
    near = near.withColumn("_slice", F.explode(F.expr(f"sequence(_begin div {slice_ms}, _end div {slice_ms})")))
    both = near.join(ticks.withColumn("_slice", F.expr(f"ts_ms div {slice_ms}")), [*keys, "_slice"])
    return both.where(F.col("ts_ms").between(F.col("_begin"), F.col("_end"))).drop("_slice", "_begin", "_end")


def asof_quote(trades: DataFrame, quotes: DataFrame, stale_ms: int | None = None) -> DataFrame:
    """Trades plus the latest quote at or before each; at equal times quotes come first.

    With ``stale_ms`` a quote older than that doesn't count.
    """
    quote = F.struct(F.col("ts_ms").alias("quote_ts_ms"), "bid", "bid_size", "ask", "ask_size")
    q = quotes.select(*KEY, "ts_ms", "seq", F.lit(0).alias("_kind"), quote.alias("_quote"))
    t = trades.withColumn("_kind", F.lit(1))
    both = q.unionByName(t, allowMissingColumns=True)
    out = carried(both, "_q", F.col("_quote"), ["ts_ms", "_kind", "seq"]).where("_kind = 1")
    if stale_ms is not None:
        out = out.withColumn("_q", F.when(F.col("ts_ms") - F.col("_q.quote_ts_ms") <= stale_ms, F.col("_q")))
    return out.select(*trades.columns, "_q.quote_ts_ms", "_q.bid", "_q.bid_size", "_q.ask", "_q.ask_size")


def lee_ready(quoted: DataFrame, need_quote: bool = True) -> DataFrame:
    """Trades (with bid and ask) plus ``side``: the quote rule, then the tick rule.

    The tick rule compares with the previous classified trade's price and keeps the last side
    if they are equal. With ``need_quote`` trades without a quote are unknown and leave no
    trace; else the tick rule holds for them too.
    """
    has = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    counts = has if need_quote else F.lit(True)
    order = ["ts_ms", "seq"]
    one = carried(quoted, "_prev", F.when(counts, F.col("price")), order, inclusive=False)
    by_quote = F.when(has, F.nullif(quote_rule(F.col("price"), F.col("bid"), F.col("ask")), F.lit("unknown")))
    by_tick = F.when(F.col("price") > F.col("_prev"), "buy").when(F.col("price") < F.col("_prev"), "sell")
    one = one.withColumn("_raw", F.when(counts, F.coalesce(by_quote, by_tick)))
    two = carried(one, "_last", F.col("_raw"), order, inclusive=False)
    side = F.coalesce("_raw", F.when(F.col("_prev").isNotNull() & counts, F.col("_last")), F.lit("unknown"))
    return two.withColumn("side", side).drop("_prev", "_raw", "_last")
