"""Bars, flow and thresholds of a live tape, as Structured Streaming.

Times are event times; rows later than the watermark are dropped by Spark and counted, and
``sinks`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..schemas import QUOTES, TRADES
from ..sources.store import kept

LATE = "10 seconds"
#: The last event of each symbol, so late that every window before it can close.
CLOSE_MS = 86_400_000
#: Rows of a file that a tape is dropped in, about, and so of the one task that writes it.
FILE_ROWS = 1_000_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
#: Partitions of a stream's state for each core: every batch loads and commits all of them, those without rows too.
STATES_EACH = 2


def drop_files(df: DataFrame, path: str, parts: int = 4, key: str = "symbol", file_rows: int = FILE_ROWS) -> None:
    """A finished tape as files that a stream reads in order of time, and a closing event for each key.

    A file source takes the oldest files first, so each file is written before the next one and
    holds a span of time of its own: a stream that takes them one by one finds no row late. Parts
    with more than ``file_rows`` rows are cut into several such files; a millisecond isn't cut.

    The tape is computed once and kept by time, so that a file's rows are found without the others.
    """
    df = kept(df.repartitionByRange("ts_ms").sortWithinPartitions("ts_ms"))
    low, high = df.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    if low is None:
        return df.write.mode("append").parquet(path)
    step = max(1, -(-(high + 1 - low) // parts))
    counted = df.groupBy(F.expr(f"(ts_ms - {low}) div {step}").alias("part")).count().where("part IS NOT NULL")
    rows = {r["part"]: r["count"] for r in counted.collect()}  # a row for each part
    for k in range(parts):
        begin, end = low + k * step, low + (k + 1) * step
        part, files = df.where((F.col("ts_ms") >= begin) & (F.col("ts_ms") < end)), -(-rows.get(k, 0) // file_rows)
        cuts = part.agg(F.percentile_approx("ts_ms", [j / files for j in range(1, files)], 100 * files)).first()[0] if files > 1 else []
        bounds = [begin, *sorted(set(cuts) - {begin}), end]
        for a, b in zip(bounds, bounds[1:]):
            part.where((F.col("ts_ms") >= a) & (F.col("ts_ms") < b)).repartition(1).write.mode("append").parquet(path)
    last = F.lit(high + CLOSE_MS)
    rest = [c for c in df.columns if c not in (key, "ts_ms")]
    closing = df.select(key).distinct().select(key, last.alias("ts_ms"), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in rest]).select(df.columns)
    closing.coalesce(1).write.mode("append").parquet(path)
    return None


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB) -> Iterator[None]:
    """Streams that start inside keep their state by ``provider``; engines with timers and several states need RocksDB.

    Their state has no more partitions than ``STATES_EACH`` for each core.
    """
    most = str(min(int(spark.conf.get(PARTITIONS)), STATES_EACH * spark.sparkContext.defaultParallelism))
    inside = {STATE_STORE: provider, PARTITIONS: most}
    before = {name: spark.conf.get(name, None) for name in inside}
    for name, value in inside.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def source(spark: SparkSession, path: str, kind: str = "trades", fmt: str = "parquet", files_each: int = 4, schema=None) -> DataFrame:
    """A folder that files are dropped into, as a stream with its event time and watermark."""
    schema = schema or (TRADES if kind == "trades" else QUOTES)
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).format(fmt).load(path)
    return raw.withColumn("t", F.timestamp_millis("ts_ms")).withWatermark("t", LATE)


def st_bars(trades: DataFrame, width: str = "1 minute") -> DataFrame:
    order = F.struct("ts_ms", "seq")
    out = trades.groupBy("symbol", F.window("t", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("trade_count"),
    )
    return out.select("symbol", F.unix_millis("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume", "trade_count")


def st_flow(sided: DataFrame) -> DataFrame:
    """Ten-second flow; ``sided`` trades have a side, or all of it is unknown."""
    side = F.col("side") if "side" in sided.columns else F.lit("unknown")
    out = sided.groupBy("symbol", F.window("t", "10 seconds").alias("w")).agg(
        F.count("*").alias("trade_count"), F.sum("size").alias("total_volume"), *[F.sum(F.when(side == s, F.col("size")).otherwise(0.0)).alias(f"{s}_volume") for s in ("buy", "sell", "unknown")],
    )
    return out.select("symbol", (F.unix_millis("w.end") - 1).alias("ts_ms"), "trade_count", "total_volume", "buy_volume", "sell_volume", "unknown_volume")


def st_threshold(trades: DataFrame) -> DataFrame:
    """The 95th percentile (nearest rank, exact) of trade sizes over the five minutes up to each ten seconds' end."""
    from .engine import threshold_engine

    return threshold_engine(trades, 299_999)


def st_phases(touches: DataFrame, gap: str = "3 minutes") -> DataFrame:
    """Runs of touches without a gap."""
    out = touches.groupBy("symbol", F.session_window("t", gap).alias("w")).agg(F.count("*").alias("touches"))
    return out.select("symbol", F.unix_millis("w.start").alias("start_ts_ms"), "touches")


def finished(query: StreamingQuery) -> StreamingQuery:
    """Wait until what has arrived is worked off; an error of the stream is raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to ``path``, exactly once, and stop."""
    with state_store(stream.sparkSession):  # a stream keeps the settings that it was started with
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    return finished(query)
