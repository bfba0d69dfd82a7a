"""Sinks of a stream by date, ticker and session: each batch once, late rows kept, late rows counted.

A batch is written to partitions of its own number, so that writing it again replaces what an
attempt that failed has left, and is entered in a ledger after all its tables are there.
Readers take the batches of the ledger alone: one that was cut off half-way isn't seen, and one
that is delivered twice isn't doubled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.expressions import exchange_date
from ..sources.store import PARTITION, exists, stored
from .tape_stream import finished, state_store

LEDGER = "_batches"
ENTRY = "batch long, last_ts_ms long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The batches that are whole: their number and the latest event time of each."""
    if not exists(spark, f"{path}/{LEDGER}"):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(f"{path}/{LEDGER}")


class BatchSink:
    """Writes batches of a stream to tables under ``path``, by kind: ``kinds`` picks each one's rows.

    Rows have symbol and ts_ms; without a session_id they belong to their symbol's exchange day.
    """

    def __init__(self, path: str, kinds: dict[str, Callable[[DataFrame], DataFrame]]):
        self.path, self.kinds = path, kinds

    def write(self, batch: DataFrame, number: int) -> None:
        """The batch's tables, to partitions of its number."""
        for kind, pick in self.kinds.items():
            rows = pick(batch)
            if "session_id" not in rows.columns:
                rows = rows.withColumn("session_id", F.concat_ws("_", "symbol", exchange_date(F.col("ts_ms"))))
            out = stored(rows, "ts_ms").withColumn("batch", F.lit(number).cast("long")).repartition(*PARTITION)
            out.write.partitionBy(*PARTITION, "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/{kind}")

    def commit(self, batch: DataFrame, number: int) -> None:
        """Enter the batch in the ledger: from now on it is seen."""
        entry = batch.agg(F.lit(number).cast("long").alias("batch"), F.max("ts_ms").cast("long").alias("last_ts_ms"))
        entry.write.mode("overwrite").parquet(f"{self.path}/{LEDGER}/number={number}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        if ledger(batch.sparkSession, self.path).where(F.col("batch") == number).isEmpty():
            batch.persist()
            try:
                self.write(batch, number)
                self.commit(batch, number)
            finally:
                batch.unpersist()


class LateSink(BatchSink):
    """A sink of a tape that keeps rows the watermark has passed in a table of their own (``late``), the others in ``kind``.

    The watermark of a batch is the latest event time of the batches before it, less ``delay_ms``.
    """

    def __init__(self, path: str, delay_ms: int, kind: str = "tape"):
        self.delay_ms, self.kind = delay_ms, kind
        super().__init__(path, {})

    def write(self, batch: DataFrame, number: int) -> None:
        before = ledger(batch.sparkSession, self.path).where(F.col("batch") < number).agg(F.max("last_ts_ms")).first()[0]
        late = F.lit(False) if before is None else F.col("ts_ms") <= before - self.delay_ms
        self.kinds = {self.kind: lambda df: df.where(~late), "late": lambda df: df.where(late)}
        super().write(batch, number)


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """The rows of a kind, of whole batches only; a kind that may be without rows so far needs its schema."""
    if not exists(spark, f"{path}/{kind}"):
        raise FileNotFoundError(f"{path}/{kind}")
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, date string, ticker string, session string, batch long")
    return reader.parquet(f"{path}/{kind}").join(ledger(spark, path).select("batch"), "batch", "left_semi")


def drain_to(stream: DataFrame, sink: BatchSink, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Work off what has arrived through a sink, and stop."""
    writer = stream.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with state_store(stream.sparkSession):
        return finished((writer.queryName(name) if name else writer).start())


class LateRows(StreamingQueryListener):
    """Counts, by a query's name (or id), the rows that its state operators dropped because the watermark had passed them."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        key = p.name or str(p.id)
        self.dropped[key] = self.dropped.get(key, 0) + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
