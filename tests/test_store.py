"""Sessions published together, the catalogue, sinks that are cut off, late rows."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from levelscope.sources import store
from levelscope.streaming import engine, sinks, tape_stream

from .test_live import recorded
from .test_tape import T0, trades


def two_kinds(spark, factor):
    stream = trades(spark, [(T0 + k, 10, factor) for k in range(5)] + [(T0 + 86_400_000, 11, factor)])
    return stream, stream.limit(2)


def sizes(df):
    return sorted({r["size"] for r in df.collect()})


def test_publication_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A reader between two tables of a publication, after one that failed, and after one that is through."""
    path = f"file://{tmp_path}/store"
    stream, markers = two_kinds(spark, 1)
    store.publish({"session_stream": (stream, "ts_ms"), "markers": (markers, "ts_ms")}, path)
    assert sizes(store.read_published(spark, path, "session_stream")) == sizes(store.read_published(spark, path, "markers")) == [1.0]
    before = store.kept(store.manifest(spark, path))
    seen = []
    listed = store._partitions

    def look(*a):
        seen.append([sizes(store.read_published(spark, path, k)) for k in ("session_stream", "markers")])
        if len(seen) == 2 and len(seen[0]) and fail:
            raise RuntimeError("cut off")
        return listed(*a)

    monkeypatch.setattr(store, "_partitions", look)
    stream, markers = two_kinds(spark, 2)
    first = stream.where(F.col("ts_ms") < T0 + 1000)
    for fail in (True, False):
        seen.clear()
        try:
            store.publish({"session_stream": (first, "ts_ms"), "markers": (markers, "ts_ms")}, path)
        except RuntimeError:
            assert fail
        assert seen == [[[1.0], [1.0]]] * 2  # after each table, the old session of both
        if fail:
            assert sizes(store.read_published(spark, path, "session_stream")) == [1.0]
    monkeypatch.undo()
    got = {(r["ts_ms"] > T0 + 1000, r["size"]) for r in store.read_published(spark, path, "session_stream").collect()}
    assert got == {(False, 2.0), (True, 1.0)}  # the other session stays
    assert sizes(store.read_published(spark, path, "markers")) == [2.0]
    assert sizes(store.read_published(spark, path, "session_stream", before)) == [1.0]  # as of the manifest before
    assert store.vacuum(spark, path) == 2 and sizes(store.read_published(spark, path, "markers")) == [2.0]
    assert store.read_published(spark, path, "session_stream").count() == 6
    with pytest.raises(ValueError):
        store.publish({"nonsense": (stream, "ts_ms")}, path)


def test_catalogue_reads_no_data(spark, tmp_path):
    stream, markers = two_kinds(spark, 1)
    plain, published = f"file://{tmp_path}/plain", f"file://{tmp_path}/published"
    store.write(stream, plain, "session_stream")
    store.write(markers, plain, "markers")
    store.publish({"session_stream": (stream, "ts_ms"), "markers": (markers, "ts_ms")}, published)
    for path in (plain, published):
        found = store.list_sessions(spark, path)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "session_stream" not in plan and "Relation" not in plan.replace("LocalRelation", "").replace("Relation [date#", "", 1) or store.MANIFEST in str(found.inputFiles())
        assert all(store.MANIFEST in f for f in found.inputFiles())
        assert [tuple(r) for r in found.collect()] == [("2024-01-03", "S", "S_1"), ("2024-01-02", "S", "S_1")]
        assert store.list_sessions(spark, path, ("markers",)).count() == 1
    assert store.list_sessions(spark, f"file://{tmp_path}/none").count() == 0


class Dies(sinks.BatchSink):
    """Fails between a batch's tables and the ledger, or between two tables, once each."""

    def __init__(self, *a):
        super().__init__(*a)
        self.left = ["commit", "write"]

    def write(self, batch, number):
        if number == 2 and "write" in self.left:
            self.left.remove("write")
            whole, self.kinds = self.kinds, dict(list(self.kinds.items())[:1])
            try:
                super().write(batch, number)
            finally:
                self.kinds = whole
            raise RuntimeError("cut off between tables")
        super().write(batch, number)

    def commit(self, batch, number):
        if number == 1 and "commit" in self.left:
            self.left.remove("commit")
            raise RuntimeError("cut off before the ledger")
        super().commit(batch, number)


def test_sink_cut_off_and_started_again(spark, tmp_path):
    t, _ = recorded(spark, minutes=20)
    tape_stream.drop_files(t.coalesce(1), f"{tmp_path}/in")
    stream = tape_stream.source(spark, f"{tmp_path}/in", schema=t.schema, files_each=1)
    sink = Dies(f"{tmp_path}/out", {"tape": lambda df: df.where("price IS NOT NULL"), "big": lambda df: df.where("size > 300")})
    for attempt in range(3):
        if attempt < 2:
            with pytest.raises(StreamingQueryException):
                sinks.drain_to(stream, sink, f"{tmp_path}/state")
            whole = sinks.read(spark, f"{tmp_path}/out", "tape")
            assert whole.select("batch").distinct().count() == attempt + 1  # what was cut off isn't seen
        else:
            sinks.drain_to(stream, sink, f"{tmp_path}/state")
    got = sinks.read(spark, f"{tmp_path}/out", "tape")
    assert got.count() == got.select("seq").distinct().count() == t.count()
    assert sinks.read(spark, f"{tmp_path}/out", "big").count() == t.where("size > 300").count()
    sink(got.drop("batch").limit(3), 1)  # a batch that is delivered again
    assert sinks.read(spark, f"{tmp_path}/out", "tape").count() == t.count()


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    """Rows behind the watermark: those that the side table keeps are those that the engine drops."""
    t, q = recorded(spark, minutes=20)
    tape = engine.events(t, q)
    cut = T0 + 900_000
    late = tape.where(F.col("ts_ms") < T0 + 120_000).limit(9).withColumn("seq", F.col("seq") + 10**9).cache()
    # Spark's own operators drop by the watermark of the batch before, so that the late rows come two batches after theirs
    for part in (tape.where(F.col("ts_ms") < cut - 300_000), tape.where(F.col("ts_ms").between(cut - 300_000, cut - 1)), tape.where(F.col("ts_ms") >= cut).unionByName(late)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = tape_stream.source(spark, f"{tmp_path}/in", files_each=1, schema=engine.EVENTS)
    sinks.drain_to(stream, sinks.LateSink(f"{tmp_path}/out", 10_000), f"{tmp_path}/state")
    kept = sinks.read(spark, f"{tmp_path}/out", "late")
    assert sorted(r["seq"] for r in kept.collect()) == sorted(r["seq"] for r in late.collect())
    assert sinks.read(spark, f"{tmp_path}/out", "tape").count() == tape.count()
    counter = sinks.LateRows()
    spark.streams.addListener(counter)
    try:
        unique = stream.dropDuplicatesWithinWatermark(["seq"])
        query = sinks.drain_to(unique, sinks.BatchSink(f"{tmp_path}/unique", {"tape": lambda df: df}), f"{tmp_path}/state2", "counted")
        for _ in range(100):
            if counter.dropped.get("counted", 0) >= 9:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counter)
    by_progress = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    assert counter.dropped["counted"] == by_progress == 9
    kinds = {"session_stream": engine.ticks, "late": engine.late_events}
    # the engine reports what it can't take any more; what is two batches late doesn't reach it, and is counted
    query = sinks.drain_to(engine.tape_engine(stream), sinks.BatchSink(f"{tmp_path}/ticks", kinds), f"{tmp_path}/state3")
    reported = sinks.read(spark, f"{tmp_path}/ticks", "late", "symbol string, session_id string, ts_ms long, seq long").count()
    assert reported + sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) == 9
    assert sinks.read(spark, f"{tmp_path}/ticks", "session_stream").where("trade_count > 0").count() > 50
