"""The live tape: equal to the replayed one over pauses, restarts and orders of arrival; late rows; sinks."""

import random

import pytest
from pyspark.sql import functions as F

from levelscope.functions import expressions as X
from levelscope.functions.sliding import CountHistogram, window_ranks
from levelscope.operators import bars as B
from levelscope.operators import tape as T
from levelscope.operators import ticks as K
from levelscope.operators import zones as Z
from levelscope.schemas import KEY
from levelscope.streaming import engine, tape_stream

from .test_tape import T0, quotes, trades

LEVELS = "symbol string, session_id string, level_id string, level_price double, level_type string, level_width_atr double, created_ts_ms long"


def dated(df):
    return df.withColumn("session_id", F.concat_ws("_", "symbol", X.exchange_date(F.col("ts_ms"))))


def recorded(spark, symbols=("S",), minutes=60, pause=(), seed=11, each=5):
    """A tape with prints of condition W, ties of time, trades without quotes and, for ``pause``'s symbols, three hours without events."""
    r = random.Random(seed)
    t, q = [], []
    for s in symbols:
        gap = 10_800_000 if s in pause else 0
        for _ in range(minutes * each):
            at = r.randrange(minutes * 60_000)
            at += gap if at > minutes * 30_000 else 0
            at -= at % 3
            t.append((s, T0 + at, 100 + 0.4 * ((at // 300_000) % 5 - 2) + r.randrange(-5, 6) / 100, float(r.randrange(1, 400)), ["W"] if r.random() < 0.1 else []))
            if r.random() < 0.4 and at > 300_000:
                q.append((s, T0 + at, 99.98, 100.02))
    tf = spark.createDataFrame([(k, s, ts, p, n, c) for k, (s, ts, p, n, c) in enumerate(t)], "seq long, symbol string, ts_ms long, price double, size double, conditions array<string>")
    qf = spark.createDataFrame([(10**6 + k, s, ts, b, 1.0, a, 1.0) for k, (s, ts, b, a) in enumerate(q)], "seq long, symbol string, ts_ms long, bid double, bid_size double, ask double, ask_size double")
    return dated(tf), dated(qf)


def replayed(t, q):
    """The batch's stream."""
    one = B.atr(B.with_emas(B.bars(t, {"1m": 60_000}))).select(*KEY, "end_ts", "ema9", "ema20", "ema30", "ema200", "atr", "atr_status")
    longer = B.with_emas(B.bars(t, {tf: B.WIDTHS[tf] for tf in ("1m", "2m", "3m")}).where("tf <> '1m'"))
    from pyspark.sql import Window

    columns = [F.max(F.when(F.col("tf") == tf, F.col(f"ema{p}"))).alias(f"ema{p}_{tf}") for tf in ("2m", "3m") for p in B.PERIODS]
    at = longer.groupBy(*KEY, "end_ts").agg(*columns)
    w = Window.partitionBy(*KEY).orderBy("end_ts").rowsBetween(Window.unboundedPreceding, 0)
    at = at.select(*KEY, "end_ts", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in at.columns if c.startswith("ema")])
    return K.session_stream(B.vwap(t), q, T.lee_ready(T.asof_quote(t, q)), one, at)


def levels_of(spark, sessions):
    return spark.createDataFrame([(s[0], s, i, p, k, 0.25, c) for s in sessions for i, p, k, c in (("L1", 99.8, "support", 0), ("L2", 100.4, "resistance", 0), ("L3", 100.0, "support", T0 + 1_234_567))], LEVELS)


def live(spark, tape, folder, files=None, name="tape", **options):
    """Drain what lies in the folder; ``tape`` is dropped there first, if given."""
    if tape is not None:
        tape_stream.drop_files(tape.coalesce(1), f"{folder}/in", parts=files or 4)
    stream = engine.tape_engine(tape_stream.source(spark, f"{folder}/in", files_each=1, schema=engine.EVENTS), **options)
    tape_stream.drain(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


def assert_equal_rows(a, b, columns, digits=9):
    def rows(df):
        return sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=repr)

    x, y = rows(a), rows(b)
    assert x == y
    return len(x)


def test_pauses_restarts_and_levels(spark, tmp_path):
    """Two symbols, one pausing for three hours; the stream stops and starts again from its checkpoint in mid-session."""
    t, q = recorded(spark, ("S", "T"), minutes=60, pause=("T",))
    sessions = [r["session_id"] for r in t.select("session_id").distinct().collect()]
    levels = levels_of(spark, sessions)
    tape = engine.events(t, q, levels).cache()
    low, high = tape.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    cut = low + (high - low) // 5
    folder = str(tmp_path)
    tape.where(F.col("ts_ms") <= cut).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    before = live(spark, None, folder).count()
    out = live(spark, tape.where(F.col("ts_ms") > cut), folder)
    batch = replayed(t, q).cache()
    got = {r["session_id"][0]: r for r in engine.parity(engine.ticks(out), batch).collect()}
    assert all(r["live"] == r["batch"] == r["equal"] for r in got.values()), got
    assert got["T"]["live"] > got["S"]["live"] + 1000 and 0 < before < out.count()
    zone = Z.zone_events(Z.zone_distance(batch, levels)).cache()
    assert assert_equal_rows(engine.zone_events(out), zone.where("event IS NOT NULL"), [*Z.LEVEL, "ts_ms", "event", "entry_side", "touch_count"]) > 20
    assert assert_equal_rows(engine.episodes(out), Z.episodes(zone), engine.EPISODE_COLUMNS) > 5


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_within_the_watermark(spark, tmp_path, seed):
    """Rows of a file in any order and quotes ten seconds late: the same ticks."""
    t, q = recorded(spark, minutes=20, seed=seed)
    tape = engine.events(t, q)
    rows = tape.collect()
    r = random.Random(seed)
    arrival = sorted(rows, key=lambda x: x["ts_ms"] + (r.randrange(9_000) if x["kind"] == engine.QUOTE else 0))
    for k in range(0, len(arrival), 60):
        part = arrival[k : k + 60]
        r.shuffle(part)
        spark.createDataFrame(part, engine.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = max(x["ts_ms"] for x in rows)
    spark.createDataFrame([(None, "S", last + tape_stream.CLOSE_MS, *[None] * 10)], engine.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = live(spark, None, str(tmp_path))
    got = engine.parity(engine.ticks(out), replayed(t, q)).first()
    assert got["live"] == got["batch"] == got["equal"] > 100


def test_parity_makes_the_batch_beside_the_stream(spark, monkeypatch):
    """The replayed tape isn't put off until the live one has drained, and an error of it is raised."""
    import threading

    from levelscope.plans import level_queries

    begun = threading.Event()

    class Tape:
        broken = False

        def __init__(self):
            self.spark = spark

        @property
        def stream(self):
            begun.set()
            if self.broken:
                raise ValueError("no batch")
            return spark.createDataFrame([("S", "d", 9_999, 1.5), ("S", "d", 19_999, 1.0)], "symbol string, session_id string, ts_ms long, last_price double")

    def drained(t):
        assert begun.wait(20)
        rows = spark.createDataFrame([("tick", "S", "d", 9_999, 1.5)], "kind string, symbol string, session_id string, ts_ms long, last_price double")
        return spark.createDataFrame([], engine.OUTPUT).unionByName(rows, allowMissingColumns=True)

    monkeypatch.setattr(level_queries, "_engine", drained)
    assert [tuple(r) for r in level_queries._parity(Tape()).collect()] == [("S", "d", 1, 2, 1)]
    Tape.broken = True
    with pytest.raises(ValueError, match="no batch"):
        level_queries._parity(Tape())


def test_gap_ticks_by_timers(spark, tmp_path):
    """With ``ahead_ms`` an idle session goes on ticking, while another one moves the watermark, and no further."""
    t, q = recorded(spark, ("S", "T"), minutes=6)
    t = t.where("symbol = 'S' OR ts_ms < %d" % (T0 + 60_000))
    q = q.where("symbol = 'S' OR ts_ms < %d" % (T0 + 60_000))
    folder = str(tmp_path)
    engine.events(t, q).where(F.col("ts_ms") < T0 + 120_000).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    engine.events(t, q).where(F.col("ts_ms") >= T0 + 120_000).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = engine.ticks(live(spark, None, folder, ahead_ms=60_000))
    last = t.unionByName(q, allowMissingColumns=True).where("symbol = 'T'").agg(F.max("ts_ms")).first()[0]
    ends = [r["ts_ms"] for r in out.where("symbol = 'T'").orderBy("ts_ms").collect()]
    assert ends == list(range(ends[0], last // 10_000 * 10_000 + 9_999 + 60_001, 10_000))
    assert {r["trade_count"] for r in out.where(f"symbol = 'T' AND ts_ms > {last + 10_000}").collect()} == {0}
    assert {r["last_price"] for r in out.where(f"symbol = 'T' AND ts_ms > {last + 10_000}").collect()} == {t.where("symbol = 'T'").agg(F.max_by("price", F.struct("ts_ms", "seq"))).first()[0]}


def test_state_stays_flat(spark, tmp_path):
    """Twice the tape, no more state: only five minutes of history are kept, and nothing after the day."""
    sizes = []
    for minutes in (40, 80):
        folder = f"{tmp_path}/{minutes}"
        t, q = recorded(spark, minutes=minutes, seed=4)
        engine.events(t, q, levels_of(spark, [r["session_id"] for r in t.select("session_id").distinct().collect()])).coalesce(1).write.parquet(f"{folder}/in")
        stream = engine.tape_engine(tape_stream.source(spark, f"{folder}/in", files_each=1, schema=engine.EVENTS))
        query = tape_stream.drain(stream, f"{folder}/out", f"{folder}/state")
        sizes.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
    assert sizes[1] <= sizes[0] * 1.3 + 20
    spark.createDataFrame([(None, "S", T0 + 2 * tape_stream.CLOSE_MS, *[None] * 10)], engine.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    query = tape_stream.drain(stream, f"{folder}/out", f"{folder}/state")
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


def test_events_wait_in_blocks(spark, tmp_path):
    """Events that aren't final are some rows of state by session, however many they are."""
    t, q = recorded(spark, ("S", "T"), minutes=60, each=40)
    tape = engine.events(t, q, levels_of(spark, [r["session_id"] for r in t.select("session_id").distinct().collect()]))
    tape.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = engine.tape_engine(tape_stream.source(spark, f"{tmp_path}/in", files_each=1, schema=engine.EVENTS))
    query = tape_stream.drain(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    assert query.recentProgress[0]["numInputRows"] > 6000
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 40
    assert 700 < engine.ticks(spark.read.parquet(f"{tmp_path}/out")).count() <= 720


def test_blocks_hold_each_session_and_command():
    """Events of a key meet in a row, commands have one each, closing events none; nothing is lost."""
    import numpy as np
    import pyarrow as pa

    rows = [("S" if k % 3 else None, f"d{k % 2}", k, 1000 - k, (0, 2, 1, -1)[k % 4]) for k in range(40)]
    flat = {c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate((("symbol", pa.string()), ("session_id", pa.string()), ("seq", pa.int64()), ("ts_ms", pa.int64()), ("kind", pa.int32())))}
    flat |= {"irregular": pa.array([k % 5 == 0 for k in range(40)])} | {c: pa.array([k / 2 if k % 7 else None for k in range(40)], pa.float64()) for c in ("price", "size", "bid", "ask", "level_price", "level_width_atr")}
    flat |= {c: pa.array([f"{c}{k}" for k in range(40)]) for c in ("level_id", "level_type")}
    batch = pa.RecordBatch.from_pydict(flat)
    got, commands = [], 0
    for out in engine._packed(["symbol", "session_id"])(iter([batch.slice(0, 25), batch.slice(25)])):
        for r in out.to_pylist():
            own = engine._columns(r[c] for c in engine._COLUMNS)
            if own["kind"][0] == engine.COMMAND:
                commands += 1
                assert len(own["seq"]) == 1 and r["level_id"] == f"level_id{own['seq'][0]}"
            got += [(r["symbol"], r["session_id"], *x) for x in zip(*(own[c].tolist() for c in ("seq", "ts_ms", "kind")), strict=True)]
            assert all(np.isnan(p) if k % 7 == 0 else p == k / 2 for k, p in zip(own["seq"].tolist(), own["ask"].tolist(), strict=True))
    assert commands == 10 and sorted(got, key=repr) == sorted((r for r in rows if r[4] >= 0), key=repr)
    assert list(engine._packed(["symbol"])(iter([batch.slice(3, 1)]))) == []  # a closing event alone


def test_blocks_of_the_state_are_replaced(monkeypatch):
    """What waits is kept in blocks of a bounded number of rows; those not needed any more go."""
    import numpy as np

    class Kept(dict):
        updateValue, removeKey = dict.__setitem__, dict.__delitem__

    monkeypatch.setattr(engine, "BLOCK_ROWS", 7)
    e = engine.TapeEngine()
    e.pending, blocks = Kept(), 0
    for n in (20, 6, 15, 0):
        blocks = e._hold({c: np.arange(n).astype(kind) for c, kind in engine._COLUMNS.items()}, blocks)
        held = [engine._columns(e.pending[(k,)]) for k in range(blocks)]
        assert len(e.pending) == blocks == -(-n // 7) and [x for h in held for x in h["seq"].tolist()] == list(range(n))


def test_state_has_few_partitions(spark, tmp_path):
    """A stream's state isn't cut into more partitions than the cores can use, and the setting is back afterwards."""
    t, q = recorded(spark, minutes=4)
    before = spark.conf.get(tape_stream.PARTITIONS)
    spark.conf.set(tape_stream.PARTITIONS, "60")
    try:
        engine.events(t, q).coalesce(1).write.parquet(f"{tmp_path}/in")
        query = tape_stream.drain(engine.tape_engine(tape_stream.source(spark, f"{tmp_path}/in", schema=engine.EVENTS)), f"{tmp_path}/out", f"{tmp_path}/state")
        assert spark.conf.get(tape_stream.PARTITIONS) == "60"
    finally:
        spark.conf.set(tape_stream.PARTITIONS, before)
    assert {p["stateOperators"][0]["numShufflePartitions"] for p in query.recentProgress} == {2 * spark.sparkContext.defaultParallelism}


def test_count_histogram_against_sorting():
    import math

    import numpy as np

    r = random.Random(9)
    values = np.array([round(r.choice([r.random() * 9, r.randrange(1, 5)]), 2) for _ in range(400)])
    ts = np.sort(np.array([r.randrange(3_000_000) for _ in range(400)]))
    ends = np.arange(9_999, 3_400_000, 10_000)
    got = window_ranks(ts, values, ends, 0.95, 300_000)
    for e, x in zip(ends.tolist(), got.tolist(), strict=True):
        own = sorted(values[(ts >= e - 300_000) & (ts <= e)].tolist())
        assert math.isnan(x) if not own else x == own[math.ceil(0.95 * len(own)) - 1]
    h = CountHistogram(np.array([1.0, 2.0, 5.0]))
    assert math.isnan(h.nearest_rank(0.5))
    h.add(np.array([0, 2, 2]))
    assert (h.nearest_rank(0.0), h.nearest_rank(1 / 3), h.nearest_rank(0.5)) == (1.0, 1.0, 5.0)


def test_thresholds_live_and_in_slices(spark, tmp_path):
    """The live threshold and the batch's, over slices of half an hour, against sorting."""
    t, q = recorded(spark, minutes=70, seed=6)
    grid = K.tick_grid(K.session_extent(t, q))
    rows = [(r["ts_ms"], r["size"]) for r in t.collect()]

    def nearest(own):
        own = sorted(own)
        return own[-(-95 * len(own) // 100) - 1] if own else 0.0

    for r in K.large_threshold(grid, t).collect():
        assert r["large_trade_threshold_size"] == nearest([n for ts, n in rows if r["ts_ms"] - 300_000 <= ts <= r["ts_ms"]])
    frame = t.drop("session_id")
    tape_stream.drop_files(frame.coalesce(1), f"{tmp_path}/in")
    tape_stream.drain(tape_stream.st_threshold(tape_stream.source(spark, f"{tmp_path}/in", schema=frame.schema, files_each=1)), f"{tmp_path}/out", f"{tmp_path}/state")
    found = {r["ts_ms"]: r["threshold"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    ends = range(T0 // 10_000 * 10_000 + 9_999, max(ts for ts, _ in rows) + 300_000, 10_000)
    want = {e: nearest(own) for e in ends if (own := [n for ts, n in rows if e - 299_999 <= ts <= e])}
    assert found == want
