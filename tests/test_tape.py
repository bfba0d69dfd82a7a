"""Hand-made tapes with known results, and properties against a plain event loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from levelscope.functions import expressions as X
from levelscope.operators import bars, scoring, tape, ticks, windows, zones
from levelscope.sources import store, tape_files
from levelscope.streaming import tape_stream

T0 = 1704205800000  # 09:30 in New York


def trades(spark, rows):
    """rows of (ts_ms, price, size) in arrival order."""
    data = [(k, "S", "S_1", t, float(p), float(s), []) for k, (t, p, s) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, symbol string, session_id string, ts_ms long, price double, size double, conditions array<string>")


def quotes(spark, rows):
    data = [(k, "S", "S_1", t, float(b), 1.0, float(a), 1.0) for k, (t, b, a) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, symbol string, session_id string, ts_ms long, bid double, bid_size double, ask double, ask_size double")


def test_one_minute_bar_and_equal_times(spark):
    df = trades(spark, [(T0, 10, 1), (T0 + 1, 11, 2), (T0 + 2, 9.5, 3), (T0 + 2, 10.5, 4)])
    b = bars.bars(df).where("tf = '1m'").first()
    assert (b["open"], b["high"], b["low"], b["close"], b["volume"], b["trade_count"]) == (10, 11, 9.5, 10.5, 10, 4)
    assert b["end_ts"] - b["bar_ts"] == 60_000 and bars.bars(df.limit(0)).count() == 0


def test_vwap_premarket_and_new_day(spark):
    df = trades(spark, [(T0 - 3_600_000, 100, 1), (T0, 110, 1), (T0 + 86_400_000, 200, 1)])
    got = {p: [r["vwap"] for r in bars.vwap(df, premarket=p).orderBy("ts_ms").collect()] for p in (False, True)}
    assert got == {False: [None, 110, 200], True: [100, 105, 200]}


def test_ema_and_atr_recursions(spark):
    r = random.Random(1)
    df = trades(spark, [(T0 + 60_000 * k, 100 + r.random(), 1) for k in range(40)])
    one = bars.bars(df, {"1m": 60_000})
    e = None
    got = bars.with_emas(one).orderBy("bar_ts").collect()
    for x in got:
        e = x["close"] if e is None else e + (x["close"] - e) * 2 / 10
        assert x["ema9"] == pytest.approx(e)
    rows = bars.atr(one).orderBy("bar_ts").collect()
    assert [x["atr_status"] for x in rows[:14]] == ["blending"] * 13 + ["live"]
    mean = sum(x["tr"] for x in rows[:5]) / 5
    assert rows[4]["atr"] == pytest.approx(0.7 * 0.5 + 0.3 * mean)
    assert rows[14]["atr"] == pytest.approx((rows[13]["atr"] * 13 + rows[14]["tr"]) / 14)


@pytest.mark.parametrize("need_quote", [True, False])
def test_sides_equal_an_event_loop(spark, need_quote):
    r = random.Random(5)
    t = [(T0 + r.randrange(9_000_000), 100 + r.randrange(-4, 5) / 100, r.randrange(1, 9)) for _ in range(300)]
    q = [(T0 + 600_000 + r.randrange(9_000_000), 99.99, 100.01) for _ in range(40)]
    got = {x["seq"]: x["side"] for x in tape.lee_ready(tape.asof_quote(trades(spark, t), quotes(spark, q)), need_quote).collect()}
    prev = last = None
    for k, (ts, price, _) in sorted(enumerate(t), key=lambda x: (x[1][0], x[0])):
        has = any(x[0] <= ts for x in q)
        if not has and need_quote:
            assert got[k] == "unknown"
            continue
        side = None
        if has:
            side = "buy" if price >= 100.01 else "sell" if price <= 99.99 else None
        if side is None and prev is not None:
            side = "buy" if price > prev else "sell" if price < prev else last
        assert got[k] == (side or "unknown")
        prev, last = price, side or last


def zone_rows(spark, prices, atr=4.0, level=100.0):
    t = spark.createDataFrame([("S", "S_1", T0 + 10_000 * k, float(p), atr) for k, p in enumerate(prices)], "symbol string, session_id string, ts_ms long, last_price double, atr double")
    lv = spark.createDataFrame([("S", "S_1", "L", level, "support", 0.25, 0)], "symbol string, session_id string, level_id string, level_price double, level_type string, level_width_atr double, created_ts_ms long")
    return zones.zone_events(zones.zone_distance(t, lv))


def test_touch_confirmation(spark):
    got = zone_rows(spark, [98, 99.5, 98.5, 98.5]).orderBy("ts_ms").collect()
    assert [x["event"] for x in got] == [None, "enter", "exit", None] and [x["touch_count"] for x in got] == [0, 0, 0, 1] and got[1]["entry_side"] == "below"


def test_episode_success_and_timeout(spark):
    win = zones.episodes(zone_rows(spark, [98, 100, 101.5, 102.5])).first()
    assert win["outcome"] == "win" and win["start_time"] == win["zone_entry_time"] - 300_000 and win["resolution_time"] == T0 + 30_000
    late = zones.episodes(zone_rows(spark, [98, 100, *[101.2] * 40])).first()
    assert late["outcome"] == "scratch" and late["resolution_time"] == late["zone_exit_time"] + 300_000
    assert zones.episodes(zone_rows(spark, [98, 100, 101.2])).count() == 0


def test_approach_return_and_large_threshold(spark):
    df = spark.createDataFrame([("S", "S_1", T0 + 10_000 * k, 110.0 if k < 6 else 121.0) for k in range(7)], "symbol string, session_id string, ts_ms long, last_price double")
    assert ticks.approach_return(df).orderBy(F.desc("ts_ms")).first()["approach_return_60s"] == pytest.approx(math.log(1.1))
    t = trades(spark, [(T0 + k, 10, k + 1) for k in range(20)])
    grid = ticks.tick_grid(ticks.session_extent(t, quotes(spark, [(T0, 9, 11)])))
    assert ticks.large_threshold(grid, t).first()["large_trade_threshold_size"] == 19


def test_expressions(spark):
    row = spark.createDataFrame([(" Support ", "WIN", "2024-01-02 09:30:00", "2024-01-02T09:30:00-05:00", "oops")], "k string, o string, a string, b string, c string")
    got = row.select(X.scenario(F.col("k"), F.col("o")), X.parse_local(F.col("a"), "America/New_York"), X.parse_local(F.col("b"), "UTC"), X.parse_local(F.col("c"), "UTC"), X.velocity_bucket(F.lit(0.8), F.lit(None).cast("double"))).first()
    assert tuple(got) == ("long_win", T0, T0, None, "fast")
    assert [scoring.label(F.lit(1))] and spark.range(1).select(scoring.label(F.lit(9))).first()[0] == "STRONG_BUY"


def test_store_replaces_partitions_and_aliases(spark, tmp_path):
    df = trades(spark, [(T0, 10, 1), (T0 + 86_400_000, 11, 1)]).withColumn("pct_at_ask", F.lit(0.5))
    path = f"file://{tmp_path}"
    store.write(df, path, "session_stream")
    store.write(df.where(F.col("ts_ms") == T0).withColumn("price", F.lit(99.0)), path, "session_stream", replace=True)
    got = {r["date"].isoformat() if hasattr(r["date"], "isoformat") else r["date"]: (r["price"], r["pct_at_ask"]) for r in store.read(spark, path, "session_stream").collect()}
    assert got == {"2024-01-02": (99.0, 0.5), "2024-01-03": (11.0, 0.5)}
    assert "%_at_ask" in spark.read.parquet(f"{path}/session_stream").columns and store.list_sessions(spark, path, ("session_stream",)).count() == 2
    with pytest.raises(ValueError):
        store.write(df, path, "nonsense")


def test_vendor_messages(spark):
    lines = [
        '{"T":"t","S":"S","t":"2024-01-02T14:30:00.123456789Z","p":10.0,"s":2}', '[{"T":"q","S":"S","t":"2024-01-02T14:30:01Z","bp":9,"bs":1,"ap":11,"as":3},{"T":"t","S":"S","t":"2024-01-02T14:30:02.5Z","p":10.5,"s":1,"c":["W","@"]}]',
        '{"T":"success","msg":"connected"}',
    ]
    t, q = tape_files.vendor_a(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(x["ts_ms"], x["price"], x["size"], x["conditions"]) for x in t.orderBy("ts_ms").collect()] == [(T0 + 123, 10.0, 2.0, []), (T0 + 2500, 10.5, 1.0, ["W", "@"])]
    assert [(x["symbol"], x["ts_ms"], x["bid"], x["ask_size"]) for x in q.collect()] == [("S", T0 + 1000, 9.0, 3.0)]
    b = spark.createDataFrame([(1704205800123456789, 1, 10.0, 2.0), (None, 1704205800123, 11.0, 1.0), (None, None, 1.0, 1.0)], "sip_timestamp long, timestamp long, price double, size double")
    good, bad = tape_files.vendor_b(b, "S")
    assert [r["ts_ms"] for r in good.collect()] == [1704205800123] * 2 and bad.count() == 1
    with pytest.raises(ValueError):
        tape_files.scan_trades(spark, _csv(spark), "csv")


def _csv(spark):
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/x"
    spark.range(1).write.option("header", "true").csv(path)
    return path


def test_stream_equals_batch(spark, tmp_path):
    """All windows of the tape, the last ones too, over several batches."""
    r = random.Random(3)
    df = trades(spark, sorted((T0 + r.randrange(600_000), 100 + r.random(), r.randrange(1, 5)) for _ in range(200))).withColumn("side", F.when(F.col("seq") % 3 == 0, "buy").otherwise("sell"))
    tape_stream.drop_files(df.drop("session_id"), f"{tmp_path}/in")
    schema = df.drop("session_id").schema
    made = {"bars": tape_stream.st_bars, "flow": tape_stream.st_flow}
    for name, make in made.items():
        tape_stream.drain(make(tape_stream.source(spark, f"{tmp_path}/in", files_each=1, schema=schema)), f"{tmp_path}/{name}", f"{tmp_path}/state-{name}")
    got = {x["bar_ts"]: (x["open"], x["close"], x["volume"]) for x in spark.read.parquet(f"{tmp_path}/bars").collect()}
    assert got == {x["bar_ts"]: (x["open"], x["close"], x["volume"]) for x in bars.bars(df, {"1m": 60_000}).collect()}
    flow = spark.read.parquet(f"{tmp_path}/flow").agg(F.sum("trade_count"), F.sum("buy_volume"), F.sum("sell_volume")).first()
    want = df.agg(F.count("*"), F.sum(F.when(F.col("side") == "buy", F.col("size"))), F.sum(F.when(F.col("side") == "sell", F.col("size")))).first()
    assert tuple(flow) == tuple(want)


def test_a_dropped_tape_is_computed_once(spark, tmp_path):
    """However many files it is cut into: once to find the spans of time, and once to be kept."""
    n, read = 2000, spark.sparkContext.accumulator(0)

    def row(k):
        read.add(1)
        return (k, "S", T0 + k * 7)

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(n), 3).map(row), "seq long, symbol string, ts_ms long")
    tape_stream.drop_files(df, f"{tmp_path}/in", file_rows=100)
    assert read.value <= 2 * n
    assert spark.read.parquet(f"{tmp_path}/in").where("seq IS NOT NULL").count() == n


def test_dropped_files_are_in_order_of_time(spark, tmp_path):
    """Whatever partitions the tape comes in: each file begins after all that were written before it end, and no row is lost."""
    from pathlib import Path

    df = trades(spark, [(T0 + k * k, 10, 1) for k in range(300)] + [(T0 + 500, 10, 1)] * 40).repartition(5)
    for file_rows in (1000, 30):
        tape_stream.drop_files(df, f"{tmp_path}/{file_rows}", file_rows=file_rows)
        files = sorted(Path(f"{tmp_path}/{file_rows}").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
        times = [[x["ts_ms"] for x in spark.read.parquet(str(f)).collect()] for f in files]
        assert all(max(a) < min(b) for a, b in zip(times, times[1:]))
        assert sorted(x for own in times[:-1] for x in own) == sorted(x["ts_ms"] for x in df.collect()) and len(times[-1]) == 1
        assert len(files) == 5 if file_rows == 1000 else len(files) > 9 and max(map(len, times)) < 80


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def joins_by_slice(df):
    """Joins of the plan that match slices of time as well as sessions."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Join " in line and line.count("_slice#") == 2 for line in plan.splitlines())


def test_markers_meet_the_ticks_of_their_slices_alone(spark):
    r = random.Random(7)
    price = [100 + 3 * math.sin(k / 9) + r.random() for k in range(700)]
    tick = [(s, T0 + 10_000 * k, p + (s == "T"), 2.0) for s in "ST" for k, p in enumerate(price) if k % 50 and k > 20]
    t = spark.createDataFrame([(s, s + "_1", ts, p, a, 3, 5.0, 1.0, 4.0, 0.5) for s, ts, p, a in tick], "symbol string, session_id string, ts_ms long, last_price double, atr double, trade_count long, total_volume double, delta double, buy_volume double, relative_aggression double").withColumn("sell_volume", F.lit(1.0))
    every = [(f"m{k}", "ST"[k % 2], T0 + r.randrange(-100_000, 7_100_000) // (1 + k % 3) // 10_000 * 10_000 + k % 2) for k in range(80)] + [("none", "U", T0)]
    m = spark.createDataFrame([(i, s, s + "_1", ts, "consolidation", "short" if s == "T" else "long") for i, s, ts in every], "marker_id string, symbol string, session_id string, ts_ms long, marker_type string, direction_bias string")
    one = {(x["symbol"], x["ts_ms"]): x["marker_id"] for x in m.orderBy(F.desc("marker_id")).collect()}
    want, means, spans = {}, {}, {}
    for i, s, ts in every:
        own = [x for x in tick if x[0] == s]
        last = [x[2] for x in own if ts - 300_000 < x[1] <= ts]
        if last:
            means[i] = pytest.approx(sum(last) / len(last))
        for k, (a, b) in enumerate(windows.COUNTDOWN):
            n = sum(ts - a * 1000 < x[1] <= ts - b * 1000 for x in own)
            if n:
                spans[i, k] = n
        level = next((x[2] for x in reversed(own) if x[1] <= ts), own[0][2] if own else None)
        moves, end = [], None
        for _, at, p, atr in own:
            if ts - 120_000 <= at <= ts + 600_000 and end is None:
                moves.append((p - level) / atr * (-1 if s == "T" else 1))
                if at >= ts + 120_000 and (at >= ts + 600_000 or moves[-1] >= 0.5 or moves[-1] <= -0.35):
                    end = at
        if moves and one[s, ts] == i:
            want[i] = (level, end, pytest.approx(max(0, *moves)), pytest.approx(max(0, *(-x for x in moves))))
    found = zones.marker_episodes(m, t)
    assert {x["marker_id"]: (x["level_price"], x["resolution_time"], x["mfe"], x["mae"]) for x in found.collect()} == want and len(want) > 60
    anchors = m.withColumnRenamed("ts_ms", "anchor_ts")
    down, stats = windows.countdown(anchors, t), windows.anchor_stats(anchors, t, ["last_price"])
    assert {(x["marker_id"], x["window"]): x["points"] for x in down.collect()} == spans and {x["marker_id"]: x["mean"] for x in stats.collect()} == means
    assert (joins_by_slice(found), joins_by_slice(down), joins_by_slice(stats)) == (2, 1, 1)
