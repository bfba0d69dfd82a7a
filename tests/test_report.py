"""Rules of the report layer on hand-made tapes, with numbers that follow from the rules by hand."""

import pytest
from pyspark.sql import functions as F

from levelscope.operators import bars, report, scoring, stats, tape, ticks, timeline, verdicts, zones
from levelscope.sources import store, tape_files

from .test_tape import T0, quotes, trades

LEVEL = "symbol string, session_id string, level_id string"


def level(spark, *rows):
    return spark.createDataFrame([("S", "S_1", i, float(p), t, 0.25, 0) for i, p, t in rows], LEVEL + ", level_price double, level_type string, level_width_atr double, created_ts_ms long")


def stream(spark, prices, **columns):
    """A session stream of these prices, ten seconds each; further columns by name, a value a tick."""
    base = {"delta": 0.0, "relative_aggression": 0.0, "total_volume": 10.0, "trade_count": 1, "buy_volume": 5.0, "sell_volume": 5.0, "atr": 1.0, "compression_index": 0.5}
    base |= {"large_trade_count_10s": 0, "large_buy_volume_10s": 0.0, "large_sell_volume_10s": 0.0, "large_trade_delta": 0.0}
    rows = []
    for k, p in enumerate(prices):
        own = {n: (columns[n][k] if n in columns else v) for n, v in base.items()}
        rows.append(("S", "S_1", T0 + 9999 + 10_000 * k, float(p), float(p), float(p), *own.values()))
    kinds = ", ".join(f"{n} {'long' if isinstance(v, int) else 'double'}" for n, v in base.items())
    return spark.createDataFrame(rows, f"symbol string, session_id string, ts_ms long, last_price double, high_10s double, low_10s double, {kinds}")


def test_a_flat_tape_has_no_range_and_nothing_fails(spark):
    t = trades(spark, [(T0 + 7_000 * k, 100, 5) for k in range(400)])
    q = quotes(spark, [(T0 + 30_000 * k, 99.99, 100.01) for k in range(90)])
    one = bars.bars(t, {"1m": 60_000})
    averages = bars.atr(bars.with_emas(one), seed=0.0).select("symbol", "session_id", "end_ts", "ema9", "ema20", "ema30", "ema200", "atr", "atr_status")
    s = store.kept(ticks.session_stream(bars.vwap(t), q, tape.lee_ready(tape.asof_quote(t, q)), averages))
    last = s.orderBy(F.desc("ts_ms")).first()
    assert (last["atr"], last["compression_index"], last["price_minus_vwap_atr"], last["stretch_200_atr"], last["ema_confluence_score"]) == (0, 0, 0, 0, 1)
    lv = level(spark, ("L", 100.0, "support"), ("M", 100.05, "resistance"))
    found = timeline.touch_packets(timeline.interaction_timeline(timeline.level_ticks(s, lv)))
    assert found.where("approach_velocity_atr_per_min IS NOT NULL").count() == 0
    assert zones.episodes(zones.zone_events(zones.zone_distance(s, lv))).count() == 0 and report.reclaim_packets(s, lv).count() == 0


def test_compression_before_a_touch_and_its_trend(spark):
    lv = level(spark, ("L", 100.0, "support"))
    s = stream(spark, [101] * 6 + [100, 101, 101], compression_index=[0.1, 0.2, 0.3, 0.7, 0.8, 0.9, 5.0, 0.0, 0.0])
    p = timeline.touch_packets(timeline.interaction_timeline(timeline.level_ticks(s, lv))).first()
    assert p["compression_at_touch"] == pytest.approx(0.5) and p["compression_trend_into_touch"] == "tightening"
    assert p["touch_outcome"] == "hold" and p["bounce_return_30s_pct"] == pytest.approx(0.01) and p["touch_dwell_s"] == 10


def packet_rows(spark, rows):
    """Packets by (outcome, bounce, large buys, large sells, count); ten seconds apart."""
    data = []
    for k, (outcome, bounce, buy, sell, n) in enumerate(rows, 1):
        ratio = buy / (buy + sell) if buy + sell else None
        data.append(("S", "S_1", "L", "support", 100.0, k, T0 + 60_000 * k, outcome, bounce, 0.1, 100.0, 0.6, "flat", float(buy), float(sell), float(buy - sell), ratio, n, n >= 5 and ratio is not None and ratio > 0.6, n >= 5 and ratio is not None and ratio < 0.4, outcome != "hold", None, None, 20.0, "grind", "above", False, False))
    return spark.createDataFrame(data, LEVEL + ", level_type string, level_price double, touch_number int, ts_ms long, touch_outcome string, bounce_return_30s_pct double, rel_aggr_0_30s double, band_delta_0_30s double, compression_at_touch double, compression_trend_into_touch string, large_buy_30s double, large_sell_30s double, large_delta_30s double, large_buy_ratio_30s double, large_count_30s long, institutional_buy boolean, institutional_sell boolean, break_confirmed_30s boolean, reclaim_hold_30s boolean, wick_recovered_flag boolean, touch_dwell_s double, approach_type string, from_side string, delta_flip_flag boolean, div_flag_at_touch boolean")


def test_breaks_that_were_reclaimed_for_good_are_none(spark):
    rows = [("hold", 0.01, 9, 1, 0)] * 8 + [("break_reclaim_hold", 0.01, 9, 1, 0)] * 3 + [("break", -0.01, 1, 9, 0)]
    got = scoring.level_stats(packet_rows(spark, rows)).first()
    assert (got["touches"], got["breaks"], got["n_break_reclaim_hold"], got["quality"]) == (12, 1, 3, "moderate")
    assert got["positive_bounce_rate"] == 0.917 and [x["bounce"] for x in got["top_bounces"]] == [0.01] * 3


def minute_rows(spark, rows):
    return spark.createDataFrame([("S", "S_1", i, T0 + 60_000 * k, 1, b, s, float(buy), float(sell)) for i, k, buy, sell, b, s in rows], LEVEL + ", minute_ts long, touches long, inst_buy long, inst_sell long, buy double, sell double")


def test_dumps_that_stop_hard_have_no_score(spark):
    m = minute_rows(spark, [
        ("A", 0, 10_000, 40_000, 0, 1), ("A", 1, 20_000, 1_000, 1, 0), ("A", 2, 30_000, 1_000, 1, 0),  # taken: ratio, accelerations, institutions, shift
        ("B", 0, 10_000, 40_000, 0, 0), ("B", 1, 1_000, 15_000, 0, 0), ("B", 2, 90_000, 1_000, 3, 0),  # goes on in the next minute
        ("C", 0, 10_000, 40_000, 0, 0), ("C", 1, 5_000, 5_000, 0, 0),  # nobody buys
        ("D", 0, 10_000, 9_000, 0, 0),  # no dump at all
    ])
    dumps = {x["level_id"]: x for x in scoring.wash_dumps(m).where("minute_ts = " + str(T0)).collect()}
    assert dumps["A"]["score"] == 2 + 2 + 2 + 2 and dumps["A"]["absorbed"]
    assert (dumps["B"]["score"], dumps["B"]["absorbed"], dumps["B"]["hard_stop_a"]) == (0, False, True) and dumps["C"]["hard_stop_b"]
    got = {x["level_id"]: (x["verdict"], x["hard_stop"], x["score"]) for x in scoring.wash_verdict(m, scoring.wash_dumps(m)).collect()}
    assert got == {"A": ("STRONG_WASH", None, 8 + 1 + 1), "B": ("HARD_STOP", "BREAKDOWN_CONTINUES", 2), "C": ("HARD_STOP", "NO_BUYERS", 0), "D": ("NO_WASH", None, 0)}


def test_patterns_of_a_turnaround(spark):
    """Four phases - + + +: a turnaround, buyers of the last three and four, reversal, ends ++, delta turned up, more bought."""
    p = packet_rows(spark, [("hold", 0.0, 100, 200, 0), ("hold", 0.0, 200, 100, 0), ("hold", 0.0, 200, 100, 0), ("hold", 0.0, 200, 100, 0)])
    m = minute_rows(spark, [("L", k, 100, 100, 0, 0) for k in range(1, 5)])
    wash = scoring.wash_verdict(m, scoring.wash_dumps(m))
    ph = scoring.phases(p)
    got = verdicts.pattern_verdict(ph, m, verdicts.inst_balance(p), wash).first()
    # early delta is -100 + 100 = 0: no flip; the rest as above with 1 + 2 + 1 + 2 + 1 + 2 + 2
    assert (got["progression"], got["score"], got["direction"], got["confidence"]) == ("-+++", 11, "LONG", "TAKE")
    one = verdicts.resistance_trend(scoring.phases(p, F.lit(1), 500.0)).first()
    assert (one["phases"], one["score"], one["trend"]) == (1, 1, "SINGLE_PHASE_BULLISH")
    assert verdicts.weighted_verdict(ph, verdicts.inst_balance(p)).first()["phases"] == 4


def test_reclaim_after_a_deeper_tag(spark):
    prices = [101, 100.5, 99.0, 98.5, 99.0, 100.0, 100.2, 100.2, 100.2, 100.2, 99.0]
    s = stream(spark, prices, delta=[0.0] * 5 + [5.0] * 6, relative_aggression=[0.2] * 11)
    (got,) = report.reclaim_packets(s, level(spark, ("hi", 100.0, "support"), ("lo", 98.5, "support"))).collect()
    assert (got["level_id"], got["deeper_id"], got["tag_ts_ms"], got["time_to_reclaim_ms"]) == ("hi", "lo", T0 + 39_999, 20_000)
    assert (got["snapback"], got["hold_30s"], got["hold_60s"], got["band_delta_30s"], got["drop_atr"], got["flush"]) == (True, True, False, 15.0, 1.5, True)


def test_features_without_deviation_have_no_effect(spark):
    rows = [(f"e{k}", ph, T0 + n, 1.0 if ph == "stress" and k < 2 else 0.0) for k in range(4) for n, ph in enumerate(("baseline", "stress"))]
    t = spark.createDataFrame(rows, "episode_id string, phase string, ts_ms long, delta double")
    out = spark.createDataFrame([(f"e{k}", "win" if k < 2 else "loss") for k in range(4)], "episode_id string, outcome string")
    got = stats.feature_ranking(t, out, ("delta",)).first()
    assert (got["wins"], got["losses"], got["diff"], got["effect"]) == (2, 2, 1.0, 0.0)


def test_percentiles_by_counted_values(spark):
    import numpy as np

    values = [float(x) for x in np.random.default_rng(1).integers(0, 300, 2001)] + [None]
    df = spark.createDataFrame([(x, 7.0) for x in values], "a double, b double")
    got = {x["column"]: x for x in stats.dq_dists(df, ["a", "b"]).collect()}
    known = np.array(values[:-1])
    assert got["a"]["p50"] == np.percentile(known, 50) and got["a"]["p90"] == pytest.approx(np.percentile(known, 90)) and got["a"]["mean"] == pytest.approx(known.mean())
    assert (got["b"]["min"], got["b"]["p50"], got["b"]["max"]) == (7, 7, 7)


def test_levels_and_commands_are_checked(spark, tmp_path):
    good = "ts_ms,ticker,type,marker_type,level_price,level_type,notes\n5,S,add_level,,101.5,support,\n4,S,add_marker,breakdown,,,\"{\"\"end_ts_ms\"\":9}\"\n"
    (tmp_path / "good.csv").write_text(good)
    (tmp_path / "bad.csv").write_text(good.replace("add_marker", "add_magic"))
    (tmp_path / "half.csv").write_text(good.replace("101.5", ""))
    c = tape_files.load_commands(spark, f"file://{tmp_path}/good.csv")
    levels, markers = zones.commanded(c.withColumnRenamed("ticker", "symbol").withColumn("session_id", F.lit("S_1")))
    assert [(x["level_id"], x["level_width_atr"], x["created_ts_ms"]) for x in levels.collect()] == [("manual:S:5:101.5", 0.25, 5)]
    assert [(x["marker_id"], x["notes"]) for x in markers.collect()] == [("marker:S:4:breakdown", '{"end_ts_ms":9}')]
    for name in ("bad.csv", "half.csv"):
        with pytest.raises(ValueError):
            tape_files.load_commands(spark, f"file://{tmp_path}/{name}")
    (tmp_path / "levels.json").write_text('{"ticker":"S","level_id":"a","level_price":1.5,"level_type":"support","level_source":"manual"}\n')
    assert tape_files.load_levels(spark, f"file://{tmp_path}/levels.json", ticker="S").first()["level_width_atr"] == 0.25
    with pytest.raises(ValueError):
        tape_files.load_levels(spark, f"file://{tmp_path}/levels.json", ticker="T")
