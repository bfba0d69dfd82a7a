"""Queries of the report's second layer, of stored tables and of checks, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..functions import expressions as X
from ..operators import document as D
from ..operators import report as P
from ..operators import scoring as S
from ..operators import stats as G
from ..operators import ticks as K
from ..operators import timeline as L
from ..operators import verdicts as V
from ..operators import zones as Z
from ..schemas import KEY
from ..sources import store, tape_files
from .level_oracles import _E, _K, _L, _W
from .level_queries import _markers, _snapshots, base, heavy, heavy_stream, minutes, packets, wash
from .oracles import CTES, r, sql
from .queries import Query, Tape, rounded, tape_of


def whole(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def joined(name: str) -> F.Column:
    return F.array_join(name, ",").alias(name)


def _reclaims(t: Tape) -> DataFrame:
    return P.reclaim_packets(t.stream, t.levels)


def _reclaim_packets(t: Tape) -> DataFrame:
    names = ["rel_aggr_30s", "drop_pct", "drop_atr"]
    out = _reclaims(t).select(*L.LEVEL, "deeper_id", "tag_ts_ms", "reclaim_ts_ms", "time_to_reclaim_ms", "snapback", "band_delta_30s", "band_delta_60s", "hold_30s", "hold_60s", "flush", *names)
    return rounded(out, *names)


def _main_support(t: Tape) -> DataFrame:
    events = L.interaction_timeline(base(t))
    return whole(P.main_support(t.levels, L.timeline_summary(events), L.role_flip(events), _reclaims(t)), "score")


def positive(t: Tape) -> DataFrame:
    return P.positive_touches(heavy(t), adapters.level_outcomes(t.levels), adapters.BOUNCE)


def _compare(t: Tape) -> DataFrame:
    return rounded(P.pattern_compare(positive(t)), "rate")


def _level_verdict(t: Tape) -> DataFrame:
    out = V_level(t).select(*L.LEVEL, "touches", "avg_score", "last5_avg_score", "peak_score", "peak_touch_number", "trough_score", "trough_touch_number", "cum_final_score", "late_inst_sell", "late_inst_buy", "late_break", "ending_strong", "ending_weak", "verdict", "thin_liquidity", F.get("top_plus", 0).alias("top_plus"))
    return rounded(whole(out, "peak_score", "peak_touch_number", "trough_score", "trough_touch_number", "cum_final_score"), "avg_score", "last5_avg_score")


def V_level(t: Tape) -> DataFrame:
    shares = L.band_rates(L.band_summary(base(t)), F.col("time_in_band_s") / 60)
    return S.level_verdict(S.touch_score(heavy(t)), shares)


def _cum(t: Tape) -> DataFrame:
    out = S.touch_cum_score(S.touch_score(heavy(t))).select(*L.LEVEL, "ts_ms", "cum_score", "cum_bucket", "cum_label", "cum_min", "cum_max", F.round("cum_height_pct", 6).alias("cum_height_pct"))
    return whole(out, "cum_score", "cum_bucket", "cum_min", "cum_max")


def _large(t: Tape) -> DataFrame:
    names = ["large_buy_ratio_30s", "large_rate_30s", "large_vs_baseline_ratio", "large_buy_vs_sell_ratio"]
    out = packets(t).select(*L.LEVEL, "ts_ms", "large_count_at_touch", "large_delta_at_touch", "large_count_30s", "large_buy_30s", "large_sell_30s", "large_delta_30s", "institutional_buy", "institutional_sell", "large_size_imbalance", *names)
    return rounded(whole(out, "large_count_at_touch", "large_count_30s"), *names)


def _context(t: Tape) -> DataFrame:
    names = ["compression_at_touch", "price_efficiency_0_30s", "spread_pct_at_touch"]
    out = packets(t).select(*L.LEVEL, "ts_ms", "minute_start_ms", "compression_trend_into_touch", "cvd_60s_at_touch", "cvd_slope_into_touch", "div_flag_at_touch", "price_vs_vwap_at_touch", "ema_stack_at_touch", "spread_narrowing_after_touch", *names)
    return rounded(out, *names)


def _rates(t: Tape) -> DataFrame:
    names = ["volume_per_min", "trades_per_min", "shares_per_trade", "large_sell_pct"]
    return rounded(L.band_rates(L.band_summary(base(t)), F.col("time_in_band_s") / 60).select(*L.LEVEL, *names), *names)


def _phase_sets(t: Tape) -> DataFrame:
    """Phases by gaps of three minutes, won beyond 500 shares."""
    return S.phases(S.gap_phases(heavy(t)), F.col("phase_id"), 500.0)


def _pattern(t: Tape) -> DataFrame:
    out = V.pattern_verdict(S.phases(heavy(t)), minutes(t), V.inst_balance(heavy(t)), wash(t))
    return whole(out.drop("rules"), "score")


def _resistance(t: Tape) -> DataFrame:
    return whole(V.resistance_trend(_phase_sets(t)), "score", "phases")


def _weighted(t: Tape) -> DataFrame:
    out = V.weighted_verdict(S.phases(heavy(t)), V.inst_balance(heavy(t)))
    return rounded(whole(out, "trend_score", "phases"), "early_score", "mid_score", "late_score", "combined")


def _checklist_eval(t: Tape) -> DataFrame:
    bands = L.band_summary(L.level_ticks(heavy_stream(t), t.levels))
    out = V.checklist_eval(heavy(t), bands)
    return out.select(*L.LEVEL, "touches", F.round("sell_pct", 6).alias("sell_pct"), "softened", joined("gates"), joined("greens"), joined("cautions"), "verdict")


def nodes(t: Tape) -> DataFrame:
    return P.chain_nodes(adapters.chain_markers(t.spark, t.sf_dir))


def _nodes(t: Tape) -> DataFrame:
    return whole(nodes(t).select(*P.NODE, "watch_start_ts_ms", "watch_end_ts_ms", "level_price", "level_type", "band_pct", "indicator"), "position")


SUMMARY = ["return_abs", "relative_aggression_mean", "compression_mean", "band_relative_aggression_mean", "reclaim_hold_rate", "level_price"]


def _watch(t: Tape, moving: bool) -> DataFrame:
    found = P.watch_summary(P.node_ticks(t.stream, nodes(t).where("indicator IS NOT NULL" if moving else "indicator IS NULL")), P.NODE)
    out = found.select(*P.NODE, "points", "trades", "volume", "delta", "time_in_band_s", "band_volume", "band_delta", "touch_count", "cross_count", "reclaim_attempts", "reclaim_holds_30s", "flag_score", joined("flags"), *SUMMARY)
    return rounded(whole(out, "position", "flag_score", "trades"), *SUMMARY)


def _tag_windows(t: Tape) -> DataFrame:
    return P.tag_windows(_markers(t))


def _watch_windows(t: Tape) -> DataFrame:
    """Every marker's watch, tag by tag."""
    out = P.watch_summary(P.node_ticks(t.stream, _tag_windows(t)), P.NODE)
    out = out.select(F.col("chain_id").alias("marker_id"), F.col("position").cast("long").alias("tag"), "points", "delta", "time_in_band_s", "band_delta", "touch_count", F.col("flag_score").cast("long").alias("flag_score"), "return_abs")
    return rounded(out, "return_abs")


def _checklist(t: Tape) -> DataFrame:
    _, _, checks = P.watch_report(t.stream, nodes(t))
    names = ["compression_mean", "compression_change", "rel_aggr_last30s", "rel_aggr_last60s"]
    return rounded(whole(checks, "position"), *names)


def _moments(t: Tape) -> DataFrame:
    """Every marker taken as a moment: its notes without an end."""
    plain = _markers(t).withColumn("notes", F.regexp_replace("notes", r'"end_ts_ms":\d+,', ""))
    out = P.event_markers(t.stream, plain)
    return rounded(out.select("marker_id", "window", "points", "volume", "delta", "time_in_band_s", "band_delta", "return_abs"), "return_abs")


def _moves(t: Tape) -> DataFrame:
    out = P.chain_moves(t.stream, nodes(t))
    out = out.select(*P.NODE, "start_ts_ms", "end_ts_ms", "points", "delta", "velocity_bucket", "direction", "flow_side", "flow_strength", "flow_imbalance", "verdict")
    return rounded(whole(out, "position"), "flow_imbalance")


def exported(t: Tape, df: DataFrame) -> DataFrame:
    """A table as CSV with a header, read back."""
    path = store.scratch(t.spark)
    P.flat(df).write.option("header", "true").csv(path)
    return t.spark.read.option("header", "true").schema(P.flat(df).schema).csv(path)


def _x_touch(t: Tape) -> DataFrame:
    return whole(exported(t, packets(t)).select(*L.LEVEL, "ts_ms", "touch_number", "touch_outcome", "from_side", "institutional_buy"), "touch_number")


def _x_reclaim(t: Tape) -> DataFrame:
    back = exported(t, _reclaims(t))
    return back.select(*L.LEVEL, P.reclaim_id(F.col("level_price"), F.col("deeper_price"), F.col("reclaim_ts_ms")).alias("reclaim_id"), "hold_60s")


def _x_chains(t: Tape) -> DataFrame:
    back = exported(t, P.level_chains(t.stream, nodes(t)))
    return whole(back.select(*P.NODE, "points", "session_points", "move_verdict", "touch_count", "session_touch_count", "compression_level"), "position")


def _x_watch(t: Tape) -> DataFrame:
    nodes_ = _tag_windows(t)
    windows = P.watch_countdown(P.node_ticks(t.stream, nodes_), P.NODE)
    back = exported(t, windows)
    return back.select(F.col("chain_id").alias("marker_id"), F.col("position").cast("long").alias("tag"), F.col("window").cast("long").alias("window"), "points", "volume", "band_delta")


def _commands(t: Tape) -> DataFrame:
    """Markers as commands, through a CSV file and back."""
    made = Z.marker_commands(_markers(t))
    path = store.scratch(t.spark)
    made.withColumnRenamed("symbol", "ticker").drop("session_id").write.option("header", "true").option("escape", '"').csv(path)
    return tape_files.load_commands(t.spark, path)


def _commands_load(t: Tape) -> DataFrame:
    return _commands(t).groupBy("ticker", "type", "level_type").agg(F.count("*").alias("n"), F.min("level_width_atr").alias("width"), F.max("ts_ms").alias("last_ts"))


def _levels_load(t: Tape) -> DataFrame:
    path = store.scratch(t.spark)
    rows = t.levels.select(F.col("symbol").alias("ticker"), F.concat_ws("-", "session_id", "level_id").alias("level_id"), "level_price", "level_type", F.lit("manual").alias("level_source"), "created_ts_ms")
    rows.write.json(path)
    return tape_files.load_levels(t.spark, path).select("ticker", "level_id", "level_price", "level_type", "level_width_atr", "created_ts_ms")


def _report_documents(t: Tape) -> tuple[str, DataFrame]:
    path = store.scratch(t.spark)
    brief = G.reports_index(t.episodes)
    doc = F.struct("episodes", "wins", "losses", F.create_map(F.lit("mfe_p50"), F.round("mfe_p50", 6)).alias("stats"))
    reports = brief.where("symbol = 'S0'").select(F.substring_index("session_id", "_", -1).alias("date"), F.col("symbol").alias("ticker"), F.col("session_id").alias("session"), doc.alias("report"))
    store.write_reports(reports, path)
    return path, store.read_reports(t.spark, path, "episodes bigint, wins bigint, losses bigint, stats map<string,double>")


def _report_doc(t: Tape) -> DataFrame:
    _, back = _report_documents(t)
    return back.select("ticker", "session", "report.episodes", "report.wins", "report.losses", F.col("report.stats")["mfe_p50"].alias("mfe_p50"))


def _whole_documents(t: Tape) -> tuple[dict[str, D.Part], DataFrame]:
    """The flat parts of the sessions' reports, and the documents that were written of them and read again."""
    path = store.scratch(t.spark)
    timeline = L.interaction_timeline(base(t))
    between, windows, _ = P.watch_report(t.stream, nodes(t))
    stats = S.level_stats(packets(t))
    stats = stats.select(*L.LEVEL, *[F.col(c).alias(f"stat_{c}") for c in stats.columns if c not in L.LEVEL])
    parts: dict[str, D.Part] = {
        "levels": (L.timeline_summary(timeline).join(stats, L.LEVEL, "left"), ["level_id"]),
        "touches": (packets(t), ["level_id", "ts_ms"]),
        "reclaims": (_reclaims(t), ["level_id"]),
        "watches": (between, ["chain_id", "position"]),
        "countdowns": (windows, ["chain_id", "position", "window"]),
        "moves": (P.chain_moves(t.stream, nodes(t)), ["chain_id", "position"]),
        "outcomes": (t.episodes.groupBy(*KEY, F.coalesce("outcome", F.lit("unresolved")).alias("outcome")).agg(F.count("*").alias("n")), ["outcome"]),
    }
    documents = D.session_documents(parts)
    dated = documents.select(F.substring_index("session_id", "_", -1).alias("date"), F.col("symbol").alias("ticker"), F.col("session_id").alias("session"), "report")
    store.write_reports(dated, path)
    back = store.read_reports(t.spark, path, D.document_schema(documents))
    return parts, back.select(F.col("ticker").alias("symbol"), F.col("session").alias("session_id"), "report")


def _report_document(t: Tape) -> DataFrame:
    """Sizes of the parts of each session's document, with what its touches and moves come to."""
    _, back = _whole_documents(t)
    sizes = [F.size(F.col("report").getField(n)).cast("long").alias(n) for n in ("levels", "touches", "reclaims", "moves")]
    held = F.size(F.filter("report.touches", lambda x: x["touch_outcome"] == "hold")).cast("long").alias("held")
    won = F.aggregate(F.filter("report.outcomes", lambda x: x["outcome"] == "win"), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("wins")
    moved = F.aggregate("report.moves", F.lit(0.0), lambda a, x: a + x["delta"]).alias("moved_delta")
    return back.select(*KEY, *sizes, held, won, moved)


def _backfill(t: Tape) -> DataFrame:
    _, back = _report_documents(t)
    sessions = t.episodes.select(F.col("symbol").alias("ticker"), F.col("session_id").alias("session")).distinct()
    return store.without_report(sessions, back)


def _sink_tape(t: Tape) -> DataFrame:
    path = store.scratch(t.spark)
    tape_files.write_tape(t.trades, path, ("ts_ms", "seq"))
    return t.spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date"), "symbol").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def _sink_alias(t: Tape) -> DataFrame:
    path = store.scratch(t.spark)
    store.write(t.flow.select(*K.TICK, "pct_at_ask", "pct_at_bid"), path, "session_stream")
    raw = t.spark.read.parquet(f"{path}/session_stream")
    return raw.groupBy("session").agg(F.count("*").alias("n"), F.round(F.sum("%_at_ask"), 4).alias("at_ask"), F.round(F.sum("%_at_bid"), 4).alias("at_bid"))


def _read_session(t: Tape) -> DataFrame:
    path = store.scratch(t.spark)
    snaps = _snapshots(t).select("episode_id", *Z.LEVEL, "ts_ms", "phase")
    store.write(snaps, path, "snapshots")
    first = t.episodes.where("symbol = 'S1'").agg(F.min_by("episode_id", F.struct("zone_entry_time", "level_id")).alias("e"), F.min_by("session_id", F.struct("zone_entry_time", "level_id")).alias("s")).first()
    return store.read(t.spark, path, "snapshots", ticker="S1", session=first["s"], episode=first["e"], order="ts_ms").select("level_id", "ts_ms", "phase")


def _drift(t: Tape) -> DataFrame:
    """Half of the ticks stored with a column of nulls, half without the column and with text for numbers."""
    a, b = store.scratch(t.spark), store.scratch(t.spark)
    flow = t.flow.select(*K.TICK, "trade_count", "total_volume")
    flow.where("symbol = 'S0'").withColumn("extra", F.lit(None).cast("string")).write.parquet(a)
    flow.where("symbol = 'S1'").withColumn("trade_count", F.col("trade_count").cast("string")).drop("total_volume").write.parquet(b)
    back = store.drift_read(t.spark, [a, b], "symbol string, trade_count long, total_volume double, extra double")
    return back.groupBy("symbol").agg(F.sum("trade_count").alias("trades"), F.sum("total_volume").alias("volume"), F.count("extra").alias("extras"))


def _outliers(t: Tape) -> DataFrame:
    out = G.dq_outliers(_snapshots(t), "delta", ["session_id"], ["ts_ms", "level_id", "zone_entry_time"])
    return whole(out, "rank")


def _episode_tick(t: Tape) -> DataFrame:
    found = t.episodes
    out = Z.episode_tick(found, t.stream.select(*K.TICK, "last_price", "trade_count"), t.trades)
    keyed = out.join(found.select("episode_id", "level_id", "zone_entry_time"), "episode_id")
    return whole(keyed.select(*L.LEVEL, "zone_entry_time", "ts_ms", "sequence_id", "phase", "last_price"), "sequence_id")


PLANS: dict[str, Callable[[Tape], DataFrame]] = {
    "reclaim_packets": _reclaim_packets,
    "main_support": _main_support,
    "positive_ledger": lambda t: whole(P.positive_ledger(positive(t)), "rank"),
    "pattern_index": lambda t: whole(P.pattern_index(positive(t)), "rank"),
    "pattern_compare": _compare,
    "level_verdict": _level_verdict,
    "touch_cum_score": _cum,
    "touch_large": _large,
    "touch_context": _context,
    "band_rates": _rates,
    "infer_interval": lambda t: whole(L.infer_interval(t.stream), "interval_s"),
    "inst_balance": lambda t: rounded(V.inst_balance(heavy(t)), "absorption_rate"),
    "pattern_verdict": _pattern,
    "resistance_trend": _resistance,
    "weighted_verdict": _weighted,
    "checklist_eval": _checklist_eval,
    "chain_nodes": _nodes,
    "window_summary": lambda t: _watch(t, False),
    "indicator_levels": lambda t: _watch(t, True),
    "watch_windows": _watch_windows,
    "checklist": _checklist,
    "event_markers": _moments,
    "chain_moves": _moves,
    "x_touch": _x_touch,
    "x_reclaim": _x_reclaim,
    "x_level_chains": _x_chains,
    "x_watch_windows": _x_watch,
    "marker_commands": lambda t: Z.marker_commands(_markers(t)).select(*KEY, "ts_ms", "type", "marker_id", "level_id", "level_price", "level_type", "direction_bias"),
    "commands_load": _commands_load,
    "levels_load": _levels_load,
    "report_doc": _report_doc,
    "report_document": _report_document,
    "report_backfill": _backfill,
    "sink_tape": _sink_tape,
    "sink_alias": _sink_alias,
    "read_session": _read_session,
    "drift_read": _drift,
    "dq_outliers": _outliers,
    "dq_time": lambda t: rounded(G.dq_time(t.episodes), "min", "p50", "p90", "max"),
    "dq_coverage": lambda t: G.dq_coverage(_snapshots(t), t.stream).select(*KEY, "first", "last", "inside"),
    "feature_corr": lambda t: rounded(G.feature_corr(_snapshots(t), t.episodes, ("delta", "relative_aggression", "signed_distance_atr", "compression_index")).drop("diff"), "win_mean", "loss_mean", "corr", digits=4),
    "episode_tick": _episode_tick,
}


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLANS[name](tape_of(spark, sf_dir))


QUERIES: dict[str, Query] = {name: partial(_run, name) for name in PLANS}

_N = f"{_K}, chain_id, position"
_NW = f"PARTITION BY {_N} ORDER BY ts_ms"
_FLAGS = ("pos_aggr", "pos_delta", "high_compression", "delta_flip", "div", "controlled_approach", "from_above")
CTES |= {
    "rpairs": f"""SELECT symbol, session_id, level_id, CAST(level_price AS DOUBLE) AS p, lead(level_id) OVER d AS did, lead(CAST(level_price AS DOUBLE)) OVER d AS dp FROM levels WINDOW d AS (PARTITION BY {_K} ORDER BY level_price DESC) QUALIFY did IS NOT NULL""",
    "rticks": f"""SELECT s.*, level_id, did, p, dp, p * (1 - 0.0015) AS lo, min(CASE WHEN last_price BETWEEN dp * (1 - 0.0015) AND dp * (1 + 0.0015) THEN ts_ms END) OVER (PARTITION BY {_L}) AS tag, avg(atr) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS atr6
  FROM stream s JOIN rpairs USING ({_K}) WHERE last_price IS NOT NULL""",
    "rback": f"""SELECT *, ts_ms >= tag AND last_price >= lo AND coalesce(max(CASE WHEN ts_ms >= tag AND last_price < lo THEN 1 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS back, max(CASE WHEN ts_ms = tag THEN atr6 END) OVER (PARTITION BY {_L}) AS tagatr,
  sum(delta) OVER a AS d30, sum(delta) OVER b AS d60, avg(relative_aggression) OVER a AS a30, min(last_price) OVER a >= lo AS h30, min(last_price) OVER b >= lo AS h60 FROM rticks WINDOW a AS ({_W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), b AS ({_W} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)""",
    "reclaims": f"""SELECT *, ts_ms - tag AS took, abs(dp - p) / tagatr AS datr FROM rback WHERE back QUALIFY row_number() OVER ({_W}) = 1""",
    "tsum": f"""SELECT {_L}, count(*) FILTER (event = 'reject') AS rejects, count(*) FILTER (event = 'break') AS breaks FROM tlr WHERE event IS NOT NULL GROUP BY ALL""",
    "tflip": f"""SELECT {_L}, bool_or(flip) AS flipped FROM (SELECT {_L}, coalesce(event = 'reject', false) AND coalesce(max(CASE WHEN event = 'break' THEN 1 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS flip FROM tlr) GROUP BY ALL""",
    "mscore": f"""SELECT l.symbol, l.session_id, l.level_id, CAST(l.level_price AS DOUBLE) AS level_price, l.created, CASE WHEN coalesce(rejects, 0) - coalesce(breaks, 0) >= 2 THEN 1 ELSE 0 END - CASE WHEN l.level_type = 'support' AND coalesce(flipped, false) THEN 2 ELSE 0 END - coalesce(breaks, 0)
  + coalesce(CASE WHEN h30 THEN 2 ELSE 0 END + CASE WHEN d30 > 0 AND a30 > 0.10 THEN 1 ELSE 0 END + CASE WHEN took <= 120000 THEN 1 ELSE 0 END, 0) AS score, coalesce(h30 AND took <= 120000, false) AS snapped
  FROM levels l LEFT JOIN tsum USING ({_L}) LEFT JOIN tflip USING ({_L}) LEFT JOIN reclaims USING ({_L})""",
    "posv": """SELECT *, CASE level_type WHEN 'support' THEN 'long' WHEN 'resistance' THEN 'short' ELSE 'unknown' END || '_' || CASE level_id WHEN 'L1' THEN 'win' WHEN 'L2' THEN 'loss' ELSE 'pending' END AS scenario,
  list_sort(list_filter([CASE WHEN a30 > 0 THEN 'pos_aggr' END, CASE WHEN d30 > 0 THEN 'pos_delta' END, CASE WHEN comp >= 1 THEN 'high_compression' END, CASE WHEN flip THEN 'delta_flip' END, CASE WHEN div THEN 'div' END, CASE WHEN speed < 0.75 THEN 'controlled_approach' END, CASE WHEN from_side = 'above' THEN 'from_above' END], lambda x: x IS NOT NULL)) AS flags FROM tpx""",
    "pos": "SELECT *, array_to_string(flags, '+') AS combo FROM posv WHERE CASE WHEN level_type = 'resistance' THEN b30 <= -0.0005 ELSE b30 >= 0.0005 END",
    "postall": "SELECT symbol, session_id, scenario, 'touches' AS kind, 'all' AS name FROM pos UNION ALL SELECT symbol, session_id, scenario, 'flag', unnest(flags) FROM pos UNION ALL SELECT symbol, session_id, scenario, 'combo', combo FROM pos WHERE combo <> ''",
    "lastscores": f"SELECT *, row_number() OVER (PARTITION BY {_L} ORDER BY tn DESC) AS bk FROM pts",
    "lverd": f"""SELECT {_L}, count(*) AS touches, avg(score) AS avg_score, avg(score) FILTER (bk <= 5) AS last5, max(score) AS peak, first(tn ORDER BY score DESC, tn) AS peakn, min(score) AS trough, first(tn ORDER BY score, tn) AS troughn, sum(score) AS final, bool_or(isell) FILTER (bk <= 3) AS ls, bool_or(ib) FILTER (bk <= 3) AS lbuy, bool_or(conf) FILTER (bk <= 3) AS lbr FROM lastscores GROUP BY ALL""",
    "lverb": "SELECT *, last5 - avg_score >= 2 AS es, avg_score - last5 >= 2 AS ew, CASE WHEN peak >= 16 THEN 'STRONG_BUY' WHEN peak >= 10 THEN 'BUY' WHEN peak <= -16 THEN 'STRONG_SELL' WHEN peak <= -10 THEN 'SELL' ELSE 'NEUTRAL' END AS v0 FROM lverd",
    "bands": f"""SELECT {_L}, count(*) FILTER (pos = 0) * 10.0 AS tib, coalesce(sum(trade_count) FILTER (pos = 0), 0) AS bn, coalesce(sum(total_volume) FILTER (pos = 0), 0.0) AS bv, coalesce(sum(delta) FILTER (pos = 0), 0.0) AS bd, coalesce(sum(lb) FILTER (pos = 0), 0.0) AS bb, coalesce(sum(ls) FILTER (pos = 0), 0.0) AS bs FROM lt GROUP BY ALL""",
    "bal": f"""SELECT {_L}, count(*) AS touches, count(*) FILTER (ib) AS nb, count(*) FILTER (isell) AS ns, coalesce(sum(lb30) FILTER (ib), 0.0) AS bv, coalesce(sum(ls30) FILTER (isell), 0.0) AS sv, count(*) FILTER (isell AND b30 > 0) AS absorbed, count(*) FILTER (isell AND NOT coalesce(b30 > 0, false)) AS confirmed FROM tpx GROUP BY ALL""",
    "pp": f"""SELECT {_L}, list(winner ORDER BY phase) AS w, list(delta ORDER BY phase) AS d, list(buy ORDER BY phase) AS b, list(sell ORDER BY phase) AS s, list(nb ORDER BY phase) AS ib, list(ns ORDER BY phase) AS isl, list(absorbed ORDER BY phase) AS ab, count(*) AS n FROM ph GROUP BY ALL""",
    "pm": f"""SELECT {_L}, list(buy ORDER BY minute_ts) AS mb, list(sell ORDER BY minute_ts) AS ms, list(nb ORDER BY minute_ts) AS mib, list(ns ORDER BY minute_ts) AS mis, count(*) AS k FROM mins GROUP BY ALL""",
    "pat": f"""SELECT *, array_to_string(w, '') AS prog, n // 2 AS half FROM bal JOIN pp USING ({_L}) JOIN pm USING ({_L}) JOIN (SELECT {_L}, stop, absorbed AS wa, failed AS wf FROM washed) USING ({_L})""",
}
_cnt = lambda x, c: f"len(list_filter({x}, lambda y: y = '{c}'))"
_last = lambda x, n: f"{x}[greatest(len({x}) - {n - 1}, 1):len({x})]"
_sum = lambda x: f"coalesce(list_sum({x}), 0)"
_late = lambda x: _sum(_last(x, 2))
_early = lambda x: _sum(f"{x}[1:2]")
_adj = lambda x: f"len(list_filter(range(1, k), lambda i: {x}[i] >= 1 AND {x}[i + 1] >= 1)) > 0"
_PATTERNS = [
    (1, f"{_cnt(_last('w', 3), '+')} >= 2"), (2, f"{_cnt(_last('w', 4), '+')} >= 3"), (3, f"n >= 2 AND {_cnt('w', '+')} = n"), (-1, f"{_cnt(_last('w', 3), '-')} >= 2"), (-2, f"{_cnt(_last('w', 4), '-')} >= 3"),
    (1, "w[n] = '+'"), (-1, "w[n] = '-'"), (2, "w[1] = '-' AND w[n] = '+'"), (-2, "w[1] = '+' AND w[n] = '-'"),
    (1, "bv > sv"), (2, "bv > sv * 2"), (-1, "sv > bv"), (-2, "sv > bv * 2"), (1, f"{_late('ib')} >= 1"), (-1, f"{_late('isl')} >= 1"),
    (2, f"{_early('isl')} >= 1 AND {_late('ib')} >= 1 AND {_late('isl')} = 0"), (-2, f"{_early('ib')} >= 1 AND {_late('isl')} >= 1 AND {_late('ib')} = 0"),
    (1, "coalesce(bv / nullif(nb, 0), 0) > coalesce(sv / nullif(ns, 0), 0) * 1.5 AND nb >= 1"), (-1, "coalesce(sv / nullif(ns, 0), 0) > coalesce(bv / nullif(nb, 0), 0) * 1.5 AND ns >= 1"),
    (2, _adj("mib")), (-2, _adj("mis")), (1, "mb[k] > ms[k] * 1.2"), (2, "k >= 2 AND mb[k] + mb[k - 1] > (ms[k] + ms[k - 1]) * 1.2"), (-1, "ms[k] > mb[k] * 1.2"), (1, "mib[k] >= 1"), (-1, "mis[k] >= 1"),
    (1, "k >= 3 AND mb[k - 1] > mb[k - 2] AND mb[k] > mb[k - 1]"), (-1, "k >= 3 AND ms[k - 1] > ms[k - 2] AND ms[k] > ms[k - 1]"), (1, f"{_sum('b')} > {_sum('s')}"), (-1, f"{_sum('s')} > {_sum('b')}"),
    (2, f"n >= 2 AND {_sum('d[1:half]')} < 0 AND {_sum('d[half + 1:n]')} > 0"), (-2, f"n >= 2 AND {_sum('d[1:half]')} > 0 AND {_sum('d[half + 1:n]')} < 0"),
    (2, "n >= 2 AND prog LIKE '%++'"), (-2, "n >= 2 AND prog LIKE '%--'"), (2, "n >= 2 AND prog LIKE '%-++%'"), (-2, "n >= 2 AND prog LIKE '%+--%'"), (2, "wa >= 1"), (3, "wa >= 2"), (-2, "wf >= 1"),
]


def _points(rules: list[tuple[int, str]]) -> str:
    return " + ".join(f"CASE WHEN {test} THEN {points} ELSE 0 END" for points, test in rules)


def _halves_sql(weighted: bool) -> str:
    e, l = (lambda x: _sum(f"{x}[1:h]")), (lambda x: _sum(f"{x}[h + 1:n]"))  # noqa: E731, E741
    margin, last = ("0", 2) if weighted else ("1000", 1)
    rules = [(1, f"{l('ib')} > {e('ib')}"), (-1, f"{l('ib')} < {e('ib')}"), (1, f"{l('isl')} < {e('isl')}"), (-1, f"{l('isl')} > {e('isl')}"), (1, f"{l('b')} > {e('b')} * 1.2"), (-1, f"{l('b')} < {e('b')} * 0.8"), (1, f"{l('s')} < {e('s')} * 0.8"), (-1, f"{l('s')} > {e('s')} * 1.2")]
    rules += [(1, f"{l('d')} > {e('d')} + {margin}"), (-1, f"{l('d')} < {e('d')} - {margin}"), (last, "w[n] = '+'"), (-last, "w[n] = '-'")]
    rules += [(1, f"{l('ib')} > {l('isl')}"), (-1, f"{l('isl')} > {l('ib')}")] if weighted else [(1, f"{l('ab')} > {e('ab')}"), (2, f"{l('ib')} > {l('isl')}"), (-1, f"{l('isl')} > {l('ib')}")]
    return _points(rules)


CTES |= {
    "pscored": f"SELECT *, {_points(_PATTERNS)} AS score, CASE WHEN sv > bv * 3 AND sv > 5000 THEN 'INST_SELL_DOMINATES' ELSE stop END AS hs FROM pat",
    "gph": f"""SELECT {_L}, list(CASE WHEN d > 500 THEN '+' WHEN d < -500 THEN '-' ELSE '=' END ORDER BY pid) AS w, list(d ORDER BY pid) AS d, list(b ORDER BY pid) AS b, list(s ORDER BY pid) AS s, list(ib ORDER BY pid) AS ib, list(isl ORDER BY pid) AS isl, list(ab ORDER BY pid) AS ab, count(*) AS n, greatest(1, count(*) // 2) AS h
  FROM (SELECT {_L}, pid, sum(lb30) - sum(ls30) AS d, sum(lb30) AS b, sum(ls30) AS s, count(*) FILTER (ib) AS ib, count(*) FILTER (isell) AS isl, count(*) FILTER (isell AND b30 > 0) AS ab FROM (SELECT *, sum(fresh) OVER ({_W}) AS pid FROM (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER ({_W}) <= 180000 THEN 0 ELSE 1 END AS fresh FROM tpx)) GROUP BY {_L}, pid) GROUP BY {_L}""",
    "rtr": f"SELECT *, {_sum('ib')} AS tb, {_sum('isl')} AS tsell, {_sum('d')} AS td, {_halves_sql(False)} AS raw FROM gph",
    "rts": "SELECT *, n >= 2 AND td > 0 AND tsell = 0 AS clean, CASE WHEN n < 2 THEN CASE WHEN td > 0 AND tsell = 0 THEN 1 WHEN td < 0 THEN -1 ELSE 0 END WHEN NOT (td > 0 AND tsell = 0) AND td > 0 AND tb > tsell THEN raw + 2 ELSE raw END AS score FROM rtr",
    "wv0": f"SELECT {_L}, n, w, d, b, s, ib, isl, bal.nb AS tb, bal.ns AS tsn, bal.bv, bal.sv, greatest(1, n // 2) AS h, greatest(1, CAST(floor(n * 0.3) AS INT)) AS ee, greatest(greatest(1, CAST(floor(n * 0.3) AS INT)), CAST(floor(n * 0.7) AS INT)) AS lst FROM pp JOIN bal USING ({_L})",
    "wv1": f"SELECT *, CASE WHEN n < 2 THEN 0 ELSE {_halves_sql(True)} END AS tr, list_transform(range(1, n + 1), lambda i: (sign(d[i]) + ib[i] - isl[i]) * CASE WHEN i <= ee THEN 0.5 WHEN i > lst THEN 2.0 ELSE 1.0 END) AS worth, list_transform(range(1, n + 1), lambda i: b[i] + s[i]) AS vol FROM wv0",
    "wv2": "SELECT *, coalesce(list_sum(worth[1:ee]), 0) AS es, coalesce(list_sum(worth[ee + 1:lst]), 0) AS mds, coalesce(list_sum(worth[lst + 1:n]), 0) AS lsc, CASE WHEN n >= 2 AND list_avg(vol) > 0 AND vol[n] / list_avg(vol) < 0.3 THEN 0.1 WHEN n >= 2 AND list_avg(vol) > 0 AND vol[n] / list_avg(vol) < 0.5 THEN 0.3 ELSE 1.0 END AS thin, list_sum(b) AS tbv, list_sum(s) AS tsv FROM wv1",
    "wv3": """SELECT *, tr + lsc * thin * 0.3 AS comb, CASE WHEN tsv > tbv * 2 THEN 'SHORT AVOID' WHEN tbv > tsv * 2 THEN 'LONG TAKE' WHEN sv > bv * 2 AND sv > 5000 THEN 'SHORT AVOID' WHEN bv > sv * 2 AND bv > 5000 THEN 'LONG TAKE' WHEN tsn > tb * 2 AND tsn >= 3 THEN 'SHORT AVOID' WHEN tb > tsn * 2 AND tb >= 3 THEN 'LONG TAKE' END AS gate FROM wv2""",
    "wv4": """SELECT *, CASE WHEN comb >= 2 THEN 'LONG' WHEN comb <= -2 THEN 'SHORT' ELSE 'NEUTRAL' END AS dir, CASE WHEN comb >= 2 THEN CAST(NOT tbv > tsv AS INT) + CAST(NOT tb > tsn AS INT) ELSE CAST(tbv > tsv AS INT) + CAST(tb > tsn AS INT) END AS ag, CASE WHEN comb >= 2 THEN tr ELSE -tr END AS st FROM wv3""",
    "cke": f"""SELECT {_L}, count(*) AS touches, count(*) FILTER (ib) AS nb, count(*) FILTER (isell) AS ns, bool_or(bk <= 2 AND isell AND b30 < 0) AS lc, bool_or(bk <= 2 AND isell AND b30 >= 0) AS la, bool_or(tn = 1 AND coalesce(ratio, 0) < 0.3 AND d30 < -50000) AS fd, bool_or(tn <= 2 AND ib) AS eb, coalesce(bool_or(ratio >= 0.55 AND n30 >= 5), false) AS hr,
  coalesce(bool_or(ratio >= 0.55 AND n30 >= 5 AND a30 > 0), false) AS kc, coalesce(bool_or(comp >= 1), false) AS ch, sum(CASE WHEN tn <= 3 THEN n30 ELSE 0 END) AS ec, sum(CASE WHEN bk <= 3 THEN n30 ELSE 0 END) AS lcnt, count(*) FILTER (isell AND b30 > 0) AS ab, count(*) FILTER (bk <= 3 AND (ib OR coalesce(ratio, 0) > 0.6)) AS stg, bool_or(b30 > 0.02) AS bo, bool_and(a30 < 0) AS an, NOT bool_or(b30 > 0.005) AS nob
  FROM (SELECT *, row_number() OVER (PARTITION BY {_L} ORDER BY tn DESC) AS bk FROM tpx) GROUP BY ALL""",
    "ckb": f"SELECT *, bd * 1000 AS hbd, bb * 1000 AS hb, bs * 1000 AS hs, coalesce(bs * 100 / nullif(bb + bs, 0), 0) AS sp FROM cke JOIN bands USING ({_L})",
    "ckg": "SELECT *, hb >= hs * 1.5 AND hb + hs >= 5000 AND hb > 0 AS ga FROM ckb",
    "ckl": """SELECT *, coalesce(array_to_string([CASE WHEN lc THEN 'LATE_INST_SELL_CONFIRMED' END, CASE WHEN nb = 0 AND NOT ga THEN 'NO_BUYERS' END, CASE WHEN sp > 70 THEN 'SELLER_DOMINATED' END, CASE WHEN fd THEN 'FIRST_TOUCH_DUMP' END, CASE WHEN ns > nb THEN 'SELLERS_OUTNUMBER' END, CASE WHEN hs > hb THEN 'SHARES_OUTNUMBER' END], ','), '') AS gates,
  list_filter([CASE WHEN eb THEN 'INST_BUY_EARLY' END, CASE WHEN nb > 0 AND ns = 0 THEN 'INST_HOLD' END, CASE WHEN hr THEN 'HIGH_BUY_RATIO' END, CASE WHEN kc THEN 'KILLER_COMBO' END, CASE WHEN ch THEN 'COMPRESSION_HIGH' END, CASE WHEN touches >= 4 AND lcnt < ec * 0.5 AND ns = 0 THEN 'SELLER_EXHAUSTION' END, CASE WHEN ab > 0 AND (hb > hs OR nb > ns) THEN 'ABSORPTION' END, CASE WHEN la THEN 'SHAKEOUT_ABSORBED' END,
    CASE WHEN hbd > 0 THEN 'BAND_DELTA_POSITIVE' END, CASE WHEN sp < 40 THEN 'SELL_PCT_LOW' END, CASE WHEN touches >= 3 AND stg >= 2 THEN 'ENDING_STRONG' END, CASE WHEN bo THEN 'BREAKOUT_IDENTIFIED' END, CASE WHEN ga THEN 'VOLUME_ACCUMULATION' END], lambda x: x IS NOT NULL) AS gl,
  coalesce(array_to_string([CASE WHEN an THEN 'AGGR_NEGATIVE_ALL' END, CASE WHEN nob THEN 'NO_BOUNCE' END, CASE WHEN touches > 40 THEN 'EXHAUSTED_LEVEL' END, CASE WHEN sp BETWEEN 45 AND 55 THEN 'SELL_PCT_CONTESTED' END], ','), '') AS cautions FROM ckg""",
    "nodes": f"""SELECT symbol, session_id, 'c1' AS chain_id, row_number() OVER (PARTITION BY {_K} ORDER BY ws, coalesce(price, 0.0), ind) AS position, ws, we, price, kind, ind FROM (SELECT symbol, session_id, start_ts_ms + (end_ts_ms - start_ts_ms) // 3 * k AS ws, start_ts_ms + (end_ts_ms - start_ts_ms) // 3 * (k + 1) - 600000 AS we, price, kind, ind
  FROM extent, (VALUES (0, CAST(100.20 AS DOUBLE), 'support', NULL), (1, CAST(101.00 AS DOUBLE), 'resistance', NULL), (2, CAST(100.60 AS DOUBLE), 'support', NULL), (2, NULL, NULL, 'ema9'), (2, NULL, NULL, 'vwap')) x(k, price, kind, ind))""",
    "nticks": f"""SELECT *, CASE WHEN last_price < lp * (1 - 0.0015) THEN -1 WHEN last_price > lp * (1 + 0.0015) THEN 1 ELSE 0 END AS pos, CASE WHEN last_price > lp THEN 1 WHEN last_price < lp THEN -1 ELSE 0 END AS side FROM (SELECT s.*, n.chain_id, n.position, n.ws, n.we, n.kind, n.ind, ts_ms BETWEEN ws AND we AS watched,
    CASE n.ind WHEN 'ema9' THEN ema9 WHEN 'vwap' THEN vwap_session ELSE n.price END AS lp FROM strm s JOIN nodes n USING ({_K}) WHERE last_price IS NOT NULL) WHERE lp > 0""",
    "nw": "SELECT * FROM nticks WHERE watched",
    "nlag": f"SELECT *, coalesce(lag(pos) OVER w, 9) AS bp, lag(side) OVER w AS bsd, CASE kind WHEN 'support' THEN -1 WHEN 'resistance' THEN 1 END AS bad, max(abs(pos)) OVER h = 0 AND count(*) OVER h = 3 AS hold FROM nw WINDOW w AS ({_NW}), h AS ({_NW} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)",
    "nsum": f"""SELECT {_N}, ind, count(*) AS points, sum(trade_count) AS trades, sum(total_volume) AS volume, sum(delta) AS delta, count(*) FILTER (pos = 0) * 10.0 AS tib, coalesce(sum(total_volume) FILTER (pos = 0), 0.0) AS bv, coalesce(sum(delta) FILTER (pos = 0), 0.0) AS bd, count(*) FILTER (pos = 0 AND bp <> 0) AS tc, count(*) FILTER (side <> 0 AND bsd <> 0 AND side <> bsd) AS cc,
  count(*) FILTER (pos = 0 AND bp = bad) AS ra, count(*) FILTER (pos = 0 AND bp = bad AND hold) AS rh, last(last_price ORDER BY ts_ms) - first(last_price ORDER BY ts_ms) AS ret, avg(relative_aggression) AS agg, avg(ci) AS comp, avg(relative_aggression) FILTER (pos = 0) AS bagg, avg(lp) AS lp FROM nlag GROUP BY ALL""",
    "nflag": """SELECT *, CASE WHEN ra > 0 THEN rh / ra END AS hr, coalesce(bagg, agg) AS ag FROM nsum""",
    "tagw": "SELECT m.marker_id, m.symbol, m.session_id, m.ts_ms AS ws, m.ts_ms + 600000 AS we, tag, price, kind FROM mk m, (VALUES (1, CAST(100.20 AS DOUBLE), 'support'), (2, CAST(101.00 AS DOUBLE), 'resistance')) x(tag, price, kind)",
    "tagt": f"SELECT w.marker_id, w.tag, w.ws, w.we, s.ts_ms, s.total_volume, s.delta, s.relative_aggression, s.last_price, CASE WHEN last_price < price * (1 - 0.0015) THEN -1 WHEN last_price > price * (1 + 0.0015) THEN 1 ELSE 0 END AS pos, CASE kind WHEN 'support' THEN -1 ELSE 1 END AS bad FROM tagw w JOIN stream s ON s.symbol = w.symbol AND s.session_id = w.session_id AND s.ts_ms BETWEEN ws AND we WHERE last_price IS NOT NULL",
    "tagl": "SELECT *, coalesce(lag(pos) OVER w, 9) AS bp, max(abs(pos)) OVER h = 0 AND count(*) OVER h = 3 AS hold FROM tagt WINDOW w AS (PARTITION BY marker_id, tag ORDER BY ts_ms), h AS (PARTITION BY marker_id, tag ORDER BY ts_ms ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)",
    "tags": "SELECT marker_id, tag, count(*) AS points, sum(delta) AS delta, count(*) FILTER (pos = 0) * 10.0 AS tib, coalesce(sum(delta) FILTER (pos = 0), 0.0) AS bd, count(*) FILTER (pos = 0 AND bp <> 0) AS tc, count(*) FILTER (pos = 0 AND bp = bad) AS ra, count(*) FILTER (pos = 0 AND bp = bad AND hold) AS rh, avg(relative_aggression) AS agg, avg(relative_aggression) FILTER (pos = 0) AS bagg, last(last_price ORDER BY ts_ms) - first(last_price ORDER BY ts_ms) AS ret FROM tagl GROUP BY ALL",
    "cdw": f"SELECT {_N}, c.w AS cw, avg(ci) AS comp, coalesce(sum(delta) FILTER (pos = 0), 0.0) AS bd, avg(relative_aggression) AS ra FROM nw, (VALUES (0, 240, 180), (1, 180, 120), (2, 120, 60), (3, 60, 30), (4, 30, 0)) c(w, a, b) WHERE ts_ms BETWEEN greatest(ws, we - a * 1000) AND we - b * 1000 GROUP BY ALL",
    "cdr": f"SELECT *, row_number() OVER (PARTITION BY {_N} ORDER BY cw DESC) AS bk FROM cdw",
    "ckw": f"SELECT {_N}, first(comp ORDER BY cw) AS early, last(comp ORDER BY cw) AS late, max(bd) FILTER (bk = 1) AS bd30, max(ra) FILTER (bk = 1) AS ra30, max(bd) FILTER (bk = 2) AS bd60, max(ra) FILTER (bk = 2) AS ra60 FROM cdr GROUP BY ALL",
    "mvs": f"SELECT n.*, lag(we) OVER (PARTITION BY {_K}, chain_id ORDER BY position) AS f FROM nodes n",
    "mvt": f"SELECT {_N}, f, ws, count(*) AS points, sum(delta) AS delta, sum(total_volume) AS volume, last(last_price ORDER BY ts_ms) - first(last_price ORDER BY ts_ms) AS ret, first(last_price ORDER BY ts_ms) AS p0, avg(atr) AS atr FROM mvs JOIN strm s USING ({_K}) WHERE f < ws AND s.ts_ms BETWEEN f AND ws AND last_price IS NOT NULL GROUP BY ALL",
    "mvv": """SELECT *, CASE WHEN v >= 1.5 THEN 'crash' WHEN v >= 0.75 THEN 'fast' WHEN v >= 0.25 THEN 'normal' ELSE 'grind' END AS vb, CASE WHEN ret > 0 THEN 'up' WHEN ret < 0 THEN 'down' ELSE 'flat' END AS dir, CASE WHEN delta > 0 THEN 'buy' WHEN delta < 0 THEN 'sell' ELSE 'flat' END AS fs, CASE WHEN im >= 0.35 THEN 'strong' WHEN im >= 0.15 THEN 'moderate' ELSE 'balanced' END AS fst
  FROM (SELECT *, abs(ret) / atr / ((ws - f) / 60000.0) AS v, abs(delta) / (volume + 1e-9) AS im FROM mvt)""",
}
_FS = "CASE WHEN bd > 0 THEN 1 WHEN bd < 0 THEN -1 ELSE 0 END + CASE WHEN ag > 0.1 THEN 1 WHEN ag < -0.1 THEN -1 ELSE 0 END + CASE WHEN hr >= 0.7 THEN 1 WHEN hr <= 0.3 THEN -1 ELSE 0 END"
_FL = "coalesce(array_to_string([CASE WHEN bd > 0 THEN 'green: band_delta_positive' END, CASE WHEN bd < 0 THEN 'red: band_delta_negative' END, CASE WHEN ag > 0.1 THEN 'green: aggression_positive' END, CASE WHEN ag < -0.1 THEN 'red: aggression_negative' END, CASE WHEN hr >= 0.7 THEN 'green: reclaim_hold_rate_high' END, CASE WHEN hr <= 0.3 THEN 'red: reclaim_hold_rate_low' END, CASE WHEN tc >= 3 THEN 'info: multiple_touches' END], ','), '')"
_NS = f"SELECT {_N}, points, CAST(trades AS BIGINT) AS trades, volume, delta, tib AS time_in_band_s, bv AS band_volume, bd AS band_delta, tc AS touch_count, cc AS cross_count, ra AS reclaim_attempts, rh AS reclaim_holds_30s, CAST({_FS} AS BIGINT) AS flag_score, {_FL} AS flags, {r('return_abs=ret', 'relative_aggression_mean=agg', 'compression_mean=comp', 'band_relative_aggression_mean=bagg', 'reclaim_hold_rate=hr', 'level_price=lp')} FROM nflag WHERE ind"
FINALS = {
    "reclaim_packets": f"SELECT {_L}, did AS deeper_id, tag AS tag_ts_ms, ts_ms AS reclaim_ts_ms, took AS time_to_reclaim_ms, took <= 120000 AS snapback, d30 AS band_delta_30s, d60 AS band_delta_60s, h30 AS hold_30s, h60 AS hold_60s, datr >= 1 AND datr / greatest(1e-9, took / 60000.0) >= 0.75 AS flush, {r('rel_aggr_30s=a30', 'drop_pct=dp / p - 1', 'drop_atr=datr')} FROM reclaims",
    "main_support": f"SELECT {_L}, level_price, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY {_K} ORDER BY score DESC, created, level_id) = 1 AS main, snapped AND row_number() OVER (PARTITION BY {_K}, snapped ORDER BY level_price DESC) = 1 AS focus FROM mscore",
    "positive_ledger": f"SELECT * FROM (SELECT {_K}, scenario, kind, name, n, CASE WHEN kind = 'combo' THEN row_number() OVER (PARTITION BY {_K}, scenario, kind ORDER BY n DESC, name) END AS rank FROM (SELECT {_K}, scenario, kind, name, count(*) AS n FROM postall GROUP BY ALL)) WHERE rank IS NULL OR rank <= 10",
    "pattern_index": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, kind ORDER BY n DESC, name) AS rank FROM (SELECT scenario, kind, name, count(*) AS n, count(DISTINCT session_id) AS sessions, count(DISTINCT symbol) AS tickers FROM postall GROUP BY ALL)) WHERE kind <> 'combo' OR rank <= 20",
    "pattern_compare": "SELECT scenario, session_id, touches, shared, flag, round(rate, 6) AS rate FROM (SELECT scenario, session_id, count(*) AS touches, unnest([" + ", ".join(f"'{f}'" for f in _FLAGS) + "]) AS flag, unnest([" + ", ".join(f"avg(CAST(list_contains(flags, '{f}') AS INT))" for f in _FLAGS) + "]) AS rate FROM pos GROUP BY scenario, session_id) JOIN (SELECT scenario, shared FROM (SELECT scenario, count(DISTINCT session_id) = (SELECT count(DISTINCT session_id) FROM pos) AS shared FROM pos GROUP BY scenario) x WHERE shared OR NOT (SELECT bool_or(c) FROM (SELECT count(DISTINCT session_id) = (SELECT count(DISTINCT session_id) FROM pos) AS c FROM pos GROUP BY scenario))) USING (scenario)",
    "level_verdict": f"""SELECT {_L}, touches, {r('avg_score', 'last5_avg_score=last5')}, CAST(peak AS BIGINT) AS peak_score, peakn AS peak_touch_number, CAST(trough AS BIGINT) AS trough_score, troughn AS trough_touch_number, CAST(final AS BIGINT) AS cum_final_score, ls AS late_inst_sell, lbuy AS late_inst_buy, lbr AS late_break, es AS ending_strong, ew AS ending_weak,
  CASE WHEN (v0 IN ('STRONG_BUY', 'BUY') AND (lbr OR (ew AND last5 <= -2))) OR (v0 IN ('STRONG_SELL', 'SELL') AND es AND last5 >= 2) THEN CASE v0 WHEN 'STRONG_BUY' THEN 'BUY' WHEN 'STRONG_SELL' THEN 'SELL' ELSE 'NEUTRAL' END ELSE v0 END AS verdict, bv / nullif(bn, 0) < 50 AS thin_liquidity, top_plus
  FROM lverb LEFT JOIN bands USING ({_L}) LEFT JOIN (SELECT {_L}, first(x || ' x' || c ORDER BY c DESC, x) AS top_plus FROM (SELECT {_L}, x, count(*) AS c FROM (SELECT {_L}, unnest(list_filter(rs, lambda y: y IS NOT NULL)[1:6]) AS x FROM plusr) GROUP BY ALL) GROUP BY {_L}) USING ({_L})""",
    "touch_cum_score": f"SELECT {_L}, ts_ms, CAST(c AS BIGINT) AS cum_score, CAST(b AS BIGINT) AS cum_bucket, CASE WHEN b <= 1 THEN 'STRONG_SELL' WHEN b <= 3 THEN 'SELL' WHEN b <= 4 THEN 'CAUTION' WHEN b <= 6 THEN 'NEUTRAL' WHEN b <= 8 THEN 'BUY' ELSE 'STRONG_BUY' END AS cum_label, CAST(lo AS BIGINT) AS cum_min, CAST(hi AS BIGINT) AS cum_max, round(abs(c) / greatest(abs(lo), abs(hi), 1) * 100.0, 6) AS cum_height_pct FROM (SELECT *, greatest(1, least(10, CAST(round_even((c + 20) / 40.0 * 9 + 1, 0) AS INT))) AS b, min(c) OVER (PARTITION BY {_L}) AS lo, max(c) OVER (PARTITION BY {_L}) AS hi FROM (SELECT *, sum(score) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS c FROM pts))",
    "touch_large": f"SELECT {_L}, ts_ms, big_n AS large_count_at_touch, big_delta AS large_delta_at_touch, CAST(n30 AS BIGINT) AS large_count_30s, lb30 AS large_buy_30s, ls30 AS large_sell_30s, ld30 AS large_delta_30s, coalesce(n30 >= 5 AND rt > 0.6, false) AS institutional_buy, coalesce(n30 >= 5 AND rt < 0.4, false) AS institutional_sell, lb30 > 0 AND ls30 > 0 AND lb30 / nullif(ls30, 0) > 1.5 AS large_size_imbalance, {r('large_buy_ratio_30s=rt', 'large_rate_30s=n30 / 0.5', 'large_vs_baseline_ratio=CASE WHEN ln > 0 AND n30 > 0 THEN n30 / 0.5 / ln END', 'large_buy_vs_sell_ratio=CASE WHEN lb30 > 0 AND ls30 > 0 THEN lb30 / ls30 END')} FROM (SELECT *, CASE WHEN lb30 + ls30 > 0 THEN lb30 / (lb30 + ls30) END AS rt FROM tp)",
    "touch_context": f"SELECT {_L}, ts_ms, ts_ms - ts_ms % 60000 AS minute_start_ms, CASE WHEN chg > 0.05 THEN 'tightening' WHEN chg < -0.05 THEN 'loosening' WHEN chg IS NOT NULL THEN 'flat' END AS compression_trend_into_touch, cvd AS cvd_60s_at_touch, cvd - cvd0 AS cvd_slope_into_touch, ad < 0 AND d30 > 0 AS div_flag_at_touch, CASE WHEN last_price > vwap_session * 1.001 THEN 'above' WHEN last_price < vwap_session * 0.999 THEN 'below' WHEN vwap_session IS NOT NULL THEN 'at' END AS price_vs_vwap_at_touch, CASE WHEN ema9 IS NULL THEN NULL WHEN ema9 > ema20 AND ema20 > ema30 THEN 'bull' WHEN ema9 < ema20 AND ema20 < ema30 THEN 'bear' ELSE 'mixed' END AS ema_stack_at_touch, spost < spread_pct * 0.9 AS spread_narrowing_after_touch, {r('compression_at_touch=comp', 'price_efficiency_0_30s=CASE WHEN v30 > 0 THEN abs(b30 * last_price) / (v30 + 1e-9) END', 'spread_pct_at_touch=spread_pct')} FROM tpc JOIN (SELECT {_L}, ts_ms, coalesce(lag(cvd, 6) OVER ({_W}), first_value(cvd) OVER ({_W})) AS cvd0 FROM pk) USING ({_L}, ts_ms)",
    "band_rates": f"SELECT {_L}, {r('volume_per_min=bv / nullif(tib / 60, 0)', 'trades_per_min=bn / nullif(tib / 60, 0)', 'shares_per_trade=bv / nullif(bn, 0)', 'large_sell_pct=bs * 100 / nullif(bb + bs, 0)')} FROM bands",
    "infer_interval": f"SELECT {_K}, CASE WHEN n >= 3 AND m > 0 THEN m ELSE 10 END AS interval_s FROM (SELECT {_K}, count(*) AS n, CAST(round_even(quantile_cont(d, 0.5) / 1000, 0) AS BIGINT) AS m FROM (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY {_K} ORDER BY ts_ms) AS d FROM grid) GROUP BY ALL)",
    "inst_balance": f"SELECT {_L}, touches, nb AS inst_buys, ns AS inst_sells, bv AS inst_buy_volume, sv AS inst_sell_volume, absorbed, confirmed, round(coalesce(absorbed / nullif(ns, 0), 0.0), 6) AS absorption_rate FROM bal",
    "pattern_verdict": f"SELECT {_L}, touches, CAST(score AS BIGINT) AS score, hs AS hard_stop, CASE WHEN hs IS NOT NULL OR score < -3 THEN 'SHORT' WHEN score >= 1 THEN 'LONG' ELSE 'NEUTRAL' END AS direction, CASE WHEN hs IS NOT NULL OR score < -7 THEN 'AVOID' WHEN score >= 8 THEN 'TAKE' WHEN score >= 4 OR score < -3 THEN 'LEAN' ELSE 'WAIT' END AS confidence, prog AS progression FROM pscored",
    "resistance_trend": f"SELECT {_L}, n AS phases, CAST(score AS BIGINT) AS score, CASE WHEN n < 2 THEN CASE WHEN score > 0 THEN 'SINGLE_PHASE_BULLISH' WHEN score < 0 THEN 'SINGLE_PHASE_BEARISH' ELSE 'INSUFFICIENT_DATA' END WHEN clean THEN 'CLEAN_BREAKOUT' WHEN score >= 4 THEN 'STRONG_BULLISH' WHEN score >= 2 THEN 'BULLISH' WHEN score >= 0 THEN 'NEUTRAL' WHEN score >= -2 THEN 'BEARISH' ELSE 'STRONG_BEARISH' END AS trend, CASE WHEN n < 2 THEN CASE WHEN score > 0 THEN 'BREAKOUT POSSIBLE (low data)' WHEN score < 0 THEN 'RESISTANCE HOLDING (low data)' ELSE 'WAIT - insufficient data' END WHEN clean THEN 'BREAKOUT - TAKE' WHEN score >= 4 THEN 'BREAKOUT LIKELY' WHEN score >= 2 THEN 'BREAKOUT POSSIBLE' WHEN score >= 0 THEN 'CONTESTED' WHEN score >= -2 THEN 'RESISTANCE HOLDING' ELSE 'STRONG RESISTANCE' END AS verdict, coalesce(list_sum(d[1:h]), 0.0) AS early_delta, coalesce(list_sum(d[h + 1:n]), 0.0) AS late_delta FROM rts",
    "weighted_verdict": f"SELECT {_L}, n AS phases, CAST(tr AS BIGINT) AS trend_score, {r('early_score=es', 'mid_score=mds', 'late_score=lsc', 'combined=comb')}, gate IS NOT NULL AS gated, coalesce(split_part(gate, ' ', 1), dir) AS direction, coalesce(split_part(gate, ' ', 2), CASE WHEN dir = 'NEUTRAL' THEN 'WAIT' WHEN st >= 5 AND ag = 0 THEN CASE dir WHEN 'LONG' THEN 'TAKE' ELSE 'AVOID' END WHEN st >= 3 AND ag <= 1 THEN 'WAIT' WHEN st >= 2 AND ag = 0 THEN 'WAIT' ELSE 'LEAN' END) AS confidence FROM wv4",
    "checklist_eval": f"SELECT {_L}, touches, round(sp, 6) AS sell_pct, nb = 0 AND ga AS softened, gates, coalesce(array_to_string(gl, ','), '') AS greens, cautions, CASE WHEN gates <> '' THEN CASE WHEN touches < 10 THEN 'LEAN AVOID' ELSE 'AVOID' END WHEN nb = 0 AND ga THEN 'WAIT - ACCUMULATION' WHEN touches < 10 AND len(gl) >= 4 THEN 'LEAN TAKE' WHEN len(gl) >= 6 THEN 'STRONG TAKE' WHEN len(gl) >= 4 THEN 'TAKE' WHEN len(gl) >= 2 THEN 'WAIT' WHEN touches < 10 THEN 'LEAN PASS' ELSE 'PASS' END AS verdict FROM ckl",
    "chain_nodes": f"SELECT {_N}, ws AS watch_start_ts_ms, we AS watch_end_ts_ms, price AS level_price, kind AS level_type, CAST(0.0015 AS DOUBLE) AS band_pct, ind AS indicator FROM nodes",
    "window_summary": f"{_NS} IS NULL",
    "indicator_levels": f"{_NS} IS NOT NULL",
    "watch_windows": f"SELECT marker_id, CAST(tag AS BIGINT) AS tag, points, delta, tib AS time_in_band_s, bd AS band_delta, tc AS touch_count, CAST({_FS} AS BIGINT) AS flag_score, {r('return_abs=ret')} FROM (SELECT *, CASE WHEN ra > 0 THEN rh / ra END AS hr, coalesce(bagg, agg) AS ag FROM tags)",
    "checklist": f"SELECT {_N}, round(comp, 6) AS compression_mean, CASE WHEN comp >= 0.75 THEN 'high' WHEN comp <= 0.35 THEN 'low' WHEN comp IS NOT NULL THEN 'mid' END AS compression_level, round(late - early, 6) AS compression_change, CASE WHEN late - early > 0.05 THEN 'tightening' WHEN late - early < -0.05 THEN 'loosening' WHEN late - early IS NOT NULL THEN 'flat' END AS compression_trend, bd30 AS band_delta_last30s, round(ra30, 6) AS rel_aggr_last30s, bd60 AS band_delta_last60s, round(ra60, 6) AS rel_aggr_last60s, CASE WHEN bd30 IS NULL OR ra30 IS NULL THEN NULL WHEN bd30 > 0 AND ra30 > 0.1 THEN 'bullish' WHEN bd30 < 0 AND ra30 < -0.1 THEN 'bearish' ELSE 'mixed' END AS reaction FROM nsum LEFT JOIN ckw USING ({_N})",
    "event_markers": "SELECT marker_id, win AS window, count(*) AS points, sum(total_volume) AS volume, sum(delta) AS delta, count(*) FILTER (inb) * 10.0 AS time_in_band_s, coalesce(sum(delta) FILTER (inb), 0.0) AS band_delta, round(last(last_price ORDER BY t) - first(last_price ORDER BY t), 6) AS return_abs FROM (SELECT m.marker_id, win, s.ts_ms AS t, s.total_volume, s.delta, s.last_price, s.last_price BETWEEN CAST(100.2 AS DOUBLE) * (1 - 0.0015) AND CAST(100.2 AS DOUBLE) * (1 + 0.0015) AS inb FROM mk m, (VALUES ('pre_60s', -60000, 0), ('during_30s', 0, 30000), ('post_90s', 30000, 120000)) x(win, a, b), stream s WHERE s.symbol = m.symbol AND s.session_id = m.session_id AND last_price IS NOT NULL AND s.ts_ms BETWEEN m.ts_ms + a AND m.ts_ms + b) GROUP BY ALL",
    "chain_moves": f"SELECT {_N}, f AS start_ts_ms, ws AS end_ts_ms, points, delta, vb AS velocity_bucket, dir AS direction, fs AS flow_side, fst AS flow_strength, round(im, 6) AS flow_imbalance, vb || ' / ' || dir || ' / ' || fs || '_' || fst AS verdict FROM mvv",
    "x_touch": f"SELECT {_L}, ts_ms, tn AS touch_number, CASE WHEN NOT conf THEN 'hold' WHEN again AND nheld THEN 'break_reclaim_hold' WHEN again THEN 'break_reclaim_fail' ELSE 'break' END AS touch_outcome, from_side, coalesce(n30 >= 5 AND lb30 / nullif(lb30 + ls30, 0) > 0.6, false) AS institutional_buy FROM tp",
    "x_reclaim": f"SELECT {_L}, 'reclaim:' || p || ':' || dp || ':' || ts_ms AS reclaim_id, h60 AS hold_60s FROM reclaims",
    "x_level_chains": f"SELECT {_N}, s.points, session_points, verdict AS move_verdict, tc AS touch_count, session_touch_count, CASE WHEN comp >= 0.75 THEN 'high' WHEN comp <= 0.35 THEN 'low' WHEN comp IS NOT NULL THEN 'mid' END AS compression_level FROM nodes LEFT JOIN nsum s USING ({_N}) LEFT JOIN (SELECT {_N}, vb || ' / ' || dir || ' / ' || fs || '_' || fst AS verdict FROM mvv) USING ({_N}) LEFT JOIN (SELECT {_N}, count(*) AS session_points, count(*) FILTER (pos = 0 AND bp <> 0) AS session_touch_count FROM (SELECT *, coalesce(lag(pos) OVER ({_NW}), 9) AS bp FROM nticks) GROUP BY ALL) USING ({_N})",
    "x_watch_windows": "SELECT marker_id, CAST(tag AS BIGINT) AS tag, CAST(c.w AS BIGINT) AS window, count(*) AS points, sum(total_volume) AS volume, coalesce(sum(delta) FILTER (pos = 0), 0.0) AS band_delta FROM tagt, (VALUES (0, 240, 180), (1, 180, 120), (2, 120, 60), (3, 60, 30), (4, 30, 0)) c(w, a, b) WHERE ts_ms BETWEEN greatest(ws, we - a * 1000) AND we - b * 1000 GROUP BY ALL",
    "marker_commands": f"SELECT {_K}, ws AS ts_ms, 'add_level' AS type, NULL AS marker_id, 'marker_level:' || symbol || ':' || ws || ':' || price || ':' || kind AS level_id, price AS level_price, kind AS level_type, NULL AS direction_bias FROM tagw UNION ALL SELECT {_K}, ts_ms, 'add_marker', 'marker:' || symbol || ':' || ts_ms || ':' || marker_type, NULL, NULL, NULL, CASE marker_type WHEN 'consolidation' THEN 'long' END FROM mk",
    "commands_load": "SELECT symbol AS ticker, 'add_level' AS type, kind AS level_type, count(*) AS n, CAST(0.25 AS DOUBLE) AS width, max(ws) AS last_ts FROM tagw GROUP BY ALL UNION ALL SELECT symbol, 'add_marker', NULL, count(*), NULL, max(ts_ms) FROM mk GROUP BY ALL",
    "levels_load": "SELECT symbol AS ticker, session_id || '-' || level_id AS level_id, CAST(level_price AS DOUBLE) AS level_price, level_type, CAST(0.25 AS DOUBLE) AS level_width_atr, created AS created_ts_ms FROM levels",
    "report_document": f"""SELECT {_K}, coalesce(l.n, 0) AS levels, coalesce(t.n, 0) AS touches, coalesce(c.n, 0) AS reclaims, coalesce(m.n, 0) AS moves, coalesce(t.h, 0) AS held, coalesce(e.w, 0) AS wins, coalesce(m.d, 0.0) AS moved_delta
  FROM (SELECT {_K}, count(DISTINCT level_id) AS n FROM tlr WHERE event IS NOT NULL GROUP BY ALL) l LEFT JOIN (SELECT {_K}, count(*) AS n, count(*) FILTER (NOT conf) AS h FROM tp GROUP BY ALL) t USING ({_K})
  LEFT JOIN (SELECT {_K}, count(*) AS n FROM reclaims GROUP BY ALL) c USING ({_K}) LEFT JOIN (SELECT {_K}, count(*) AS n, sum(delta) AS d FROM mvv GROUP BY ALL) m USING ({_K}) LEFT JOIN (SELECT {_K}, count(*) FILTER (why = 'threshold_hit') AS w FROM eps GROUP BY ALL) e USING ({_K})""",
    "report_doc": "SELECT symbol AS ticker, session_id AS session, count(*) AS episodes, count(*) FILTER (why = 'threshold_hit') AS wins, count(*) FILTER (why = 'invalidation') AS losses, round(quantile_cont(mfe, 0.5), 6) AS mfe_p50 FROM eps WHERE symbol = 'S0' GROUP BY ALL",
    "report_backfill": "SELECT DISTINCT symbol AS ticker, session_id AS session FROM eps WHERE symbol <> 'S0'",
    "sink_tape": "SELECT strftime(make_timestamp(ts_ms * 1000) - INTERVAL 5 HOUR, '%Y-%m-%d') AS date, symbol, count(*) AS n, sum(size) AS size FROM trades GROUP BY ALL",
    "sink_alias": "SELECT session_id AS session, count(*) AS n, round(sum(CASE WHEN total_volume > 0 THEN buy_volume / total_volume ELSE 0 END), 4) AS at_ask, round(sum(CASE WHEN total_volume > 0 THEN sell_volume / total_volume ELSE 0 END), 4) AS at_bid FROM flow GROUP BY ALL",
    "read_session": "SELECT level_id, ts_ms, phase FROM et WHERE (symbol, session_id, level_id, entry) = (SELECT (symbol, session_id, level_id, entry) FROM eps WHERE symbol = 'S1' ORDER BY entry, level_id LIMIT 1)",
    "drift_read": "SELECT symbol, CAST(sum(trade_count) AS BIGINT) AS trades, CASE symbol WHEN 'S0' THEN sum(total_volume) END AS volume, CAST(0 AS BIGINT) AS extras FROM flow GROUP BY symbol",
    "dq_outliers": "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY delta DESC, ts_ms, level_id, entry) AS rank, ts_ms, level_id, entry AS zone_entry_time, delta FROM et WHERE delta IS NOT NULL QUALIFY rank <= 10",
    "dq_time": f"SELECT pair, count(*) AS n, {r('min=min(d)', 'p50=quantile_cont(d, 0.5)', 'p90=quantile_cont(d, 0.9)', 'max=max(d)')} FROM (SELECT unnest(['start_time to zone_entry_time', 'zone_entry_time to zone_exit_time', 'zone_entry_time to resolution_time']) AS pair, unnest([CAST(300000 AS DOUBLE), CAST(exit_ts - entry AS DOUBLE), CAST(res - entry AS DOUBLE)]) AS d FROM eps) WHERE d IS NOT NULL GROUP BY pair",
    "dq_coverage": f"SELECT {_K}, min(ts_ms) AS first, max(ts_ms) AS last, true AS inside FROM et GROUP BY ALL",
    "feature_corr": f"""SELECT feature, win AS window, stat, wins, losses, {', '.join(f'round({x}, 4) AS {x}' for x in ('win_mean', 'loss_mean', 'corr'))} FROM (SELECT feature, win, stat, count(x) FILTER (y = 1) AS wins, count(x) FILTER (y = 0) AS losses, avg(x) FILTER (y = 1) AS win_mean, avg(x) FILTER (y = 0) AS loss_mean, corr(coalesce(x, med), y) AS corr FROM (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY feature, win, stat) AS med FROM (
    SELECT g.*, v.x FROM (SELECT {_L}, entry, CASE why WHEN 'threshold_hit' THEN 1.0 ELSE 0.0 END AS y, feature, win, stat FROM eps, (SELECT unnest(['delta', 'relative_aggression', 'signed_distance_atr', 'compression_index']) AS feature), (SELECT unnest(['baseline', 'stress', 'early_stress_60s']) AS win), (SELECT unnest(['mean', 'std']) AS stat) WHERE why <> 'timeout') g LEFT JOIN cor v USING ({_L}, entry, feature, win, stat))) GROUP BY ALL) WHERE wins >= 2 AND losses >= 2 ORDER BY abs(win_mean - loss_mean) DESC, corr DESC LIMIT 15""",
    "episode_tick": f"SELECT {_L}, entry AS zone_entry_time, ts_ms, row_number() OVER ({_E}) - 1 AS sequence_id, phase, last_value(own IGNORE NULLS) OVER ({_E}) AS last_price FROM (SELECT et.*, CASE WHEN p.at >= et.st THEN p.price END AS own FROM (SELECT e.symbol, e.session_id, e.level_id, e.entry, e.entry - 300000 AS st, g.ts_ms, CASE WHEN g.ts_ms < e.entry THEN 'baseline' WHEN e.exit_ts IS NULL OR g.ts_ms <= e.exit_ts THEN 'stress' ELSE 'resolution' END AS phase FROM eps e JOIN grid g ON g.symbol = e.symbol AND g.session_id = e.session_id AND g.ts_ms BETWEEN e.entry - 300000 AND e.res) et LEFT JOIN (SELECT {_K}, ts_ms - ts_ms % 10000 + 9999 AS tick, last(price ORDER BY ts_ms, seq) AS price, last(ts_ms ORDER BY ts_ms, seq) AS at FROM trades GROUP BY ALL) p ON p.symbol = et.symbol AND p.session_id = et.session_id AND p.tick = et.ts_ms)",
}
CTES |= {
    "cor": f"""SELECT {_L}, entry, feature, win, stat, CASE stat WHEN 'mean' THEN m ELSE s END AS x FROM (SELECT {_L}, entry, feature, win, avg(x) AS m, coalesce(stddev_pop(x), 0.0) AS s FROM (SELECT *, unnest(CASE WHEN phase = 'baseline' THEN ['baseline'] WHEN phase = 'stress' AND n <= 6 THEN ['stress', 'early_stress_60s'] WHEN phase = 'stress' THEN ['stress'] ELSE [] END) AS win FROM feat) GROUP BY ALL), (SELECT unnest(['mean', 'std']) AS stat)""",
    "plusr": f"""SELECT {_L}, [CASE WHEN dp > 0 THEN 'delta30 ' || dp END, CASE WHEN a30 >= 0.2 THEN 'aggression 3' WHEN a30 <= -0.2 THEN NULL WHEN a30 >= 0.05 THEN 'aggression 1' END, CASE WHEN b30 >= 0.02 THEN 'bounce30 6' WHEN b30 >= 0.01 THEN 'bounce30 3' WHEN b30 >= 0.005 THEN 'bounce30 1' END, CASE WHEN ratio >= 0.55 THEN CASE WHEN a30 > 0 THEN 'large ratio 7' ELSE 'large ratio 3' END END,
  CASE WHEN ld30 >= 20000 THEN 'large delta 3' END, CASE WHEN n30 >= 50 THEN 'large count 3' WHEN n30 >= 20 THEN 'large count 2' END, CASE WHEN ib THEN 'institutions 4' END, CASE WHEN isell AND b30 > 0 THEN 'absorbed selling 8' END, CASE WHEN comp >= 1 THEN 'compression 3' WHEN comp >= 0.8 THEN 'compression 2' END, CASE WHEN chg > 0.05 THEN 'trend 1' END,
  CASE WHEN level_type = 'support' AND lower > low60 AND b30 * last_price + last_price >= lower - 1e-9 THEN 'wick 2' END, CASE WHEN dwell <= 20 AND b30 > 0 THEN 'dwell 1' END] AS rs FROM (SELECT *, CAST(round_even(greatest(-6.0, least(6.0, asinh(d30 / 50000.0) * 4)), 0) AS INT) AS dp FROM tpx)""",
}
ORACLES = {name: sql(final) for name, final in FINALS.items()}
