"""Queries of windows, identities, vendor messages, time frames and checks, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import bars as B
from ..operators import stats as G
from ..operators import tape as T
from ..operators import ticks as K
from ..operators import windows as W
from ..operators import zones as Z
from ..schemas import KEY
from ..sources import store, tape_files
from ..streaming import tape_stream as ST
from . import level_oracles  # noqa: F401  its table expressions are used below
from .level_queries import _markers, _snapshots, _streamed, packets
from .oracles import CTES, r, sql
from .queries import Query, Tape, rounded, tape_of


def _anchors(t: Tape) -> DataFrame:
    return _markers(t).select("marker_id", *KEY, F.col("ts_ms").alias("anchor_ts"))


def _ticks(t: Tape) -> DataFrame:
    return t.stream.where("last_price IS NOT NULL")


def _countdown(t: Tape) -> DataFrame:
    out = W.countdown(_anchors(t), _ticks(t)).select("marker_id", F.col("window").cast("long").alias("window"), "points", "trades", "volume", "delta", "price_first", "price_last", "return_pct")
    return rounded(out, "return_pct")


def _time_frames(t: Tape) -> DataFrame:
    """Two time frames at the ticks of episodes."""
    own = _snapshots(t).select("episode_id", *Z.LEVEL, "zone_entry_time", "ts_ms", "last_price", "atr")
    parts = []
    for tf in ("30s", "1m"):
        bars = B.with_emas(B.bars(t.trades, {tf: B.WIDTHS[tf]})).select(*KEY, "end_ts", "ema9", "ema20", "ema30", "ema200")
        state = K.tick_state(t.grid, t.trades.withColumn("vwap", F.lit(None).cast("double")), bars).drop("last_price", "vwap_session")
        parts.append(own.join(state, K.TICK).where("ema9 IS NOT NULL").withColumn("timeframe", F.lit(tf)))
    out = Z.tf_rows(parts[0].unionByName(parts[1]))
    names = ["ema9", "ema200", "slope_ema9_60s", "slope_ema30_60s", "compression_index", "ema_confluence_score", "stretch_200_atr"]
    return rounded(out.select(*Z.LEVEL, "zone_entry_time", "ts_ms", "timeframe", "stack_state", "price_vs_emas", *names), *names)


def _vendor_a(t: Tape) -> DataFrame:
    """Trades as the first vendor's JSON lines, landed and read back."""
    iso = F.concat(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("456789Z"))
    # field names that differ by case alone can't be columns of one struct, so the text is put together
    rest = F.to_json(F.struct(F.col("symbol").alias("S"), F.col("price").alias("p"), F.col("conditions").alias("c")))
    message = F.concat(F.lit('{"T":"t","t":"'), iso, F.lit('","s":'), F.col("size").cast("string"), F.lit(","), F.substring(rest, 2, 10_000))
    path = store.scratch(t.spark)
    t.trades.select(message.alias("value")).write.text(path)
    found, _ = tape_files.vendor_a(t.spark.read.text(path))
    return found.select("symbol", "ts_ms", "price", "size", F.size("conditions").cast("long").alias("n_conditions"))


def _vendor_b(t: Tape) -> DataFrame:
    odd = F.col("seq") % 3
    rows = t.trades.select(F.when(odd == 0, F.col("ts_ms") * 1_000_000 + 999_999).alias("sip_timestamp"), F.when(odd == 1, F.col("ts_ms")).alias("timestamp"), F.col("price").alias("p"), F.when(F.col("seq") % 10 != 7, F.col("size")).alias("s"))
    good, bad = tape_files.vendor_b(rows, "X")
    return good.agg(F.count("*").alias("n"), F.sum("ts_ms").alias("ts_sum"), F.sum("size").alias("size_sum")).join(bad.agg(F.count("*").alias("rejected")))


def _parse(t: Tape) -> DataFrame:
    text = F.date_format(X.local(F.col("ts_ms"), X.EXCHANGE_ZONE), "yyyy-MM-dd HH:mm:ss")
    return t.trades.select("seq", X.parse_local(text, X.EXCHANGE_ZONE).alias("parsed_ms"))


def _zone_share(t: Tape) -> DataFrame:
    return rounded(G.dq_zone(_snapshots(t), Z.LEVEL), "share_25", "share_50", "share_divergent")


def _sequence(t: Tape) -> DataFrame:
    """The episodes' recorded ticks, numbered as the stream numbers them; one in a hundred has lost its place."""
    ticks = _snapshots(t).select(*Z.LEVEL, "zone_entry_time", "ts_ms").join(t.stream.select(*K.TICK, "sequence_id"), K.TICK)
    moved = F.when((F.col("ts_ms") - 9999) % 970_000 == 0, F.col("sequence_id") - 5).otherwise(F.col("sequence_id"))
    return G.dq_sequence(ticks.withColumn("sequence_id", moved), [*Z.LEVEL, "zone_entry_time"])


def _gaps(t: Tape) -> DataFrame:
    atr = t.averages.groupBy(*KEY).agg(F.max_by("atr", "end_ts").alias("atr"))
    return rounded(W.level_gaps(t.levels, atr), "gap", "gap_atr")


def _ids(t: Tape) -> DataFrame:
    e = t.episodes
    return e.select(F.format_string("touch:%.4f:%d", "level_price", "zone_entry_time").alias("touch_id"), F.concat_ws(":", F.lit("manual"), "symbol", F.col("zone_entry_time").cast("string")).alias("manual_id"), X.scenario(F.col("level_type"), F.col("outcome")).alias("scenario"))


def _dedup(t: Tape) -> DataFrame:
    twice = _markers(t).unionByName(_markers(t).withColumn("marker_id", F.concat(F.lit("z"), "marker_id")))
    return Z.dedup_markers(twice).select("marker_id", "marker_type", "ts_ms")


def _labels(t: Tape) -> DataFrame:
    e = t.episodes
    labels = e.where("outcome = 'win'").select("episode_id", F.lit("good").alias("manual_outcome"), F.lit("bounce").alias("setup_type"), F.lit(3).alias("confidence"))
    return Z.merge_labels(e, labels).groupBy("session_id", "outcome", "manual_outcome").agg(F.count("*").alias("n"))


def _shared(t: Tape) -> DataFrame:
    combo = F.concat_ws("+", "approach_type", "touch_outcome")
    return G.shared_combos(packets(t).select("session_id", combo.alias("combo")))


def _range(t: Tape) -> DataFrame:
    """Two requests for the same windows of each ticker."""
    one = _markers(t).select(F.col("symbol").alias("ticker"), (F.col("ts_ms") - 60_000).alias("start_ts"), (F.col("ts_ms") + 600_000).alias("end_ts"))
    return W.session_range(one.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("request")), ["ticker", "request"])


PLANS: dict[str, Callable[[Tape], DataFrame]] = {
    "countdown": _countdown,
    "anchor_stats": lambda t: rounded(W.anchor_stats(_anchors(t), _ticks(t), ["last_price", "delta", "atr"]), "p10", "p50", "p90", "mean"),
    "level_gaps": _gaps,
    "tape_minutes": lambda t: W.tape_minutes(T.lee_ready(t.quoted, need_quote=False).withColumn("size", F.col("size") * 3), F.lit(100.05), F.lit(100.35)),
    "session_range": _range,
    "tf_indicators": _time_frames,
    "norm_vendor_a": _vendor_a,
    "norm_vendor_b": _vendor_b,
    "parse_local_ts": _parse,
    "dq_zone": _zone_share,
    "dq_sequence": _sequence,
    "ids": _ids,
    "marker_dedup": _dedup,
    "merge_labels": _labels,
    "shared_combos": _shared,
    "st_threshold": lambda t: _streamed(t, ST.st_threshold),
    }


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLANS[name](tape_of(spark, sf_dir))


QUERIES: dict[str, Query] = {name: partial(_run, name) for name in PLANS}

_K = "symbol, session_id"
CTES |= {
    "tfstate": f"""SELECT g.*, v.price AS last_price FROM (SELECT {_K}, ts_ms, tf FROM grid, (VALUES ('30s'), ('1m')) f(tf)) g ASOF LEFT JOIN lastvwap v ON g.symbol = v.symbol AND g.session_id = v.session_id AND g.ts_ms >= v.ts_ms""",
    "tfema": f"SELECT b.symbol, b.session_id, b.tf, b.end_ts, e9, e20, e30, e200 FROM emas JOIN nbars b USING ({_K}, tf, n)",
    "sided2": f"SELECT *, coalesce(raw, CASE WHEN prev IS NOT NULL THEN last_value(raw IGNORE NULLS) OVER (PARTITION BY {_K} ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, 'unknown') AS side FROM ruled2",
}
_TM = "count(*) AS trades, sum(CASE WHEN side = 'buy' THEN size * 3 ELSE 0.0 END) AS buy, sum(CASE WHEN side = 'sell' THEN size * 3 ELSE 0.0 END) AS sell, sum(CASE WHEN side = 'buy' AND size * 3 >= 500 THEN size * 3 ELSE 0.0 END) AS inst_buy, sum(CASE WHEN side = 'sell' AND size * 3 >= 500 THEN size * 3 ELSE 0.0 END) AS inst_sell"
FINALS = {
    "countdown": "SELECT marker_id, CAST(w AS BIGINT) AS window, count(*) AS points, CAST(sum(trade_count) AS BIGINT) AS trades, sum(total_volume) AS volume, sum(delta) AS delta, first(last_price ORDER BY s.ts_ms) AS price_first, last(last_price ORDER BY s.ts_ms) AS price_last, round((last(last_price ORDER BY s.ts_ms) - first(last_price ORDER BY s.ts_ms)) / first(last_price ORDER BY s.ts_ms), 6) AS return_pct FROM mk m, (VALUES (0, 240, 180), (1, 180, 120), (2, 120, 60), (3, 60, 30), (4, 30, 0)) c(w, a, b), stream s WHERE s.symbol = m.symbol AND s.session_id = m.session_id AND last_price IS NOT NULL AND s.ts_ms > m.ts_ms - a * 1000 AND s.ts_ms <= m.ts_ms - b * 1000 GROUP BY marker_id, w",
    "anchor_stats": f"SELECT marker_id, c AS column, {r('p10=quantile_cont(x, 0.1)', 'p50=quantile_cont(x, 0.5)', 'p90=quantile_cont(x, 0.9)', 'mean=avg(x)')} FROM (SELECT m.marker_id, unnest(['last_price', 'delta', 'atr']) AS c, unnest([last_price, delta, atr]) AS x FROM mk m JOIN stream s ON s.symbol = m.symbol AND s.session_id = m.session_id AND s.ts_ms > m.ts_ms - 300000 AND s.ts_ms <= m.ts_ms WHERE last_price IS NOT NULL) WHERE x IS NOT NULL GROUP BY marker_id, c",
    "level_gaps": f"SELECT {_K}, level_id, CAST(level_price AS DOUBLE) AS level_price, round(gap, 6) AS gap, round(gap / atr, 6) AS gap_atr, coalesce(gap / atr < 0.5, false) AS cluster FROM (SELECT {_K}, level_id, level_price, CAST(level_price AS DOUBLE) - lead(CAST(level_price AS DOUBLE)) OVER (PARTITION BY {_K} ORDER BY level_price DESC) AS gap FROM levels) JOIN (SELECT {_K}, last(atr ORDER BY end_ts) AS atr FROM averages GROUP BY ALL) USING ({_K})",
    "tape_minutes": f"SELECT {_K}, ts_ms - ts_ms % 60000 AS minute_ts, CASE WHEN price > 100.35 THEN 'ABOVE' WHEN price < 100.05 THEN 'BELOW' ELSE 'IN_BAND' END AS zone, {_TM} FROM sided2 GROUP BY ALL UNION ALL SELECT {_K}, ts_ms - ts_ms % 60000 AS minute_ts, 'ALL' AS zone, {_TM} FROM sided2 GROUP BY ALL",
    "session_range": "SELECT ticker, request, start_ts, end_ts, ticker || '_' || strftime(make_timestamp(start_ts * 1000), '%Y%m%d_%H%M%S') || CASE request WHEN 'b' THEN '_2' ELSE '' END AS session_id FROM (VALUES ('a'), ('b')) q(request), (SELECT symbol AS ticker, min(ts_ms) - 60000 AS start_ts, max(ts_ms) + 600000 AS end_ts FROM mk GROUP BY ALL)",
    "tf_indicators": f"""SELECT {_K}, level_id, entry AS zone_entry_time, ts_ms, tf AS timeframe, round(e9, 6) AS ema9, round(e200, 6) AS ema200, CASE WHEN e9 > e20 AND e20 > e30 THEN 'bull' WHEN e9 < e20 AND e20 < e30 THEN 'bear' ELSE 'mixed' END AS stack_state,
  CASE WHEN last_price > e200 THEN 8 ELSE 0 END + CASE WHEN last_price > e30 THEN 4 ELSE 0 END + CASE WHEN last_price > e20 THEN 2 ELSE 0 END + CASE WHEN last_price > e9 THEN 1 ELSE 0 END AS price_vs_emas,
  round(coalesce((e9 - b9) * 1000.0 / (ts_ms - bt), 0.0), 6) AS slope_ema9_60s, round(coalesce((e30 - b30) * 1000.0 / (ts_ms - bt), 0.0), 6) AS slope_ema30_60s, round((abs(e9 - e20) + abs(e20 - e30)) / atr, 6) AS compression_index,
  round(greatest(0.0, least(1.0, 1 - (abs(e9 - e20) + abs(e20 - e30)) / atr / 0.25)), 6) AS ema_confluence_score, round((last_price - e200) / atr, 6) AS stretch_200_atr
  FROM (SELECT *, last_value(ts_ms) OVER b AS bt, last_value(e9) OVER b AS b9, last_value(e30) OVER b AS b30 FROM (SELECT et.symbol, et.session_id, et.level_id, et.entry, et.ts_ms, et.last_price, et.atr, s.tf, s.e9, s.e20, s.e30, s.e200 FROM et
    JOIN (SELECT g.symbol, g.session_id, g.ts_ms, g.tf, e.e9, e.e20, e.e30, e.e200 FROM tfstate g ASOF JOIN tfema e ON g.symbol = e.symbol AND g.session_id = e.session_id AND g.tf = e.tf AND g.ts_ms >= e.end_ts) s ON s.symbol = et.symbol AND s.session_id = et.session_id AND s.ts_ms = et.ts_ms)
  WINDOW b AS (PARTITION BY {_K}, level_id, entry, tf ORDER BY ts_ms RANGE BETWEEN 300000 PRECEDING AND 60000 PRECEDING))""",
    "norm_vendor_a": "SELECT symbol, ts_ms, price, size, CAST(odd AS BIGINT) AS n_conditions FROM trades",
    "norm_vendor_b": "SELECT count(*) FILTER (ok) AS n, CAST(sum(ts_ms) FILTER (ok) AS BIGINT) AS ts_sum, sum(size) FILTER (ok) AS size_sum, count(*) FILTER (NOT ok) AS rejected FROM (SELECT *, seq % 3 <> 2 AND seq % 10 <> 7 AS ok FROM trades)",
    "parse_local_ts": "SELECT seq, ts_ms - ts_ms % 1000 AS parsed_ms FROM trades",
    "dq_zone": f"SELECT {_K}, level_id, round(avg(CAST(abs(da) <= 0.25 AS INT)), 6) AS share_25, round(avg(CAST(abs(da) <= 0.5 AS INT)), 6) AS share_50, round(avg(df), 6) AS share_divergent FROM smd GROUP BY ALL",
    "dq_sequence": f"SELECT {_K}, level_id, entry AS zone_entry_time, bool_and(coalesce(n >= p, true)) AS monotonic, count(*) - count(DISTINCT n) AS duplicates FROM (SELECT *, lag(n) OVER (PARTITION BY {_K}, level_id, entry ORDER BY ts_ms) AS p FROM (SELECT {_K}, level_id, entry, ts_ms, g.n - CASE WHEN (ts_ms - 9999) % 970000 = 0 THEN 5 ELSE 0 END AS n FROM et JOIN (SELECT {_K}, ts_ms, row_number() OVER (PARTITION BY {_K} ORDER BY ts_ms) - 1 AS n FROM grid) g USING ({_K}, ts_ms))) GROUP BY ALL",
    "ids": "SELECT format('touch:{:.4f}:{}', level_price, entry) AS touch_id, 'manual:' || symbol || ':' || entry AS manual_id, CASE level_type WHEN 'support' THEN 'long' ELSE 'short' END || '_' || CASE why WHEN 'threshold_hit' THEN 'win' WHEN 'invalidation' THEN 'loss' ELSE 'pending' END AS scenario FROM eps",
    "marker_dedup": "SELECT marker_id, marker_type, ts_ms FROM mk",
    "merge_labels": "SELECT session_id, outcome, CASE outcome WHEN 'win' THEN 'good' END AS manual_outcome, count(*) AS n FROM (SELECT session_id, CASE why WHEN 'threshold_hit' THEN 'win' WHEN 'invalidation' THEN 'loss' ELSE 'scratch' END AS outcome FROM eps) GROUP BY ALL",
    "shared_combos": "SELECT combo, count(DISTINCT session_id) AS sessions FROM (SELECT session_id, concat_ws('+', CASE WHEN speed >= 1.5 THEN 'crash' WHEN speed >= 0.75 THEN 'fast' WHEN speed >= 0.25 THEN 'normal' WHEN speed IS NOT NULL THEN 'grind' END, CASE WHEN NOT conf THEN 'hold' WHEN again AND nheld THEN 'break_reclaim_hold' WHEN again THEN 'break_reclaim_fail' ELSE 'break' END) AS combo FROM tp) GROUP BY combo HAVING count(DISTINCT session_id) = (SELECT count(DISTINCT session_id) FROM tp)",
}
ORACLES = {name: sql(final) for name, final in FINALS.items()}
