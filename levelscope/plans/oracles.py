"""DuckDB SQL that gives the same rows as the registered queries.

Common table expressions build on each other as the operators do; a query's SQL names the
last ones it needs, and the engine evaluates no others.
"""

from __future__ import annotations

CTES: dict[str, str] = {
    "ev": """SELECT event_id AS seq, 'S' || (user_id % 2) AS symbol, event_type,
  (epoch_us(ts) // 1000 - 1704067200000) // 60 + 1704196800000 + ((user_id // 2) % 2) * 86400000 AS ts_ms,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "tape": """SELECT *, (10000 + abs((ts_ms // 60000) % 120 - 60) * 2 + (k % 11 - 5) * 2) / 100.0 AS price,
  symbol || '_' || strftime(make_timestamp(ts_ms * 1000) - INTERVAL 5 HOUR, '%Y-%m-%d') AS session_id FROM ev""",
    "trades": """SELECT seq, symbol, session_id, ts_ms, price, CAST(1 + (seq * 37) % 400 AS DOUBLE) AS size, event_type = 'error' AS odd
  FROM tape WHERE event_type IN ('click', 'purchase', 'error')""",
    "quotes": """SELECT seq, symbol, session_id, ts_ms, price - 0.02 AS bid, CAST(1 + seq % 9 AS DOUBLE) AS bid_size, price + 0.02 AS ask, CAST(1 + seq % 7 AS DOUBLE) AS ask_size
  FROM tape WHERE event_type IN ('view', 'signup')""",
    "extent": """SELECT symbol, session_id, min(ts_ms) AS start_ts_ms, max(ts_ms) AS end_ts_ms
  FROM (SELECT symbol, session_id, ts_ms FROM trades UNION ALL SELECT symbol, session_id, ts_ms FROM quotes) GROUP BY ALL""",
    "lastquotes": """SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY symbol, session_id, ts_ms ORDER BY seq DESC) = 1""",
    "quoted": """SELECT t.*, q.ts_ms AS quote_ts_ms, q.bid, q.bid_size, q.ask, q.ask_size FROM trades t
  ASOF LEFT JOIN lastquotes q ON t.symbol = q.symbol AND t.session_id = q.session_id AND t.ts_ms >= q.ts_ms""",
    "ruled": """SELECT *, lag(price) OVER s AS prev, CASE WHEN price >= ask THEN 'buy' WHEN price <= bid THEN 'sell' WHEN price > lag(price) OVER s THEN 'buy' WHEN price < lag(price) OVER s THEN 'sell' END AS raw
  FROM quoted WHERE bid IS NOT NULL WINDOW s AS (PARTITION BY symbol, session_id ORDER BY ts_ms, seq)""",
    "sided": """SELECT t.*, coalesce(r.side, 'unknown') AS side FROM quoted t LEFT JOIN (
    SELECT seq, coalesce(raw, CASE WHEN prev IS NOT NULL THEN last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol, session_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END) AS side FROM ruled
  ) r USING (seq)""",
    "ruled2": """SELECT *, lag(price) OVER s AS prev, CASE WHEN price >= ask THEN 'buy' WHEN price <= bid THEN 'sell' WHEN price > lag(price) OVER s THEN 'buy' WHEN price < lag(price) OVER s THEN 'sell' END AS raw
  FROM quoted WINDOW s AS (PARTITION BY symbol, session_id ORDER BY ts_ms, seq)""",
    "widths": "SELECT * FROM (VALUES ('30s', 30000), ('1m', 60000), ('2m', 120000), ('3m', 180000)) w(tf, width)",
    "bars": """SELECT symbol, session_id, tf, width, ts_ms - ts_ms % width AS bar_ts, ts_ms - ts_ms % width + width AS end_ts,
  first(price ORDER BY ts_ms, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts_ms, seq) AS close, sum(size) AS volume, count(*) AS trade_count
  FROM trades, widths GROUP BY ALL""",
    "nbars": "SELECT *, row_number() OVER (PARTITION BY symbol, session_id, tf ORDER BY bar_ts) AS n FROM bars",
    "emas": """SELECT symbol, session_id, tf, n, close AS e9, close AS e20, close AS e30, close AS e200 FROM nbars WHERE n = 1
  UNION ALL SELECT b.symbol, b.session_id, b.tf, b.n, e9 + (b.close - e9) * 2 / 10, e20 + (b.close - e20) * 2 / 21, e30 + (b.close - e30) * 2 / 31, e200 + (b.close - e200) * 2 / 201
  FROM emas e JOIN nbars b ON b.symbol = e.symbol AND b.session_id = e.session_id AND b.tf = e.tf AND b.n = e.n + 1""",
    "trs": """SELECT *, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr FROM nbars WINDOW s AS (PARTITION BY symbol, session_id, tf ORDER BY bar_ts)""",
    "smooth": """SELECT symbol, session_id, tf, n, tr AS v FROM trs WHERE n = 1
  UNION ALL SELECT b.symbol, b.session_id, b.tf, b.n, CASE WHEN b.n <= 14 THEN (v * (b.n - 1) + b.tr) / b.n ELSE (v * 13 + b.tr) / 14 END
  FROM smooth e JOIN trs b ON b.symbol = e.symbol AND b.session_id = e.session_id AND b.tf = e.tf AND b.n = e.n + 1""",
    "atrs": "SELECT t.*, CASE WHEN n < 14 THEN 0.7 * 0.5 + 0.3 * v ELSE v END AS atr, CASE WHEN n < 14 THEN 'blending' ELSE 'live' END AS atr_status FROM trs t JOIN smooth USING (symbol, session_id, tf, n)",
    "vwaps": """SELECT *, sum(CASE WHEN ok THEN price * size END) OVER s / sum(CASE WHEN ok THEN size END) OVER s AS vwap
  FROM (SELECT *, size > 0 AND strftime(make_timestamp(ts_ms * 1000) - INTERVAL 5 HOUR, '%H:%M:%S') >= '09:30:00' AS ok FROM trades)
  WINDOW s AS (PARTITION BY session_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING)""",
    "grid": """SELECT symbol, session_id, unnest(generate_series(start_ts_ms - start_ts_ms % 10000 + 9999, end_ts_ms - end_ts_ms % 10000 + 9999, 10000)) AS ts_ms FROM extent""",
    "ticktrades": "SELECT *, ts_ms - ts_ms % 10000 + 9999 AS tick FROM sided",
    "flow": """SELECT g.*, count(t.seq) AS trade_count, coalesce(sum(size), 0.0) AS total_volume, coalesce(sum(size) FILTER (side = 'buy'), 0.0) AS buy_volume, coalesce(sum(size) FILTER (side = 'sell'), 0.0) AS sell_volume,
  coalesce(sum(size) FILTER (side = 'unknown'), 0.0) AS unknown_volume, max(price) FILTER (NOT odd) AS hi, min(price) FILTER (NOT odd) AS lo
  FROM grid g LEFT JOIN ticktrades t ON t.symbol = g.symbol AND t.session_id = g.session_id AND t.tick = g.ts_ms GROUP BY ALL""",
    "lastquote": """SELECT g.*, q.ts_ms AS quote_ts, q.bid, q.ask FROM grid g LEFT JOIN
  (SELECT *, ts_ms - ts_ms % 10000 + 9999 AS tick FROM quotes QUALIFY row_number() OVER (PARTITION BY symbol, session_id, tick ORDER BY ts_ms DESC, seq DESC) = 1) q
  ON q.symbol = g.symbol AND q.session_id = g.session_id AND q.tick = g.ts_ms""",
    "averages": """SELECT a.symbol, a.session_id, a.end_ts, a.atr, a.atr_status, e9 AS ema9, e20 AS ema20, e30 AS ema30, e200 AS ema200
  FROM atrs a JOIN emas e USING (symbol, session_id, tf, n) WHERE a.tf = '1m'""",
    "lastvwap": "SELECT * FROM vwaps QUALIFY row_number() OVER (PARTITION BY symbol, session_id, ts_ms ORDER BY seq DESC) = 1",
    "state": """SELECT p.*, a.atr, a.atr_status, a.ema9, a.ema20, a.ema30, a.ema200 FROM (
    SELECT g.*, v.price AS last_price, v.vwap AS vwap_session FROM grid g ASOF LEFT JOIN lastvwap v ON g.symbol = v.symbol AND g.session_id = v.session_id AND g.ts_ms >= v.ts_ms) p
  ASOF LEFT JOIN averages a ON p.symbol = a.symbol AND p.session_id = a.session_id AND p.ts_ms >= a.end_ts""",
    "stream": """SELECT s.*, q.bid, q.ask, q.quote_ts, (q.ask - q.bid) / ((q.bid + q.ask) / 2) AS spread_pct, f.trade_count, f.total_volume, f.buy_volume, f.sell_volume, f.unknown_volume, f.buy_volume - f.sell_volume AS delta,
  CASE WHEN f.total_volume > 0 THEN (f.buy_volume - f.sell_volume) / (f.total_volume + 1e-9) ELSE 0.0 END AS relative_aggression, coalesce(f.hi, s.last_price) AS high_10s, coalesce(f.lo, s.last_price) AS low_10s
  FROM state s JOIN lastquote q USING (symbol, session_id, ts_ms) JOIN flow f USING (symbol, session_id, ts_ms)""",
    "thresholds": """SELECT g.symbol, g.session_id, g.ts_ms, coalesce(quantile_disc(t.size, 0.95), 0.0) AS thr FROM grid g LEFT JOIN trades t
  ON t.symbol = g.symbol AND t.session_id = g.session_id AND t.ts_ms BETWEEN g.ts_ms - 300000 AND g.ts_ms GROUP BY ALL""",
    "large": """SELECT h.symbol, h.session_id, h.ts_ms, h.thr, count(*) FILTER (size >= thr AND thr > 0) AS n, coalesce(sum(size) FILTER (size >= thr AND side = 'buy'), 0.0) AS lb, coalesce(sum(size) FILTER (size >= thr AND side = 'sell'), 0.0) AS ls,
  coalesce(sum(size) FILTER (size >= thr AND side = 'unknown'), 0.0) AS lu, coalesce(sum(size), 0.0) AS total
  FROM thresholds h LEFT JOIN ticktrades t ON t.symbol = h.symbol AND t.session_id = h.session_id AND t.tick = h.ts_ms GROUP BY ALL""",
    "levels": """SELECT symbol, session_id, level_id, level_price, level_type, 0.25 AS width, CASE WHEN after > 0 THEN start + after ELSE 0 END AS created
  FROM (SELECT symbol, session_id, min(ts_ms) AS start FROM tape GROUP BY ALL), (VALUES ('L1', 100.20, 'support', 0), ('L2', 101.00, 'resistance', 0), ('L3', 100.60, 'support', 7200000)) l(level_id, level_price, level_type, after)""",
    "zone": """SELECT s.symbol, s.session_id, level_id, CAST(level_price AS DOUBLE) AS level_price, level_type, CAST(width AS DOUBLE) AS width, ts_ms, last_price, atr, last_price - CAST(level_price AS DOUBLE) AS d, (last_price - CAST(level_price AS DOUBLE)) / atr AS da,
  abs((last_price - CAST(level_price AS DOUBLE)) / atr) <= 0.25 AS inz FROM state s JOIN levels l ON s.symbol = l.symbol AND s.session_id = l.session_id AND created <= ts_ms WHERE last_price IS NOT NULL AND atr > 0""",
    "zlag": """SELECT *, coalesce(lag(inz) OVER s, false) AS p1, coalesce(lag(inz, 2) OVER s, false) AS p2 FROM zone WINDOW s AS (PARTITION BY symbol, session_id, level_id ORDER BY ts_ms)""",
    "zev": """SELECT *, CASE WHEN inz AND NOT p1 THEN 'enter' WHEN NOT inz AND p1 THEN 'exit' END AS event, sum(CASE WHEN p2 AND NOT p1 AND NOT inz THEN 1 ELSE 0 END) OVER s AS touch_count,
  sum(CASE WHEN inz AND NOT p1 THEN 1 ELSE 0 END) OVER s AS seg FROM zlag WINDOW s AS (PARTITION BY symbol, session_id, level_id ORDER BY ts_ms)""",
    "segs": """SELECT symbol, session_id, level_id, seg, level_price, level_type, width, min(ts_ms) AS entry, min(ts_ms) FILTER (event = 'exit') AS exit_ts, first(atr ORDER BY ts_ms) AS entry_atr, first(d ORDER BY ts_ms) >= 0 AS above
  FROM zev WHERE seg > 0 GROUP BY ALL""",
    "trig": """SELECT z.*, s.entry, s.exit_ts, s.entry_atr, s.above, CASE WHEN s.exit_ts IS NOT NULL AND s.exit_ts <= z.ts_ms AND z.ts_ms >= s.exit_ts + 300000 THEN 'timeout' WHEN da >= 0.5 THEN 'threshold_hit' WHEN da <= -0.35 THEN 'invalidation' END AS why
  FROM zev z JOIN segs s USING (symbol, session_id, level_id, seg)""",
    "ends": "SELECT symbol, session_id, level_id, seg, min(ts_ms) AS res, first(why ORDER BY ts_ms) AS why FROM trig WHERE why IS NOT NULL GROUP BY ALL",
    "eps": """SELECT *, mts - entry AS mfe_ms, fts - entry AS fail_ms FROM (
  SELECT symbol, session_id, level_id, seg, t.level_price, t.level_type, t.entry, max(CASE WHEN t.exit_ts <= t.ts_ms THEN t.exit_ts END) AS exit_ts, t.above, e.res, e.why, t.entry_atr,
    greatest(0.0, max((last_price - level_price) / entry_atr)) AS mfe, greatest(0.0, -min((last_price - level_price) / entry_atr)) AS mae,
    first(ts_ms ORDER BY (last_price - level_price) / entry_atr DESC, ts_ms) AS mts, min(ts_ms) FILTER (-(last_price - level_price) / entry_atr >= 0.35) AS fts
  FROM trig t JOIN ends e USING (symbol, session_id, level_id, seg) WHERE ts_ms <= e.res
  GROUP BY symbol, session_id, level_id, seg, t.level_price, t.level_type, t.entry, t.above, e.res, e.why, t.entry_atr)""",
}


def sql(final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body})" for name, body in CTES.items()) + "\n" + final


_K = "symbol, session_id"
R = "round({}, 6) AS {}"


def r(*pairs: str) -> str:
    """``round(x, 6) AS name`` for each 'name' or 'name=x'."""
    out = []
    for p in pairs:
        name, _, x = p.partition("=")
        out.append(f"round({x or name}, 6) AS {name}")
    return ", ".join(out)


_T60 = "RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW"
_S = f"PARTITION BY {_K} ORDER BY ts_ms"

FINALS: dict[str, str] = {
    "scan_trades": f"SELECT symbol, ts_ms, price, size, CASE WHEN odd THEN 'W' ELSE '' END AS conditions FROM trades",
    "scan_quotes": f"SELECT symbol, ts_ms, {r('bid', 'ask')}, bid_size, ask_size FROM quotes",
    "norm_conditions": "SELECT odd AS has_w, CAST(odd AS INT) AS n_conditions, count(*) AS n FROM trades GROUP BY ALL",
    "range_scan": "SELECT ts_ms, price, size FROM trades WHERE symbol = 'S0' AND ts_ms BETWEEN 1704207600000 AND 1704218400000",
    "stable_order": f"SELECT seq, {_K}, row_number() OVER (PARTITION BY {_K} ORDER BY ts_ms, seq) AS position FROM trades",
    "event_merge": f"SELECT seq, kind, {_K}, row_number() OVER (PARTITION BY {_K} ORDER BY ts_ms, o, seq) AS position FROM (SELECT seq, {_K}, ts_ms, 'quote' AS kind, 0 AS o FROM quotes UNION ALL SELECT seq, {_K}, ts_ms, 'trade', 2 FROM trades UNION ALL SELECT seq, {_K}, ts_ms, 'command', 1 FROM tape WHERE event_type = 'signup')",
    "session_extent": f"SELECT {_K}, start_ts_ms, end_ts_ms FROM extent",
    "exch_date": "SELECT strftime(make_timestamp(ts_ms * 1000) - INTERVAL 5 HOUR, '%Y-%m-%d') AS date, strftime(make_timestamp(ts_ms * 1000) - INTERVAL 6 HOUR, '%H:%M') AS minute, count(*) AS n FROM trades GROUP BY ALL",
    "tape_preview": f"SELECT {_K}, n_trades, n_quotes, first_price, last_price FROM (SELECT {_K}, count(*) AS n_trades, first(price ORDER BY ts_ms, seq) AS first_price, last(price ORDER BY ts_ms, seq) AS last_price FROM trades GROUP BY ALL) JOIN (SELECT {_K}, count(*) AS n_quotes FROM quotes GROUP BY ALL) USING ({_K})",
    "asof_quote": f"SELECT seq, {_K}, ts_ms, price, quote_ts_ms, {r('bid', 'ask')} FROM quoted",
    "quote_rule": f"SELECT seq, {_K}, CASE WHEN price >= ask THEN 'buy' WHEN price <= bid THEN 'sell' ELSE 'unknown' END AS side FROM quoted",
    "lee_ready": f"SELECT seq, {_K}, ts_ms, price, size, side FROM sided",
    "lee_ready_noquote": f"SELECT seq, {_K}, coalesce(raw, CASE WHEN prev IS NOT NULL THEN last_value(raw IGNORE NULLS) OVER (PARTITION BY {_K} ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, 'unknown') AS side FROM ruled2",
    **{f"bars_{tf}": f"SELECT {_K}, bar_ts, open, high, low, close, volume, trade_count FROM bars WHERE tf = '{tf}'" for tf in ("30s", "1m", "2m", "3m")},
    "candles": f"SELECT {_K}, tf, end_ts, strftime(make_timestamp(bar_ts * 1000) - INTERVAL 6 HOUR, '%H:%M') AS minute, open, high, low, close FROM bars",
    "true_range": f"SELECT {_K}, bar_ts, {r('tr')} FROM trs WHERE tf = '1m'",
    "vwap": f"SELECT seq, {_K}, {r('vwap')} FROM vwaps",
    "ema_1m": f"SELECT {_K}, bar_ts, {r('ema9=e9', 'ema20=e20', 'ema30=e30', 'ema200=e200')} FROM emas JOIN nbars USING ({_K}, tf, n) WHERE tf = '1m'",
    "ema_tf": f"SELECT {_K}, tf, bar_ts, {r('ema9=e9', 'ema20=e20', 'ema30=e30', 'ema200=e200')} FROM emas JOIN nbars USING ({_K}, tf, n)",
    "atr": f"SELECT {_K}, bar_ts, n AS bar_no, {r('tr', 'atr')}, atr_status FROM atrs WHERE tf = '1m'",
    "atr_seed": f"SELECT {_K}, bar_ts, {r('seed=atr * 20 / sqrt(390)')} FROM atrs WHERE tf = '3m'",
    "atr_seed_chain": f"SELECT {_K}, {r('seed=coalesce(lag(last_atr) OVER (PARTITION BY symbol ORDER BY start), 0.5)')} FROM (SELECT {_K}, last(atr ORDER BY bar_ts) AS last_atr, min(bar_ts) AS start FROM atrs WHERE tf = '1m' GROUP BY ALL)",
    "tick_grid": f"SELECT {_K}, ts_ms, row_number() OVER ({_S}) - 1 AS sequence_id FROM grid",
    "tick_state": f"SELECT {_K}, ts_ms, last_price, {r('vwap_session', 'ema9', 'ema200', 'atr')} FROM state",
    "tick_quote": f"SELECT {_K}, ts_ms, {r('bid', 'ask', 'mid_price=(bid + ask) / 2', 'spread_abs=ask - bid', 'spread_pct=(ask - bid) / ((bid + ask) / 2)')}, ts_ms - quote_ts AS quote_age_ms FROM lastquote",
    "spread": f"SELECT seq, {_K}, {r('mid_price=(bid + ask) / 2', 'spread_abs=ask - bid', 'spread_pct=(ask - bid) / ((bid + ask) / 2)')} FROM quotes WHERE bid > 0 AND ask > 0",
    "tick_flow": f"SELECT {_K}, ts_ms, trade_count, total_volume, buy_volume, sell_volume, unknown_volume, buy_volume - sell_volume AS delta, {r('pct_at_ask=CASE WHEN total_volume > 0 THEN buy_volume / total_volume ELSE 0.0 END', 'relative_aggression=CASE WHEN total_volume > 0 THEN (buy_volume - sell_volume) / (total_volume + 1e-9) ELSE 0.0 END')} FROM flow",
    "tick_hilo": f"SELECT {_K}, ts_ms, high_10s, low_10s FROM stream",
    "filter_w": f"SELECT {_K}, ts_ms, hi AS high, lo AS low FROM flow",
    "spread_vol": f"""SELECT {_K}, ts_ms, round(v, 6) AS spread_volatility_60s, round(CASE WHEN n < 2 OR v <= 1e-9 THEN 0.0 ELSE (coalesce(spread_pct, 0.0) - mean) / (v + 1e-9) END, 4) AS spread_zscore
  FROM (SELECT *, count(spread_pct) OVER s AS n, avg(spread_pct) OVER s AS mean, coalesce(CASE WHEN count(spread_pct) OVER s > 1 THEN stddev_pop(spread_pct) OVER s END, 0.0) AS v FROM stream WINDOW s AS ({_S} {_T60}))""",
    "aggr_z": f"SELECT {_K}, ts_ms, {r('z=CASE WHEN stddev_pop(relative_aggression) OVER s > 1e-9 THEN (relative_aggression - avg(relative_aggression) OVER s) / (stddev_pop(relative_aggression) OVER s + 1e-9) ELSE 0.0 END')} FROM stream WINDOW s AS ({_S} {_T60})",
    "delta_deriv": f"SELECT {_K}, ts_ms, v AS delta_velocity, coalesce(v - lag(v) OVER ({_S}), 0.0) AS delta_acceleration FROM (SELECT {_K}, ts_ms, coalesce(delta - lag(delta) OVER ({_S}), 0.0) AS v FROM stream)",
    "absorption": f"SELECT {_K}, ts_ms, round(asinh(greatest(0.0, -delta) / (abs(coalesce(round(last_price, 4) - lag(round(last_price, 4)) OVER ({_S}), 0.0)) + 1e-9)), 4) AS absorption FROM stream",
    "trade_size": f"SELECT {_K}, tick AS ts_ms, {r('avg_trade_size=avg(size)', 'trade_size_std=stddev_pop(size)', 'trade_size_cv=stddev_pop(size) / avg(size)', 'top_decile_volume_share=sum(size) FILTER (n <= greatest(1, ceil(total * 0.1))) / sum(size)')} FROM (SELECT *, row_number() OVER (PARTITION BY {_K}, tick ORDER BY size DESC, seq) AS n, count(*) OVER (PARTITION BY {_K}, tick) AS total FROM ticktrades) GROUP BY {_K}, tick",
    "realized_vol": f"SELECT {_K}, ts_ms, {r('realized_vol_60s=coalesce(stddev_pop(step) OVER s, 0.0)')} FROM (SELECT {_K}, ts_ms, ln(last_price / lag(last_price) OVER ({_S})) AS step FROM state) WINDOW s AS ({_S} RANGE BETWEEN 50000 PRECEDING AND CURRENT ROW)",
    "approach_ret": f"SELECT {_K}, ts_ms, {r('approach_return_60s=coalesce(ln(last_price / (last_value(last_price IGNORE NULLS) OVER s)), 0.0)')} FROM state WINDOW s AS ({_S} RANGE BETWEEN 300000 PRECEDING AND 60000 PRECEDING)",
    "ema_mask": f"SELECT {_K}, ts_ms, CASE WHEN ema9 IS NOT NULL THEN CASE WHEN ema9 > ema20 AND ema20 > ema30 THEN 'bull' WHEN ema9 < ema20 AND ema20 < ema30 THEN 'bear' ELSE 'mixed' END END AS stack_state, CASE WHEN last_price > ema200 THEN 8 ELSE 0 END + CASE WHEN last_price > ema30 THEN 4 ELSE 0 END + CASE WHEN last_price > ema20 THEN 2 ELSE 0 END + CASE WHEN last_price > ema9 THEN 1 ELSE 0 END AS price_vs_emas FROM state",
    "ema_structure": f"SELECT {_K}, ts_ms, {r('slope_ema9_60s=coalesce((ema9 - then9) * 1000.0 / (ts_ms - then_ts), 0.0)', 'ema_spread_9_20=ema9 - ema20', 'compression_index=(abs(ema9 - ema20) + abs(ema20 - ema30)) / atr', 'ema_confluence_score=CASE WHEN atr IS NOT NULL THEN least(1.0, greatest(0.0, 1 - (abs(ema9 - ema20) + abs(ema20 - ema30)) / atr / 0.25)) END', 'stretch_200_atr=coalesce((last_price - ema200) / atr, 0.0)')} FROM (SELECT *, last_value(CASE WHEN ema9 IS NOT NULL THEN ts_ms END IGNORE NULLS) OVER s AS then_ts, last_value(ema9 IGNORE NULLS) OVER s AS then9 FROM state WINDOW s AS ({_S} RANGE BETWEEN 300000 PRECEDING AND 60000 PRECEDING))",
    "vwap_context": f"SELECT {_K}, ts_ms, {r('price_minus_vwap=last_price - vwap_session', 'price_minus_vwap_atr=(last_price - vwap_session) / atr')}, CASE WHEN last_price - vwap_session > 1e-12 THEN 'above' WHEN last_price - vwap_session < -1e-12 THEN 'below' WHEN last_price - vwap_session IS NOT NULL THEN 'at' END AS vwap_state FROM state",
    "large_threshold": f"SELECT {_K}, ts_ms, thr AS large_trade_threshold_size FROM thresholds",
    "large_trades": f"SELECT {_K}, ts_ms, n AS large_trade_count_10s, lb AS large_buy_volume_10s, ls AS large_sell_volume_10s, lu AS large_unknown_volume_10s, lb - ls AS large_trade_delta, {r('large_trade_buy_ratio=CASE WHEN lb + ls > 0 THEN lb / (lb + ls + 1e-9) ELSE 0.0 END', 'large_trade_share_of_total_vol_10s=CASE WHEN total > 0 THEN (lb + ls + lu) / (total + 1e-9) ELSE 0.0 END')} FROM large",
    "session_stream": f"""SELECT {_K}, ts_ms, row_number() OVER ({_S}) - 1 AS sequence_id, last_price, {r('vwap_session', 'atr', 'ema9', 'ema9_2m=two', 'ema200_3m=three', 'spread_pct', 'relative_aggression')}, trade_count, total_volume, delta, high_10s, low_10s, l.thr AS large_trade_threshold_size, l.n AS large_trade_count_10s,
  round((abs(ema9 - ema20) + abs(ema20 - ema30)) / atr, 6) AS compression_index, round(CASE WHEN atr IS NOT NULL THEN least(1.0, greatest(0.0, 1 - (abs(ema9 - ema20) + abs(ema20 - ema30)) / atr / 0.25)) END, 6) AS ema_confluence_score,
  CASE WHEN ema9 IS NULL THEN NULL WHEN ema9 > ema20 AND ema20 > ema30 THEN 'bull' WHEN ema9 < ema20 AND ema20 < ema30 THEN 'bear' ELSE 'mixed' END AS stack_state,
  CASE WHEN last_price - vwap_session > 1e-12 THEN 'above' WHEN last_price - vwap_session < -1e-12 THEN 'below' WHEN last_price - vwap_session IS NOT NULL THEN 'at' END AS vwap_state, round((last_price - vwap_session) / atr, 6) AS price_minus_vwap_atr,
  round(coalesce(stddev_pop(step) OVER ({_S} RANGE BETWEEN 50000 PRECEDING AND CURRENT ROW), 0.0), 6) AS realized_vol_60s, coalesce(delta - pdelta, 0.0) AS delta_velocity
  FROM (SELECT *, ln(last_price / lag(last_price) OVER ({_S})) AS step, lag(delta) OVER ({_S}) AS pdelta FROM stream) JOIN large l USING ({_K}, ts_ms) JOIN (SELECT g.symbol, g.session_id, g.ts_ms, a.e9 AS two, b.e200 AS three FROM grid g
  ASOF LEFT JOIN (SELECT x.*, b.end_ts FROM emas x JOIN nbars b USING ({_K}, tf, n) WHERE tf = '2m') a ON a.symbol = g.symbol AND a.session_id = g.session_id AND g.ts_ms >= a.end_ts
  ASOF LEFT JOIN (SELECT x.*, b.end_ts FROM emas x JOIN nbars b USING ({_K}, tf, n) WHERE tf = '3m') b ON b.symbol = g.symbol AND b.session_id = g.session_id AND g.ts_ms >= b.end_ts) tfs USING ({_K}, ts_ms)""",
    "active_levels": f"SELECT {_K}, level_id, CAST(level_price AS DOUBLE) AS level_price, created AS created_ts_ms FROM levels",
    "zone_distance": f"SELECT {_K}, level_id, ts_ms, {r('signed_distance=d', 'signed_distance_atr=da')}, inz AS in_zone FROM zone",
    "zone_events": f"SELECT {_K}, level_id, ts_ms, event FROM zev WHERE event IS NOT NULL",
    "touch_count": f"SELECT {_K}, level_id, CAST(max(touch_count) AS BIGINT) AS touches, count(*) FILTER (event = 'enter') AS entries FROM zev GROUP BY ALL",
    "resolution": f"SELECT {_K}, level_id, why AS resolution_trigger, count(*) AS n FROM eps GROUP BY ALL",
    "episodes": f"SELECT {_K}, level_id, entry - 300000 AS start_time, entry AS zone_entry_time, exit_ts AS zone_exit_time, res AS resolution_time, why AS resolution_trigger, CASE WHEN above THEN 'above' ELSE 'below' END AS level_entry_side FROM eps",
    "outcome_metrics": f"SELECT {_K}, level_id, entry AS zone_entry_time, CASE why WHEN 'threshold_hit' THEN 'win' WHEN 'invalidation' THEN 'loss' ELSE 'scratch' END AS outcome, {r('mfe', 'mae')}, mfe_ms AS time_to_mfe_ms, fail_ms AS time_to_failure_ms FROM eps",
    "outcome_counts": "SELECT CASE why WHEN 'threshold_hit' THEN 'win' WHEN 'invalidation' THEN 'loss' ELSE 'scratch' END AS outcome, session_id, count(*) AS n FROM eps GROUP BY ALL",
    "episode_stats": f"SELECT session_id, metric, {r('min=min(x)', 'p50=quantile_cont(x, 0.5)', 'p90=quantile_cont(x, 0.9)', 'max=max(x)', 'mean=avg(x)')} FROM (SELECT session_id, 'mfe' AS metric, mfe AS x FROM eps UNION ALL SELECT session_id, 'mae', mae FROM eps UNION ALL SELECT session_id, 'time_to_mfe_ms', CAST(mfe_ms AS DOUBLE) FROM eps UNION ALL SELECT session_id, 'time_to_failure_ms', CAST(fail_ms AS DOUBLE) FROM eps) WHERE x IS NOT NULL GROUP BY session_id, metric",
    "baseline_backfill": f"SELECT e.symbol, e.session_id, e.level_id, e.entry AS zone_entry_time, count(*) AS ticks, round(min(da), 6) AS lowest FROM eps e JOIN zone z ON z.symbol = e.symbol AND z.session_id = e.session_id AND z.level_id = e.level_id AND z.ts_ms >= e.entry - 300000 AND z.ts_ms < e.entry GROUP BY ALL",
}
ORACLES = {name: sql(final) for name, final in FINALS.items()}
