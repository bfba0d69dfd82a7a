"""DuckDB SQL for the queries of levels, touches, scores and sessions."""

from __future__ import annotations

from .oracles import CTES, r, sql

_K = "symbol, session_id"
_L = f"{_K}, level_id"
_W = f"PARTITION BY {_L} ORDER BY ts_ms"
_S = f"PARTITION BY {_K} ORDER BY ts_ms"

CTES |= {
    "lt": f"""SELECT s.*, l.level_id, CAST(l.level_price AS DOUBLE) AS level_price, l.level_type, CAST(l.level_price AS DOUBLE) * (1 - 0.0015) AS lower, CAST(l.level_price AS DOUBLE) * (1 + 0.0015) AS upper,
  CASE WHEN last_price < CAST(l.level_price AS DOUBLE) * (1 - 0.0015) THEN -1 WHEN last_price > CAST(l.level_price AS DOUBLE) * (1 + 0.0015) THEN 1 ELSE 0 END AS pos,
  (abs(s.ema9 - s.ema20) + abs(s.ema20 - s.ema30)) / s.atr AS ci, g.n AS big_n, g.lb, g.ls, g.lb - g.ls AS big_delta
  FROM stream s JOIN levels l USING ({_K}) JOIN large g USING ({_K}, ts_ms) WHERE last_price IS NOT NULL""",
    "ltn": f"SELECT *, row_number() OVER ({_W}) AS rn, lag(pos) OVER ({_W}) AS bpos FROM lt",
    "tl": """SELECT *, rn > 1 AND ((low_10s <= upper AND last_price > upper) OR (high_10s >= lower AND last_price < lower)) AS wick FROM ltn""",
    "tle": """SELECT *, CASE WHEN wick THEN 'touch' WHEN rn > 1 AND bpos <> pos AND bpos = 0 THEN CASE WHEN (level_type = 'support') = (pos < 0) THEN 'break' ELSE 'reject' END WHEN rn > 1 AND bpos <> pos THEN 'touch' END AS event,
  CASE WHEN wick THEN CASE WHEN last_price > upper THEN 'above' ELSE 'below' END WHEN rn > 1 AND bpos <> pos AND bpos <> 0 THEN CASE WHEN bpos > 0 THEN 'above' ELSE 'below' END END AS from_side,
  CASE WHEN NOT wick AND rn > 1 AND bpos <> pos AND pos <> 0 THEN CASE WHEN pos > 0 THEN 'above' ELSE 'below' END END AS to_side, NOT wick AND rn > 1 AND bpos <> pos AND bpos <> 0 AND pos <> 0 AS cross_through FROM tl""",
    "tlr": f"""SELECT *, event IS NOT NULL AND event = 'touch' AND last_value(CASE WHEN event = 'break' THEN to_side END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT NULL AS reclaim_attempt FROM tle""",
    "pk": f"""SELECT *, coalesce(sum(delta) OVER e, 0.0) AS ad, abs(last_price - coalesce(lag(last_price, 6) OVER ({_W}), first_value(last_price) OVER ({_W}))) / avg(atr) OVER e AS speed,
  sum(delta) OVER t3 AS d30, sum(delta) OVER m AS d60, avg(relative_aggression) OVER t3 AS a30,
  (coalesce(min(CASE WHEN pos <> 0 THEN rn END) OVER z, rn + count(*) OVER z) - rn) * 10.0 AS dwell,
  (coalesce(lead(last_price, 3) OVER ({_W}), last_value(last_price) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - last_price) / last_price AS b30,
  (coalesce(lead(last_price, 6) OVER ({_W}), last_value(last_price) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - last_price) / last_price AS b60,
  min(last_price) OVER m AS low60, (total_volume - avg(total_volume) OVER (PARTITION BY {_L})) / (stddev_samp(total_volume) OVER (PARTITION BY {_L}) + 1e-9) AS vz,
  min(last_price) OVER t3 >= lower AS held, max(last_price) OVER t3 < lower AS under, sum(big_n) OVER t3 AS n30, sum(lb) OVER t3 AS lb30, sum(ls) OVER t3 AS ls30, sum(big_delta) OVER t3 AS ld30, list(ci) OVER e AS cis, sum(big_n) OVER e AS ln, avg(spread_pct) OVER t3 AS spost, avg(spread_pct) OVER (PARTITION BY {_L}) AS sall, avg(spread_pct) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING) AS spre, sum(total_volume) OVER t3 AS v30, sum(delta) OVER ({_W} ROWS 5 PRECEDING) AS cvd
  FROM tlr WINDOW e AS ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), t3 AS ({_W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), m AS ({_W} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), z AS ({_W} ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)""",
    "nb": f"""SELECT *, min(CASE WHEN event = 'break' THEN ts_ms END) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS bts FROM pk""",
    "tp": f"""SELECT n.*, b.under AS bunder, coalesce(b.under AND n.bts - n.ts_ms <= 120000, false) AS conf, row_number() OVER (PARTITION BY n.symbol, n.session_id, n.level_id ORDER BY n.ts_ms) AS tn,
  b.nts IS NOT NULL AS again, b.nheld FROM nb n LEFT JOIN (SELECT {_L}, ts_ms, under, first(nt ORDER BY nt) AS nts, first(nh ORDER BY nt) AS nheld FROM (
    SELECT x.symbol, x.session_id, x.level_id, x.ts_ms, x.under, y.ts_ms AS nt, y.held AS nh FROM pk x LEFT JOIN pk y ON x.symbol = y.symbol AND x.session_id = y.session_id AND x.level_id = y.level_id AND y.event = 'touch' AND y.ts_ms > x.ts_ms WHERE x.event = 'break') GROUP BY ALL) b
  ON b.symbol = n.symbol AND b.session_id = n.session_id AND b.level_id = n.level_id AND b.ts_ms = n.bts WHERE n.event = 'touch'""",
    "strm": f"""SELECT *, (abs(ema9 - ema20) + abs(ema20 - ema30)) / atr AS ci, CASE WHEN atr IS NOT NULL THEN greatest(0.0, least(1.0, 1 - (abs(ema9 - ema20) + abs(ema20 - ema30)) / atr / 0.25)) END AS conf,
  greatest(0.0, -delta) / (abs(coalesce(last_price - lag(last_price) OVER ({_S}), 0.0)) + 1e-9) AS absn FROM stream""",
    "et": f"""SELECT e.symbol, e.session_id, e.level_id, e.entry, e.above, e.entry - 300000 AS st, z.ts_ms, z.da, z.width, z.last_price, z.atr, x.absn, x.spread_pct, x.ci, x.conf, f.delta, f.total_volume, f.trade_count, f.buy_volume, f.sell_volume, e.why,
  CASE WHEN z.ts_ms < e.entry THEN 'baseline' WHEN e.exit_ts IS NULL OR z.ts_ms <= e.exit_ts THEN 'stress' ELSE 'resolution' END AS phase
  FROM eps e JOIN zev z ON z.symbol = e.symbol AND z.session_id = e.session_id AND z.level_id = e.level_id AND z.ts_ms BETWEEN e.entry - 300000 AND e.res JOIN (SELECT *, buy_volume - sell_volume AS delta FROM flow) f ON f.symbol = z.symbol AND f.session_id = z.session_id AND f.ts_ms = z.ts_ms
  JOIN strm x ON x.symbol = z.symbol AND x.session_id = z.session_id AND x.ts_ms = z.ts_ms""",
    "mk": """SELECT 'm' || seq AS marker_id, symbol, session_id, ts_ms, ['consolidation', 'support_bounce', 'breakdown', 'downtrend_break'][CAST(seq % 4 + 1 AS INT)] AS marker_type FROM tape WHERE event_type = 'signup'""",
}
CTES |= {
    "tpc": """SELECT *, list_avg(cis) AS comp, list_avg(cis[greatest(len(cis) - 2, 1):len(cis)]) - list_avg(cis[1:3]) AS chg FROM tp""",
    "tpx": """SELECT * REPLACE (d30 * 1000 AS d30, ld30 * 1000 AS ld30, lb30 * 1000 AS lb30, ls30 * 1000 AS ls30), CASE WHEN lb30 + ls30 > 0 THEN lb30 / (lb30 + ls30) END AS ratio, coalesce(n30 >= 5 AND CASE WHEN lb30 + ls30 > 0 THEN lb30 / (lb30 + ls30) END > 0.6, false) AS ib, coalesce(n30 >= 5 AND CASE WHEN lb30 + ls30 > 0 THEN lb30 / (lb30 + ls30) END < 0.4, false) AS isell,
  CASE WHEN NOT conf THEN 'hold' WHEN again AND nheld THEN 'break_reclaim_hold' WHEN again THEN 'break_reclaim_fail' ELSE 'break' END AS outcome, sign(ad) * sign(d30) < 0 AS flip, ad < 0 AND d30 > 0 AS div FROM tpc""",
    "pts": """SELECT *, greatest(-20, least(20, CAST(round_even(greatest(-6.0, least(6.0, asinh(d30 / 50000.0) * 4)), 0) AS INT)
  + CASE WHEN a30 >= 0.2 THEN 3 WHEN a30 <= -0.2 THEN -3 WHEN a30 >= 0.05 THEN 1 WHEN a30 <= -0.05 THEN -1 ELSE 0 END
  + CASE WHEN b30 >= 0.02 THEN 6 WHEN b30 >= 0.01 THEN 3 WHEN b30 >= 0.005 THEN 1 WHEN b30 <= -0.01 THEN -6 WHEN b30 <= -0.005 THEN -2 ELSE 0 END
  + CASE WHEN ratio >= 0.55 THEN 3 + CASE WHEN a30 > 0 THEN 4 ELSE 0 END ELSE 0 END + CASE WHEN ld30 >= 20000 THEN 3 WHEN ld30 <= -20000 THEN -4 ELSE 0 END + CASE WHEN n30 >= 50 THEN 3 WHEN n30 >= 20 THEN 2 ELSE 0 END
  + CASE WHEN ib THEN 4 ELSE 0 END + CASE WHEN isell THEN -6 ELSE 0 END + CASE WHEN isell AND b30 > 0 THEN 8 WHEN isell AND b30 < 0 THEN -3 ELSE 0 END + CASE WHEN conf AND again AND nheld THEN -2 WHEN conf THEN -8 ELSE 0 END
  + CASE WHEN comp >= 1 THEN 3 WHEN comp >= 0.8 THEN 2 WHEN comp < 0.5 THEN -1 ELSE 0 END + CASE WHEN chg > 0.05 THEN 1 WHEN chg < -0.05 THEN -1 ELSE 0 END
  + CASE WHEN level_type = 'support' AND lower > low60 AND b30 * last_price + last_price >= lower - 1e-9 THEN 2 ELSE 0 END + CASE WHEN dwell <= 20 AND b30 > 0 THEN 1 ELSE 0 END + CASE WHEN n30 < 10 AND ratio >= 0.55 THEN -2 ELSE 0 END)) AS score FROM tpx""",
    "bucketed": "SELECT *, greatest(1, least(10, CAST(round_even((score + 20) / 40.0 * 9 + 1, 0) AS INT))) AS bucket FROM pts",
    "stats": f"""SELECT {_L}, count(*) AS touches, count(*) FILTER (outcome = 'hold') / count(*) AS hold_rate, count(*) FILTER (outcome IN ('break', 'break_reclaim_fail')) AS breaks, round_even(count(*) FILTER (flip) / count(*), 3) AS flip_rate, avg(comp) AS compression_mean, quantile_cont(comp, 0.5) AS compression_median,
  round_even(max(comp), 3) AS compression_max, avg(b30) AS bounce_mean, quantile_cont(b30, 0.5) AS bounce_median, round_even(avg(CAST(b30 > 0 AS INT)), 3) AS positive_bounce_rate, round_even(avg(CAST(a30 > 0 AS INT)), 3) AS aggression_rate,
  list(round(b30, 6) ORDER BY b30 DESC, ts_ms)[1:3] AS best FROM tpx GROUP BY ALL""",
    "statsq": """SELECT *, CASE WHEN (touches <= 3 AND hold_rate >= 0.8) OR (touches <= 7 AND hold_rate >= 0.7 AND coalesce(positive_bounce_rate, 0) >= 0.6) THEN 'strong' WHEN touches > 10 AND (breaks >= 2 OR coalesce(positive_bounce_rate, 0) < 0.5) THEN 'exhausted' WHEN hold_rate >= 0.6 THEN 'moderate' ELSE 'weak' END AS quality FROM stats""",
}
CTES |= {
    "mins": f"""SELECT m.*, buy - sell AS delta, CASE WHEN buy > 1.1 * sell THEN 'buyers' WHEN sell > 1.1 * buy THEN 'sellers' ELSE 'even' END AS winner FROM (
    SELECT t.*, coalesce(b, 0.0) AS buy, coalesce(s, 0.0) AS sell FROM (SELECT {_L}, ts_ms - ts_ms % 60000 AS minute_ts, count(*) AS touches, count(*) FILTER (ib) AS nb, count(*) FILTER (isell) AS ns FROM tpx GROUP BY ALL) t
    LEFT JOIN (SELECT {_K}, ts_ms - ts_ms % 60000 AS minute_ts, sum(buy_volume) * 1000 AS b, sum(sell_volume) * 1000 AS s FROM flow GROUP BY ALL) USING ({_K}, minute_ts)) m""",
    "minsw": f"""SELECT *, CASE WHEN buy > 1.1 * lag(buy) OVER w THEN 1 ELSE 0 END AS faster, coalesce(lead(sell) OVER w > 1.2 * lead(buy) OVER w, false) AS a FROM mins WINDOW w AS (PARTITION BY {_L} ORDER BY minute_ts)""",
    "dumpx": f"""SELECT *, coalesce(sum(faster) OVER f, 0) AS accelerations, coalesce(sum(buy) OVER f, 0.0) AS recovery_buy, coalesce(sum(nb) OVER f, 0) AS lateb, coalesce(sum(ns) OVER f, 0) AS lates FROM minsw WINDOW f AS (PARTITION BY {_L} ORDER BY minute_ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""",
    "dumpr": """SELECT *, recovery_buy / sell AS ratio, recovery_buy < 0.30 * sell AS b FROM dumpx WHERE sell > 2 * buy AND sell > 20000""",
    "dumpy": """SELECT *, CASE WHEN a OR b THEN 0 ELSE CASE WHEN ratio >= 0.75 THEN 2 WHEN ratio >= 0.5 THEN 1 ELSE 0 END + CASE WHEN accelerations >= 2 THEN 2 WHEN accelerations >= 1 THEN 1 ELSE 0 END + CASE WHEN lateb >= 2 THEN 2 WHEN lateb >= 1 THEN 1 ELSE 0 END
  + CASE WHEN ns >= 1 AND lateb >= 1 AND lates = 0 THEN 2 ELSE 0 END END AS score FROM dumpr""",
    "washed": f"""SELECT {_L}, coalesce(dumps, 0) AS dumps, coalesce(ds, 0) + CASE WHEN lb > 1.2 * ls THEN 1 ELSE 0 END + CASE WHEN ln >= 1 THEN 1 ELSE 0 END AS score, stop, coalesce(absorbed, 0) AS absorbed, coalesce(failed, 0) AS failed
  FROM (SELECT {_L}, last(buy ORDER BY minute_ts) AS lb, last(sell ORDER BY minute_ts) AS ls, last(nb ORDER BY minute_ts) AS ln FROM mins GROUP BY ALL) LEFT JOIN (SELECT {_L}, count(*) AS dumps, sum(score) AS ds, last(CASE WHEN b THEN 'NO_BUYERS' ELSE 'BREAKDOWN_CONTINUES' END ORDER BY minute_ts) FILTER (a OR b) AS stop,
    count(*) FILTER (score >= 2) AS absorbed, count(*) FILTER (score < 2 AND NOT a AND NOT b) AS failed FROM dumpy GROUP BY ALL) USING ({_L})""",
    "ph": f"""SELECT {_L}, phase, count(*) AS touches, min(tn) AS first_touch, sum(lb30) AS buy, sum(ls30) AS sell, sum(lb30) - sum(ls30) AS delta, count(*) FILTER (ib) AS nb, count(*) FILTER (isell) AS ns, count(*) FILTER (isell AND b30 > 0) AS absorbed,
  CASE WHEN sum(lb30) - sum(ls30) > 0 THEN '+' WHEN sum(lb30) - sum(ls30) < 0 THEN '-' ELSE '=' END AS winner FROM (SELECT *, (tn - 1) // greatest(1, count(*) OVER (PARTITION BY {_L}) // 4) + 1 AS phase FROM tpx) GROUP BY {_L}, phase""",
}
_E = f"PARTITION BY {_L}, entry ORDER BY ts_ms"

CTES |= {
    "spine": f"""SELECT *, CASE WHEN sg IS NULL THEN NULL WHEN sg <> last_value(sg IGNORE NULLS) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS chg FROM (SELECT *, CASE WHEN da > 1e-12 THEN 1 WHEN da < -1e-12 THEN -1 END AS sg FROM et)""",
    "sm": f"""SELECT *, coalesce(avg(CASE WHEN phase = 'baseline' THEN v60 END) OVER ({_E}), 0.0) AS bm, coalesce(stddev_pop(CASE WHEN phase = 'baseline' THEN v60 END) OVER ({_E}), 0.0) AS bd, coalesce(avg(CASE WHEN phase = 'baseline' THEN n60 END) OVER ({_E}), 0.0) AS nm,
  coalesce(stddev_pop(CASE WHEN phase = 'baseline' THEN n60 END) OVER ({_E}), 0.0) AS nd, r60 / (atr + 1e-9) AS rn, row_number() OVER (PARTITION BY {_L}, entry, phase ORDER BY ts_ms) AS n FROM (SELECT *, sum(delta) OVER ({_E} ROWS 2 PRECEDING) AS c30, sum(delta) OVER s AS c60, sum(total_volume) OVER s AS v60,
    sum(trade_count) OVER s AS n60, coalesce(last_price - lag(last_price) OVER ({_E}), 0.0) AS r10, coalesce(last_price - lag(last_price, 6) OVER ({_E}), 0.0) AS r60, CASE WHEN total_volume > 0 THEN delta / (total_volume + 1e-9) ELSE 0.0 END AS ra FROM et WINDOW s AS ({_E} ROWS 5 PRECEDING))""",
    "smz": """SELECT *, CASE WHEN bm > 0 THEN c60 / (bm + 1e-9) ELSE 0.0 END AS dn, CASE WHEN bd > 0 THEN (v60 - bm) / (bd + 1e-9) ELSE 0.0 END AS vz, CASE WHEN nd > 0 THEN (n60 - nm) / (nd + 1e-9) ELSE 0.0 END AS tz,
  CASE WHEN r10 < 0 THEN buy_volume / (greatest(abs(r10), 0.02 * atr) + 1e-9) ELSE 0.0 END AS bor, CASE WHEN r10 > 0 THEN sell_volume / (greatest(abs(r10), 0.02 * atr) + 1e-9) ELSE 0.0 END AS sog FROM sm""",
    "smd": """SELECT *, CASE WHEN abs(rn) > 0 OR abs(dn) > 0 THEN abs(dn) / (abs(rn) + 1e-9) ELSE 0.0 END AS ds, CASE WHEN CASE WHEN dn > 1e-12 THEN 1 WHEN dn < -1e-12 THEN -1 ELSE 0 END <> CASE WHEN rn > 1e-12 THEN 1 WHEN rn < -1e-12 THEN -1 ELSE 0 END THEN 1 ELSE 0 END AS df FROM smz""",
    "feat": f"""SELECT {_L}, entry, why, phase, n, unnest(['delta', 'cvd_60s', 'cvd_30s', 'relative_aggression', 'absorption_index', 'divergence_score', 'buy_on_red', 'sell_on_green', 'spread_pct', 'signed_distance_atr', 'vol_zscore', 'trade_zscore', 'compression_index', 'ema_confluence_score']) AS feature,
  unnest([delta, c60, c30, ra, absn, ds, bor, sog, spread_pct, da, vz, tz, ci, conf]) AS x FROM smd""",
    "shift": f"SELECT {_L}, entry, why, feature, avg(x) FILTER (phase = 'stress') - avg(x) FILTER (phase = 'baseline') AS change FROM feat WHERE phase = 'baseline' OR (phase = 'stress' AND n <= 6) GROUP BY ALL",
    "shifty": "SELECT *, CASE WHEN feature IN ('absorption_index', 'divergence_score', 'buy_on_red', 'sell_on_green') THEN asinh(change) ELSE change END AS y FROM shift WHERE change IS NOT NULL",
    "ranked": """SELECT feature, count(*) FILTER (why = 'threshold_hit') AS wins, count(*) FILTER (why = 'invalidation') AS losses, avg(change) FILTER (why = 'threshold_hit') AS win_mean, avg(change) FILTER (why = 'invalidation') AS loss_mean, avg(y) FILTER (why = 'threshold_hit') - avg(y) FILTER (why = 'invalidation') AS apart,
  sqrt((pow(stddev_pop(y) FILTER (why = 'threshold_hit'), 2) + pow(stddev_pop(y) FILTER (why = 'invalidation'), 2)) / 2) AS pooled FROM shifty GROUP BY feature""",
    "mep": """SELECT m.*, CASE marker_type WHEN 'breakdown' THEN 'short' ELSE 'long' END AS bias, coalesce(p.last_price, f.last_price) AS lp, coalesce(p.atr, f.atr) AS la FROM mk m
  ASOF LEFT JOIN (SELECT * FROM state WHERE last_price IS NOT NULL AND atr > 0) p ON p.symbol = m.symbol AND p.session_id = m.session_id AND m.ts_ms >= p.ts_ms
  LEFT JOIN (SELECT symbol, session_id, first(last_price ORDER BY ts_ms) AS last_price, first(atr ORDER BY ts_ms) AS atr FROM state WHERE last_price IS NOT NULL AND atr > 0 GROUP BY ALL) f ON f.symbol = m.symbol AND f.session_id = m.session_id""",
    "mtick": """SELECT m.*, s.ts_ms AS t, (s.last_price - lp) / la * CASE bias WHEN 'short' THEN -1 ELSE 1 END AS mv FROM mep m JOIN state s ON s.symbol = m.symbol AND s.session_id = m.session_id AND s.ts_ms BETWEEN m.ts_ms - 120000 AND m.ts_ms + 600000 WHERE s.last_price IS NOT NULL AND s.atr > 0""",
    "mres": """SELECT *, CASE WHEN t < ts_ms + 120000 THEN NULL WHEN t >= ts_ms + 600000 THEN 'timeout' WHEN mv >= 0.5 THEN 'threshold_hit' WHEN mv <= -0.35 THEN 'invalidation' END AS why FROM mtick""",
    "mend": "SELECT marker_id, min(t) AS res, first(why ORDER BY t) AS trig FROM mres WHERE why IS NOT NULL GROUP BY ALL",
}
FINALS = {
    "feature_ranking": "SELECT feature, wins, losses, round(asinh(win_mean), 4) AS win_mean, round(asinh(loss_mean), 4) AS loss_mean, round(CASE WHEN pooled > 0 THEN apart / (pooled + 1e-12) ELSE 0.0 END, 4) AS effect FROM ranked WHERE wins >= 2 AND losses >= 2",
    "episode_snapshots": f"SELECT {_L}, entry AS zone_entry_time, ts_ms, phase, round(max(CASE WHEN above THEN greatest(0.0, -da) ELSE greatest(0.0, da) END) OVER ({_E} ROWS UNBOUNDED PRECEDING), 6) AS max_penetration_atr, CAST(coalesce(sum(chg) OVER m - first_value(chg IGNORE NULLS) OVER m, 0) AS BIGINT) AS cross_count_60s, round(max(da) OVER m - min(da) OVER m, 6) AS oscillation_amplitude_60s, sum(CASE WHEN abs(da) <= width THEN 10.0 ELSE 0.0 END) OVER m AS time_in_zone_60s, sum(CASE WHEN abs(da) <= width THEN 10.0 ELSE 0.0 END) OVER ({_E} ROWS UNBOUNDED PRECEDING) AS time_in_zone_total FROM spine WINDOW m AS ({_E} RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW)",
    "marker_episodes": f"SELECT marker_id, {_K}, marker_type, bias AS direction_bias, lp AS level_price, any_value(res) AS resolution_time, any_value(trig) AS resolution_trigger, round(greatest(0.0, max(mv)), 6) AS mfe, round(greatest(0.0, -min(mv)), 6) AS mae FROM mres LEFT JOIN mend USING (marker_id) WHERE res IS NULL OR t <= res GROUP BY marker_id, {_K}, marker_type, bias, lp",
    "touch_score": f"SELECT {_L}, ts_ms, CAST(score AS BIGINT) AS score, CAST(bucket AS BIGINT) AS bucket, CASE WHEN bucket <= 1 THEN 'STRONG_SELL' WHEN bucket <= 3 THEN 'SELL' WHEN bucket <= 4 THEN 'CAUTION' WHEN bucket <= 6 THEN 'NEUTRAL' WHEN bucket <= 8 THEN 'BUY' ELSE 'STRONG_BUY' END AS label FROM bucketed",
    "level_stats": f"SELECT {_L}, touches, breaks, quality, {r('hold_rate', 'flip_rate', 'compression_mean', 'compression_median', 'compression_max', 'bounce_mean', 'bounce_median', 'positive_bounce_rate', 'aggression_rate')}, array_to_string(list_transform(best, lambda x: printf('%.4f', x * 100)), ' ') AS best FROM statsq",
    "level_flags": f"SELECT {_L}, concat_ws(',', CASE WHEN compression_max >= 1 THEN 'compression' END, CASE WHEN positive_bounce_rate >= 0.6 THEN 'bounces' END, CASE WHEN flip_rate >= 0.5 THEN 'flips' END, CASE WHEN aggression_rate >= 0.6 THEN 'aggression' END, CASE WHEN quality = 'strong' THEN 'quality' END) AS green, concat_ws(',', CASE WHEN compression_max < 0.5 THEN 'compression' END, CASE WHEN positive_bounce_rate < 0.5 THEN 'bounces' END, CASE WHEN aggression_rate < 0.4 THEN 'aggression' END, CASE WHEN touches > 10 THEN 'touches' END, CASE WHEN breaks >= 2 THEN 'breaks' END, CASE WHEN quality IN ('exhausted', 'weak') THEN 'quality' END) AS red FROM statsq",
    "phases": f"SELECT {_L}, CAST(phase AS BIGINT) AS phase, touches, first_touch, buy, sell, delta, nb AS inst_buy, ns AS inst_sell, absorbed, winner FROM ph",
    "interaction_timeline": f"SELECT {_L}, ts_ms, event, from_side, to_side, wick AS wick_touch, cross_through, reclaim_attempt FROM tlr WHERE event IS NOT NULL",
    "timeline_summary": f"SELECT {_L}, count(*) FILTER (event = 'touch') AS touches, count(*) FILTER (event = 'break') AS breaks, count(*) FILTER (event = 'reject') AS rejects, count(*) FILTER (reclaim_attempt) AS reclaim_attempts, count(*) FILTER (cross_through) AS cross_throughs, count(*) AS events FROM tlr WHERE event IS NOT NULL GROUP BY ALL",
    "role_flip": f"SELECT {_L}, bool_or(flip) AS role_flip FROM (SELECT {_L}, coalesce(event = 'reject', false) AND coalesce(max(CASE WHEN event = 'break' THEN 1 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS flip FROM tlr) GROUP BY ALL",
    "session_wide": f"SELECT {_K}, count(*) AS points, (max(ts_ms) - min(ts_ms)) / 1000.0 AS duration_s, CAST(sum(trade_count) AS BIGINT) AS trades, sum(total_volume) AS volume, sum(buy_volume) AS buy_volume, sum(sell_volume) AS sell_volume, sum(unknown_volume) AS unknown_volume, sum(delta) AS delta, {r('relative_aggression_mean=avg(relative_aggression)', 'spread_pct_mean=avg(spread_pct)', 'compression_mean=avg(ci)', 'confluence_mean=avg(conf)', 'atr_mean=avg(atr)', 'absorption_mean_asinh=avg(asinh(absn))', 'price_first=first(last_price ORDER BY ts_ms)', 'price_last=last(last_price ORDER BY ts_ms)')}, min(last_price) AS price_min, max(last_price) AS price_max, {r('return_abs=last(last_price ORDER BY ts_ms) - first(last_price ORDER BY ts_ms)', 'return_pct=(last(last_price ORDER BY ts_ms) - first(last_price ORDER BY ts_ms)) / first(last_price ORDER BY ts_ms)')} FROM strm WHERE last_price IS NOT NULL GROUP BY ALL",
    "band_summary": f"SELECT {_L}, count(*) FILTER (pos = 0) * 10.0 AS time_in_band_s, coalesce(sum(total_volume) FILTER (pos = 0), 0.0) AS band_volume, coalesce(sum(delta) FILTER (pos = 0), 0.0) AS band_delta, count(*) FILTER (pos = 0 AND coalesce(bpos, 1) <> 0) AS touch_count, count(*) FILTER (side <> 0 AND bside <> 0 AND side <> bside) AS cross_count, count(*) FILTER (pos = 0 AND bpos = bad) AS reclaim_attempts, count(*) FILTER (pos = 0 AND bpos = bad AND hold) AS reclaim_holds_30s, CAST(coalesce(sum(big_n) FILTER (pos = 0), 0) AS BIGINT) AS band_large_count, coalesce(sum(lb - ls) FILTER (pos = 0), 0.0) AS band_large_delta, round(CASE WHEN sum(lb + ls) FILTER (pos = 0) > 0 THEN sum(lb) FILTER (pos = 0) / sum(lb + ls) FILTER (pos = 0) END, 6) AS band_large_buy_ratio, round(CASE WHEN count(*) FILTER (pos = 0 AND bpos = bad) > 0 THEN count(*) FILTER (pos = 0 AND bpos = bad AND hold) / count(*) FILTER (pos = 0 AND bpos = bad) END, 6) AS reclaim_hold_rate FROM (SELECT *, lag(side) OVER ({_W}) AS bside, max(abs(pos)) OVER h = 0 AND count(*) OVER h = 3 AS hold FROM (SELECT *, CASE WHEN last_price > level_price THEN 1 WHEN last_price < level_price THEN -1 ELSE 0 END AS side, CASE WHEN level_type = 'support' THEN -1 ELSE 1 END AS bad FROM ltn) WINDOW h AS ({_W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) GROUP BY ALL",
    "touch_packets": f"SELECT {_L}, ts_ms, tn AS touch_number, CASE WHEN speed >= 1.5 THEN 'crash' WHEN speed >= 0.75 THEN 'fast' WHEN speed >= 0.25 THEN 'normal' WHEN speed IS NOT NULL THEN 'grind' END AS approach_type, sign(ad) * sign(d30) < 0 AS delta_flip_flag, CASE WHEN level_type = 'support' THEN lower > low60 AND b30 * last_price + last_price >= lower - 1e-9 END AS wick_recovered_flag, {r('approach_delta_60s=ad', 'approach_velocity_atr_per_min=speed', 'band_delta_0_30s=d30', 'band_delta_0_60s=d60', 'rel_aggr_0_30s=a30', 'touch_dwell_s=dwell', 'bounce_return_30s_pct=b30', 'bounce_return_60s_pct=b60', 'touch_volume_z=vz')}, round(CASE WHEN level_type = 'support' THEN (lower - low60) / level_price END, 6) AS max_penetration_pct FROM tp",
    "touch_outcome": f"SELECT {_L}, ts_ms, conf AS break_confirmed_30s, CASE WHEN conf THEN again END AS reclaim_after_break, CASE WHEN conf AND again THEN nheld END AS reclaim_hold_30s, CASE WHEN NOT conf THEN 'hold' WHEN again AND nheld THEN 'break_reclaim_hold' WHEN again THEN 'break_reclaim_fail' ELSE 'break' END AS touch_outcome FROM tp",
    "gap_phases": f"SELECT {_L}, CAST(phase_id AS BIGINT) AS phase_id, count(*) AS touches, min(ts_ms) AS start_ts_ms FROM (SELECT *, sum(fresh) OVER ({_W}) AS phase_id FROM (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER ({_W}) <= 180000 THEN 0 ELSE 1 END AS fresh FROM tp)) GROUP BY ALL",
    "minute_breakdown": f"SELECT {_L}, minute_ts, touches, nb AS inst_buy, ns AS inst_sell, buy, sell, winner, delta FROM mins",
    "wash_dumps": f"SELECT {_L}, minute_ts, buy, sell, recovery_buy, CAST(accelerations AS BIGINT) AS accelerations, CAST(lateb AS BIGINT) AS late_buy, {r('recovery_ratio=ratio')}, a AS hard_stop_a, b AS hard_stop_b, CAST(score AS BIGINT) AS score, score >= 2 AS absorbed FROM dumpy",
    "wash_verdict": f"SELECT {_L}, dumps, CAST(score AS BIGINT) AS score, stop AS hard_stop, absorbed, failed, CASE WHEN stop IS NOT NULL THEN 'HARD_STOP' WHEN score >= 5 THEN 'STRONG_WASH' WHEN score >= 3 THEN 'DECENT_WASH' WHEN score >= 1 THEN 'WEAK_WASH' ELSE 'NO_WASH' END AS verdict FROM washed",
    "cvd": f"SELECT {_L}, entry AS zone_entry_time, ts_ms, delta AS cvd_10s, c30 AS cvd_30s, c60 AS cvd_60s, coalesce(c30 - lag(c30) OVER ({_E}), 0.0) AS cvd_30s_slope, coalesce(c60 - lag(c60) OVER ({_E}), 0.0) AS cvd_60s_slope, v60 AS volume_60s, CAST(n60 AS BIGINT) AS trade_count_60s, round(coalesce(last_price - lag(last_price) OVER ({_E}), 0.0), 6) AS price_return_10s, round(r60, 6) AS price_return_60s, round(r60 / (atr + 1e-9), 6) AS return_norm, round(bm, 6) AS baseline_vol_mean, round(CASE WHEN bm > 0 THEN c60 / (bm + 1e-9) ELSE 0.0 END, 6) AS delta_norm FROM (SELECT *, coalesce(avg(CASE WHEN phase = 'baseline' THEN v60 END) OVER ({_E}), 0.0) AS bm FROM (SELECT *, sum(delta) OVER ({_E} ROWS 2 PRECEDING) AS c30, sum(delta) OVER s AS c60, sum(total_volume) OVER s AS v60, sum(trade_count) OVER s AS n60, coalesce(last_price - lag(last_price, 6) OVER ({_E}), 0.0) AS r60 FROM et WINDOW s AS ({_E} ROWS 5 PRECEDING)))",
    "baseline_z": f"SELECT {_L}, entry AS zone_entry_time, ts_ms, round(bm, 4) AS baseline_vol_mean, round(vz, 4) AS vol_zscore, round(nm, 4) AS baseline_trade_mean, round(tz, 4) AS trade_zscore FROM smz",
    "divergence": f"SELECT {_L}, entry AS zone_entry_time, ts_ms, CAST(df AS BIGINT) AS divergence_flag, round(asinh(ds), 4) AS divergence_score, round(asinh(bor), 4) AS buy_on_red, round(asinh(sog), 4) AS sell_on_green FROM smd",
    "reports_index": f"SELECT {_K}, count(*) AS episodes, count(*) FILTER (why = 'threshold_hit') AS wins, count(*) FILTER (why = 'invalidation') AS losses, {r('mfe_p50=quantile_cont(mfe, 0.5)', 'mae_p90=quantile_cont(mae, 0.9)', "win_rate=count(*) FILTER (why = 'threshold_hit') / count(*) FILTER (why IN ('threshold_hit', 'invalidation'))")} FROM eps GROUP BY ALL",
    "level_tag": "SELECT marker_id, CAST(100.2 AS DOUBLE) AS price, 'support' AS kind, CAST(2 AS BIGINT) AS n_tags, ts_ms + 600000 AS end_ts_ms FROM mk",
    "marker_bias": "SELECT marker_id, CASE marker_type WHEN 'breakdown' THEN 'short' ELSE 'long' END AS bias FROM mk",
    "dq_counts": "SELECT session_id, count(*) AS rows, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, kind FROM (SELECT session_id, ts_ms, 'trades' AS kind FROM trades UNION ALL SELECT session_id, ts_ms, 'quotes' FROM quotes) GROUP BY session_id, kind",
    "dq_nulls": "SELECT 'last_price' AS column, round(avg(CAST(last_price IS NULL AS INT)), 6) AS null_rate FROM state UNION ALL SELECT 'ema9', round(avg(CAST(ema9 IS NULL AS INT)), 6) FROM state UNION ALL SELECT 'atr', round(avg(CAST(atr IS NULL AS INT)), 6) FROM state",
    "dq_dists": f"SELECT name AS column, {r('min=min(x)', 'max=max(x)', 'mean=avg(x)', 'p50=quantile_cont(x, 0.5)', 'p90=quantile_cont(x, 0.9)')} FROM (SELECT 'last_price' AS name, last_price AS x FROM state UNION ALL SELECT 'ema9', ema9 FROM state UNION ALL SELECT 'atr', atr FROM state) GROUP BY name",
    "dq_value_counts": "SELECT 'side' AS column, side AS value, count(*) AS n FROM sided GROUP BY ALL UNION ALL SELECT 'symbol', symbol, count(*) FROM sided GROUP BY ALL",
    "dq_cadence": f"SELECT {_L}, entry AS zone_entry_time, min(d) AS min, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.9) AS p90, max(d) AS max, round(avg(CAST(d = 10000 AS INT)), 6) AS regular, count(*) FILTER (d > 20000) AS gaps_20s, count(*) FILTER (d > 60000) AS gaps_60s FROM (SELECT {_L}, entry, ts_ms - lag(ts_ms) OVER ({_E}) AS d FROM et) WHERE d IS NOT NULL GROUP BY ALL",
    "dq_missing": f"SELECT DISTINCT {_K} FROM trades EXCEPT SELECT {_K} FROM eps WHERE why = 'timeout'",
    "max_drop": f"SELECT {_K}, max(high_10s) FILTER (a <= 6) AS first_high, min(low_10s) FILTER (a <= 6) AS first_low, max(high_10s) FILTER (z <= 6) AS last_high, min(low_10s) FILTER (z <= 6) AS last_low, max(last_price) AS peak, min(last_price) AS low, round((max(last_price) - min(last_price)) / max(last_price) * 100, 6) AS drop_pct FROM (SELECT *, row_number() OVER ({_S}) AS a, row_number() OVER (PARTITION BY {_K} ORDER BY ts_ms DESC) AS z FROM stream WHERE last_price IS NOT NULL) GROUP BY ALL",
    "sink_partitioned": "SELECT strftime(make_timestamp(ts_ms * 1000) - INTERVAL 5 HOUR, '%Y-%m-%d') AS date, symbol AS ticker, session_id AS session, count(*) AS rows, CAST(sum(trade_count) AS BIGINT) AS trades FROM flow GROUP BY ALL",
    "sink_replace_session": "SELECT symbol AS ticker, session_id AS session, count(*) AS rows, CAST(sum(trade_count * CASE WHEN symbol = 'S0' THEN 2 ELSE 1 END) AS BIGINT) AS trades FROM flow GROUP BY ALL",
    "sink_published": f"SELECT symbol AS ticker, session_id AS session, count(*) AS rows, CAST(sum(trade_count) * any_value(CASE symbol WHEN 'S0' THEN 2 ELSE 1 END) AS BIGINT) AS trades, coalesce(any_value(n), 0) * any_value(CASE symbol WHEN 'S0' THEN 2 ELSE 1 END) AS events FROM flow LEFT JOIN (SELECT {_K}, count(*) AS n FROM zev WHERE event IS NOT NULL GROUP BY ALL) USING ({_K}) GROUP BY {_K}",
    "list_sessions": "SELECT DISTINCT strftime(make_timestamp(ts_ms * 1000) - INTERVAL 5 HOUR, '%Y-%m-%d') AS date, symbol AS ticker, session_id AS session FROM flow",
}
FINALS |= {
    "st_bars": "SELECT symbol, bar_ts, open, high, low, close, volume, trade_count FROM bars WHERE tf = '1m'",
    "st_engine": f"SELECT {_K}, ts_ms, round(last_price, 6) AS last_price, trade_count, total_volume, buy_volume, sell_volume, unknown_volume, {r('ema9', 'atr')} FROM state JOIN flow USING ({_K}, ts_ms)",
    "st_sink": "SELECT symbol AS ticker, session_id AS session, count(*) AS n, count(DISTINCT seq) AS n_different, sum(size) AS size FROM trades GROUP BY ALL",
    "st_watermark": "SELECT seq, symbol, ts_ms, (SELECT count(*) FROM trades) AS on_time FROM trades WHERE seq % 50 = 7 AND ts_ms < (SELECT min(ts_ms) + (max(ts_ms) + 1 - min(ts_ms)) // 4 FROM trades)",
    "st_zones": f"SELECT {_L}, ts_ms, event FROM zev WHERE event IS NOT NULL",
    "st_episodes": f"SELECT {_L}, entry AS zone_entry_time, exit_ts AS zone_exit_time, res AS resolution_time, why AS resolution_trigger, CASE WHEN above THEN 'above' ELSE 'below' END AS level_entry_side, CASE why WHEN 'threshold_hit' THEN 'win' WHEN 'invalidation' THEN 'loss' ELSE 'scratch' END AS outcome, {r('mfe', 'mae')}, mfe_ms AS time_to_mfe_ms, fail_ms AS time_to_failure_ms FROM eps",
    "st_parity": f"SELECT {_K}, count(*) AS live, count(*) AS batch, count(*) AS equal FROM grid GROUP BY ALL",
    "st_source": "SELECT seq, symbol, ts_ms, price, size FROM trades WHERE size > 0",
    "st_flow": "SELECT symbol, ts_ms, trade_count, total_volume, buy_volume, sell_volume, unknown_volume FROM flow WHERE trade_count > 0",
    "st_phases": "SELECT symbol, min(ts_ms) AS start_ts_ms, count(*) AS touches FROM (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts_ms, level_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT symbol, ts_ms, level_id, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms, level_id) <= 180000 THEN 0 ELSE 1 END AS fresh FROM tp)) GROUP BY symbol, run",
    "st_threshold": "SELECT symbol, tick AS ts_ms, quantile_disc(size, 0.95) AS threshold FROM (SELECT symbol, size, unnest(generate_series(ts_ms - ts_ms % 10000 + 9999, ts_ms - ts_ms % 10000 + 299999, 10000)) AS tick FROM trades WHERE size > 0) GROUP BY symbol, tick",
}
ORACLES = {name: sql(final) for name, final in FINALS.items()}
