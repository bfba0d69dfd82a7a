"""A live tape by session, tick by tick: all that the batch knows of a tick, of zones and of episodes.

Every session's state is typed and lives in the state store: events that aren't final yet,
what is carried along a session (quote, side, price, VWAP, bars and averages), the last five
minutes of ticks and trade sizes, and each level's zone and open episode. Events and trade sizes
are many, so they come to the engine and are kept as blocks, by column, not as a row each. Events are final
once the watermark has passed the end of their tick; ones that come later than that are late.
A tick without events is emitted with the next event that becomes final, or, with ``ahead_ms``,
by a timer as long as its session has been idle no longer than that. What a tick shows doesn't
depend on when it is emitted. Only the tape's history is evicted, after five minutes; averages
and carried sides live until the exchange's day ends, whatever the pause.

Levels come as commands in the tape (kind 1) and count from the first tick that ends at or after
them; the first command of a level id counts.

The state store has to be RocksDB (``tape_stream.drain`` sees to it).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.expressions import DEAD_ZONE, EPS, EXCHANGE_ZONE, exchange_date, regular
from ..functions.sliding import window_ranks
from ..operators.bars import ATR_PERIOD, ATR_SEED, BLEND, PERIODS
from ..operators.ticks import CONFLUENCE_REF, TICK_MS
from ..operators.zones import BASELINE_MS, FAILURE_ATR, SUCCESS_ATR, TIMEOUT_MS
from ..schemas import KEY

QUOTE, COMMAND, TRADE = 0, 1, 2
EVENTS = "seq long, symbol string, ts_ms long, kind int, price double, size double, irregular boolean, bid double, ask double, level_id string, level_price double, level_type string, level_width_atr double"
#: What an engine is sent for a null: whole numbers with nulls would become floats in pandas. An unknown seq sorts last.
NO_SEQ, NO_KIND = 2**63 - 1, -1
#: Columns of a block of quotes and trades, as it is sent and as the state holds it.
_COLUMNS = {"seq": "<i8", "ts_ms": "<i8", "kind": "<i4", "irregular": "?", "price": "<f8", "size": "<f8", "bid": "<f8", "ask": "<f8"}
_BLOCK = ", ".join(f"{c} binary" for c in _COLUMNS)
#: Rows of a block, which is read and written at once.
BLOCK_ROWS = 100_000
_LEVEL_ADDED = "level_id string, level_price double, level_type string, level_width_atr double"
_COMMAND = "seq long, ts_ms long, " + _LEVEL_ADDED
#: Sides as the engine numbers them.
SIDES = {"buy": 1, "sell": -1, "unknown": 0}
WINDOW_MS, SHARE = 300_000, 0.95
#: Ticks that look back five minutes need.
HISTORY = WINDOW_MS // TICK_MS + 1

_NUMBERS = (
    "last_price vwap_session ema9 ema20 ema30 ema200 atr bid ask mid_price spread_abs spread_pct total_volume buy_volume sell_volume unknown_volume delta pct_at_ask pct_at_bid relative_aggression "
    "avg_trade_size trade_size_std top_decile_volume_share trade_size_cv large_trade_threshold_size large_buy_volume_10s large_sell_volume_10s large_unknown_volume_10s large_trade_delta large_trade_buy_ratio "
    "large_trade_share_of_total_vol_10s high_10s low_10s ema9_2m ema20_2m ema30_2m ema200_2m ema9_3m ema20_3m ema30_3m ema200_3m spread_volatility_60s spread_zscore relative_aggression_zscore_60s "
    "delta_velocity delta_acceleration absorption_index realized_vol_60s approach_return_60s slope_ema9_60s slope_ema20_60s slope_ema30_60s ema_spread_9_20 ema_spread_20_30 compression_index "
    "ema_confluence_score stretch_200_atr price_minus_vwap price_minus_vwap_atr"
).split()
_COUNTS = "sequence_id trade_count quote_age_ms large_trade_count_10s price_vs_emas".split()
_TEXTS = "atr_status stack_state vwap_state".split()
TICK_COLUMNS = [*_COUNTS, *_NUMBERS, *_TEXTS]
ZONE_COLUMNS = ["level_id", "event", "entry_side", "touch_count"]
EPISODE_COLUMNS = [
    "episode_id", "level_id", "level_price", "level_type", "level_width_atr", "level_entry_side", "start_time", "zone_entry_time", "zone_exit_time", "resolution_time", "resolution_trigger", "outcome",
    "direction_bias", "atr_value", "mfe", "mae", "time_to_mfe_ms", "time_to_failure_ms",
]
_TYPES = (
    {c: "double" for c in (*_NUMBERS, "level_price", "level_width_atr", "atr_value", "mfe", "mae")}
    | {c: "long" for c in (*_COUNTS, "touch_count", "start_time", "zone_entry_time", "zone_exit_time", "resolution_time", "time_to_mfe_ms", "time_to_failure_ms")}
    | {c: "string" for c in (*_TEXTS, *ZONE_COLUMNS[:3], "episode_id", "level_type", "level_entry_side", "resolution_trigger", "outcome", "direction_bias")}
)
_ALL = list(dict.fromkeys([*TICK_COLUMNS, *ZONE_COLUMNS, *EPISODE_COLUMNS]))
#: A row of the stream: a tick, a zone event, an episode or a late event (its seq as sequence_id), by ``kind``.
OUTPUT = "kind string, symbol string, session_id string, ts_ms long, " + ", ".join(f"{c} {_TYPES[c]}" for c in _ALL)

_CORE = "bid double, ask double, prev double, side string, price double, vwap double, money double, vwap_size double, tick long, ticks long, last long"
_BAR = "begin long, high double, low double, close double, n long, ema9 double, ema20 double, ema30 double, ema200 double, tr double, atr double, closed double"
#: What rolling features need of earlier ticks.
_RECENT = ("last_price", "spread_pct", "relative_aggression", "delta", "delta_velocity", "ema9", "ema20", "ema30")
_LEVEL = (
    "price double, type string, width double, created long, one boolean, two boolean, side string, touches long, open boolean, entry long, entry_atr double, exit long, most double, most_ts long, least double, fail_ts long"
)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def events(trades: DataFrame, quotes: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Trades, quotes and commands that add levels as one tape; at equal times quotes come first and trades last.

    A level that was there before its session (``created_ts_ms`` before the first event) comes with the first event.
    """
    columns = _names(EVENTS)
    q = quotes.select("seq", "symbol", "ts_ms", F.lit(QUOTE).alias("kind"), "bid", "ask")
    w = ~regular(F.col("conditions")) if "conditions" in trades.columns else F.lit(False)
    t = trades.select("seq", "symbol", "ts_ms", F.lit(TRADE).alias("kind"), "price", "size", w.alias("irregular"))
    out = q.unionByName(t, allowMissingColumns=True)
    if levels is not None:
        starts = trades.select(*KEY, "ts_ms").unionByName(quotes.select(*KEY, "ts_ms")).groupBy(*KEY).agg(F.min("ts_ms").alias("_start"))
        own = levels.join(starts, KEY).select(
            F.lit(None).cast("long").alias("seq"), "symbol", F.greatest("created_ts_ms", "_start").alias("ts_ms"), F.lit(COMMAND).alias("kind"), "level_id", F.col("level_price").cast("double").alias("level_price"), "level_type", "level_width_atr"
        )
        out = out.unionByName(own, allowMissingColumns=True)
    missing = [c for c in columns if c not in out.columns]
    types = dict(c.split() for c in EVENTS.split(", "))
    return out.withColumns({c: F.lit(None).cast(types[c]) for c in missing}).select(columns)


_PANDAS = {"double": "float64", "long": "Int64", "int": "Int64", "string": "object", "boolean": "boolean"}


Rows = dict[str, np.ndarray]


def _columns(block: Iterable[bytes]) -> Rows:
    return {c: np.frombuffer(x, kind) for (c, kind), x in zip(_COLUMNS.items(), block, strict=True)}


def _at(rows: Rows, which: np.ndarray | slice) -> Rows:
    return {c: x[which] for c, x in rows.items()}


def _tuples(df: pd.DataFrame) -> list[tuple]:
    return list(df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))


def _float(x) -> float:
    return math.nan if x is None else x


class Ticking(StatefulProcessor):
    """Keeps events until the watermark has passed their tick, and a timer for the next thing to do."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "block long", _BLOCK)
        self.commands = handle.getListState("commands", _COMMAND)
        self.clock = handle.getValueState("clock", "done long, due long, blocks long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._step(key, list(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.clock.exists() and self.clock.get()[1] > watermark:
            return  # new rows of this batch have done what the timer was for, and set another one
        yield from self._step(key, [], watermark)

    def _step(self, key: tuple, parts: list[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        done, due, blocks = self.clock.get() if self.clock.exists() else (-1, None, 0)
        held = list(self.commands.get()) if self.commands.exists() else []
        every, commands = [_columns(self.pending.getValue((k,))) for k in range(blocks)], [*held]
        for block in (x for part in parts for x in _tuples(part[[*_COLUMNS, *_names(_LEVEL_ADDED)]])):
            own, level = _columns(block[: len(_COLUMNS)]), block[len(_COLUMNS) :]
            if own["kind"][0] == COMMAND:
                commands.append((int(own["seq"][0]), int(own["ts_ms"][0]), *level))
            else:
                every.append(own)
        rows = {c: np.concatenate([x[c] for x in every]) if every else np.zeros(0, kind) for c, kind in _COLUMNS.items()}
        behind = rows["ts_ms"] <= done
        late = [*zip(rows["ts_ms"][behind].tolist(), rows["seq"][behind].tolist(), strict=True), *((c[1], c[0]) for c in commands if c[1] <= done)]
        if late:
            yield from self.late(key, late)
        boundary = max(done, (watermark + 1) // TICK_MS * TICK_MS - 1)
        ripe = ~behind & (rows["ts_ms"] <= boundary)
        final = _at(rows, ripe)
        yield from self.advance(key, _at(final, np.lexsort((final["seq"], final["kind"], final["ts_ms"]))), sorted((c for c in commands if done < c[1] <= boundary), key=lambda c: (c[1], c[0])), boundary)
        rest, waiting = _at(rows, ~behind & ~ripe), [c for c in commands if c[1] > boundary]
        n = self._hold(rest, blocks)
        if waiting:
            self.commands.put(waiting)
        elif held:
            self.commands.clear()
        begin = min([*([int(rest["ts_ms"].min())] if n else []), *(c[1] for c in waiting)], default=None)
        at = self.next_due(key, None if begin is None else begin // TICK_MS * TICK_MS + TICK_MS - 1, watermark)
        if due is not None and due != at and due > watermark:
            self.handle.deleteTimer(due)
        if at is None:
            self.clock.clear()
            return
        at = max(at, watermark + 1)
        self.clock.update((boundary, at, n))
        self.handle.registerTimer(at)

    def _hold(self, rest: Rows, before: int) -> int:
        """Put ``rest`` in place of the blocks that were there ``before``; returns how many blocks there are."""
        total = len(rest["ts_ms"])
        blocks = -(-total // BLOCK_ROWS)
        for k in range(blocks):
            own = _at(rest, slice(k * BLOCK_ROWS, (k + 1) * BLOCK_ROWS))
            self.pending.updateValue((k,), tuple(x.tobytes() for x in own.values()))
        for k in range(blocks, before):
            self.pending.removeKey((k,))
        return blocks

    def advance(self, key: tuple, final: Rows, commands: list[tuple], boundary: int) -> Iterator[pd.DataFrame]:
        """Work off final events and commands, each in order, up to the end of a tick."""
        raise NotImplementedError

    def late(self, key: tuple, behind: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        """Times and seqs of events of ticks that are done; they are left out."""
        return iter(())

    def next_due(self, key: tuple, pending: int | None, watermark: int) -> int | None:
        """When to act without a new event; None if the state is gone."""
        raise NotImplementedError


class Sizes:
    """Trade sizes of a window, kept by column."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.state = handle.getValueState("sizes", "ts_ms binary, size binary")

    def exists(self) -> bool:
        return self.state.exists()

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        ts, size = self.state.get() if self.state.exists() else (b"", b"")
        return np.frombuffer(ts, "<i8"), np.frombuffer(size, "<f8")

    def put(self, ts: np.ndarray, size: np.ndarray) -> None:
        if len(ts):
            self.state.update((ts.astype("<i8").tobytes(), size.astype("<f8").tobytes()))
        else:
            self.state.clear()

    def clear(self) -> None:
        self.state.clear()


def _rows_back(x: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` values up to each row, NaN before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)


def _moments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and population deviation of what isn't NaN among the last ``n`` rows."""
    w = _rows_back(x, n)
    there = ~np.isnan(w)
    count = there.sum(1)
    mean = np.where(count > 0, np.where(there, w, 0).sum(1) / np.maximum(count, 1), np.nan)
    return count, mean, np.sqrt(np.where(there, (w - mean[:, None]) ** 2, 0).sum(1) / np.maximum(count, 1))


def _before(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(0, len(x) - n)]])


class TapeEngine(Ticking):
    """The tape of a session, key (symbol, session_id)."""

    def __init__(self, ahead_ms: int = 0, bias: str = "long"):
        self.ahead_ms, self.bias = ahead_ms, bias

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.core = handle.getValueState("core", _CORE)
        self.bars = handle.getMapState("bars", "width long", _BAR)
        self.recent = handle.getListState("recent", ", ".join(f"{c} double" for c in _RECENT))
        self.sizes = Sizes(handle)
        self.levels = handle.getMapState("levels", "level_id string", _LEVEL)

    def late(self, key: tuple, behind: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        seqs = pd.array([None if seq == NO_SEQ else seq for _, seq in behind], "Int64")
        yield _shaped(key, "late", pd.DataFrame({"ts_ms": [ts for ts, _ in behind], "sequence_id": seqs}))

    @staticmethod
    def _day(session_id: str) -> tuple[int, int]:
        """When the regular hours of the session's day begin, and when the day ends."""
        day = pd.Timestamp(session_id[-10:])
        opens, ends = (x.tz_localize(EXCHANGE_ZONE) for x in (day + pd.Timedelta(hours=9, minutes=30), day + pd.Timedelta(days=1)))
        return opens.value // 1_000_000, ends.value // 1_000_000

    def next_due(self, key: tuple, pending: int | None, watermark: int) -> int | None:
        ends = self._day(key[1])[1]
        core = self.core.get() if self.core.exists() else None
        if watermark >= ends and pending is None:
            for s in (self.core, self.bars, self.recent, self.sizes, self.levels):
                s.clear()
            return None
        if pending is not None:
            return pending
        if core is None and not self.levels.exists():
            return None
        tick, last = (core[_names(_CORE).index(c)] for c in ("tick", "last")) if core is not None else (None, None)
        if self.ahead_ms and tick is not None and tick + TICK_MS <= last // TICK_MS * TICK_MS + TICK_MS - 1 + self.ahead_ms:
            return tick + TICK_MS
        return ends

    def advance(self, key: tuple, final: Rows, commands: list[tuple], boundary: int) -> Iterator[pd.DataFrame]:
        for _, ts, level_id, price, kind, width in commands:
            if not self.levels.containsKey((level_id,)):
                self.levels.updateValue((level_id,), (float(price), kind, 0.25 if width is None else float(width), ts, False, False, None, 0, False, None, None, None, None, None, None, None))
        s = dict(zip(_names(_CORE), self.core.get(), strict=True)) if self.core.exists() else dict.fromkeys(_names(_CORE)) | {"money": 0.0, "vwap_size": 0.0, "ticks": 0}
        if len(final["ts_ms"]):
            s["last"] = int(final["ts_ms"][-1])
        if s["last"] is None:
            return
        first = s["tick"] + TICK_MS if s["tick"] is not None else int(final["ts_ms"][0]) // TICK_MS * TICK_MS + TICK_MS - 1
        upto = min(boundary, s["last"] // TICK_MS * TICK_MS + TICK_MS - 1 + self.ahead_ms // TICK_MS * TICK_MS)
        grid = np.arange(first, upto + 1, TICK_MS)
        if not len(grid):
            return
        out = self._ticks(key, s, final, grid)
        s["tick"], s["ticks"] = int(grid[-1]), s["ticks"] + len(grid)
        self.core.update(tuple(None if isinstance(x, float) and math.isnan(x) else x for x in s.values()))
        yield _shaped(key, "tick", out)
        yield from self._zones(key, out)

    def _ticks(self, key: tuple, s: dict, final: Rows, grid: np.ndarray) -> pd.DataFrame:
        """Every column of the grid's ticks; ``s`` is carried on."""
        n, is_trade = len(grid), final["kind"] == TRADE
        q, t = _at(final, ~is_trade), _at(final, is_trade)
        ts, price, size, quote_ts = t["ts_ms"], t["price"], t["size"], q["ts_ms"]
        tick = (ts - (grid[0] - TICK_MS + 1)) // TICK_MS
        out: dict[str, np.ndarray] = {"ts_ms": grid, "sequence_id": s["ticks"] + np.arange(n)}
        # quotes: as of each trade, and the last one inside each tick
        at = np.cumsum(~is_trade)[is_trade] - 1
        bids, asks = q["bid"], q["ask"]
        bid, ask = (np.where(at >= 0, x[np.maximum(at, 0)] if len(x) else np.nan, _float(s[c])) for x, c in ((bids, "bid"), (asks, "ask")))
        q_tick = (quote_ts - (grid[0] - TICK_MS + 1)) // TICK_MS
        last_q = np.full(n, -1)
        last_q[q_tick] = np.arange(len(quote_ts))
        has = last_q >= 0
        for c, x in (("bid", bids), ("ask", asks)):
            out[c] = np.where(has, x[last_q] if len(x) else np.nan, np.nan)
        valid = (out["bid"] > 0) & (out["ask"] > 0)
        out["mid_price"] = np.where(valid, (out["bid"] + out["ask"]) / 2, np.nan)
        out["spread_abs"] = np.where(valid, out["ask"] - out["bid"], np.nan)
        out["spread_pct"] = out["spread_abs"] / out["mid_price"]
        out["quote_age_ms"] = np.where(has, grid - (quote_ts[last_q] if len(quote_ts) else 0), np.nan)
        if len(quote_ts):
            s["bid"], s["ask"] = float(bids[-1]), float(asks[-1])
        # sides and flow
        side = self._sides(s, price, bid, ask)
        volume = np.nan_to_num(size)
        out["trade_count"] = np.bincount(tick, minlength=n)
        out["total_volume"] = np.bincount(tick, volume, n)
        for k, number in SIDES.items():
            out[f"{k}_volume"] = np.bincount(tick, np.where(side == number, volume, 0.0), n)
        out["delta"] = out["buy_volume"] - out["sell_volume"]
        some, total = out["total_volume"] > 0, np.where(out["total_volume"] > 0, out["total_volume"], 1)
        out["pct_at_ask"], out["pct_at_bid"] = np.where(some, out["buy_volume"] / total, 0.0), np.where(some, out["sell_volume"] / total, 0.0)
        out["relative_aggression"] = np.where(some, out["delta"] / (total + EPS), 0.0)
        # price and VWAP
        opens = self._day(key[1])[0]
        counts = (size > 0) & (ts >= opens)
        money, shares = s["money"] + np.cumsum(np.where(counts, price * volume, 0.0)), s["vwap_size"] + np.cumsum(np.where(counts, volume, 0.0))
        vwap = np.where(shares > 0, money / np.where(shares > 0, shares, 1), np.nan)
        last_t = np.full(n, -1)
        last_t[tick] = np.arange(len(ts))
        last_t = np.maximum.accumulate(last_t)
        for c, name, x in (("last_price", "price", price), ("vwap_session", "vwap", vwap)):
            out[c] = np.where(last_t >= 0, x[last_t] if len(x) else np.nan, _float(s[name]))
            s[name] = float(out[c][-1])
        if len(ts):
            s["money"], s["vwap_size"] = float(money[-1]), float(shares[-1])
        plain = ~t["irregular"]
        high, low = np.full(n, -np.inf), np.full(n, np.inf)
        np.maximum.at(high, tick[plain], price[plain])
        np.minimum.at(low, tick[plain], price[plain])
        out["high_10s"], out["low_10s"] = np.where(np.isinf(high), out["last_price"], high), np.where(np.isinf(low), out["last_price"], low)
        out |= self._trade_sizes(tick, size, n) | self._large(grid, ts, tick, size, side)
        # bars that have ended by each tick
        for width, suffix in ((60_000, ""), (120_000, "_2m"), (180_000, "_3m")):
            out |= self._averages(width, suffix, ts, price, grid)
        return pd.DataFrame(out | self._rolling(out))

    @staticmethod
    def _sides(s: dict, price: np.ndarray, bid: np.ndarray, ask: np.ndarray) -> np.ndarray:
        """Lee and Ready's side of each trade in turn, as numbered, carried on from the state."""
        out = np.zeros(len(price), np.int8)
        own = np.flatnonzero(~np.isnan(bid) & ~np.isnan(ask))
        if not len(own):
            return out
        p, b, a = price[own], bid[own], ask[own]
        prev = np.concatenate([[_float(s["prev"])], p[:-1]])
        raw = np.select([p >= a, p <= b, p > prev, p < prev], [1, -1, 1, -1], 0)
        known = np.maximum.accumulate(np.where(raw != 0, np.arange(len(raw)), -1))
        before = SIDES[s["side"] or "unknown"]
        carried = np.where(known >= 0, raw[known], before)
        carried = np.where(np.isnan(prev) & (raw == 0), 0, carried)
        out[own] = carried
        s["prev"] = float(p[-1])
        if known[-1] >= 0:
            s["side"] = "buy" if raw[known[-1]] > 0 else "sell"
        return out

    @staticmethod
    def _trade_sizes(tick: np.ndarray, size: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """Mean, deviation, variation and top-decile share of the trade sizes of each tick."""
        good = size > 0
        tick, size = tick[good], size[good]
        count, total = np.bincount(tick, minlength=n), np.bincount(tick, size, n)
        safe = np.maximum(count, 1)
        mean = total / safe
        dev = np.sqrt(np.bincount(tick, (size - mean[tick]) ** 2, n) / safe)
        order = np.lexsort((-size, tick))
        rank = np.arange(len(tick)) - (np.cumsum(count) - count)[tick[order]]
        top = rank < np.maximum(1, np.ceil(count * 0.1))[tick[order]]
        share = np.bincount(tick[order], np.where(top, size[order], 0.0), n) / np.where(total > 0, total, 1)
        return {"avg_trade_size": mean, "trade_size_std": dev, "top_decile_volume_share": share, "trade_size_cv": dev / np.where(mean > 0, mean, 1)}

    def _large(self, grid: np.ndarray, ts: np.ndarray, tick: np.ndarray, size: np.ndarray, side: np.ndarray) -> dict[str, np.ndarray]:
        """The 95th percentile of the sizes of five minutes, and the trades of each tick that reach it."""
        n, good = len(grid), size > 0
        held_ts, held = self.sizes.get()
        every, values = np.concatenate([held_ts, ts[good]]), np.concatenate([held, size[good]])
        threshold = np.nan_to_num(window_ranks(every, values, grid, SHARE, WINDOW_MS))
        keep = every >= grid[-1] + TICK_MS - WINDOW_MS
        if len(every):
            self.sizes.put(every[keep], values[keep])
        own = threshold[tick]
        big = (own > 0) & (size >= own)
        volume = np.nan_to_num(size)
        out = {"large_trade_threshold_size": threshold, "large_trade_count_10s": np.bincount(tick, big, n).astype(np.int64)}
        buy, sell, rest = (np.bincount(tick, np.where(big & (side == k), volume, 0.0), n) for k in SIDES.values())
        total = np.bincount(tick, volume, n)
        out |= {"large_buy_volume_10s": buy, "large_sell_volume_10s": sell, "large_unknown_volume_10s": rest, "large_trade_delta": buy - sell}
        out["large_trade_buy_ratio"] = np.where(buy + sell > 0, buy / (buy + sell + EPS), 0.0)
        out["large_trade_share_of_total_vol_10s"] = np.where(total > 0, (buy + sell + rest) / (total + EPS), 0.0)
        return out

    def _averages(self, width: int, suffix: str, ts: np.ndarray, price: np.ndarray, grid: np.ndarray) -> dict[str, np.ndarray]:
        """Averages of the bars of a width as of each tick; the bar that hasn't ended stays in the state."""
        names = _names(_BAR)
        b = dict(zip(names, self.bars.getValue((width,)), strict=True)) if self.bars.containsKey((width,)) else dict.fromkeys(names) | {"n": 0}
        ended = [(-1, *(_float(b[f"ema{p}"]) for p in PERIODS), _float(b["atr"]), b["n"])]

        def close() -> None:
            begin, high, low, last, before = b["begin"], b["high"], b["low"], b["close"], b["closed"]
            tr = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
            b["n"] += 1
            for p in PERIODS:
                old = b[f"ema{p}"]
                b[f"ema{p}"] = last if old is None else old + (last - old) * 2 / (p + 1)
            k, old = b["n"], b["tr"] or 0.0
            b["tr"] = (old * (k - 1) + tr) / k if k <= ATR_PERIOD else (old * (ATR_PERIOD - 1) + tr) / ATR_PERIOD
            b["atr"] = BLEND * ATR_SEED + (1 - BLEND) * b["tr"] if k < ATR_PERIOD else b["tr"]
            b["closed"], b["begin"] = last, None
            ended.append((begin + width, *(b[f"ema{p}"] for p in PERIODS), b["atr"], k))

        buckets = ts // width * width
        cuts = np.flatnonzero(np.diff(buckets, prepend=-1)) if len(ts) else np.zeros(0, np.int64)
        for p, q in zip(cuts.tolist(), np.append(cuts, len(ts))[1:].tolist(), strict=True):
            begin, own = int(buckets[p]), price[p:q]
            if b["begin"] is not None and b["begin"] != begin:
                close()
            high, low = float(own.max()), float(own.min())
            if b["begin"] is not None:
                high, low = max(high, b["high"]), min(low, b["low"])
            b |= {"begin": begin, "high": high, "low": low, "close": float(own[-1])}
        if b["begin"] is not None and b["begin"] + width <= grid[-1]:
            close()
        self.bars.updateValue((width,), tuple(b[c] for c in names))
        at = np.searchsorted([e[0] for e in ended], grid, side="right") - 1
        table = np.array([e[1:] for e in ended], float)[at]
        out = {f"ema{p}{suffix}": table[:, k] for k, p in enumerate(PERIODS)}
        if not suffix:
            out["atr"] = table[:, len(PERIODS)]
            bars = table[:, len(PERIODS) + 1]
            out["atr_status"] = np.where(bars == 0, None, np.where(bars >= ATR_PERIOD, "live", "blending"))
        return out

    def _rolling(self, out: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Features that look back, over the ring of the last five minutes and the new ticks."""
        ring = pd.DataFrame(list(self.recent.get()) if self.recent.exists() else [], columns=list(_RECENT), dtype=float)
        m, n = len(ring), len(out["ts_ms"])
        h = {c: np.concatenate([ring[c].to_numpy(float), out[c]]) for c in _RECENT if c in out}
        f: dict[str, np.ndarray] = {}
        spread = h["spread_pct"]
        count, mean, dev = _moments(spread, 7)
        vol = np.where(count > 1, dev, 0.0)
        f["spread_volatility_60s"] = vol
        f["spread_zscore"] = np.where((count < 2) | (vol <= EPS), 0.0, (np.nan_to_num(spread) - np.nan_to_num(mean)) / (vol + EPS))
        x = h["relative_aggression"]
        count, mean, dev = _moments(x, 7)
        f["relative_aggression_zscore_60s"] = np.where((count < 2) | (dev <= EPS), 0.0, (x - mean) / (dev + EPS))
        velocity = np.nan_to_num(h["delta"] - _before(h["delta"], 1))
        velocity[:m] = ring["delta_velocity"].to_numpy(float)  # the ring's first has lost the tick before it
        f["delta_velocity"] = velocity
        f["delta_acceleration"] = np.nan_to_num(velocity - _before(velocity, 1))
        p = h["last_price"]
        before = _before(p, 1)
        f["absorption_index"] = np.maximum(0.0, -h["delta"]) / (np.abs(np.nan_to_num(p - before)) + EPS)
        with np.errstate(invalid="ignore", divide="ignore"):
            step = np.where((p > 0) & (before > 0), np.log(p / before), np.nan)
            f["realized_vol_60s"] = np.where(_moments(step, 6)[0] > 0, _moments(step, 6)[2], 0.0)
            then = _before(p, 6)
            f["approach_return_60s"] = np.where((then > 0) & (p > 0), np.nan_to_num(np.log(p / then)), 0.0)
        f = {c: v[m:] for c, v in f.items()}
        e9, e20, e30, e200, atr, price = (out[c] for c in ("ema9", "ema20", "ema30", "ema200", "atr", "last_price"))
        for k in (9, 20, 30):
            f[f"slope_ema{k}_60s"] = np.nan_to_num((h[f"ema{k}"] - _before(h[f"ema{k}"], 6)) / (6 * TICK_MS / 1000))[m:]
        f["ema_spread_9_20"], f["ema_spread_20_30"] = e9 - e20, e20 - e30
        moving, ranged = ~np.isnan(e9) & ~np.isnan(atr), atr > 0
        safe = np.where(ranged, atr, 1)
        compression = np.where(ranged, (np.abs(e9 - e20) + np.abs(e20 - e30)) / safe, np.where(moving, 0.0, np.nan))
        f["compression_index"], f["ema_confluence_score"] = compression, np.clip(1 - compression / CONFLUENCE_REF, 0, 1)
        stack = np.where((e9 > e20) & (e20 > e30), "bull", np.where((e9 < e20) & (e20 < e30), "bear", "mixed"))
        f["stack_state"] = np.where(np.isnan(e9), None, stack)
        f["price_vs_emas"] = sum(np.where((e > 0) & (price > e), w, 0) for e, w in ((e200, 8), (e30, 4), (e20, 2), (e9, 1)))
        f["stretch_200_atr"] = np.where(ranged, np.nan_to_num((price - e200) / safe), 0.0)
        d = price - out["vwap_session"]
        f["price_minus_vwap"] = d
        f["price_minus_vwap_atr"] = np.where(ranged, d / safe, np.where(~np.isnan(d) & ~np.isnan(atr), 0.0, np.nan))
        f["vwap_state"] = np.where(np.isnan(d), None, np.where(d > DEAD_ZONE, "above", np.where(d < -DEAD_ZONE, "below", "at")))
        h["delta_velocity"] = np.concatenate([ring["delta_velocity"].to_numpy(float), f["delta_velocity"]])
        self.recent.put(_tuples(pd.DataFrame({c: h[c][-HISTORY:] for c in _RECENT})))
        return f

    def _zones(self, key: tuple, ticks: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Zone events and episodes that the ticks bring about, level by level."""
        known = ticks[ticks["last_price"].notna() & (ticks["atr"] > 0)]
        if not len(known) or not self.levels.exists():
            return
        names = _names(_LEVEL)
        ts, price, atr = known["ts_ms"].tolist(), known["last_price"].tolist(), known["atr"].tolist()
        zones, found, changed = [], [], []
        for (level_id,), value in self.levels.iterator():
            v = dict(zip(names, value, strict=True))
            for t, p, a in zip(ts, price, atr, strict=True):
                if t < v["created"]:
                    continue
                d = (p - v["price"]) / a
                inside = abs(d) <= v["width"]
                if v["two"] and not v["one"] and not inside:
                    v["touches"] += 1
                event = "enter" if inside and not v["one"] else "exit" if v["one"] and not inside else None
                if event == "enter":
                    v["side"] = "above" if p - v["price"] >= 0 else "below"
                    v |= {"open": True, "entry": t, "entry_atr": a, "exit": None, "most": None, "most_ts": None, "least": None, "fail_ts": None}
                if event is not None:
                    zones.append((t, level_id, event, v["side"], v["touches"]))
                v["two"], v["one"] = v["one"], inside
                if v["open"]:
                    episode = self._episode(key, level_id, v, t, p, d, event)
                    if episode is not None:
                        found.append(episode)
            changed.append((level_id, v))
        for level_id, v in changed:
            self.levels.updateValue((level_id,), tuple(v[c] for c in names))
        if zones:
            yield _shaped(key, "zone", pd.DataFrame(zones, columns=["ts_ms", *ZONE_COLUMNS]))
        if found:
            yield _shaped(key, "episode", pd.DataFrame(found))

    def _episode(self, key: tuple, level_id: str, v: dict, t: int, p: float, d: float, event: str | None) -> dict | None:
        """Carry a level's open episode on by a tick; the episode if this resolves it."""
        sign = -1 if self.bias == "short" else 1
        if event == "exit" and v["exit"] is None:
            v["exit"] = t
        move = (p - v["price"]) / v["entry_atr"] * sign
        if v["most"] is None or move > v["most"]:
            v["most"], v["most_ts"] = move, t
        v["least"] = move if v["least"] is None else min(v["least"], move)
        if v["fail_ts"] is None and -move >= FAILURE_ATR:
            v["fail_ts"] = t
        thesis = d * sign
        late = v["exit"] is not None and t >= v["exit"] + TIMEOUT_MS
        why = "timeout" if late else "threshold_hit" if thesis >= SUCCESS_ATR else "invalidation" if thesis <= -FAILURE_ATR else None
        if why is None:
            return None
        v["open"] = False
        entry = v["entry"]
        return {
            "ts_ms": t, "episode_id": hashlib.sha256(f"{key[1]}|{level_id}|{entry}".encode()).hexdigest(), "level_id": level_id, "level_price": v["price"], "level_type": v["type"], "level_width_atr": v["width"],
            "level_entry_side": v["side"], "start_time": entry - BASELINE_MS, "zone_entry_time": entry, "zone_exit_time": v["exit"], "resolution_time": t, "resolution_trigger": why,
            "outcome": {"threshold_hit": "win", "invalidation": "loss", "timeout": "scratch"}[why], "direction_bias": self.bias, "atr_value": v["entry_atr"], "mfe": max(0.0, v["most"]), "mae": max(0.0, -v["least"]),
            "time_to_mfe_ms": v["most_ts"] - entry, "time_to_failure_ms": None if v["fail_ts"] is None else v["fail_ts"] - entry,
        }


def _shaped(key: tuple, kind: str, rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of a kind with all columns of ``OUTPUT``, null where the kind has none."""
    whole = {"kind": kind, "symbol": key[0], "session_id": key[1], "ts_ms": rows["ts_ms"]}
    for c in _ALL:
        whole[c] = rows[c].astype(_PANDAS[_TYPES[c]]) if c in rows else pd.Series(None, index=rows.index, dtype=_PANDAS[_TYPES[c]])
    return pd.DataFrame(whole)


class Thresholds(Ticking):
    """The nearest rank of trade sizes over a window to each tick that isn't empty, key (symbol,)."""

    def __init__(self, window_ms: int, share: float):
        self.window_ms, self.share = window_ms, share

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sizes = Sizes(handle)
        self.tick = handle.getValueState("tick", "ts_ms long")

    def advance(self, key: tuple, final: Rows, commands: list[tuple], boundary: int) -> Iterator[pd.DataFrame]:
        good = _at(final, final["size"] > 0)
        held_ts, held = self.sizes.get()
        ts = np.concatenate([held_ts, good["ts_ms"]])
        if not len(ts):
            return
        values = np.concatenate([held, good["size"]])
        first = self.tick.get()[0] + TICK_MS if len(held) and self.tick.exists() else int(ts.min()) // TICK_MS * TICK_MS + TICK_MS - 1
        grid = np.arange(first, min(boundary, (int(ts.max()) + self.window_ms + 1) // TICK_MS * TICK_MS - 1) + 1, TICK_MS)
        if not len(grid):
            if len(good["ts_ms"]):
                self.sizes.put(ts, values)
            return
        threshold = window_ranks(ts, values, grid, self.share, self.window_ms)
        keep = ts >= grid[-1] + TICK_MS - self.window_ms
        self.sizes.put(ts[keep], values[keep])
        if keep.any():
            self.tick.update((int(grid[-1]),))
        else:
            self.tick.clear()
        there = ~np.isnan(threshold)
        yield pd.DataFrame({"symbol": key[0], "ts_ms": grid[there], "threshold": threshold[there]})

    def next_due(self, key: tuple, pending: int | None, watermark: int) -> int | None:
        if pending is not None:
            return pending
        return self.tick.get()[0] + TICK_MS if self.sizes.exists() and self.tick.exists() else None


def _blocks(batches: list[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The events of each key as one row of their columns' bytes; a command has a row by itself, with its level."""
    table = pa.Table.from_batches(batches).combine_chunks()
    rows = {c: table[c].to_numpy().astype(kind, copy=False) for c, kind in _COLUMNS.items()}
    group = np.zeros(table.num_rows, np.int64)
    for k in keys:
        coded = table[k].combine_chunks().dictionary_encode("encode")
        group = group * len(coded.dictionary) + coded.indices.to_numpy()
    command = rows["kind"] == COMMAND
    group[command] = -1 - np.arange(command.sum())
    order = np.argsort(group, kind="stable")
    order = order[rows["kind"][order] != NO_KIND]
    begins = np.flatnonzero(np.diff(group[order], prepend=group[order[:1]] - 1))
    if not len(begins):
        return
    cuts = [slice(*x) for x in zip(begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True)]
    rows = _at(rows, order)
    out = {c: table[c].take(order[begins]) for c in (*keys, *_names(_LEVEL_ADDED))} | {c: pa.array([x[cut].tobytes() for cut in cuts], pa.binary()) for c, x in rows.items()}
    one = pa.table(out).select([*keys, *_COLUMNS, *_names(_LEVEL_ADDED)])
    yield from one.combine_chunks().to_batches()


def _packed(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield from _blocks(held, keys)
                held, n = [], 0
        if n:
            yield from _blocks(held, keys)

    return pack


def _sent(stream: DataFrame, keys: list[str]) -> DataFrame:
    """What an engine is sent of a stream: its events in blocks.

    Spark's worker makes a tuple of every row that it hands to a processor, which for an event takes
    longer than all that the engine does with it.
    """
    filled = {"seq": NO_SEQ, "kind": NO_KIND, "irregular": False}
    columns = [F.coalesce(c, F.lit(filled[c])).alias(c) if c in filled else F.col(c) for c in (*_COLUMNS, *_names(_LEVEL_ADDED))]
    schema = ", ".join([*(f"{k} string" for k in keys), _BLOCK, _LEVEL_ADDED])
    return stream.where("ts_ms IS NOT NULL").select(*keys, *columns).mapInArrow(_packed(keys), schema)


def tape_engine(stream: DataFrame, ahead_ms: int = 0, bias: str = "long") -> DataFrame:
    """``OUTPUT`` of a stream of ``EVENTS`` that has an event time ``t`` and a watermark, by symbol and exchange day."""
    dated = stream.withColumn("session_id", F.concat_ws("_", "symbol", exchange_date(F.col("ts_ms"))))
    return _sent(dated, KEY).groupBy(*KEY).transformWithStateInPandas(TapeEngine(ahead_ms, bias), OUTPUT, "append", "eventTime")


def threshold_engine(trades: DataFrame, window_ms: int, share: float = SHARE) -> DataFrame:
    """symbol, ts_ms and threshold for each tick whose window (of ``window_ms`` before its end, and that) has a trade."""
    types = dict(c.split() for c in EVENTS.split(", ") if c != "symbol string")
    whole = trades.withColumns({c: F.lit(None).cast(types[c]) for c in types if c not in trades.columns and c != "kind"})
    whole = whole.withColumn("kind", F.when(F.col("seq").isNotNull(), TRADE).cast("int"))
    return _sent(whole, ["symbol"]).groupBy("symbol").transformWithStateInPandas(Thresholds(window_ms, share), "symbol string, ts_ms long, threshold double", "append", "eventTime")


def ticks(out: DataFrame) -> DataFrame:
    return out.where("kind = 'tick'").select(*KEY, "ts_ms", *TICK_COLUMNS)


def zone_events(out: DataFrame) -> DataFrame:
    return out.where("kind = 'zone'").select(*KEY, "ts_ms", *ZONE_COLUMNS)


def episodes(out: DataFrame) -> DataFrame:
    return out.where("kind = 'episode'").select(*KEY, *EPISODE_COLUMNS)


def late_events(out: DataFrame) -> DataFrame:
    """Events that came after their tick was done: seq and time."""
    return out.where("kind = 'late'").select(*KEY, "ts_ms", F.col("sequence_id").alias("seq"))


def parity(live: DataFrame, batch: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """By session, how many ticks the stream and the batch have, and how many agree in every stored column that both have.

    Numbers agree within ``tolerance`` of their size; nulls agree with nulls alone.
    """
    a, b = live.alias("a"), batch.alias("b")
    keys = [*KEY, "ts_ms"]
    same = F.lit(True)
    for n in [c for c in TICK_COLUMNS if c in batch.columns and c in live.columns]:
        x, y = F.col(f"a.{n}"), F.col(f"b.{n}")
        if n not in _TEXTS:
            x, y = x.cast("double"), y.cast("double")
            close = F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
            same = same & F.coalesce(close, x.isNull() & y.isNull())
        else:
            same = same & x.eqNullSafe(y)
    both = a.withColumn("_live", F.lit(1)).alias("a").join(b.withColumn("_batch", F.lit(1)).alias("b"), keys, "full")
    return both.groupBy(*KEY).agg(F.count("_live").alias("live"), F.count("_batch").alias("batch"), F.count(F.when(F.col("_live").isNotNull() & F.col("_batch").isNotNull() & same, 1)).alias("equal"))
