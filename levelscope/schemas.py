"""Schemas of tapes and dimension tables. Time is a LONG of epoch milliseconds throughout."""

TRADES = "seq long, symbol string, ts_ms long, price double, size double, conditions array<string>"
QUOTES = "seq long, symbol string, ts_ms long, bid double, bid_size double, ask double, ask_size double"
LEVELS = "ticker string, level_id string, level_price double, level_type string, level_source string, level_width_atr double, created_ts_ms long, notes string"
COMMANDS = "ts_ms long, ticker string, type string, marker_type string, marker_id string, direction_bias string, notes string, level_price double, level_type string, level_width_atr double, level_id string"
MARKERS = "marker_id string, session_id string, ticker string, ts_ms long, marker_type string, direction_bias string, notes string"
NOTES = (
    "schema string, chain_id string, end_ts_ms long, price_tags array<struct<price: double, kind: string>>, level_index int, level_outcome string, "
    "level_type string, indicators array<string>, indicator_timeframe string, band_pct double, direction_bias string, watch_start_ts_ms long, watch_end_ts_ms long, skip_episode boolean"
)
#: Columns by which a tape is partitioned.
KEY = ["symbol", "session_id"]
