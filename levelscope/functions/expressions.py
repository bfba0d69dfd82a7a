"""Scalar expressions: time, identity, bands, buckets and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import NOTES

EPS = 1e-9
DEAD_ZONE = 1e-12
EXCHANGE_ZONE = "America/New_York"
DISPLAY_ZONE = "America/Chicago"


def bucket(ts: Column, width_ms: int) -> Column:
    """Start of the time bucket of ``width_ms`` that holds ``ts``."""
    return ts - F.pmod(ts, F.lit(width_ms))


def local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ts), zone)


def exchange_date(ts: Column, zone: str = EXCHANGE_ZONE) -> Column:
    return F.date_format(local(ts, zone), "yyyy-MM-dd")


def local_minute(ts: Column, zone: str = DISPLAY_ZONE) -> Column:
    return F.date_format(local(ts, zone), "HH:mm")


def parse_local(text: Column, zone: str) -> Column:
    """Epoch ms of an ISO date-time, with its own offset or else in ``zone``."""
    clean = F.replace(F.trim(text), F.lit(" "), F.lit("T"))
    offset = F.rlike(clean, F.lit(r"T.*(Z|[+-]\d{2}:?\d{2})$"))
    stated = F.unix_millis(F.try_to_timestamp(clean))
    wall = F.unix_millis(F.to_utc_timestamp(F.try_to_timestamp(clean), zone))
    return F.when(offset, stated).otherwise(wall)


def sign(x: Column, eps: float = DEAD_ZONE) -> Column:
    return F.when(x > eps, 1).when(x < -eps, -1).otherwise(0)


def asinh(x: Column) -> Column:
    """Inverse hyperbolic sine by its symmetry: Spark's own loses large negative numbers."""
    return F.signum(x) * F.asinh(F.abs(x))


def clamp01(x: Column) -> Column:
    """``x`` kept within 0 and 1; a null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def true_range(high: Column, low: Column, prev_close: Column) -> Column:
    """The bar's range, widened to the close before it; without one, the range alone."""
    return F.greatest(high - low, F.abs(high - prev_close), F.abs(low - prev_close))


def daily_atr_seed(daily: Column) -> Column:
    """A one-minute ATR from a daily one, over the 390 minutes of a session."""
    return daily / F.sqrt(F.lit(390.0))


def ema_alpha(period: int) -> float:
    return 2.0 / (period + 1)


def quote_rule(price: Column, bid: Column, ask: Column) -> Column:
    return F.when(price >= ask, "buy").when(price <= bid, "sell").otherwise("unknown")


def regular(conditions: Column) -> Column:
    """False for prints of condition W, which are left out of highs and lows."""
    return ~F.coalesce(F.array_contains(conditions, "W"), F.lit(False))


def price_zone(price: Column, low: Column, high: Column) -> Column:
    return F.when(price > high, "ABOVE").when(price < low, "BELOW").otherwise("IN_BAND")


def normal_conditions(value: Column) -> Column:
    """Conditions as an array: a null is empty, a string a single element."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def stack_state(price: Column, e9: Column, e20: Column, e30: Column) -> Column:
    return F.when((e9 > e20) & (e20 > e30), "bull").when((e9 < e20) & (e20 < e30), "bear").otherwise("mixed")


def price_mask(price: Column, e9: Column, e20: Column, e30: Column, e200: Column) -> Column:
    """Which averages the price is above: 8 for 200, 4 for 30, 2 for 20, 1 for 9; unset ones count 0."""
    flags = [(e200, 8), (e30, 4), (e20, 2), (e9, 1)]
    total = F.lit(0)
    for average, weight in flags:
        total = total + F.when((average > 0) & (price > average), weight).otherwise(0)
    return total


def parse_notes(notes: Column) -> Column:
    """Marker notes; text that isn't JSON gives nulls."""
    return F.from_json(notes, NOTES, {"mode": "PERMISSIVE"})


def level_tags(tags: Column) -> Column:
    """Price tags with lower-case kinds, once each: supports, resistances, others, by price."""
    clean = F.transform(F.coalesce(tags, F.array().cast("array<struct<price:double,kind:string>>")), lambda t: F.struct(_kind_rank(t["kind"]).alias("rank"), t["price"].alias("price"), F.lower(F.coalesce(t["kind"], F.lit(""))).alias("kind")))
    return F.transform(F.array_sort(F.array_distinct(F.filter(clean, lambda t: t["price"].isNotNull()))), lambda t: F.struct(t["price"].alias("price"), t["kind"].alias("kind")))


def _kind_rank(kind: Column) -> Column:
    low = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(low == "support", 0).when(low == "resistance", 1).otherwise(2)


def first_tag(tags: Column) -> Column:
    """The first support, else the first resistance, else the first tag."""
    def of(kind: str) -> Column:
        return F.get(F.filter(tags, lambda t: F.lower(t["kind"]) == kind), F.lit(0))

    return F.coalesce(of("support"), of("resistance"), F.get(tags, F.lit(0)))


def scenario(kind: Column, outcome: Column) -> Column:
    """Side of a level's kind and its outcome, pending unless it is a win or a loss."""
    side = F.when(F.lower(F.trim(kind)) == "support", "long").when(F.lower(F.trim(kind)) == "resistance", "short").otherwise("unknown")
    end = F.lower(F.trim(outcome))
    return F.concat_ws("_", side, F.when(end.isin("win", "loss"), end).otherwise("pending"))


def velocity_bucket(atr_per_min: Column, pct_per_min: Column) -> Column:
    """How fast price came: by ATR a minute, or without an ATR by the fraction a minute."""
    def by(x: Column, crash: float, fast: float, normal: float) -> Column:
        return F.when(x >= crash, "crash").when(x >= fast, "fast").when(x >= normal, "normal").otherwise("grind")

    return F.when(atr_per_min.isNotNull(), by(F.abs(atr_per_min), 1.5, 0.75, 0.25)).otherwise(by(F.abs(pct_per_min), 0.007, 0.003, 0.001))


def marker_bias(marker_type: Column, bias: Column) -> Column:
    """The stated bias, or what the marker's type implies."""
    stated = F.lower(F.nullif(F.trim(bias), F.lit("")))
    return F.coalesce(stated, F.when(marker_type.isin("support_bounce", "downtrend_break"), "long").when(marker_type == "breakdown", "short"))
