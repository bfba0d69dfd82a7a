"""Verdicts on levels from their phases, minutes and touches: rule tables with points, gates and flags.

Each rule is a named condition over one row a level; a verdict is the sum of the points of the
rules that hold and what the sum stands for, unless a gate decides before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import LEVEL

Rules = list[tuple[int, str, Column]]


def scored(df: DataFrame, rules: Rules, score: str = "score", names: str = "rules") -> DataFrame:
    """``df`` plus the points of the rules that hold and their names; a null condition doesn't hold."""
    held = [(points, name, F.coalesce(test, F.lit(False))) for points, name, test in rules]
    total = sum((F.when(test, points).otherwise(0) for points, _, test in held), F.lit(0))
    listed = F.array_compact(F.array(*[F.when(test, F.lit(f"{points:+d} {name}")) for points, name, test in held]))
    return df.withColumns({score: total, names: listed})


def inst_balance(packets: DataFrame) -> DataFrame:
    """Institutional touches and volume of each level by side, and how much selling was absorbed."""
    buy, sell, up = F.col("institutional_buy"), F.col("institutional_sell"), F.coalesce(F.col("bounce_return_30s_pct") > 0, F.lit(False))
    out = packets.groupBy(*LEVEL).agg(
        F.count("*").alias("touches"), F.count(F.when(buy, 1)).alias("inst_buys"), F.count(F.when(sell, 1)).alias("inst_sells"),
        F.sum(F.when(buy, F.col("large_buy_30s")).otherwise(0.0)).alias("inst_buy_volume"), F.sum(F.when(sell, F.col("large_sell_30s")).otherwise(0.0)).alias("inst_sell_volume"),
        F.count(F.when(sell & up, 1)).alias("absorbed"), F.count(F.when(sell & ~up, 1)).alias("confirmed"),
    )
    return out.withColumn("absorption_rate", F.coalesce(F.try_divide("absorbed", "inst_sells"), F.lit(0.0)))


def _sum(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x[field])


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def _won(items: Column, side: str) -> Column:
    return F.size(F.filter(items, lambda p: p["winner"] == side))


def _in_order(df: DataFrame, order: str, fields: list[str], name: str) -> DataFrame:
    """A level's rows as one array in order: four or five phases, or the minutes with touches."""
    return df.groupBy(*LEVEL).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias(name))


def pattern_rules() -> Rules:
    """Points of the pattern library, over phases ``p``, minutes ``m`` and totals."""
    p, m = F.col("p"), F.col("m")
    n, k = F.size(p), F.size(m)
    first, last, closing = F.element_at(p, 1)["winner"], F.element_at(p, -1)["winner"], F.element_at(m, -1)
    three, four = _last(p, 3), _last(p, 4)
    buys, sells = F.col("inst_buy_volume"), F.col("inst_sell_volume")
    late, early = _last(p, 2), F.slice(p, 1, 2)
    late_buy, late_sell, early_buy, early_sell = _sum(late, "inst_buy"), _sum(late, "inst_sell"), _sum(early, "inst_buy"), _sum(early, "inst_sell")
    buy_size, sell_size = (F.coalesce(F.try_divide(v, F.col(c)), F.lit(0.0)) for v, c in ((buys, "inst_buys"), (sells, "inst_sells")))
    two, tail = _last(m, 2), _last(m, 3)

    def adjacent(field: str) -> Column:
        pairs = F.zip_with(F.slice(m, F.lit(1), F.greatest(k - 1, F.lit(0))), F.slice(m, F.lit(2), F.greatest(k - 1, F.lit(0))), lambda a, b: (a[field] >= 1) & (b[field] >= 1))
        return F.exists(pairs, lambda x: x)

    def rising(field: str) -> Column:
        return (k >= 3) & (F.get(tail, 1)[field] > F.get(tail, 0)[field]) & (F.get(tail, 2)[field] > F.get(tail, 1)[field])

    total_buy, total_sell = _sum(p, "buy"), _sum(p, "sell")
    half = F.floor(n / 2).cast("int")
    early_delta, late_delta = _sum(F.slice(p, F.lit(1), half), "delta"), _sum(F.slice(p, half + 1, n), "delta")
    shape = F.when(n >= 2, F.array_join(F.transform(p, lambda x: x["winner"]), ""))
    return [
        (1, "buyers 2 of last 3 phases", _won(three, "+") >= 2), (2, "buyers 3 of last 4 phases", _won(four, "+") >= 3), (3, "buyers all phases", (n >= 2) & (_won(p, "+") == n)),
        (-1, "sellers 2 of last 3 phases", _won(three, "-") >= 2), (-2, "sellers 3 of last 4 phases", _won(four, "-") >= 3),
        (1, "last phase buyers", last == "+"), (-1, "last phase sellers", last == "-"), (2, "turnaround", (first == "-") & (last == "+")), (-2, "breakdown", (first == "+") & (last == "-")),
        (1, "institutions buy more", buys > sells), (2, "institutions buy twice as much", buys > sells * 2), (-1, "institutions sell more", sells > buys), (-2, "institutions sell twice as much", sells > buys * 2),
        (1, "late institutional buys", late_buy >= 1), (-1, "late institutional sells", late_sell >= 1),
        (2, "institutions turned to buying", (early_sell >= 1) & (late_buy >= 1) & (late_sell == 0)), (-2, "institutions turned to selling", (early_buy >= 1) & (late_sell >= 1) & (late_buy == 0)),
        (1, "bigger buyers", (buy_size > sell_size * 1.5) & (F.col("inst_buys") >= 1)), (-1, "bigger sellers", (sell_size > buy_size * 1.5) & (F.col("inst_sells") >= 1)),
        (2, "adjacent institutional buys", adjacent("inst_buy")), (-2, "adjacent institutional sells", adjacent("inst_sell")),
        (1, "last minute buyers", closing["buy"] > closing["sell"] * 1.2), (2, "last two minutes buyers", (k >= 2) & (_sum(two, "buy") > _sum(two, "sell") * 1.2)), (-1, "last minute sellers", closing["sell"] > closing["buy"] * 1.2),
        (1, "ended with institutional buys", closing["inst_buy"] >= 1), (-1, "ended with institutional sells", closing["inst_sell"] >= 1), (1, "buying rises", rising("buy")), (-1, "selling rises", rising("sell")),
        (1, "more bought", total_buy > total_sell), (-1, "more sold", total_sell > total_buy),
        (2, "delta turned up", (n >= 2) & (early_delta < 0) & (late_delta > 0)), (-2, "delta turned down", (n >= 2) & (early_delta > 0) & (late_delta < 0)),
        (2, "ends ++", F.endswith(shape, F.lit("++"))), (-2, "ends --", F.endswith(shape, F.lit("--"))), (2, "reversal -++", F.contains(shape, F.lit("-++"))), (-2, "breakdown +--", F.contains(shape, F.lit("+--"))),
        (2, "dump absorbed", F.col("absorbed_dumps") >= 1), (3, "dumps absorbed twice", F.col("absorbed_dumps") >= 2), (-2, "dump not absorbed", F.col("failed_dumps") >= 1),
    ]


def by_bounds(score: Column, bounds: list[tuple[float, str]], least: str) -> Column:
    """The first name whose bound the score reaches, from the highest on; ``least`` below all."""
    out = None
    for bound, name in bounds:
        out = F.when(score >= bound, name) if out is None else out.when(score >= bound, name)
    return out.otherwise(least)


#: Direction and confidence by pattern score, from the highest bound on.
PATTERN_VERDICTS = [(8, "LONG TAKE"), (4, "LONG LEAN"), (1, "LONG WAIT"), (-3, "NEUTRAL WAIT"), (-7, "SHORT LEAN")]


def pattern_verdict(phases: DataFrame, minutes: DataFrame, balance: DataFrame, wash: DataFrame) -> DataFrame:
    """Direction and confidence of each level from the pattern library; a hard stop decides before.

    ``phases``, ``minutes``, ``balance`` and ``wash`` are those of the level's touches.
    """
    p = _in_order(phases, "phase", ["winner", "buy", "sell", "delta", "inst_buy", "inst_sell"], "p")
    m = _in_order(minutes, "minute_ts", ["buy", "sell", "inst_buy", "inst_sell"], "m")
    totals = wash.select(*LEVEL, F.col("hard_stop").alias("_stop"), F.col("absorbed").alias("absorbed_dumps"), F.col("failed").alias("failed_dumps"))
    one = balance.select(*LEVEL, "touches", "inst_buys", "inst_sells", "inst_buy_volume", "inst_sell_volume").join(p, LEVEL).join(m, LEVEL).join(totals, LEVEL, "left").fillna(0, ["absorbed_dumps", "failed_dumps"])
    sells = F.col("inst_sell_volume")
    stop = F.when((sells > F.col("inst_buy_volume") * 3) & (sells > 5000), "INST_SELL_DOMINATES").otherwise(F.col("_stop"))
    out = scored(one, pattern_rules()).withColumn("hard_stop", stop)
    verdict = F.when(F.col("hard_stop").isNotNull(), "SHORT AVOID").otherwise(by_bounds(F.col("score"), PATTERN_VERDICTS, "SHORT AVOID"))
    progression = F.array_join(F.transform("p", lambda x: x["winner"]), "")
    out = out.withColumn("_v", F.split(verdict, " ")).withColumns({"direction": F.get("_v", 0), "confidence": F.get("_v", 1), "progression": progression})
    return out.select(*LEVEL, "touches", "score", "hard_stop", "direction", "confidence", "progression", "rules")


def _halves(phases: DataFrame, order: str = "phase") -> DataFrame:
    """One row a level: phases in order ``p``, how many, and sums of the early and the late half."""
    fields = ["winner", "buy", "sell", "delta", "inst_buy", "inst_sell", "absorbed"]
    one = _in_order(phases, order, fields, "p").withColumn("n", F.size("p"))
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2)).cast("int")
    early, late = F.slice(F.col("p"), F.lit(1), half), F.slice(F.col("p"), half + 1, F.col("n"))
    sums = {f"{name}_{f}": _sum(items, f) for name, items in (("early", early), ("late", late)) for f in fields[1:]}
    return one.withColumns(sums | {"last": F.element_at("p", -1)["winner"]})


def _against(late: str, early: str, more: int = 1, grow: float = 1.0, shrink: float = 1.0, margin: float = 0.0) -> list[tuple[int, Column]]:
    up = F.col(late) > F.col(early) * grow + margin
    return [(more, up), (-more, F.col(late) < F.col(early) * shrink - margin)]


def trend_rules(weighted: bool) -> Rules:
    """Early against late phases. ``weighted`` is the variant without a margin on delta whose last phase counts double."""
    b, s = F.col("late_inst_buy"), F.col("late_inst_sell")
    sets = {
        "institutional buys": _against("late_inst_buy", "early_inst_buy"), "institutional sells": _against("late_inst_sell", "early_inst_sell", -1),
        "buy volume": _against("late_buy", "early_buy", 1, 1.2, 0.8), "sell volume": _against("late_sell", "early_sell", -1, 1.2, 0.8),
        "delta": _against("late_delta", "early_delta", 1, margin=0.0 if weighted else 1000.0),
    }
    rules = [(points, name, test) for name, pair in sets.items() for points, test in pair]
    last = 2 if weighted else 1
    rules += [(last, "last phase buyers", F.col("last") == "+"), (-last, "last phase sellers", F.col("last") == "-")]
    if weighted:
        return [*rules, (1, "late balance", b > s), (-1, "late balance", s > b)]
    return [*rules, (1, "absorption rises", F.col("late_absorbed") > F.col("early_absorbed")), (2, "late balance", b > s), (-1, "late balance", (s > b) & (s > 0))]


RESISTANCE_VERDICTS = [(4, "BREAKOUT LIKELY"), (2, "BREAKOUT POSSIBLE"), (0, "CONTESTED"), (-2, "RESISTANCE HOLDING")]
RESISTANCE_TRENDS = [(4, "STRONG_BULLISH"), (2, "BULLISH"), (0, "NEUTRAL"), (-2, "BEARISH")]


def resistance_trend(phases: DataFrame) -> DataFrame:
    """Whether a resistance gives way, from its phases by gaps (winner beyond 500 shares).

    Positive delta without institutional sells is a clean breakout whatever the score.
    """
    one = scored(_halves(phases), trend_rules(weighted=False), "_points")
    buys, sells = F.col("early_inst_buy") + F.col("late_inst_buy"), F.col("early_inst_sell") + F.col("late_inst_sell")
    delta = F.col("early_delta") + F.col("late_delta")
    single, rising = F.col("n") < 2, delta > 0
    clean = ~single & rising & (sells == 0)
    points = F.when(single, F.when(rising & (sells == 0), 1).when(delta < 0, -1).otherwise(0)).when(~clean & rising & (buys > sells), F.col("_points") + 2).otherwise(F.col("_points"))
    one = one.withColumn("score", points)

    def named(alone: tuple[str, str, str], whole: str, bounds: list, least: str) -> Column:
        lone = F.when(F.col("score") > 0, alone[0]).when(F.col("score") < 0, alone[1]).otherwise(alone[2])
        return F.when(single, lone).when(clean, whole).otherwise(by_bounds(F.col("score"), bounds, least))

    trend = named(("SINGLE_PHASE_BULLISH", "SINGLE_PHASE_BEARISH", "INSUFFICIENT_DATA"), "CLEAN_BREAKOUT", RESISTANCE_TRENDS, "STRONG_BEARISH")
    verdict = named(("BREAKOUT POSSIBLE (low data)", "RESISTANCE HOLDING (low data)", "WAIT - insufficient data"), "BREAKOUT - TAKE", RESISTANCE_VERDICTS, "STRONG RESISTANCE")
    return one.withColumns({"trend": trend, "verdict": verdict}).select(*LEVEL, F.col("n").alias("phases"), "score", "trend", "verdict", "early_delta", "late_delta")


def running_phases(phases: DataFrame) -> DataFrame:
    """Phases with what has built up so far: institutions, delta and volume."""
    w = Window.partitionBy(*LEVEL).orderBy("phase").rowsBetween(Window.unboundedPreceding, 0)
    return phases.withColumns({f"cum_{c}": F.sum(c).over(w) for c in ("inst_buy", "inst_sell", "delta", "buy", "sell")})


def weighted_verdict(phases: DataFrame, balance: DataFrame) -> DataFrame:
    """Direction and confidence from totals (gates), or else from the trend and the weight of late phases."""
    one = scored(_halves(phases), trend_rules(weighted=True), "_trend")
    p, n = F.col("p"), F.col("n")
    early_end = F.greatest(F.lit(1), F.floor(n * 0.3)).cast("int")
    late_start = F.greatest(early_end, F.floor(n * 0.7).cast("int"))
    worth = F.transform(p, lambda x, i: (F.signum(x["delta"]) + x["inst_buy"] - x["inst_sell"]) * F.when(i < early_end, 0.5).when(i >= late_start, 2.0).otherwise(1.0))

    def part(low: Column, high: Column) -> Column:
        return F.aggregate(F.slice(F.col("_worth"), low + 1, F.greatest(high - low, F.lit(0))), F.lit(0.0), lambda a, x: a + x)

    volume = F.transform(p, lambda x: x["buy"] + x["sell"])
    one = one.withColumns({"_worth": worth, "_volume": volume, "trend_score": F.when(n < 2, 0).otherwise(F.col("_trend"))})
    one = one.withColumns({"early_score": part(F.lit(0), early_end), "mid_score": part(early_end, late_start), "late_score": part(late_start, n)})
    mean = F.aggregate("_volume", F.lit(0.0), lambda a, x: a + x) / n
    share = F.try_divide(F.element_at("_volume", -1), mean)
    thin = F.when((n >= 2) & (mean > 0), F.when(share < 0.3, 0.1).when(share < 0.5, 0.3).otherwise(1.0)).otherwise(1.0)
    one = one.withColumn("combined", F.col("trend_score") + F.col("late_score") * thin * 0.3)
    b = balance.select(*LEVEL, "inst_buys", "inst_sells", "inst_buy_volume", "inst_sell_volume")
    one = one.join(b, LEVEL).withColumns({"_buy": F.col("early_buy") + F.when(n > 1, F.col("late_buy")).otherwise(0.0), "_sell": F.col("early_sell") + F.when(n > 1, F.col("late_sell")).otherwise(0.0)})
    buy, sell, many_b, many_s, vol_b, vol_s = (F.col(c) for c in ("_buy", "_sell", "inst_buys", "inst_sells", "inst_buy_volume", "inst_sell_volume"))
    gate = (
        F.when(sell > buy * 2, "SHORT AVOID").when(buy > sell * 2, "LONG TAKE").when((vol_s > vol_b * 2) & (vol_s > 5000), "SHORT AVOID").when((vol_b > vol_s * 2) & (vol_b > 5000), "LONG TAKE")
        .when((many_s > many_b * 2) & (many_s >= 3), "SHORT AVOID").when((many_b > many_s * 2) & (many_b >= 3), "LONG TAKE")
    )
    up, by_volume, by_count = F.col("combined") >= 2, buy > sell, many_b > many_s
    against = F.when(up, (~by_volume).cast("int") + (~by_count).cast("int")).otherwise(by_volume.cast("int") + by_count.cast("int"))
    strength = F.when(up, F.col("trend_score")).otherwise(-F.col("trend_score"))
    sure = F.when((strength >= 5) & (against == 0), F.when(up, "TAKE").otherwise("AVOID")).when((strength >= 3) & (against <= 1), "WAIT").when((strength >= 2) & (against == 0), "WAIT").otherwise("LEAN")
    direction = F.when(up, "LONG").when(F.col("combined") <= -2, "SHORT").otherwise("NEUTRAL")
    verdict = F.coalesce(gate, F.concat_ws(" ", direction, F.when(direction == "NEUTRAL", "WAIT").otherwise(sure)))
    one = one.withColumn("_v", F.split(verdict, " ")).withColumns({"gated": gate.isNotNull(), "direction": F.get("_v", 0), "confidence": F.get("_v", 1)})
    return one.select(*LEVEL, n.alias("phases"), "trend_score", "early_score", "mid_score", "late_score", "combined", "gated", "direction", "confidence")


def checklist_eval(packets: DataFrame, bands: DataFrame) -> DataFrame:
    """A level's hard gates, green flags and cautions over its touches, and the graded verdict.

    ``bands`` (LEVEL, band_delta, band_large_buy, band_large_sell) has what was traded in the band over the session.
    """
    up, down = Window.partitionBy(*LEVEL).orderBy("touch_number"), Window.partitionBy(*LEVEL).orderBy(F.desc("touch_number"))
    bounce, ratio = F.coalesce("bounce_return_30s_pct", F.lit(0.0)), F.coalesce("large_buy_ratio_30s", F.lit(0.0))
    aggression, count = F.coalesce("rel_aggr_0_30s", F.lit(0.0)), F.coalesce("large_count_30s", F.lit(0))
    buys, sold, busy = F.col("institutional_buy"), F.col("institutional_sell"), count >= 5
    a, z = F.col("_a"), F.col("_z")

    def some(test: Column) -> Column:
        return F.coalesce(F.max(test), F.lit(False))

    t = packets.withColumns({"_a": F.row_number().over(up), "_z": F.row_number().over(down)}).groupBy(*LEVEL).agg(
        F.count("*").alias("touches"), F.count(F.when(buys, 1)).alias("inst_buys"), F.count(F.when(sold, 1)).alias("inst_sells"),
        some((z <= 2) & sold & (bounce < 0)).alias("late_confirmed"), some((z <= 2) & sold & (bounce >= 0)).alias("late_absorbed"),
        some((a == 1) & (ratio < 0.30) & (F.coalesce("band_delta_0_30s", F.lit(0.0)) < -50_000)).alias("first_dump"), some((a <= 2) & buys).alias("early_buy"),
        some((ratio >= 0.55) & busy).alias("high_ratio"), some((ratio >= 0.55) & busy & (aggression > 0)).alias("killer"), some(F.coalesce("compression_at_touch", F.lit(0.0)) >= 1.0).alias("compressed"),
        F.sum(F.when(a <= 3, count).otherwise(0)).alias("_early"), F.sum(F.when(z <= 3, count).otherwise(0)).alias("_late"), F.count(F.when(sold & (bounce > 0), 1)).alias("absorbed"),
        F.count(F.when((z <= 3) & (buys | (ratio > 0.6)), 1)).alias("_strong"), some(bounce > 0.02).alias("breakout"), F.min(aggression < 0).alias("all_negative"), (~some(bounce > 0.005)).alias("no_bounce"),
    )
    one = t.join(bands.select(*LEVEL, "band_delta", "band_large_buy", "band_large_sell"), LEVEL)
    buy, sell, n, many_b, many_s = (F.col(c) for c in ("band_large_buy", "band_large_sell", "touches", "inst_buys", "inst_sells"))
    gathering = (buy >= sell * 1.5) & (buy + sell >= 5000) & (buy > 0)
    share = F.coalesce(F.try_divide(sell * 100, buy + sell), F.lit(0.0))
    one = one.withColumns({"sell_pct": share, "_gathering": gathering})
    none = many_b == 0
    gates = [
        ("LATE_INST_SELL_CONFIRMED", F.col("late_confirmed")), ("NO_BUYERS", none & ~F.col("_gathering")), ("SELLER_DOMINATED", F.col("sell_pct") > 70),
        ("FIRST_TOUCH_DUMP", F.col("first_dump")), ("SELLERS_OUTNUMBER", many_s > many_b), ("SHARES_OUTNUMBER", sell > buy),
    ]
    greens = [
        ("INST_BUY_EARLY", F.col("early_buy")), ("INST_HOLD", (many_b > 0) & (many_s == 0)), ("HIGH_BUY_RATIO", F.col("high_ratio")), ("KILLER_COMBO", F.col("killer")), ("COMPRESSION_HIGH", F.col("compressed")),
        ("SELLER_EXHAUSTION", (n >= 4) & (F.col("_late") < F.col("_early") * 0.5) & (many_s == 0)), ("ABSORPTION", (F.col("absorbed") > 0) & ((buy > sell) | (many_b > many_s))), ("SHAKEOUT_ABSORBED", F.col("late_absorbed")),
        ("BAND_DELTA_POSITIVE", F.col("band_delta") > 0), ("SELL_PCT_LOW", F.col("sell_pct") < 40), ("ENDING_STRONG", (n >= 3) & (F.col("_strong") >= 2)), ("BREAKOUT_IDENTIFIED", F.col("breakout")), ("VOLUME_ACCUMULATION", F.col("_gathering")),
    ]
    cautions = [("AGGR_NEGATIVE_ALL", F.col("all_negative")), ("NO_BOUNCE", F.col("no_bounce")), ("EXHAUSTED_LEVEL", n > 40), ("SELL_PCT_CONTESTED", F.col("sell_pct").between(45, 55))]

    def listed(tests: list[tuple[str, Column]]) -> Column:
        return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))

    one = one.withColumns({"gates": listed(gates), "greens": listed(greens), "cautions": listed(cautions), "softened": none & F.col("_gathering")})
    few, green = n < 10, F.size("greens")
    verdict = (
        F.when(F.size("gates") > 0, F.when(few, "LEAN AVOID").otherwise("AVOID")).when(F.col("softened"), "WAIT - ACCUMULATION").when(few & (green >= 4), "LEAN TAKE").when(green >= 6, "STRONG TAKE").when(green >= 4, "TAKE").when(green >= 2, "WAIT")
        .otherwise(F.when(few, "LEAN PASS").otherwise("PASS"))
    )
    return one.withColumn("verdict", verdict).select(*LEVEL, "touches", "sell_pct", "softened", "gates", "greens", "cautions", "verdict")
