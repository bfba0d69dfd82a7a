"""Statistics of sessions and across them: features, patterns and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import asinh
from ..schemas import KEY

#: What a tick of an episode is ranked by; the ratio-like ones are compared as asinh, where they can't explode.
FEATURES = (
    "delta", "cvd_60s", "cvd_30s", "relative_aggression", "absorption_index", "divergence_score", "buy_on_red", "sell_on_green", "spread_pct", "signed_distance_atr", "vol_zscore", "trade_zscore",
    "compression_index", "ema_confluence_score",
)
RATIO_LIKE = ("absorption_index", "divergence_score", "buy_on_red", "sell_on_green")
EARLY = 6


def _stacked(names: tuple[str, ...], value: str = "{}") -> Column:
    """Columns of ``names`` below each other, as (feature, x)."""
    return F.expr(f"stack({len(names)}, {', '.join(f"'{n}', CAST({value.format(n)} AS DOUBLE)" for n in names)}) AS (feature, x)")


def _tall(ticks: DataFrame, names: tuple[str, ...]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("episode_id", "phase").orderBy("ts_ms"))
    return ticks.withColumn("_n", rank).select("episode_id", "phase", "_n", _stacked(names))


def _changes(ticks: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """episode_id, feature and change: the features side by side in one aggregation by episode, then below each other."""
    rank = F.row_number().over(Window.partitionBy("episode_id", "phase").orderBy("ts_ms"))
    early = ticks.select("episode_id", "phase", *names, rank.alias("_n")).where(f"phase = 'baseline' OR (phase = 'stress' AND _n <= {EARLY})")
    means = [F.avg(F.when(F.col("phase") == p, F.col(n).cast("double"))).alias(f"{n}_{k}") for n in names for k, p in enumerate(("baseline", "stress"))]
    return early.groupBy("episode_id").agg(*means).select("episode_id", _stacked(names, "{0}_1 - {0}_0")).withColumnRenamed("x", "change")


def feature_ranking(ticks: DataFrame, outcomes: DataFrame, names: tuple[str, ...] = FEATURES, most: int = 20) -> DataFrame:
    """How far the change of each feature from baseline to stress separates wins from losses.

    ``ticks`` have episode_id, phase, ts_ms; the first six stress ticks count. Features with
    fewer than two episodes of either outcome are left out; the ``most`` largest effects stay,
    of equal ones those with the larger difference. Without any deviation an effect is 0.
    """
    change = _changes(ticks, names)
    joined = change.join(outcomes.select("episode_id", "outcome"), "episode_id").where("change IS NOT NULL")
    joined = joined.withColumn("stable", F.when(F.col("feature").isin(*RATIO_LIKE), asinh(F.col("change"))).otherwise(F.col("change")))

    def of(kind: str, f, column: str = "change") -> Column:
        return f(F.when(F.col("outcome") == kind, F.col(column)))

    out = joined.groupBy("feature").agg(
        of("win", F.count).alias("wins"), of("loss", F.count).alias("losses"), of("win", F.avg).alias("win_mean"), of("loss", F.avg).alias("loss_mean"),
        (of("win", F.avg, "stable") - of("loss", F.avg, "stable")).alias("_apart"), of("win", F.stddev_pop, "stable").alias("_w"), of("loss", F.stddev_pop, "stable").alias("_l"),
    ).where("wins >= 2 AND losses >= 2")
    pooled = F.sqrt((F.col("_w") * F.col("_w") + F.col("_l") * F.col("_l")) / 2)
    out = out.withColumns({"diff": F.col("win_mean") - F.col("loss_mean"), "effect": F.when(pooled > 0, F.col("_apart") / (pooled + 1e-12)).otherwise(0.0)})
    return out.drop("_w", "_l", "_apart").orderBy(F.desc(F.abs("effect")), F.desc(F.abs("diff")), "feature").limit(most)


def feature_corr(ticks: DataFrame, outcomes: DataFrame, names: tuple[str, ...] = FEATURES, most: int = 15) -> DataFrame:
    """Means and deviations of features by window (baseline, early stress, all stress), and their correlation with winning.

    An episode without a value counts with the feature's median; the ``most`` largest differences stay.
    """
    tall = _tall(ticks, names)
    stress = F.col("phase") == "stress"
    windows = F.explode(F.array_compact(F.array(F.when(F.col("phase") == "baseline", F.lit("baseline")), F.when(stress, F.lit("stress")), F.when(stress & (F.col("_n") <= EARLY), F.lit("early_stress_60s"))))).alias("window")
    per = tall.select("episode_id", "feature", "x", windows).groupBy("episode_id", "feature", "window").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("std"))
    known = outcomes.where("outcome IN ('win', 'loss')").select("episode_id", (F.col("outcome") == "win").cast("double").alias("y"))
    each = per.select("episode_id", "feature", "window", F.expr("stack(2, 'mean', mean, 'std', std) AS (stat, x)"))
    sets = each.select("feature", "window", "stat").distinct()
    grid = known.crossJoin(F.broadcast(sets))  # three windows and two statistics of each feature
    full = grid.join(each, ["episode_id", "feature", "window", "stat"], "left")
    keys = ["feature", "window", "stat"]
    medians = counted_ranks(full.select(*keys, "x"), keys, (0.5,)).select(*keys, F.col("p50").alias("_median"))
    full = full.join(F.broadcast(medians), keys, "left")  # as few rows as sets
    win, loss = F.when(F.col("y") == 1, F.col("x")), F.when(F.col("y") == 0, F.col("x"))
    out = full.groupBy(*keys).agg(F.count(win).alias("wins"), F.count(loss).alias("losses"), F.avg(win).alias("win_mean"), F.avg(loss).alias("loss_mean"), F.corr(F.coalesce("x", "_median"), "y").alias("corr"))
    out = out.where("wins >= 2 AND losses >= 2").withColumn("diff", F.col("win_mean") - F.col("loss_mean"))
    return out.orderBy(F.desc(F.abs("diff")), F.desc("corr"), *keys).limit(most)


def episode_stats(episodes: DataFrame, metrics: tuple[str, ...] = ("mfe", "mae", "time_to_mfe_ms", "time_to_failure_ms")) -> DataFrame:
    """Least, median, 90th percentile, largest and mean of each metric, by session."""
    stacked = F.expr(f"stack({len(metrics)}, {', '.join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)}) AS (metric, x)")
    p = F.percentile("x", F.array(F.lit(0.5), F.lit(0.9)))
    out = episodes.select("session_id", stacked).where("x IS NOT NULL").groupBy("session_id", "metric").agg(F.min("x").alias("min"), p.alias("p"), F.max("x").alias("max"), F.avg("x").alias("mean"))
    return out.select("session_id", "metric", "min", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), "max", "mean")


def reports_index(episodes: DataFrame) -> DataFrame:
    """A session's episodes, its win rate of those won or lost, and typical excursions."""
    return episodes.groupBy(*KEY).agg(
        F.count("*").alias("episodes"), F.count(F.when(F.col("outcome") == "win", 1)).alias("wins"), F.count(F.when(F.col("outcome") == "loss", 1)).alias("losses"),
        F.percentile("mfe", F.lit(0.5)).alias("mfe_p50"), F.percentile("mae", F.lit(0.9)).alias("mae_p90"),
    ).withColumn("win_rate", F.try_divide("wins", F.col("wins") + F.col("losses")))


def shared_combos(index_by_session: DataFrame) -> DataFrame:
    """Combinations (session_id, combo) that every session has."""
    n = index_by_session.select("session_id").distinct().agg(F.count("*").alias("n"))
    found = index_by_session.groupBy("combo").agg(F.countDistinct("session_id").alias("sessions"))
    return found.join(n, F.col("sessions") == F.col("n")).select("combo", "sessions")


def dq_counts(kinds: dict[str, DataFrame]) -> DataFrame:
    """Rows and time range of each kind of table and session."""
    parts = [df.groupBy("session_id").agg(F.count("*").alias("rows"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts")).withColumn("kind", F.lit(k)) for k, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dq_nulls(df: DataFrame, names: list[str]) -> DataFrame:
    """The share of nulls of each column, a row a column, in one pass."""
    one = df.agg(*[F.avg(F.col(n).isNull().cast("double")).alias(n) for n in names])
    return one.select(F.expr(f"stack({len(names)}, {', '.join(f"'{n}', `{n}`" for n in names)}) AS (column, null_rate)"))


def counted_ranks(tall: DataFrame, keys: list[str], points: tuple[float, ...]) -> DataFrame:
    """min, max, mean, rows and percentiles (p50, ..., interpolated) of ``x`` for each of a few ``keys``.

    Values are counted first; each count is then placed among the ranks of its key by running
    sums over ranges of values, so no task holds a key's values.
    """
    counted = tall.where("x IS NOT NULL").groupBy(*keys, "x").agg(F.count("*").alias("n"))
    whole = counted.groupBy(*keys).agg(F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("rows"))
    ranged = counted.join(F.broadcast(whole.select(*keys, "min", "max")), keys)  # a row for each key: columns, pairs or features by name
    bins = F.least(F.lit(4095), F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("min"), F.col("max") - F.col("min")), F.lit(0.0)) * 4096)).cast("int")
    ranged = ranged.withColumn("_bin", bins)
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    by_bin = ranged.groupBy(*keys, "_bin").agg(F.sum("n").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, "_bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(by_bin.select(*keys, "_bin", "_before"), [*keys, "_bin"]).withColumn("_upto", F.sum("n").over(inside) + F.col("_before"))
    ranks = placed.join(F.broadcast(whole.select(*keys, "rows")), keys)
    picked = []
    for p in points:
        at = (F.col("rows") - 1) * p
        low, high = F.floor(at), F.ceil(at)
        begin, end = F.col("_upto") - F.col("n"), F.col("_upto") - 1
        value = [F.max(F.when((begin <= i) & (i <= end), F.col("x"))) for i in (low, high)]
        picked.append((value[0] + (value[1] - value[0]) * F.max(at - low)).alias(f"p{round(100 * p)}"))
    return whole.join(ranks.groupBy(*keys).agg(*picked), keys)


def dq_dists(df: DataFrame, names: list[str], points: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Least, largest, mean and percentiles (interpolated) of each column."""
    stacked = F.expr(f"stack({len(names)}, {', '.join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)}) AS (column, x)")
    return counted_ranks(df.select(stacked), ["column"], points).drop("rows")


def dq_value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Counts of the values of several columns in one pass."""
    tall = df.select(F.expr(f"stack({len(names)}, {', '.join(f"'{n}', CAST(`{n}` AS STRING)" for n in names)}) AS (column, value)"))
    return tall.groupBy("column", "value").agg(F.count("*").alias("n"))


def dq_cadence(ticks: DataFrame, part: list[str], step_ms: int = 10_000) -> DataFrame:
    """Distances between successive times of each part: extremes, percentiles, share of regular ones, gaps."""
    d = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy(*part).orderBy("ts_ms"))
    x = ticks.withColumn("d", d).where("d IS NOT NULL")
    return x.groupBy(*part).agg(
        F.min("d").alias("min"), F.percentile("d", F.lit(0.5)).alias("p50"), F.percentile("d", F.lit(0.9)).alias("p90"), F.max("d").alias("max"), F.avg((F.col("d") == step_ms).cast("double")).alias("regular"),
        F.count(F.when(F.col("d") > 20_000, 1)).alias("gaps_20s"), F.count(F.when(F.col("d") > 60_000, 1)).alias("gaps_60s"),
    )


def dq_sequence(ticks: DataFrame, part: list[str], order: str = "ts_ms", number: str = "sequence_id") -> DataFrame:
    """Whether the numbers of each part never fall in order of time, and how many repeat."""
    ok = F.coalesce(F.col(number) >= F.lag(number).over(Window.partitionBy(*part).orderBy(order)), F.lit(True))
    return ticks.withColumn("_ok", ok).groupBy(*part).agg(F.min("_ok").alias("monotonic"), (F.count("*") - F.countDistinct(number)).alias("duplicates"))


def dq_zone(ticks: DataFrame, part: list[str]) -> DataFrame:
    """Shares of ticks within a quarter and half an ATR of the level, and of those that diverge."""
    near = [F.avg((F.abs("signed_distance_atr") <= x).cast("double")).alias(n) for x, n in ((0.25, "share_25"), (0.5, "share_50"))]
    apart = [F.avg((F.col("divergence_flag") == 1).cast("double")).alias("share_divergent")] if "divergence_flag" in ticks.columns else []
    return ticks.groupBy(*part).agg(*near, *apart)


def dq_outliers(ticks: DataFrame, column: str, part: list[str], keep: list[str], most: int = 10) -> DataFrame:
    """The rows with the largest values of a column in each part."""
    w = Window.partitionBy(*part).orderBy(F.desc(column), *keep)
    return ticks.where(F.col(column).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*part, "rank", *keep, column)


#: Pairs of an episode's times whose distance should make sense.
TIMES = (("start_time", "zone_entry_time"), ("zone_entry_time", "zone_exit_time"), ("zone_entry_time", "resolution_time"), ("start_time", "end_time"))


def dq_time(episodes: DataFrame) -> DataFrame:
    """Least, median, 90th percentile and largest distance of the times of episodes, a row a pair."""
    pairs = [(a, b) for a, b in TIMES if a in episodes.columns and b in episodes.columns]
    stacked = F.expr(f"stack({len(pairs)}, {', '.join(f"'{a} to {b}', CAST({b} - {a} AS DOUBLE)" for a, b in pairs)}) AS (pair, x)")
    return counted_ranks(episodes.select(stacked), ["pair"], (0.5, 0.9)).select("pair", F.col("rows").alias("n"), "min", "p50", "p90", "max")


def dq_coverage(snapshots: DataFrame, stream: DataFrame) -> DataFrame:
    """Whether the snapshots of each session lie inside its stream."""
    a = snapshots.groupBy(*KEY).agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    b = stream.groupBy(*KEY).agg(F.min("ts_ms").alias("stream_first"), F.max("ts_ms").alias("stream_last"))
    inside = (F.col("first") >= F.col("stream_first")) & (F.col("last") <= F.col("stream_last"))
    return a.join(b, KEY, "left").withColumn("inside", F.coalesce(inside, F.lit(False)))


def dq_markers(found: DataFrame) -> DataFrame:
    """Marker episodes that lack their marker's id or time."""
    return found.agg(F.count("*").alias("rows"), F.count(F.when(F.col("marker_id").isNull(), 1)).alias("without_id"), F.count(F.when(F.col("marker_ts_ms").isNull(), 1)).alias("without_time"))


def dq_missing(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Keys that have input and no output."""
    return inputs.select(*KEY).distinct().join(outputs.select(*KEY).distinct(), KEY, "left_anti")


def minute_extremes(ticks: DataFrame) -> DataFrame:
    """High and low of a session's first and last six ticks, its peak, its low and the drop between."""
    up, down = Window.partitionBy(*KEY).orderBy("ts_ms"), Window.partitionBy(*KEY).orderBy(F.desc("ts_ms"))
    one = ticks.where("last_price IS NOT NULL").withColumn("_a", F.row_number().over(up)).withColumn("_z", F.row_number().over(down))
    first, last = F.col("_a") <= 6, F.col("_z") <= 6
    return one.groupBy(*KEY).agg(
        F.max(F.when(first, F.col("high_10s"))).alias("first_high"), F.min(F.when(first, F.col("low_10s"))).alias("first_low"), F.max(F.when(last, F.col("high_10s"))).alias("last_high"), F.min(F.when(last, F.col("low_10s"))).alias("last_low"),
        F.max("last_price").alias("peak"), F.min("last_price").alias("low"), (F.try_divide(F.max("last_price") - F.min("last_price"), F.max("last_price")) * 100).alias("drop_pct"),
    )
