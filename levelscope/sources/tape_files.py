"""Tapes from files: recorded Parquet or CSV, and two vendors' JSON messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import exchange_date, normal_conditions
from ..schemas import COMMANDS

TRADE_COLUMNS = {"ts_ms": "long", "symbol": "string", "price": "double", "size": "double"}
QUOTE_COLUMNS = {"ts_ms": "long", "symbol": "string", "bid": "double", "bid_size": "double", "ask": "double", "ask_size": "double"}


def _scan(spark: SparkSession, path: str, fmt: str, columns: dict[str, str]) -> DataFrame:
    df = spark.read.option("header", "true").csv(path) if fmt == "csv" else spark.read.parquet(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.withColumns({c: F.col(c).cast(t) for c, t in columns.items()})


def scan_trades(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    df = _scan(spark, path, fmt, TRADE_COLUMNS)
    if "conditions" not in df.columns:
        return df.select(*TRADE_COLUMNS, F.array().cast("array<string>").alias("conditions"))
    kind = dict(df.dtypes)["conditions"]
    conditions = F.coalesce("conditions", F.array().cast(kind)).cast("array<string>") if kind.startswith("array") else normal_conditions(F.col("conditions"))
    return df.select(*TRADE_COLUMNS, conditions.alias("conditions"))


def scan_quotes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, path, fmt, QUOTE_COLUMNS).select(*QUOTE_COLUMNS)


def range_scan(df: DataFrame, symbol: str, start: int, end: int) -> DataFrame:
    """One symbol's rows from ``start`` to ``end``, both included."""
    return df.where((F.col("symbol") == symbol) & F.col("ts_ms").between(start, end))


def iso_ms(text: Column) -> Column:
    """Epoch ms of an ISO time in UTC with up to nanoseconds, of which microseconds count, cut to whole ms."""
    return F.unix_millis(F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{1,6})\d*", "$1")))


def vendor_a(lines: DataFrame, symbol: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Trades and quotes of JSON lines (column ``value``) with fields T, S, t (ISO time), p, s, c / bp, bs, ap, as.

    Names differ by case alone, so fields are taken from the text. A line may be one message or
    an array of them. Without T a message with a bid is a quote; without S ``symbol`` holds.
    """
    array = F.from_json("value", "array<string>")
    one = lines.select(F.explode(F.when(F.startswith(F.ltrim("value"), F.lit("[")), array).otherwise(F.array("value"))).alias("value"))

    def field(name: str, kind: str = "double") -> Column:
        return F.get_json_object("value", f"$.{name}").cast(kind)

    is_quote = F.coalesce(field("T", "string"), F.when(field("bp").isNotNull(), "q").otherwise("t"))
    base = one.select("value", is_quote.alias("_kind"), iso_ms(field("t", "string")).alias("ts_ms"), (F.lit(symbol) if symbol else field("S", "string")).alias("symbol"))
    conditions = F.coalesce(F.from_json(field("c", "string"), "array<string>"), F.array().cast("array<string>"))
    trades = base.where("_kind = 't'").select("ts_ms", "symbol", field("p").alias("price"), field("s").alias("size"), conditions.alias("conditions"))
    quotes = base.where("_kind = 'q'").select("ts_ms", "symbol", field("bp").alias("bid"), field("bs").alias("bid_size"), field("ap").alias("ask"), field("as").alias("ask_size"))
    return trades, quotes


def vendor_b(rows: DataFrame, symbol: str, kind: str = "trade") -> tuple[DataFrame, DataFrame]:
    """Rows of the second vendor in the tape's schema, and those that lack a field.

    The first time stamp that is there counts; one in nanoseconds is brought to milliseconds.
    """
    def first(*names: str):
        there = [F.col(n) for n in names if n in rows.columns]
        return F.coalesce(*there) if there else F.lit(None)

    ts = first("sip_timestamp", "participant_timestamp", "timestamp", "t").cast("long")
    exact = F.expr(f"IF(_ts >= {10**15}, _ts div 1000000, _ts)")
    base = rows.withColumn("_ts", ts).withColumn("ts_ms", exact).withColumn("symbol", F.lit(symbol))
    if kind == "trade":
        out = {"price": ("price", "p"), "size": ("size", "s")}
    else:
        out = {"bid": ("bid_price", "bp", "bid"), "bid_size": ("bid_size", "bs"), "ask": ("ask_price", "ap", "ask"), "ask_size": ("ask_size", "as")}
    typed = base.withColumns({f"_{k}": first(*v).cast("double") for k, v in out.items()})
    whole = F.col("ts_ms").isNotNull()
    for k in out:
        whole = whole & F.col(f"_{k}").isNotNull()
    return typed.where(whole).select("ts_ms", "symbol", *[F.col(f"_{k}").alias(k) for k in out]), typed.where(~whole).select(*rows.columns)


def write_tape(df: DataFrame, path: str, order: tuple[str, ...] = ("ts_ms",), compression: str = "zstd") -> None:
    """A normalised tape as files by exchange date and symbol, each in order of time."""
    dated = df.withColumn("date", exchange_date(F.col("ts_ms")))
    dated.repartition("date", "symbol").sortWithinPartitions("date", "symbol", *order).write.partitionBy("date", "symbol").option("compression", compression).parquet(path)


LEVEL_FIELDS = {"level_id": "string", "level_price": "double", "level_type": "string", "level_source": "string"}
COMMAND_FIELDS = {"ts_ms": "long", "ticker": "string", "type": "string"}
COMMAND_KINDS = {"add_level": ("level_price", "level_type"), "add_marker": ("marker_type",)}


def load_levels(spark: SparkSession, path: str, fmt: str = "json", ticker: str | None = None) -> DataFrame:
    """Levels from JSON, CSV or Parquet rows (``ticker`` and the fields of a level); width and creation time have defaults.

    Raises if a needed column or value is missing, or if a ticker other than ``ticker`` is there.
    """
    reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    if missing := [c for c in ("ticker", *LEVEL_FIELDS) if c not in df.columns]:
        raise ValueError(f"levels lack {', '.join(missing)}")
    optional = {"level_width_atr": ("double", 0.25), "created_ts_ms": ("long", 0), "notes": ("string", None)}
    columns = [F.col(c).cast(t).alias(c) for c, t in LEVEL_FIELDS.items()]
    columns += [F.coalesce(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t), F.lit(d).cast(t)).alias(c) for c, (t, d) in optional.items()]
    out = df.select(F.trim("ticker").alias("ticker"), *columns)
    wrong = F.coalesce(F.col("ticker"), F.lit("")) == ""
    for c in LEVEL_FIELDS:
        wrong = wrong | F.col(c).isNull()
    if ticker is not None:
        wrong = wrong | (F.col("ticker") != ticker)
    if bad := out.where(wrong).take(1):
        raise ValueError(f"not a level of {ticker or 'a ticker'}: {bad[0].asDict()}")
    return out


def load_commands(spark: SparkSession, path: str) -> DataFrame:
    """Commands from CSV in their schema, with ``seq`` for the order of arrival at equal times.

    Raises on an unknown type and on a row that lacks what its type needs. CSV files are split,
    so arrival is the order of lines in the file that Spark reads: (file, position).
    """
    df = spark.read.option("header", "true").option("escape", '"').csv(path)  # quotes inside fields are doubled
    if missing := [c for c in COMMAND_FIELDS if c not in df.columns]:
        raise ValueError(f"commands lack {', '.join(missing)}")
    want = spark.createDataFrame([], COMMANDS).schema
    typed = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want], F.monotonically_increasing_id().alias("seq"))
    typed = typed.withColumn("level_width_atr", F.when(F.col("type") == "add_level", F.coalesce("level_width_atr", F.lit(0.25))))
    wrong = ~F.col("type").isin(*COMMAND_KINDS) | F.col("type").isNull() | F.col("ts_ms").isNull() | F.col("ticker").isNull()
    for kind, needed in COMMAND_KINDS.items():
        for c in needed:
            wrong = wrong | ((F.col("type") == kind) & F.col(c).isNull())
    if bad := typed.where(wrong).take(1):
        raise ValueError(f"not a command: {bad[0].asDict()}")
    return typed
