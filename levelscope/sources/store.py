"""Tables by kind, date, ticker and session: writing, replacing, reading and listing them."""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import exchange_date

KINDS = ("snapshots", "episodes", "tf_indicators", "session_stream", "markers")
PARTITION = ["date", "ticker", "session"]
#: Stored names that differ from the columns'.
ALIASES = {"pct_at_ask": "%_at_ask", "pct_at_bid": "%_at_bid"}


def scratch(spark: SparkSession) -> str:
    """A new folder on what driver and executors share: the checkpoint folder, or the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/levelscope-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and read again from a new folder: for what several operators build on."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, ts: str) -> DataFrame:
    """``df`` under its stored names, with the partition columns."""
    named = df.withColumnsRenamed({k: v for k, v in ALIASES.items() if k in df.columns})
    return named.withColumn("date", exchange_date(F.col(ts))).withColumn("ticker", F.col("symbol")).withColumn("session", F.col("session_id"))


def write(df: DataFrame, path: str, kind: str, ts: str = "ts_ms", replace: bool = False, compression: str = "zstd") -> None:
    """Append ``df`` to a kind, or replace the partitions that it has rows of.

    Rows of a partition meet in one task a partition and date, so files stay few.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    out = stored(df, ts).repartition(*PARTITION)
    writer = out.write.partitionBy(*PARTITION).option("compression", compression).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if replace else "append").parquet(f"{path}/{kind}")


def read(spark: SparkSession, path: str, kind: str, date: str | None = None, ticker: str | None = None, session: str | None = None, episode: str | None = None, order: str | None = None) -> DataFrame:
    """A kind's rows; date, ticker and session prune partitions, an episode is pushed to the scan.

    With ``order`` rows whose time isn't a number are left out and the rest is sorted by it.
    """
    df = spark.read.parquet(f"{path}/{kind}")
    for name, value in (("date", date), ("ticker", ticker), ("session", session), ("episode_id", episode)):
        if value is not None:
            df = df.where(F.col(name) == value)
    df = df.withColumnsRenamed({v: k for k, v in ALIASES.items() if v in df.columns})
    if order is not None:
        df = df.withColumn(order, F.expr(f"try_cast({order} AS BIGINT)")).where(F.col(order).isNotNull()).orderBy(*PARTITION, order)
    return df


MANIFEST = "_manifest"
ENTRY = "date string, ticker string, session string, version string, published_ms long, kinds array<string>"


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _folder(spark, path)
    return system.exists(where)


def publish(frames: dict[str, tuple[DataFrame, str]], path: str, compression: str = "zstd") -> str:
    """Write several kinds (frame and time column of each) as a new version of their sessions, seen all together.

    The tables are written to folders of the version first, then one file of the manifest names
    it for every session that any kind has rows of. Until that file is there readers see the
    sessions as they were before; a publication that fails leaves nothing that is read.
    """
    version = f"v{uuid.uuid4().hex}"
    spark = next(iter(frames.values()))[0].sparkSession
    named = []
    for kind, (df, ts) in frames.items():
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        out = stored(df, ts).withColumn("version", F.lit(version)).repartition(*PARTITION)
        out.write.partitionBy("version", *PARTITION).option("compression", compression).mode("append").parquet(f"{path}/{kind}")
        if exists(spark, f"{path}/{kind}/version={version}"):
            named.append(_partitions(spark, f"{path}/{kind}/version={version}").withColumn("kind", F.lit(kind)))
    if named:
        sessions = reduce(DataFrame.unionByName, named).groupBy(*PARTITION).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
        entry = sessions.select(*PARTITION, F.lit(version).alias("version"), F.unix_millis(F.current_timestamp()).alias("published_ms"), "kinds")
        entry.coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")  # a row a session; one file is there or isn't
    return version


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The version of each session that counts, as of now: keep this frame (``kept``) to read several kinds at one moment."""
    if not exists(spark, f"{path}/{MANIFEST}"):
        return spark.createDataFrame([], ENTRY)
    every = spark.read.schema(ENTRY).parquet(f"{path}/{MANIFEST}")
    last = F.max_by(F.struct("version", "published_ms", "kinds"), F.struct("published_ms", "version")).alias("m")
    return every.groupBy(*PARTITION).agg(last).select(*PARTITION, "m.version", "m.published_ms", "m.kinds")


def read_published(spark: SparkSession, path: str, kind: str, at: DataFrame | None = None) -> DataFrame:
    """A kind's rows of the versions that count, now or as of the manifest ``at``.

    Versions and partitions are folders, so that those of other versions aren't read.
    """
    versions = (manifest(spark, path) if at is None else at).where(F.array_contains("kinds", kind)).select(*PARTITION, "version")
    df = spark.read.parquet(f"{path}/{kind}")
    df = df.withColumns({c: F.col(c).cast("string") for c in (*PARTITION, "version")})
    return df.join(versions, [*PARTITION, "version"], "left_semi").withColumnsRenamed({v: k for k, v in ALIASES.items() if v in df.columns})


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the versions that no session counts any more; returns how many. Not while older manifests are read."""
    live = {r["version"] for r in manifest(spark, path).select("version").distinct().collect()}  # a name a publication in force
    gone = 0
    for kind in KINDS:
        where, system = _folder(spark, f"{path}/{kind}")
        for found in system.listStatus(where) if system.exists(where) else ():
            name = found.getPath().getName()
            if name.startswith("version=") and name[8:] not in live:
                system.delete(found.getPath(), True)
                gone += 1
    return gone


def _partitions(spark: SparkSession, path: str) -> DataFrame:
    """The partitions of a stored table by the names of its folders, as the file index lists them: no file is read."""
    files = spark.read.parquet(path).inputFiles()
    folders = {f.rsplit("/", 1)[0] for f in files}
    values = {tuple(dict(x.split("=", 1) for x in unquote(d).split("/") if "=" in x).get(c) for c in PARTITION) for d in folders}
    return spark.createDataFrame(sorted(v for v in values if None not in v), "date string, ticker string, session string")


def list_sessions(spark: SparkSession, path: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Sessions that any kind has, the latest first: from the manifest, or else from the names of folders.

    Either way no data is read.
    """
    if exists(spark, f"{path}/{MANIFEST}"):
        found = [manifest(spark, path).where(F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in kinds]))).select(*PARTITION)]
    else:
        found = [_partitions(spark, f"{path}/{k}") for k in kinds if exists(spark, f"{path}/{k}")]
    if not found:
        return spark.createDataFrame([], "date string, ticker string, session string")
    return reduce(DataFrame.unionByName, found).distinct().orderBy(F.desc("date"), F.desc("session"), "ticker")


def drift_read(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Files whose schemas have drifted (missing or null columns), cast to one schema."""
    want = spark.createDataFrame([], schema).schema
    parts = []
    for p in paths:
        df = spark.read.parquet(p)
        parts.append(df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]))
    return reduce(DataFrame.unionByName, parts)


REPORTS = "reports"


def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    """A nested document a session as JSON, by date and ticker; ``reports`` has PARTITION columns and a struct ``report``."""
    document = F.to_json("report", {"ignoreNullFields": "false"})
    out = reports.select("date", "ticker", F.to_json(F.struct("session", document.alias("report"))).alias("value"))
    out.repartition("date", "ticker").write.partitionBy("date", "ticker").option("partitionOverwriteMode", "dynamic").mode(mode).text(f"{path}/{REPORTS}")


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports by ``schema`` (of the document); lines that aren't one are skipped."""
    lines = spark.read.text(f"{path}/{REPORTS}")
    outer = F.from_json("value", "session string, report string")
    inner = lines.select("date", "ticker", outer.alias("o")).select("date", "ticker", "o.session", F.from_json("o.report", schema).alias("report"))
    return inner.where("session IS NOT NULL AND report IS NOT NULL")


def without_report(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """Sessions that have no report yet."""
    key = ["ticker", "session"]
    return sessions.join(reports.select(*key).distinct(), key, "left_anti")
