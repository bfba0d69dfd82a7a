"""What the training-data operators share: tables, shared folders, words."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the text contracts: all but the space and the five ASCII controls from tab on.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (tests, a single machine) a new folder is made once
    for the application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Remove a table that ``written`` made and nothing reads any more; any other frame is left alone."""
    path = getattr(df, "_written_path", None)
    if path is not None:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, for lambdas that read it per element."""
    return F.transform(F.array(value), use)[0]


def word_bytes(text: str | None) -> list[bytes]:
    """Words with A-Z lowered, as UTF-8: bytes.split and bytes.lower know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in turn."""
    words = word_bytes(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


MULTIPLIER = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))
