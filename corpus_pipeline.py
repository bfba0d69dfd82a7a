"""A corpus from raw documents to packed sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``.

Every stage takes null ids and texts, empty texts, ties, repeated rows and further columns of
any name: rows that share an id are judged each on their own, but leave together where a stage
goes by id (decontamination); near-duplicate groups keep their least id, once. An empty table
gives an empty one. Columns of ``documents`` go through unchanged, but for ``text`` and
``n_chars`` where secrets are redacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelscope.llm import bin_packing, decontaminate, near_dedup, quality_classifier, secret_scan
from levelscope.llm.common import new_path, table
from levelscope.llm.encoding import vocabulary


#: Words that a worker keeps while it packs: executors have run four stages before.
PACKING_BYTES = 20_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from ``labels``, doesn't reject."""
    return quality_classifier.accepted(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8."""
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold an item of ``benchmark``."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets redacted and ``n_chars`` counted anew."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return bin_packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 0, most_bytes=PACKING_BYTES)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secrets),
    ("packing", packing),
]

#: Tokenizers and the classifier can't be expressed in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
