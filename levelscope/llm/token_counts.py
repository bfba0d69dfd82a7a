"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A store is a folder with two tables, each with a subfolder for every committed batch:

* ``ledger``: signed rows a document, +1 / +tokens for what a batch adds and -1 / -tokens
  for what it takes away, so a document's present state is the sum of its rows;
* ``rollup``: the batch's ledger rows summed by (source, lang, tokenizer).

Totals are the sum of all batches' rollups: additive, never recounted. Committing a batch
again under its id changes nothing: a batch whose rollup is complete is skipped, and one
that was lost half-way is written anew over what it left, from the ledger of the others.

A batch has rows (doc_id, tokenizer, op, source, lang, n_tokens, seq): ``upsert`` states a
document's present count, whether it is new or revised; ``delete`` takes it out. Per
(doc_id, tokenizer) the row with the highest seq counts, of ties the largest by op, source,
lang and count. Deleting what isn't there changes nothing. Nulls: a null key is a key of
its own; a null count is 0; a null source or lang is a group of its own; a row with a null
op is ignored. Other columns are ignored. An empty batch commits and adds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder, slices

KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, tokenizer string, source string, lang string, d_docs long, d_tokens long"
ROLLUP = "source string, lang string, tokenizer string, d_docs long, d_tokens long"


def count_tokens(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """doc_id, source, lang and n_tokens, by the tokenizers library over whole texts."""

    def counted(batches):
        own = encoder(vocabulary_file)
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(np.diff(own.encode(part)[1]) for part in slices(batch.column("text")))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])
        own.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text").mapInArrow(counted, "doc_id long, source string, lang string, n_tokens long")


class TokenCounts:
    """A store of token totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, kind: str, schema: str, other_than: str | None = None) -> DataFrame:
        batches = [b for b in self.batches() if b != other_than]
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{b}" for b in batches])

    def batches(self) -> list[str]:
        """Ids of the committed batches: those whose rollup was written whole."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rollup")
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        found = [x.getPath() for x in files.listStatus(where)]
        return sorted(x.getName() for x in found if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been applied before."""
        if not batch_id.replace("-", "").replace("_", "").isalnum() or batch_id.startswith("_"):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self.batches():
            return False
        latest = F.max(F.struct("seq", "op", "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))).alias("last")
        wanted = changes.where(F.col("op").isin("upsert", "delete")).groupBy(*KEY).agg(latest)
        a, b = self._table("ledger", LEDGER, batch_id).alias("a"), wanted.select(*KEY).alias("b")
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.tokenizer").eqNullSafe(F.col("b.tokenizer"))
        # only the batch's own keys are summed, not the ledger
        state = a.join(b, same, "left_semi").groupBy(*KEY, "source", "lang").agg(F.sum("d_docs").alias("docs"), F.sum("d_tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
        taken = state.select(*KEY, "source", "lang", (-F.col("docs")).alias("d_docs"), (-F.col("tokens")).alias("d_tokens"))
        added = wanted.where("last.op = 'upsert'").select(*KEY, "last.source", "last.lang", F.lit(1).cast("long").alias("d_docs"), F.col("last.n_tokens").alias("d_tokens"))
        signed = taken.unionByName(added).groupBy(*KEY, "source", "lang").agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).where("d_docs <> 0 OR d_tokens <> 0")
        signed.select("doc_id", "tokenizer", "source", "lang", "d_docs", "d_tokens").write.mode("overwrite").parquet(f"{self.path}/ledger/{batch_id}")
        ledger = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/{batch_id}")
        rollup = ledger.groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        rollup.write.mode("overwrite").parquet(f"{self.path}/rollup/{batch_id}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens of the documents present."""
        sums = self._table("rollup", ROLLUP).groupBy(*GROUP).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")
