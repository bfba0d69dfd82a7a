"""Token ids on disk: documents in id order, coded in independent blocks, and their reader.

The file format is a Parquet dataset with one row per block: ``part`` and ``block`` give
the order, ``part_start`` the ids before it in its part, ``docs`` the documents that have
ids in it (doc_id, row, ids of the document before the block, ids here, ids in all) and
``payload`` a coded block of :mod:`range_coder`. Spark's commit protocol makes the files
appear whole or not at all, on any store that it can write to.

Blocks hold up to ``block_ids`` ids: two millions, so that the lanes of one have much to learn from each other. A document that fits in one isn't split; a longer one
starts a block of its own and runs over as many as it needs.

Nulls and ties: a null text is empty; every document has at least its end id. Rows that
repeat a doc_id are kept, next to each other, ordered by text. A null doc_id comes first.
Columns other than those named are ignored. An empty table gives an empty dataset.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import range_coder
from .common import new_path
from .encoding import encoder

BLOCK_IDS = 1 << 21
#: Ids of the blocks that a task codes side by side; bounds its memory. A step costs nearly as much for a few short
#: blocks as for all, so tasks hold up to twice as many and take blocks of like length together, the longest first.
IDS_AT_ONCE = 1 << 22
#: Bytes of a row group, and after how many rows Parquet looks again how many it has: blocks are large rows.
GROUP_BYTES, LOOK_AFTER = 16 << 20, 4
#: Bytes of known words that a worker keeps within a task and from one to the next: the coder leaves room for many,
#: and every second word that a task would have to encode anew was in the one before.
CACHED_BYTES, RESTING_BYTES = 80_000_000, 40_000_000
BLOCKS = "part int, block long, part_start long, n_ids long, docs array<struct<doc_id: long, row: long, before: long, here: long, n_tokens: long>>, payload binary"
FRAGMENT = "part int, doc_id long, row long, part_start long, before long, n_tokens long, ids binary, ids_crc32 long"


def coded_blocks(batches, part: int, vocabulary_file: str, end_id: int, block_ids: int = BLOCK_IDS, lanes: int | None = None):
    """A part's documents (pandas, in order) as rows of blocks, up to ``lanes`` coded side by side."""
    lanes = lanes or max(1, IDS_AT_ONCE // block_ids)
    end, own_encoder = np.array([end_id], "<u4").tobytes(), encoder(vocabulary_file, CACHED_BYTES)
    pending, full, state = [], [], {"block": 0, "start": 0, "row": 0, "size": 0}

    def close():
        if pending:
            full.append((state["block"], state["start"], state["size"], [x[0] for x in pending], b"".join(x[1] for x in pending)))
            state["block"] += 1
            state["start"] += state["size"]
            pending.clear()
            state["size"] = 0

    def coded():
        full.sort(key=lambda b: -b[2])
        own = full[:lanes]
        del full[:lanes]
        payloads = range_coder.encode_blocks([np.frombuffer(b[4], "<u4") for b in own])
        rows = [(part, *b[:4], payload) for b, payload in zip(own, payloads, strict=True)]
        return pd.DataFrame(rows, columns=["part", "block", "part_start", "n_ids", "docs", "payload"])

    for batch in batches:
        for doc_id, ids in zip(batch["doc_id"], own_encoder.many(batch["text"]), strict=True):
            ids += end
            total = len(ids) // 4
            if state["size"] + total > block_ids:
                close()
            for before in range(0, total, block_ids):
                piece = ids[4 * before : 4 * (before + block_ids)]
                here = len(piece) // 4
                pending.append(({"doc_id": None if pd.isna(doc_id) else int(doc_id), "row": state["row"], "before": before, "here": here, "n_tokens": total}, piece))
                state["size"] += here
                if total > block_ids:
                    close()
            state["row"] += 1
            while len(full) >= 2 * lanes:
                yield coded()
    close()
    while full:
        yield coded()
    own_encoder.rest(RESTING_BYTES)


def write_ids(docs: DataFrame, path: str, vocabulary_file: str, end_id: int, block_ids: int = BLOCK_IDS, lanes: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each and write the blocks to ``path``."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches):
        yield from coded_blocks(batches, TaskContext.get().partitionId(), vocabulary_file, end_id, block_ids, lanes)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInPandas(blocks, BLOCKS).write.option("parquet.block.size", GROUP_BYTES)
    for kind in ("page", "block"):
        writer = writer.option(f"parquet.{kind}.size.row.check.min", LOOK_AFTER)
    writer.parquet(path)


def read_fragments(spark: SparkSession, path: str, having: Column | None = None, digests: bool = False) -> DataFrame:
    """Runs of ids within one block, decoded; each block's checksums are verified. ``having`` picks blocks before that.

    With ``digests``, a document that isn't split has the crc32 of its decoded ids in the ids' place.
    """

    def decoded(batches):
        for batch in batches:
            batch = batch.sort_values("n_ids", ascending=False, kind="stable")
            begun = np.cumsum(batch["n_ids"].to_numpy()) - batch["n_ids"].to_numpy()
            for _, part in batch.groupby(begun // IDS_AT_ONCE):
                rows = []
                for b, ids in zip(part.itertuples(), range_coder.decode_blocks(list(part["payload"])), strict=True):
                    offset = 0
                    for d in b.docs:
                        own = ids[offset : offset + d["here"]].astype("<u4", copy=False)
                        held = (None, zlib.crc32(own)) if digests and d["here"] == d["n_tokens"] else (own.tobytes(), None)
                        rows.append((b.part, d["doc_id"], d["row"], b.part_start + offset, d["before"], d["n_tokens"], *held))
                        offset += d["here"]
                out = pd.DataFrame(rows, columns=["part", "doc_id", "row", "part_start", "before", "n_tokens", "ids", "ids_crc32"])
                for c in ("doc_id", "ids_crc32"):
                    out[c] = out[c].astype("Int64")
                yield out

    blocks = spark.read.schema(BLOCKS).parquet(path)
    return (blocks if having is None else blocks.where(having)).mapInPandas(decoded, FRAGMENT)


def read_documents(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32).

    With ``digests``, ids_crc32 in the place of ids: the workers that decode them send no more than that.
    Only documents that run over several blocks are shuffled to be put together.
    """
    more, last = ({"digests": True}, "ids_crc32") if digests else ({}, "ids")
    totals = spark.read.schema(BLOCKS).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each part file
    starts, before = [], 0
    for t in totals:
        starts.append((t["part"], before))
        before += t["n"]
    parts = spark.createDataFrame(starts, "part int, part_begins long")
    # a block holds whole documents or a run of one that is split, so that each is decoded by one of the two
    whole = read_fragments(spark, path, F.exists("docs", lambda d: d["here"] == d["n_tokens"]), **more).select("part", "doc_id", "part_start", "n_tokens", last)

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("before")
        ids = b"".join(group["ids"])
        return group.head(1)[["part", "doc_id", "part_start", "n_tokens"]].assign(**{last: zlib.crc32(ids) if digests else ids})

    split = read_fragments(spark, path, F.exists("docs", lambda d: d["here"] < d["n_tokens"]), **more)
    split = split.groupBy("part", "row").applyInPandas(joined, f"part int, doc_id long, part_start long, n_tokens long, {last} {'long' if digests else 'binary'}")
    return whole.unionByName(split).join(F.broadcast(parts), "part").select("doc_id", (F.col("part_begins") + F.col("part_start")).alias("start"), "n_tokens", last)


def written_and_read(docs: DataFrame, vocabulary_file: str, end_id: int) -> DataFrame:
    """The documents as read back from a new dataset in the shared folder, with ids_crc32."""
    path = new_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, vocabulary_file, end_id)
    return read_documents(docs.sparkSession, path, digests=True)
