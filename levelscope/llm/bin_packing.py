"""Packing documents into sequences of at most ``capacity`` tokens by minimum bin slack.

Documents are encoded once and cut into pieces; only documents longer than a sequence are
cut. Which lengths share a sequence depends on nothing but how many pieces there are of
each length, a table of at most ``capacity`` rows at any size of the corpus. On that table
the driver fills one sequence after another: it takes the longest piece left, finds by a
bitset subset-sum over the lengths left the fullest feasible rest, and removes the
combination. As long as its lengths last, the same combination is the fullest again, so it
is taken as many times at once as its lengths allow. Spark then deals out the pieces: the
k-th piece of a length goes to the sequence that took the k-th of that length.

Nulls and ties: a null text is empty and still has its end id. Pieces of equal length are
interchangeable; rows that repeat a doc_id are packed each on their own. Other columns of
the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .encoding import CACHED_BYTES, encoder, slices

#: Groups that the pieces of one length are numbered in, at least; as many as twice the shuffle partitions.
SALTS = 256
PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, vocabulary_file: str, end_id: int, capacity: int, with_ids: bool = False, most_bytes: int = CACHED_BYTES) -> DataFrame:
    """Each document's pieces in order; with_ids adds the ids as little-endian uint32 bytes."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches):
        encode = encoder(vocabulary_file, most_bytes)
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                ids, ends = encode.encode(part)
                data, lengths = ids.astype("<u4").tobytes(), np.diff(ends) + 1  # with the end id
                counts = -(-lengths // capacity)
                doc = np.repeat(np.arange(len(part)), counts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(lengths[doc] - start, capacity)
                low = 4 * (ends[:-1][doc] + start)
                high = low + 4 * length
                last = start + length == lengths[doc]
                own = [data[a : b - 4] + end if x else data[a:b] for a, b, x in zip(low.tolist(), high.tolist(), last.tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(at + doc)), pa.array(piece), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, own), pa.int64())]
                columns += [pa.array(own, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids)])
                at += len(part)
        encode.rest()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(pieces, PIECES + ", ids binary" * with_ids).withColumn("piece", F.col("piece").cast("int"))


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """The combination of lengths with the largest sum up to ``room``, as (index, how many).

    Bit s of the bitset says that the lengths so far can sum to s. Long lengths come first,
    so that of equally full combinations one with few pieces is found.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        if length > room:
            continue
        left, times = min(count, room // length), 1
        while left:  # multiples by doubling
            take = min(times, left)
            grown = reach | reach << length * take & mask
            if grown != reach:
                steps.append((k, take, reach))
                reach = grown
            left -= take
            times *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for k, take, before in reversed(steps):
        if not before >> total & 1:
            total -= lengths[k] * take
            chosen[k] = chosen.get(k, 0) + take
    return sorted(chosen.items())


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """All sequences as (how many alike, [(length, how many of it in each), ...])."""
    lengths = sorted(counts, reverse=True)
    left = [counts[x] for x in lengths]
    packed = []
    while lengths:
        left[0] -= 1
        rest = fullest(lengths, left, capacity - lengths[0])
        left[0] += 1
        inside = dict(rest)
        inside[0] = inside.get(0, 0) + 1
        times = min(left[k] // n for k, n in inside.items())
        packed.append((times, [(lengths[k], n) for k, n in sorted(inside.items())]))
        for k, n in inside.items():
            left[k] -= n * times
        kept = [k for k, n in enumerate(left) if n]
        lengths, left = [lengths[k] for k in kept], [left[k] for k in kept]
    return packed


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) plus sequence_id and offset.

    The input must be a stored table: it is read once to count and once to deal out.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(SALTS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    by_part = pieces.groupBy("_part", "length").agg(F.count("*").alias("n"))
    tally = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    if any(x > capacity or x < 1 for x in tally):
        raise ValueError("a piece doesn't fit a sequence")
    runs: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in tally}
    used, sequence = dict.fromkeys(tally, 0), 0
    for times, inside in minimum_slack(tally, capacity):
        offset = 0
        for length, n in inside:
            runs[length].append((used[length], n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    plan = spark.sparkContext.broadcast({x: ([r[0] for r in y], y) for x, y in runs.items()})  # bounded by capacity, not by rows

    def deal(batches):
        for batch in batches:
            where = []
            for length, rank in zip(batch["length"], batch["_rank"], strict=True):
                begins, own = plan.value[length]
                first, n, seq, offset = own[bisect_right(begins, rank) - 1]
                where.append((seq + (rank - first) // n, offset + (rank - first) % n * length))
            placed = pd.DataFrame(where, columns=["sequence_id", "offset"], index=batch.index, dtype="int64")
            yield pd.concat([batch.drop(columns="_rank"), placed], axis=1)

    names = [f for f in pieces.schema.fields if f.name != "_part"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", sequence_id long, offset long"
    return ranked(pieces, by_part).select(*[f.name for f in names], "_rank").mapInPandas(deal, schema)


def ranked(pieces: DataFrame, by_part: DataFrame) -> DataFrame:
    """``_rank``: 0, 1, 2 ... within each length, without bringing a length to one task."""
    from pyspark.sql import Window

    before = by_part.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("_part", "length").orderBy("doc_id", "piece")) - 1
    return pieces.withColumn("_own", own).join(before, ["_part", "length"]).withColumn("_rank", F.col("_before") + F.col("_own"))


def pack_documents(docs: DataFrame, vocabulary_file: str, end_id: int, capacity: int = 2048, most_bytes: int = CACHED_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; a worker keeps ``most_bytes`` of words."""
    return pack(written(cut(docs, vocabulary_file, end_id, capacity, most_bytes=most_bytes), "pieces"), capacity)
