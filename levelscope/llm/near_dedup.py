"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signatures: each word shingle is hashed into 0 .. 2^32 - 1. A first permutation of that
range shuffles the shingles; coordinate k is the least value of a second permutation at the
shuffled places shifted round by k. Two permutations so give all coordinates. Both are
bijective integer mixers, so no table is kept.

Documents with the same shingle set are one class, compared through its representative.
Classes that share a band are candidates. Within a bucket each class is first compared with
the bucket's least one, on the full sets, and then with others of it, a different one in
each bucket; linked classes become components. A large group of copies so costs a few
comparisons a class and not one a pair. Where a bucket still holds classes of different
components, an exact prefix filter over their shingles finds those that can be linked yet,
and all of these are compared: no link between different components is left out.

Nulls and ties: a null or wordless text has no shingles and is linked with nothing. Rows
that repeat a doc_id count as one document with all their links. A null doc_id is returned
with itself (null) as its component and takes part in nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MULTIPLIER, drop_written, mix, word_hashes, written
from .components import components

BANDS, ROWS = 32, 5
#: Rows of 40 bytes that may be broadcast: some 10 MB.
BROADCAST_ROWS = 200_000
SIGNED = "doc_id long, text_hash long, n_shingles long, class binary, bands array<long>"
#: Times that a bucket's unlinked classes are compared with one of them.
STAR_ROUNDS = 3



def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of a shorter text, one of all."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * MULTIPLIER + h[k : k + n])
    return np.unique(out)


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(sets: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of one set of 64-bit shingle hashes."""
    places = _permute((sets >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), 512):  # a slice that stays in the cache
        values = _permute(places[None, at : at + 512] + shifts, 0x21F0AAAD, 0xD35A2D97)
        np.minimum(out, values.min(axis=1), out=out)
    return out


def sign(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, class (hash of the set) and one hash a band; nothing else is kept."""
    number = np.arange(bands, dtype=np.uint64)

    def signed(batches):
        for batch in batches:
            out = []
            for doc_id, text, key in zip(batch["doc_id"], batch["text"], batch["text_hash"], strict=True):
                s = shingles(text, size)
                if not len(s):
                    out.append((doc_id, key, 0, None, None))
                    continue
                grid = signature(s, bands * rows).reshape(bands, rows).astype(np.uint64)
                h = number.copy()
                for k in range(rows):
                    h = mix(h * MULTIPLIER + grid[:, k])
                out.append((doc_id, key, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), h.view(np.int64)))
            frame = pd.DataFrame(out, columns=["doc_id", "text_hash", "n_shingles", "class", "bands"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.mapInPandas(signed, SIGNED)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The links (u, v) of those pairs of classes whose full sets reach ``percent`` Jaccard similarity."""

    def linked(batches):
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for a, x, y in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
                if last[0] != a:
                    last = (a, shingles(x, size))
                s, t = last[1], shingles(y, size)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.loc[keep, ["u", "v"]]

    one = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "u", "v", "text_a", "text_b").mapInPandas(linked, "u long, v long")


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class and text for ``wanted`` (class, doc_id, text_hash); a small ``wanted`` is broadcast."""
    wanted = written(wanted, "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    found = docs.join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).select("class", "text")
    return found.groupBy("class").agg(F.first("text").alias("text"))


def _centre() -> Column:
    return F.struct("label", "id", "class", "n")


def star_pairs(entries: DataFrame) -> DataFrame:
    """Each class of a bucket with the bucket's centre, unless they are known to be linked."""
    far = entries.where("label <> centre.label")
    return far.select(F.col("centre.class").alias("a"), F.col("class").alias("b"), F.col("centre.id").alias("u"), F.col("id").alias("v"), F.col("centre.n").alias("n_a"), F.col("n").alias("n_b"))


def prefix_pairs(entries: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Classes of different components that can be linked at all, by their rarest shingles.

    Shingles have one order, the rarest first. A set that reaches the threshold with another
    shares all but n - ceil(n * percent / 100) of its n shingles; so the first shingle that the
    two share is among that many, and one more, of each set's first ones. From there on a set
    has ``rest`` shingles that other components have too, and no more than the lesser of both
    rests can be shared: with r the rest, all of n + m (r * (100 + percent) / percent) that is
    left to a partner's size m is ``room``. Rows that no partner of their shingle has room for
    go before the join. A class whose changes made enough shingles of its own so meets no one,
    however large its bucket is.
    """
    classes = entries.select("class", "id", "label", "n").distinct().join(texts, "class")

    def spread(batches):
        for batch in batches:
            sets = [shingles(t, size).view(np.int64) for t in batch["text"]]
            yield batch.drop(columns="text").assign(shingle=sets).explode("shingle", ignore_index=True).astype({"shingle": "int64"})

    rows = written(classes.select("class", "id", "label", "n", "text").mapInPandas(spread, "class binary, id long, label long, n long, shingle long"), "spread")
    common = rows.groupBy("shingle").agg(F.count("*").alias("f"), F.min("label").alias("low"), F.max("label").alias("high"))
    own = Window.partitionBy("class")
    order = own.orderBy("f", "shingle")
    shared = F.count(F.when(F.col("low") < F.col("high"), 1))
    ranked = rows.join(common, "shingle").withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumn("rest", shared.over(own) - shared.over(order.rowsBetween(Window.unboundedPreceding, -1)))
    room = F.floor(F.col("rest") * (100 + percent) / percent) - F.col("n")
    rare = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("low < high").withColumn("room", room)
    rare = written(rare.where(100 * F.col("room") >= percent * F.col("n")).select("class", "id", "label", "n", "rest", "room", "shingle"), "rare")
    drop_written(rows)
    bounds = rare.groupBy("shingle").agg(F.min("n").alias("least_n"), F.max("room").alias("most_room"), F.min("label").alias("low"), F.max("label").alias("high"))
    meeting = rare.join(bounds.where("low < high"), "shingle").where("room >= least_n AND n <= most_room")
    meeting = written(meeting.select("class", "id", "label", "n", "rest", "shingle"), "meeting")
    drop_written(rare)
    x, y = meeting.alias("x"), meeting.alias("y")
    enough = (100 + percent) * F.least("x.rest", "y.rest") >= percent * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") < F.col("y.label")) & enough)
    return pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.id").alias("u"), F.col("y.id").alias("v"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))


def similar_size(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that can reach the threshold by their sets' sizes alone."""
    return pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    signed = written(sign(docs, size, bands, rows), "signatures")
    known = signed.where("class IS NOT NULL AND doc_id IS NOT NULL")
    # of each class: its least document, and the bands, which are the same in all of it
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    classes = known.groupBy("class").agg(least, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.select("class", F.col("least.doc_id").alias("id"), "least.text_hash", "n", "bands"), "classes")
    entries = classes.select("class", "id", F.col("id").alias("label"), "text_hash", "n", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min(_centre()).alias("centre"), F.count("*").alias("members")).where("members > 1")
    shared = written(entries.join(buckets, "bucket"), "shared")
    texts = written(class_texts(docs, shared.select("class", F.col("id").alias("doc_id"), "text_hash").distinct()), "class-texts")

    # documents whose rows repeat a doc_id tie their classes together
    ids = known.select("doc_id", "class").distinct().join(classes.select("class", "id"), "class")
    several = ids.groupBy("doc_id").agg(F.min("id").alias("v"), F.max("id").alias("high")).where("v < high")
    links = written(ids.join(several, "doc_id").where("id <> v").select(F.col("id").alias("u"), "v").distinct(), "links")

    label, tried, open_ = components(links), [], shared
    for turn in range(STAR_ROUNDS + 1):
        pairs = star_pairs(open_) if turn < STAR_ROUNDS else prefix_pairs(open_, texts, size, percent)
        pairs = similar_size(pairs, percent).select("a", "b", "u", "v").distinct()
        for before in tried:
            pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if not pairs.isEmpty():
            tried.append(pairs)
            links = written(links.unionByName(verified(pairs, texts, size, percent).select("u", "v")), "links")
            label = components(links)
        if turn == STAR_ROUNDS:
            break
        named = shared.drop("label", "centre").join(label, shared["id"] == label["node"], "left").withColumn("label", F.coalesce("component", "id")).drop("node", "component")
        # buckets of several components stay open, each with a centre of its own for the next turn
        any_ = F.max_by(_centre(), F.xxhash64("bucket", "id", F.lit(turn))).alias("centre")
        mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), any_).where("low <> high")
        open_ = written(named.join(mixed.select("bucket", "centre"), "bucket"), "open")
    member = known.select("doc_id", "class").distinct().join(classes.select("class", "id"), "class").groupBy("doc_id").agg(F.min("id").alias("id"))
    final = member.join(label, member["id"] == label["node"], "left").select("doc_id", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, as they are, of one document of each near-duplicate group.

    Rows that repeat a doc_id are one document, of which one row stays.
    """
    found = written(near_duplicates(docs, size, percent), "near-duplicates")
    gone = written(found.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    out = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return out
    return out.where("doc_id IS NULL").unionByName(out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
