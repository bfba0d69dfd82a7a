"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on the word shingles that they share (seeds). For
each such pair, greedy string tiling covers the item with non-overlapping matches of at
least ``least`` words, longest first: windows of a length that shrinks from round to round
are hashed by a rolling Karp-Rabin hash, equal windows are compared word by word, extended
and marked. Marked words take part in no later match, and tiles may lie in any order, so
passages that were cut up and reordered are still caught. A document is contaminated by an
item if tiles cover ``percent`` of the item's words.

Items shorter than a seed are matched whole, as one shingle of their own length.

Nulls and ties: words are split at white space, their case folded in every script; a null or
wordless text on either side matches nothing. Rows that repeat a doc_id are compared each on their own and
the best coverage is reported; repeated items likewise. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, word_hashes, written

SEED_WORDS = 5
PERCENT = 80
#: First window length of the tiling; longer matches are found by extension.
FIRST_WINDOW = 32
#: Bits of the seed filter that goes to every task: 2 MB whatever the benchmark's size.
FILTER_BITS = 24
#: Seeds that may be broadcast to join; more are joined by a shuffle.
BROADCAST_SEEDS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Pairs of equal windows that are looked at together.
PAIRS_AT_ONCE = 1_000_000


def folded_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words, equal for a text and its upper- or lower-cased copy.

    Folding alone keeps the dotless i apart from its upper case; the fold of the upper case doesn't.
    """
    return word_hashes(text if not text or text.isascii() else text.upper().casefold())


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each window of ``size`` ids: a polynomial modulo 2^64, mixed.

    It rolls: with the running sum of id * base^place, a window is the difference of two
    sums, brought back to place 0 by the base's inverse; each costs the same at any size.
    """
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, back = (np.cumprod(np.full(len(ids), base, np.uint64)) for base in (_BASE, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * powers)])
    return mix((sums[size:] - sums[:-size]) * back[:n])


def tiles(item: np.ndarray, text: np.ndarray, least: int, first: int = FIRST_WINDOW) -> list[tuple[int, int, int]]:
    """Greedy string tiling of hashed words: (start in item, start in text, words) of each tile."""
    free_item, free_text, found = np.ones(len(item), bool), np.ones(len(text), bool), []
    top = min(len(item), len(text))
    least = min(least, top)
    size = min(first, top)
    while size >= least > 0:
        hashes = windows(text, size)
        while len(matches := _matches(item, text, free_item, free_text, size, hashes)):
            longest = matches[:, 2].max()
            for p, t, n in sorted(map(tuple, matches[matches[:, 2] == longest].tolist())):
                if free_item[p : p + n].all() and free_text[t : t + n].all():
                    free_item[p : p + n] = free_text[t : t + n] = False
                    found.append((p, t, n))
        size = max(size // 2, least) if size > least else 0
    return found


def _matches(item, text, free_item, free_text, size: int, hashes: np.ndarray) -> np.ndarray:
    """Unmarked matches (start in item, start in text, words) that can't be extended on either side."""
    none = np.zeros((0, 3), np.int64)
    starts, places = _open(free_item, size), _open(free_text, size)
    if not len(starts) or not len(places):
        return none
    own = windows(item, size)[starts]
    order = np.argsort(own, kind="stable")
    starts, own = starts[order], own[order]
    low, high = (np.searchsorted(own, hashes[places], side) for side in ("left", "right"))
    some = high > low
    places, low, many = places[some], low[some], (high - low)[some]
    found, at = [none], 0
    while at < len(places):
        end = max(at + 1, int(np.searchsorted(np.cumsum(many[at:]), PAIRS_AT_ONCE, "right")) + at)
        n = many[at:end]
        t = np.repeat(places[at:end], n)
        p = starts[np.repeat(low[at:end] - (np.cumsum(n) - n), n) + np.arange(len(t))]
        found.append(_extended(item, text, free_item, free_text, size, p, t))
        at = end
    return np.concatenate(found)


def _extended(item, text, free_item, free_text, size: int, p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of pairs of windows with equal hashes, those that begin a match, compared word by word."""
    inner = np.flatnonzero((p > 0) & (t > 0))
    before = free_item[p[inner] - 1] & free_text[t[inner] - 1] & (item[p[inner] - 1] == text[t[inner] - 1])
    first = np.ones(len(p), bool)
    first[inner[before]] = False  # its beginning is found further left
    p, t = p[first], t[first]
    for k in range(size):
        same = item[p + k] == text[t + k]
        p, t = p[same], t[same]
    n, alive = np.full(len(p), size), np.arange(len(p))
    while len(alive):
        x, y = p[alive] + n[alive], t[alive] + n[alive]
        inside = (x < len(item)) & (y < len(text))
        alive, x, y = alive[inside], x[inside], y[inside]
        more = free_item[x] & free_text[y] & (item[x] == text[y])
        alive = alive[more]
        n[alive] += 1
    return np.stack([p, t, n], axis=1)


def _open(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked word."""
    marked = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(marked[size:] == marked[:-size]) if size <= len(free) else np.zeros(0, np.int64)


def benchmark_seeds(benchmark: DataFrame, least: int) -> DataFrame:
    """item_id, words, size and seed: each window of an item, or a shorter item whole."""

    def seeds(batches):
        for batch in batches:
            rows = []
            for item_id, text in zip(batch["item_id"], batch["text"], strict=True):
                ids = folded_hashes(text)
                size = min(least, len(ids))
                if size:
                    rows += [(item_id, size, int(h)) for h in np.unique(windows(ids, size)).view(np.int64)]
            yield pd.DataFrame(rows, columns=["item_id", "size", "seed"]).astype({"item_id": "Int64"})

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInPandas(seeds, "item_id long, size int, seed long")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bit for each value of the seeds' upper bits, gathered by Spark as 64-bit words.

    The driver gets as many words as the filter has at most, whatever the benchmark's size.
    """
    upper = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    bit = F.expr("shiftleft(1L, cast(upper % 64 AS int))")
    words = seeds.select(upper.alias("upper")).groupBy(F.floor(F.col("upper") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def document_seeds(docs: DataFrame, sizes: list[int], keep: np.ndarray) -> DataFrame:
    """doc_id, text_hash, size and seed of the windows of whole texts that pass the filter."""
    held = docs.sparkSession.sparkContext.broadcast(keep)

    def seeds(batches):
        words = held.value
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch["doc_id"], batch["text_hash"], batch["text"], strict=True):
                ids = folded_hashes(text)
                for size in sizes:
                    h = windows(ids, size)
                    upper = h >> np.uint64(64 - FILTER_BITS)
                    h = h[(words[upper >> np.uint64(6)] >> (upper & np.uint64(63)) & np.uint64(1)).astype(bool)]
                    rows += [(doc_id, key, size, x) for x in np.unique(h).view(np.int64).tolist()]
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "size", "seed"]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(seeds, "doc_id long, text_hash long, size int, seed long")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = SEED_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, n_tiles and coverage, for contaminated documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    seeds = written(benchmark_seeds(benchmark, least), "seeds")
    few = seeds.count() <= BROADCAST_SEEDS
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most as many as a seed has words
    hits = document_seeds(docs, sizes, seed_filter(seeds))
    pairs = written(hits.join(F.broadcast(seeds) if few else seeds, ["size", "seed"]).select("doc_id", "text_hash", "item_id").distinct(), "pairs")
    some = pairs.count() <= BROADCAST_SEEDS
    same = docs["doc_id"].eqNullSafe(pairs["doc_id"]) & (docs["text_hash"] == pairs["text_hash"])
    texts = docs.join(F.broadcast(pairs) if some else pairs, same).select(docs["doc_id"], "item_id", docs["text"])
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))
    found = texts.join(items, texts["item_id"].eqNullSafe(items["item_id"])).select("doc_id", texts["item_id"], "text", "item_text")

    def tiled(batches):
        for batch in batches:
            rows = []
            for doc_id, item_id, text, item_text in zip(batch["doc_id"], batch["item_id"], batch["text"], batch["item_text"], strict=True):
                item = folded_hashes(item_text)
                own = tiles(item, folded_hashes(text), least)
                covered = sum(n for _, _, n in own)
                if len(item) and 100 * covered >= percent * len(item):
                    rows.append((doc_id, item_id, len(item), covered, len(own)))
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "item_words", "covered_words", "n_tiles"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

    rows = found.mapInPandas(tiled, "doc_id long, item_id long, item_words long, covered_words long, n_tiles long")
    best = F.max(F.struct((F.col("covered_words") / F.col("item_words")).alias("coverage"), "item_words", "covered_words", "n_tiles")).alias("best")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.item_words", "best.covered_words", "best.n_tiles", "best.coverage")


def clean(docs: DataFrame, benchmark: DataFrame, least: int = SEED_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, as they are, that no benchmark item contaminates."""
    found = written(contaminated(docs, benchmark, least, percent).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    few = found.count() <= BROADCAST_SEEDS
    return docs.join(F.broadcast(found) if few else found, docs["doc_id"].eqNullSafe(found["_leak"]), "left_anti")
