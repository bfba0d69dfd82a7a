"""Interpolated modified Kneser-Ney bigram model: counted by Spark, mapped into memory to score.

Tokens are words (white space, A-Z lowered) and one end a text; the first word's context is
the text's beginning. A token is its 64-bit hash, a bigram the mixed hash of its two tokens.

Counting: tasks count the bigrams of some millions of tokens at a time and send each
shard, a range of bigram hashes, its sorted part. A shard adds its parts up and stores two
arrays, sorted bigram hashes and their counts. What the model needs by word (how often it
comes, how many words come before it, how many words follow it once, twice or more often)
is a sum over bigrams, so shards pass on partial sums, which are added up by ranges of word
hashes and stored as sorted arrays likewise. A frequent word is spread over all shards.

Scoring: workers map the arrays into memory and look sorted queries up. Arrays lie in the
shared folder; files of a store that can't be mapped are fetched once by each worker.

Nulls and ties: a null text is empty and has its end token alone. Rows that repeat a doc_id
each count and are scored each on their own; a null doc_id is trained on by its bucket like
any other. Other columns are ignored. Without a training token every token is unknown.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, mix, new_path, word_hashes, written

BEGIN, END = np.uint64(1), np.uint64(2)
#: Characters that a task counts or scores at once (about a sixth of that in tokens); bounds its memory.
COUNT_CHARS, SCORE_CHARS = 8_000_000, 2_000_000
#: Shards for each shuffle partition; more make smaller groups.
SHARDS_EACH = 2
#: Arrays that a worker maps at once.
MOST_OPEN = 400
PARTS = "shard int, kind string, payload binary"
#: Sums by word: predicted count, words before it, tokens after it, and words after it by count 1, 2, 3+.
WORD_SUMS = ("count", "before", "total", "after1", "after2", "after3")


def _bigrams(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first * MULTIPLIER + np.uint64(7)) + second)


def _shards(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of 2^64 / n values that each key is in, for sorted keys: begin of each range."""
    edges = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _sums(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sum of each column by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], *(np.add.reduceat(c[order], begins, dtype=np.int64) if len(begins) else c[:0].astype(np.int64) for c in columns)


def _shrunk(x: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte by byte: all first bytes, then all second ones and so on, after each one's type and length.

    Bytes that hardly differ then lie together, and the shuffle's compression removes them.
    """
    parts = []
    for x in arrays:
        parts += [x.dtype.str[1:].encode(), len(x).to_bytes(8, "little"), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""]
    return b"".join(parts)


def _unpacked(payload: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(payload):
        kind, n = np.dtype(payload[at : at + 2].decode()), int.from_bytes(payload[at + 2 : at + 10], "little")
        at += 10
        out.append(np.frombuffer(payload, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _unpack(payloads, columns: int) -> list[np.ndarray]:
    """The columns of several payloads, one after another."""
    found = [_unpacked(x) for x in payloads if x]
    return [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64) for k in range(columns)]


def _pack_bigrams(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> bytes:
    """Bigrams as places among their distinct words, which are sent once, and their counts."""
    words, at = np.unique(np.concatenate([first, second]), return_inverse=True)
    at = _shrunk(at)
    return _pack(words, at[: len(first)], at[len(first) :], _shrunk(n))


def _unpack_bigrams(payloads) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [_unpacked(x) for x in payloads]
    columns = [(words[a], words[b], n.astype(np.int64)) for words, a, b, n in found]
    return tuple(np.concatenate([c[k] for c in columns]) for k in range(3))


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the texts, an end after each, and where each text's tokens begin."""
    parts, begins, at = [], [], 0
    for text in texts:
        h = word_hashes(text)
        parts += [h, [END]]
        begins.append(at)
        at += len(h) + 1
    return np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64), np.array(begins, np.int64)


def _contexts(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    first = np.empty_like(tokens)
    first[1:] = tokens[:-1]
    first[begins] = BEGIN
    return first


def _chunks(batches, size: int):
    """Batches cut into frames of about ``size`` characters."""
    for batch in batches:
        lengths = batch["text"].str.len().fillna(0).to_numpy()
        group = (np.cumsum(lengths) // size).astype(np.int64)
        for _, part in batch.groupby(group):
            yield part


def _store(folder: str, name: str, array: np.ndarray) -> None:
    """An array as a .npy file; a task that runs again puts the same file in its place."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        np.lib.format.write_array(_Writer(out), array)
    store.move(own, f"{path}/{name}.npy")


class _Writer:
    """What numpy's writer asks of a file, for a stream that isn't one."""

    def __init__(self, out):
        self.write = out.write


class _Arrays:
    """The model's arrays in a worker, each mapped into memory at its first use."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.local = isinstance(self.store, fs.LocalFileSystem)
        self.open: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.open:
            if len(self.open) >= MOST_OPEN:
                self.open.clear()
            path = f"{self.path}/{name}.npy"
            if not self.local:
                with self.store.open_input_stream(path) as source, tempfile.NamedTemporaryFile(suffix=".npy", delete=False) as copy:
                    while piece := source.read(1 << 24):
                        copy.write(piece)
                path = copy.name
            self.open[name] = np.load(path, mmap_mode="r")
            if not self.local:
                os.unlink(path)  # the mapping holds the file
        return self.open[name]

    def find(self, kind: str, n: int, keys: np.ndarray, columns: int) -> np.ndarray:
        """A row of sums for each column for the sorted ``keys``, 0 where the key isn't stored."""
        out = np.zeros((columns, len(keys)), np.int64)
        bounds = _shards(keys, n)
        for shard in range(n):
            low, high = bounds[shard], bounds[shard + 1]
            if low == high:
                continue
            stored = self[f"{kind}-{shard}-key"]
            if not len(stored):
                continue
            want = keys[low:high]
            at = np.minimum(np.searchsorted(stored, want), len(stored) - 1)
            known = stored[at] == want
            out[:, low:high] = np.where(known, self[f"{kind}-{shard}-sums"][:, at], 0)
        return out


_open_models: dict[str, _Arrays] = {}


def _model_arrays(folder: str) -> _Arrays:
    if folder not in _open_models:
        _open_models.clear()
        _open_models[folder] = _Arrays(folder)
    return _open_models[folder]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney's discounts for counts 1, 2 and 3+; sane values where counts lack."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k) for x, k in zip(d, (0.95, 1.9, 2.9), strict=True))


def count(docs: DataFrame, folder: str, shards: int) -> dict:
    """Count the texts of ``docs`` into arrays in ``folder``; returns what holds for all words."""
    word_shards = max(1, shards // 2)  # words are far fewer than bigrams

    def parts(batches):
        for batch in _chunks(batches, COUNT_CHARS):
            tokens, begins = _tokens(batch["text"])
            first = _contexts(tokens, begins)
            keys = _bigrams(first, tokens)
            order = np.argsort(keys)
            keys = keys[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            n = np.diff(np.append(new, len(keys)))
            keys, first, second = keys[new], first[order][new], tokens[order][new]
            bounds = _shards(keys, shards)
            rows = []
            for s in range(shards):
                a, b = bounds[s], bounds[s + 1]
                if a < b:  # by first word, so that the shuffle's compression finds runs
                    near = a + np.argsort(first[a:b])
                    rows.append((s, "bigram", _pack_bigrams(first[near], second[near], n[near])))
            yield pd.DataFrame(rows, columns=["shard", "kind", "payload"])

    def bigrams(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        first, second, n = _unpack_bigrams(group["payload"])
        keys, at = _bigrams(first, second), np.arange(len(first))
        unique, n = _sums(keys, n)
        order = np.argsort(keys, kind="stable")
        at = at[order][np.searchsorted(keys[order], unique)]
        first, second = first[at], second[at]
        _store(folder, f"bigram-{shard}-key", unique)
        _store(folder, f"bigram-{shard}-sums", n[None].astype(np.min_scalar_type(n.max() if len(n) else 0)))
        rows = []
        for kind, by, columns in (("before", second, (n, np.ones_like(n))), ("after", first, (n, n == 1, n == 2, n > 2))):
            word, *sums = _sums(by, *columns)
            bounds = _shards(word, word_shards)
            rows += [(s, kind, _pack(word[a:b], *(_shrunk(x[a:b]) for x in sums))) for s in range(word_shards) if (a := bounds[s]) < (b := bounds[s + 1])]
        rows.append((shard, "counts", _pack(np.array([np.sum(n == k) for k in (1, 2, 3, 4)] + [len(n), n.sum(), 0], np.int64))))
        return pd.DataFrame(rows, columns=["shard", "kind", "payload"])

    def words(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        found = []
        for kind, width in (("before", 2), ("after", 4)):
            word, *sums = _unpack(group.loc[group["kind"] == kind, "payload"], 1 + width)
            found.append(_sums(word.astype(np.uint64), *sums))
        word = np.union1d(found[0][0], found[1][0])
        table = np.zeros((len(WORD_SUMS), len(word)), np.int64)
        for at, (own, *sums) in zip((0, 2), found, strict=True):
            table[at : at + len(sums), np.searchsorted(word, own)] = sums
        _store(folder, f"word-{shard}-key", word)
        _store(folder, f"word-{shard}-sums", table)
        before = table[1]
        return pd.DataFrame([(shard, "counts", _pack(np.array([np.sum(before == k) for k in (1, 2, 3, 4)] + [np.sum(before > 0), before.sum(), 0], np.int64)))], columns=["shard", "kind", "payload"])

    empty = np.zeros(0, np.uint64)
    spark = docs.sparkSession
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    # every shard has its arrays, be they empty
    none2 = every.select("shard", F.lit("bigram").alias("kind"), F.lit(_pack_bigrams(empty, empty, empty)).alias("payload"))
    none1 = every.where(F.col("shard") < word_shards).select("shard", F.lit("none").alias("kind"), F.lit(b"").alias("payload"))
    counted = docs.select("text").mapInPandas(parts, PARTS).unionByName(none2)
    second = written(counted.groupBy("shard").applyInPandas(bigrams, PARTS), "bigrams")
    third = written(second.where("kind <> 'counts'").unionByName(none1).groupBy("shard").applyInPandas(words, PARTS), "words")

    def totals(df: DataFrame) -> list[int]:
        rows = df.where("kind = 'counts'").select("payload").collect()  # 64 bytes a shard
        return np.sum([_unpacked(r["payload"])[0] for r in rows], axis=0).tolist()

    two, one = totals(second), totals(third)
    return {"folder": folder, "shards": shards, "word_shards": word_shards, "d2": discounts(*two[:4]), "d1": discounts(*one[:4]), "types": two[4], "tokens": two[5], "vocabulary": one[4], "n1": one[:4]}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every text."""

    def scored(batches):
        arrays, n = _model_arrays(model["folder"]), model["shards"]
        v, total, types = model["vocabulary"], model["tokens"], max(1, model["types"])
        d1, d2 = np.array([0.0, *model["d1"]]), np.array([0.0, *model["d2"]])
        ones, twos = model["n1"][:2]
        spare = (d1[1] * ones + d1[2] * twos + d1[3] * (v - ones - twos)) / types if v else 1.0
        for batch in _chunks(batches, SCORE_CHARS):
            tokens, begins = _tokens(batch["text"])
            first = _contexts(tokens, begins)
            words, back = np.unique(np.concatenate([tokens, first]), return_inverse=True)
            own, context = back[: len(tokens)], back[len(tokens) :]
            c, before, after, a1, a2, a3 = arrays.find("word", model["word_shards"], words, len(WORD_SUMS))
            low = np.maximum(before - d1[np.minimum(before, 3)], 0) / types + spare / (v + 1)
            pairs, where = np.unique(_bigrams(first, tokens), return_inverse=True)
            (c2,) = arrays.find("bigram", n, pairs, 1)
            c2 = c2[where]
            left = np.where(after > 0, (d2[1] * a1 + d2[2] * a2 + d2[3] * a3) / np.maximum(after, 1), 1.0)
            p = np.maximum(c2 - d2[np.minimum(c2, 3)], 0) / np.maximum(after[context], 1) + left[context] * low[own]
            base = np.log10((c[own] + 0.5) / (total + 0.5 * (v + 1)))
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")})
            out["n_tokens"] = np.diff(np.append(begins, len(tokens)))
            out["n_known"] = np.add.reduceat((c[own] > 0).astype(np.int64), begins)
            out["base_score"] = np.add.reduceat(base, begins)
            out["score"] = np.add.reduceat(np.log10(p), begins)
            out["perplexity"] = 10 ** np.minimum(-out["score"] / out["n_tokens"], 300)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def train(docs: DataFrame) -> dict:
    """A model of the texts of ``docs`` in a new folder; its shards follow the shuffle partitions."""
    spark = docs.sparkSession
    return count(docs, new_path(spark, "kneser-ney"), SHARDS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
