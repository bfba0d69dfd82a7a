"""Alignment of two tokenizers' tokens over the bytes of whole texts, and how often ids are linked.

Tokenizer A (the tokenizers library) encodes a space and the text, B (sentencepiece) the text,
before which it sets a space itself. Both have the same bytes then, or the text has no tokens.
Byte offsets at which tokens of both end cut them into groups; tokens of A and B whose byte
ranges overlap are linked. Over the corpus an id pair's count is how many links hold it.

Common ends are found by galloping: the shorter list of ends drives; for each of its ends the
search starts where the last one stopped in the longer list, doubles its stride until it is
past, and halves back. What it finds is the end's rank in the longer list. A rank whose end is
equal is a common end and closes a group; the ranks of a token's two ends are the range of
tokens that it overlaps. Many pairs of lists are searched side by side.

Neither tokenizer carries anything across a single space, or before a single line feed,
between two visible characters (see :mod:`encoding`; no piece of B has a space mark after
another character). So words are aligned once each in a worker, and texts are sums over words.

Texts are encoded once. Each document's tokens, groups, digest and distinct linked pairs are
written; from these the pairs are counted, aggregated in each task before the shuffle, and
the counts brought back. As long as there are few (``MOST_PAIRS``, checked by counting) every
worker gets them as sorted arrays; beyond that documents send their distinct pairs to be joined.

Nulls and ties: a null text is empty; it has zeros and an empty digest, as have texts that B
can't spell, such as those with the mark that it has for a space. Rows that repeat a doc_id are
aligned and counted each. Ties of counts all are best. Further columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written
from .encoding import WordwiseEncoder, _cuts, _gather, _inner, slices

#: Counted pairs that are sent to every worker, at most: 17 bytes each.
MOST_PAIRS = 6_000_000
#: Bytes of aligned words that a worker keeps within a task, and words in a search side by side.
KEPT_BYTES, SIDE_BY_SIDE = 60_000_000, 20_000
_OVERHEAD = 280
_MARK = "▁"
#: A pair's key has so many bits for the id of B.
B_BITS = 20
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: The same before pairs are counted, with each document's pairs in order and how often it has them.
LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<int>"


def byte_alphabet() -> dict[str, int]:
    """The byte of each character in which byte-level vocabularies are written.

    Printable bytes of Latin-1 stand for themselves, the others in turn for characters from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def gallop(short: np.ndarray, short_at: np.ndarray, short_n: np.ndarray, long: np.ndarray, long_at: np.ndarray, long_n: np.ndarray) -> np.ndarray:
    """For each end of each shorter list, the place of the first end of the longer list that isn't below it.

    Lists lie in ``short`` and ``long`` one after another, with their starts and sizes; the k-th
    ends of all pairs are searched at once, each from where the end before it was found. The last
    ends of both lists of a pair are equal.
    """
    out = np.zeros(len(short), np.int64)
    order = np.argsort(-short_n, kind="stable")
    sizes = -short_n[order]
    found = long_at.copy()
    stop = long_at + long_n - 1
    for k in range(int(short_n.max()) if len(short_n) else 0):
        live = order[: np.searchsorted(sizes, -k, side="left")]  # pairs with more than k ends
        want = short[short_at[live] + k]
        low, end = found[live], stop[live]
        high, stride = low.copy(), 1
        while True:  # double the stride while the end there is below
            under = long[high] < want
            if not under.any():
                break
            low = np.where(under, high + 1, low)
            high = np.where(under, np.minimum(high + stride, end), high)
            stride *= 2
        while True:  # the place lies in [low, high]
            apart = low < high
            if not apart.any():
                break
            middle = (low + high) // 2
            under = apart & (long[middle] < want)
            high = np.where(apart & ~under, middle, high)
            low = np.where(under, middle + 1, low)
        found[live] = low
        out[short_at[live] + k] = low
    return out


def _sums(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``; a run without values has 0."""
    so_far = np.concatenate([[0], np.cumsum(values)])
    return so_far[begins + sizes] - so_far[begins]


class Aligner:
    """A worker's aligned words: how many tokens, groups and links each has, its links and its groups as text."""

    #: Rows of ``facts``: tokens of A, tokens of B, groups, links, whether B spells other bytes.
    N_A, N_B, N_GROUPS, N_LINKS, BAD = range(5)

    def __init__(self, path_a: str, path_b: str, most_bytes: int = KEPT_BYTES):
        import sentencepiece

        self.a = WordwiseEncoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        vocabulary = self.a.tokenizer.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if max(len(pieces), len(self.bytes_a)) >> B_BITS:
            raise ValueError(f"vocabularies of more than {1 << B_BITS} ids")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_MARK, " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # how each id is written inside a group and at the end of its side of it
        self.written = [b"%d%s" % (k, end) for n, ends in ((len(self.bytes_a), (b",", b"|")), (len(pieces), (b",", b";"))) for k in range(n) for end in ends]
        self.most_bytes = most_bytes
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.facts = np.zeros((5, 1024), np.int64)
        self.starts, self.seen = np.zeros(1024, np.int64), np.zeros(1024, np.int32)  # places of links in ``flat``; slices that held the word
        self.flat, self.used, self.held = np.zeros(4096, np.int64), 0, 0

    def _spelt(self, words: list[str], inner: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and numbers of ids of words (as they stand in a text) by A and B, and whether both spell each."""
        plain = [w[1:] if w[0] == " " else w for w in words]
        if inner:
            flat_a, n_a = self.a._of_pieces(plain)
        else:
            ids = self.a._ids(words)
            flat_a, n_a = np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
        # before a line feed B's own space is a piece of its own
        ids_b = [x if w[0] == " " else x[1:] for w, x in zip(words, self.b.encode(plain, num_threads=1), strict=True)]
        flat_a, n_a = flat_a.astype(np.int64), n_a.astype(np.int64)
        n_b = np.fromiter(map(len, ids_b), np.int64, len(ids_b))
        flat_b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        own = pa.array(words, pa.large_string())
        sizes, whole = pc.binary_length(own).to_numpy(), "".join(words).encode("utf-8", "surrogatepass")
        good = np.ones(len(words), bool)
        for flat, n, size, spelt in ((flat_a, n_a, self.size_a, self.bytes_a), (flat_b, n_b, self.size_b, self.bytes_b)):
            begins = np.cumsum(n) - n
            same = _sums(size[flat], begins, n) == sizes
            if same.all() and b"".join(map(spelt.__getitem__, flat.tolist())) == whole:
                continue
            for k, (w, p, q) in enumerate(zip(words, begins.tolist(), (begins + n).tolist(), strict=True)):
                good[k] &= b"".join(map(spelt.__getitem__, flat[p:q].tolist())) == w.encode("utf-8", "surrogatepass")
        return flat_a, n_a, flat_b, n_b, good

    def aligned(self, words: list[str], inner: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """``facts`` of words, the starts of their links, all links as keys, and groups as text, each with its semicolon."""
        flat_a, n_a, flat_b, n_b, good = self._spelt(words, inner)
        if not good.all():
            flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        facts = np.zeros((5, len(words)), np.int64)
        facts[self.N_A], facts[self.N_B], facts[self.BAD] = n_a, n_b, ~good
        at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])  # equal at the end of each word
        starts, keys, base = np.zeros(len(words), np.int64), [], 0
        groups = [b""] * len(words)
        for a_drives in (True, False):
            which = np.flatnonzero(good & ((n_a <= n_b) == a_drives))
            if not len(which):
                continue
            (sf, sn, sat, se), (lf, ln, lat, le) = ((flat_a, n_a, at_a, ends_a), (flat_b, n_b, at_b, ends_b))[:: 1 if a_drives else -1]
            n, m = sn[which], ln[which]
            short_at, long_at = np.cumsum(n) - n, np.cumsum(m) - m
            short, long, short_ids, long_ids = (_gather(x, at[which], k) for x, at, k in ((se, sat, n), (le, lat, m), (sf, sat, n), (lf, lat, m)))
            rank = gallop(short, short_at, n, long, long_at, m)
            common = long[rank] == short
            low = np.concatenate([[0], (rank + common)[:-1]])
            low[short_at] = long_at
            over = rank - low + 1
            facts[self.N_GROUPS, which], links = _sums(common, short_at, n), _sums(over, short_at, n)
            facts[self.N_LINKS, which] = links
            ours, theirs = np.repeat(short_ids, over), long_ids[_gather(np.arange(len(long)), low, over)]
            keys.append((ours << B_BITS | theirs) if a_drives else (theirs << B_BITS | ours))
            starts[which] = base + np.cumsum(links) - links
            base += int(links.sum())
            closes = np.zeros(len(long), bool)
            closes[rank[common]] = True
            a_ids, b_ids, a_last, b_last = (short_ids, long_ids, common, closes) if a_drives else (long_ids, short_ids, closes, common)
            texts = self._written(a_ids, a_last, b_ids, b_last)
            upto = np.cumsum(n + m)
            for w, p, q in zip(which.tolist(), [0, *upto[:-1].tolist()], upto.tolist(), strict=True):
                groups[w] = b"".join(texts[p:q])
        return facts, starts, np.concatenate(keys) if keys else np.zeros(0, np.int64), groups

    def _written(self, a_ids: np.ndarray, a_last: np.ndarray, b_ids: np.ndarray, b_last: np.ndarray) -> list[bytes]:
        """The ids of groups in turn, A's before B's in each, as they are written; ``last`` marks each side's last one."""
        n_a, n_b = (np.diff(np.flatnonzero(x), prepend=-1) for x in (a_last, b_last))  # by group
        group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        places = np.empty(len(a_ids) + len(b_ids), np.int64)
        places[np.arange(len(a_ids)) + (np.cumsum(n_b) - n_b)[group_a]] = 2 * a_ids + a_last
        places[np.arange(len(b_ids)) + np.cumsum(n_a)[group_b]] = 2 * (len(self.bytes_a) + b_ids) + b_last
        return list(map(self.written.__getitem__, places.tolist()))

    def _add(self, words: list[str], facts: np.ndarray, starts: np.ndarray, flat: np.ndarray, groups: list[bytes]) -> None:
        first = len(self.known)
        end = first + len(words)
        while end > len(self.starts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)], 1)
            self.starts, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.seen))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.facts[:, first:end], self.starts[first:end], self.seen[first:end] = facts, self.used + starts, 1
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.groups += groups
        self.known.update(zip(words, range(first, end), strict=True))
        self.held += 8 * len(flat) + _OVERHEAD * len(words) + sum(map(len, words)) + sum(map(len, groups))

    def _thin(self, most: int) -> None:
        """Forget the words that came up in the fewest slices until ``most`` bytes are left."""
        n = len(self.known)
        sizes = np.fromiter(map(len, self.groups), np.int64, n) + 8 * self.facts[self.N_LINKS, :n] + _OVERHEAD
        least = 2
        while int(sizes[self.seen[:n] >= least].sum()) > most:
            least *= 2
        keep = np.flatnonzero(self.seen[:n] >= least)
        words, groups = list(self.known), self.groups
        links = self.facts[self.N_LINKS, keep]
        flat, facts = _gather(self.flat, self.starts[keep], links), self.facts[:, keep]
        kept = [words[k] for k in keep.tolist()], [groups[k] for k in keep.tolist()]
        self._forget()
        self._add(kept[0], facts, np.cumsum(links) - links, flat, kept[1])

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Each distinct word's number among the known ones; words that may not stand inside a text get one below zero."""
        known = self.known
        numbers = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        self.seen[numbers[numbers >= 0]] += 1
        new = [k for k in np.flatnonzero(numbers < 0).tolist() if _inner(words[k])]
        for at in range(0, len(new), SIDE_BY_SIDE):
            part = new[at : at + SIDE_BY_SIDE]
            own = [words[k] for k in part]
            numbers[part] = np.arange(len(known), len(known) + len(part))
            self._add(own, *self.aligned([w if w[0] == "\n" else " " + w for w in own], True))
        return numbers

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """The words of texts in turn, as numbers, and where each text's begin and end; facts, starts of links, links and groups by number.

        Numbers from ``len(known)`` on are parts of texts with other white space, which aren't kept.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        begins = np.asarray(cut.offsets, np.int64) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        index = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        odd = ~empty & (np.add.reduceat((index < 0).astype(np.int64), begins[:-1]) > 0) if len(texts) else empty
        runs: list[np.ndarray] = []
        loose: list[str] = []
        where: list[tuple[int, int]] = []  # run and place of what is loose
        last = 0
        sizes = np.where(empty, 0, np.diff(begins))
        for k in np.flatnonzero(odd | empty).tolist():
            runs.append(index[begins[last] : begins[k]])
            last = k + 1
            if empty[k]:
                continue
            head, *pieces = _cuts.split(" " + texts[k].as_py())
            tail = [pieces.pop()] if pieces else []
            distinct = list(dict.fromkeys(pieces))
            at = dict(zip(distinct, self._numbers(distinct).tolist(), strict=True))
            own = np.array([-1, *(at[p] for p in pieces), *(-1 for _ in tail)], np.int64)
            where.append((len(runs), 0))
            loose.append(head)
            if tail:
                where.append((len(runs), len(own) - 1))
                loose.append(tail[0] if tail[0][0] == "\n" else " " + tail[0])
            sizes[k] = len(own)
            runs.append(own)
        runs.append(index[begins[last] :] if len(texts) else index)
        n = len(self.known)
        facts, starts, flat, groups = self.facts[:, :n], self.starts[:n], self.flat[: self.used], self.groups
        if loose:
            for k, (run, place) in enumerate(where):
                runs[run][place] = n + k
            f, s, links, g = self.aligned(loose, False)
            facts, starts, flat, groups = np.concatenate([facts, f], 1), np.concatenate([starts, self.used + s]), np.concatenate([flat, links]), groups + g
        return np.concatenate(runs), np.concatenate([[0], np.cumsum(sizes)]), facts, starts, flat, groups

    def documents(self, texts: pa.Array) -> list[pa.Array]:
        """The columns of ``LINKED`` after doc_id for texts."""
        if self.held > self.most_bytes:
            self._thin(self.most_bytes // 2)
        words, ends, facts, starts, flat, groups = self.texts(texts)
        begins, sizes = ends[:-1], np.diff(ends)
        bad = _sums(facts[self.BAD, words], begins, sizes) > 0
        columns = [np.where(bad, 0, _sums(facts[k, words], begins, sizes)) for k in (self.N_A, self.N_B, self.N_GROUPS, self.N_LINKS)]
        numbers = words.tolist()
        digests = ["" if skip or p == q else hashlib.sha256(b"".join([groups[k] for k in numbers[p:q]])[:-1]).hexdigest() for skip, p, q in zip(bad.tolist(), begins.tolist(), ends[1:].tolist(), strict=True)]
        words = words[np.repeat(~bad, sizes)]
        keys = np.repeat(np.arange(len(texts)), columns[3]) << 2 * B_BITS | _gather(flat, starts[words], facts[self.N_LINKS, words])
        keys, times = _added(keys, None)
        offsets = np.searchsorted(keys >> 2 * B_BITS, np.arange(len(texts) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (keys & ((1 << 2 * B_BITS) - 1), times.astype(np.int32))]
        return [*map(pa.array, columns), pa.array(digests, pa.string()), *lists]


def _added(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts, each 1 where none are given."""
    if counts is None:
        keys = np.sort(keys)
        so_far = np.arange(1, len(keys) + 1)
    else:
        order = np.argsort(keys)
        keys, so_far = keys[order], np.cumsum(counts[order])
    last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if len(keys) else np.zeros(0, np.int64)
    return keys[last], np.diff(so_far[last], prepend=0)


_aligners: dict[tuple[str, str, int], Aligner] = {}


def aligner(path_a: str, path_b: str, most_bytes: int = KEPT_BYTES) -> Aligner:
    """The worker's aligner for two vocabulary files; kept while the worker lives."""
    key = (path_a, path_b, most_bytes)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def link(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``LINKED`` of every row of ``docs`` (doc_id, text)."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), *own.documents(part)], _names(LINKED))
                at += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(linked, LINKED)


def count_pairs(linked: DataFrame) -> DataFrame:
    """key (the A id times 2^20 plus the B id), n and whether n is the B id's highest, over all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more = [batch.column(c).flatten().to_numpy() for c in ("keys", "times")]
            keys, counts = _added(np.concatenate([keys, more[0]]), np.concatenate([counts, more[1]]))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    sums = linked.select("keys", "times").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    b = F.col("key").bitwiseAND((1 << B_BITS) - 1)
    # an id of B has at most as many partners as A has ids
    return sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))


def _with_arrays(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """Every worker has all counts."""
    table = counts.select("key", "n", "best").toArrow().sort_by("key")
    sent = linked.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("key", "n", "best")))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = sent.value
        for batch in batches:
            lists = batch.column("keys")
            offsets = np.asarray(lists.offsets, np.int64)
            begins, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
            at, times = np.searchsorted(key, lists.flatten().to_numpy()), batch.column("times").flatten().to_numpy().astype(np.int64)
            sums = [pa.array(_sums(x, begins, sizes)) for x in (times * best[at], times * n[at])]
            columns = {c: batch.column(c) for c in batch.schema.names} | dict(zip(("n_best", "count_sum"), sums, strict=True))
            yield pa.RecordBatch.from_arrays([columns[c] for c in _names(ALIGNED)], _names(ALIGNED))

    return linked.mapInArrow(summed, ALIGNED)


def _with_join(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents send their distinct pairs to the counts."""
    rows = written(linked.withColumn("row", F.monotonically_increasing_id()), "numbered")
    sent = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("row", F.col("p.keys").alias("key"), F.col("p.times").alias("times"))
    sums = sent.join(counts, "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("n") * F.col("times")).alias("s"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").withColumns({"n_best": F.coalesce("b", zero), "count_sum": F.coalesce("s", zero)}).select(_names(ALIGNED))


def align(docs: DataFrame, path_a: str, path_b: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``ALIGNED`` of every row of ``docs`` (doc_id, text): tokens, groups and links, how many links are
    their B id's most counted, the sum of the links' counts and the digest of the groups."""
    linked = written(link(docs, path_a, path_b), "linked")
    counts = written(count_pairs(linked), "pairs")
    if counts.count() > most_pairs:
        return _with_join(linked, counts)
    out = _with_arrays(linked, counts)
    drop_written(counts)
    return out
