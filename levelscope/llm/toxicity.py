"""Toxicity by weak supervision: many weak voters, a generative model of them, a linear classifier.

Voters. Labelled rows (a bounded sample) name word beginnings and whole words that mostly
stand in toxic texts; each is a voter of a lexicon. Patterns of how such words lie in a text
(how many, how dense, how soon, how many different ones, none at all) and of its marks are
further voters. A voter votes or abstains; it always votes for the same side.

Label model. Over the votes of all documents, without their labels, expectation maximisation
estimates how often each voter votes in toxic and in other texts. Then the pairs of voters
that depend on each other most within a class are joined to a forest (the maximum spanning
one by conditional mutual information), and each voter's rate is estimated anew given its
parent's vote. So correlated voters don't count twice. It gives each pattern of votes the
probability that its text is toxic.

Classifier. A logistic regression over votes and binned statistics learns these
probabilities. It is a sum of weights, compiled into one Spark column.

Votes and bins of a document are two whole numbers. Both models are fitted on the distinct
ones and how many documents have them, so that their cost doesn't grow with the texts.

Nulls and ties: a null text scores as an empty one. Labels that repeat a doc_id count once, by
their mean (a tie is toxic); a null label is none. Without toxic labels there is no lexicon,
and every text scores the labels' share of toxic rows, 0 without labels. Rows that repeat a
doc_id are scored each. Further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, bucket_of, drop_written, written
from .encoding import slices

#: Labelled rows that the lexicon is learnt from, at most; entries of the lexicon, at most.
MOST_LABELS, MOST_ENTRIES = 20_000, 48
#: Word beginnings of these lengths and whole words may enter the lexicon.
SHORTEST, LONGEST = 3, 8
#: An entry stands in so many toxic labelled texts that aren't copies of one another.
SUPPORT = 5
#: Lower bound (two standard errors) of the share of toxic texts among those with an entry.
SHARE = 0.5
#: Candidates that are read to the driver, most frequent first.
MOST_CANDIDATES = 20_000
ROUNDS = 6
#: Mutual information in nats from which two voters count as dependent.
DEPENDENT = 1e-4
PENALTY = 1e-5
THRESHOLD = 0.5
EDGES = "".join(chr(c) for c in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F))) + "«»“”„’‘¡¿…–—"
#: Mark of an entry that is a whole word.
WHOLE = "$"
#: How often a voter's entry must come up at least: words, and their share of the text's words.
LEVELS = ((1, 0.0), (2, 0.01), (3, 0.015))

#: Pattern voters, after the lexicon's: (what, side: 1 toxic, 0 clean).
PATTERNS = (("two entries", 1), ("three words", 1), ("one in sixty words", 1), ("among the first twenty", 1), ("two near each other", 1), ("exclaimed", 1), ("shouted", 1), ("none", 0), ("none in a hundred words", 0), ("fewer than one in a hundred words", 0), ("long words calmly put", 0))
#: Bounds of the bins of the statistics: words with entries, their share, words in all, share of exclaimed words.
BINS = {"hits": (1, 2, 3, 5, 9), "density": (0.002, 0.01, 0.03, 0.1), "words": (20, 60, 200, 600, 2000), "exclaimed": (0.001, 0.02, 0.1)}
FACTS = "doc_id long, votes long, bins long"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """Distinct words in lower case without marks at their ends, the word at each place, where texts begin and end, and the words as they are."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = np.asarray(cut.offsets, np.int64)
    coded = cut.flatten().dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=EDGES)
    return plain, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends - ends[0], coded.dictionary


def _entries_of(plain: pa.Array) -> list[tuple[np.ndarray, list[str]]]:
    """For each length of beginning and for whole words: the entry's number by word, or -1, and the entries."""
    sizes = pc.utf8_length(plain).to_numpy(zero_copy_only=False)
    out = []
    for n in range(SHORTEST, LONGEST + 1):
        coded = pc.utf8_slice_codeunits(plain, 0, n).dictionary_encode()
        out.append((np.where(sizes >= n, coded.indices.to_numpy(zero_copy_only=False), -1), coded.dictionary.to_pylist()))
    coded = pc.binary_join_element_wise(plain, pa.scalar(WHOLE, pa.large_string()), pa.scalar("", pa.large_string())).dictionary_encode()
    out.append((np.where(sizes >= 2, coded.indices.to_numpy(zero_copy_only=False), -1), coded.dictionary.to_pylist()))
    return out


def labelled(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, most: int = MOST_LABELS) -> DataFrame:
    """text and label (0 or 1) of at most ``most`` rows that learning may use, by hash order; equal texts once."""
    mean = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    chosen = mean.where(bucket_of(F.col("doc_id"), modulus) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("text").agg(F.max("label").alias("label"))


def _levels(times: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The highest of ``LEVELS`` that so many times in so many words reach, from 1; 0 for none."""
    out = np.zeros(len(times), np.int64)
    for k, (least, share) in enumerate(LEVELS, 1):
        out[(times >= least) & (times >= share * words)] = k
    return out


def _counted(rows: DataFrame) -> DataFrame:
    """entry, level, n and n_toxic: in how many labelled texts it comes up so often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                toxic = batch.column("label").slice(at, len(part)).to_numpy() == 1
                at += len(part)
                plain, index, ends, _ = _words(part)
                sizes = np.diff(ends)
                text = np.repeat(np.arange(len(part)), sizes)
                for by_word, entries in _entries_of(plain):
                    own = by_word[index]
                    pairs, times = np.unique(own[own >= 0] * len(part) + text[own >= 0], return_counts=True)
                    entry, where = pairs // len(part), pairs % len(part)
                    level = _levels(times, sizes[where])
                    for k in range(1, len(LEVELS) + 1):
                        up = level >= k
                        n, t = np.bincount(entry[up], minlength=len(entries)), np.bincount(entry[up], weights=toxic[where[up]], minlength=len(entries))
                        there = np.flatnonzero(n)
                        columns = [pa.array([entries[x] for x in there.tolist()], pa.string()), pa.array(np.full(len(there), k)), pa.array(n[there]), pa.array(t[there].astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, ["entry", "level", "n", "n_toxic"])

    found = rows.mapInArrow(count, "entry string, level long, n long, n_toxic long")
    return found.groupBy("entry", "level").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def _bound(part: Column, all_: Column) -> Column:
    """Wilson's lower bound of a share, two standard errors wide."""
    p, z2 = part / all_, 4.0
    return (p + z2 / (2 * all_) - F.sqrt(4 * (p * (1 - p) / all_ + z2 / (4 * all_ * all_)))) / (1 + z2 / all_)


def _places(plain: pa.Array, entries: list[str]) -> Iterator[np.ndarray]:
    """By word, the number of the entry that it is or begins with, or -1; once for each length of entries."""
    by_length: dict[int, list[int]] = {}
    for k, e in enumerate(entries):
        by_length.setdefault(0 if e.endswith(WHOLE) else len(e), []).append(k)
    for n, which in by_length.items():
        values = pa.array([entries[k].removesuffix(WHOLE) for k in which], plain.type)
        at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(plain, 0, n) if n else plain, values), -1).to_numpy(zero_copy_only=False)
        yield np.where(at >= 0, np.array(which, np.int64)[at], -1)


def _families(rows: DataFrame, entries: list[str]) -> DataFrame:
    """entry (its number), level, n and n_toxic: in how many texts it comes up so often that aren't copies of one another.

    Of the pairs of words between which an entry stands in a text the one of the least hash
    names the text's family: near copies of a text mostly have it in common.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                toxic = batch.column("label").slice(at, len(part)).to_numpy()
                at += len(part)
                plain, index, ends, _ = _words(part)
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in plain.to_pylist()), np.uint64, len(plain))
                flat, sizes = hashes[index], np.diff(ends)
                some = sizes > 0
                before, after = np.roll(flat, 1), np.roll(flat, -1)
                before[ends[:-1][some]] = after[ends[1:][some] - 1] = 0
                around = (before * np.uint64(0x9E3779B97F4A7C15) + after * MULTIPLIER + flat).view(np.int64)
                text = np.repeat(np.arange(len(part)), sizes)
                for own in _places(plain, entries):
                    hit = np.flatnonzero(own[index] >= 0)
                    key = own[index[hit]] * len(part) + text[hit]
                    order = np.lexsort((around[hit], key))
                    key, least = key[order], around[hit][order]
                    first = np.flatnonzero(np.diff(key, prepend=-1))
                    times = np.diff(np.append(first, len(key)))
                    where = key[first] % len(part)
                    columns = [key[first] // len(part), _levels(times, sizes[where]), least[first], toxic[where].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["entry", "level", "around", "toxic"])

    found = rows.mapInArrow(look, "entry long, level long, around long, toxic long").groupBy("entry", "around").agg(F.max("toxic").alias("toxic"), F.max("level").alias("level"))
    each = found.where("level > 0").select("entry", "toxic", F.explode(F.sequence(F.lit(1).cast("long"), "level")).alias("level"))
    return each.groupBy("entry", "level").agg(F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"))


def _purest(candidates: list[tuple[str, int, int, int]]) -> list[tuple[str, int]]:
    """Of (entry, level, n, n_toxic) those by which no better one is implied, likeliest first.

    What begins with a better entry is covered by it. A beginning of better ones, or an entry at
    a lower level, counts only with the texts that they leave it.
    """
    def bound(n: int, t: int) -> float:
        p = t / n
        return (p + 2 / n - (4 * (p * (1 - p) / n + 1 / (n * n))) ** 0.5) / (1 + 4 / n)

    chosen: dict[tuple[str, int], None] = {}
    covering: set[str] = set()
    taken: dict[str, tuple[int, int]] = {}
    for entry, level, n, t in sorted(candidates, key=lambda c: (-bound(c[2], c[3]), c[1], len(c[0]), c[0])):
        whole = entry.removesuffix(WHOLE)
        begins = [whole[:k] for k in range(SHORTEST, len(whole) + (entry != whole))]
        if any(b in covering for b in begins):
            continue
        gone = taken.get(entry, (0, 0))
        left, toxic = n - gone[0], t - gone[1]
        if toxic >= SUPPORT and left > 0 and bound(left, toxic) >= SHARE:
            chosen[entry, level] = None
            covering.add(entry)
            for b in (*begins, entry):
                m, u = taken.get(b, (0, 0))
                taken[b] = (m + left, u + toxic)
    return list(chosen)


def lexicon(rows: DataFrame, most: int = MOST_ENTRIES) -> list[tuple[str, int]]:
    """Beginnings of words and whole words with the level at which they stand mostly in the toxic
    ones of labelled ``rows``, most frequent first."""
    enough = (F.col("n_toxic") >= SUPPORT) & (_bound(F.col("n_toxic"), F.col("n")) >= SHARE)
    likely = _counted(rows).where(enough).orderBy(F.desc("n_toxic"), "entry", "level").limit(MOST_CANDIDATES)
    pure = _purest([(r["entry"], r["level"], r["n"], r["n_toxic"]) for r in likely.collect()])
    if not pure:
        return []
    entries = sorted({e for e, _ in pure})
    best = _families(rows, entries).where(enough).orderBy(F.desc("n_toxic"), "entry", "level").collect()  # three an entry at most
    wanted = set(pure)
    return [x for r in best if (x := (entries[r["entry"]], r["level"])) in wanted][:most]


def _bin_columns() -> list[tuple[str, float]]:
    return [(name, bound) for name, bounds in BINS.items() for bound in bounds]


def facts(docs: DataFrame, voters: list[tuple[str, int]]) -> DataFrame:
    """doc_id, votes and bins of every row, as bits: the lexicon's in order, then the patterns'."""
    entries = list(dict.fromkeys(e for e, _ in voters))
    of = [entries.index(e) for e, _ in voters]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = len(voters)
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                doc_ids = batch.column("doc_id").slice(at, len(part))
                at += len(part)
                plain, index, ends, words = _words(part)
                begins, sizes = ends[:-1], np.diff(ends)
                empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
                loud = pc.ends_with(words, "!").to_numpy(zero_copy_only=False)
                letters = pc.utf8_length(plain).to_numpy(zero_copy_only=False)
                caps = pc.utf8_is_upper(words).to_numpy(zero_copy_only=False) & (letters > 2)
                text = np.repeat(np.arange(len(part)), sizes)
                times, hit = np.zeros((len(part), len(entries)), np.int64), np.zeros(len(index), bool)
                for own in _places(plain, entries):
                    there = np.flatnonzero(own[index] >= 0)
                    np.add.at(times, (text[there], own[index[there]]), 1)
                    hit[there] = True

                def total(x: np.ndarray) -> np.ndarray:
                    so_far = np.concatenate([[0], np.cumsum(x)])
                    return so_far[ends[1:]] - so_far[begins]

                places = np.arange(len(index)) - np.repeat(begins, sizes)
                at_hit = np.flatnonzero(hit)
                near = (np.diff(at_hit) <= 10) & (text[at_hit[1:]] == text[at_hit[:-1]])
                close = np.zeros(len(part), bool)
                close[text[at_hit[1:][near]]] = True
                votes = np.zeros(len(part), np.int64)
                for k, (e, (_, level)) in enumerate(zip(of, voters, strict=True)):
                    votes |= (_levels(times[:, e], sizes) >= level).astype(np.int64) << k
                different = (times > 0).sum(1)
                n = total(~empty[index])
                hits, early = total(hit), total(hit & (places < 20))
                exclaimed, shouted = total(loud[index]), total(caps[index])
                mean = total(letters[index]) / np.maximum(n, 1)
                share, shout = hits / np.maximum(n, 1), exclaimed / np.maximum(n, 1)
                voted = (
                    different >= 2, hits >= 3, (hits >= 2) & (share >= 0.015), early > 0, close, (n > 0) & (shout >= 0.05), (n >= 5) & (shouted >= 0.2 * n),
                    hits == 0, (hits == 0) & (n >= 100), hits * 100 < n, (mean >= 5) & (exclaimed == 0),
                )
                for k, x in enumerate(voted):
                    votes |= x.astype(np.int64) << (first + k)
                values = {"hits": hits, "density": share, "words": n, "exclaimed": shout}
                bins = np.zeros(len(part), np.int64)
                for k, (name, bound) in enumerate(_bin_columns()):
                    bins |= (values[name] >= bound).astype(np.int64) << k
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(votes), pa.array(bins)], ["doc_id", "votes", "bins"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(look, FACTS)


def _bits(values: np.ndarray, n: int) -> np.ndarray:
    return (values[:, None] >> np.arange(n) & 1).astype(np.float64)


class LabelModel:
    """P(toxic) and each voter's rate by class, given its parent's vote if it has one.

    ``rates`` has the probability of a vote by class, voter and the parent's vote (0, 1).
    """

    def __init__(self, prior: float, rates: np.ndarray, parents: np.ndarray):
        self.prior, self.rates, self.parents = prior, rates, parents

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of votes given as bits."""
        x = _bits(votes, len(self.parents))
        above = np.where(self.parents >= 0, x[:, np.maximum(self.parents, 0)], 0).astype(np.int64)
        voter = np.arange(len(self.parents))
        logs = np.full((2, len(votes)), [[np.log(1 - self.prior)], [np.log(self.prior)]])
        for y in (0, 1):
            p = self.rates[y][voter, above]
            logs[y] += np.where(x > 0, np.log(p), np.log(1 - p)).sum(1)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracies(self) -> list[tuple[float, float]]:
        """Each voter's rate of votes in clean and in toxic texts (its parent abstaining)."""
        return [tuple(map(float, self.rates[:, k, 0])) for k in range(len(self.parents))]


def _moments(patterns: DataFrame, voters: int, posterior) -> tuple[np.ndarray, np.ndarray]:
    """By class, how many documents it is expected to have (2) and how many with votes of both voters of a pair (2 x voters x voters)."""

    def sums(batches):
        total = np.zeros((2, voters + 1, voters + 1))
        for batch in batches:
            votes, n = batch["votes"].to_numpy(np.int64), batch["n"].to_numpy(np.float64)
            q = posterior(votes)
            x = np.column_stack([np.ones(len(votes)), _bits(votes, voters)])
            for y, w in enumerate((n * (1 - q), n * q)):
                total[y] += (x * w[:, None]).T @ x
        yield pd.DataFrame({"s": [total.ravel().tolist()]})

    parts = patterns.mapInPandas(sums, "s array<double>")
    rows = parts.select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # 2 x (voters + 1)^2
    out = np.zeros(2 * (voters + 1) ** 2)
    for r in rows:
        out[r["k"]] = r["v"]
    out = out.reshape(2, voters + 1, voters + 1)
    return out[:, 0, 0], out[:, 1:, 1:]


def _rates(count: np.ndarray, both: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Rates of votes by class, voter and parent's vote, smoothed by a vote and an abstention."""
    n = len(parents)
    out = np.zeros((2, n, 2))
    for y in (0, 1):
        single = np.diag(both[y])
        up = np.where(parents >= 0, single[np.maximum(parents, 0)], 0.0)
        joint = np.where(parents >= 0, both[y][np.arange(n), np.maximum(parents, 0)], 0.0)
        out[y, :, 1] = (joint + 0.5) / (up + 1)
        out[y, :, 0] = (single - joint + 0.5) / (count[y] - up + 1)
    return np.clip(out, 1e-6, 1 - 1e-6)


def _information(count: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Mutual information of each pair of voters given the class, in nats."""
    n, total = both.shape[1], count.sum()
    out = np.zeros((n, n))
    for y in (0, 1):
        if count[y] <= 0:
            continue
        p = np.clip(np.diag(both[y]) / count[y], 0, 1)
        p11 = both[y] / count[y]
        for a, b, joint in ((1, 1, p11), (1, 0, p[:, None] - p11), (0, 1, p[None, :] - p11), (0, 0, 1 - p[:, None] - p[None, :] + p11)):
            alone = (p if a else 1 - p)[:, None] * (p if b else 1 - p)[None, :]
            there = (joint > 1e-12) & (alone > 1e-12)
            out += count[y] / total * np.where(there, joint * np.log(np.where(there, joint, 1) / np.where(there, alone, 1)), 0)
    return out


def _forest(information: np.ndarray, least: float = DEPENDENT) -> np.ndarray:
    """Each voter's parent (-1: none) in the maximum spanning forest of the dependent pairs."""
    n = len(information)
    parents, reached = np.full(n, -1), np.zeros(n, bool)
    best, by = np.full(n, -1.0), np.full(n, -1)
    for _ in range(n):
        k = int(np.argmax(np.where(reached, -2.0, best)))
        reached[k] = True
        parents[k] = by[k]
        better = ~reached & (information[k] > best) & (information[k] >= least)
        best[better], by[better] = information[k][better], k
    return parents


def fit_label_model(patterns: DataFrame, known: DataFrame, voters: int, rounds: int = ROUNDS) -> LabelModel:
    """The generative model for ``patterns`` (votes, n) of so many voters.

    The votes of the few labelled texts (``known``: votes, label, n) start it and keep as much
    weight as all others, so that the classes stay what the labels mean by them. Voters are
    independent at first, then joined to a forest.
    """
    def told(label: int) -> tuple[np.ndarray, np.ndarray]:
        return _moments(known.where(F.col("label") == label).select("votes", "n"), voters, lambda votes: np.full(len(votes), float(label)))

    anchors = [a + b for a, b in zip(told(0), told(1), strict=True)]
    parents, found = np.full(voters, -1), anchors

    def fitted() -> LabelModel:
        return LabelModel(float(np.clip(found[0][1] / max(found[0].sum(), 1), 1e-6, 1 - 1e-6)), _rates(*found, parents), parents)

    for phase in (0, 1):
        if phase:
            parents = _forest(_information(*found))
        for _ in range(rounds):
            seen = _moments(patterns, voters, fitted().posterior)
            weight = seen[0].sum() / max(anchors[0].sum(), 1)
            found = [x + weight * y for x, y in zip(seen, anchors, strict=True)]
    return fitted()


class Classifier:
    """Weights of votes and bins; ``score()`` is their Spark column over ``votes`` and ``bins``."""

    def __init__(self, voters: int, weights: list[float], intercept: float):
        self.voters, self.weights, self.intercept = voters, weights, intercept

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for k, w in enumerate(self.weights):
            if w:
                bits, place = (F.col("votes"), k) if k < self.voters else (F.col("bins"), k - self.voters)
                total = total + F.when(F.shiftrightunsigned(bits, place).bitwiseAND(F.lit(1)) == 1, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_classifier(patterns: DataFrame, model: LabelModel, penalty: float = PENALTY) -> Classifier:
    """A logistic regression of ``patterns`` (votes, bins, n) on the label model's probabilities.

    Every pattern is there as toxic and as clean, weighted by its documents and probability.
    """
    voters, bins = len(model.parents), len(_bin_columns())

    def judged(batches):
        for batch in batches:
            q = model.posterior(batch["votes"].to_numpy(np.int64))
            x = np.column_stack([_bits(batch["votes"].to_numpy(np.int64), voters), _bits(batch["bins"].to_numpy(np.int64), bins)]).tolist()
            for label, w in ((1.0, q), (0.0, 1 - q)):
                yield batch.assign(label=label, weight=batch["n"] * w, x=x)[["label", "weight", "x"]]

    rows = patterns.mapInPandas(judged, "label double, weight double, x array<double>").where("weight > 0")
    data = rows.select("label", "weight", array_to_vector("x").alias("features"))
    fitted = LogisticRegression(weightCol="weight", regParam=penalty, standardization=False, maxIter=100).fit(data)
    return Classifier(voters, [float(w) for w in fitted.coefficients.toArray()], float(fitted.intercept))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, learnt from all their votes and the open ``labels``."""
    rows = written(labelled(docs, labels), "labelled")
    n, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    entries = lexicon(rows) if toxic else []
    held = bucket_of(F.col("doc_id"), 5) == 0
    if not entries:
        share = (toxic or 0) / n if n else 0.0
        drop_written(rows)
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.lit(share).alias("score"), F.lit(int(share >= threshold)).alias("predicted"))
    known = written(facts(rows.select(F.col("label").alias("doc_id"), "text"), entries).groupBy("votes", F.col("doc_id").alias("label")).agg(F.count("*").alias("n")), "known")
    seen = written(facts(docs, entries), "votes")
    patterns = written(seen.groupBy("votes", "bins").agg(F.count("*").alias("n")), "patterns")
    model = fit_label_model(patterns.groupBy("votes").agg(F.sum("n").alias("n")), known, len(entries) + len(PATTERNS))
    scored = seen.select("doc_id", fit_classifier(patterns, model).score().alias("score"))
    for df in (rows, known, patterns):
        drop_written(df)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
