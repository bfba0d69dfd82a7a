"""Operator 12: votes against plain Python, the label model against its formulas, held-out texts, edge cases."""

import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from levelscope.llm import toxicity as T

from .conftest import prose

BAD = ["zorgle", "fribbous", "mucktard"]


def text_of(seed, toxic):
    r = random.Random(seed)
    words = prose(seed, r.randrange(30, 120)).split(" ")
    for _ in range(r.randrange(2, 5) if toxic else 0):
        words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "", "s", ",", "!"]))
    if r.random() < 0.3:  # "zor" also begins clean words
        words.insert(r.randrange(len(words)), "zorban")
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(k, text_of(k, k % 4 == 0), int(k % 4 == 0)) for k in range(500)]
    first = "a quixwort " + rows[0][1]
    rows += [(500 + k, first + " " + prose(k, 2), 1) for k in range(40)]  # copies of a toxic text with a word of their own
    docs = [(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (902, " \n\t"), (903, "ZORGLE!"), (904, prose(5, 9000)), (904, prose(5, 9000)), (None, "you fribbous mucktard, zorgle zorgle")]
    labels = [(k, 1, x) for k, _, x in rows] + [(3, 1, 0), (None, 1, 1), (8, None, None), (7777, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("votes", "bins", "n", "label", "entry", "weight", "features", "source")})
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: x for k, _, x in rows}


@pytest.fixture(scope="module")
def classified(tables):
    docs, labels, _ = tables
    return T.classify(docs, labels).collect()


def test_held_out(tables, classified):
    truth = tables[2]
    held = [r for r in classified if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in classified)
    assert [r["doc_id"] for r in held if r["predicted"] != truth[r["doc_id"]]] == []
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in classified)


def test_edge_rows(tables, classified):
    by_id = {}
    for r in classified:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(classified) == tables[0].count()
    assert [by_id[k][0]["predicted"] for k in (900, 901, 902, 904)] == [0, 0, 0, 0]
    assert by_id[900][0]["score"] == by_id[901][0]["score"] == by_id[902][0]["score"]
    assert len(by_id[904]) == 2 and by_id[904][0]["score"] == by_id[904][1]["score"]
    assert by_id[None][0]["predicted"] == 1


def test_labels_of_held_out_rows_are_not_read(tables, classified):
    """Other labels for all held-out rows leave every score as it was."""
    docs, labels, _ = tables
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda r: (str(r["doc_id"]), r["score"])
    a, b = sorted(map(key, classified)), sorted(map(key, T.classify(docs, other).collect()))
    assert [x for x, _ in a] == [x for x, _ in b]
    assert np.allclose([x for _, x in a], [x for _, x in b], atol=1e-6)


def test_lexicon_finds_stems_and_no_copies(tables):
    docs, labels, _ = tables
    entries = T.lexicon(T.labelled(docs, labels))
    assert {e for e, _ in entries} >= {"zorg", "fri", "muc"} or {e[:3] for e, _ in entries} >= {"zor", "fri", "muc"}
    assert all(any(b.startswith(e.removesuffix("$")) for b in ("zorgle", "fribbous", "mucktard")) for e, _ in entries), entries


def test_votes_against_plain_python(spark):
    voters = [("zorg", 1), ("zorg", 2), ("me$", 1)]
    texts = ["zorgle Zorga, (me) x", "me! zorg " + "word " * 150, "", None, "some mez", "ZORG zorg zorg stay"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in T.facts(df, voters).collect()}
    for k, text in enumerate(texts):
        words = (text or "").split()
        plain = [w.lower().strip(T.EDGES) for w in words]
        zorg = sum(w.startswith("zorg") for w in plain)
        hits = [w.startswith("zorg") or w == "me" for w in plain]
        votes = [zorg >= 1, zorg >= 2 and zorg >= 0.01 * len(words), "me" in plain]
        names = dict(zip([n for n, _ in T.PATTERNS], [rows[k]["votes"] >> (3 + j) & 1 for j in range(len(T.PATTERNS))], strict=True))
        assert [rows[k]["votes"] >> j & 1 for j in range(3)] == list(map(int, votes)), text
        assert names["two entries"] == int(zorg > 0 and "me" in plain)
        assert names["three words"] == int(sum(hits) >= 3) and names["none"] == int(not any(hits))
        assert names["among the first twenty"] == int(any(hits[:20]))
        bins = dict(zip(T._bin_columns(), [rows[k]["bins"] >> j & 1 for j in range(99)], strict=False))
        assert all(bins["hits", b] == int(sum(hits) >= b) for b in T.BINS["hits"]) and all(bins["words", b] == int(len(words) >= b) for b in T.BINS["words"])


def test_label_model_finds_rates_and_dependence(spark):
    """Votes drawn from a known model with a voter that copies another."""
    r = np.random.default_rng(5)
    n = 20_000
    y = r.random(n) < 0.2
    rates = [(0.02, 0.7), (0.05, 0.6), (0.01, 0.5), (0.8, 0.1)]
    x = [np.where(y, r.random(n) < b, r.random(n) < a) for a, b in rates]
    x.append(np.where(r.random(n) < 0.95, x[0], ~x[0]))
    votes = np.sum([v.astype(np.int64) << k for k, v in enumerate(x)], axis=0)
    frame = pd.DataFrame({"votes": votes, "label": y.astype(int)})
    patterns = spark.createDataFrame(frame.groupby("votes").size().reset_index(name="n"))
    known = spark.createDataFrame(frame[:200].groupby(["votes", "label"]).size().reset_index(name="n"))
    model = T.fit_label_model(patterns, known, 5)
    assert abs(model.prior - 0.2) < 0.02
    assert model.parents[4] == 0 or model.parents[0] == 4
    for k in range(4):
        found = [(votes[y == bool(c)] >> k & 1).mean() for c in (0, 1)]
        if model.parents[k] < 0:  # voters that hang on no other
            assert np.allclose(model.rates[:, k, 0], found, atol=0.05)
    # the posterior is the product of the rates along the forest
    for bits in itertools.product((0, 1), repeat=5):
        p = []
        for c, prior in ((0, 1 - model.prior), (1, model.prior)):
            for k, b in enumerate(bits):
                rate = model.rates[c, k, bits[model.parents[k]] if model.parents[k] >= 0 else 0]
                prior *= rate if b else 1 - rate
            p.append(prior)
        assert np.isclose(model.posterior(np.array([sum(b << k for k, b in enumerate(bits))]))[0], p[1] / (p[0] + p[1]))
    q = model.posterior(votes)
    assert ((q >= 0.5) == y).mean() > 0.93


def test_no_toxic_labels_and_empty_tables(spark, tables):
    docs, labels, _ = tables
    none = T.classify(docs, labels.where("toxic = 0")).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert {r["score"] for r in T.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert T.classify(docs.limit(0), labels).count() == 0
