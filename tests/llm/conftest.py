import pytest

WORDS = "the of and to in that stone river green bright walks under seven houses quiet morning paper engine letters copper".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "s", "ed", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with nulls, empty and long texts, copies, repeated rows and clashing columns."""
    rows = [(k, prose(k, 30 + 7 * k), "en", f"src{k % 3}", 0) for k in range(30)]
    base = prose(3, 51).split(" ")
    changed = base[:25] + ["altered"] + base[26:]
    rows += [(40, " ".join(base), "en", "src0", 0), (41, " ".join(changed), "en", "src0", 0), (42, None, "en", "src1", 0), (43, "", None, None, 0), (44, "  \n\t ", "fr", "src2", 0)]
    rows += [(45, "One", "en", "src0", 0), (46, "one", "en", "src0", 0), (47, "a<|endoftext|>b  c\n d \\ <| é 漢字 \U0001f600", "en", "src1", 0)]
    rows += [(48, " ".join([prose(1, 8)] * 40), "en", "src1", 0), (49, prose(9, 6000), "en", "src1", 0), (49, prose(9, 6000), "en", "src1", 0), (None, prose(77, 12), "en", "src1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    clash = {c: F.lit("x") for c in ("words", "length", "class", "label", "_hash", "spans", "n", "seed", "bucket")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def texts(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
