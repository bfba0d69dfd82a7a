"""Operator 13 against all edit sequences of small conversations and against its SQL."""

import hashlib
import random
import re
import zlib

import pandas as pd
import pytest

from levelscope.llm import conversation_repair as R
from levelscope.llm.sql import ORACLES

LAWFUL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) over all edit sequences with at most so many inserted turns as could pay."""
    marks, best = faults(rows), None
    stack = [(0, 0, "", (), "")]
    while stack:
        k, cost, audit, out, form = stack.pop()
        if best and cost > best[0]:
            continue
        if k == len(rows) and LAWFUL.fullmatch(form) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        if cost + 5 <= (best[0] if best else 2 * len(rows)):
            for role in ("user", "assistant"):
                stack.append((k, cost + 5, audit + "I", (*out, (role, "")), form + role[0]))
        if k < len(rows):
            role, text = rows[k]
            extra = 5 * (marks[k] == "truncated")
            if marks[k] not in ("blank", "duplicate"):
                stack.append((k + 1, cost + extra, audit + "K", (*out, (role, text)), form + (role[:1] or "-")))
                for other in ("user", "assistant"):
                    stack.append((k + 1, cost + 1 + extra, audit + "R", (*out, (other, text)), form + other[0]))
            stack.append((k + 1, cost + 2, audit + "D", out, form))
    return best


def test_all_edit_sequences():
    r = random.Random(3)
    roles = ["system", "user", "assistant", "tool", " ", ""]
    texts = ["A.", "B!", "cut", "", " \n", "long one?", "C. \t"]
    convs = [[(r.choices(roles, [2, 5, 5, 1, 1, 1])[0], r.choice(texts)) for _ in range(r.randrange(1, 6))] for _ in range(250)]
    frame = pd.DataFrame([(k, t, role, text) for k, c in enumerate(convs) for t, (role, text) in enumerate(c)], columns=["conv_id", "turn", "role", "text"])
    got = R.repair_rows(frame).set_index("conv_id")
    for k, c in enumerate(convs):
        cost, audit, out = cheapest(c)
        assert (got.loc[k, "cost"], got.loc[k, "audit"]) == (cost, audit), c
        assert [(x["role"], x["text"]) for x in got.loc[k, "repaired"]] == list(out)
        assert got.loc[k, "repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        marks = faults(c)
        assert [got.loc[k, n] for n in ("blank", "duplicate", "truncated")] == [marks.count(n) for n in ("blank", "duplicate", "truncated")]
        assert got.loc[k, "illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(c, c[1:], strict=False))


def test_batches_do_not_cut_conversations(monkeypatch):
    """The same rows in one batch, and in batches of seven with a conversation longer than what is worked off together."""
    r = random.Random(4)
    rows = [(k, t, r.choice(["user", "assistant", "system"]), r.choice(["x.", "y", f"{t}!", ""])) for k, n in enumerate([3, 40, 1, 1, 12, 5]) for t in range(n)]
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    whole = R.repair_rows(frame)
    monkeypatch.setattr(R, "TOGETHER", 10)
    parts = pd.concat(R._stream(frame.iloc[k : k + 7] for k in range(0, len(frame), 7)), ignore_index=True)
    pd.testing.assert_frame_equal(parts, whole, check_dtype=False)


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


@pytest.fixture(scope="module")
def conversations(spark):
    """Nulls in every column, repeated and tied rows, gaps, long texts, lost conversations, clashing columns."""
    r = random.Random(8)
    rows = [(k, t * r.choice([1, 1, 1, 3]), r.choice(["system", "user", "assistant", None]), r.choice(["Yes.", "no", None, "Why? ", "\t", "x. y! " * 50])) for k in range(60) for t in range(r.randrange(1, 7))]
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b"), (None, None, None, None), (7, None, "user", "q?"), (7, None, "assistant", "w."), (7, 2, "user", "e."), (7, 2, "user", "e.")]
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(700)]
    gone = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "lost")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("x") for c in ("_kind", "_copy", "cost", "audit", "gaps", "repaired")}), rows, gone


def test_damage(conversations):
    df, rows, _ = conversations
    got = [tuple(x) for x in R.damaged(df).collect()]
    assert sorted(got, key=str) == sorted(damaged(rows), key=str)


def test_query_equals_its_sql(spark, conversations, tmp_path):
    import duckdb

    df, rows, gone = conversations
    path = str(tmp_path / "conversations.parquet")
    df.select("conv_id", "turn", "role", "text").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = {x[0]: x for x in con.sql(ORACLES["op13_conversation_repair"]).select(*columns).fetchall()}
    got = {x[0]: tuple(x) for x in R.damaged_and_repaired(df).select(*columns).collect()}
    for k in want:
        assert got[k] == want[k]
    assert got.keys() == want.keys()
    assert got[gone] == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert len(got) == len({c for c, *_ in rows})


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.damaged_and_repaired(empty).count() == 0
