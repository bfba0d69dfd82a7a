"""Repair of conversations: the cheapest edits that give turns a lawful order, and their audit.

A conversation is lawful if the initials of its roles read ``(s?(ua)+)?``. Edits: Keep a row
(0), Rerole it to user or assistant (1), Delete it (2; the only way with blank and repeated
rows), Insert an empty turn of user or assistant anywhere (5). A truncated row that isn't
deleted costs 5 more. The audit has a letter for each edit in turn, D, I, K or R; of equally
cheap ones the ASCII-least counts.

A node is a row still to come and the state of the order: nothing yet, after a system turn,
after a user's, after an assistant's. A dynamic program over the rows gives every node its
cost to the end. Arcs that keep to it are optimal. Nodes are then ranked by the first 1, 2,
4, ... letters of their least audits: a node's rank by twice as many letters is that of its
own rank and the rank of the node its doubled pointer leads to. The ranks choose the arc at
each node, and the pointers give all places of the path at once. A whole batch of
conversations is worked off together.

Spark deals conversations out and sorts their rows; within a task they stream by. The digest
of a repaired conversation chains all its text, so that one conversation stays in one task,
which holds its rows while it is worked off.

Nulls: a null role or text is one space; a null conversation or turn stands as one space in
the key that damage depends on; rows of a null conversation are one conversation. An empty
role has no initial and can't be kept. Rows go by
turn, nulls first, rows of equal turns by role and text; repeated rows are duplicates.
Conversations without a row left give zeros, an empty audit and the digest of the empty text.
An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of whole conversations that a task works off together.
TOGETHER = 20_000
ROWS = "conv_id long, turn long, role string, text string"
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired array<struct<role: string, text: string>>"

# States: nothing yet, after system, after user, after assistant. The turn that may follow
# each (user or assistant) and the state that it leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: States to which keeping a row leads, by its initial (s, u, a, other) and the state before; -1: not lawful.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
_FAR = 1 << 40
_LETTERS = "DIKR"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` after the damage that the crc32 of conversation and turn chooses."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *part).cast("binary")) % 20
    one = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return one.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def _faults(rows: pd.DataFrame, conv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each row is blank, else repeated, else truncated."""
    bare = rows["text"].str.strip(" \t\n\x0b\x0c\r")
    blank = (bare == "").to_numpy()
    seen = pd.DataFrame({"conv": conv, "role": rows["role"], "text": rows["text"]}).duplicated().to_numpy()
    cut = ~bare.str[-1:].isin([".", "!", "?"]).to_numpy()
    return blank, ~blank & seen, ~blank & ~seen & cut


def _costs(begins: np.ndarray, lengths: np.ndarray, initial: np.ndarray, fixed: np.ndarray, truncated: np.ndarray) -> np.ndarray:
    """Cost to the end from each node, (rows + conversations) x 4; a conversation's nodes start at begins + its number."""
    first = begins + np.arange(len(begins))
    cost = np.full((int(lengths.sum()) + len(begins), 4), _FAR, np.int64)
    cost[first + lengths] = [0, 2 * INSERT, INSERT, 0]
    order = np.argsort(-lengths, kind="stable")
    longest = lengths[order]
    for back in range(1, int(longest[0]) + 1 if len(longest) else 0):
        live = order[: np.searchsorted(-longest, -back, side="right")]  # conversations with so many rows
        row, node = (begins + lengths)[live] - back, (first + lengths)[live] - back
        after = np.column_stack([cost[node + 1], np.full(len(live), _FAR)])  # the last column is for what isn't lawful
        with_row = truncated[row] * TRUNCATED + np.where(fixed[row], _FAR, 0)
        kept = np.take_along_axis(after, KEPT[initial[row]], 1) + KEEP
        own = np.minimum(after[:, :4] + DELETE, np.minimum(kept, after[:, NEXT] + REROLE) + with_row[:, None])
        own = np.minimum(own, _FAR)
        user, assistant = own[:, USER].copy(), own[:, ASSISTANT].copy()
        own[:, USER] = np.minimum(user, assistant + INSERT)
        own[:, ASSISTANT] = np.minimum(assistant, user + INSERT)
        own[:, :2] = np.minimum(own[:, :2], own[:, [USER]] + INSERT)
        cost[node] = own
    return cost


def _arcs(cost: np.ndarray, first: np.ndarray, lengths: np.ndarray, initial: np.ndarray, fixed: np.ndarray, truncated: np.ndarray) -> np.ndarray:
    """Where each node's D, I, K and R lead if they are optimal, else -1; the last node is the end of all paths."""
    n = len(cost)
    sink = 4 * n
    targets = np.full((sink + 1, 4), -1, np.int64)
    level = np.arange(n)
    states = np.arange(4)
    inserted = 4 * level[:, None] + NEXT[states]
    best = cost < _FAR
    targets[:sink, 1].reshape(n, 4)[:] = np.where(best & (cost[:, NEXT] + INSERT == cost), inserted, -1)
    inner = np.ones(n, bool)
    inner[first + lengths] = False  # no row to come
    level = level[inner]
    after = np.column_stack([cost[level + 1], np.full(len(level), _FAR)])
    here, best = cost[level], best[level]
    extra = (truncated * TRUNCATED)[:, None] + np.where(fixed, _FAR, 0)[:, None]
    base = 4 * (level + 1)[:, None]
    kept = KEPT[initial]
    for letter, ok, to in (
        (0, after[:, :4] + DELETE == here, base + states),
        (2, np.take_along_axis(after, kept, 1) + KEEP + extra == here, base + kept),
        (3, after[:, NEXT] + REROLE + extra == here, base + NEXT[states]),
    ):
        nodes = 4 * level[:, None] + states
        targets[nodes, letter] = np.where(best & ok, to, -1)
    return targets


def _least(targets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Doubled pointers along each node's least audit, by powers of two, and its first letter (4: none).

    Ranks by 1, 2, 4, ... letters; the empty end ranks before all letters. From the ranks by all
    letters each node takes the arc of the least letter and, if letters were equal, least rank.
    """
    sink = len(targets) - 1
    has = targets >= 0
    letter = np.where(has.any(1), has.argmax(1), 4)
    step = np.where(letter < 4, np.take_along_axis(targets, np.minimum(letter, 3)[:, None], 1)[:, 0], sink)
    rank, jump = np.where(letter < 4, letter + 1, 0), step
    while (jump != sink).any():
        rank = np.unique(rank * (sink + 1) + rank[jump], return_inverse=True)[1]
        jump = jump[jump]
    order = np.where(has, np.arange(4) * (sink + 1) + rank[targets], 5 * (sink + 1))
    letter = np.where(has.any(1), order.argmin(1), 4)
    step = np.where(letter < 4, np.take_along_axis(targets, np.minimum(letter, 3)[:, None], 1)[:, 0], sink)
    doubled = [step]
    while (doubled[-1] != sink).any():
        doubled.append(doubled[-1][doubled[-1]])
    return doubled, letter


def _path(start: int, doubled: list[np.ndarray], letter: np.ndarray) -> tuple[str, np.ndarray]:
    """The audit from ``start`` and the nodes that its letters leave, every place by the bits of its number."""
    sink, length, at = len(letter) - 1, 0, start
    for k in reversed(range(len(doubled))):
        if doubled[k][at] != sink:
            at, length = doubled[k][at], length + (1 << k)
    length += letter[at] < 4
    places, nodes = np.arange(length), np.full(length, start)
    for k, jump in enumerate(doubled):
        nodes = np.where(places >> k & 1, jump[nodes], nodes)
    return "".join(_LETTERS[x] for x in letter[nodes]), nodes


def repair_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole conversations, each one's rows together and in order, to a row of ``REPAIRED`` each."""
    rows = rows.reset_index(drop=True)
    if not len(rows):
        return pd.DataFrame(columns=[c.split()[0] for c in REPAIRED.split(", ")[:10]])
    ids = rows["conv_id"].astype("Int64")
    known = ids.fillna(0).to_numpy(np.int64)
    null = ids.isna().to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], (known[1:] != known[:-1]) | (null[1:] != null[:-1])]))
    lengths = np.diff(np.append(begins, len(rows)))
    conv = np.repeat(np.arange(len(begins)), lengths)
    blank, repeated, cut = _faults(rows, conv)
    fixed = blank | repeated
    head = rows["role"].str[:1]
    initial = head.map({"s": 0, "u": 1, "a": 2}).fillna(3).to_numpy(np.int64)
    lawful = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool)  # su, ua, au
    illegal = np.concatenate([[False], ~lawful[initial[:-1], initial[1:]]])
    illegal[begins] = False
    cost = _costs(begins, lengths, initial, fixed, cut)
    first = begins + np.arange(len(begins))
    doubled, letter = _least(_arcs(cost, first, lengths, initial, fixed, cut))
    turns = rows["turn"].astype("Int64")
    spans = pd.DataFrame({"conv": conv, "turn": turns}).groupby("conv")["turn"].agg(["min", "max", "nunique"])
    gaps = (spans["max"] - spans["min"] + 1 - spans["nunique"]).fillna(0).astype("int64").to_numpy()
    totals = {n: np.add.reduceat(x.astype(np.int64), begins) for n, x in (("blank", blank), ("duplicate", repeated), ("truncated", cut), ("illegal", illegal))}
    roles, texts = rows["role"].tolist(), rows["text"].tolist()
    audits, digests, all_repaired = [], [], []
    for k, (row, node) in enumerate(zip(begins.tolist(), first.tolist(), strict=True)):
        audit, nodes = _path(4 * node, doubled, letter)
        repaired = []
        for edit, state in zip(audit, (nodes % 4).tolist(), strict=True):
            turn = "user" if NEXT[state] == USER else "assistant"
            if edit == "I":
                repaired.append((turn, ""))
                continue
            if edit != "D":
                repaired.append((roles[row] if edit == "K" else turn, texts[row]))
            row += 1
        audits.append(audit)
        digests.append(hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode("utf-8", "surrogatepass")).hexdigest())
        all_repaired.append([{"role": r, "text": t} for r, t in repaired])
    return pd.DataFrame({"conv_id": ids[begins].to_numpy(), "gaps": gaps, **totals, "cost": cost[first, START], "audit": audits, "repaired_sha256": digests, "repaired": all_repaired})


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows to repaired conversations; the last conversation of a batch waits for its end."""
    held: list[pd.DataFrame] = []
    size = 0

    def done(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        ids = rows["conv_id"].astype("Int64")
        last = ids.iloc[-1]
        open_ = ids.isna() if pd.isna(last) else (ids == last).fillna(False)
        return rows[~open_], rows[open_]

    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch)
        if size >= TOGETHER:
            whole, rest = done(pd.concat(held, ignore_index=True))
            held, size = [rest], 0 if len(whole) else size - TOGETHER
            if len(whole):
                yield repair_rows(whole)
    if held:
        yield repair_rows(pd.concat(held, ignore_index=True))


def repair(conversations: DataFrame) -> DataFrame:
    """Each conversation of ``conversations`` (conv_id, turn, role, text) with its faults, cost, audit and repaired turns."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(_stream, REPAIRED)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table after damage and repair; those that lost all rows give zeros."""
    found = repair(damaged(conversations)).drop("repaired")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.alias("e").join(found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    numbers = [F.coalesce(f"f.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("e.conv_id", *numbers, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(empty)).alias("repaired_sha256"))

