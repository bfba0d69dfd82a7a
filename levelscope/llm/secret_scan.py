"""Secret scanning with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query of trigrams is derived that holds for
every text the expression can match (an OR of ANDs, in lower case). One pass over the texts
makes postings (trigram, doc_id, text hash) of the trigrams that the rules ask for;
intersecting the postings of a clause gives a rule's candidates, and only these are verified
by the expression itself. Rules without a mandatory trigram scan every text.

Spans count code points, end exclusive. A rule's matches are leftmost and don't overlap; a
match whose checked group is too short is dropped. Redaction replaces the union of spans.

Nulls and ties: a null text is empty and has no spans; redaction leaves it null. Rows that
repeat a doc_id are scanned each on their own, and a null doc_id is an id like any other.
Equal spans of several rules are all listed. Columns beyond doc_id and text are not read by
``scan`` and are passed on by ``redact``; their names may be anything but doc_id and text.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: Candidates (24 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bounds of a derived query: strings followed at once, and clauses.
MOST_STRINGS, MOST_CLAUSES = 16, 32


@dataclass(frozen=True)
class Rule:
    """``group`` of a match needs ``least`` characters, else the match is dropped."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Rule("assign", ASSIGN, 2, 6), Rule("access", r"AKIA[A-Z0-9]+", 0, 20), Rule("hex", r"[0-9a-f]{24,}", 0, 24))
#: Fixed forms of keys that services publish.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE
REDACTED = "[REDACTED]"
#: Code points of the blocks that a text is cut into to copy what lies between its spans.
BLOCK = 4096


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """An OR of ANDs of lower-case trigrams that every match has; None if there is none.

    The pattern is walked as a sequence of pieces with few possible strings each; pieces
    that can be anything cut the sequence. Each way through it gives a clause.
    """
    ways = [""]
    clauses: set[frozenset[str]] = {frozenset()}

    def cut() -> None:
        nonlocal ways, clauses
        found = {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in ways}
        both = {a | b for a, b in product(clauses, found)}
        if len(both) <= MOST_CLAUSES:  # else what is known already must do
            clauses = both
        ways = [""]

    for piece in _strings(rp.parse(pattern)):
        if piece is None or len(ways) * len(piece) > MOST_STRINGS:
            cut()
        if piece is not None and len(piece) <= MOST_STRINGS:
            ways = [a + b for a, b in product(ways, piece)]
    cut()
    if frozenset() in clauses:
        return None
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _strings(parsed) -> list[list[str] | None]:
    """For each piece of a parsed pattern the lower-case strings it can be; None for anything."""
    out: list[list[str] | None] = []
    for kind, value in parsed:
        if kind is rc.LITERAL:
            out.append([chr(value).lower()])
        elif kind is rc.IN and all(k is rc.LITERAL for k, _ in value):
            out.append(sorted({chr(v).lower() for _, v in value}))
        elif kind is rc.SUBPATTERN:
            out += _strings(value[3])
        elif kind is rc.BRANCH:
            whole = [_whole(_strings(branch)) for branch in value[1]]
            out.append(None if None in whole else sorted(set().union(*whole)))
        elif kind in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, inner = value
            one = _whole(_strings(inner))
            if (low, high) == (0, 1) and one is not None:
                out.append(["", *one])
            else:
                out += _strings(inner) * min(low, 3)
                if high != low or low > 3:
                    out.append(None)
        elif kind is not rc.AT:
            out.append(None)
    return out


def _whole(pieces: list[list[str] | None]) -> list[str] | None:
    ways = [""]
    for piece in pieces:
        if piece is None or len(ways) * len(piece) > MOST_STRINGS:
            return None
        ways = [a + b for a, b in product(ways, piece)]
    return ways


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc_id and text_hash for each of ``trigrams`` that a text has, once a text."""
    held = [F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams]
    found = texts.withColumn("folded", F.lower("text")).select("doc_id", "text_hash", F.array_compact(F.array(*held)).alias("trigrams"))
    return found.select(F.explode("trigrams").alias("trigram"), "doc_id", "text_hash")


def candidates(index: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """doc_id, text_hash and the rules that the text may match, by intersecting postings.

    A text's postings meet in one group, at most one for each trigram that the rules use.
    """
    has = index.groupBy("doc_id", "text_hash").agg(F.collect_set("trigram").alias("has"))
    may = []
    for name, clauses in sorted(queries.items()):
        either = F.lit(False)
        for clause in clauses:
            wanted = F.array(*[F.lit(t) for t in sorted(clause)])
            either = either | (F.size(F.array_except(wanted, "has")) == 0)
        may.append(F.when(either, F.lit(name)))
    return has.select("doc_id", "text_hash", F.array_compact(F.array(*may)).alias("may")).where(F.size("may") > 0)


def running(values: Column, combine) -> Column:
    """Inclusive running ``combine`` of an array of numbers, in log2(n) passes over it.

    Pass d combines each element with the one 2^d before it; appending to an array element by
    element would copy it each time.
    """

    def scanned(own: Column) -> Column:
        steps = F.when(F.size(own) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(own))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

        def double(state: Column, d: Column) -> Column:
            far = F.pow(F.lit(2), d).cast("int")
            return F.transform(state, lambda x, i: F.when(i >= far, combine(x, F.get(state, i - far))).otherwise(x))

        return F.aggregate(steps, own, double)

    return let(values, scanned)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's matches in a text.

    What lies between matches comes from splitting at them, so a match ends after all gaps
    and matches up to it.
    """
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def placed(found: Column) -> Column:
        gaps = F.split(text, rule.pattern, -1)
        ends = running(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)), lambda x, y: x + y)
        value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
        rows = F.arrays_zip(ends.alias("end"), found.alias("match"), value.alias("value"))
        kept = F.filter(rows, lambda x: F.length(x["value"]) >= rule.least)
        return F.transform(kept, lambda x: F.struct((x["end"] - F.length(x["match"])).alias("start"), x["end"].alias("end"), F.lit(rule.name).alias("kind")))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` plus ``_spans``: all rules' spans by start, then in the rules' order."""
    queries = {r.name: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    texts = keyed.where("text IS NOT NULL").select("doc_id", "text", F.col("_text_hash").alias("text_hash"))
    wanted = sorted(set().union(*(c for q in queries.values() for c in q)))
    found = written(candidates(postings(texts, wanted), queries), "candidates")
    few = found.count() <= BROADCAST_ROWS
    may = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("may").alias("_may"))
    same = keyed["doc_id"].eqNullSafe(may["_id"]) & (keyed["_text_hash"] == may["_hash"])
    joined = keyed.join(F.broadcast(may) if few else may, same, "left").withColumn("_text", F.coalesce("text", F.lit("")))
    order = F.array(*[F.lit(r.name) for r in rules])
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    parts = []
    for r in rules:
        own = spans(F.col("_text"), r)
        parts.append(F.when(F.array_contains("_may", r.name), own).otherwise(empty) if r.name in queries else own)
    every = F.flatten(F.array(*parts))
    ranked = F.transform(every, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return joined.withColumn("_spans", F.array_sort(ranked)).drop("_id", "_hash", "_may", "_text_hash", "_text")


def listed(own: Column) -> Column:
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """doc_id, a count for each base rule, base_sha256 and spans of every row."""
    found = with_spans(docs.select("doc_id", "text"), rules)
    names = [r.name for r in base]
    kinds = F.transform("_spans", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{n}") for n in names]
    of_base = F.filter("_spans", lambda x: x["kind"].isin(*names))
    return found.select("doc_id", *counts, F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every run of overlapping spans in ``text`` replaced; all other columns as they are, whatever their names."""
    others = [c for c in docs.columns if c != "text"]
    found = with_spans(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row")), rules)
    text = F.col("text")

    def redacted(blocks: Column) -> Column:
        def piece(begin: Column, end: Column) -> Column:
            """The text from code point ``begin`` to ``end``, out of the blocks that hold it."""
            first, last = F.floor(begin / BLOCK), F.floor((end - 1) / BLOCK)
            run = F.array_join(F.slice(blocks, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
            inside = F.substring(run, (begin % BLOCK + 1).cast("int"), (end - begin).cast("int"))
            return F.when(end > begin, inside).otherwise(F.lit(""))

        ends = running(F.transform("_spans", lambda x: x["end"]), F.greatest)

        def parts(ends: Column) -> Column:
            def part(x: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
                fresh = (x["start"] > before) | (i == 0)
                return F.when(fresh, F.concat(piece(before, x["start"]), F.lit(REDACTED))).otherwise(F.lit(""))

            tail = piece(F.element_at(ends, -1), F.length(text))
            return F.concat(F.array_join(F.transform("_spans", part), ""), tail)

        return let(ends, parts)

    clean = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), redacted)
    new = F.when(F.size("_spans") > 0, clean).otherwise(text).alias("text")
    return found.select(*[new if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
