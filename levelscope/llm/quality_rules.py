"""Quality rules: a table of thresholds compiled into one Spark projection.

Statistics of a text (lengths, symbols, stop words, lines, repetitions) are Spark
expressions; each rule bounds one of them, and a row keeps the names of the rules that it
fails. Nothing but built-in functions runs, over whole texts, without a shuffle.

Nulls and ties: a null text has no words and no lines; ratios with nothing below the line
are 0. Rows are judged each on their own, so repeated rows get equal verdicts; further
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

WINDOW = 8
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in that is was for with this be on by from at as it a an "
    "de la le les et des en un une du que qui est dans pour par sur au avec pas "
    "el los las y se del su una con no por para lo como más al "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine"
).split()
STOP_FORMS = sorted({form for word in STOP_WORDS for form in (word, word.capitalize())})


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low`` <= statistic <= ``high``."""

    name: str
    statistic: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


#: Production thresholds. Ratios hold for texts of ``least_words`` words or more.
RULES = (
    Rule("few words", "n_words", low=20),
    Rule("repeated windows", "repeat_word_ratio", high=0.30),
    Rule("word length", "mean_word_length", low=2.0, high=14.0, least_words=20),
    Rule("symbols", "symbol_ratio", high=0.10, least_words=20),
    Rule("no stop words", "stop_word_ratio", low=0.02, least_words=50),
    Rule("repeated lines", "dup_line_ratio", high=0.50, least_words=20),
    Rule("upper case", "upper_ratio", high=0.60, least_words=20),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))


def repeat_words(own: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that are found twice or more, by 64-bit window hashes.

    Window hashes are sorted with their places; a window is repeated if a neighbour in that
    order has its hash. Sorted places then cover the gap to the next one, at most a window.
    """
    n = F.size(own) - window + 1
    hashes, width = F.transform(own, lambda w: F.xxhash64(w)), 1
    while width < window:  # hashes of twice as many words, until they span a window
        step = min(width, window - width)
        hashes = let(hashes, _paired(step))
        width += step
    hashes = F.slice(hashes, 1, n)

    def covered(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(p: Column) -> Column:
            marked = F.transform(p, lambda x, k: F.when((x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]), x["i"]))
            places = F.array_sort(F.array_compact(marked))
            return let(places, lambda q: F.aggregate(F.transform(q, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(q, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(pairs, again))

    return F.when(n < 2, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def _paired(step: int):
    """Each hash with the one ``step`` places on, as one hash; a lambda's second argument would be an index."""
    return lambda h: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))


def statistics(text: Column) -> dict[str, Column]:
    """Counts by name, of a text that isn't null; ``words`` must be a column already."""
    own = F.col("words")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return {
        "n_words": F.size(own).cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": let(lines, lambda x: F.size(x)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(own),
        "n_stop_words": F.size(F.filter(own, lambda w: w.isin(*STOP_FORMS))).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"),
    }


def ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


RATIOS = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
}


def failed(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that a row of statistics fails."""
    tests = []
    for r in rules:
        value = ratio(*RATIOS[r.statistic]) if r.statistic in RATIOS else F.col(r.statistic)
        low = value < r.low if r.low is not None else F.lit(False)
        high = value > r.high if r.high is not None else F.lit(False)
        tests.append(F.when((low | high) & (F.col("n_words") >= r.least_words), F.lit(r.name)))
    return F.array_compact(F.array(*tests))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the statistics, failed_rules, base_failed and kept."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stats = text.withColumn("words", words(F.col("text"))).select("doc_id", *[c.alias(name) for name, c in statistics(F.col("text")).items()])
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    named = stats.withColumn("failed_rules", failed(rules)).withColumn("base_failed", base)
    return named.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
