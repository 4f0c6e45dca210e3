"""Line-first quality rules.

Each line is judged on its own: punctuation, navigation and boilerplate rules
mark it as failed, failed lines are removed, and a document is rejected when it
loses too large a share of its words that way (or fails the document-wide base
rules). Everything is a narrow projection: no shuffle, no Python.

Edge cases: a null text has no words and fails the base rules; so does an empty
text. Repeated rows are judged independently and identically. Other columns are
passed through by :func:`clean` and dropped by :func:`judge`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optiloom.llm.native import SPACE, count_of, let, words

SYMBOLS = "#*$%&|<>"
#: Phrases of licence, cookie and script boilerplate.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy",
    "terms of use", "terms of service", "use of cookies",
)


@dataclass(frozen=True)
class Rules:
    """Thresholds. Shares are of the characters of one line; ``max_lost`` is the share of a document's words in failed lines."""

    min_words: int = 10
    max_repeat_pct: int = 20
    window: int = 5
    max_symbol_share: float = 0.1
    max_bang_share: float = 0.05
    max_bar_share: float = 0.03
    max_lost: float = 0.3


def repeated_words(tokens: Column, window: int) -> Column:
    """Words inside ``window``-word windows that occur at least twice in the array, the first occurrence included."""
    starts = F.sequence(F.lit(0), F.size(tokens) - window)
    keys = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(window)]))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(ordered: Column) -> Column:
            same = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]))
            hits = F.sort_array(F.transform(same, lambda x: x["i"]))
            return let(hits, lambda p: F.aggregate(F.transform(p, lambda s, k: F.least(F.coalesce(F.get(p, k + 1) - s, F.lit(window)), F.lit(window))), F.lit(0), lambda a, x: a + x))

        return let(pairs, count)

    count = let(keys, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(tokens) <= window, F.lit(0)).otherwise(count).cast("long")


def line_fails(line: Column, boilerplate: Column, rules: Rules) -> Column:
    """Whether a line breaks a rule. ``boilerplate`` says whether the document has any of the phrases at all."""
    size = F.length(line)
    without = lambda mark: size - F.length(F.replace(line, F.lit(mark), F.lit("")))
    return (
        (without("|") > rules.max_bar_share * size)
        | (without("!") > rules.max_bang_share * size)
        | (count_of(line, SYMBOLS) > rules.max_symbol_share * size)
        | (boilerplate & _phrases(line))
    )


def _phrases(text: Column) -> Column:
    low = F.lower(text)
    return reduce(or_, [low.contains(x) for x in BOILERPLATE])


def _measures(whole: Column, rules: Rules) -> Column:
    """One struct of all measures of a text. Self-contained, so that a filter on it costs no more than a column."""

    def by_lines(lines: Column) -> Column:
        def judged(known: Column) -> Column:
            failed = F.filter(lines, lambda x: line_fails(x, known, rules))
            return F.aggregate(F.transform(failed, lambda x: F.size(words(x))), F.lit(0), lambda a, x: a + x)

        worded = F.filter(lines, lambda x: x.rlike(f"[^{SPACE}]"))
        repeats = let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return F.struct(let(_phrases(whole), judged).alias("lost"), repeats.alias("repeats"))

    by_tokens = lambda t: F.struct(F.size(t).alias("n"), repeated_words(t, rules.window).alias("windowed"))
    return F.struct(let(words(whole), by_tokens).alias("t"), let(F.split(whole, "\n"), by_lines).alias("l"))


def _base_failed(m: Column, rules: Rules) -> Column:
    return (m["t"]["n"] < rules.min_words) | (100 * m["t"]["windowed"] > rules.max_repeat_pct * m["t"]["n"])


def _loses(m: Column, rules: Rules) -> Column:
    return m["l"]["lost"] > rules.max_lost * m["t"]["n"]


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: base statistics, base verdict and the line-first verdict."""
    whole = F.coalesce(F.col("__text"), F.lit(""))
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("__text")).withColumn("m", _measures(whole, rules))
    m = F.col("m")
    base = _base_failed(m, rules)
    return measured.select(
        "doc_id",
        m["t"]["n"].cast("long").alias("n_words"),
        (F.length(whole) - count_of(whole, SPACE)).cast("long").alias("word_chars"),
        count_of(whole, SYMBOLS).cast("long").alias("n_symbols"),
        m["l"]["repeats"].cast("long").alias("n_dup_lines"),
        m["t"]["windowed"].alias("n_repeat_words"),
        base.alias("base_failed"),
        F.when(base, F.lit(False)).otherwise(~_loses(m, rules)).alias("kept"),
    )


def clean(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """Kept documents with their failed lines removed; same columns as ``docs``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = docs.where(let(_measures(whole, rules), lambda m: ~_base_failed(m, rules) & ~_loses(m, rules)))
    left = let(_phrases(whole), lambda known: F.concat_ws("\n", F.filter(F.split(whole, "\n"), lambda x: ~line_fails(x, known, rules))))
    out = kept.withColumn(text, left)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)
