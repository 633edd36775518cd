"""Quality rules as a short-circuit cascade, in Spark expressions only.

Every rule is a reject condition over a text and its word array. Cost and
selectivity of the rules are estimated on a bounded sample from all over the
table; the rules are then tried in order of rejections per cost, and the first
that fires ends the row's evaluation (a CASE expression evaluates its branches
in order). The order changes the speed, never the verdict. A rule's cost is the
work of its expression on the sample, in characters read, not a measured time:
the same documents give the same order.

Defined results: a null or empty text has no words, all counts are 0 and
``few_words`` rejects it. Repeated rows are judged alike, each on its own. Extra
columns are passed through; added names that clash get a trailing underscore.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark.llm.common import free_name, let, ref, spread_sample

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"

#: Rows of the sample that the order of the rules is estimated on.
SAMPLE_ROWS = 256


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and \\x09-\\x0D."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")


def n_dup_lines(text: Column) -> Column:
    return let(worded_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def n_repeat_words(words: Column) -> Column:
    """Words inside any 3-word window that the text holds twice or more.

    Windows are compared by 64-bit hash within one text: they are sorted with
    their positions, and a window repeats if a neighbour equals it. O(n log n)
    for a text of n words, no shuffle.
    """

    def windows(w: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
                lambda first, i: F.struct(F.xxhash64(first, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
            )
        )

    def covered(p: Column) -> Column:
        twice = F.filter(
            p,
            lambda s, j: F.coalesce(F.get(p, j - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["h"] == s["h"], F.lit(False)),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))

    return let(words, lambda w: let(windows(w), covered)).cast("long")


@dataclass(frozen=True)
class Rule:
    """``reject(text, words)`` is true for a text that the rule rejects;
    ``work(text, words)`` is about the number of characters that takes."""

    name: str
    reject: Callable[[Column, Column], Column]
    work: Callable[[Column, Column], Column] = lambda t, w: F.char_length(t)


BASE_RULES = [
    Rule("few_words", lambda t, w: n_words(w) < 50, lambda t, w: F.lit(1)),
    Rule("repeated_words", lambda t, w: n_repeat_words(w) * 100 > n_words(w) * 50, lambda t, w: F.size(w) * 40),
]
#: More than 3 symbols for 10 words, 4 of 10 lines repeated, capitals in half
#: of the characters, words shorter than 2 or longer than 20 on average.
FURTHER_RULES = [
    Rule("symbols", lambda t, w: n_symbols(t) * 10 > n_words(w) * 3),
    Rule("repeated_lines", lambda t, w: n_dup_lines(t) * 10 > F.size(worded_lines(t)) * 4, lambda t, w: F.char_length(t) * 2),
    Rule("capitals", lambda t, w: F.regexp_count(F.coalesce(t, F.lit("")), F.lit("[A-Z]")) * 2 > word_chars(w), lambda t, w: F.char_length(t) + F.size(w) * 2),
    Rule("word_length", lambda t, w: (word_chars(w) < n_words(w) * 2) | (word_chars(w) > n_words(w) * 20), lambda t, w: F.size(w) * 4),
]
RULES = BASE_RULES + FURTHER_RULES


def order_rules(docs: DataFrame, text_col: str, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per cost, greedily: after the first choice, the
    rejections of the next are counted among the rows that the ones before
    let through; ties by name.

    The sample's texts are taken through the driver, bounded in rows and bytes
    (``spread_sample``). One grouped query gives the number of rows and the
    work of every rule for each combination of verdicts.
    """
    if len(rules) < 2:
        return list(rules)
    rows = [(t,) for t in spread_sample(docs, text_col, sample_rows)]
    sample = docs.sparkSession.createDataFrame(rows, "t string").withColumn("w", words_of(F.col("t")))
    t, w = F.col("t"), F.col("w")
    verdicts = [r.reject(t, w).cast("int").alias(f"r{i}") for i, r in enumerate(rules)]
    works = [r.work(t, w).cast("long").alias(f"c{i}") for i, r in enumerate(rules)]
    names = [f"r{i}" for i in range(len(rules))]
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(len(rules))]
    seen = [tuple(x) for x in sample.select(*verdicts, *works).groupBy(*names).agg(F.count("*").alias("n"), *sums).collect()]
    at = len(rules)
    left, order = list(range(at)), []
    while left:
        gain = {i: sum(x[at] for x in seen if x[i]) for i in left}
        cost = {i: 1 + sum(x[at + 1 + i] for x in seen) for i in left}
        best = min(left, key=lambda i: (-gain[i] / cost[i], cost[i], rules[i].name))
        order.append(rules[best])
        left.remove(best)
        seen = [x for x in seen if not x[best]]
    return order


def first_rejection(text: Column, words: Column, rules: list[Rule]) -> Column:
    """Name of the first rule of the list that rejects, else null. Rules
    behind it are not evaluated for that row."""
    chain = None
    for r in rules:
        fires = r.reject(text, words)
        chain = F.when(fires, F.lit(r.name)) if chain is None else chain.when(fires, F.lit(r.name))
    return F.lit(None).cast("string") if chain is None else chain


def judged(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by``: the rule that rejects the row, or null.
    If several would, it is the first in cascade order."""
    rules = order_rules(docs, text_col, RULES if rules is None else rules, sample_rows)
    # The words are bound once inside the expression: a filter on the verdict
    # is moved to the scan and would otherwise split the text for every rule.
    text = ref(docs, text_col)
    verdict = let(words_of(text), lambda words: first_rejection(text, words, rules))
    return docs.withColumn(free_name(docs, "rejected_by"), verdict)


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, columns as they came."""
    verdict = free_name(docs, "rejected_by")
    return judged(docs, text_col, rules).filter(F.col(verdict).isNull()).drop(verdict)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, ``base_failed``, and ``kept``,
    false if the base fails or a further rule of the cascade rejects."""
    further = order_rules(docs, text_col, FURTHER_RULES)
    df = docs.select(ref(docs, id_col).alias("doc_id"), ref(docs, text_col).alias("t"), words_of(ref(docs, text_col)).alias("w"))
    df = df.select(
        "doc_id",
        "t",
        "w",
        n_words(F.col("w")).alias("n_words"),
        word_chars(F.col("w")).alias("word_chars"),
        n_symbols(F.col("t")).alias("n_symbols"),
        n_dup_lines(F.col("t")).alias("n_dup_lines"),
        n_repeat_words(F.col("w")).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    verdict = F.when(base, F.lit("base")).otherwise(first_rejection(F.col("t"), F.col("w"), further))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), verdict.isNull().alias("kept"), verdict.alias("rejected_by")
    ).drop("rejected_by")
