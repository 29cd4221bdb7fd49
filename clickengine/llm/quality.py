"""Quality rules as a short-circuit cascade of column expressions.

Each rule is a condition under which a document is rejected. On a bounded sample (the first
``SAMPLE_ROWS`` rows of the table) every rule's run time and rejection rate are measured; the rules
then run in the order of rejections per cost, and the first that rejects ends the work on
a document. The order changes the speed only: a document is kept when no rule rejects it.

Null and empty texts have no words and all counts zero. Texts of any length are read whole;
3-word windows are told apart by 64-bit hashes within one text. Repeated rows are judged
alike, an empty table gives an empty result, and columns other than id and text are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, words_column

SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the measured columns, ``text`` and ``words``."""

    name: str
    rejects: Callable[[], Column]


def _chars(kind: str) -> Column:
    """Number of characters of a class in the text."""
    return F.length(F.regexp_replace("text", f"[^{kind}]+", ""))


RULES = (
    Rule("symbols", lambda: F.col("n_symbols") * 20 > F.col("word_chars")),
    Rule("repeated_lines", lambda: F.col("n_dup_lines") * 100 > F.col("n_lines") * 40),
    Rule("capitals", lambda: _chars("A-Z") * 3 > F.col("word_chars")),
    Rule("exclamations", lambda: _chars("!") * 20 > F.col("word_chars")),
    Rule("word_length", lambda: (F.col("word_chars") < F.col("n_words") * 2)
         | (F.col("word_chars") > F.col("n_words") * 15)),
    Rule("few_letters", lambda: F.length(F.regexp_replace("text", "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", "")) * 2
         < F.col("word_chars")),
)


def measured(docs: DataFrame) -> DataFrame:
    """One row per document with its text, words, and the base counts."""
    rows = id_text(docs).select(
        "doc_id", "text", words_column(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    n = F.size("words")
    rows = rows.select(
        "*",
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
            )
        ).alias("windows"),
    )
    # Windows are sorted, by hash and place, only where some hash occurs again.
    rows = rows.select(
        "*",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("sorted"),
    )
    again = F.filter(
        "sorted",
        lambda x, j: ((j > 0) & (F.get("sorted", j - 1)["h"] == x["h"]))
        | F.coalesce(F.get("sorted", j + 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return rows.select(
        "doc_id", "text", "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        _chars(SYMBOLS).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("bigint").alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
    )


def by_rejection_per_cost(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS,
) -> tuple[Rule, ...]:
    """The rules, most rejections per second of a bounded sample first."""
    # The first rows of as many files as it takes, without an exchange of a sample of all; a local table from then on.
    rows = docs.select("doc_id", "text")
    some = docs.sparkSession.createDataFrame(rows.take(sample_rows), rows.schema)
    # Stored before it is filtered: a filter pushed below would repeat the array work per element.
    stored = measured(some).persist()
    sample = stored.where(~F.col("base_failed"))
    try:
        def seconds(condition: Column) -> tuple[float, int]:
            best, hits = None, 0
            for _ in range(2):
                start = time.perf_counter()
                hits = sample.agg(F.count(F.when(condition, 1))).first()[0]
                took = time.perf_counter() - start
                best = took if best is None else min(best, took)
            return best, hits

        floor, _ = seconds(F.col("n_words") < 0)
        ranked = []
        for place, rule in enumerate(rules):
            took, hits = seconds(rule.rejects())
            ranked.append((-hits / max(took - floor, 1e-4), place, rule))
        return tuple(rule for *_, rule in sorted(ranked, key=lambda x: x[:2]))
    finally:
        stored.unpersist()


def kept_by(rules: tuple[Rule, ...]) -> Column:
    """False from the first rule on that rejects; later rules are then not evaluated."""
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        verdict = verdict.when(F.coalesce(rule.rejects(), F.lit(False)), F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts and the cascade's verdict for every document."""
    ordered = by_rejection_per_cost(docs, rules, sample_rows)
    return measured(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        "base_failed", kept_by(ordered).alias("kept"),
    )


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
spots AS (SELECT doc_id, words, unnest(range(len(words) - 2)) AS i FROM w WHERE len(words) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id,
    words[CAST(i + 1 AS INTEGER)], words[CAST(i + 2 AS INTEGER)], words[CAST(i + 3 AS INTEGER)]) AS n FROM spots),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY 1),
m AS (SELECT w.doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 20 > word_chars OR n_dup_lines * 100 > n_lines * 40
    OR length(regexp_replace(text, '[^A-Z]+', '', 'g')) * 3 > word_chars
    OR length(regexp_replace(text, '[^!]+', '', 'g')) * 20 > word_chars
    OR word_chars < n_words * 2 OR word_chars > n_words * 15
    OR length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) * 2 < word_chars) AS kept
FROM b"""
