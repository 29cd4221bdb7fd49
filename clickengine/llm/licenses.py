"""License scans with a positional index of rare words.

Every template notice is a sequence of words. The document frequency of all template words is
counted over all documents; of each template the half with the highest IDF (at least
``LEAST_INDEXED`` words) goes into the index with its positions. All indexed words of a document are looked up, so that
the words of one license do not keep out those of another; every place of such a
word votes for a start of each template that holds it (place - position), and votes for one start
are added up by IDF. A template counts when its mandatory key phrase stands in the document and
the votes for its best start reach ``ACCEPT`` of the best that the looked-up words could give;
its score is the share of all its indexed IDF that agrees. The SQL follows the same rule.

Besides, the places of three plain phrases are listed; their labels always stay.

Null and empty texts have no words, no labels and score 0. Texts are read whole. Repeated rows,
also of one doc_id, stay rows of their own. An empty table gives an empty result;
columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, lower_ascii

# Wording of well-known license notices, lower case, and the phrase each must contain.
TEMPLATES = {
    "agpl": ("licensed under the gnu affero general public license", "gnu affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",
            "redistribution and use in source and binary forms"),
    "cc-by": ("this work is licensed under cc by 4 0", "cc by"),
    "cc0": ("dedicated to the public domain under the cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    "gpl": ("licensed under the gnu general public license version", "gnu general public license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose",
            "permission to use copy modify and or distribute this software"),
    "lgpl": ("licensed under the gnu lesser general public license", "gnu lesser general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software",
                 "permission is hereby granted free of charge"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",
                "mozilla public license"),
    "reserved": ("copyright all rights reserved", "all rights reserved"),
    "unlicense": ("this is free and unencumbered software released into the public domain",
                  "free and unencumbered software"),
}
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
LEAST_INDEXED = 3
ACCEPT = 0.6
NOT_A_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def vocabulary(templates: dict[str, tuple[str, str]] = TEMPLATES) -> list[str]:
    return sorted({w for notice, _ in templates.values() for w in notice.split()})


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def with_words(docs: DataFrame) -> DataFrame:
    """One row per document: row (tells repeated ids apart), doc_id, words."""
    words = F.split(F.regexp_replace(lower_ascii(F.col("text")), NOT_A_WORD, " "), " ")
    return id_text(docs).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.array_remove(words, "").alias("words")
    )


def document_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each given word stands, and the number of documents under "".

    The result has a row per given word at most, whatever the number of documents.
    """
    present = F.array_union(F.array_intersect("words", _strings(words)), F.array(F.lit("")))
    counts = with_words(docs).select(F.explode(present).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}


def build_index(
    frequencies: dict[str, int], templates: dict[str, tuple[str, str]] = TEMPLATES,
) -> list[tuple[str, str, int, float]]:
    """(word, label, position, idf) of each template's rarest words."""
    n = frequencies.get("", 0)
    out = []
    for label, (notice, _) in templates.items():
        words = notice.split()
        idf = {w: math.log((n + 1) / (frequencies.get(w, 0) + 1)) + 1 for w in words}
        rarest = sorted(idf, key=lambda w: (-idf[w], w))[:max(LEAST_INDEXED, len(idf) // 2)]
        out += [(w, label, i, idf[w]) for i, w in enumerate(words) if w in rarest]
    return sorted(out, key=lambda x: (-x[3], x[0], x[1], x[2]))


def _stands_at(words: str, parts: list[str]):
    return lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])


def _labelled(label: str):
    return lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))


def base_places(words: str = "words") -> Column:
    """Starts of the base phrases, with their label."""
    found = []
    for phrase, label in BASE_PHRASES.items():
        parts = phrase.split()
        starts = F.filter(
            F.sequence(F.lit(0), F.size(words) - len(parts)),
            _stands_at(words, parts),
        )
        found.append(
            F.when(
                F.array_contains(words, parts[0]) & (F.size(words) >= len(parts)),
                F.transform(starts, _labelled(label)),
            ).otherwise(F.array().cast("array<struct<at:int,label:string>>"))
        )
    return F.concat(*found)


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Base places and license labels of every document."""
    spark: SparkSession = docs.sparkSession
    index = build_index(document_frequencies(docs, vocabulary(templates)), templates)
    by_word = [(w, next(iter(g))[3]) for w, g in groupby(index, key=lambda x: x[0])]
    totals = {label: sum(x[3] for x in index if x[1] == label) for label in templates}
    # A few rows per template, whatever the data.
    postings = F.broadcast(spark.createDataFrame(
        [(w, label, i, idf, totals[label], templates[label][1]) for w, label, i, idf in index],
        "word string, label string, position int, idf double, total double, phrase string",
    ))
    rows = with_words(docs)
    rare = F.array_intersect("words", _strings(w for w, _ in by_word))
    rows = rows.select("row", "doc_id", "words", base_places().alias("base"), rare.alias("rare"))
    # Joined once per document, and only where some indexed word stands.
    rows = rows.select("*", F.when(
        F.size("rare") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("spaced"))
    nothing = F.array().cast("array<struct<word:string,at:int>>")
    hits = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
        lambda x: F.array_contains("rare", x["word"]),
    )
    phrases = sorted({p for _, p in templates.values()})
    rows = rows.select(
        "row", "doc_id", "rare", F.size("words").cast("bigint").alias("n_words"),
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["at"])).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))).alias("base_list"),
        F.array_compact(F.array(*[
            F.when(F.contains("spaced", F.lit(f" {p} ")), F.lit(p)) for p in phrases
        ])).alias("phrases"),
        F.when(F.size("rare") > 0, hits).otherwise(nothing).alias("hits"),
    )
    facts = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_list"]
    # Only places of words of templates whose key phrase is there need to vote.
    votes = rows.withColumn(
        "hits", F.when(F.size("phrases") > 0, F.col("hits")).otherwise(nothing)
    ).select("row", *facts, "rare", "phrases", F.explode_outer("hits").alias("hit"))
    votes = votes.select("row", *facts, "rare", "phrases", F.col("hit.word").alias("word"), F.col("hit.at").alias("at"))
    votes = votes.join(postings, "word", "left").select(
        "row", *facts, "rare", F.when(F.array_contains("phrases", F.col("phrase")), F.col("label")).alias("label"),
        (F.col("at") - F.col("position")).alias("start"), "idf", "total",
    )
    reach = F.broadcast(postings.groupBy("label").agg(F.collect_list(F.struct("word", "idf")).alias("indexed")))
    starts = votes.groupBy("row", "label", "start").agg(
        F.sum("idf").alias("agreed"), F.first("total").alias("total"), F.first("rare").alias("rare"),
        *[F.first(c).alias(c) for c in facts],
    ).join(reach, "label", "left")
    sought = F.aggregate(
        F.filter("indexed", lambda x: F.array_contains("rare", x["word"])), F.lit(0.0), lambda a, x: a + x["idf"]
    )
    accepted = F.col("agreed") >= sought * ACCEPT - 1e-9
    out = starts.groupBy("row").agg(
        *[F.first(c).alias(c) for c in facts],
        F.collect_set(F.when(accepted, F.col("label"))).alias("found"),
        F.max(F.when(accepted, F.col("agreed") / F.col("total"))).alias("best"),
    )
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", "found")), ",").alias("labels"),
        F.round(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0)), 6).alias("score"),
    )


def sql(templates: dict[str, tuple[str, str]] = TEMPLATES) -> str:
    """The same result in SQL, word by word."""

    def values(rows) -> str:
        return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)

    notices = values((label, w, i) for label, (notice, _) in templates.items() for i, w in enumerate(notice.split()))
    phrases = values((label, phrase) for label, (_, phrase) in templates.items())
    stands = " UNION ALL ".join(
        f"SELECT a.rid, a.spot, '{label}' AS label FROM spots a " + " ".join(
            f"JOIN spots s{k} ON s{k}.rid = a.rid AND s{k}.spot = a.spot + {k} AND s{k}.word = '{p}'"
            for k, p in enumerate(phrase.split()) if k
        ) + f" WHERE a.word = '{phrase.split()[0]}'"
        for phrase, label in BASE_PHRASES.items())
    return rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split(regexp_replace(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM documents),
spots AS MATERIALIZED (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS spot FROM w),
tpl(label, word, position) AS (VALUES {notices}), keys(label, phrase) AS (VALUES {phrases}),
freq AS (SELECT word, count(DISTINCT rid) AS df FROM spots WHERE word IN (SELECT word FROM tpl) GROUP BY word),
weighed AS (SELECT tpl.*, ln((SELECT count(*) + 1 FROM w)::DOUBLE / (coalesce(df, 0) + 1)) + 1 AS idf
  FROM tpl LEFT JOIN freq USING (word)),
ranked AS (SELECT label, word, row_number() OVER (PARTITION BY label ORDER BY idf DESC, word) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT label, word, idf FROM weighed)),
listed AS (SELECT weighed.* FROM weighed JOIN ranked USING (label, word) WHERE r <= greatest({LEAST_INDEXED}, n // 2)),
totals AS (SELECT label, sum(idf) AS total FROM listed GROUP BY label),
rare AS (SELECT DISTINCT rid, word FROM spots JOIN listed USING (word)),
held AS (SELECT rid, label FROM w, keys WHERE rid IN (SELECT rid FROM rare)
  AND contains(' ' || array_to_string(words, ' ') || ' ', ' ' || phrase || ' ')),
sought AS (SELECT rid, label, sum(idf) AS sought FROM rare JOIN listed USING (word) GROUP BY ALL),
starts AS (SELECT rid, label, spot - position AS start, sum(idf) AS agreed
  FROM rare JOIN spots USING (rid, word) JOIN listed USING (word) JOIN held USING (rid, label) GROUP BY ALL),
accepted AS (SELECT rid, label, max(agreed / total) AS best FROM starts JOIN sought USING (rid, label) JOIN totals USING (label)
  WHERE agreed >= sought * {ACCEPT} - 1e-9 GROUP BY ALL),
base AS ({stands}),
summed AS (SELECT rid, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM accepted) GROUP BY rid),
bests AS (SELECT rid, max(best) AS best FROM accepted GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(least(coalesce(best, 0.0::DOUBLE), 1.0::DOUBLE), 6) AS score
FROM w LEFT JOIN summed USING (rid) LEFT JOIN every USING (rid) LEFT JOIN bests USING (rid)"""
