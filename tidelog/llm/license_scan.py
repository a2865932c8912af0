"""License scan by diagonal voting, with DataFrame functions only.

Words are the maximal runs of ASCII digits and letters and of all characters beyond ASCII, after A-Z is
lower-cased.  The hashes of all rolling word k-grams of every document are joined with the positions at which the
templates hold the same k-grams (a fixed list of a few hundred rows, broadcast).  A match at document position p and
template position t votes for the diagonal p - t.  Votes are added up by document, template and diagonal.
Neighbouring diagonals (a few words inserted or left out) merge into one span, and a span counts as the share of
the template's words that its k-grams cover, so that one replaced word costs one word.  Where spans of several notices
overlap, only those that cover the most words count, then those of the largest share: one license's notice holds most
words of its relatives'.  Every vote is verified by
comparing the words themselves; a position carries its own k words and not the text, so long texts stay linear.

A phrase template asks for its exact words: a diagonal with all of its k-grams is one place.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import LOWER, UPPER, lower_ascii

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
#: A span is reported at this share of its template's words.
LEAST = 0.8
#: Diagonals merge if they differ by so many words at most and the later part starts so many words on at most.
DRIFT, GAP = 2, 4

#: Exact phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that the method finds with small edits.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "creative commons attribution 4 0 international license": "cc-by",
    "creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license version 3": "agpl-3",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
    "no part of this publication may be reproduced": "all-rights-reserved",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons cc0 1 0 universal public domain dedication": "cc0",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license version 1 0": "bsl-1",
    "eclipse public license version 2 0": "epl-2",
    "this software is provided as is without any express or implied warranty": "zlib",
    "neither the name of the copyright holder nor the names of its contributors may be used": "bsd",
}


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    split = F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK)
    return F.filter(split, lambda w: w != "")


def _template_rows(phrases: Mapping[str, str], notices: Mapping[str, str]) -> list[tuple]:
    rows = []  # a notice that ends in its version counts only where the version stands too
    for i, (kind, (text, label)) in enumerate([("phrase", x) for x in phrases.items()] + [("notice", x) for x in notices.items()]):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words at least: {text!r}")
        last = len(words) - 1 if words[-1].isdigit() else -1
        rows += [(i, kind, label, len(words) - K + 1, last, at, words[at : at + K]) for at in range(len(words) - K + 1)]
    return rows


def _templates(spark: SparkSession, phrases: Mapping[str, str], notices: Mapping[str, str]) -> DataFrame:
    """The templates' k-grams: a fixed list, so it may be broadcast."""
    frame = spark.createDataFrame(_template_rows(phrases, notices), "template int, kind string, label string, grams int, last int, t_pos int, gram array<string>")
    return frame.withColumn("hash", F.xxhash64(*[F.col("gram")[j] for j in range(K)]))


def _grams(words: Column) -> Column:
    """All rolling k-grams, as position and words; the outer lambda binds the words once for all of them."""
    one = lambda ws, i: F.struct((i - 1).alias("pos"), *[F.element_at(ws, i + j).alias(f"w{j}") for j in range(K)])
    inner = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (K - 1)), lambda i: one(ws, i))
    return F.element_at(F.transform(F.array(words), lambda ws: F.when(F.size(ws) >= K, inner(ws))), 1)


def votes(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """id, h, template, diagonal and the positions that voted for it."""
    each = docs.select("id", "h", F.explode(_grams(words_of(F.col("text")))).alias("g")).select("id", "h", "g.*")
    own = [F.col(f"w{j}") for j in range(K)]
    hit = each.withColumn("hash", F.xxhash64(*own)).join(F.broadcast(templates), "hash").where(F.array(*own) == F.col("gram"))
    one = hit.select("id", "h", "template", "kind", "label", "grams", "last", (F.col("pos") - F.col("t_pos")).alias("diagonal"), "t_pos")
    return one.groupBy("id", "h", "template", "kind", "label", "grams", "last", "diagonal").agg(
        F.collect_set("t_pos").alias("at"), F.min("t_pos").alias("lo"), F.max("t_pos").alias("hi")
    )


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    notices: Mapping[str, str] = NOTICES,
    least: float = LEAST,
) -> DataFrame:
    """One row per input row: `id_col`, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of all phrases, first_word and last_word are their smallest and largest start (null if
    none).  labels adds the notices whose best span covers `least` of their words, the last one among them where that
    is a version; score is 1 where a phrase stands, else the best span's share.  A null or empty text has no words and
    no labels; very long texts are scanned whole.  Rows that repeat an id are judged
    by their own text; rows that repeat id and text get equal results.  Ties need no order.  Other columns are not
    read.  An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    cast = votes(source, _templates(docs.sparkSession, phrases, notices)).withColumn("start", F.col("diagonal") + F.col("lo"))

    along = Window.partitionBy("id", "h", "template").orderBy("start", "diagonal")
    new = F.lag("diagonal").over(along).isNull() | (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > DRIFT)
    new = new | (F.col("start") - F.max(F.col("diagonal") + F.col("hi")).over(along.rowsBetween(Window.unboundedPreceding, -1)) > GAP)
    spans = cast.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("id", "h", "template", "kind", "label", "grams", "last", "span").agg(
        F.min("start").alias("s_lo"),
        F.max(F.col("diagonal") + F.col("hi") + (K - 1)).alias("s_hi"),
        F.array_distinct(F.flatten(F.collect_list(F.flatten(F.transform("at", lambda t: F.sequence(t, t + (K - 1))))))).alias("covered"),
        F.sort_array(F.collect_list(F.when((F.col("kind") == "phrase") & (F.size("at") == F.col("grams")), F.col("diagonal")))).alias("places"),
    )
    share = F.when((F.col("last") < 0) | F.array_contains("covered", F.col("last")), F.size("covered") / (F.col("grams") + (K - 1))).otherwise(F.lit(0.0))
    spans = spans.withColumn("share", share).withColumn("good", (F.col("kind") == "notice") & (F.col("share") >= least))
    by_place = Window.partitionBy("id", "h", "good").orderBy("s_lo", "template", "span")
    apart = F.col("s_lo") > F.coalesce(F.max("s_hi").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    spans = spans.withColumn("apart", apart.cast("int")).withColumn("pile", F.sum("apart").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    worth = F.struct(F.size("covered"), "share")
    spans = spans.withColumn("good", F.col("good") & (worth == F.max(worth).over(Window.partitionBy("id", "h", "good", "pile"))))
    found = spans.groupBy("id", "h").agg(
        F.sum(F.size("places")).cast("long").alias("n_base"),
        F.min(F.when(F.size("places") > 0, F.col("places")[0])).cast("long").alias("first_word"),
        F.max(F.when(F.size("places") > 0, F.element_at("places", -1))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.size("places") > 0, F.col("label"))).alias("base"),
        F.collect_set(F.when(F.col("good"), F.col("label"))).alias("more"),
        F.max(F.when(F.size("places") > 0, F.lit(1.0)).when(F.col("kind") == "notice", F.col("share")).otherwise(F.lit(0.0))).alias("score"),
    )
    found = found.select(F.col("id").alias("f_id"), F.col("h").alias("f_h"), "n_base", "first_word", "last_word", "base", "more", "score")
    rows = source.select("id", "h", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left")
    none = F.array().cast("array<string>")
    base, more = F.coalesce("base", none), F.coalesce("more", none)
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle(phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES, least: float = LEAST) -> str:
    """The same in SQL, by comparing the words of all k-grams."""
    values = ", ".join(f"({i}, '{kind}', '{label}', {grams}, {last}, {at}, '{' '.join(gram)}')" for i, kind, label, grams, last, at, gram in _template_rows(phrases, notices))
    gram = " || ' ' || ".join(f"ws[i + {j}]" if j else "ws[i]" for j in range(K))
    shifted = ", ".join(f"list_transform(spots, lambda t: t + {j})" for j in range(K))
    along = "PARTITION BY doc_id, template ORDER BY start, diagonal"
    by_place = "PARTITION BY doc_id, good ORDER BY s_lo, template, span"
    return f"""
WITH t(template, kind, label, grams, last, t_pos, gram) AS (VALUES {values}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK}'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, {gram} AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {K - 2})) AS i FROM d)),
c AS (SELECT doc_id, template, kind, label, grams, last, pos - t_pos AS diagonal, list_distinct(list(t_pos)) AS spots, min(t_pos) AS lo, max(t_pos) AS hi
  FROM g JOIN t ON g.gram = t.gram GROUP BY 1, 2, 3, 4, 5, 6, 7),
n AS (SELECT *, diagonal + lo AS start FROM c),
m AS (SELECT *, CASE WHEN lag(diagonal) OVER ({along}) IS NULL OR abs(diagonal - lag(diagonal) OVER ({along})) > {DRIFT}
  OR start - max(diagonal + hi) OVER ({along} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {GAP} THEN 1 ELSE 0 END AS new FROM n),
p AS (SELECT *, sum(new) OVER ({along} ROWS UNBOUNDED PRECEDING) AS span FROM m),
s AS (SELECT doc_id, template, span, kind, label, grams, last, min(start) AS s_lo, max(diagonal + hi + {K - 1}) AS s_hi,
  list_distinct(flatten(list(flatten([{shifted}])))) AS covered, list(diagonal) FILTER (kind = 'phrase' AND len(spots) = grams) AS places
  FROM p GROUP BY doc_id, template, kind, label, grams, last, span),
f AS (SELECT *, CASE WHEN last < 0 OR list_contains(covered, last) THEN len(covered) / (grams + {K - 1}) ELSE 0 END AS share FROM s),
o AS (SELECT *, coalesce(kind = 'notice' AND share >= {least}, false) AS good FROM f),
q AS (SELECT *, CASE WHEN s_lo > coalesce(max(s_hi) OVER ({by_place} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS apart FROM o),
z AS (SELECT *, sum(apart) OVER ({by_place} ROWS UNBOUNDED PRECEDING) AS pile FROM q),
b AS (SELECT *, good AND (len(covered), share) = max((len(covered), share)) OVER (PARTITION BY doc_id, good, pile) AS best FROM z),
r AS (SELECT doc_id, sum(coalesce(len(places), 0)) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (len(places) > 0))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list(label) FILTER (len(places) > 0 OR best))), ',') AS labels,
  max(CASE WHEN len(places) > 0 THEN 1 WHEN kind = 'notice' THEN share ELSE 0 END) AS score FROM b GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
