"""License scans by diagonal voting, in DataFrame functions only.

Every text's rolling word k-grams are hashed and joined to the k-gram positions of a fixed set of templates (hash, then
the k-gram itself, so a hash collision never counts). A hit at word p of the text and q of the template votes for the
diagonal p - q. Short templates (phrases) count where one diagonal holds all their k-grams; long ones after neighbouring
diagonals (insertions and deletions shift them) are merged into spans. A span is verified by the share of the template's
k-grams it holds, by its length, and by the template's own words: every k-gram of the words that tell the template from
its kin (a notice of another licence shares most of the rest) must stand in it. Where repeated lines chain diagonals into
more than a notice, each diagonal with its neighbours is a part that is verified for itself, and the best one counts.

Only the templates are broadcast: their number is fixed here. Only hits are shuffled, once; texts are read once for the
hits and once for their number of words.

Defined results: a null text counts as empty; texts of fewer than three words hold nothing; first_word and last_word are
null and the label strings empty where no phrase stands; texts of any length are scanned whole; of equal spans each counts for its own label; rows repeated with the same id and
text get equal results; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, materialize

K = 3
NEAR_DIAGONALS = 8
NEAR_WORDS = 40
COVERAGE = 0.6
MOST_SPREAD = 2

# Phrases with their labels, and the opening words of public licence texts.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-sa": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}
# The words that tell each notice from its kin.
DECISIVE = {
    "mit": "without restriction including", "apache-2": "apache license version 2", "bsd": "redistribution and use in source", "gpl": "the gnu general public license",
    "isc": "permission to use copy modify", "mpl-2": "mozilla public license v 2", "cc-by-nc": "attribution noncommercial 4", "cc-by-sa": "attribution sharealike 4",
    "cc-by-nc-sa": "attribution noncommercial sharealike 4", "cc-by": "attribution 4 0", "unlicense": "free and unencumbered software",
}
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates(phrases=PHRASES, notices=NOTICES, k: int = K) -> list[tuple[int, str, bool, int, list[int], str, int]]:
    """(template, label, is a phrase, k-grams in it, positions of the decisive ones, k-gram, its position)."""
    out = []
    for n, (label, text, short) in enumerate([(a, b, True) for a, b in phrases.items()] + [(a, b, False) for a, b in notices.items()]):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"template of fewer than {k} words: {text}")
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        own = (text if short else DECISIVE.get(label, "")).split()
        begin = next((i for i in range(len(words)) if own and words[i : i + len(own)] == own), None)
        must = [] if begin is None else list(range(begin, begin + max(1, len(own) - k + 1)))
        out += [(n, label, short, len(grams), must, gram, i) for i, gram in enumerate(grams)]
    return out


def words_of(text: Column) -> Column:
    """The words of a lower-cased text. Splitting is linear; extracting all matches copies the text for each."""
    return F.array_remove(F.split(ascii_lower(text), NO_WORD), "")


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_key")]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """Verified spans: _id, _text_key, label, phrase, first, last (word positions), coverage."""
    spark = docs.sparkSession
    known = spark.createDataFrame(templates(phrases, notices, k), "template int, label string, phrase boolean, grams int, must array<int>, gram string, at int")
    known = F.broadcast(known.withColumn("h", F.xxhash64("gram")))
    # The words are bound as a lambda's variable: a column used inside one would be split anew for every position.
    rolled = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]))
    grams = F.transform(F.array(words_of(F.col(text_col))), rolled)[0]
    rows = docs.select(*_keys(id_col, text_col), F.posexplode(grams).alias("pos", "_gram")).withColumn("_h", F.xxhash64("_gram"))
    hits = rows.join(known, (F.col("_h") == F.col("h")) & (F.col("_gram") == F.col("gram")))
    one = ["_id", "_text_key", "template", "label", "phrase", "grams", "must"]
    diagonals = (
        hits.groupBy(*one, (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.collect_set("at").alias("held"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    )
    diagonals = materialize(diagonals, "diagonals", few=True)  # few rows, read by both branches: else the texts are scanned twice
    whole = diagonals.filter(F.col("phrase") & (F.size("held") == F.col("grams"))).select(
        "_id", "_text_key", "label", "phrase", F.col("diagonal").cast("long").alias("first"), (F.col("high") + k - 1).cast("long").alias("last"), F.lit(1.0).alias("coverage")
    )
    along = Window.partitionBy("_id", "_text_key", "template").orderBy("diagonal", "low")
    opens = (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR_DIAGONALS) | (F.col("low") - F.lag("high").over(along) > NEAR_WORDS) | (F.lag("low").over(along) - F.col("high") > NEAR_WORDS)
    chain = Window.partitionBy("_id", "_text_key", "template", "span")
    chained = diagonals.filter(~F.col("phrase")).withColumn("span", F.sum(F.when(F.coalesce(opens, F.lit(False)), 1).otherwise(0)).over(along))
    chained = chained.withColumn("spread", F.max("high").over(chain) - F.min("low").over(chain))
    fits = F.col("spread") <= MOST_SPREAD * F.col("grams")
    merged = chained.filter(fits).groupBy(*one, "span").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.min("low").alias("first"), F.max("high").alias("high"))
    # A chain longer than any notice is cut: around each of its diagonals, those near it are a part of bounded length.
    near = chain.orderBy("diagonal").rangeBetween(-NEAR_DIAGONALS, NEAR_DIAGONALS)
    cut = chained.filter(~fits).select(*one, "span", F.array_distinct(F.flatten(F.collect_list("held").over(near))).alias("held"), F.min("low").over(near).alias("first"), F.max("high").over(near).alias("high"))
    verified = merged.unionByName(cut).withColumn("coverage", F.size("held") / F.col("grams")).filter((F.col("coverage") >= COVERAGE) & (F.size(F.array_except("must", "held")) == 0))
    best = chain.orderBy(F.col("coverage").desc(), "first", "high")
    merged = verified.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("_id", "_text_key", "label", "phrase", F.col("first").cast("long"), (F.col("high") + k - 1).cast("long").alias("last"), "coverage")
    return whole.unionByName(merged)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    phrase = F.col("phrase")
    found = spans(docs, id_col, text_col).groupBy("_id", "_text_key").agg(
        F.count(F.when(phrase, 1)).alias("n_base"), F.min(F.when(phrase, F.col("first"))).alias("first_word"), F.max(F.when(phrase, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"),
    ).withColumnsRenamed({"_id": "_fid", "_text_key": "_fkey"})
    n_words = F.size(words_of(F.col(text_col))).cast("long")
    rows = docs.select(*_keys(id_col, text_col), n_words.alias("n_words"))
    rows = rows.join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_text_key") == F.col("_fkey")), "left")
    return rows.select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    rows = ", ".join(f"({n}, '{label}', {str(short).lower()}, {grams}, {must}::INTEGER[], '{gram}', {at})" for n, label, short, grams, must, gram, at in templates())
    return f"""
WITH tpl(template, label, phrase, grams, must, gram, tpos) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(len(w) - {K} + 1)) AS pos FROM d WHERE len(w) >= {K}),
h AS (SELECT doc_id, pos, tpl.* FROM (SELECT doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] AS g FROM u) x JOIN tpl ON x.g = tpl.gram),
g AS (SELECT doc_id, template, label, phrase, grams, must, pos - tpos AS diagonal, list(DISTINCT tpos) AS held, min(pos) AS low, max(pos) AS high FROM h GROUP BY ALL),
o AS (SELECT *, lag(diagonal) OVER a AS pd, lag(low) OVER a AS pl, lag(high) OVER a AS ph FROM g WHERE NOT phrase WINDOW a AS (PARTITION BY doc_id, template ORDER BY diagonal, low)),
s AS (SELECT *, sum(CASE WHEN coalesce(diagonal - pd > {NEAR_DIAGONALS} OR low - ph > {NEAR_WORDS} OR pl - high > {NEAR_WORDS}, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal, low) AS span FROM o),
z AS (SELECT *, max(high) OVER c - min(low) OVER c <= {MOST_SPREAD} * grams AS fits FROM s WINDOW c AS (PARTITION BY doc_id, template, span)),
m AS (SELECT doc_id, label, grams, must, list_distinct(flatten(list(held))) AS held FROM z WHERE fits GROUP BY doc_id, template, label, grams, must, span
  UNION ALL SELECT doc_id, label, grams, must, list_distinct(flatten(list(held) OVER (PARTITION BY doc_id, template, span ORDER BY diagonal RANGE BETWEEN {NEAR_DIAGONALS} PRECEDING AND {NEAR_DIAGONALS} FOLLOWING))) FROM z WHERE NOT fits),
f AS (SELECT doc_id, label, true AS phrase, diagonal AS first, 1.0::DOUBLE AS coverage FROM g WHERE phrase AND len(held) = grams
  UNION ALL SELECT doc_id, label, false, NULL, len(held) / grams FROM m WHERE len(held) / grams >= {COVERAGE} AND len(list_filter(must, lambda q: NOT list_contains(held, q))) = 0),
r AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(first) AS first_word, max(first) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
