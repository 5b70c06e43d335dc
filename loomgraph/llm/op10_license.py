"""License scan by a positional rare-token index, all in SQL functions.

Templates (label, words, key phrase) are indexed by the words of their key phrase,
which must stand whole whatever else differs, so no edit that leaves a match can
take a lookup word away: the LOOKUPS of them of highest inverse document frequency,
counted over all documents. A file is looked up by the index words that it has: their
positions are listed once, the positions of a template's lookup words give the starts
that it could have, starts on which all of its lookup words agree stay. There the key
phrase must stand in its place and COVERAGE of the template's words in theirs. A
phrase is a template that must match whole. All of it happens within the row: nothing
is exploded or shuffled but the document frequencies, one row for each index word.

Null or empty text: no words, no labels, score 0, no positions. Texts are whole,
whatever their length. Ties between equally rare words go by the word. Rows are
independent, so repeats agree; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOOKUPS, COVERAGE = 2, 0.8

# The phrases of the contract and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Words of public licences and notices: label, words, mandatory key phrase.
TEMPLATES = (
    ("gpl-3", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", "terms of the gnu general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "affero general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "retain the above copyright notice"),
    ("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "any person obtaining a copy"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
)


def _words(text: Column) -> Column:
    """Words, those of ASCII letters in lower case.

    Lowering all letters changes no place and no ASCII word once the only two others
    whose lower case has an ASCII letter are swapped for some that stay outside it.
    """
    whole = F.coalesce(text, F.lit(""))
    for letter, other in (("\u212a", "\u212b"), ("\u0130", "\u0131")):
        whole = F.replace(whole, F.lit(letter), F.lit(other))
    # an end that is no word character leaves an empty part
    return F.array_remove(F.split(F.lower(whole), GAP, -1), "")


def _literal(words: list[str]) -> Column:
    return F.expr("array(" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) + ")")


def _entries(phrases, templates) -> list[dict]:
    """Index entries: words, label, least share of words that must agree, key phrase's place."""
    out = [{"words": p.split(), "label": label, "least": 1.0, "key": (0, len(p.split())), "base": True} for p, label in phrases]
    for label, text, key in templates:
        words, k = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        out.append({"words": words, "label": label, "least": COVERAGE, "key": (at, len(k)), "base": False})
    return out


def document_frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each of the words stands: at most as many rows as words."""
    have = F.array_intersect(_literal(words), _words(F.col(text_col)))
    rows = docs.select(F.explode(have).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in words} | {r["word"]: r["count"] for r in rows}


def _starts(entry: dict) -> Column:
    """Word positions of the file at which all lookup words put the template's start."""
    lo, size = entry["key"]

    def by(word: str) -> Column:
        here = F.array(*[F.lit(lo + i) for i, w in enumerate(entry["words"][lo : lo + size]) if w == word])
        at = F.filter("at", lambda p: p["word"] == word)
        return F.flatten(F.transform(at, lambda p: F.transform(here, lambda t: p["place"] - t)))

    # a start can come from several places of one word
    found = F.array_distinct(by(entry["lookup"][0]))
    for word in entry["lookup"][1:]:
        found = F.array_intersect(found, by(word))
    return F.filter(found, lambda s: s >= 0)


def _agreeing(entry: dict) -> Column:
    """Structs (start, share) where the key phrase stands and enough words agree."""
    lo, size = entry["key"]
    phrase, words = map(_literal, (entry["words"][lo : lo + size], entry["words"]))
    n = len(entry["words"])

    def share(s):
        same = F.zip_with(F.slice(F.col("w"), s + 1, n), words, lambda x, y: x == y)
        return F.struct(s.cast("long").alias("start"), (F.size(F.filter(same, lambda x: x)) / float(n)).alias("share"))

    right = F.filter(_starts(entry), lambda s: F.slice(F.col("w"), s + lo + 1, size) == phrase)
    return F.filter(F.transform(right, share), lambda x: x["share"] >= entry["least"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, lookups: int = LOOKUPS) -> DataFrame:
    """(id, n_words, places, found): places are the phrases' starts, found all (label, start, share)."""
    entries = _entries(phrases, templates)
    vocabulary = sorted({w for e in entries for w in e["words"][e["key"][0] : sum(e["key"])]})
    n = max(1, docs.count())
    df = document_frequencies(docs, vocabulary, text_col)
    idf = {w: math.log((n + 1) / (df[w] + 1)) for w in vocabulary}
    rare = lambda words: sorted(set(words), key=lambda w: (-idf[w], w))
    for e in entries:
        lo, size = e["key"]
        e["lookup"] = rare(e["words"][lo : lo + size])[:lookups]
    index = rare(w for e in entries for w in e["lookup"])
    rows = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("w"))
    lookup = _literal(index)
    rows = rows.withColumn("n", F.size("w")).withColumn("present", F.array_intersect(lookup, F.col("w")))

    def all_of(e: dict) -> Column:
        have = F.array_contains("present", e["lookup"][0])
        for word in e["lookup"][1:]:
            have = have & F.array_contains("present", word)
        return have

    # the places of index words, listed once, in files that can have an entry
    some = all_of(entries[0])
    for e in entries[1:]:
        some = some | all_of(e)
    places = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("place"))), lambda p: F.array_contains(lookup, p["word"]))
    rows = rows.withColumn("at", F.when(some, places))
    none = F.expr("cast(array() as array<struct<start: bigint, share: double>>)")
    rows = rows.select("id", "n", *[F.when(all_of(e), _agreeing(e)).otherwise(none).alias(f"e{i}") for i, e in enumerate(entries)])

    def tag(i: int, e: dict) -> Column:
        return F.transform(f"e{i}", lambda x: F.struct(F.lit(e["label"]).alias("label"), F.lit(e["base"]).alias("base"), x["start"].alias("start"), x["share"].alias("share")))

    tagged = [tag(i, e) for i, e in enumerate(entries)]
    return rows.select("id", F.col("n").cast("long").alias("n_words"), F.concat(*tagged).alias("found"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: licence phrases and templates in every document."""
    out = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"))


def brute_force(text: str | None, phrases=PHRASES, templates=TEMPLATES) -> dict:
    """The same result by comparing every position with every template, for tests."""
    w = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = []
    for e in _entries(phrases, templates):
        lo, size = e["key"]
        key = e["words"][lo : lo + size]
        for s in range(len(w)):
            if w[s + lo : s + lo + size] == key:
                share = sum(w[s + i : s + i + 1] == [x] for i, x in enumerate(e["words"])) / len(e["words"])
                if share >= e["least"]:
                    found.append((e["label"], e["base"], s, share))
    base = [f for f in found if f[1]]
    return {"n_words": len(w), "n_base": len(base), "first_word": min((f[2] for f in base), default=None), "last_word": max((f[2] for f in base), default=None),
            "base_labels": ",".join(sorted({f[0] for f in base})), "found": sorted(found)}


def _oracle() -> str:
    """DuckDB: every place of every document against every entry."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = []
    for e in _entries(PHRASES, TEMPLATES):
        lo, size = e["key"]
        rows.append(f"('{e['label']}', {str(e['base']).lower()}, {listed(e['words'])}, {lo}, {listed(e['words'][lo : lo + size])}, {e['least']}::DOUBLE)")
    return r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e(label, base, words, lo, phrase, least) AS (VALUES ENTRIES),
p AS (SELECT doc_id, w, unnest(range(len(w)))::BIGINT AS place, unnest(w) AS word FROM d),
k AS (SELECT doc_id, w, place - lo AS start, e.* FROM p JOIN e ON p.word = e.phrase[1] WHERE place >= lo AND w[place + 1 : place + len(phrase)] = phrase),
s AS (SELECT *, len(list_filter(range(1, len(words) + 1), lambda i: start + i <= len(w) AND w[start + i] = words[i]))::DOUBLE / len(words) AS share FROM k),
f AS (SELECT * FROM s WHERE share >= least),
r AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM f GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)
""".replace("ENTRIES", ",\n  ".join(rows))


ORACLE = _oracle()
