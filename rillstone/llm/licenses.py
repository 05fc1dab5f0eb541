"""License scans by a positional rare-token index (DataFrame functions only).

Each template is a sentence of a licence with a label and a mandatory key phrase. The words of all templates are the licence
words; inverse document frequencies over the scanned texts say how rare each is. The index posts each template under the rarest word of its key
phrase, with the place of that word. A text's licence words that have a posting are looked up: word and place give the template's start
in the text, and there the template's other words are compared at their relative positions, each by one array access. A template
holds if its key phrase stands there word by word and enough of all words agree. The places of the base phrases come from the same index.

Work in a text is one pass over its words and one template's length for each posting that its rare words meet, however long the text is.

Defined results: a null or empty text has no words, labels or score above 0; very long texts are scanned whole; doc_id
and extra columns are passed, never read; rows that repeat are scanned each; ties between
equally rare words go to the earlier one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A word: digits, ASCII letters, and everything from U+0080 on.
CHARS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Phrases whose places are counted, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str  # the licence's words in order
    key: str  # must stand there, word by word
    least: float = 0.8  # share of the template's words at their relative positions


#: Well-known licence sentences.
TEMPLATES = (
    Template("gpl", "licensed under the gnu general public license version", "general public license"),
    Template("gpl", "gnu general public license as published by the free software foundation either version", "general public license"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    Template("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "without restriction including without limitation the rights"),
    Template("mit", "released under the mit license", "mit license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    Template("mpl", "mozilla public license version 2 0", "mozilla public license"),
    Template("epl", "eclipse public license version 2 0", "eclipse public license"),
    Template("eupl", "european union public licence", "european union public licence", 1.0),
    Template("boost", "boost software license version 1 0", "boost software license"),
    Template("artistic", "the artistic license 2 0", "artistic license"),
    Template("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", "permission is granted to anyone"),
    Template("wtfpl", "do what the fuck you want to public license", "you want to public license"),
    Template("cc-by", "licensed under cc by", "cc by"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    Template("proprietary", "all rights reserved", "all rights reserved", 1.0),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Literals of which every mandatory key and base phrase holds at least one, in lower case; a text without any can't match.
ANCHORS = ("licen", "permission", "redistribution", "reserved", "domain", "copyright", "restriction", "commons")
#: The one key that they leave out.
SHORT_KEY = rf"cc{GAP}+by"


@dataclass(frozen=True)
class Entry:
    """A template or base phrase in the index: ids of its words, where its key stands, and the least share."""

    label: str
    words: tuple[int, ...]
    key_at: int
    key_size: int
    least: float
    base: bool


def licence_words() -> list[str]:
    return sorted({w for text in (*(t.text for t in TEMPLATES), *(p for p, _ in BASE)) for w in text.split()})


def entries() -> list[Entry]:
    ids = {w: k + 1 for k, w in enumerate(licence_words())}
    out = [Entry(label, tuple(ids[w] for w in phrase.split()), 0, len(phrase.split()), 1.0, True) for phrase, label in BASE]
    for t in TEMPLATES:
        ws, key = t.text.split(), t.key.split()
        at = next(k for k in range(len(ws)) if ws[k : k + len(key)] == key)
        out.append(Entry(t.label, tuple(ids[w] for w in ws), at, len(key), t.least, False))
    return out


def words_of(text: Column) -> Column:
    """The words in order. A text is split at its gaps: taking words by matching them costs three times as much."""
    return F.array_remove(F.split(text, f"{GAP}+"), "")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    matches: an array of (label, start, score), the method's finds.
    """
    keys = [*(t.key for t in TEMPLATES), *(p for p, _ in BASE)]
    bad = [k for k in keys if not any(a in k for a in ANCHORS) and "cc by" not in k]
    if bad:
        raise ValueError(f"keys without an anchor: {bad}")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low = F.lower("text")
    maybe = low.rlike(SHORT_KEY)
    for anchor in ANCHORS:
        maybe = F.contains(low, F.lit(anchor)) | maybe
    rows = rows.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.when(maybe, words_of(lower_ascii(F.col("text")))).alias("ws"))
    # a text as the ids of its words, 0 for those of no template
    known = licence_words()
    ids = F.create_map(*[x for k, w in enumerate(known) for x in (F.lit(w), F.lit(k + 1))])
    rows = rows.select("doc_id", "n_words", F.transform("ws", lambda w: F.when(w.isin(known), F.try_element_at(ids, w)).otherwise(0)).alias("ids"))
    rows = written(rows.select("doc_id", "n_words", F.when(F.exists("ids", lambda w: w > 0), F.col("ids")).alias("ids")), "license-words")
    seen = rows.select(F.explode(F.array_distinct("ids")).alias("word")).filter("word > 0").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return _match(rows, {r["word"]: r["n"] for r in seen.collect()})  # at most one row a licence word


def _array(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"


def _match(rows: DataFrame, n_docs: dict[int, int]) -> DataFrame:
    index = entries()
    postings: dict[int, list[str]] = {}
    for k, e in enumerate(index):
        rare = min(range(e.key_at, e.key_at + e.key_size), key=lambda j: (n_docs.get(e.words[j], 0), j))
        postings.setdefault(e.words[rare], []).append(f"named_struct('entry', {k}, 'at', {rare})")
    posted = F.expr(f"map({', '.join(f'{w}, {_array(p)}' for w, p in postings.items())})")
    facts = F.expr(_array(f"named_struct('words', {_array(map(str, e.words))}, 'key_at', {e.key_at}, 'key_end', {e.key_at + e.key_size}, 'least', {e.least!r}D, 'base', {str(e.base).lower()}, 'label', '{e.label}')" for e in index))

    # places of words with postings, then starts of the templates posted there
    here = F.filter(F.transform("ids", lambda w, i: F.when(w.isin(list(postings)), F.struct(w.alias("w"), i.cast("long").alias("i")))), lambda x: x.isNotNull())
    starts = F.flatten(F.transform(here, lambda x: F.transform(F.try_element_at(posted, x["w"]), lambda p: F.struct(p["entry"].alias("entry"), (x["i"] - p["at"]).alias("start")))))
    rows = rows.select("doc_id", "n_words", "ids", starts.alias("starts"))

    def agreeing(x: Column) -> Column:
        fact = F.get(facts, x["entry"])
        agrees = F.transform(fact["words"], lambda w, k: F.coalesce(F.get(F.col("ids"), (x["start"] + k).cast("int")) == w, F.lit(False)))
        return F.struct(fact.alias("fact"), x["start"].alias("start"), agrees.alias("agrees"))

    def graded(x: Column) -> Column:
        fact, agrees = x["fact"], x["agrees"]
        key = F.forall(F.slice(agrees, fact["key_at"] + 1, fact["key_end"] - fact["key_at"]), lambda hit: hit)
        share = F.size(F.array_remove(agrees, False)) / F.size(agrees).cast("double")
        return F.struct(fact["label"].alias("label"), x["start"].alias("start"), share.alias("score"), fact["base"].alias("base"), (key & (share >= fact["least"])).alias("holds"))

    finds = F.filter(F.transform(F.transform("starts", agreeing), graded), lambda x: x["holds"])
    kind = "array<struct<label:string,start:bigint,score:double,base:boolean,holds:boolean>>"
    rows = rows.select("doc_id", "n_words", F.when(F.size("starts") > 0, finds).otherwise(F.array().cast(kind)).alias("finds"))
    base = F.filter("finds", lambda x: x["base"])
    matches = F.transform(F.filter("finds", lambda x: ~x["base"]), lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["score"].alias("score")))
    rows = rows.select("doc_id", "n_words", "finds", F.transform(base, lambda x: x["start"]).alias("every"), F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"]))).alias("base_names"), matches.alias("matches"))
    labels = F.array_sort(F.array_distinct(F.transform("finds", lambda x: x["label"])))
    best = F.array_max(F.transform("finds", lambda x: x["score"]))
    return rows.select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").alias("first_word"), F.array_max("every").alias("last_word"),
        F.concat_ws(",", "base_names").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"), "matches",
    )


def report(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("matches")


def sql() -> str:
    """The same result in DuckDB, word by word, without the index."""
    stands = lambda ws, at: " AND ".join(f"ws[i + {k + at + 1}] = '{w}'" for k, w in enumerate(ws))
    base = ",\n  ".join(f"list_filter(range(n_words), lambda i: {stands(p.split(), 0)}) AS b{k}" for k, (p, _) in enumerate(BASE))
    every = " || ".join(f"b{k}" for k in range(len(BASE)))
    names = " || ".join(f"(CASE WHEN len(b{k}) > 0 THEN ['{label}'] ELSE [] END)" for k, (_, label) in enumerate(BASE))
    scores, labels = [], []
    for k, t in enumerate(TEMPLATES):
        ws, key = t.text.split(), t.key.split()
        at = next(j for j in range(len(ws)) if ws[j : j + len(key)] == key)
        rest = [j for j in range(len(ws)) if not at <= j < at + len(key)]
        score = f"({len(key)} " + "".join(f"+ CASE WHEN i + {j} >= 0 AND ws[i + {j + 1}] = '{ws[j]}' THEN 1 ELSE 0 END " for j in rest) + f")::DOUBLE / {len(ws)}::DOUBLE"
        starts = f"list_filter(range(-{at}, n_words), lambda i: i + {at} >= 0 AND {stands(key, at)})"
        scores.append(f"list_filter(list_transform({starts}, lambda i: {score}), lambda s: s >= {t.least if rest else 0}::DOUBLE) AS t{k}")
        labels.append(f"(CASE WHEN len(t{k}) > 0 THEN ['{t.label}'] ELSE [] END)")
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
c AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n_words FROM w),
f AS (SELECT doc_id, n_words,
  {base},
  {(","+chr(10)+"  ").join(scores)}
  FROM c),
g AS (SELECT *, {every} AS every_, {names} AS base_,
  {" || ".join(f"t{k}" for k in range(len(TEMPLATES)))} AS scores_,
  {" || ".join(labels)} AS found_
  FROM f)
SELECT doc_id, n_words, CAST(len(every_) AS BIGINT) AS n_base, list_min(every_) AS first_word, list_max(every_) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(base_)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(base_ || found_)), ','), '') AS labels,
  greatest(coalesce(list_max(scores_), 0::DOUBLE), CASE WHEN len(every_) > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS score
FROM g
"""
