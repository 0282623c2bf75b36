"""License scans with a positional rare-token index, in DataFrame functions only.

Templates are word sequences, some with a mandatory key phrase. One pass over the texts writes the index: for each file the places of
the templates' words. Document frequencies of these words come from the index, over all documents. Then each template takes its words
by falling IDF: the places of the rarest, less its offset, propose beginnings, and the places of every further word, less theirs, are
intersected with them; what is left are the template's places. A key phrase is found in the same way, and without it its template
has none. The text itself is not read again, no text is shuffled, and nothing that grows is broadcast.

Words: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters, counted from 0. A null or empty text has no words; very long
texts are indexed whole. A place that several templates share is listed for each, by place, then label. Repeated rows get the same
places each; an empty table gives an empty result. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.llm.common import cut


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str = ""
    base: bool = False


# Base phrases, then phrases of well-known licences with their key phrases.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
MORE = (
    Template("apache-2.0", "apache license version 2 0"),
    Template("apache-text", "licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"),
    Template("boost", "boost software license version 1 0", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms", "provided that the following conditions are met"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it", "gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "the software is provided as is"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit-text", "permission is hereby granted free of charge", "the software is provided as is"),
    Template("mpl", "mozilla public license"),
    Template("mpl-text", "this source code form is subject to the terms of the mozilla public license", "you can obtain one at"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "the software is provided as is"),
    Template("zlib", "this software is provided as is without any express or implied warranty", "altered source versions must be plainly marked as such"),
)
TEMPLATES = BASE + MORE
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


_KELVIN = "\u212a"  # the only other character that lower() turns into a letter of a template


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in f"{t.words} {t.key}".split()})


def positional_index(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and postings: array of (term, place) of the templates' words, terms numbered from 1 as in ``vocabulary``; a written table."""
    known = vocabulary(templates)
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_KELVIN), F.lit("\u0138"))
    rows = docs.select("doc_id", F.split(F.lower(text), _GAP, -1).alias("parts"))
    parts = F.col("parts")
    lead = (F.get(parts, F.lit(0)) == "").cast("int")  # an empty part at an end is no word
    n = F.greatest(F.size(parts) - lead - (F.get(parts, F.size(parts) - 1) == "").cast("int"), F.lit(0))
    places = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i).isin(known))
    number = F.array(*[F.lit(w) for w in known])
    postings = F.transform(places, lambda i: F.struct(F.array_position(number, F.get(parts, i)).cast("int").alias("term"), (i - lead).alias("place")))
    return cut(rows.select("doc_id", n.cast("bigint").alias("n_words"), postings.alias("postings")))


def document_frequencies(index: DataFrame) -> dict[int, int]:
    """In how many documents each term of the index stands; terms in none are left out."""
    held = F.array_distinct(F.transform("postings", lambda p: p["term"]))
    rows = index.select(F.explode(held).alias("term")).groupBy("term").count().collect()
    return {r["term"]: r["count"] for r in rows}


def by_rarity(phrase: str, known: list[str], frequency: dict[int, int]) -> list[tuple[int, int]]:
    """(term, offset) of a phrase's words, the highest IDF first, the first of equals."""
    words = [(known.index(w) + 1, i) for i, w in enumerate(phrase.split())]
    return sorted(words, key=lambda x: (frequency.get(x[0], 0), x[1]))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and license_places: array of (word, label, base) by word."""
    known = vocabulary(templates)
    index = positional_index(docs, templates)
    frequency = document_frequencies(index)

    def begin(term: int, offset: int) -> Column:
        return F.transform(F.filter("postings", lambda p: p["term"] == term), lambda p: p["place"] - offset)

    def beginnings(phrase: str) -> Column:
        """Where a phrase begins: its words' places, less their offsets, intersected from the rarest word on."""
        return functools.reduce(F.array_intersect, (begin(*x) for x in by_rarity(phrase, known, frequency)))

    def told(places: Column, t: Template) -> Column:
        return F.transform(places, lambda w: F.struct(w.cast("bigint").alias("word"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base")))

    found = []
    for t in templates:
        rarest = [by_rarity(p, known, frequency)[0][0] for p in (t.words, t.key) if p]
        if any(term not in frequency for term in rarest):
            continue  # a word of it stands in no document
        looked = F.transform("postings", lambda p: p["term"])
        there = [F.array_contains(looked, term) for term in rarest] + ([F.size(beginnings(t.key)) > 0] if t.key else [])
        places = F.when(functools.reduce(lambda x, y: x & y, there), beginnings(t.words)).otherwise(F.array().cast("array<int>"))
        found.append(told(places, t))
    kind = "array<struct<word:bigint,label:string,base:boolean>>"
    every = F.array_sort(F.flatten(F.array(*found))) if found else F.array()
    return index.select("doc_id", "n_words", every.cast(kind).alias("license_places"))
