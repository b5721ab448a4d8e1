"""Licence scan by a positional index of rare licence words, on DataFrame functions alone.

1. Document frequencies of the licence vocabulary are counted over the whole corpus.
2. Each template is indexed by its `seeds` words of highest inverse document frequency that
   stand in its key phrases, with all their positions there: the postings.
3. A file's seed words are looked up. A word at position p that has a posting (template, q)
   says that the template starts at p - q. A place holds all key phrases, so it has the same start
   in every posting of its template: the starts of the postings are intersected.
4. A start counts only if the template's mandatory key phrases stand at their relative
   positions, word for word. The score is the share of the template's words in place.

Everything after step 1 happens inside the row: no explode, join or shuffle of the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of text whose A-Z are still to be lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """`text` holds the licence words in order; each phrase of `keys` must be in place.
    A `base` template counts all its places."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_spans(self) -> list[tuple[int, list[str]]]:
        spans = []
        for key in self.keys:
            k = key.split()
            at = [i for i in range(len(self.words) - len(k) + 1) if self.words[i : i + len(k)] == k]
            if not at:
                raise ValueError(f"key phrase {key!r} is not in the template {self.label!r}")
            spans.append((at[0], k))
        return spans


def phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,), base=True)


#: Phrases whose places are counted.
BASE = (
    phrase("mit", "under the mit license"),
    phrase("apache-2", "apache license version 2"),
    phrase("cc-by-nc", "cc by nc"),
)
#: Sentences of public licences and notices, in the words of this module.
NOTICES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge", "obtaining a copy of this software"),
    ),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("licensed under cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("boost-1", "distributed under the boost software license version 1 0", ("boost software license version 1",)),
)


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased (null: none)."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> dict[str, int]:
    """Documents that hold each word of the templates' key phrases. One pass over the corpus; the
    result has at most one row per word of the templates, however large the corpus is."""
    vocabulary = sorted({w for t in templates for k in t.keys for w in k.split()})
    found = F.array_intersect(F.transform(raw_words(F.col(text)), F.lower), F.array(*map(F.lit, vocabulary)))
    counted = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


@dataclass(frozen=True)
class Index:
    """Postings (word, position) of each template, rarest word first; `idf` is kept for inspection."""

    templates: tuple[Template, ...]
    postings: tuple[tuple[tuple[str, int], ...], ...]
    idf: dict[str, float]

    @property
    def rarest(self) -> list[str]:
        """The first word of each template: a text without any of them holds no template."""
        return sorted({p[0][0] for p in self.postings})

    @property
    def seeds(self) -> list[str]:
        return sorted({w for p in self.postings for w, _ in p})


def build_index(frequencies: dict[str, int], documents: int, templates: tuple[Template, ...], seeds: int = 3) -> Index:
    """Index the `seeds` rarest words of all key phrases of each template, with their positions.

    Ties are broken by the word, so the index is the same on every run."""
    idf = {
        w: math.log((documents + 1) / (frequencies.get(w, 0) + 1)) for t in templates for k in t.keys for w in k.split()
    }
    postings = []
    for t in templates:
        places = sorted({(w, start + q) for start, key in t.key_spans() for q, w in enumerate(key)})
        chosen = sorted({w for w, _ in places}, key=lambda w: (-idf[w], w))[:seeds]
        postings.append(tuple((w, q) for c in chosen for w, q in places if w == c))
    return Index(templates, tuple(postings), idf)


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def scan(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """Append `n_words` and `hits`: array<struct<template, start, score>> of verified places.

    `template` numbers `index.templates`. Null and empty texts have no words and no hits;
    repeated rows and other columns pass through; clashing names raise at plan time.
    """
    clash = {"n_words", "hits"} & set(docs.columns)
    if clash:
        raise ValueError(f"the table has columns {sorted(clash)} already; drop or rename them")
    body = F.coalesce(F.col(text), F.lit(""))
    edge = WORD.rstrip("+")
    some_seed = body.rlike(f"(?i)(?<!{edge})(?:{'|'.join(index.rarest)})(?!{edge})")
    seeds = _array(index.seeds)
    words = words_of(F.col(text))

    # Blank words before the text: a template may be cut off by the beginning of the file.
    pad = max(len(t.words) for t in index.templates)

    def located(bare: Column) -> Column:
        w = F.concat(F.array_repeat(F.lit(""), pad), bare)
        placed = F.transform(bare, lambda x, i: F.struct((i + pad).alias("i"), x.alias("w")))
        seeded = F.filter(placed, lambda x: F.array_contains(seeds, x["w"]))
        # Bound once, as the words are.
        starts = F.flatten(F.transform(F.array(seeded), lambda s: _starts(index, s)))
        placed_hits = F.transform(starts, lambda v: _verified(index, w, v, pad))
        return F.filter(placed_hits, lambda h: h["score"] > 0)

    kind = "array<struct<template: int, start: int, score: double>>"
    empty = F.array().cast(kind)
    # The words are bound once by a one-element transform, so nothing is extracted twice.
    found = F.flatten(F.transform(F.array(words), located)).cast(kind)
    return docs.withColumn("n_words", F.size(raw_words(F.col(text))).cast("bigint")).withColumn(
        "hits", F.when(some_seed, found).otherwise(empty)
    )


def _starts(index: Index, seeded: Column) -> Column:
    """Starts that all postings of a template agree on, as array<struct<t, start>>."""

    def of_template(number: int, postings: tuple[tuple[str, int], ...]) -> Column:
        agreed: Column | None = None
        for word, q in postings:
            starts = F.transform(F.filter(seeded, lambda x: x["w"] == word), lambda x: x["i"] - q)
            agreed = F.array_distinct(starts) if agreed is None else F.array_intersect(agreed, starts)
        return F.transform(agreed, lambda s: F.struct(F.lit(number).alias("t"), s.alias("start")))

    return F.flatten(F.array(*[of_template(number, p) for number, p in enumerate(index.postings)]))


def _verified(index: Index, words: Column, v: Column, pad: int) -> Column:
    """Score of a start, 0 if a key phrase is not in place."""
    score = F.lit(0.0)
    for number, t in reversed(list(enumerate(index.templates))):
        in_place = F.lit(True)
        for at, key in t.key_spans():
            in_place = in_place & (F.slice(words, v["start"] + (at + 1), len(key)) == _array(key))
        here = F.arrays_zip(F.slice(words, v["start"] + 1, len(t.words)).alias("a"), _array(t.words).alias("b"))
        equal = F.size(F.filter(here, lambda p: p["a"].eqNullSafe(p["b"])))
        score = F.when(v["t"] == number, F.when(in_place, equal / F.lit(len(t.words))).otherwise(0.0)).otherwise(score)
    return F.struct(v["t"].alias("template"), (v["start"] - pad).alias("start"), score.alias("score"))


def summarise(scanned: DataFrame, index: Index, keep: list[str]) -> DataFrame:
    """Per row: `n_base`, first and last start of the base phrases, labels and best score."""
    base_numbers = F.array(*[F.lit(i) for i, t in enumerate(index.templates) if t.base])
    base = F.filter("hits", lambda h: F.array_contains(base_numbers, h["template"]))
    names = _array([t.label for t in index.templates])

    def labels(hits: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.get(names, h["template"])))), ",")

    return scanned.select(
        *keep,
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["start"])).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )
