"""Licence notices in texts, by a positional index of the rarest licence words.

1. Spark counts in how many documents each word of the templates occurs. The words are bounded by the
   templates, so the counts are a small table, and they give each word its inverse document frequency (IDF).
2. The index has, for each template, its positions of highest IDF. A file's words of the index are looked up; a
   word at p that a template has at q speaks for the template's start at p - q. A start stays a candidate if
   the words that agree on it weigh so much that the template can still reach its least share.
3. A candidate is verified: the share of the template's IDF weight that stands in place, ``SLACK`` words
   of shift allowed, must reach ``LEAST_SHARE``, and the template's key phrases must stand there word by word.

The index misses no place that the verification would accept (see ``_rare_positions``). Phrases are templates
that must stand whole; all their places are found, overlapping ones too.

Defined results: a null text counts as empty and has no words, no labels and score 0. Repeated rows and null ids
each get their row; extra columns do not matter; an empty table gives an empty table. Texts are looked through whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a place may be shifted by insertions or losses, and the share of a template's weight that must stand.
SLACK = 2
LEAST_SHARE = 0.7
#: Share of a template's weight that its index positions hold at least; more than 1 - LEAST_SHARE.
INDEX_SHARE = 0.6

#: Words are runs of ASCII letters and digits and of all other characters beyond ASCII.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()
    phrase: bool = False  # must stand whole


# Phrases and labels that every result reports.
PHRASES = (
    Template("cc-by", "cc by", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("reserved", "all rights reserved", phrase=True),
)

# Customary wordings of public licence notices, with the phrases that must stand in them.
NOTICES = (
    Template("mit", "released under the MIT License", ("mit license",)),
    Template("mit", "licensed under the MIT License", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted", "obtaining a copy"),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template("apache-2.0", "you may not use this file except in compliance with the License", ("in compliance with the license",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template(
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License",
        ("gnu general public license", "redistribute it"),
    ),
    Template(
        "lgpl",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        ("gnu lesser general public license",),
    ),
    Template(
        "agpl",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        ("gnu affero general public license",),
    ),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("source and binary forms", "conditions are met"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("with or without fee",),
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable", ("express or implied", "held liable")),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-4.0", "Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    Template("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
)
TEMPLATES = (*PHRASES, *NOTICES)

PLACES = "array<struct<label: string, phrase: boolean, first_word: long, last_word: long, share: double>>"


# ---------------------------------------------------------------- document frequencies


def document_frequencies(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those that hold each word of the templates."""
    known = frozenset(w for t in templates for w in words(t.text))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                found.update(known.intersection(words(text.as_py())))
        names = [None, *(w.decode() for w in found)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([rows, *found.values()], pa.int64())], ["word", "n"])

    sums = documents.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = sums.collect()  # a row for each word of the templates at most
    return sum(r["n"] for r in rows if r["word"] is None), {r["word"].encode(): r["n"] for r in rows if r["word"] is not None}


# ---------------------------------------------------------------- index


class Entry:
    """A template with the weights of its positions and those positions that the index has."""

    def __init__(self, template: Template, weight: dict[bytes, float]):
        self.template = template
        self.words = words(template.text)
        self.weights = [weight[w] for w in self.words]
        self.whole = sum(self.weights)
        self.slack = 0 if template.phrase else SLACK
        self.rare = _rare_positions(self.weights, 0.0 if template.phrase else INDEX_SHARE)
        lost = 0.0 if template.phrase else (1 - LEAST_SHARE) * self.whole
        #: what the index positions that agree on a start must weigh together
        self.agreeing = sum(self.weights[q] for q in self.rare) - lost - 1e-9
        self.keys = []
        for key in map(words, template.keys):
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(key)] == key)
            self.keys.append((at, key))


def _rare_positions(weights: list[float], share: float) -> list[int]:
    """The positions of highest weight, just so many that they hold the share, and one at least.

    An accepted place lacks at most 1 - LEAST_SHARE of the weight, which is less than these positions
    hold, so that some of them agree on it.
    """
    order = sorted(range(len(weights)), key=lambda q: (-weights[q], q))
    held, taken = 0.0, []
    for q in order:
        taken.append(q)
        held += weights[q]
        if held >= share * sum(weights):
            break
    return taken


class Index:
    def __init__(self, templates: tuple[Template, ...], documents: int, frequencies: dict[bytes, int]):
        found = {w for t in templates for w in words(t.text)}
        weight = {w: math.log(1 + (documents + 1) / (frequencies.get(w, 0) + 1)) for w in found}
        self.entries = [Entry(t, weight) for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, entry in enumerate(self.entries):
            for q in entry.rare:
                self.postings[entry.words[q]].append((number, q))
        self.known = frozenset(self.postings)

    def places(self, text: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share) of all verified places, in order of template and start."""
        present = self.known.intersection(text)
        reach = Counter()
        for word in present:
            for number, q in self.postings[word]:
                reach[number] += self.entries[number].weights[q]
        wanted = {number for number, weight in reach.items() if weight >= self.entries[number].agreeing}
        if not wanted:
            return []
        starts: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for p, word in enumerate(text):
            if word in present:
                for number, q in self.postings[word]:
                    if number in wanted:
                        slack = self.entries[number].slack
                        for start in range(p - q - slack, p - q + slack + 1):
                            starts[number][start].add(q)
        found = []
        for number, agreed in sorted(starts.items()):
            entry = self.entries[number]
            likely = [s for s, positions in agreed.items() if sum(entry.weights[q] for q in positions) >= entry.agreeing]
            found += [(number, s, share) for s, share in verified(entry, text, sorted(likely))]
        return found


def verified(entry: Entry, text: list[bytes], starts: list[int]) -> list[tuple[int, float]]:
    """Those of the ascending starts at which the template stands, with the share of its weight that does.

    Of starts within the slack of each other, one after the other, the one of the highest share is kept; on
    ties that with the most weight in its very place, then the first.
    """
    checked = [(s, found) for s in starts if (found := _shares(entry, text, s))]
    if entry.template.phrase:
        return [(s, share) for s, (share, _) in checked]
    runs: list[list] = []
    for start, found in checked:
        if not runs or start - runs[-1][-1][0] > 2 * SLACK + 1:
            runs.append([])
        runs[-1].append((start, found))
    best = [max(run, key=lambda r: (r[1], -r[0])) for run in runs]
    return [(s, share) for s, (share, _) in best]


def _shares(entry: Entry, text: list[bytes], start: int) -> tuple[float, float] | None:
    """The shares of the weight that stand near their places and right in them; None if this is no place of the template."""

    def stands(at: int, wanted: list[bytes]) -> bool:
        return at >= 0 and text[at : at + len(wanted)] == wanted

    shifts = range(-entry.slack, entry.slack + 1)
    if entry.template.phrase:
        return (1.0, 1.0) if stands(start, entry.words) else None
    if not all(any(stands(start + at + d, key) for d in shifts) for at, key in entry.keys):
        return None
    held = sum(w for j, w in enumerate(entry.weights) if any(stands(start + j + d, [entry.words[j]]) for d in shifts))
    exact = sum(w for j, w in enumerate(entry.weights) if stands(start + j, [entry.words[j]]))
    return (min(held / entry.whole, 1.0), exact) if held >= LEAST_SHARE * entry.whole - 1e-9 else None


# ---------------------------------------------------------------- Spark


def find_licences(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, places: where licence notices stand in each text, words counted from 0."""
    index = Index(templates, *document_frequencies(documents, templates))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))
        for batch in batches:
            sizes, places = [], []
            for text in batch.column("text"):
                own = words(text.as_py())
                sizes.append(len(own))
                places.append([_place(index.entries[number], start, share, len(own)) for number, start, share in index.places(own)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(places, kind)], ["doc_id", "n_words", "places"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(found, f"doc_id long, n_words long, places {PLACES}")


def _place(entry: Entry, start: int, share: float, size: int) -> dict:
    first, last = max(start, 0), min(start + len(entry.words), size) - 1
    return {"label": entry.template.label, "phrase": entry.template.phrase, "first_word": first, "last_word": last, "share": share}


def label_licences(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document the phrases' places and labels, all labels, and the highest share of a template that stands in it."""
    found = find_licences(documents, templates)
    base = F.filter("places", lambda p: p["phrase"])

    def joined(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["first_word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
