"""Licence notices, found through a positional index of the rare words of each file.

All words of the templates are indexed with their places. Of each document, the licence words it holds are looked up
from the highest IDF down, over document counts of the whole corpus. A template is left out when too few of its words,
or not all words of its key phrases, are in the document. Of the others as many places are looked up as make sure that a
notice reaching its share holds two of them: the words held, less those that must agree, and two more. Each posting
says where the template would have to start; the postings are intersected by that start, ``shift`` words more or less.
Where two places meet, the template is compared word by word.

Compared are the words that stand in order, each at most ``shift`` words from its place, so words may be replaced,
inserted or missing, also at the ends of the text. A template counts when its share of such words is reached and each
key phrase stands whole, no further than that from its place. No other bound is set, so every such notice is found.

Base phrases are templates of their own that must agree in every word at its place.

Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased.

Defined cases: a null text is empty; repeated rows are judged alike; equal IDFs go by the word; a template
without words is refused; other columns pass through, save those named like one added here; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import widened

ADDED = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
# Bytes to words: A-Z to lower case, everything that separates to a space.
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


@dataclass(frozen=True)
class Template:
    """``least``: share of the words that must agree; ``keys``: phrases that must stand whole; ``shift``: how many words
    a word may stand from its place."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    least: float = 0.8
    base: bool = False
    shift: int = 3


def phrase(label: str, text: str, base: bool = False) -> Template:
    """A template that must stand whole."""
    return Template(label, text, least=1.0, base=base, shift=0)


# --- fixed values: the base phrases ----------------------------------------------------------------------
BASE = (
    phrase("gpl", "gnu general public license", base=True),
    phrase("apache", "apache license", base=True),
    phrase("cc-by", "cc by", base=True),
    phrase("mit", "mit license", base=True),
)
# --- fixed values: opening words of public licence notices -----------------------------------------------
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files", ("free of charge", "person obtaining a copy")),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the "
             "software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met", ("source and binary forms",)),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
             "promote products derived from this software without specific prior written permission",
             ("endorse or promote products derived from this software",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors "
             "be held liable for any damages arising from the use of this software", ("will the authors be held liable",)),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
             "compliance with the license", ("apache license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
             "general public license", ("free software", "gnu general public license")),
    Template("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license "
             "or at your option any later version", ("gnu general public license", "version 2 of the license")),
    Template("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license "
             "or at your option any later version", ("gnu general public license", "version 3 of the license")),
    Template("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
             "the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license as published by "
             "the free software foundation", ("gnu affero general public license",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not "
             "use this file except in compliance with the license", ("mozilla public license version 1 1",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license",
             ("eclipse public license",)),
    Template("cddl", "the contents of this file are subject to the terms of the common development and distribution license",
             ("common development and distribution license",)),
    Template("cc-by", "this work is licensed under a creative commons attribution", ("creative commons attribution",)),
    Template("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights to",
             ("waived all copyright and related or neighboring rights",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
             "is hereby granted", ("with or without fee",)),
    Template("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose "
             "without fee and without a written agreement is hereby granted", ("without a written agreement",)),
    Template("ofl", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("public domain",)),
    phrase("apache-2.0", "apache license version 2 0"),
    phrase("gpl-2", "gnu general public license version 2"),
    phrase("gpl-3", "gnu general public license version 3"),
    phrase("mpl-2.0", "mozilla public license v 2 0"),
    phrase("cc-by-sa", "cc by sa"),
    phrase("cc-by-nc", "cc by nc"),
    phrase("cc-by-nd", "cc by nd"),
    phrase("cc0", "cc0 1 0 universal"),
    phrase("spdx", "spdx license identifier"),
)
# ---------------------------------------------------------------------------------------------------------
TEMPLATES = (*BASE, *NOTICES)
#: Places that must meet before a template is compared.
MEET = 2


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def in_order(own: list[bytes], found: list[bytes], start: int, shift: int) -> int:
    """The most words of a template that stand in order in ``found``, each within ``shift`` of its place after ``start``."""
    width = 2 * shift + 1
    row = [0] * (width + 1)
    for place, word in enumerate(own):
        at, left = start + place - shift, 0
        for j in range(width):
            same = 0 <= at + j < len(found) and found[at + j] == word
            row[j] = left = max(row[j] + same, row[j + 1], left)
    return row[width - 1]


class Index:
    """Words of the templates with their places; ``frequency`` counts the documents that hold a word."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[bytes, int]):
        self.templates = [(t, words(t.text)) for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.keys: list[list[tuple[int, int]]] = []  # stretches of the template that must stand whole
        self.needed: list[int] = []  # words that must agree
        for n, (t, own) in enumerate(self.templates):
            if not own:
                raise ValueError(f"template {t.label} has no words")
            stretches = []
            for key in map(words, t.keys):
                at = next((i for i in range(len(own)) if own[i:i + len(key)] == key), None)
                if at is None:
                    raise ValueError(f"key phrase not in template {t.label}")
                stretches.append((at, at + len(key)))
            self.keys.append(stretches)
            self.needed.append(next(k for k in range(1, len(own) + 1) if k == len(own) or k / len(own) >= t.least))
            for place, word in enumerate(own):
                self.postings[word].append((n, place))
        #: Fewer documents, higher IDF; ties by the word.
        self.rank = {w: i for i, w in enumerate(sorted(self.postings, key=lambda w: (frequency.get(w, 0), w)))}

    def lookups(self, found: list[bytes]) -> dict[int, list[int]]:
        """Per template that the document may hold: the places looked up, those of its words of highest IDF."""
        held: dict[int, list[int]] = defaultdict(list)
        for word in sorted(self.rank.keys() & set(found), key=self.rank.__getitem__):
            for n, place in self.postings[word]:
                held[n].append(place)
        out = {}
        for n, places in held.items():
            needed = self.needed[n]
            if len(places) >= needed and all(i in places for low, high in self.keys[n] for i in range(low, high)):
                out[n] = places[:len(places) - needed + min(MEET, needed)]
        return out

    def starts(self, found: list[bytes]) -> list[tuple[int, int]]:
        """(template, start) where the postings of enough places meet."""
        lookups = self.lookups(found)
        wanted = {self.templates[n][1][place] for n, places in lookups.items() for place in places}
        at: dict[bytes, list[int]] = defaultdict(list)
        if wanted:
            for i, word in enumerate(found):
                if word in wanted:
                    at[word].append(i)
        out = []
        for n, places in lookups.items():
            template, own = self.templates[n]
            met: dict[int, int] = defaultdict(int)  # places that meet at a start, as bits
            for place in places:
                for i in at[own[place]]:
                    for start in range(i - place - template.shift, i - place + template.shift + 1):
                        met[start] |= 1 << place
            out += [(n, start) for start, bits in met.items() if bits.bit_count() >= min(MEET, self.needed[n])]
        return out

    def matches(self, found: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of agreeing words) of every notice in a document."""
        out = []
        for n, start in self.starts(found):
            template, own = self.templates[n]
            moves = range(start - template.shift, start + template.shift + 1)
            if all(any(a + m >= 0 and own[a:b] == found[a + m:b + m] for m in moves) for a, b in self.keys[n]):
                near = set(found[max(0, start - template.shift):max(0, start + len(own) + template.shift)])
                if sum(w in near for w in own) >= self.needed[n]:
                    agreeing = in_order(own, found, start, template.shift)
                    if agreeing >= self.needed[n]:
                        out.append((n, start, agreeing / len(own)))
        return out

    def judge(self, text: str | None) -> tuple:
        found = words(text)
        base, labels, base_labels, score = [], set(), set(), 0.0
        for n, start, share in self.matches(found):
            template = self.templates[n][0]
            labels.add(template.label)
            score = max(score, share)
            if template.base:
                base.append(start)
                base_labels.add(template.label)
        return (len(found), len(base), min(base, default=None), max(base, default=None),
                ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)


def document_frequency(df: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[bytes, int]:
    """Documents that hold each word of the templates; as many rows as the templates have words come to the driver."""
    wanted = frozenset(w for t in templates for w in words(t.text))

    def task(batches):
        counts: Counter = Counter()
        for batch in batches:
            for content in batch.column(0):
                counts.update(wanted.intersection(words(content.as_py())))
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = df.select(text).mapInArrow(task, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def scan(df: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The rows of ``df`` with the counts, places, labels and score of the notices in their texts."""
    index = Index(templates, document_frequency(df, text, templates))
    made = [x.split()[0] for x in ADDED.split(", ")]
    kept = [c for c in df.columns if c not in made]
    read = kept if text in kept else [*kept, text]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    at = read.index(text)

    def task(batches):
        for batch in batches:
            judged = [index.judge(t.as_py()) for t in batch.column(at)]
            columns = zip(*judged) if judged else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(kept))], *[pa.array(c, t) for c, t in zip(columns, types)]], names=[*kept, *made])

    return df.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(task, widened(df, kept, ADDED))
