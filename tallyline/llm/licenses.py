"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a text; a line of more than BLOCK words is read as windows of BLOCK words,
each starting half a window after the one before. A notice may be wrapped over lines, so such windows
over the words of the whole text, line ends ignored, are blocks as well; they are wide enough that
half of one holds the longest template. A template is contained in a block if at least
CONTAINED of its distinct words occur there. Words are put in one global order, rarest in the
corpus first. A template of m words that needs o = ceil(CONTAINED * m) of them in common must share
one of its first m - o + 1 words with the block (prefix filter), the block needs at least o words
(length filter), and a common word at place i of the template and j of the block's known words
leaves at most 1 + min(what follows i, what follows j) in common with it and after it (positional
filter). What is left is counted in full, so exactly the pairs at or over the threshold are found.
The templates are a bounded parameter and go to the tasks whole; the corpus is not shuffled.

A set of words tells nothing of their order, and licenses differ in a word. A contained template gives
its label only if as many of its words as the threshold asks for stand in the block in its order, within
twice its length, and if the name that NAMES has for its label stands there, should the template itself
hold it: the plain General Public License is no Lesser one, and prose with the same words is none.
"""

from __future__ import annotations

from bisect import bisect_left
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

BLOCK = 64
CONTAINED = 0.8
#: Most words of all templates together: the bound of what each task holds.
MOST_WORDS = 20_000
PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))
# Notices in common use and the telling sentences of the licenses' own texts: label and wording.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)
#: Words that tell a label's templates from those of others, where the templates hold them.
NAMES = {
    "mit": ("mit",), "apache": ("apache",), "bsd": ("bsd",), "mpl": ("mozilla public",), "gpl": ("gnu general public",), "lgpl": ("lesser general public",), "agpl": ("affero general public",),
    "cc-by": ("cc by", "commons attribution"), "cc-by-nc": ("by nc", "attribution noncommercial"), "cc-by-sa": ("by sa", "attribution sharealike"),
}
_SPLIT = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPLIT).split()


def blocks(text: bytes) -> list[list[bytes]]:
    out = []
    for line in text.split(b"\n"):
        own = words(line)
        if len(own) <= BLOCK:
            out.append(own)
        else:
            out += [own[k : k + BLOCK] for k in range(0, len(own) - BLOCK // 2, BLOCK // 2)]
    return [b for b in out if b]


def across(every: list[bytes], width: int) -> list[list[bytes]]:
    """Windows of the whole word sequence; any width // 2 words in a row lie in one of them."""
    return [every[k : k + width] for k in range(0, max(len(every) - width // 2, 1), width // 2)]


def spaced(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


class Index:
    """Templates with their words in global order, and where each prefix word occurs."""

    def __init__(self, templates, frequency: dict[bytes, int], contained: float = CONTAINED, names=NAMES):
        plain = [(label, words(t.encode())) for label, t in templates]
        sets = [(label, frozenset(t)) for label, t in plain]
        #: Per template, the place of each of its words among them, and the names of its label that it holds.
        self.places = [{w: i for i, w in enumerate(dict.fromkeys(t))} for _, t in plain if t]
        spoken = [(spaced(t), [spaced([n.encode()]) for n in names.get(label, ())]) for label, t in plain if t]
        self.names = [[n for n in own if n in text] for text, own in spoken]
        self.order = {w: k for k, w in enumerate(sorted({w for _, s in sets for w in s}, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates = [(label, sorted(s, key=self.order.get)) for label, s in sets if s]
        self.sets = [frozenset(t) for _, t in self.templates]
        self.width = max(BLOCK, 2 * max((len(words(t.encode())) for _, t in templates), default=0))
        self.need = [ceil(contained * len(t) - 1e-9) for _, t in self.templates]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.templates):
            for i in range(len(t) - self.need[k] + 1):
                self.prefix.setdefault(t[i], []).append((k, i))

    def matches(self, block: list[bytes]) -> dict[int, float]:
        """Template number -> containment, of all at or over the threshold."""
        known = sorted({w for w in block if w in self.order}, key=self.order.get)
        have, found, seen = set(known), {}, set()
        for j, w in enumerate(known):
            for k, i in self.prefix.get(w, ()):
                if k in seen:
                    continue
                need, size = self.need[k], len(self.templates[k][1])
                if len(block) < need or 1 + min(size - i - 1, len(known) - j - 1) + min(i, j) < need:
                    continue
                seen.add(k)
                common = len(self.sets[k] & have)
                if common >= need:
                    found[k] = common / size
        return found

    def stands(self, block: list[bytes], k: int) -> bool:
        """Whether template k's name is in the block, and enough of its words in its order and close by."""
        if self.names[k] and not any(n in spaced(block) for n in self.names[k]):
            return False
        places, need = self.places[k], self.need[k]
        at = [(i, places[w]) for i, w in enumerate(block) if w in places]
        for first in range(len(at) - need + 1):
            rising: list[int] = []
            for i, place in at[first:]:
                if i >= at[first][0] + 2 * len(places):
                    break
                j = bisect_left(rising, place)
                rising[j : j + 1] = [place]
            if len(rising) >= need:
                return True
        return False

    def named(self, block: list[bytes], found) -> set[str]:
        """The labels of the contained templates that stand in the block, but for those whose words there
        are all another one's too: a notice of CC BY-NC does not also count as one of CC BY."""
        have, found = frozenset(block), [k for k in found if self.stands(block, k)]
        shared = {k: self.sets[k] & have for k in found}
        return {self.templates[k][0] for k in found if not any(shared[k] < shared[o] for o in found)}


def scan(text: bytes, index: Index) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    every = words(text)
    joined = b" " + b" ".join(every) + b" "
    places, base = [], set()
    for phrase, label in PHRASES:
        phrase, seen, word = b" " + phrase + b" ", 0, 0
        while (at := joined.find(phrase, seen)) >= 0:
            word += joined.count(b" ", seen, at + 1)
            places.append(word - 1)
            base.add(label)
            seen = at + 1
    labels, score = set(base), 1.0 if base else 0.0
    if not index.prefix.keys().isdisjoint(every):
        lines = blocks(text)
        for block in lines if len(lines) == 1 and len(every) <= BLOCK else lines + across(every, index.width):
            found = index.matches(block)
            score = max([score, *found.values()])
            labels |= index.named(block, found)
    return len(every), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def frequencies(docs: DataFrame, vocabulary: frozenset) -> dict[bytes, int]:
    """In how many documents each of the (bounded) vocabulary's words occurs, over all documents."""

    def run(batch):
        n: dict[bytes, int] = {}
        for text in texts(batch):
            for w in vocabulary.intersection(words(text)):
                n[w] = n.get(w, 0) + 1
        return {"word": list(n), "n": list(n.values())}

    rows = map_arrow(docs.select("text"), run, "word binary, n long", rows=None).groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def license_scan(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """One row for each document. n_base, first_word, last_word and base_labels tell of the places
    where a phrase of PHRASES stands; labels adds those of the contained templates that stand in a
    block in their order (of templates alike all count); score is 1 with a base place, else the largest
    containment found, in whatever order, else 0. Null and empty texts have no words;
    repeated rows each get theirs; other columns are ignored; an empty table gives no rows."""
    vocabulary = frozenset(w for _, t in templates for w in words(t.encode()))
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"templates of over {MOST_WORDS} words are no bounded parameter")
    index = Index(templates, frequencies(docs, vocabulary), contained)

    def run(batch):
        rows = zip(*(scan(t, index) for t in texts(batch)))
        return dict(zip(["doc_id", *(c.split()[0] for c in COLUMNS.split(", ")[1:])], [batch.column("doc_id"), *map(list, rows)]))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, COLUMNS)
