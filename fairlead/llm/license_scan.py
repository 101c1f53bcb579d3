"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are lines; a line longer than twice the longest template is cut into overlapping blocks so that every run of as
many words as that template lies within one. Notices are often wrapped, so each template is also sought over line ends,
in windows of twice its own words, cut so that every run of as many words as it has lies within one; such a window counts
where it holds more of the template than the line blocks it touches, or enough of it besides them. A block matches a
template when it holds at least ``threshold`` of the template's distinct words. Words are ordered by how many blocks hold them over the whole corpus, rarest first. A
template's prefix is as many of its rarest words as any match must touch; a block meets a template only through a
prefix word (prefix filter), if it holds enough template words (length filter) and if enough words can still follow on
both sides (positional filter). What is left is verified. Nothing else about a block can make it match, so the join is
complete. The templates are a parameter, a small table that travels with the task.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import WORD, byte_texts

_WORDS = re.compile(WORD)

#: Phrases whose words must stand next to each other, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices by which licenses are named or granted, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)
THRESHOLD = 0.8


def words_of(text: bytes) -> list[bytes]:
    return _WORDS.findall(text.lower())


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    line, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        wanted = b" " + b" ".join(words_of(phrase.encode())) + b" "
        at, seen, first = line.find(wanted), 0, 0
        while at >= 0:
            first, seen = first + line.count(b" ", seen, at), at
            found.append((first, label))
            at = line.find(wanted, at + 1)
    return found


@dataclass(frozen=True)
class Templates:
    """Word sets with labels; ``sizes`` are the lengths in words, ``longest`` is that of the longest template."""

    labels: tuple[str, ...]
    sets: tuple[frozenset, ...]
    longest: int
    sizes: tuple[int, ...]

    @classmethod
    def of(cls, templates) -> Templates:
        words = [words_of(text.encode()) for _, text in templates]
        return cls(tuple(label for label, _ in templates), tuple(map(frozenset, words)), max(map(len, words)), tuple(map(len, words)))

    @property
    def vocabulary(self) -> frozenset:
        return frozenset().union(*self.sets)


def text_blocks(text: bytes, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first word in the text, words) of every block."""
    first = 0
    for line in text.lower().split(b"\n"):
        words = _WORDS.findall(line)
        if len(words) <= 2 * longest:
            if words:
                yield first, words
        else:
            for at in range(0, len(words) - longest, longest):
                yield first + at, words[at : at + 2 * longest]
        first += len(words)


def word_frequencies(docs: DataFrame, templates: Templates) -> dict[bytes, int]:
    """Number of blocks in the corpus that hold each template word, summed by Spark; one row per template word."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vocabulary = Counter(), templates.vocabulary
        for batch in batches:
            for text in byte_texts(batch):
                for _, words in text_blocks(text, templates.longest):
                    held.update(vocabulary.intersection(words))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


class Join:
    """The templates indexed by their prefix words in the global order."""

    def __init__(self, templates: Templates, frequency: dict[bytes, int], threshold: float = THRESHOLD):
        self.templates, self.threshold = templates, threshold
        order = sorted(templates.vocabulary, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.least = [max(1, ceil(threshold * len(s) - 1e-9)) for s in templates.sets]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for t, words in enumerate(templates.sets):
            for place, word in enumerate(sorted(words, key=self.rank.get)[: len(words) - self.least[t] + 1]):
                self.prefix.setdefault(word, []).append((t, place))

    def matches(self, block: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block holds enough of."""
        own = sorted(self.rank.keys() & set(block), key=self.rank.get)
        sets, candidates = self.templates.sets, set()
        for at, word in enumerate(own):
            for t, place in self.prefix.get(word, ()):
                if len(own) >= self.least[t] and 1 + min(len(sets[t]) - place, len(own) - at) - 1 >= self.least[t]:
                    candidates.add(t)
        held = set(own)
        shares = ((t, len(held & sets[t]), len(sets[t])) for t in sorted(candidates))
        return [(t, n / size) for t, n, size in shares if n >= self.least[t]]

    def block_matches(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """(first word, words, template, containment) over all blocks of a text, then over its wrapped windows."""
        words = words_of(text)
        if self.prefix.keys().isdisjoint(words):
            return []
        blocks = text_blocks(text, self.templates.longest)
        found = [(first, len(block), t, share) for first, block in blocks for t, share in self.matches(block)]
        return found + self.wrapped(text, words, found)

    def wrapped(self, text: bytes, words: list[bytes], found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """(first word, words, template, containment) of the windows over line ends that tell more than the blocks ``found``."""
        ends = list(accumulate(len(words_of(line)) for line in text.split(b"\n")))
        starts: set[tuple[int, int]] = set()
        for at, word in enumerate(words):  # any match touches a prefix word of its template
            for t, _ in self.prefix.get(word, ()):
                size = self.templates.sizes[t]
                starts.update((t, k * size) for k in (at // size - 1, at // size) if k >= 0)
        told: dict[int, list[tuple[int, int, float]]] = {}
        for first, size, t, share in found:  # in the order of their places
            told.setdefault(t, []).append((first, size, share))
        more = []
        for t, first in sorted(starts):
            wanted, end = self.templates.sets[t], min(len(words), first + 2 * self.templates.sizes[t])
            n = len(wanted.intersection(words[first:end]))
            if n < self.least[t] or ends[bisect_right(ends, first)] >= end:  # too little, or within one line
                continue
            blocks = told.get(t, [])
            # No block is longer than this, so those that reach into the window lie between two places of the list.
            near = blocks[bisect_left(blocks, (first - 2 * self.templates.longest,)) : bisect_left(blocks, (end,))]
            own = [(max(a, first), min(a + size, end), share) for a, size, share in near if first < a + size]
            rest = wanted.intersection(w for i, w in enumerate(words[first:end], first) if not any(a <= i < b for a, b, _ in own))
            if len(rest) >= self.least[t] or n / len(wanted) > max((share for *_, share in own), default=0.0):
                more.append((first, end - first, t, n / len(wanted)))
        return more


_FOUND = "array<struct<first:long,words:long,label:string,template:int,containment:double>>"
_PLACES = "array<struct<first:long,label:string>>"


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, places (of phrases, in order), blocks (that meet a template).

    Words are runs of 0-9, a-z and characters outside ASCII after lower-casing A-Z. Null and empty texts have no words
    and no places. Ties in the global order fall to the smaller word. Rows that repeat an id repeat; a null doc_id is
    passed on. Empty input gives no rows. Other columns are ignored.
    """
    known = Templates.of(templates)
    join = Join(known, word_frequencies(docs, known), threshold)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("first", pa.int64()), ("label", pa.string())])
        block = pa.struct([("first", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("template", pa.int32()), ("containment", pa.float64())])
        for batch in batches:
            counts, places, blocks = [], [], []
            for text in byte_texts(batch):
                words = words_of(text)
                counts.append(len(words))
                places.append([{"first": at, "label": label} for at, label in sorted(phrase_places(words, phrases))])
                blocks.append([{"first": a, "words": n, "label": known.labels[t], "template": t, "containment": c} for a, n, t, c in join.block_matches(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(place)), pa.array(blocks, pa.list_(block))], names=["doc_id", "n_words", "places", "blocks"])

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, places {_PLACES}, blocks {_FOUND}")
