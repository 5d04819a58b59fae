"""Operator 11: fuzzy search for short licence notices.

A notice is a phrase of words with a bound on edits (insertions, deletions and
substitutions of characters), one for each ``SHARE`` characters.  Cut into one
piece more than the bound, an occurrence within the bound holds at least one
piece unchanged (pigeonhole).  An automaton finds all pieces of all notices in
one pass over the text's words; each hit names a place where the notice can
begin, give or take the bound, and the regex library's bounded-error matching
verifies that window and counts the edits.

Of occurrences of one notice that overlap, those with fewer edits stay, then
the earlier ones; exact ones always stay.  Different notices may overlap.

Defined results: a null or empty text has no words and no places; equal texts
get equal results; repeated rows stay repeated; a null ``doc_id`` stays null;
very long texts are searched whole, in memory of a small multiple of the text;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import id_and_text, strings, tidy

#: Characters of a notice for each edit that it may have.
SHARE = 10


class Notice(NamedTuple):
    label: str
    words: str
    base: bool = False

    @property
    def edits(self) -> int:
        return len(self.words) // SHARE


#: The phrases and labels that are always reported where their words stand exactly.
BASE = (
    Notice("gpl", "gnu general public license", True),
    Notice("apache", "apache license", True),
    Notice("cc-by", "cc by", True),
    Notice("mit", "mit license", True),
)
#: Phrases of well-known licences that the method adds.
ADDED = (
    Notice("gpl", "under the terms of the gnu general public license"),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("agpl", "gnu affero general public license"),
    Notice("apache", "licensed under the apache license version 2 0"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("bsd", "redistribution and use in source and binary forms"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("mpl", "mozilla public license"),
    Notice("epl", "eclipse public license"),
    Notice("boost", "boost software license"),
    Notice("cc-by", "creative commons attribution"),
    Notice("cc0", "creative commons zero"),
    Notice("cc-by-nc", "cc by nc"),
    Notice("cc-by-sa", "cc by sa"),
    Notice("unlicense", "free and unencumbered software released into the public domain"),
)
NOTICES = (*BASE, *ADDED)


class Place(NamedTuple):
    """Where a notice stands: words from 0, and code points of the text, end exclusive."""

    label: str
    notice: str
    base: bool
    edits: int
    word: int
    start: int
    end: int


PLACES = "array<struct<label:string,notice:string,base:boolean,edits:int,word:long,start:long,end:long>>"
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()), ("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Search:
    """Automaton of the notices' pieces, and a verifying pattern for each notice."""

    def __init__(self, notices: Sequence[Notice]):
        import ahocorasick
        import regex

        self.notices = tuple(notices)
        self.patterns = [regex.compile(f"(?<= )(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.edits}}}(?= )", regex.BESTMATCH | regex.VERSION1) for n in self.notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(self.notices):
            if " ".join(n.words.split()) != n.words or not n.words or words.spaced(n.words).decode() != f" {n.words} ":
                raise ValueError(f"not a phrase of lower-case words: {n.words!r}")
            for piece, at in cut(n.words, n.edits + 1):
                pieces.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), tuple(uses)))
        self.automaton.make_automaton()

    def spans(self, spaced: str) -> list[tuple[int, int, int, int]]:
        """(notice, edits, start, end) in ``spaced``, by start."""
        starts: set[tuple[int, int]] = set()
        for last, (size, uses) in self.automaton.iter(spaced):
            first = last + 1 - size
            starts.update((k, first - at) for k, at in uses)
        found: dict[int, set[tuple[int, int, int]]] = {}
        for k, start in starts:
            n = self.notices[k]
            lo = max(start - n.edits - 1, 0)
            m = self.patterns[k].search(spaced[lo : start + len(n.words) + n.edits + 1])
            if m:
                found.setdefault(k, set()).add((sum(m.fuzzy_counts), lo + m.start(), lo + m.end()))
        out = []
        for k, hits in found.items():
            taken: list[tuple[int, int, int]] = []
            exact = sorted(h for h in hits if not h[0])
            taken += exact
            rest = sorted(hits.difference(exact))
            busy = _Busy([(a, b) for _, a, b in exact])
            taken += [h for h in rest if busy.take(h[1], h[2])]
            out += [(k, *h) for h in taken]
        return sorted(out, key=lambda h: (h[2], h[0], h[3]))

    def places(self, text: str) -> tuple[int, list[Place]]:
        """How many words the text has, and its places."""
        spaced = words.spaced(text)
        total = words.count(spaced)
        shown = spaced.decode("utf-8")
        hits = self.spans(shown)
        if not hits:
            return total, []
        # The words' own positions in the text are looked up for texts with places only.
        numbers, at, done = [], 0, -1
        for _, _, start, end in hits:
            done, at = done + shown.count(" ", at, start), start
            numbers.append((done, done + shown.count(" ", start, end)))
        wanted = {w: None for pair in numbers for w in pair}
        for w, m in enumerate(_WORD.finditer(text)):
            if w in wanted:
                wanted[w] = m.span()
        out = []
        for (k, edits, _, _), (first, last) in zip(hits, numbers):
            n = self.notices[k]
            out.append(Place(n.label, n.words, n.base and not edits, edits, first, wanted[first][0], wanted[last][1]))
        return total, out


class _Busy:
    """Intervals taken so far, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)

    def take(self, start: int, end: int) -> bool:
        import bisect

        k = bisect.bisect_left(self.spans, (start, end))
        if (k < len(self.spans) and self.spans[k][0] < end) or (k and self.spans[k - 1][1] > start):
            return False
        self.spans.insert(k, (start, end))
        return True


def cut(phrase: str, parts: int) -> list[tuple[str, int]]:
    """The phrase in ``parts`` pieces of nearly equal length, with their offsets."""
    bounds = [len(phrase) * k // parts for k in range(parts + 1)]
    return [(phrase[a:b], a) for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=4)
def search_for(notices: tuple[Notice, ...]) -> Search:
    return Search(notices)


def scan(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """``doc_id``, ``n_words``, ``places`` for every row: one pass over the scan, no shuffle."""
    notices = tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = search_for(notices)
        for batch in batches:
            for lo, texts in strings(batch.column(1)):
                found = [search.places(text) for text in texts]
                places = pa.array([[p._asdict() for p in own] for _, own in found], _PLACES)
                yield pa.record_batch([batch.column(0).slice(lo, len(texts)), pa.array([n for n, _ in found], pa.int64()), places], names=["doc_id", "n_words", "places"])

    return id_and_text(docs).mapInArrow(tidy(run), f"doc_id long, n_words long, places {PLACES}")


def report(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """One row per document: counts and words of the base places, labels, and the score.

    The score is that of the document's best place: 1 for an exact notice, and
    less by an equal share for each edit (0.5 for the one edit of a notice that
    may have one); 0 without any place.  ``spans`` (label:start:end:edits) shows
    all places.
    """
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    quality = F.transform("places", lambda p: 1 - p["edits"] / (F.floor(F.length(p["notice"]) / SHARE) + 1))
    return scan(docs, notices).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(quality), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["label"], p["start"].cast("string"), p["end"].cast("string"), p["edits"].cast("string"))), ",").alias("spans"),
    )
