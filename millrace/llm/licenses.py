"""Fuzzy search for short licence notices.

A notice with at most k errors, cut into k + 1 pieces, holds at least one piece
unchanged (the pigeonhole principle). An Aho-Corasick automaton finds all pieces of all
notices in one pass over a text; around each hit the regex library's bounded-error
matching decides, and gives the span and the number of errors. Where a word tells a
notice from others, it stands exactly, and the errors are for the words beside it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import per_worker, releasing, slices

#: Lower-cases A-Z; all other ASCII but digits and lower-case letters ends a word.
_FOLD = bytes(k + 32 if 65 <= k <= 90 else k if 48 <= k <= 57 or 97 <= k <= 122 or k > 127 else 32 for k in range(256))

#: Exact phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    errors: int
    #: The last word of the phrase, if other notices differ in nothing else.
    telling: str = ""
    #: Words of the phrase that a match must have as they are.
    exact: tuple[str, ...] = ()

    @property
    def stem(self) -> str:
        return self.phrase.removesuffix(f" {self.telling}") if self.telling else self.phrase


#: Words that may stand side by side in place of one telling word, as in BY-NC-SA.
TELLING = ("nc", "nd", "sa")

#: Words of well-known notices as they stand after folding, and the errors allowed.
NOTICES = (
    Notice("apache-2.0", "licensed under the apache license version 2 0", 4, exact=("apache", "2", "0")),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc-by-nc", "licensed under cc by nc", 2, "nc"),
    Notice("cc-by-sa", "licensed under cc by sa", 2, "sa"),
    Notice("cc0", "dedicated to the public domain", 3),
    Notice("gnu-gpl", "gnu general public license", 2, exact=("gnu",)),
    Notice("isc", "permission to use copy modify and or distribute this software", 5),
    Notice("mit", "released under the mit license", 3, exact=("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("mpl-2.0", "subject to the terms of the mozilla public license", 4, exact=("mozilla",)),
    Notice("rights-notice", "all rights reserved", 1),
    Notice("unlicense", "free and unencumbered software released into the public domain", 5),
)


def fold(text: str | None) -> str:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text in lower case,
    each with a space on either side."""
    words = (text or "").encode().translate(_FOLD).split()
    return f" {b' '.join(words).decode()} " if words else ""


def gaps(folded: str) -> list[int]:
    """The places of the spaces: that of number k stands before word k."""
    return [m.start() for m in re.finditer(" ", folded)]


def base_places(folded: str, spaces: list[int]) -> list[tuple[int, str]]:
    """(word, label) for every place where a base phrase stands."""
    found = []
    for phrase, label in BASE:
        at = folded.find(f" {phrase} ")
        while at >= 0:
            found.append((bisect_left(spaces, at), label))
            at = folded.find(f" {phrase} ", at + 1)
    return found


def pieces(phrase: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 consecutive pieces of nearly equal length, with their offsets."""
    cuts = [len(phrase) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(a: str, b: str) -> int:
    """The fewest insertions, deletions and substitutions that turn a into b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def letters_of(phrase: str) -> dict[str, int]:
    """For each character the bits of the places where the phrase has it."""
    out: dict[str, int] = {}
    for k, c in enumerate(phrase):
        out[c] = out.get(c, 0) | 1 << k
    return out


def near(text: str, letters: dict[str, int], length: int, errors: int) -> bool:
    """Whether some part of a text is within the errors of a phrase: the differences in
    a column of the table of distances are the bits of two numbers, a column a character."""
    every, last = (1 << length) - 1, 1 << (length - 1)
    more, less, distance = every, 0, length
    for c in text:
        equal = letters.get(c, 0)
        across = (((equal & more) + more) ^ more) | equal
        up, down = less | ~(across | more) & every, more & across
        distance += bool(up & last) - bool(down & last)
        if distance <= errors:
            return True
        up, down, held = up << 1 & every, down << 1 & every, equal | less
        more, less = down | ~(held | up) & every, up & held
    return False


def confusable(a: Notice, b: Notice) -> bool:
    """Whether one text could be within the errors of both notices, although their
    labels differ and no exact word tells them apart."""
    own, other = {a.telling, *a.exact} - {""}, {b.telling, *b.exact} - {""}
    told = own - set(b.phrase.split()) or other - set(a.phrase.split())
    return a.label != b.label and not told and distance(a.phrase, b.phrase) <= a.errors + b.errors


class Searcher:
    """All notices within their errors; with ``telling``, errors are for the stem, the
    telling word stands exactly, after at most two others of ``TELLING``, and so do the
    exact words. Notices that one text could be within the errors of raise ValueError."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES, telling: bool = False):
        self.notices = notices
        self.exact = [frozenset(n.exact) if telling else frozenset() for n in notices]
        for k, notice in enumerate(notices if telling else ()):
            for other in notices[:k]:
                if confusable(notice, other):
                    raise ValueError(f"{notice.label} and {other.label} are too alike for their errors")
        self.fuzzy = [n.stem if telling else n.phrase for n in notices]
        others = f"(?: (?:{'|'.join(TELLING)})){{0,{len(TELLING) - 1}}}?"
        exact = [f"{others} {n.telling}(?= )" if telling and n.telling else "" for n in notices]
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(f, literal_spaces=True)}){{e<={n.errors}}}{x}") for n, f, x in zip(notices, self.fuzzy, exact, strict=True)]
        self.letters = [letters_of(f) for f in self.fuzzy]
        #: Characters that a match may need beyond its fuzzy part.
        self.beyond = [len(TELLING) * (max(map(len, TELLING)) + 1) + 1 if x else 0 for x in exact]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for offset, piece in pieces(self.fuzzy[k], notice.errors):
                seeds.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def windows(self, folded: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice the parts of the text that can hold it, merged where they
        overlap."""
        out: dict[int, list[list[int]]] = {}
        for end, (length, uses) in self.automaton.iter(folded):
            for k, offset in uses:
                notice = self.notices[k]
                first = end + 1 - length - offset
                out.setdefault(k, []).append([max(0, first - notice.errors), min(len(folded), first + len(self.fuzzy[k]) + notice.errors + self.beyond[k])])
        merged: dict[int, list[tuple[int, int]]] = {}
        for k, parts in out.items():
            parts.sort()
            spans = [parts[0]]
            for a, b in parts[1:]:
                if a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            merged[k] = [tuple(s) for s in spans]
        return merged

    def spans(self, folded: str, spaces: list[int]) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, words, errors, likeness) of every notice found, in
        order of place; likeness is the share of the notice's characters without error."""
        found = []
        for k, parts in self.windows(folded).items():
            notice = self.notices[k]
            for a, b in parts:
                if not near(folded[a:b], self.letters[k], len(self.fuzzy[k]), notice.errors):
                    continue
                while (match := self.patterns[k].search(folded, a, b)) is not None:
                    text = match.group()
                    if not self.exact[k].issubset(folded[max(0, match.start() - 1) : match.end() + 1].split()):
                        a = match.start() + 1  # a true match may begin inside this one
                        continue
                    a = max(match.end(), match.start() + 1)
                    errors = sum(match.fuzzy_counts)
                    first = match.start() + len(text) - len(text.lstrip())
                    words = len(text.split())
                    found.append((notice.label, bisect_left(spaces, first) - 1, words, errors, 1 - errors / len(notice.phrase)))
        return sorted(found, key=lambda s: (s[1], s[0]))


def searcher(notices: tuple[Notice, ...] = NOTICES) -> Searcher:
    """The one of this Python worker."""
    return per_worker(Searcher, notices, True)


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "array<struct<label:string,first_word:long,words:int,errors:int,likeness:double>>"


def scan(text: str | None, found: Searcher) -> tuple:
    folded = fold(text)
    spaces = gaps(folded)
    base, spans = base_places(folded, spaces), found.spans(folded, spaces)
    starts = [word for word, _ in base]
    base_labels = {label for _, label in base}
    labels = base_labels | {s[0] for s in spans}
    score = 1.0 if base else max((s[4] for s in spans), default=0.0)
    return max(0, len(spaces) - 1), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: the columns of ``SCANNED`` and ``spans``, those of
    ``notices`` found with the word at which each begins, its words, errors and likeness.

    score is 1 where a base phrase stands, else the best likeness of a notice, else 0.
    Null and empty texts have no words, no places and empty labels; repeated rows stay;
    an empty table gives no rows; other columns are left out. Texts are searched whole.
    """
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
    names = [f.split()[0] for f in SCANNED.split(", ")]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int32()), ("errors", pa.int32()), ("likeness", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher(notices)
        for part in (part for batch in batches for part in slices(batch, 1)):
            rows = [scan(text, search) for text in part.column(1).to_pylist()]
            columns = [part.column(0)] + [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds[1:])]
            fields = ("label", "first_word", "words", "errors", "likeness")
            spans = pa.array([[dict(zip(fields, s, strict=True)) for s in r[7]] for r in rows], span)
            yield pa.record_batch([*columns, spans], [*names, "spans"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), f"{SCANNED}, spans {SPANS}")
