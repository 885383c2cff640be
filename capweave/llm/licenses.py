"""Fuzzy search for short license notices.

Texts are lower-cased (A-Z) and reduced to PLAIN_WORD words joined by one space. A notice of length m that
occurs with at most k edits contains one of its k + 1 pieces unchanged (pigeonhole), so one pass of an
Aho-Corasick automaton over all pieces locates every candidate. In a candidate's own window (the notice and k characters
on either side of where it should stand), the regex library finds a match with at most k insertions, deletions and substitutions, at word
boundaries; if there is one, with as few as give one. Of a notice's matches the best is taken first, then the earliest; what a window still holds beside a match that was
taken is searched again, so matches of a notice don't overlap. A window is searched a few times and never grows, so a text of
any length takes time in proportion to its length and candidates, however densely notices stand.

A notice's label counts if it matches anywhere. Base phrases are counted exactly, beside it: the places
where a phrase's words stand consecutively. The score is the best match's share of unchanged characters
(1 for an exact notice or base phrase, 0 without any).

Nulls: a null or empty text has no words, no labels and the score 0. Any doc_id, null or repeated, is a
row like any other. An empty table gives no rows. A very long text is searched whole by its task. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, table


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    edits: int


#: Exact phrases of the base, each with its label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    Notice("mit", "mit license", 1),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("apache", "apache license", 2),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("gpl", "general public license", 3),
    Notice("gpl", "this program is free software you can redistribute it and or modify it", 6),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    Notice("bsd", "bsd 3 clause license", 2),
    Notice("mpl", "mozilla public license", 3),
    Notice("cc", "creative commons attribution", 3),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 6),
)
_PLAIN = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 parts of the phrase, as (offset, part), as even as they can be."""
    cut = [round(i * len(phrase) / (edits + 1)) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cut, cut[1:])]


class NoticeFinder:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        # By notice and number of edits. With one fewer there is no match, so a match has just as many, and is the best.
        self.matchers = [[regex.compile(rf"\b(?:{regex.escape(n.phrase)}){{e<={e}}}\b") for e in range(n.edits + 1)] for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            for offset, part in pieces(n.phrase, n.edits):
                seeds.setdefault(part, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for part, places in seeds.items():
            self.automaton.add_word(part, (len(part), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in code points of the normalised text."""
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for last, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                n = self.notices[k]
                a = max(last - size + 1 - offset - n.edits, 0)
                b = last - size + 1 - offset + len(n.phrase) + n.edits
                own = windows[k]
                # Pieces of one occurrence lie within its edits of each other; further ones have a window of their own.
                if own and own[-1][0] <= a <= own[-1][0] + 2 * n.edits:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        out = [(k, *m) for k, own in windows.items() for m in self._taken(k, own, text)]
        return sorted(out, key=lambda x: x[1:3])

    def _taken(self, k: int, windows: list[list[int]], text: str) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the notice's matches in these windows, the best first, none over another."""
        notice, matchers, n = self.notices[k], self.matchers[k], len(text)
        least, most = max(1, len(notice.phrase) - notice.edits), len(notice.phrase) + notice.edits
        found: list[tuple[int, int, int, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by start // most, as few as fit

        def look(a: int, b: int) -> None:
            # Matches begin and end with words, so a cut word at either end can go.
            b = min(b, n)
            if a > 0 and text[a - 1] != " ":
                a = text.find(" ", a, b) + 1 or b
            if b < n and text[b] != " ":
                b = max(text.rfind(" ", a, b), a)
            if b - a >= least and matchers[-1].search(text, a, b):
                m = next(m for x in matchers if (m := x.search(text, a, b)))
                heapq.heappush(found, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        for a, b in windows:
            look(a, b)
        out = []
        while found:
            edits, start, end, a, b = heapq.heappop(found)
            near = sorted(x for i in range((a - most) // most, b // most + 1) for x in taken.get(i, ()) if x[0] < b and x[1] > a)
            if any(s < end and t > start for s, t in near):
                for s, t in near:
                    if s > a:
                        look(a, s)
                    a = max(a, t)
            else:
                taken[start // most].append((start, end))
                out.append((start, end, edits))
                look(a, start)
                a = end
            look(a, b)
        return out


def normalised(text: bytes) -> tuple[int, bytes]:
    """Number of words; the words joined by one space."""
    words = text.translate(_PLAIN).split()
    return len(words), b" ".join(words)


def base_places(plain: bytes) -> list[tuple[int, str]]:
    """(index of the first word, label) of every place of a base phrase."""
    hits, padded = [], b" " + plain + b" "
    for phrase, label in BASE:
        wanted, at = b" " + phrase.encode() + b" ", -1
        while (at := padded.find(wanted, at + 1)) >= 0:
            hits.append((at, label))
    out, words, seen = [], 0, 0
    for at, label in sorted(hits):
        words, seen = words + padded.count(b" ", seen, at), at
        out.append((words, label))
    return out


SPAN = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
RESULT = "doc_id long, n_words long, base array<struct<word:int,label:string>>, found array<struct<label:string,start:int,`end`:int,edits:int>>, score double"


def _search(notices: tuple[Notice, ...]):
    def run(batches):
        finder = NoticeFinder(notices)
        for b in batches:
            rows = []
            for text in b.column(1).cast(pa.large_string()).cast(pa.large_binary()):
                n, plain = normalised(text.as_py() or b"")
                base = base_places(plain)
                found = finder.find(plain.decode())
                score = max([1.0 if base else 0.0, *(1 - e / len(finder.notices[k].phrase) for k, _, _, e in found)])
                rows.append((n, [{"word": w, "label": x} for w, x in base], [{"label": finder.notices[k].label, "start": s, "end": t, "edits": e} for k, s, t, e in found], score))
            kinds = (pa.int64(), pa.list_(pa.struct([("word", pa.int32()), ("label", pa.string())])), pa.list_(SPAN), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], ["doc_id", "n_words", "base", "found", "score"])

    return run


def license_scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, base (places of base phrases), found (spans in the normalised text with their edits), score."""
    return by_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _search(notices), RESULT)


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents"))
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(x, lambda s: s["label"]) for x in c]))), ",")
    word = F.transform("base", lambda s: s["word"])
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(word).cast("long").alias("first_word"),
        F.array_max(word).cast("long").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("base", "found").alias("labels"),
        "score",
    )


def license_base_places(spark, sf_dir: str) -> DataFrame:
    """What op9 says of base phrases alone."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENSE_BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(phrase, label) AS (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')),
h AS (SELECT rid, label, i FROM d, p, unnest(range(1, len(w) + 1)) t(i) WHERE w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase),
g AS (SELECT rid, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (rid)
"""
