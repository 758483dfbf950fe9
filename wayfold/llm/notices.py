"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice with at most k edits, cut into k + 1 pieces, has at least one piece without an edit. So the
pieces are looked up in one pass, and only around their hits does the regex library match the notice
with bounded errors and report the span. Texts are compared as words: lower case, joined by one space.
"""

from __future__ import annotations

import bisect

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import freed, slices

# Phrases whose words stand for a license wherever they follow one another.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Short notices: label, words, and the edits (characters put in, left out or changed) allowed.
NOTICES = [
    ("gpl", "gnu general public license", 2),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("apache", "licensed under the apache license", 3),
    ("apache", "apache license version", 2),
    ("mit", "released under the mit license", 2),
    ("mit", "licensed under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 7),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    ("mpl", "mozilla public license", 2),
    ("epl", "eclipse public license", 2),
    ("cc-by", "licensed under cc by", 1),
    ("cc-by", "creative commons attribution", 2),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5),
]
SCAN = ("doc_id long, n_words long, base array<struct<label: string, word: long>>, "
        "found array<struct<label: string, start: long, end: long, edits: int, notice: int>>")
WINDOWS_KEPT = 50_000

_plain = np.full(256, ord(" "), np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        _plain[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b


class Words:
    """The texts of a slice as one line each: their words in lower case, joined by one space."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
        size = np.diff(at)
        begin = at[:-1] - at[0] + np.arange(n) + 1          # each text behind a line feed, and one at the end
        flat = np.full(len(raw) + n + 1, ord("\n"), np.uint8)
        place = np.arange(len(raw)) + np.repeat(np.arange(n) + 1, size)
        flat[place] = _plain[raw]
        self.points = np.zeros(len(flat) + 1, np.int64)     # code points before each place
        first = np.zeros(len(flat), bool)
        first[place] = (raw & 0xC0) != 0x80
        np.cumsum(first, out=self.points[1:])
        word = (flat != ord(" ")) & (flat != ord("\n"))
        keep = word | (flat == ord("\n"))
        keep[1:] |= (flat[1:] == ord(" ")) & word[:-1]
        self.origin = np.flatnonzero(keep)
        self.text = flat[keep].tobytes()
        kept = word[keep]
        start = kept.copy()
        start[1:] &= ~kept[:-1]
        self.words = np.concatenate([[0], np.cumsum(start)])    # words that start before each place
        self.lines = np.searchsorted(self.origin, begin - 1)    # place of the line feed before each text
        self.begin = begin
        self.ends = np.append(self.lines[1:], len(self.text) - 1)

    def doc(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at) - 1

    def span(self, doc: int, start: int, end: int) -> tuple[int, int]:
        """Code points of the original text, end exclusive."""
        base = self.points[self.begin[doc]]
        return int(self.points[self.origin[start]] - base), int(self.points[self.origin[end - 1] + 1] - base)


def places(words: Words, phrase: str):
    """Where the words of a phrase stand consecutively."""
    text, sought, at = words.text, phrase.encode(), -1
    while (at := text.find(sought, at + 1)) >= 0:
        if text[at - 1] in b" \n" and text[at + len(sought)] in b" \n":
            yield at


class Notices:
    """The pieces of all notices in one automaton, and a pattern with bounded errors for each notice."""

    def __init__(self, notices: list[tuple[str, str, int]]):
        self.notices, self.pieces = notices, ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, edits) in enumerate(notices):
            cuts = [len(text) * j // (edits + 1) for j in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                held.setdefault(text[a:b], []).append((i, a))
        for piece, owners in held.items():
            self.pieces.add_word(piece, (len(piece), owners))
        if held:
            self.pieces.make_automaton()
        self.patterns = [regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}(?![^ ])") for _, text, edits in notices]
        self.known: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}

    def windows(self, words: Words) -> list[tuple[int, int, int]]:
        """(notice, start, end) of the stretches around seeds, overlapping ones joined, inside one line each."""
        text, got = words.text, {}
        if not len(self.pieces):
            return []
        for end, (size, owners) in self.pieces.iter(text.decode("latin-1")):
            for i, offset in owners:
                _, notice, edits = self.notices[i]
                room = 4 * edits + 4                # an edit may bring in a character of four bytes
                at = end + 1 - size - offset
                got.setdefault(i, []).append((at - room, at + len(notice) + room))
        out = []
        for i, spans in got.items():
            spans.sort()
            joined = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            for a, b in joined:
                first, last = words.doc(max(0, a)), words.doc(min(b, len(text) - 1))
                for d in range(first, last + 1):
                    lo, hi = max(a, int(words.lines[d]) + 1), min(b, int(words.ends[d]))
                    if lo < hi:
                        out.append((i, lo, hi))
        return out

    def matches(self, words: Words) -> list[tuple[int, int, int, int, int]]:
        """(doc, notice, start, end, edits) with places in ``words.text``."""
        text, out = words.text, []
        for i, lo, hi in self.windows(words):
            while lo > 0 and text[lo - 1] not in b" \n":    # whole words at both ends
                lo -= 1
            while text[hi] not in b" \n":
                hi += 1
            part = text[lo:hi]
            found = self.known.get((i, part))
            if found is None:
                found = []
                shown = part.decode()
                for m in self.patterns[i].finditer(shown):
                    a = len(shown[:m.start()].encode())
                    found.append((a, a + len(m[0].encode()), sum(m.fuzzy_counts)))
                if len(self.known) >= WINDOWS_KEPT:
                    self.known.clear()
                self.known[i, part] = found
            d = words.doc(lo)
            out += [(d, i, lo + a, lo + b, e) for a, b, e in found if b > a]
        return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES,
         notices: list[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """doc_id, n_words, base, found of every whole text.

    ``base`` holds label and first word of each place of a phrase, ``found`` label, start, end (code points of the text, end
    exclusive), edits and notice of each place of a notice within its bound, at whole words. Places of one notice that
    overlap are reported once. Null texts are empty; null ids and repeated rows stay; other columns are ignored; an empty
    table gives no rows.
    """
    @freed
    def run(batches):
        sought = Notices(notices)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                base, found = [[] for _ in range(len(part))], [[] for _ in range(len(part))]
                for phrase, label in phrases.items():
                    for at in places(words, phrase):
                        d = words.doc(at)
                        base[d].append({"label": label, "word": int(words.words[at] - words.words[words.lines[d]])})
                for d, i, a, b, e in sorted(set(sought.matches(words))):
                    start, end = words.span(d, a, b)
                    found[d].append({"label": notices[i][0], "start": start, "end": end, "edits": e, "notice": i})
                n = words.words[words.ends] - words.words[words.lines]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, BASE), pa.array(found, FOUND)],
                                                 ["doc_id", "n_words", "base", "found"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SCAN)


BASE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
FOUND = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("notice", pa.int32())]))


def summary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: list[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every text; see ``scan``.

    The score is 1 for a phrase, else the share of a notice's characters without an edit, the best of all; 0 without a find.
    """
    s = scan(docs, doc_id, text, notices=notices)
    at = F.col("base.word")
    lengths = F.array(*[F.lit(float(len(t))) for _, t, _ in notices]) if notices else F.array().cast("array<double>")
    shares = F.transform("found", lambda x: 1 - x["edits"] / F.get(lengths, x["notice"]))
    spans = F.transform("found", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"], x["edits"]))
    return s.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("base.label"), F.col("found.label"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0))).alias("score"), F.array_join(spans, ",").alias("spans"))
