"""Tokens of whole texts from a public tokenizer file, without encoding any word twice if that can be helped.

A text is cut at the six ASCII white-space characters. The tokenizer drops white space and
never joins across it, so the tokens of a text are those of its pieces in order. Only distinct
pieces of a slice of documents are looked at, and only pieces that a worker hasn't met go to
the library.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A word of Latin letters that are stable under NFC, then ASCII marks; an apostrophe could start a
# contraction and "<" a special string, so pieces with these go to the library as they are.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=-@\[-^`{-~]*)")
# The same in Arrow's syntax.
SPLIT = r"\A(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:;=-@\[-^`{-~]*)\z"
LONGEST_KEPT = 64


def chunks(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces, the piece index of each place, and the place where each text starts (and the end)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    coded = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(), offsets - offsets[0]


class Encoder:
    """The library's ids of pieces without white space, through a cache of bounded size.

    The cache has two generations of ``kept`` pieces: when the young one is full it becomes the old one, and what is
    found there comes back.
    """

    def __init__(self, path: str, kept: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.word = None
        if path.endswith("word_bpe_49k.json"):
            # The same model for words that are already normal: one lower-case pre-token each.
            self.word = Tokenizer(self.whole.model)
            self.word.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kept, self.young, self.old = kept, {}, {}

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece from the library, or put together from a plain word and the marks behind it."""
        words, split = {"": b""}, []
        if self.word is not None:
            fits, young, old = PLAIN.fullmatch, self.young, self.old
            for x in pieces:
                m = fits(x)
                pair = (m[1].lower(), m[2]) if m else None
                split.append(pair)
                for w in pair or ():
                    if w not in words:
                        words[w] = young.get(w) or old.get(w)
            model = self.word.model.tokenize
            rest = []
            for w, known in words.items():
                if known is None:
                    if w.isascii():         # its bytes are its signs
                        words[w] = array("I", [t.id for t in model(w)]).tobytes()
                    else:
                        rest.append(w)
            for w, e in zip(rest, self.word.encode_batch_fast(rest, add_special_tokens=False)):
                words[w] = array("I", e.ids).tobytes()
        else:
            split = [None] * len(pieces)
        other = [x for x, pair in zip(pieces, split) if pair is None]
        whole = {x: array("I", e.ids).tobytes() for x, e in zip(other, self.whole.encode_batch_fast(other, add_special_tokens=False))}
        for w, ids in (words | whole).items():
            if 0 < len(w) <= LONGEST_KEPT:
                self.young[w] = ids
        return [whole[x] if pair is None else words[pair[0]] + words[pair[1]] for x, pair in zip(pieces, split)]

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Native 32-bit unsigned ids of each piece."""
        found = list(map(self.young.get, pieces))
        for at in (i for i, x in enumerate(found) if x is None):
            found[at] = self.old.get(pieces[at])
            if found[at] is not None:
                self.young[pieces[at]] = found[at]
        missed = [i for i, x in enumerate(found) if x is None]
        for a in range(0, len(missed), 20_000):
            part = missed[a:a + 20_000]
            for i, x in zip(part, self.encoded([pieces[i] for i in part])):
                found[i] = x
        self.turn()
        return found

    def turn(self) -> None:
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}

    def plain_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case letters alone or of marks alone."""
        young, old, model = self.young, self.old, self.word.model.tokenize
        found = [young.get(w) or old.get(w) for w in words]
        wide = []
        for i, (w, known) in enumerate(zip(words, found)):
            if known is None and w.isascii():
                found[i] = array("I", [t.id for t in model(w)]).tobytes() if w else b""
            elif known is None:
                wide.append(i)
        for i, e in zip(wide, self.word.encode_batch_fast([words[i] for i in wide], add_special_tokens=False)):
            found[i] = array("I", e.ids).tobytes()
        young.update((w, x) for w, x in zip(words, found) if len(w) <= LONGEST_KEPT)
        self.turn()
        return found

    def segments(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids of each piece as two segments: their numbers, and the ids of all segments.

        Plain pieces fall into a word and marks, of which there are far fewer different ones than pieces; they are told apart
        in Arrow. Other pieces are one segment and an empty one.
        """
        if self.word is None:
            whole = np.arange(len(names))
            return whole, np.full(len(names), len(names)), [*self.ids(names.to_pylist()), b""]
        parts = pc.extract_regex(names, SPLIT)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        kept = parts.drop_null()
        words, marks = pc.utf8_lower(kept.field("word")).dictionary_encode(), kept.field("marks").dictionary_encode()
        coded = [b"", *self.plain_ids(words.dictionary.to_pylist())]
        first, second = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        first[plain] = words.indices.to_numpy() + 1
        second[plain] = marks.indices.to_numpy() + len(coded)
        coded += self.plain_ids(marks.dictionary.to_pylist())
        first[~plain] = np.arange(int((~plain).sum())) + len(coded)
        coded += self.ids(names.filter(pa.array(~plain)).to_pylist())
        return first, second, coded


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_ids(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in one array, and where each text's ids start (and the end)."""
    names, codes, offsets = chunks(text)
    first, second, coded = encoder(path).segments(names)
    flat = np.frombuffer(b"".join(coded), "<u4")
    size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    seg = np.empty(2 * len(codes), np.int64)
    seg[::2], seg[1::2] = first[codes], second[codes]
    each = size[seg]
    seg, each = seg[each > 0], each[each > 0]
    ends = np.concatenate([[0], np.cumsum(size[first][codes] + size[second][codes])])
    starts = np.cumsum(each) - each
    at = np.arange(ends[-1]) + np.repeat(begin[seg] - starts, each)
    return flat[at], ends[offsets]
