"""Codebooks, license notices and hard negatives against brute force on small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.llm import codebooks, negatives, notices
from wayfold.llm.integers import LIMIT

SCHEMA = "vec_id long, embedding array<double>, label int, error string, code int, q string, bar long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, la, "x", 1, "q", 7) for i, v, la in rows], SCHEMA).repartition(3)


def whole(v, width):
    return [max(-LIMIT, min(LIMIT, math.floor(256 * x))) for x in v] + [0] * (width - len(v))


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(i, [round(r.gauss(0, 0.2), 3) for _ in range(32)], r.choice((0, 1, 1, 1, 2, 9))) for i in range(230)]
    out += [(300 + i, out[3][1], None) for i in range(4)]                                     # ties
    out += [out[5], (None, out[6][1], 2), (7, out[8][1], 1), (400, None, 1), (401, [0.1] * 31 + [None], 1), (402, [float("nan")] * 32, 1),
            (403, [float("inf")] + [0.0] * 31, 1), (404, [], 1), (405, [0.5] * 9, None), (500, [0.0] * 32, 3), (600, [1e9] + [-1e9] * 31, 1)]
    return out


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, la) for i, v, la in rows if good(v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = [(i, whole(v, width), la) for i, v, la in kept]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    step = width // parts
    books = [[first[i][p * step:(p + 1) * step] for i in sorted(first)[:entries]] for p in range(parts)]

    def assign(v):
        got = []
        for p in range(parts):
            x = v[p * step:(p + 1) * step]
            got.append(min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p])))
        return got

    for _ in range(rounds):
        sums = collections.defaultdict(list)
        for _, v, _ in kept:
            for p, (_, j) in enumerate(assign(v)):
                sums[p, j].append(v[p * step:(p + 1) * step])
        for (p, j), xs in sums.items():
            books[p][j] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, assign(v), la) for i, v, la in kept]
    total = collections.Counter()
    for _, a, la in coded:
        total[la] += sum(d for d, _ in a)
    return [(i, "".join(f"{j:02x}" for _, j in a), sum(d for d, _ in a), total[la], digest) for i, a, la in coded]


def test_codes_match_full_search(spark, rows):
    got = codebooks.compress(vectors(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_codes(rows), key=str)
    few = [(i, v, la) for i, v, la in rows if i is not None and i < 9]
    assert sorted(map(tuple, codebooks.compress(vectors(spark, few)).collect())) == sorted(brute_codes(few))


def test_codes_of_empty_tables(spark, rows):
    assert codebooks.compress(vectors(spark, [])).collect() == []
    assert codebooks.compress(vectors(spark, [(None, [1.0] * 32, 1), (1, None, 2)])).collect() == []


def test_labels_too_many_to_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(codebooks, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, codebooks.compress(vectors(spark, rows)).collect()), key=str) == sorted(brute_codes(rows), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 20), st.integers(1, 5))
def test_search_by_sums_is_exact_and_stops_early(seed, entries, width):
    r = np.random.default_rng(seed)
    books = codebooks.Codebooks(r.integers(-3, 4, (2, entries, width)))
    x = r.integers(-4, 5, (30, 2 * width))
    code, off, seen = books.nearest(x)
    d = ((x.reshape(30, 2, 1, width) - books.entries[None]) ** 2).sum(axis=3)
    assert (code == d.argmin(axis=2)).all() and (off == d.min(axis=2)).all() and seen <= d.size
    assert (books.decode(code).reshape(30, 2, width) == books.entries[np.arange(2), code]).all()


def test_search_leaves_entries_out():
    r = np.random.default_rng(1)
    books = codebooks.Codebooks(r.integers(-50, 50, (16, 64, 4)))
    _, _, seen = books.nearest(r.integers(-50, 50, (500, 64)))
    assert seen < 0.7 * 500 * 16 * 64


def brute_negatives(rows, every=100):
    kept = {}
    width = max(len(v) for i, v, la in rows if good(v) and i is not None and la is not None)
    for i, v, la in rows:
        if i is not None and la is not None and good(v):
            x = ((la + 1) % 10 if i % 7 == 0 else la, whole(v, len(v)))
            kept[i] = min(kept.get(i, x), x)
    kept = {i: (la, v + [0] * (width - len(v))) for i, (la, v) in kept.items()}
    out = []
    for a, (la, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lb) for i, (lb, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            window = [(n, i) for n, i, lb in scored if lb != la and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("at_once", [16_384, 7])
def test_negatives_match_full_search(spark, rows, at_once):
    got = negatives.hard_negatives(vectors(spark, rows), every=10, at_once=at_once)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 10)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_negatives_of_clusters_and_rare_labels(spark):
    """Thresholds must fall far: rows of an anchor's label are few or far off, and copies tie."""
    r = random.Random(8)
    centre = [[r.gauss(0, 0.3) for _ in range(16)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centre[i % 4]], 3 if i in (10, 40, 61) else 4 if i == 20 else r.choice((1, 2))) for i in range(300)]
    rows += [(1000 + i, rows[30][1], 1 + i % 2) for i in range(12)]
    rows += [(2000, [0.0] * 16, 1), (2010, [-x for x in centre[0]], 5), (2011, centre[0], 5)]
    got = sorted(map(tuple, negatives.hard_negatives(vectors(spark, rows), every=10).collect()))
    assert got == brute_negatives(rows, 10)
    assert negatives.hard_negatives(vectors(spark, [])).collect() == []
    assert negatives.hard_negatives(vectors(spark, [(100, [1.0], 1)])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 20), st.sampled_from([-np.inf, -50.0, 0.0, 40.0, 150.0, 400.0]))
def test_index_joins_every_pair_at_or_above_thresholds(seed, dims, bar):
    r = np.random.default_rng(seed)
    rows, asked = r.integers(-9, 10, (60, dims)), r.integers(-9, 10, (9, dims))
    label, own = r.integers(0, 3, 60), r.integers(0, 3, 9)
    t = np.ceil(bar + r.integers(0, 30, 9).astype(float))
    norms = negatives.prefix_norms(asked)
    index = negatives.Index(np.arange(60), label, rows, norms, t)
    for same in (True, False):
        x, y, s = index.join(own, asked, norms, t, same)
        score = asked @ rows.T
        want = {(i, j, score[i, j]) for i, j in zip(*np.nonzero((score >= t[:, None]) & ((own[:, None] == label[None]) == same)))}
        assert set(zip(x.tolist(), index.ids[y].tolist(), s.tolist())) == want and len(x) == len(want)


def test_index_leaves_out_leading_dimensions():
    r = np.random.default_rng(3)
    asked, rows = r.integers(-30, 30, (4, 64)), r.integers(-30, 30, (50, 64))
    norms = negatives.prefix_norms(asked)
    index = negatives.Index(np.arange(50), np.zeros(50, int), rows, norms, norms[:, -1] ** 2 * 0.6)
    assert index.out.min() > 5 and index.listed[0] == 0


# License notices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(low)]


def edits(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def brute_places(text, notice, most):
    """(first word, last word, edits) of every run of words within the bound."""
    w = [x[0] for x in words_of(text)]
    out = []
    for i in range(len(w)):
        for j in range(i + 1, len(w) + 1):
            run = " ".join(w[i:j])
            if len(run) > len(notice) + most:
                break
            if len(run) >= len(notice) - most:
                e = edits(run, notice, most)
                if e <= most:
                    out.append((i, j, e))
    return out


def mutated(r, s, n):
    s = list(s)
    for _ in range(n):
        i = r.randrange(len(s))
        kind = r.random()
        if kind < 0.4:
            s[i] = r.choice("abcdexyz é")
        elif kind < 0.7:
            s.insert(i, r.choice("abcxyzé"))
        else:
            del s[i]
    return "".join(s)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(6)
    filler = "The quick fox, under a licensed bridge; public works version two Straße ünder gnu cc BY-products apache mit license-free".split()
    some = lambda n: " ".join(r.choice(filler) for _ in range(n))
    out = []
    for i in range(150):
        _, notice, most = r.choice(notices.NOTICES)
        line = mutated(r, notice, r.choice((0, 1, most, most + 1, most + 4)))
        line = r.choice((str, str.upper, str.title))(line)
        out.append(f"{some(r.randint(0, 12))}\n{line.replace(' ', r.choice((' ', ', ', '  ', chr(10))))}. {some(r.randint(0, 9))}")
    out += [None, "", " \t", "İ MIT License", "limit license mit licenses", "mit license mit license; MIT\u0000LICENSE", "CC\tBY cc-by CC BY-NC 4.0", "gnu general public license " * 3000,
            "word " * 30_000 + "Released under the M1T Licence.", "x" * 200_000, "GNU General Public License", "é" * 3 + " Apache License"]
    return out


def test_notices_match_every_run_of_words(spark, texts):
    rows = [(i, t, "s", 3, "f") for i, t in enumerate(texts)] + [(None, "apache license", "s", 3, "f"), (5, texts[5], "s", 3, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int, found string").repartition(3)
    got = notices.summary(docs).collect()
    assert len(got) == len(rows)
    seen = collections.Counter()
    for r in got:
        text = "apache license" if r.doc_id is None else texts[r.doc_id]
        w = words_of(text)
        plain = [x[0] for x in w]
        base = sorted((i, la) for ph, la in notices.PHRASES.items() for i in range(len(w)) if plain[i:i + len(ph.split())] == ph.split()) if len(w) < 5000 else None
        assert r.n_words == len(w)
        if base is not None:
            assert (r.n_base, r.first_word, r.last_word) == (len(base), base[0][0] if base else None, base[-1][0] if base else None)
            assert r.base_labels == ",".join(sorted({la for _, la in base}))
        found = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        assert r.labels == ",".join(sorted(set(filter(None, r.base_labels.split(","))) | {x[0] for x in found}))
        assert 0 <= r.score <= 1 and (r.score == 1) == (r.n_base > 0 or any(x[3] == "0" for x in found))
        if len(w) < 500:
            starts, ends = {x[1]: i for i, x in enumerate(w)}, {x[2]: i + 1 for i, x in enumerate(w)}
            near = {la: [] for la, _, _ in notices.NOTICES}
            for la, notice, most in notices.NOTICES:
                near[la] += brute_places(text, notice, most)
            assert {x[0] for x in found} == {la for la, p in near.items() if p}, text
            for la, a, b, e in found:
                at = (starts[int(a)], ends[int(b)])
                assert any((i, j) == at and k <= int(e) for i, j, k in near[la]), (text, la, a, b, e)
                seen[int(e) > 0] += 1
    assert seen[True] > 30 and seen[False] > 10
    by = {r.doc_id: r for r in got}
    long = by[texts.index("word " * 30_000 + "Released under the M1T Licence.")]
    assert long.labels == "mit" and long.n_base == 0 and long.spans.startswith("mit:150000:150030:")
    many = by[texts.index("gnu general public license " * 3000)]
    assert many.n_base == 3000 and many.last_word == 11_996 and many.spans.count("gpl:") == 3000
    assert notices.summary(docs.limit(0)).collect() == []
