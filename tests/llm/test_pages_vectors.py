"""Pages and vectors: exact round trips, brute force, held-out pages."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import zstandard

from wayfold.llm import curves, html_text, warc
from wayfold.storage import new_path


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, digest string, _salt int").repartition(3)


HTML = ["<p>short</p>", "<p>" + "long page " * 300 + "</p>", "<p>" + "another " * 400 + "é</p>"]
ROWS = [(1, "http://a/1", HTML[0]), (2, "http://a/2", HTML[0]), (3, "http://a/3 x", HTML[1]), (4, None, HTML[1]), (9, "http://b\r\n/", HTML[1]), (5, "u", None), (6, "u", ""),
        (None, "u", HTML[2]), (7, "u", HTML[2]), (7, "u", HTML[2])]


def test_archives_round_trip(spark):
    got = sorted(map(tuple, warc.archived(pages(spark, ROWS), archive_bytes=4000).collect()), key=str)
    want = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        top = max((j for j, _, x in ROWS if (x or "") == (h or "") and j is not None), default=None)
        again = len(b) >= 1000 and top is not None and i != top
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=str)
    assert warc.archived(pages(spark, ROWS).limit(0)).collect() == []


def test_archive_files_are_plain_zstandard_with_a_leading_dictionary(spark):
    path = new_path(spark, "warc-test")
    many = [(i, f"http://a/{i}", f"<html><body><p>page number {i} of the site</p>{'text ' * (i % 50)}</body></html>") for i in range(300)]
    warc.write(warc.decided(pages(spark, many), "page_id", "url", "html", 2), path)
    files = [r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    seen = {}
    for content in map(bytes, files):
        if not content:
            continue
        assert content[:4] == (0x184D2A5D).to_bytes(4, "little")
        n = int.from_bytes(content[4:8], "little")
        reader = zstandard.ZstdDecompressor(dict_data=warc.dict_of(content[8:8 + n])).stream_reader(content, read_across_frames=True)
        text = reader.read()
        assert text.count(b"WARC/1.1\r\n") == len(list(warc.archive_records(content)))
        seen |= {f["WARC-Record-ID"]: body for f, body in warc.archive_records(content)}
    assert {f"<urn:page:{i}>": h.encode() for i, _, h in many} == seen


@pytest.fixture(scope="module")
def model():
    return html_text.fit(html_text.labelled_pages())


def test_held_out_layouts(model):
    made = html_text.labelled_pages(150, seed=99)
    right = wrong = missed = 0
    for x, got in zip(made, html_text.main_texts([re.sub(r' data-gold="\d"', "", x) for x in made], model)):
        page = html_text.Page(x, gold=True)
        gold = [t for t, y in zip(page.text, page.label) if t is not None and y]
        found = got.split("\n") if got else []
        right += len(set(gold) & set(found))
        wrong += len(set(found) - set(gold))
        missed += len(set(gold) - set(found))
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_messages_match_enumeration():
    page = html_text.Page("<body><div class='ad'>x y</div><article><p>one</p></article></body>")
    forest, r = html_text.Forest([page]), np.random.default_rng(1)
    w, ties = r.normal(size=len(html_text._features)), r.normal(size=(html_text.EDGES, 2, 2))
    n, p = forest.n, np.zeros(forest.n)
    local = np.bincount(forest.row, w[forest.col] * forest.value, n)
    total = 0.0
    for y in np.ndindex(*[2] * n):
        s = np.exp(sum(local[i] * y[i] for i in range(n)) + sum(ties[forest.edge[i]][y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0))
        total += s
        p += s * np.asarray(y)
    assert np.allclose(forest.pass_messages(w, ties)[0], p / total)


def test_page_text(spark):
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>a</a></li></ul></nav><!-- ad -->"
            "<div class=\"ad\">Buy this now.</div><article><h1>A &amp; B</h1><p><b>First  part<br>here.<br><p>Second\n one &lt;x&gt; goes on for a while.</p></article>"
            "<div class='comments'><p>I like it very much indeed.</p></div><footer>&copy; me</footer></body></html>")
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "<nav><a href='x'>y</a></nav>"), (1, "u", page), (4, "u", "<div " * 2000 + "<p>x"), (5, "u", "<ul><li>" * 3000)]
    got = html_text.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    want = "A & B\nFirst part here.\nSecond one <x> goes on for a while."
    by = {}
    for r in got:
        assert r.n_chars == len(r.text)
        by.setdefault(r.page_id, []).append(r.text)
    assert by[1] == [want, want] and by[2] == by[3] == by[None] == [""]
    assert html_text.extract(pages(spark, rows).limit(0)).collect() == []


def test_hilbert_curve_is_one_step_at_a_time():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curves.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(side ** dims))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    vectors = {i: (centres[i % 12] + 0.4 * r.normal(size=16)).astype(np.float32).tolist() for i in range(900)}
    vectors |= {900 + i: vectors[40] for i in range(300)}          # one very common vector
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [1.0, None] + [0.0] * 14), (2060, [float("nan")] * 16), (2080, [float("inf")] * 16), (2100, []), (2120, [1.0] * 3), (None, [1.0] * 16), (40, vectors[40])]
    rows = spark.createDataFrame([(i, v, 1, "x") for i, v in [*vectors.items(), *odd]], "vec_id long, embedding array<float>, label int, rep string")
    got = curves.search(rows).collect()
    ids = np.asarray(sorted(vectors))
    x = np.asarray([vectors[i] for i in ids], np.float64)
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append(g)
    asked = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(by) == asked
    hits = 0
    for q in asked:
        s = x @ np.asarray(vectors[q], np.float64)
        own = sorted(by[q], key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 21)) and all(g.vec_id != q for g in own) and len({g.vec_id for g in own}) == 20
        assert all(abs(g.score - s[np.searchsorted(ids, g.vec_id)]) < 1e-9 for g in own)
        assert [(-g.score, g.vec_id) for g in own] == sorted((-g.score, g.vec_id) for g in own)
        keep = ids != q
        best = ids[keep][np.lexsort((ids[keep], -np.round(s[keep], 9)))][:20]
        hits += len(set(best.tolist()) & {g.vec_id for g in own})
    assert hits / (20 * len(asked)) >= 0.9
    few = curves.search(rows.where("vec_id in (0, 1, 2)")).collect()
    assert sorted((g.query_id, g.vec_id) for g in few) == [(0, 1), (0, 2)]
    assert curves.search(rows.limit(0)).collect() == []


def test_nesting_is_linear(model):
    n = 200_000
    for page in ("<div>" * n + "deep text of the page", "<div>" * n + "</p>" * n, "<ul>" + "<li>" * n, "<svg>" * n + "x", "<td>" * n, "<iframe><object>" * (n // 2), "<p>" * n + "</div>" * n):
        start = time.process_time()
        html_text.main_texts([page], model)
        assert time.process_time() - start < 15      # seconds; a scan of the stack for each element takes hours


def test_deep_pages_by_node(model):
    """Messages node by node give what messages by level give."""
    page = "<body>" + "".join(f"<div class='{r}'><p>some words {i}</p>" for i, r in enumerate(["content", "ad", "", "menu"] * 150))
    forest = html_text.Forest([html_text.Page(page), html_text.Page("<p>short</p>")])
    assert len(forest.levels) > html_text.DEEP
    assert np.allclose(forest.marginals(*model), forest.pass_messages(*model)[0], atol=1e-9)
