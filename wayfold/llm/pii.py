"""Personal data: fixed patterns, and a skip-chain conditional random field around them.

Sites are the spans of the patterns and whatever else looks like a number or an address. A chain
links each site to the next; skip links join distant sites that repeat a site or share its last
digits. Spans of the patterns are observed; loopy sum-product message passing carries their labels
along the links, and a site with a high marginal becomes a span too, so that an entity is found
wherever the document repeats it in another form. Sites without any number or address sign have
the label "none" with certainty and need no node.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import freed, strings

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LIKE = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,3}[0-9]){6,}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+[\x20]?(?:@|\(at\)|\[at\]|[\x20]at[\x20])[\x20]?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SIGN = re.compile(r"[0-9]|@|[(\[]at[)\]]")
DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        n = int(x)
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Every match holds one @; its local part is the run of signs before, its domain what follows."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four patterns, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = DIGITS.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


FEATURES = 12


def features(site: str) -> np.ndarray:
    """What a site looks like: its length in digits, checksum, signs. The first is constant."""
    d = DIGITS.sub("", site)
    n = len(d)
    dots = site.count(".")
    bits = (1, n < 9, 9 <= n <= 12, 13 <= n <= 15, 16 <= n <= 19, n > 19, 13 <= n <= 19 and luhn(d), "@" in site, dots >= 3, site[:1] == "+", "(" in site,
            " " in site or "-" in site)
    return np.asarray(bits, np.float64)


def alike(site: str) -> list[str]:
    """Keys under which sites count as the same entity: all its signs, and its last digits."""
    if any(c.isalpha() for c in site):
        flat = re.sub(r"[\x20(\[]*(?:@|\bat\b)[)\]\x20]*", "@", site.lower())
        return ["a" + flat]
    d = DIGITS.sub("", site)
    return ["d" + d] + (["t" + d[-9:]] if len(d) >= 9 else [])


def sites(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind or NONE) in order; patterns first, other candidates where they overlap none."""
    taken = sorted((a, b, k) for k, a, b in base)
    out, i = list(taken), 0
    for m in LIKE.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not any(x < b for x, _, _ in taken[i:i + 1]):
            out.append((a, b, NONE))
    return sorted(out)


def skips(names: list[str]) -> list[tuple[int, int]]:
    """Each site with the last one before it under each key: every repeat is reached, with as many links as sites."""
    last: dict[str, int] = {}
    out = set()
    for i, x in enumerate(names):
        for key in alike(x):
            if key in last:
                out.add((last[key], i))
            last[key] = i
    return sorted(out)


def marginals(unary: np.ndarray, links: list[tuple[int, int]], pair: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Loopy sum-product: label marginals of every node. ``unary``: log potentials; ``pair``: log potential of each link."""
    n, k = unary.shape
    if not links:
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    a, b = np.asarray(links).T
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    table = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
    message = np.zeros((len(src), k))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, message)
        out = belief[src] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", out, table) + 1e-30)
        new -= new.max(axis=1, keepdims=True)
        done = np.abs(new - message).max() < 1e-4
        message = 0.5 * message + 0.5 * new
        if done:
            break
    belief = unary.copy()
    np.add.at(belief, dst, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(examples: list[tuple[list[str], list[int]]], rounds: int = 300, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights by pseudo-likelihood. ``examples``: the sites of a document and their kinds.

    Each document's sites are seen once more with half of their looks hidden, as if written in another form, so that
    the links learn to carry a label.
    """
    k = len(KINDS) + 1
    model = {"unary": np.zeros((FEATURES, k)), "chain": np.zeros((k, k)), "skip": np.zeros((k, k))}
    rng = np.random.default_rng(seed)
    rows, label, chain, skip = [], [], [], []
    for names, kinds in examples:
        x = np.stack([features(s) for s in names])
        hidden = x.copy()
        hide = rng.random(len(x)) < 0.5
        hidden[hide, 1:] = 0
        both, kinds2 = names + names, list(kinds) + list(kinds)
        near, far = np.zeros((2 * len(x), k)), np.zeros((2 * len(x), k))
        for i in range(len(both) - 1):
            near[i, kinds2[i + 1]] += 1
            near[i + 1, kinds2[i]] += 1
        for i, j in skips(both):
            far[i, kinds2[j]] += 1
            far[j, kinds2[i]] += 1
        rows.append(np.concatenate([x, hidden]))
        label += kinds2
        chain.append(near)
        skip.append(far)
    if not rows:
        return model
    x, c, s, y = np.concatenate(rows), np.concatenate(chain), np.concatenate(skip), np.asarray(label)
    want = np.eye(k)[y]
    for i in range(rounds):
        z = x @ model["unary"] + c @ model["chain"] + s @ model["skip"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        off = (want - p / p.sum(axis=1, keepdims=True)) / len(y)
        rate = 4.0
        model["unary"] += rate * (x.T @ off - 1e-4 * model["unary"])
        for name, m in (("chain", c), ("skip", s)):
            g = m.T @ off
            model[name] += rate * ((g + g.T) / 2 - 1e-4 * model[name])
    return model


def spans(text: str, model: dict[str, np.ndarray], least: float = 0.95) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that the field adds, as (kind, start, end)."""
    if not SIGN.search(text):
        return [], []
    base = base_spans(text)
    found = sites(text, base) if base else []
    if len(found) == len(base):         # nothing to carry, or nobody to carry it to
        return base, []
    names = [text[a:b] for a, b, _ in found]
    unary = np.stack([features(s) for s in names]) @ model["unary"]
    for i, (_, _, kind) in enumerate(found):
        if kind != NONE:
            unary[i] = -1e3
            unary[i, kind] = 0.0
    chain = [(i, i + 1) for i in range(len(found) - 1)]
    skip = skips(names)
    pair = np.concatenate([np.repeat(model["chain"][None], len(chain), 0), np.repeat(model["skip"][None], len(skip), 0)])
    p = marginals(unary, chain + skip, pair)
    linked = {i for link in skip for i in link}
    added = []
    for i, (a, b, kind) in enumerate(found):
        best = int(p[i, :NONE].argmax())
        if kind == NONE and i in linked and p[i, best] >= least:
            added.append((best, a, b))
    return base, added


def train(docs: DataFrame, text: str = "text", sample_docs: int = 4000, sample_sites: int = 200) -> dict[str, np.ndarray]:
    """Weights from at most about ``sample_docs`` documents, labelled by the patterns, and the first ``sample_sites`` sites of each.

    Both bound what reaches the driver for the fit alone; ``spans`` looks at every site of every document.
    """
    rows = docs.count()
    sample = docs.select(F.col(text).cast("string").alias("text"))
    if rows > sample_docs:
        sample = sample.sample(fraction=sample_docs / rows, seed=3)

    @freed
    def label(batches):
        for batch in batches:
            names, kinds = [], []
            for x in strings(batch.column("text")):
                if x and SIGN.search(x):
                    found = sites(x, base_spans(x))[:sample_sites]
                    if found:
                        names.append([x[a:b] for a, b, _ in found])
                        kinds.append([k for _, _, k in found])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int32()))], ["names", "kinds"])

    got = sample.mapInArrow(label, "names array<string>, kinds array<int>").collect()
    return fit(sorted((list(r.names), list(r.kinds)) for r in got))


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(found))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 4000) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every whole text.

    Counts and digest are those of the patterns; ``spans`` also holds the n_added spans of the field. Null texts are
    empty: no spans, the digest of nothing. Null ids and repeated rows stay; other columns are ignored; an empty table
    gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text, sample_docs))

    @freed
    def run(batches):
        for batch in batches:
            counts, digest, every, more = [], [], [], []
            for x in strings(batch.column("text")):
                base, added = spans(x, model.value) if x else ([], [])
                counts.append([sum(k == i for k, _, _ in base) for i in range(len(KINDS))])
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                every.append(listed(base + added))
                more.append(len(added))
            n = np.asarray(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(n[:, i]) for i in range(len(KINDS))), pa.array(digest, pa.string()), pa.array(every, pa.string()), pa.array(more, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, text: str = "text", sample_docs: int = 4000) -> DataFrame:
    """The rows of ``docs`` with each span replaced by its kind in square brackets; other columns and null texts stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text, sample_docs))

    @freed
    def run(batches):
        for batch in batches:
            new = []
            for x in strings(batch.column(text)):
                base, added = spans(x, model.value) if x else ([], [])
                if base or added:
                    parts, at = [], 0
                    for a, b, k in sorted((a, b, k) for k, a, b in base + added):
                        if b <= at:
                            continue
                        parts += [x[at:max(a, at)], f"[{KINDS[k]}]"]
                        at = b
                    x = "".join(parts) + x[at:]
                new.append(x)
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, text, pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
