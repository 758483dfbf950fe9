"""SimHash fingerprints and exact near-duplicate groups through vantage-point trees.

Distances between 64-bit fingerprints of unrelated texts all lie near 32, so a tree over them
prunes nothing. Fingerprints that differ in at most 4 bits differ in at most one bit in some of
three parts, and Hamming distance in a part is a metric as well: each part has a vantage-point
tree, in which the triangle inequality prunes with radius 1. The upper levels of a tree deal the
fingerprints to shards; a fingerprint near a boundary also visits the shard beyond it as a guest.
Each shard is searched by the lower levels, and every candidate is compared in all 64 bits.

Only distinct fingerprints take part. Shards give links that join what must be joined, at most a
few for each fingerprint, not all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import freed, strings
from wayfold.llm.names import free_name
from wayfold.operators.clusters import components
from wayfold.storage import written

WORDS = 4
SEED = 42
PARTS = ((0, 22), (22, 21), (43, 21))   # first bit, width
SHARD_ROWS = 20_000
SAMPLE = 8192
LEAF = 128
DENSE = 4_000_000
SALTS = 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 without words."""
    words = (text or "").encode().lower().split()       # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    one, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, 65_536):
        h = np.fromiter((one(b" ".join(words[i:i + WORDS]), SEED) for i in range(a, min(a + 65_536, n))), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``fp`` (the 64 bits as a signed long) in place of the text column."""
    @freed
    def run(batches):
        for batch in batches:
            kept = [i for i, c in enumerate(batch.schema.names) if c != text]
            values = np.fromiter(map(fingerprint, strings(batch.column(text))), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(values)], [*(batch.schema.names[i] for i in kept), "fp"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text]
    return rows.mapInArrow(run, ", ".join([*schema, "fp long"]))


def part_of(fp: np.ndarray, part: int) -> np.ndarray:
    shift, width = PARTS[part]
    return (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def vantage(values: np.ndarray, tries: int = 6) -> tuple[int, np.ndarray] | None:
    """The value, of a few spread over the input, whose distances vary most, and all distances to it."""
    best = None
    for v in values[np.linspace(0, len(values) - 1, tries).astype(np.int64)]:
        d = np.bitwise_count(values ^ v).astype(np.int8)
        if d.min() < d.max() and (best is None or d.std() > best[1].std()):
            best = int(v), d
    return best


def tree(values: np.ndarray, depth: int) -> tuple | None:
    """Nested (vantage point, greatest distance on the near side, near, far); None is a shard."""
    found = vantage(values) if depth and len(values) > 1 else None
    if found is None:
        return None
    v, d = found
    mu = min(int(np.median(d)), int(d.max()) - 1)
    return v, mu, tree(values[d <= mu], depth - 1), tree(values[d > mu], depth - 1)


def deal(node, values, rows, guest, radius, path=1):
    """Shards of values: (shard, rows, guest). Everything has one home; guests go where a partner may live.

    Of two homes on both sides of a boundary only the near one visits, so no pair is looked at twice.
    """
    if node is None or not len(rows):
        if len(rows):
            yield path, rows, guest
        return
    v, mu, near, far = node
    d = np.bitwise_count(values ^ np.uint64(v)).astype(np.int64)
    for side, child in ((0, near), (1, far)):
        if side == 0:
            go, as_guest = np.where(guest, d - radius <= mu, d <= mu), guest
        else:
            go, as_guest = np.where(guest, d + radius > mu, d + radius > mu), guest | (d <= mu)
        yield from deal(child, values[go], rows[go], as_guest[go], radius, 2 * path + side)


def cover(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join whatever chains of close fingerprints join, for dense sets: one ball after another.

    All within ``bits`` of a vantage point are linked to it. Others can be close to a member only if they are
    within twice that, and one link to the ball is enough for each.
    """
    out, rest = [], fps
    while len(rest) > 1:
        v, rest = rest[0], rest[1:]
        d = np.bitwise_count(rest ^ v)
        ball = rest[d <= bits]
        rest, d = rest[d > bits], d[d > bits]
        if not len(ball):
            continue
        out.append((np.full(len(ball), v), ball))
        open_ = rest[d <= 2 * bits]
        step = max(1, DENSE // max(1, len(open_)))
        for a in range(0, len(ball), step):
            if not len(open_):
                break
            close = np.bitwise_count(open_[:, None] ^ ball[None, a:a + step]) <= bits
            hit = close.any(axis=1)
            if hit.any():
                out.append((open_[hit], ball[a:a + step][close[hit].argmax(axis=1)]))
                open_ = open_[~hit]
            step = max(1, DENSE // max(1, len(open_)))
    return out


def close_pairs(home: np.ndarray, guest: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    both = np.concatenate([home, guest])
    if len(home) * len(both) <= DENSE:
        i, j = np.nonzero(np.bitwise_count(home[:, None] ^ both[None, :]) <= bits)
        keep = (j >= len(home)) | (i < j)
        i, j = i[keep], j[keep]
        if len(i) <= 4 * len(both):
            return [(home[i], both[j])] if len(i) else []
    return cover(both, bits)


def search(home: np.ndarray, guest: np.ndarray, part: int, radius: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among homes, and between homes and guests, through a vantage-point tree over the part."""
    out, todo = [], [(home, guest)]
    while todo:
        home, guest = todo.pop()
        if not len(home):
            continue
        found = vantage(part_of(home, part)) if len(home) > LEAF else None
        if found is None:
            out += close_pairs(home, guest, bits)
            continue
        v, d = found
        mu = min(int(np.median(d)), int(d.max()) - 1)
        g = np.bitwise_count(part_of(guest, part) ^ np.uint64(v)).astype(np.int64)
        near, edge = d <= mu, (d <= mu) & (d.astype(np.int64) + radius > mu)
        todo.append((home[near], guest[g - radius <= mu]))
        todo.append((home[~near], np.concatenate([guest[g + radius > mu], home[edge]])))
    return out


def links(distinct: DataFrame, bits: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(src, dst) links between distinct ``fp``: their components are those of all pairs at most ``bits`` apart."""
    radius = bits // len(PARTS)
    spark = distinct.sparkSession
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    seen = np.fromiter((r.fp for r in sample), np.int64, len(sample)).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, distinct.count()) / shard_rows))))
    trees = spark.sparkContext.broadcast([tree(part_of(seen, p), depth) for p in range(len(PARTS))])

    @freed
    def route(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for p in range(len(PARTS)):
                start = np.arange(len(fps)), np.zeros(len(fps), bool)
                for shard, rows, guest in deal(trees.value[p], part_of(fps, p), *start, radius):
                    key = np.full(len(rows), shard * len(PARTS) + p)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[rows].view(np.int64)), pa.array(guest)], ["shard", "fp", "guest"])

    def shard_links(table):
        p = table["shard"][0].as_py() % len(PARTS)
        fps, guest = table["fp"].to_numpy().view(np.uint64), table["guest"].to_numpy()
        order = np.argsort(fps)
        fps, guest = fps[order], guest[order]
        found = search(fps[~guest], fps[guest], p, radius, bits)
        a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
        return pa.table({"src": a.view(np.int64), "dst": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(route, "shard long, fp long, guest boolean")
    return dealt.groupBy("shard").applyInArrow(shard_links, "src long, dst long").distinct()


def groups(fps: DataFrame, bits: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp, root): the least fingerprint of its component, for fingerprints that have a link."""
    found = written(links(fps, bits, shard_rows), "links")
    nodes = found.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return components(nodes, found).select(F.col("id").alias("fp"), F.col("component").alias("root"))


def salted_left(rows: DataFrame, table: DataFrame, key: str, salt) -> DataFrame:
    """Left join on a key that may be very frequent in ``rows`` and is unique in ``table``."""
    a = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    b = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return a.join(b, [key, "_salt"], "left").drop("_salt")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id of every whole text.

    Fingerprints link at ``bits`` or fewer differing bits, and component_id is the least doc_id that links reach. Null
    and blank texts have fingerprint zero. Null ids are allowed and are never the least; a group of null ids alone has
    a null component. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = written(fingerprints(rows), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    linked = written(groups(distinct, bits, shard_rows), "groups")
    least = linked.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    table = salted_left(linked, least, "root", "fp").select("fp", "component_id")
    alone = distinct.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    out = salted_left(rows, table.unionByName(alone), "fp", "doc_id")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the one with the least (doc_id, hash of the text), nulls last."""
    own = F.xxhash64(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), own.alias("row"))
    rows = written(fingerprints(rows), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    distinct = written(rows.groupBy("fp").agg(first), "distinct")
    linked = written(groups(distinct.select("fp"), bits, shard_rows), "groups")
    best = linked.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("first"))
    alone = distinct.join(linked, "fp", "left_anti")
    keep = written(best.select("first.row").unionByName(alone.select("first.row")).distinct(), "kept")
    name = free_name("_row", docs)
    kept = docs.withColumn(name, own).join(keep.select(F.col("row").alias(name)).hint("shuffle_hash"), name, "left_semi")
    again = rows.join(keep, "row", "left_semi").groupBy("row").count().where("count > 1").limit(1).count()
    if again:           # exact repeats of a row: keep one
        kept = kept.dropDuplicates([name])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
