"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. Whole copies of the source that fit the target are
certain. For what is left, documents are ranked by random odds over inclusion odds, with
inclusion probabilities in proportion to document size, and taken in that order until the
words left are used. Ranks are cut by buckets of the rank, so no source is ever sorted in one
task, and decisions come down to one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.ranks import numbered
from wayfold.storage import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BROADCAST_SOURCES = 50_000
BUCKETS = 1024
FILLS = 3
KEY = ["_none", "_name"]


def source_key(source: str) -> list[Column]:
    c = F.col(source).cast("string")
    return [c.isNull().alias("_none"), F.coalesce(c, F.lit("")).alias("_name")]


def unit(doc_id: str, text: str, seed: int) -> list[Column]:
    """Two hashes that stand for a document; the first also gives its random number in (0, 1)."""
    h = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    return [h.alias("_unit"), random_number(h).alias("_u")]


def random_number(h: Column) -> Column:
    return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)


def near(df: DataFrame, params: DataFrame) -> DataFrame:
    """Join one row for each source to rows: broadcast if that is small, else salted."""
    if params.count() <= BROADCAST_SOURCES:
        return df.join(F.broadcast(params), KEY)
    salts = 64
    a = df.withColumn("_salt", F.pmod(F.col("_unit"), F.lit(salts)))
    b = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_salt", F.col("_salt").cast("long"))
    return a.join(b, [*KEY, "_salt"]).drop("_salt")


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Add ``target``: the budget dealt by weight, no source above ``most`` times its size, the excess dealt again."""
    n = len(WEIGHTS)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.pmod(F.col("_rank"), F.lit(n)) + 1).cast("int"))
    ranked = written(numbered(sources, KEY, "_rank").withColumn("_w", w), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    budget = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = cap < F.col("_w") * level
        r = ranked.agg(F.sum(F.when(full, cap)).alias("c"), F.sum(F.when(~full, F.col("_w"))).alias("w")).first()
        new = (budget - (r.c or 0.0)) / r.w if r.w else level
        if not new > level:
            break
        level = new
    return ranked.withColumn("target", F.least(cap, F.col("_w") * level))


def plan(rows: DataFrame, share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """One row for each source that decides every document, and the few documents taken besides.

    ``rows``: _none, _name, size, _unit, _u, one unit for each row.
    """
    sizes = rows.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    t = targets(sizes, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = written(t.withColumn("_whole", whole).withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))
                .select(*KEY, "source_size", "target", "_whole", "_left"), "targets")
    units = near(rows.where("size > 0"), t.where("_left > 0"))
    units = written(units.select(*KEY, "_unit", "_u", "size", "_left"), "units")
    fitting = units.where(F.col("size") <= F.col("_left"))
    squares = fitting.groupBy(*KEY).agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("_q"))
    t2 = written(t.join(squares, KEY, "left"), "targets")
    ranked = written(near(fitting.drop("_left"), t2.where("_left > 0")).withColumn("_rankv", pareto()).withColumn("_b", bucket())
                     .select(*KEY, "_unit", "_rankv", "_b", "size", "_left"), "ranked")
    run = Window.partitionBy(*KEY).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = ranked.groupBy(*KEY, "_b").agg(F.sum("size").alias("_n"), F.first("_left").alias("_left")).withColumn("_run", F.sum("_n").over(run))
    edge = cum.where(F.col("_run") > F.col("_left")).groupBy(*KEY).agg(F.min("_b").alias("_edge"), F.min_by(F.col("_run") - F.col("_n"), "_b").alias("_base"))
    t3 = written(t2.join(edge, KEY, "left"), "targets")
    inside = near(ranked.drop("_left"), t3.where("_edge is not null")).where("_b = _edge")
    order = Window.partitionBy(*KEY).orderBy("_rankv", "_unit").rowsBetween(Window.unboundedPreceding, 0)
    last = (inside.withColumn("_run", F.sum("size").over(order)).where(F.col("_base") + F.col("_run") <= F.col("_left"))
            .groupBy(*KEY).agg(F.max(F.struct("_rankv", "_unit")).alias("_last")))
    t4 = written(t3.join(last, KEY, "left"), "targets")
    used = near(units.drop("_left"), t4).where(taken_by_rank()).groupBy(*KEY).agg(F.sum("size").alias("_used"))
    gaps = written(t4.where("_left > 0").join(used, KEY, "left").withColumn("_gap", F.col("_left") - F.coalesce("_used", F.lit(0)))
                   .select(*KEY, "_gap"), "gaps")
    # A few documents that close what the rank order leaves open, each the nearest in size to the gap.
    rest = near(units.drop("_left"), t4).where(~taken_by_rank()).select(*KEY, "_unit", "size")
    extra = None
    for _ in range(FILLS):
        free = rest if extra is None else rest.join(small(extra), [*KEY, "_unit"], "left_anti")
        off = F.abs(F.col("size") - F.col("_gap"))
        best = (near(free, gaps.where("_gap >= 0.5")).where(off < F.col("_gap")).groupBy(*KEY)
                .agg(F.min_by(F.struct("_unit", "size"), F.struct(off, F.col("_unit"))).alias("_best")))
        picked = written(best.select(*KEY, "_best.*"), "fills")
        gaps = written(gaps.join(picked.select(*KEY, "size"), KEY, "left").select(*KEY, (F.col("_gap") - F.coalesce("size", F.lit(0))).alias("_gap")), "gaps")
        picked = picked.select(*KEY, "_unit")
        extra = picked if extra is None else written(extra.unionByName(picked), "fills")
    return t4, written(extra, "fills")


def pareto() -> Column:
    """Random odds divided by inclusion odds; inclusion is in proportion to size and sums to the words left."""
    p = F.least(F.lit(1 - 1e-9), F.col("_left") * F.col("size") / F.col("_q"))
    return F.col("_u") / (1 - F.col("_u")) * (1 - p) / p


def bucket() -> Column:
    return F.floor(F.col("_rankv") / (1 + F.col("_rankv")) * BUCKETS)


def taken_by_rank() -> Column:
    fits = (F.col("_left") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("_left"))
    at_edge = F.col("_last").isNotNull() & (F.struct(pareto().alias("_rankv"), F.col("_unit").alias("_unit")) <= F.col("_last"))
    return F.coalesce(fits & (F.col("_edge").isNull() | (bucket_of() < F.col("_edge")) | ((bucket_of() == F.col("_edge")) & at_edge)), F.lit(False))


def bucket_of() -> Column:
    r = pareto()
    return F.floor(r / (1 + r) * BUCKETS)


def decided(docs: DataFrame, doc_id: str, text: str, source: str, share: float, most: float, seed: int) -> DataFrame:
    """Every row of ``docs`` (columns kept) with size, source_size, target and _copies."""
    own = docs.columns
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), *source_key(source), size.alias("size"), *unit(doc_id, text, seed))
    slim = written(keyed.drop("_row"), "sizes")
    again = written(slim.where("size > 0").groupBy(*KEY, "_unit").agg(F.count("*").alias("_n")).where("_n > 1").select(*KEY, "_unit"), "repeats")
    n = again.count()
    if n:
        keyed = told_apart(keyed, F.broadcast(again) if n <= BROADCAST_SOURCES else again, seed)
        slim = written(keyed.drop("_row"), "sizes")
    params, extra = plan(slim, share, most)
    sides = near(keyed, params).join(on_units(extra), [*KEY, "_unit"], "left")
    copies = F.when(F.col("size") > 0, F.col("_whole") + taken_by_rank().cast("long") + F.coalesce("_more", F.lit(0))).otherwise(0)
    return sides.select("_row", "size", "source_size", "target", copies.cast("long").alias("_copies"))


def told_apart(keyed: DataFrame, again: DataFrame, seed: int) -> DataFrame:
    """Exact repeats (``again`` has their units) become units of their own, by their number among their like.

    Which repeat gets which number doesn't matter, as repeats are equal; the numbers come from a rank over all repeats, so
    a unit of many is not gathered.
    """
    on = [*KEY, "_unit"]
    at = written(keyed.join(again, on, "left_semi").withColumn("_place", F.monotonically_increasing_id()), "repeated")
    ranked = numbered(at, [*on, "_place"], "_rank")
    first = written(ranked.groupBy(*on).agg(F.min("_rank").alias("_first")), "repeats")
    first = F.broadcast(first) if first.count() <= BROADCAST_SOURCES else first
    h = F.xxhash64(F.lit(seed), F.col("_unit"), F.col("_rank") - F.col("_first"))
    apart = ranked.join(first, on).withColumn("_unit", h).withColumn("_u", random_number(h)).select(keyed.columns)
    return keyed.join(again, on, "left_anti").select(keyed.columns).unionByName(written(apart, "repeated"))


def on_units(extra: DataFrame) -> DataFrame:
    return small(extra.withColumn("_more", F.lit(1)))


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its checked size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0,
        seed: int = 20) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    The mix takes ``share`` times the words of all documents, dealt to sources by the weights 3, 1, 2, repeating in
    code point order with null last; a target stops at ``most`` times its source. A document is taken ``taken / size``
    times: floor(target / source size) times for certain, and once more if it is sampled. Reruns agree, as the random
    numbers are hashes of id and text. Null and blank texts have size 0 and are not taken; null ids are allowed; exact
    repeats are rows like others; an empty table gives no rows; other columns are ignored.
    """
    d = decided(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")), "doc_id", "text", "source",
                share, most, seed)
    return d.select(F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0,
                    seed: int = 20) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns."""
    d = decided(docs, doc_id, text, source, share, most, seed)
    return d.where("_copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
