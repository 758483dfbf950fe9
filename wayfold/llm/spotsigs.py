"""SpotSigs fingerprints with DataFrame functions alone.

A common word is an anchor; the chain of the next content words after it is a spot signature, and
the set of a text's chains is its fingerprint. Sets are alike by Jaccard. Sets whose sizes differ
too much cannot be alike, so sets are partitioned by size, and only sets of the same or the next
partition with a rare signature in common are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Common words of the languages in use.
ANCHORS = (
    "the of and to a in is that it for was on with be by as this are at from "
    "der die und in den von zu das mit sich auf des für ist nicht dem im ein eine als "
    "de la le et les des en un du une que pour est qui par dans sur au pas avec "
    "de la que el en y los se del las por un no con su una es para al lo").split()
CHAIN = 3
MARK = "\u0001"
LAST = (1 << 63) - 1


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures (64-bit hashes of chains) of a whole text that is not null.

    Every anchor starts a chain of the next ``chain`` content words (fewer at the end). A text without an anchor
    takes chains from every word, and one without words has itself as its only signature.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(*sorted(set(ANCHORS))), MARK).otherwise(w)), " ")
    content = F.filter(F.split(F.replace(marked, F.lit(MARK + " "), F.lit(MARK)), " "), lambda w: F.replace(w, F.lit(MARK), F.lit("")) != "")

    def spots(c):
        places = F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
        spot = lambda i: F.xxhash64(F.replace(F.concat_ws(" ", *[F.get(c, i + k) for k in range(chain)]), F.lit(MARK), F.lit("")))
        anchored = F.transform(F.filter(places, lambda i: F.startswith(F.get(c, i), F.lit(MARK))), spot)
        return F.transform(F.array(anchored), lambda a: F.when(F.size(a) > 0, a).otherwise(F.transform(places, spot)))[0]

    found = F.transform(F.array(content), spots)[0]
    return F.transform(F.array(found), lambda s: F.array_sort(F.array_distinct(F.when(F.size(s) > 0, s).otherwise(F.array(F.xxhash64(text))))))[0]


def fingerprint(sigs: Column) -> Column:
    return F.sha2(F.array_join(sigs.cast("array<string>"), ","), 256)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without comparing them if their sizes alone keep it below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    return F.when(large == 0, 1.0).when(small < large * F.lit(float(least)), 0.0).otherwise(exact) if least else F.when(large == 0, 1.0).otherwise(exact)


def starts(rows: DataFrame, order: str, bands: int) -> list[int]:
    """The least value of each of about ``bands`` even bands of an integer column: exact, one number for each band."""
    at = rows.agg(F.percentile_approx(order, [i / bands for i in range(1, bands)], 20 * bands).alias("q")).first().q if bands > 1 else []
    guess = sorted(set(at or []))
    return sorted(r[0] for r in rows.select(order, band_of(F.col(order), guess).alias("b")).groupBy("b").agg(F.min(order)).select(f"min({order})").collect())


def band_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value``, by bisection."""
    if not bounds:
        return F.lit(0)
    table, n = F.lit(bounds).cast("array<long>"), len(bounds)
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(table, at + s - 1) <= value), at + s).otherwise(at))


def with_next(rows: DataFrame, order: str, tie: str, carried: list[str], bands: int | None = None) -> DataFrame:
    """Add ``next``: the carried columns of the next row by (order, tie), for the last row those of the first.

    Rows are dealt in bands of the order column, and the first rows of each band are copied to the band before.
    """
    spark = rows.sparkSession
    bands = bands or min(4096, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = starts(rows.select(order), order, bands)
    value, own = F.col(order), band_of(F.col(order), first) - 1
    entry = lambda band, wrap, guest: F.struct(band.cast("int").alias("_band"), F.lit(wrap).alias("_wrap"), F.lit(guest).alias("_guest"))
    mine, none = F.array(entry(own, 0, False)), F.array().cast("array<struct<_band:int,_wrap:int,_guest:boolean>>")
    heads = F.lit(first).cast("array<long>") if first else F.array().cast("array<long>")
    before = F.when((own > 0) & (F.get(heads, own) == value), F.array(entry(own - 1, 0, True))).otherwise(none)
    around = F.when(value == F.lit(first[0] if first else 0), F.array(entry(F.lit(max(0, len(first) - 1)), 1, True))).otherwise(none)
    dealt = rows.withColumn("_place", F.explode(F.concat(mine, before, around))).select(*rows.columns, "_place.*")
    w = Window.partitionBy("_band").orderBy("_wrap", order, tie)
    return dealt.withColumn("next", F.lead(F.struct(*carried)).over(w)).where(~F.col("_guest")).drop("_band", "_wrap", "_guest")


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chain: int = CHAIN) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, by ascending doc_id (null ids last, ties by a hash of the text); the first follows the last. Null texts
    are empty. Repeated rows stay and follow each other; other columns are ignored; an empty table gives no rows.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("_order"))
    rows = rows.select("doc_id", "text", "_order", F.xxhash64("text").alias("_tie"), signatures(F.col("text"), chain).alias("sigs"))
    d = with_next(rows, "_order", "_tie", ["text", "sigs"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)))
    d = d.withColumn("edited_sigs", signatures(F.col("edited"), chain))
    return d.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
                    likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next.sigs")).alias("near_next"))


def near_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints, (doc_id, fingerprint), and pairs of classes, (a, b, likeness), that are alike.

    Partition k holds the set sizes from least^-k on. A set looks for partners in its own partition and the one below,
    by its rarest signatures: of n, n - ceil(least n) + 1 must include one that any partner has too.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), signatures(t, chain).alias("sigs")).select("doc_id", fingerprint(F.col("sigs")).alias("fingerprint"), "sigs")
    sets = rows.groupBy("fingerprint").agg(F.first("sigs").alias("sigs"))
    size, part = F.size("sigs"), F.floor(F.log(F.size("sigs")) / math.log(1 / least) + 1e-9)
    each = sets.select("fingerprint", F.explode("sigs").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count("*").alias("df"))
    order = Window.partitionBy("fingerprint").orderBy("df", "sig")
    rare = (each.join(rarity, "sig").where("df > 1").withColumn("r", F.row_number().over(order)).join(sets.select("fingerprint", size.alias("n"), part.alias("part")), "fingerprint")
            .where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1))
    left = rare.select("sig", F.col("fingerprint").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    right = rare.select("sig", F.col("fingerprint").alias("b"), F.col("n").alias("nb"), "part")
    fits = (F.col("nb") >= F.col("na") * least) & (F.col("nb") <= F.col("na")) & ((F.col("nb") < F.col("na")) | (F.col("b") < F.col("a")))
    pairs = left.join(right, ["sig", "part"]).where(fits).select("a", "b").distinct()
    pairs = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"), least))
    return rows.select("doc_id", "fingerprint"), pairs.where(F.col("likeness") >= least).select("a", "b", "likeness")
