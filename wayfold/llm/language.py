"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (n = 1 to 3, white space and all that
is no letter being one boundary sign). A document's own most frequent n-grams are compared with each
profile: the distance is the sum of the differences in rank, and the most for an n-gram that the
profile lacks. Profiles count the n-grams of all training documents; nothing is sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wayfold.llm.arrow import freed, strings

LONGEST = 3
TOP = 300
BITS = 21
UNKNOWN = "und"
_letters = None


def letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), np.int64, 0x110000)
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text, each packed into 63 bits, and their counts; none if it has no letter."""
    points = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    points = np.concatenate([[0], points, [0]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    points = points[keep]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts, code = [points[points != 0]], points
    for n in range(2, LONGEST + 1):
        code = (code[:-1] << BITS) | points[n - 1:]
        # A gram starts or ends at most one boundary sign; two in a row were joined above.
        parts.append(code)
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent, ties by code."""
    if len(codes) > 4 * top:
        least = np.partition(counts, -top)[-top]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:top]]


def trains(doc_id: str) -> Column:
    """Documents whose language may be learned from: crc32 of the id as text leaves no remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def profiles(train: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """The ``top`` n-grams of each language; ``top`` numbers for each language reach the driver."""
    @freed
    def count(batches):
        names: dict[str, list] = {}
        held: dict[str, int] = {}

        def joined(name):
            codes = np.concatenate([c for c, _ in names[name]])
            each, at = np.unique(codes, return_inverse=True)
            return each, np.bincount(at, np.concatenate([n for _, n in names[name]]), len(each)).astype(np.int64)

        for batch in batches:
            for name, x in zip(batch.column("lang").to_pylist(), strings(batch.column("text"))):
                got = grams(x)
                names.setdefault(name, []).append(got)
                held[name] = held.get(name, 0) + len(got[0])
                if held[name] > 300_000:
                    names[name] = [joined(name)]
                    held[name] = len(names[name][0][0])
        for name in names:
            codes, n = joined(name)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

    rows = train.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    total = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    out: dict[str, list[int]] = {}
    for r in sorted(best.select("lang", "r", "gram").collect()):
        out.setdefault(r.lang, []).append(r.gram)
    return out


def identify(docs: DataFrame, learned: dict[str, list[int]], text: str = "text", top: int = TOP, pred: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """Every row of ``docs`` with ``pred`` and ``score_as`` (0 to 1: one minus the nearest profile's share of the greatest distance).

    Both names must not be columns of ``docs``.

    ``und`` with score 0 for a null text, one without letters, or if nothing was learned. Ties go to the
    first language in code point order.
    """
    if {pred.lower(), score_as.lower()} & {x.lower() for x in docs.columns}:
        raise ValueError(f"{pred} or {score_as} is a column already: name the results otherwise")
    table = docs.sparkSession.sparkContext.broadcast(learned)

    @freed
    def predict(batches):
        names = sorted(table.value)
        books = []
        for name in names:
            codes = np.asarray(table.value[name], np.int64)
            order = np.argsort(codes)
            books.append((codes[order], order))
        for batch in batches:
            said, share = [], []
            for x in strings(batch.column(text)):
                mine = ranked(*grams(x), top) if x else np.zeros(0, np.int64)
                if not len(mine) or not books:
                    said.append(UNKNOWN)
                    share.append(0.0)
                    continue
                rank, far = np.arange(len(mine)), []
                for codes, place in books:
                    at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
                    off = np.where(codes[at] == mine, np.minimum(np.abs(place[at] - rank), top), top)
                    far.append(int(off.sum()))
                i = int(np.argmin(far))
                said.append(names[i])
                share.append(1.0 - far[i] / (top * len(mine)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(said, pa.string()), pa.array(share, pa.float64())],
                                             [*batch.schema.names, pred, score_as])

    return docs.mapInArrow(predict, StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score_as, DoubleType())]))


def identify_held_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text, learned from the documents that are not held out.

    A null id is not held out. Null languages are not learned from; repeated rows count as often as they occur; an
    empty table gives no rows; other columns are ignored.
    """
    learned = profiles(docs.where(trains(doc_id)), text, lang, top)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (~trains(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return identify(rows, learned, "text", top).select("doc_id", "held_out", "lang_pred", "score")
