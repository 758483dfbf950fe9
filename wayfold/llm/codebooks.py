"""Product codes of vectors, encoded by equal-average search.

Vectors are cut into equal parts, and each part position has a codebook. By Cauchy and Schwarz the
squared gap between two component sums, over the dimension, is at most the squared distance. So
the entries of a codebook are sorted by component sum, and the search for a part starts at its own
sum and goes outward, the nearer sum first, until the squared gap over the dimension is strictly
greater than the best distance: nothing further out can be nearer, nor tie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import freed
from wayfold.llm.integers import finite, floored, padded
from wayfold.storage import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
ROWS_AT_ONCE = 2048
BROADCAST_LABELS = 50_000
SALTS = 64


class Codebooks:
    """Integer entries (parts, entries, width of a part) with their order by component sum."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        sums = self.entries.sum(axis=2)
        self.order = np.argsort(sums, axis=1, kind="stable")
        self.sums = np.take_along_axis(sums, self.order, axis=1)

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, parts) entry and squared distance of each part, ties to the lower entry, and the distances computed."""
        parts, n, width = self.entries.shape
        x = vectors.reshape(len(vectors) * parts, width)
        part = np.tile(np.arange(parts), len(vectors))
        sums = x.sum(axis=1)
        up = np.empty(len(x), np.int64)
        for p in range(parts):
            up[p::parts] = np.searchsorted(self.sums[p], sums[p::parts])
        down = up - 1
        far = np.iinfo(np.int64).max // (4 * max(1, width))
        best, code = np.full(len(x), far), np.full(len(x), n)
        live, seen = np.arange(len(x)), 0
        while len(live):
            p, lo, hi, s = part[live], down[live], up[live], sums[live]
            gap_lo = np.where(lo >= 0, s - self.sums[p, np.maximum(lo, 0)], far)
            gap_hi = np.where(hi < n, self.sums[p, np.minimum(hi, n - 1)] - s, far)
            below = gap_lo <= gap_hi
            gap = np.minimum(gap_lo, gap_hi)
            on = gap < far
            on[on] = gap[on] * gap[on] <= best[live[on]] * width
            live, p, below = live[on], p[on], below[on]
            at = np.where(below, down[live], up[live])
            entry = self.order[p, at]
            off = x[live] - self.entries[p, entry]
            d = (off * off).sum(axis=1)
            seen += len(live)
            nearer = (d < best[live]) | ((d == best[live]) & (entry < code[live]))
            best[live[nearer]], code[live[nearer]] = d[nearer], entry[nearer]
            down[live[below]] -= 1
            up[live[~below]] += 1
        return code.reshape(-1, parts), best.reshape(-1, parts), seen

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that (rows, parts) codes stand for."""
        return self.entries[np.arange(len(self.entries)), codes].reshape(len(codes), -1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def prepared(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, q of the rows whose vector takes part; q are whole numbers."""
    return rows.where(finite(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), floored(F.col(vector)).alias("q"))


def first_books(kept: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors under the least ids; of several under one id the least vector counts."""
    longest = kept.agg(F.max(F.size("q"))).first()[0]
    if longest is None:
        return None
    width = -(-max(1, longest) // parts) * parts
    chosen = (kept.where("vec_id is not null").groupBy("vec_id").agg(F.min("q").alias("q")).orderBy("vec_id").limit(entries)
              .select("vec_id", F.col("q").cast("array<long>").alias("q")).toArrow().sort_by("vec_id"))
    if not len(chosen):
        return None
    vectors = padded(chosen["q"].combine_chunks(), width)
    return Codebooks(vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2))


def improved(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: assign every part, then replace each used entry by the floored mean of its parts.

    A task sends one sum for each component of the codebooks, so what is shuffled and what reaches the driver is
    bounded by the size of the codebooks.
    """
    shared = kept.sparkSession.sparkContext.broadcast(books)

    @freed
    def totals(batches):
        book = shared.value
        parts, n, width = book.entries.shape
        sums, counts = np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                x = padded(batch.column("q").slice(a, ROWS_AT_ONCE), book.width)
                code, _, _ = book.nearest(x)
                slot = (code + np.arange(parts) * n).ravel()
                counts += np.bincount(slot, minlength=parts * n)
                cut = x.reshape(len(slot), width)
                for j in range(width):      # sums of a slice stay below 2**53 and are exact as doubles
                    sums[:, j] += np.bincount(slot, cut[:, j], parts * n).astype(np.int64)
        used = np.flatnonzero(counts)
        at = (used[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[used].ravel()), pa.array(np.repeat(counts[used], width))], ["at", "total", "n"])

    got = kept.select("q").mapInArrow(totals, "at long, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    new = books.entries.copy().ravel()
    new[got["at"].to_numpy()] = got["total"].to_numpy() // got["n"].to_numpy()
    return Codebooks(new.reshape(books.entries.shape))


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """Every row of ``kept`` (vec_id, label, q) with codes, one byte for each part, and error, its squared distance."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    label = kept.schema["label"].dataType.simpleString()

    @freed
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                code, off, _ = shared.value.nearest(padded(part.column("q"), shared.value.width))
                width = code.shape[1]
                flat = code.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([flat[i:i + width] for i in range(0, len(flat), width)], pa.binary()),
                                                  pa.array(off.sum(axis=1))], ["vec_id", "label", "codes", "error"])

    return kept.mapInArrow(run, f"vec_id long, label {label}, codes binary, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add the errors' sum over equal labels, nulls together: broadcast if labels are few, else joined on salts."""
    key = [F.col("label").isNull().alias("_none"), F.hash("label").alias("_hash"), F.col("label").alias("_label")]
    totals = written(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).select(*key, "label_error"), "label-errors")
    if totals.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(totals), coded["label"].eqNullSafe(totals["_label"])).drop("_none", "_hash", "_label")
    spread = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("_deal", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, dealt["label"].eqNullSafe(spread["_label"]) & (dealt["_deal"] == spread["_salt"])).drop("_none", "_hash", "_label", "_salt", "_deal")


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row whose vector takes part.

    Null vectors and vectors with null or non-finite components are left out. Components are whole numbers,
    floor(256 x), held within 2**20. The codebooks start from the ``entries`` least ids (fewer rows: fewer entries); null
    ids are coded but start no entry; of several vectors under one id the least starts it, and all rows are coded.
    Vectors shorter than the longest, or of a length that ``parts`` doesn't divide, end in zeros. Ties go to the lower
    entry; entries without parts stay. An empty table, or one without ids, gives no rows; other columns are ignored.
    A sum over a label beyond 64 bits is null. At most 256 entries, so that a code is two hex digits.
    """
    kept = written(prepared(rows, vec_id, vector, label), "whole-vectors")
    books = first_books(kept, parts, entries)
    if books is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    for _ in range(rounds):
        books = improved(kept, books)
    coded = with_label_error(written(encode(kept, books), "codes"))
    return coded.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
