"""Packing token sequences by best-fit decreasing.

Documents are tokenized where they are read; only the places of their pieces are shuffled, never
texts or ids. Overlong documents are cut into full windows first. What is left is packed in shards
of bounded size: longest first, each into the tightest open window, found in a segment tree over
remaining capacities.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import freed, slices
from wayfold.llm.tokens import text_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
END_ID = 1


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.at = [[] for _ in range(capacity + 1)]

    def put(self, left: int, window: int) -> None:
        self.at[left].append(window)
        i = self.width + left
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (remaining capacity, window) of the tightest window with room for ``need``."""
        count, i = self.count, self.width + need
        while not count[i]:             # up to the first node on the right that holds a window
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.width:           # down to its leftmost
            i = 2 * i if count[2 * i] else 2 * i + 1
        left = i - self.width
        while i:
            count[i] -= 1
            i >>= 1
        return left, self.at[left].pop()


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; ``order`` has the longest first."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, made = OpenWindows(capacity), 0
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        found = free.take(need) if need < capacity else None
        if found is None:
            found, made = (capacity, made), made + 1
        left, w = found
        window[i], offset[i] = w, capacity - left
        if left > need:
            free.put(left - need, w)
    return window, offset


def document_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048) -> DataFrame:
    """Full windows and the remainder of each document: its ids, then the end id. See ``PIECES``."""
    @freed
    def cut(batches):
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = text_ids(part.column("text"), path)
                ids, at = memoryview(np.ascontiguousarray(ids)).cast("B"), at.tolist()
                rows, start, length, crc, total = [], [], [], [], []
                for r, (a, b) in enumerate(zip(at, at[1:])):
                    n = b - a + 1
                    for s in range(0, n, capacity):
                        e = min(s + capacity, n)
                        value = zlib.crc32(ids[4 * (a + s):4 * (a + min(e, n - 1))])
                        rows.append(r)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(end, value) if e == n else value)
                        total.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                    NAMES[:5])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048,
         docs_per_shard: int = 20_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    A shard is one partition of a round-robin deal, about ``docs_per_shard`` documents' pieces of 40 bytes each,
    whatever the ids are; it packs by itself and so costs at most one half-empty window more. Null texts are
    empty and hold the end id alone. Null ids and repeated rows are packed like others. Ties are broken by
    (doc_id, start, checksum), so a lost task gives the same rows again. An empty table gives no rows.
    """
    shards = max(1, -(-docs.count() // docs_per_shard))

    @freed
    def fit(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        order = table.append_column("i", pa.array(np.arange(len(table)))).sort_by(
            [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window, offset = best_fit(table["length"].to_numpy(), order["i"].to_numpy(), capacity)
        window += TaskContext.get().partitionId() << 40
        out = table.append_column("sequence_id", pa.array(window)).append_column("offset", pa.array(offset))
        yield from out.combine_chunks().to_batches(max_chunksize=65_536)

    pieces = document_pieces(docs, path, doc_id, text, capacity)
    return pieces.repartition(shards).mapInArrow(fit, PIECES + ", sequence_id long, offset long")
