"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table with the lengths of frequent pieces (white-space separated
pre-tokens), read with Arrow's hash lookup. Tier two, for misses, is the worker's own cache
before the library. The corpus itself is never shuffled. The table only saves time: it is
counted on a sample of at most about ``sample_docs`` documents and holds at most ``table_size``
pieces, and no result depends on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import freed, slices, strings
from wayfold.llm.tokens import Encoder, chunks, encoder


def frequent_pieces(docs: DataFrame, text: str = "text", sample_docs: int = 4096, table_size: int = 65_536) -> list[str]:
    """The most frequent pieces of a bounded sample; only the sample's own counts are shuffled."""
    rows = docs.count()
    sample = docs.select(F.col(text).alias("text"))
    if rows > sample_docs:
        sample = sample.sample(fraction=sample_docs / rows, seed=11)

    @freed
    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                names, codes, _ = chunks(part.column("text"))
                n = np.bincount(codes, minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(n)], ["piece", "n"])

    counts = sample.mapInArrow(count, "piece string, n long").where("length(piece) between 1 and 64")
    top = counts.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_size)
    return [r.piece for r in top.select("piece").collect()]


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048,
                 sample_docs: int = 4096, table_size: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    ``path``: a tokenizer file of the ``tokenizers`` library that drops white space, present on every executor.
    Null and empty texts have no bytes and no tokens. Null ids and repeated rows stay as they are, one row each;
    other columns are ignored. An empty table gives no rows.
    """
    pieces = frequent_pieces(docs, text, sample_docs, table_size)
    lengths = np.fromiter((len(x) // 4 for x in Encoder(path).ids(pieces)), np.int32, len(pieces))
    table = docs.sparkSession.sparkContext.broadcast((pieces, lengths))

    @freed
    def count(batches):
        known, size = table.value
        known = pa.array(known, pa.string())
        cache = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column("text")
                names, codes, offsets = chunks(column)
                place = pc.index_in(names, value_set=known)
                missed = pc.is_null(place).to_numpy(zero_copy_only=False)
                n = np.zeros(len(names), np.int64)
                n[~missed] = size[place.drop_null().to_numpy()]
                rest = list(strings(names.filter(pa.array(missed))))
                n[missed] = np.fromiter(map(len, cache.ids(rest)), np.int64, len(rest)) // 4
                sums = np.concatenate([[0], np.cumsum(n[codes])])
                tokens = np.diff(sums[offsets])
                width = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), width, pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
