"""Principal components of many groups of vectors at once.

Every partition sums its rows to one row for each group: their number, mean, and the products of the deviations from it.
Such sums merge in two levels, first those of a bundle of partitions, then the bundles, so a group task holds few of them
however many rows a group has. Each merged row yields its components; the products of one group take ``width**2`` numbers.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.windows import cut

c = F.col
BUNDLE = 64         # partitions whose sums merge first
MOMENTS = "part int, n bigint, mean array<double>, products array<double>"


def merged(sums: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Number, mean and products of deviations of the union of disjoint sets of rows."""
    total = None
    for n, mean, products in sums:
        if total is None:
            total = n, mean, products
            continue
        m, at, p = total
        d = mean - at
        total = n + m, at + d * (n / (n + m)), p + products + np.outer(d, d) * (n * m / (n + m))
    return total


def _of_rows(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    d = x - mean
    return len(x), mean, d.T @ d


def _matrix(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an array column; all arrays have one length."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return np.asarray(values.flatten(), dtype="float64").reshape(len(values), -1)


def _row(group, part: int, total, kind: pa.DataType, name: str) -> pa.RecordBatch:
    n, mean, products = total
    double = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array([group], kind), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([mean], double), pa.array([products.ravel()], double)],
        [name, "part", "n", "mean", "products"])


def moments(vectors: DataFrame, group: str, values: str = "x") -> DataFrame:
    """(group, n, mean, products) by group. Rows without a vector are left out; vectors are arrays of one length."""
    kind = vectors.schema[group].dataType.simpleString()
    schema = f"`{group}` {kind}, {MOMENTS}"
    rows = vectors.where(c(values).isNotNull()).select(group, c(values).cast("array<double>").alias("x"), F.spark_partition_id().alias("part"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, arrow = {}, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            arrow, part = b.schema.field(group).type, b.column("part")[0].as_py()
            keys = b.column(group).dictionary_encode()
            codes = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
            x = _matrix(b.column("x"))
            for code in np.unique(codes):
                key = keys.dictionary[int(code)].as_py() if code < len(keys.dictionary) else None
                held[key] = merged([held[key], _of_rows(x[codes == code])] if key in held else [_of_rows(x[codes == code])])
        for key, total in held.items():
            yield _row(key, part, total, arrow, group)

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")       # one order of additions, whatever arrives first
        mean = _matrix(t["mean"])
        products = _matrix(t["products"]).reshape(len(mean), mean.shape[1], -1)
        total = merged(zip(t["n"].to_pylist(), mean, products))
        return pa.Table.from_batches([_row(t[group][0].as_py(), t["part"][0].as_py(), total, t.schema.field(group).type, group)])

    first = rows.mapInArrow(sums, schema).withColumn("_bundle", F.floor(c("part") / BUNDLE))
    second = first.groupBy(group, "_bundle").applyInArrow(lambda t: join(t.drop_columns(["_bundle"])), schema)
    return second.groupBy(group).applyInArrow(join, schema).drop("part")


def components(sums: DataFrame, group: str, dims: int) -> DataFrame:
    """(group, n, axes): the ``dims`` leading components, each an array, the greatest spread first.

    Directions only: the sign of a component is that which makes its largest part positive.
    """
    kind = sums.schema[group].dataType.simpleString()

    def axes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for one in range(b.num_rows):
                p = _matrix(b.column("products").slice(one, 1))
                width = int(np.sqrt(p.size))
                _, v = np.linalg.eigh(p.reshape(width, width))
                v = v[:, ::-1][:, :dims].T
                lead = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)
                out.append((v * np.where(lead < 0, -1.0, 1.0)).tolist())
            yield pa.RecordBatch.from_arrays([b.column(group), b.column("n"), pa.array(out, pa.list_(pa.list_(pa.float64())))], [group, "n", "axes"])

    return sums.select(group, "n", "products").mapInArrow(axes, f"`{group}` {kind}, n bigint, axes array<array<double>>")


def models(vectors: DataFrame, group: str, dims: int, values: str = "x", least: int = 2) -> DataFrame:
    """(group, axes) for every group; one with fewer rows than ``least`` gets the components over all rows."""
    sums = cut(moments(vectors, group, values))
    own = components(sums, group, dims)
    if not sums.where(c("n") < least).limit(1).count():
        return own.select(group, "axes")
    # The sums of the groups, not their rows, merge to those of all.
    every = components(moments_of_all(sums, group), "_all", dims).select("_all", c("axes").alias("_axes"))
    both = own.withColumn("_all", F.lit(0)).join(F.broadcast(every), "_all")        # one row
    return both.select(group, F.when(c("n") < least, c("_axes")).otherwise(c("axes")).alias("axes"))


def moments_of_all(sums: DataFrame, group: str) -> DataFrame:
    """One row over all groups, under the key 0 of column ``_all``."""
    def join(t: pa.Table) -> pa.Table:
        mean = _matrix(t["mean"])
        products = _matrix(t["products"]).reshape(len(mean), mean.shape[1], -1)
        total = merged(zip(t["n"].to_pylist(), mean, products))
        return pa.Table.from_batches([_row(0, 0, total, pa.int32(), "_all")])

    schema = f"_all int, {MOMENTS}"
    bundled = sums.withColumn("_bundle", F.pmod(F.xxhash64(group), F.lit(BUNDLE)))
    first = bundled.groupBy("_bundle").applyInArrow(join, schema)
    return first.groupBy("_all").applyInArrow(join, schema).drop("part")
