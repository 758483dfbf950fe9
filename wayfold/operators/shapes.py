"""Points against rings and polylines, in numpy inside tasks.

Rows carry their own ring or line; those of one length are a matrix. ``in_ring`` and ``measured`` take sums, products, quotients
and roots alone, in the order of ``geo.point_in_ring`` and ``geo.polyline_distance``, so results are theirs to the last bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wayfold import config as C

c = F.col
CELLS = 1 << 20         # numbers of a matrix


def _matrices(table: pa.RecordBatch, name: str):
    """(row numbers, latitudes, longitudes) of rows with equally many vertices, one row a line."""
    lists = table.column(name)
    count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lat, lon = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
    first = np.cumsum(count) - count
    for n in np.unique(count):
        rows = np.flatnonzero(count == n)
        step = max(1, CELLS // max(1, int(n)))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            which = first[some][:, None] + np.arange(n)
            yield some, lat[which], lon[which]


def in_ring(rows: DataFrame, ring: str = "ring") -> DataFrame:
    """Rows whose lat and lon are inside their ring, by ``geo.point_in_ring``, without the ring."""
    left = [f for f in rows.schema.fields if f.name != ring]
    pair = F.transform(ring, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))

    def run(batches):
        for b in batches:
            x_, y_ = (b.column(k).to_numpy(zero_copy_only=False) for k in ("lat", "lon"))
            inside = np.zeros(b.num_rows, bool)
            for at, px, py in _matrices(b, ring):
                if px.shape[1] < 3:
                    continue
                qx, qy = np.roll(px, -1, 1), np.roll(py, -1, 1)
                x, y = x_[at][:, None], y_[at][:, None]
                with np.errstate(all="ignore"):
                    cross = ((y > np.minimum(py, qy)) & (y <= np.maximum(py, qy)) & (x <= np.maximum(px, qx)) & (py != qy)
                             & ((px == qx) | (x <= (y - py) * (qx - px) / (qy - py) + px)))
                inside[at] = cross.sum(1) % 2 == 1
            yield b.select([f.name for f in left]).filter(pa.array(inside))

    return rows.withColumn(ring, pair).select(*[f.name for f in left], ring).mapInArrow(run, StructType(left))


def measured(rows: DataFrame, line: str = "centerline") -> DataFrame:
    """Rows with ``d`` and ``pos`` of ``geo.polyline_distance`` to their line, without the line; null for lines of one vertex."""
    left = [f for f in rows.schema.fields if f.name != line]
    pair = F.transform(line, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))

    def run(batches):
        for b in batches:
            lat, lon, scale = (b.column(k).to_numpy(zero_copy_only=False) for k in ("lat", "lon", "_scale_of"))
            d, pos = np.full(b.num_rows, np.nan), np.full(b.num_rows, np.nan)
            for at, y, x in _matrices(b, line):
                if y.shape[1] < 2:
                    continue
                k = scale[at][:, None]
                py, px = (lat[at] * 60.0)[:, None], lon[at][:, None] * 60.0 * k
                ay, ax = y[:, :-1] * 60.0, x[:, :-1] * 60.0 * k
                dy, dx = (y[:, 1:] - y[:, :-1]) * 60.0, (x[:, 1:] - x[:, :-1]) * 60.0 * k
                len2 = dy * dy + dx * dx
                with np.errstate(all="ignore"):
                    t = np.where(len2 == 0, 0.0, np.maximum(0.0, np.minimum(1.0, ((py - ay) * dy + (px - ax) * dx) / len2)))
                ey, ex = py - (ay + t * dy), px - (ax + t * dx)
                far, long = np.sqrt(ey * ey + ex * ex), np.sqrt(len2)
                best = np.argmin(np.where(np.isnan(far), np.inf, far), 1)[:, None]
                walked = np.cumsum(long, 1)
                take = lambda m: np.take_along_axis(m, best, 1)[:, 0]
                whole = walked[:, -1]
                before = np.where(best[:, 0] > 0, np.take_along_axis(walked, np.maximum(best - 1, 0), 1)[:, 0], 0.0)
                d[at] = take(far)
                pos[at] = (before + take(t) * take(long)) / np.where(whole == 0, 1.0, whole)
            names = [f.name for f in left]
            number = lambda v: pa.array(v, mask=np.isnan(v))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), number(d), number(pos)], [*names, "d", "pos"])

    out = StructType([*left, StructField("d", DoubleType()), StructField("pos", DoubleType())])
    scaled = rows.withColumn(line, pair).withColumn("_scale_of", F.cos(F.radians(F.try_element_at(line, F.lit(1))["lat"])))
    return scaled.select(*[f.name for f in left], line, "_scale_of").mapInArrow(run, out)


def near_side(rows: DataFrame, nm: float) -> DataFrame:
    """Rows whose lat and lon are within nm of the side from p to q, taken at its ends and nine points between, without the side."""
    left = [f for f in rows.schema.fields if f.name not in ("p", "q")]
    ends = [c(f"{e}.{x}").alias(f"_{e}{x}") for e in "pq" for x in ("lat", "lon")]

    def run(batches):
        for b in batches:
            lat, lon, py, px, qy, qx = (b.column(k).to_numpy(zero_copy_only=False) for k in ("lat", "lon", "_plat", "_plon", "_qlat", "_qlon"))
            least, y, cosine = np.full(b.num_rows, np.inf), np.radians(lat), np.cos(np.radians(lat))
            for i in range(11):
                sy, sx = np.radians(py + i / 10 * (qy - py)), np.radians(px + i / 10 * (qx - px))
                s1, s2 = np.sin((sy - y) / 2.0), np.sin((sx - np.radians(lon)) / 2.0)
                least = np.fmin(least, s1 * s1 + cosine * np.cos(sy) * s2 * s2)
            far = 2.0 * C.EARTH_NM * np.arctan2(np.sqrt(least), np.sqrt(np.maximum(1.0 - least, 0.0)))
            yield b.select([f.name for f in left]).filter(pa.array(far <= nm))

    return rows.select(*[f.name for f in left], *ends).mapInArrow(run, StructType(left))
