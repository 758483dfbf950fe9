"""Nearest polyline of a layer for each point, through cells of its segments.

The distance is that of ``geo.polyline_distance``: flat, with the longitude scaled by the cosine of the line's first
vertex. Lines of about the same scale form a class (scale within a factor of two), and cells of a class are as many times
wider in longitude, so that whatever lies beyond the neighbouring cells is further than one cell height for sure.

Points near a line find it in their own cell, where lines are listed with a margin. The others go down a tree of the same
cells: a node has the box of its pieces, which bounds the distance from below, and one point on a line, which bounds the
nearest from above. All of it is equi joins; no point meets a whole layer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.hotkeys import hot_keys, join_dealt, join_hot, spread
from wayfold.operators.shapes import measured
from wayfold.operators.windows import cut

c = F.col

LEAF = 0.25                 # cell height in degrees
NEAR = (LEAF, 4 * LEAF)     # heights of the cells that list lines with a margin
DEPTH = 5                   # levels above the leaves, each four times as high; the top is 256 degrees
FLATTEST = 6                # classes beyond this scale (2 ** -6, latitudes above 89) count as one
CELL = ["_class", "_y", "_x"]


def _lines(paths: DataFrame) -> DataFrame:
    """Lines of two or more positions with their scale and class: scale in (2 ** -(class + 1), 2 ** -class]."""
    off = lambda p: p["lat"].isNull() | p["lon"].isNull() | (F.abs(p["lat"]) > 90) | (F.abs(p["lon"]) > 360)
    ok = paths.where((F.size("centerline") >= 2) & ~F.exists("centerline", off))
    ok = ok.withColumn("_scale", F.cos(F.radians(c("centerline")[0]["lat"])))
    steep = F.when(c("_scale") > 0, F.floor(-F.log2("_scale") + 1e-12)).otherwise(FLATTEST)
    return ok.withColumn("_class", F.least(F.greatest(steep, F.lit(0)), F.lit(FLATTEST)).cast("int"))


def _width(height: float) -> Column:
    """Cell width by class; the last class has scales down to zero, so its cells don't tell longitudes apart."""
    return F.when(c("_class") < FLATTEST, F.lit(height) * F.pow(F.lit(2.0), c("_class") + 1)).otherwise(F.lit(1e6))


def _pieces(lines: DataFrame, height: float, margin: int) -> DataFrame:
    """Cells (with ``margin`` cells around) of pieces of segments no longer than a cell: CELL, id, box, scale, one end.

    A long oblique segment lists the cells along it and not those of its whole box.
    """
    ends = F.arrays_zip(F.slice("centerline", 1, F.size("centerline") - 1).alias("p"), F.slice("centerline", 2, F.size("centerline") - 1).alias("q"))
    s = lines.select("id", "_class", "_scale", F.explode(ends).alias("e")).select("id", "_class", "_scale", "e.p", "e.q")
    n = F.greatest(F.ceil(F.abs(c("p.lat") - c("q.lat")) / height), F.ceil(F.abs(c("p.lon") - c("q.lon")) / _width(height)), F.lit(1)).cast("int")
    s = s.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), c("_n") - 1)))
    at = lambda x, i: c(f"p.{x}") + (c(f"q.{x}") - c(f"p.{x}")) * (i / c("_n"))
    s = s.withColumns({f"_{k}{x}": at(x, c("_i") + i) for x in ("lat", "lon") for k, i in (("a", 0), ("b", 1))})
    box = {f"_{k}{x}": f(f"_a{x}", f"_b{x}") for x in ("lat", "lon") for k, f in (("lo", F.least), ("hi", F.greatest))}
    s = s.withColumns(box)
    span = lambda x, size: F.sequence(F.floor(c(f"_lo{x}") / size - 1e-9) - margin, F.floor(c(f"_hi{x}") / size + 1e-9) + margin)
    return (s.withColumn("_y", F.explode(span("lat", F.lit(height)))).withColumn("_x", F.explode(span("lon", _width(height))))
            .select(*CELL, "id", "_scale", "_lolat", "_hilat", "_lolon", "_hilon", "_alat", "_alon"))


def _nearest(pairs: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Least (d, id, width_nm, pos) of (keys, lat, lon, id) pairs."""
    pairs = cut(pairs)
    m = measured(join_dealt(spread(pairs, keys), lines.select("id", "centerline", "width_nm"), ["id"], hot_keys(pairs, ["id"])))
    best = F.min(F.struct("d", "id", "width_nm", "pos")).alias("b")
    return m.groupBy(*keys).agg(best).select(*keys, "b.*")


def nearest_line(points: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and (d, id, width_nm, pos) of the nearest path in nautical miles, ties to the smaller id.

    ``points``: keys (unique), lat, lon; ``paths``: id (unique), centerline, width_nm. Points without a position and lines
    of fewer than two vertices, or with a vertex that is no position, take no part; without lines there are no rows.
    """
    lines = cut(_lines(paths.select("id", "centerline", "width_nm")))
    classes = sorted(r[0] for r in lines.select("_class").distinct().collect())     # seven at most
    left = points.select(*keys, "lat", "lon").where("lat is not null and lon is not null")
    if not classes:
        return _nearest(left.withColumn("id", F.lit(None).cast("string")).limit(0), lines, keys)
    every = F.explode(F.array(*[F.lit(k) for k in classes]))
    done = []
    for height in NEAR:
        asked = left.withColumn("_class", every).withColumns({"_y": F.floor(c("lat") / height), "_x": F.floor(c("lon") / _width(height))})
        listed = cut(_pieces(lines, height, 1).select(*CELL, "id").distinct())
        near = _nearest(join_hot(asked, listed, CELL).select(*keys, "lat", "lon", "id"), lines, keys)
        done.append(cut(near.where(c("d") <= 60 * height * (1 - 1e-9))))
        left = cut(left.join(done[-1].select(*keys), keys, "left_anti"))
        if not left.limit(1).count():
            break
    else:
        done.append(_far(left, lines, keys))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def nodes(pieces: DataFrame) -> list[DataFrame]:
    """Levels of the tree from the top: CELL, parent cell (_py, _px), box, least scale, one point on a line."""
    level = pieces.withColumn("_at", F.struct("_alat", "_alon", "_scale"))
    out = []
    for _ in range(DEPTH + 1):
        level = cut(level.groupBy(*CELL).agg(F.min("_lolat").alias("_lolat"), F.max("_hilat").alias("_hilat"), F.min("_lolon").alias("_lolon"),
                                             F.max("_hilon").alias("_hilon"), F.min("_scale").alias("_scale"), F.min("_at").alias("_at")))
        out.append(level.withColumns({"_py": F.floor(c("_y") / 4), "_px": F.floor(c("_x") / 4)}))
        level = out[-1].withColumns({"_y": c("_py"), "_x": c("_px")})
    return out[::-1]


def _far(points: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest lines of points by the tree: a point keeps the nodes that its least upper bound does not rule out."""
    pieces = cut(_pieces(lines, LEAF, 0))
    tree = nodes(pieces)
    # The top cells are 256 degrees high: few of each class.
    top = [F.struct(*[F.lit(r[n]).alias(n) for n in CELL]) for r in tree[0].select(*CELL).collect()]
    live = points.withColumn("n", F.explode(F.array(*top))).select(*keys, "lat", "lon", *[c(f"n.{x}").alias(x) for x in CELL])
    gap = lambda x: F.greatest(F.lit(0.0), c(f"_lo{x}") - c(x), c(x) - c(f"_hi{x}"))
    flat = lambda dlat, dlon, k: 60.0 * F.sqrt(dlat * dlat + dlon * dlon * k * k)
    own = Window.partitionBy(*keys)
    for i, level in enumerate(tree):
        if i == 0:
            met = live.join(F.broadcast(level.drop("_py", "_px")), CELL)
        else:
            up = live.withColumnsRenamed({"_y": "_py", "_x": "_px"})
            met = join_hot(up, level, ["_class", "_py", "_px"])
        low = flat(gap("lat"), gap("lon"), F.greatest(c("_scale"), F.lit(0.0)))
        real = flat(c("lat") - c("_at._alat"), c("lon") - c("_at._alon"), c("_at._scale"))
        met = met.select(*keys, "lat", "lon", *CELL, low.alias("_low"), real.alias("_real"))
        kept = met.withColumn("_best", F.min("_real").over(own)).where(c("_low") * (1 - 1e-9) - 1e-9 <= c("_best"))
        live = cut(kept.select(*keys, "lat", "lon", *CELL))
    pairs = join_hot(live, pieces.select(*CELL, "id").distinct(), CELL).select(*keys, "lat", "lon", "id").distinct()
    return _nearest(pairs, lines, keys)
