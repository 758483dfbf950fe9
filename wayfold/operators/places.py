"""Nearest place for dimensions of any size: a tree of cells, searched from the root by bounds.

A node is a cell of places; cells of one level nest in those of the level above. A node carries the box of its places'
unit vectors, which bounds their distance from below, and one of the places, whose distance bounds the nearest from
above. A position keeps the nodes that its least upper bound does not rule out. Nothing is gathered: nodes, places and
positions meet in equi joins, and bounds are least values per position, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.windows import cut

c = F.col

# Cell edges in millionths of a degree; each divides the one before.
LEVELS = (60_000_000, 15_000_000, 3_000_000, 600_000, 120_000, 24_000)
LEAF = 16           # a node of so few places is not opened further
AXES = ("x", "y", "z")


def _cell(edge: int, lat: str = "lat", lon: str = "lon") -> Column:
    """Number of the cell of a position; the longitude is taken modulo 360."""
    number = lambda degrees: F.floor(F.floor(degrees * 1e6) / edge).cast("bigint")
    return number(c(lat) + 90.0) * 1_000_000 + number(F.pmod(c(lon) + 180.0, F.lit(360.0)))


def _with_vectors(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    la, lo = F.radians(lat), F.radians(lon)
    return df.withColumns({"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)})


def _square(of) -> Column:
    return sum((of(a) * of(a) for a in AXES[1:]), of(AXES[0]) * of(AXES[0])) / 4      # the scale of geo.half_chord


def _bounds() -> tuple[Column, Column]:
    """Least possible and one real half chord from a position (x, y, z) to the places of a node."""
    low = _square(lambda a: F.greatest(F.lit(0.0), c(f"lo_{a}") - c(a), c(a) - c(f"hi_{a}")))
    return low, _square(lambda a: c(f"at_{a}") - c(a))


def nodes(places: DataFrame, level: int) -> DataFrame:
    """(node, parent, places, box, one place) of a level; ``places``: lat, lon, x, y, z, ord."""
    up = _cell(LEVELS[level - 1]) if level else F.lit(0).cast("bigint")
    first = F.min(F.struct("ord", *AXES)).alias("_at")
    box = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    return (places.groupBy(_cell(LEVELS[level]).alias("node"), up.alias("parent")).agg(F.count("*").alias("places"), first, *box)
            .withColumns({f"at_{a}": c("_at")[a] for a in AXES}).drop("_at"))


def nearest_place(positions: DataFrame, places: DataFrame) -> DataFrame:
    """(lat, lon, best) for each distinct position, best = (a, ord, code, elev, lat, lon), ties by ``ord``.

    ``places``: ord, code, elev, lat, lon. Rows without a position take no part on either side; without places there
    are no rows. Equal places count once, under their least ``ord``.
    """
    known = lambda df: df.where("lat is not null and lon is not null")
    dim = known(places).groupBy("lat", "lon").agg(F.min(F.struct("ord", "code", "elev")).alias("p")).select("lat", "lon", "p.*")
    dim = cut(_with_vectors(dim))
    live = _with_vectors(known(positions).select("lat", "lon").distinct()).withColumn("best", F.lit(float("inf")))
    ready = []
    for level in range(len(LEVELS)):
        tree = nodes(dim, level)
        if level == 0:      # 24 cells at most cover the globe
            root = [F.struct(*[F.lit(r[n]).alias(n) for n in tree.columns]) for r in tree.collect()]
            if not root:
                return live.select("lat", "lon", F.lit(None).cast("struct<a:double,ord:int,code:string,elev:int,lat:double,lon:double>").alias("best")).limit(0)
            met = live.withColumn("n", F.explode(F.array(*root))).select("lat", "lon", *AXES, "best", "n.*")
        else:
            met = live.withColumnRenamed("node", "parent").join(tree, "parent")
        low, real = _bounds()
        met = met.withColumns({"low": low, "real": real}).select("lat", "lon", *AXES, "best", "node", "places", "low", "real")
        least = met.groupBy("lat", "lon").agg(F.least(F.min("best"), F.min("real")).alias("best"))
        left = met.drop("best", "real").join(least, ["lat", "lon"]).where(_may_hold())
        left = cut(left)
        done = (c("places") <= LEAF) if level + 1 < len(LEVELS) else F.lit(True)
        ready.append(left.where(done).withColumn("level", F.lit(level)).select("lat", "lon", "level", "node", "low", "best"))
        live = left.where(~done).select("lat", "lon", *AXES, "best", "node")
        if not live.limit(1).count():
            break
    leaves = ready[0]
    for r in ready[1:]:
        leaves = leaves.unionByName(r)
    # A leaf found early is held against the bounds found later.
    least = leaves.groupBy("lat", "lon").agg(F.min("best").alias("best"))
    leaves = leaves.drop("best").join(least, ["lat", "lon"]).where(_may_hold()).select("lat", "lon", "level", "node")
    listed = dim.select(F.posexplode(F.array(*[_cell(e) for e in LEVELS[:len(ready)]])).alias("level", "node"),
                        "ord", "code", "elev", c("lat").alias("plat"), c("lon").alias("plon"))
    at = F.struct(geo.half_chord("lat", "lon", c("plat"), c("plon")).alias("a"), "ord", "code", "elev", c("plat").alias("lat"), c("plon").alias("lon"))
    return leaves.join(listed, ["level", "node"]).groupBy("lat", "lon").agg(F.min(at).alias("best"))


def _may_hold() -> Column:
    """The node may hold the nearest place; the margin is beyond the rounding of unit vectors."""
    return c("low") * (1 - 1e-9) - 1e-15 <= c("best")
