"""Paths that run alike: discrete Fréchet distance up to a limit, by filter and verify."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold import config as C
from wayfold.functions import geo
from wayfold.operators.windows import cut

c = F.col


def _ends(line: Column) -> list[Column]:
    """All coordinates of the first point's unit vector and two of the last point's."""
    first, last = line[0], F.element_at(line, -1)
    flat = lambda p: F.cos(F.radians(p["lat"]))
    return [flat(first) * F.cos(F.radians(first["lon"])), flat(first) * F.sin(F.radians(first["lon"])), F.sin(F.radians(first["lat"])),
            flat(last) * F.sin(F.radians(last["lon"])), F.sin(F.radians(last["lat"]))]


def path_candidates(paths: DataFrame, limit_nm: float) -> DataFrame:
    """(id, id2), id < id2, that ends and latitudes do not keep apart; no pair within the limit is left out.

    ``paths``: id, centerline. Alike paths begin and end within the limit of each other, so those coordinates differ by no
    more than its chord. They meet in cells four times as wide: one side stands in its own cell, the other in all cells that
    its ends can reach, 8 on average and 32 at most. Lines stay out of this join, only their ends and extents take part.
    """
    reach = limit_nm / C.EARTH_NM * (1 + 1e-9)
    edge = 4 * reach
    lats = F.transform("centerline", lambda p: p["lat"])
    keys = paths.where(F.size("centerline") > 0).select("id", c("centerline")[0].alias("a"), F.element_at("centerline", -1).alias("z"),
                                                        F.array_min(lats).alias("south"), F.array_max(lats).alias("north"),
                                                        *[v.alias(f"_e{i}") for i, v in enumerate(_ends(c("centerline")))])
    keys = cut(keys.where(" and ".join(f"_e{i} is not null" for i in range(5))))
    cells = [f"_k{i}" for i in range(5)]
    own = keys.withColumns({k: F.floor(c(f"_e{i}") / edge) for i, k in enumerate(cells)}).drop(*[f"_e{i}" for i in range(5)])
    other = keys.select(*[c(x).alias(f"{x}2") for x in ("id", "a", "z", "south", "north")], *[f"_e{i}" for i in range(5)])
    for i, k in enumerate(cells):
        other = other.withColumn(k, F.explode(F.sequence(F.floor((c(f"_e{i}") - reach) / edge), F.floor((c(f"_e{i}") + reach) / edge)))).drop(f"_e{i}")
    near = lambda p: geo.haversine(c(p)["lat"], c(p)["lon"], c(f"{p}2")["lat"], c(f"{p}2")["lon"]) <= limit_nm * (1 + 1e-9)
    degrees = math.degrees(reach)
    alike = (F.abs(c("south") - c("south2")) <= degrees) & (F.abs(c("north") - c("north2")) <= degrees)
    return own.join(other, cells).where((c("id") < c("id2")) & alike & near("a") & near("z")).select("id", "id2")


def similar_paths(paths: DataFrame, limit_nm: float) -> DataFrame:
    """(id, id2, nm) of all pairs of paths at most ``limit_nm`` apart by discrete Fréchet distance, id < id2.

    Ids are unique. Paths that are null, empty or begin or end without a position take no part.
    """
    lines = cut(paths.select("id", "centerline"))
    pairs = cut(path_candidates(lines, limit_nm))
    j = pairs.join(lines, "id").join(lines.select(c("id").alias("id2"), c("centerline").alias("line2")), "id2")
    return j.select("id", "id2", geo.frechet_nm("centerline", "line2", limit_nm).alias("nm")).where(c("nm") <= limit_nm)
