"""Interference zones: chained cells, wide chains split by one k-means over all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.clusters import hulls, planar_clusters
from wayfold.operators.nearest import bounded_broadcast
from wayfold.operators.windows import cut, sliced_row_number

c = F.col
UNIT = 1_000_000        # positions and centres of the split count in millionths of a degree, so sums are exact


def chains(cells: DataFrame, merge_nm: float = 25.0, max_radius_nm: float = 100.0, min_events: int = 3) -> tuple[DataFrame, DataFrame]:
    """Cells with their ``component``, and (component, cells, span_deg, parts) of every component of ``min_events`` cells.

    One wider than twice the radius is to be split into span / radius ``parts``, at least 2, each with room for
    ``min_events`` cells; where there is no such room it stays whole (parts 1). The globe holds parts to 360 / radius.
    """
    labelled = cut(planar_clusters(cells, merge_nm / 60.0))
    reach = max_radius_nm / 60.0
    span = F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon"))
    sizes = labelled.groupBy("component").agg(F.count("*").alias("cells"), span.alias("span_deg"), (F.max("lat") - F.min("lat") >= F.max("lon") - F.min("lon")).alias("tall"),
                                              F.min("lat").alias("south"), F.min("lon").alias("west")).where(c("cells") >= min_events)
    room = F.floor(c("cells") / min_events)
    parts = F.when((c("span_deg") > 2 * reach) & (room >= 2), F.least(room, F.greatest(F.lit(2), F.floor(c("span_deg") / reach)))).otherwise(1)
    return labelled, cut(sizes.withColumn("parts", parts.cast("int")))


def keyed_kmeans(points: DataFrame, sizes: DataFrame, rounds: int = 10) -> DataFrame:
    """Add ``part`` to points (component, lat, lon, ...) of the components in ``sizes`` with more than one part.

    All components take each round together. The first centres are the cells at the middle of equal shares of a component,
    along its longer side. A cell goes to the nearest centre, ties to the lower number; a centre moves to the mean of its
    cells, rounded down, and stays where it has none. Ends after ``rounds`` rounds or when no centre moved.
    """
    wide = sizes.where("parts > 1").select("component", "cells", "parts", "tall", "south", "west", "span_deg")
    at = points.join(bounded_broadcast(wide), "component").withColumns({"_y": F.round(c("lat") * UNIT).cast("bigint"), "_x": F.round(c("lon") * UNIT).cast("bigint")})
    along = F.when(c("tall"), c("lat")).otherwise(c("lon"))
    at = at.withColumn("_along", along).withColumn("_sl", F.floor((along - F.when(c("tall"), c("south")).otherwise(c("west"))) / c("span_deg") * 256))
    at = cut(at.drop("south", "west", "span_deg", "tall"))
    if not at.limit(1).count():
        return points.limit(0).withColumn("part", F.lit(0))
    ranked = sliced_row_number(at.select("component", "cells", "parts", "_y", "_x", "_along", "_sl"), "component", "_sl", ["_along", "_y", "_x"], "_n")
    # Rank r starts part i where r is the middle of share i: floor((2 i + 1) cells / (2 parts)) + 1.
    i = F.floor(((c("_n") - 1) * 2 * c("parts") / c("cells") - 1) / 2)
    near = F.explode(F.array(i, i + 1))
    middle = ranked.withColumn("part", near).where((c("part") >= 0) & (c("part") < c("parts")) & (F.floor((2 * c("part") + 1) * c("cells") / (2 * c("parts"))) + 1 == c("_n")))
    centres = cut(middle.select("component", c("part").cast("int").alias("part"), "_y", "_x"))
    at = at.drop("_along", "_sl", "cells", "parts")
    for _ in range(rounds):
        new = _assigned(at, centres).groupBy("component", "part").agg(*[F.floor(F.sum(a) / F.count("*")).alias(f"{a}n") for a in ("_y", "_x")])
        moved = cut(centres.join(new, ["component", "part"], "left"))
        centres = moved.select("component", "part", F.coalesce("_yn", "_y").alias("_y"), F.coalesce("_xn", "_x").alias("_x"))
        if not moved.where("_yn <> _y or _xn <> _x").limit(1).count():
            break
    return _assigned(at, centres).drop("_y", "_x")


def _assigned(at: DataFrame, centres: DataFrame) -> DataFrame:
    """``at`` with the number of the nearest centre of its component; a component has few centres."""
    held = centres.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("part", c("_y").alias("y"), c("_x").alias("x")))).alias("_c"))
    far = lambda p: (p["y"] - c("_y")) * (p["y"] - c("_y")) + (p["x"] - c("_x")) * (p["x"] - c("_x"))
    best = F.array_min(F.transform("_c", lambda p: F.struct(far(p).alias("d"), p["part"].alias("part"))))
    return at.join(bounded_broadcast(held), "component").withColumn("part", best["part"]).drop("_c")


def interference_zones(cells: DataFrame, buffer_nm: float = 15.0, min_events: int = 3, merge_nm: float = 25.0, max_radius_nm: float = 100.0,
                       max_buffer_nm: float = 30.0) -> DataFrame:
    """Zones of interference cells (as of ``spatial.interference_components``): totals, type, leading confidence, outline and area.

    Chains of fewer cells than ``min_events`` are no zones, nor are parts of a split with fewer. The outline is the hull of
    the cells pushed out from their mean by the buffer, which grows with the score; a line or a pair gets a circle.
    """
    labelled, sizes = chains(cells, merge_nm, max_radius_nm, min_events)
    whole = labelled.join(sizes.where("parts = 1").select("component"), "component", "left_semi").withColumn("part", F.lit(0))
    z = cut(whole.unionByName(keyed_kmeans(labelled, sizes)).withColumn("zone", F.concat_ws("/", "component", "part")))
    ranks = F.create_map(*[F.lit(v) for kv in {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNLIKELY": 0}.items() for v in kv])
    said = z.groupBy("zone", "confidence").agg(F.count("*").alias("n")).groupBy("zone").agg(F.max(F.struct("n", ranks[c("confidence")].alias("r"), "confidence"))["confidence"].alias("confidence"))
    sums = ("event_count", "affected_flights", "altitude_jumps", "position_teleports", "impossible_turns", "mlat_only_flights")
    s = (z.groupBy("zone").agg(F.count("*").alias("cells"), *[F.sum(x).alias(x) for x in sums], F.avg("score").alias("_score"), F.avg("lat").alias("lat"),
                               F.avg("lon").alias("lon"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
         .where(c("cells") >= min_events).withColumn("_buf", F.least(F.lit(max_buffer_nm), buffer_nm * (1 + c("_score") / 200))))
    j = s.join(said, "zone").join(hulls(z.join(s.select("zone"), "zone", "left_semi"), "zone"), "zone", "left")
    lat, lon, buf = c("lat"), c("lon"), c("_buf") / 60

    def push(p):
        d = F.hypot(p["lat"] - lat, p["lon"] - lon)
        grow = F.when(d > 0, 1 + buf / d).otherwise(F.lit(1.0))
        return F.struct((lat + (p["lat"] - lat) * grow).alias("lat"), (lon + (p["lon"] - lon) * grow).alias("lon"))

    many = F.size("ring") >= 3
    j = cut(j.withColumn("outline", F.when(many, F.transform("ring", push)).otherwise(geo.circle("lat", "lon", "_buf", 16))))
    side = lambda k: F.array_max(F.transform("outline", lambda p: p[k])) - F.array_min(F.transform("outline", lambda p: p[k]))
    area = F.when(many, side("lon") * 60 * side("lat") * 60 * 0.7).otherwise(3.14159 * c("_buf") * c("_buf"))
    kind = (F.when((c("altitude_jumps") > c("position_teleports")) & (c("altitude_jumps") > 0), "spoofing")
            .when(c("mlat_only_flights") > c("event_count") * 0.3, "denial").otherwise("mixed"))
    return j.select("zone", "cells", *sums, F.round("_score", 1).alias("score"), kind.alias("zone_type"), "confidence", F.round("lat", 4).alias("lat"),
                    F.round("lon", 4).alias("lon"), "first_seen", "last_seen", F.round(area, 1).alias("area_sq_nm"), "outline")
