"""Vessel positions and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
AIS = "mmsi string, ts timestamp_ntz, latitude double, longitude double, speed_over_ground double, navigation_status string"


def latest_positions(pos: DataFrame) -> DataFrame:
    """Newest position per vessel; max over a struct is combined map-side."""
    key = F.struct("ts", (-c("latitude")).alias("a"), (-c("longitude")).alias("b"))
    best = F.max_by(F.struct("ts", "latitude", "longitude", "speed_over_ground", "navigation_status"), key)
    return pos.groupBy("mmsi").agg(best.alias("p")).select("mmsi", "p.*")


def with_latest(meta: DataFrame, pos: DataFrame) -> DataFrame:
    """Every vessel of the register with its newest position, if any."""
    return meta.join(latest_positions(pos), "mmsi", "left")


def active_vessels(pos: DataFrame, meta: DataFrame, since, kind: str | None = None, box=None) -> DataFrame:
    out = pos.where(c("ts") > since)
    if box:
        s, w, n, e = box
        out = out.where(c("latitude").between(s, n) & c("longitude").between(w, e))
    out = latest_positions(out).join(meta, "mmsi", "left")
    return out.where(c("vessel_type_description").ilike(f"%{kind}%")) if kind else out


def search(meta: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """mmsi or name contains the text; exact mmsi first, then exact name. ``meta`` may carry last_updated."""
    hit = meta.where(c("mmsi").like(f"%{text}%") | c("vessel_name").ilike(f"%{text}%"))
    rank = F.when(c("mmsi") == text, 1).when(c("vessel_name").ilike(text), 2).otherwise(3)
    order = [rank] + ([F.desc("last_updated")] if "last_updated" in meta.columns else []) + [c("mmsi")]
    return hit.orderBy(*order).limit(limit)


def statistics(pos: DataFrame, meta: DataFrame) -> DataFrame:
    """Vessels and positions in total, by type and by status, as (kind, label, n)."""
    total = pos.agg(F.count_distinct("mmsi").alias("v"), F.count("*").alias("p")).select(F.explode(F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("vessels").alias("label"), c("v").alias("n")),
        F.struct(F.lit("total").alias("kind"), F.lit("positions").alias("label"), c("p").alias("n")))).alias("x")).select("x.*")
    seen = pos.select("mmsi").distinct()
    by_type = (seen.join(meta, "mmsi").groupBy(c("vessel_type_description").alias("label")).agg(F.count("*").alias("n"))
               .select(F.lit("type").alias("kind"), "label", "n"))
    by_status = pos.groupBy(c("navigation_status").alias("label")).agg(F.count_distinct("mmsi").alias("n")).select(F.lit("status").alias("kind"), "label", "n")
    return total.unionByName(by_type).unionByName(by_status)


def parse_messages(raw: DataFrame, col: str = "value") -> DataFrame:
    """AIS position messages from JSON text with a declared schema; rows without a vessel are dropped."""
    return raw.select(F.from_json(c(col).cast("string"), AIS).alias("m")).select("m.*").where("mmsi is not null and ts is not null")


# -- messages as the receiver sends them: positions and static data share one envelope
AIS_MESSAGE = ("MessageType string, MetaData struct<MMSI:string,ShipName:string>, Message struct<"
               "PositionReport:struct<Latitude:double,Longitude:double,Sog:double,Cog:double,TrueHeading:int,NavigationalStatus:int,Timestamp:timestamp>,"
               "ShipStaticData:struct<Name:string,CallSign:string,ImoNumber:bigint,Type:int,Dimension:struct<A:int,B:int,C:int,D:int>,Draught:double,Destination:string>>")


def ship_type(code: Column) -> Column:
    """Class of the two-digit ship type."""
    tens = F.floor(code / 10)
    return (F.when(code == 30, "Fishing").when(tens == 6, "Passenger").when(tens == 7, "Cargo").when(tens == 8, "Tanker")
            .when(code.isNotNull(), "Other"))


def ais_envelopes(raw: DataFrame, col: str = "value", at: str = "received") -> DataFrame:
    """(mmsi, received, kind, name, position, static) of JSON texts; texts without a vessel or not to be parsed are dropped."""
    m = raw.select(F.from_json(c(col).cast("string"), AIS_MESSAGE).alias("m"), c(at).alias("received"))
    text = lambda x: F.nullif(F.trim(x), F.lit(""))
    return m.select(text(c("m.MetaData.MMSI")).alias("mmsi"), "received", c("m.MessageType").alias("kind"), text(c("m.MetaData.ShipName")).alias("name"),
                    c("m.Message.PositionReport").alias("position"), c("m.Message.ShipStaticData").alias("static")).where("mmsi is not null")


def position_reports(envelopes: DataFrame) -> DataFrame:
    p = envelopes.where("kind = 'PositionReport' and position.Latitude is not null and position.Longitude is not null")
    return p.select("mmsi", F.coalesce(c("position.Timestamp"), c("received").cast("timestamp")).alias("ts"), c("position.Latitude").alias("latitude"),
                    c("position.Longitude").alias("longitude"), c("position.Sog").alias("speed_over_ground"), c("position.NavigationalStatus").alias("status_code"))


def static_reports(envelopes: DataFrame) -> DataFrame:
    """Register rows of static messages; length and width are the sums of the distances from the antenna."""
    s = envelopes.where("kind = 'ShipStaticData' and static is not null")
    text = lambda x: F.nullif(F.trim(c(f"static.{x}")), F.lit(""))
    return s.select("mmsi", F.coalesce(text("Name"), "name").alias("vessel_name"), text("CallSign").alias("call_sign"), c("static.ImoNumber").alias("imo_number"),
                    c("static.Type").alias("vessel_type"), ship_type(c("static.Type")).alias("vessel_type_description"),
                    (c("static.Dimension.A") + c("static.Dimension.B")).alias("length_m"), (c("static.Dimension.C") + c("static.Dimension.D")).alias("width_m"),
                    c("static.Draught").alias("draught_m"), text("Destination").alias("destination"), c("received").alias("last_updated"))
