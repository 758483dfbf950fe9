"""Keys, classes and labels derived from scalar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.geo import _c


# -- time keys: integer arithmetic on epoch seconds, so the session zone plays no part
def day_number(ts="ts") -> Column:
    return F.floor(_c(ts) / 86400).cast("int")


def date_of(ts="ts") -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day_number(ts))


def date_str(ts="ts") -> Column:
    return date_of(ts).cast("string")


def month_str(ts="ts") -> Column:
    return F.substring(date_str(ts), 1, 7)


def hour_of(ts="ts") -> Column:
    return F.floor(F.pmod(_c(ts), F.lit(86400)) / 3600).cast("int")


def weekday(ts="ts") -> Column:
    """0 = Sunday, as strftime('%w')."""
    return (F.dayofweek(date_of(ts)) - 1).cast("int")


def year_of(ts="ts") -> Column:
    return F.year(date_of(ts))


def month_of(ts="ts") -> Column:
    return F.month(date_of(ts))


def quarter_of(ts="ts") -> Column:
    return F.quarter(date_of(ts))


def season(month) -> Column:
    m = _c(month)
    return (F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring")
            .when(m.isin(6, 7, 8), "Summer").otherwise("Fall"))


# -- text keys
def airline_code(callsign="callsign") -> Column:
    return F.upper(F.substring(_c(callsign), 1, 3))


def airline_letters(callsign="callsign") -> Column:
    """First three characters with non-letters removed; null below two letters."""
    s = F.upper(F.regexp_replace(F.substring(_c(callsign), 1, 3), "[^A-Za-z]", ""))
    return F.when(F.length(s) >= 2, s)


def starts_with_any(text, prefixes) -> Column:
    text = _c(text)
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def known_airport(code) -> Column:
    c = _c(code)
    return c.isNotNull() & (c != "") & (c != "UNKNOWN")


# -- classes
def gap_class(gap_s, brief: int = 900, medium: int = 3600) -> Column:
    g = _c(gap_s)
    return F.when(g < brief, "brief").when(g < medium, "medium").otherwise("extended")


def flight_phase(alt="alt", vspeed="vspeed") -> Column:
    a, v = _c(alt), _c(vspeed)
    return (F.when(a < 1000, "ground").when(v > 400, "climb")
            .when(v < -400, "descent").otherwise("cruise"))


# Type codes and three-character families of wide and narrow bodies.
WIDE_BODY = ["B744", "B747", "B748", "B74S", "B762", "B763", "B764", "B767", "B772", "B773", "B77L",
             "B77W", "B779", "B778", "B77F", "B788", "B789", "B78X", "B787", "A332", "A333", "A339",
             "A330", "A338", "A33F", "A342", "A343", "A345", "A346", "A340", "A359", "A35K", "A350",
             "A35X", "A388", "A380", "A306", "A310", "A3ST", "DC10", "MD11", "MD1F", "IL96", "IL86",
             "B78K", "B76F"]
WIDE_FAMILIES = ["B74", "B76", "B77", "B78", "A33", "A34", "A35", "A38"]
NARROW_BODY = ["B731", "B732", "B733", "B734", "B735", "B736", "B737", "B738", "B739", "B38M", "B39M",
               "B37M", "B3XM", "B752", "B753", "B757", "A318", "A319", "A320", "A321", "A19N", "A20N",
               "A21N", "E170", "E175", "E190", "E195", "E75L", "E75S", "CRJ2", "CRJ7", "CRJ9", "CRJX",
               "DH8A", "DH8B", "DH8C", "DH8D", "DHC8", "Q400", "AT43", "AT72", "AT76", "ATR", "A220",
               "BCS1", "BCS3", "MD80", "MD81", "MD82", "MD83", "MD87", "MD88", "MD90", "B712", "B717",
               "F70", "F100"]
NARROW_FAMILIES = ["B73", "B75", "A31", "A32", "E17", "E19", "CRJ", "DH8", "AT7", "MD8", "MD9"]


def body_class(aircraft_type="aircraft_type") -> Column:
    t = F.substring(F.trim(F.upper(_c(aircraft_type))), 1, 4)
    fam = F.substring(t, 1, 3)
    return (F.when(t.isin(WIDE_BODY) | fam.isin(WIDE_FAMILIES), "wide_body")
            .when(t.isin(NARROW_BODY) | fam.isin(NARROW_FAMILIES), "narrow_body")
            .otherwise("unknown"))


# Callsign prefix -> organisation, in test order.
CALLSIGN_ORGS = [
    ("RCH", "US Air Force (Air Mobility Command)"), ("REACH", "US Air Force (Air Mobility Command)"),
    ("TOPCAT", "US Air Force (Refueling)"), ("SPAR", "US Military (Senior Presence, Airborne)"),
    ("SAM", "US Air Force (Special Air Mission - VIP)"), ("PAT", "US Army (Priority Air Transport)"),
    ("NAVY", "US Navy"), ("VM", "US Marine Corps"), ("CNV", "US Navy (Convoy)"),
    ("CONVOY", "US Navy (Convoy)"), ("EVAC", "US Air Force (Medical Evacuation)"),
    ("TABOO", "US Air Force (Tanker)"), ("QID", "US Air Force (KC-135 Tanker)"),
    ("QUID", "US Air Force (KC-135 Tanker)"), ("LAGR", "US Air Force (Fighter)"),
    ("DARK", "US Air Force (ISR)"), ("FORTE", "US Air Force (RQ-4 Global Hawk)"),
    ("HOMER", "US Air Force (RC-135)"), ("DUKE", "Military (General)"), ("KING", "Military (General)"),
    ("VIPER", "Military (Fighter)"), ("HAWK", "Military (General)"), ("EAGLE", "Military (Fighter)"),
    ("N00", "US Navy"), ("RRR", "Royal Air Force (ASCOT)"), ("ASCOT", "Royal Air Force (Transport)"),
    ("SHF", "Royal Navy / RAF (Support Helicopter Force)"), ("AAC", "Army Air Corps"),
    ("SYS", "RAF Syerston (Training)"), ("TARTN", "Royal Air Force (Tanker)"), ("RAF", "Royal Air Force"),
    ("RFR", "Royal Air Force (Tanker)"), ("GAF", "German Air Force"), ("BAF", "Belgian Air Force"),
    ("FAF", "French Air Force"), ("CTM", "French Air Force (Transport)"), ("AME", "Spanish Air Force"),
    ("PLF", "Polish Air Force"), ("RDAF", "Royal Danish Air Force"), ("ASY", "Royal Australian Air Force"),
    ("CFC", "Canadian Armed Forces"), ("RFF", "Russian Air Force (Transport)"),
    ("RSD", "Russian State Flight"), ("SHAHD", "Royal Jordanian Air Force"),
    ("SHAHED", "Iranian Military (Shahed Drone)"), ("IAF", "Israeli Air Force"),
    ("ISF", "Israeli Air Force"), ("RSAF", "Republic of Singapore Air Force"),
]
# Registration prefix -> organisation, in test order.
REGISTRATION_ORGS = [
    ("ZZ", "United Kingdom (RAF)"), ("ZM", "United Kingdom (RAF)"), ("ZH", "United Kingdom (RAF)"),
    ("10+", "Germany (Luftwaffe)"), ("11+", "Germany (Luftwaffe)"), ("2+", "Germany (Helicopters/Jets)"),
    ("MM", "Italy (Aeronautica Militare)"), ("FAC", "Colombia (Fuerza Aérea Colombiana)"),
    ("FAH", "Honduras"), ("4XA", "Israel (IDF Aircraft)"), ("4XB", "Israel (IDF Aircraft)"),
    ("4XC", "Israel (IDF Aircraft)"),
]
# Words in an organisation text -> role, first match wins.
ORG_ROLES = [
    (["transport", "mobility", "convoy"], "transport"), (["tanker", "refuel"], "tanker"),
    (["fighter"], "fighter"), (["isr", "recce", "hawk", "rc-135"], "ISR"),
    (["medical", "evac"], "medical"), (["vip", "special air mission", "executive"], "vip"),
    (["helicopter"], "helicopter"), (["training"], "training"), (["drone", "shahed"], "drone"),
]


def _first_prefix(text: Column, table) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for prefix, label in table:
        out = out.when(text.startswith(prefix), label)
    return out


def military_org(callsign="callsign", registration=None, category=None) -> Column:
    """Organisation by category, then callsign prefix, then registration prefix; null when civil."""
    null = F.lit(None).cast("string")
    cs = F.trim(F.upper(_c(callsign))) if callsign is not None else null
    reg = F.trim(F.upper(_c(registration))) if registration is not None else null
    cat = F.lower(_c(category)) if category is not None else null
    return F.coalesce(
        F.when(cat.isin("military_and_government", "military"), "Military (Category)"),
        _first_prefix(cs, CALLSIGN_ORGS), _first_prefix(reg, REGISTRATION_ORGS))


def military_role(org) -> Column:
    low = F.lower(_c(org))
    out = F.when(low.isNull() | (low == ""), F.lit(None).cast("string"))
    for words, role in ORG_ROLES:
        cond = F.lit(False)
        for word in words:
            cond = cond | low.contains(word)
        out = out.when(cond, role)
    return out.otherwise("military")


def place_text(municipality="municipality", country="iso_country", region="iso_region") -> Column:
    m, c, r = (F.coalesce(_c(x), F.lit("")) for x in (municipality, country, region))
    return (F.when((m != "") & (c != ""), F.concat(m, F.lit(", "), c)).when(r != "", r).otherwise(c))

