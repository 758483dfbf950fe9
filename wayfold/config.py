"""Thresholds and fixed constants, in one place.

Semantics fixed once for the whole package: epoch seconds are UTC, BETWEEN is
inclusive, points are unique on (flight_id, ts), ties fall to the smaller key,
and any "now" is an explicit ``as_of`` argument.
"""

from __future__ import annotations

# Unit and earth constants.
EARTH_KM = 6371.0
NM_PER_KM = 0.539957
EARTH_NM = EARTH_KM * NM_PER_KM
EARTH_NM_STATS = 3440.065
EARTH_M = 6371000.0

# Training region box (north, south, west, east).
REGION = {"north": 34.597042, "south": 28.536275, "west": 32.299805, "east": 37.397461}

# Squawk codes and what they mean.
SQUAWKS = {"7500": "Hijack", "7600": "Radio Failure", "7700": "General Emergency"}

# One rule numbering for the whole package.
RULES = {
    1: "Emergency Squawks",
    2: "Extreme Altitude Change",
    3: "Abrupt Turn",
    4: "Dangerous Proximity",
    6: "Go Around",
    7: "Return to Land",
    8: "Diversion",
    9: "Low Altitude",
    10: "Signal Loss",
    11: "Off Course",
    12: "Unplanned Landing",
    13: "Military Aircraft",
}

# Rule thresholds.
ALT_CHANGE = {"delta_ft": 4000.0, "window_s": 60, "cruise_ft": 10000.0}
TURN = {"heading_deg": 160.0, "window_s": 90, "min_kt": 200.0, "acc_window_s": 900}
PROXIMITY = {"nm": 4.0, "alt_ft": 999.0, "sync_s": 5, "airport_nm": 4.0, "min_alt_ft": 5000.0}
GO_AROUND = {"nm": 6.0, "low_ft": 1500.0, "buffer_ft": 150.0, "recovery_ft": 800.0,
             "descent_ft": 300.0, "below_ft": -200.0}
RETURN = {"nm": 10.0, "takeoff_ft": 750.0, "landing_ft": 800.0, "max_s": 600,
          "outbound_nm": 3.0, "min_s": 120}
DIVERSION_NM = 10.0
UNPLANNED_NM = 5.0
LOW_ALT = {"ft": 800.0, "airport_nm": 12.0}
SIGNAL = {"gap_s": 180, "repeat": 2}
PATHS = {"samples": 120, "cell_deg": 0.05, "heat_min": 5, "off_points": 15,
         "far_nm": 12.0, "bucket": 5, "sig_deg": 30, "width_nm": 8.0,
         "tube_nm": 6.0, "tube_ft": 2000.0, "floor_ft": 9000.0}
LAYERS = {"turn_tol_nm": 3.0, "proc_tol_nm": 10.0, "proc_width_nm": 6.0, "turn_radius_nm": 5.0,
          "zone_radius_nm": 2.0}
OD = {"points": 20, "alt_ft": 5000.0, "nm": 15.0}

# Published runway directions per airport code.
RUNWAYS = {
    "LCRA": [100, 280], "ALJAWZAH": [135, 315], "HEGR": [160, 340], "LLBG": [76, 256],
    "LLHA": [155, 335], "LLER": [9, 189], "LLSD": [140, 320], "LLBS": [143, 323],
    "LLET": [86, 266], "LLOV": [30, 210], "LLNV": [100, 280], "LLMG": [80, 260],
    "LLHZ": [160, 340], "OLBA": [155, 335], "OLKA": [90, 270], "OJAI": [75, 255],
    "OJAM": [61, 241], "OJAQ": [20, 200], "OJMF": [150, 330], "OJJR": [113, 293],
    "OJMN": [142, 322], "OSDI": [50, 230], "OSKL": [75, 255], "OSAP": [35, 215],
}

# Rows an inlined dimension may have; beyond it the grid join is used.
INLINE_DIM_ROWS = 64
# Rows a dimension may have to be broadcast by hint; beyond it Catalyst decides.
BROADCAST_DIM_ROWS = 100_000
# Width of a track slice. (flight, ts) is unique in whole seconds, so a slice
# never holds more than this many points, however long the track is.
SLICE_S = 21_600
