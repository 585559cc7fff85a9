"""Fixed values of the engineering model: size table, crossing kinds, prices and tolerances."""

from __future__ import annotations

# Fixed values. Pipe sizes: dn mm, capacity t/h, longest run m, price RUB/m, envelope width m, envelope height m.
SIZES = (
    (50, 3.5, 181, 74023, 0.400, 0.125),
    (65, 8.3, 245, 78631, 0.430, 0.140),
    (80, 13.2, 327, 83530, 0.470, 0.160),
    (100, 22.3, 419, 89748, 0.510, 0.180),
    (125, 40.2, 554, 97275, 0.600, 0.225),
    (150, 65.1, 696, 105507, 0.650, 0.250),
    (200, 152.3, 1042, 120275, 0.880, 0.315),
    (250, 274.9, 1379, 135323, 1.050, 0.400),
    (300, 437.4, 1718, 150022, 1.150, 0.450),
    (400, 943.1, 2477, 190299, 1.370, 0.560),
    (500, 1663.4, 3245, 224137, 1.670, 0.710),
    (600, 2627.7, 4037, 264790, 1.850, 0.800),
    (700, 3735.1, 4775, 324298, 2.050, 0.900),
    (800, 5296.8, 5644, 325996, 2.250, 1.000),
    (900, 7165.0, 6518, 327693, 2.450, 1.100),
    (1000, 9391.8, 7419, 418777, 2.650, 1.200),
    (1200, 15012.8, 9288, 428074, 3.100, 1.425),
    (1400, 22501.9, 11276, 683417, 3.450, 1.600),
)

# Fixed values. Crossing kinds: factor, width, height, top depth, vertical gap, horizontal gap, window each side.
CROSSINGS = {
    "gas_pipeline": (1.25, 0.4, 0.4, 2.8, 0.2, 2.0, 2.0),
    "power_cable": (1.15, 0.2, 0.2, 2.7, 0.5, 2.0, 2.0),
    "heat_network": (1.05, None, None, 3.0, 0.5, 1.0, 2.0),
    "road": (1.60, 0.0, 0.0, None, None, 1.5, 3.0),
    "tram_tracks": (1.75, 0.0, 0.0, None, None, 1.5, 3.0),
}
BUILDINGS = ("oks", "oks_existing", "oks_future")

# Fixed values. Chamber prices by the largest size that they hold (None: above).
CHAMBER_STEPS = ((200, 3_000_000), (500, 5_000_000), (1000, 8_000_000), (None, 12_000_000))
TIE_IN_COST = 5_000_000
PENALTY_BASE, PENALTY_PER_TPH = 100_000_000, 500_000
COST_WEIGHT, COST_UNIT, LENGTH_WEIGHT, LENGTH_UNIT = 0.7, 25_000_000, 0.3, 100
LENGTH_EQUIVALENT = (LENGTH_WEIGHT / LENGTH_UNIT) / (COST_WEIGHT / COST_UNIT)  # RUB for a metre of the score's length term
SLOPE, NORMAL_DEPTH, MIN_DEPTH = 0.10, 3.0, 0.7

# Fixed values. Tolerances.
FIT = 1e-9
CONTINUOUS_FIT, CONTINUOUS_FIT_AUDIT = 1e-8, 0.002
TOUCH = 0.02
CHAMBER_REUSE_RADIUS = 10.0
ENVELOPE_TOLERANCE, ENVELOPE_TOLERANCE_AUDIT = 1e-6, 0.002
CONFLICT = 1e-7
BEND_PRICED, BEND_SEARCH, BEND_REPORTED = 15.0, 5.0, 8.0
MAX_DEGREE = 4

# Fixed values of WGS84 and UTM zone 37 north.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EASTING, UTM_MERIDIAN = 0.9996, 500000.0, 39.0
