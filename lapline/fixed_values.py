"""Values that results depend on and that have to be exactly these.

Fixed values: names, order, thresholds, enum codes, track and tyre tables.
"""

WHEELS = ("fl", "fr", "rl", "rr")

# Wheel metrics in file order: nested field -> flat column prefix.
WHEEL_METRICS = (
    ("pressure", "tyre_pressure"),
    ("core_temp", "tyre_temp"),
    ("inner_temp", "tyre_inner_temp"),
    ("middle_temp", "tyre_middle_temp"),
    ("outer_temp", "tyre_outer_temp"),
    ("slip", "tyre_slip"),
    ("suspension_travel", "suspension_travel"),
    ("brake_temp", "brake_temp"),
    ("wear", "tyre_wear"),
)

SETUP_PARAMETERS = ("tc_level", "tc_cut", "abs_level", "engine_map", "brake_bias")
BRAKE_BIAS_TOLERANCE = 0.01

HEAVY_BRAKE = 0.8
FULL_THROTTLE = 0.95

FUEL_USED_WARN = 3.5
TYRE_TEMP_WARN = 100
TYRE_TEMP_GOOD = 75
LAPS_LEFT_WARN = 3

NO_LAP_TIME = "--:--.---"
SAMPLE_RATE_HZ = 30.0
GRID_POINTS = 1000

STATUS_CODES = {0: "off", 1: "replay", 2: "live", 3: "pause"}
SESSION_TYPE_CODES = {
    0: "practice", 1: "qualify", 2: "race", 3: "hotlap",
    4: "time_attack", 7: "hotstint", 8: "superpole",
}
GRIP_CODES = {
    0: "green", 1: "fast", 2: "optimum", 3: "greasy", 4: "damp", 5: "wet", 6: "flooded",
}
RAIN_CODES = {
    0: "no_rain", 1: "drizzle", 2: "light_rain", 3: "medium_rain",
    4: "heavy_rain", 5: "thunderstorm",
}

# car id -> percentage points added to the raw brake bias; others take the default
BRAKE_BIAS_OFFSETS = {"12": -7.0, "3": -14.0, "2": -17.0}
DEFAULT_BRAKE_BIAS_OFFSET = -5.0

# compound -> (min, max) degrees C
TYRE_WINDOWS = {
    "gt3_dry": (80.0, 100.0),
    "gt3_wet": (50.0, 70.0),
    "gt4_dry": (75.0, 95.0),
}

# topic -> what it carries; also the name of the per-session JSON lines files
TELEMETRY_TOPIC = "telemetry_raw"
EVENT_TOPICS = ("session_events", "lap_completions", "setup_snapshots")

# field -> (lowest, highest) plausible value
FIELD_BOUNDS = {
    "speed_kmh": (0, 370),
    "throttle": (-0.01, 1.01),
    "brake": (-0.01, 1.01),
    "steering": (-1.5, 1.5),
    "fuel_remaining": (0, 200),
    "brake_bias": (-1, 100),
    "air_temp": (-10, 60),
    "road_temp": (-10, 80),
    "tyre_temp_fl": (10, 200),
    "tyre_temp_fr": (10, 200),
    "tyre_temp_rl": (10, 200),
    "tyre_temp_rr": (10, 200),
    "tyre_pressure_fl": (15, 35),
    "tyre_pressure_fr": (15, 35),
    "tyre_pressure_rl": (15, 35),
    "tyre_pressure_rr": (15, 35),
    "brake_temp_fl": (0, 1200),
    "brake_temp_fr": (0, 1200),
}
# The stricter bounds put on the first rows of a recording.
HEAD_BOUNDS = {
    "speed_kmh": (0, 400),
    "throttle": (-0.01, 1.01),
    "brake": (-0.01, 1.01),
    "tyre_temp_fl": (20, 150),
    "tyre_temp_fr": (20, 150),
    "tyre_temp_rl": (20, 150),
    "tyre_temp_rr": (20, 150),
    "fuel_remaining": (0, None),
    "distance_into_lap": (0, None),
}
REQUIRED_FIELDS = (
    "timestamp_wall", "car", "track", "speed_kmh", "throttle", "brake", "distance_into_lap",
)

# Decimals each column is written with in CSV recordings.
CSV_DECIMALS = {
    "timestamp_game": 3, "distance_into_lap": 2, "normalized_position": 6,
    "throttle": 4, "brake": 4, "steering": 4, "clutch": 4,
    "speed_kmh": 2, "fuel_remaining": 2, "fuel_per_lap": 2,
    "g_lat": 4, "g_lon": 4, "g_vert": 4,
    "tyre_pressure": 2, "tyre_temp": 1, "tyre_inner_temp": 1, "tyre_middle_temp": 1,
    "tyre_outer_temp": 1, "tyre_slip": 4, "suspension_travel": 4, "brake_temp": 1,
    "tyre_wear": 4, "brake_bias": 1, "air_temp": 1, "road_temp": 1,
    "wind_speed": 1, "wind_direction": 1,
}

# track_id, track_name, length_m, sector boundaries
TRACKS = (
    ("monza", "Monza", 5793, (0, 2060, 4150, 5793)),
    ("spa", "Spa-Francorchamps", 7004, (0, 2310, 4720, 7004)),
)
# track_id, corner, entry_m, apex_m, exit_m, braking zone start, reference speed low, high
CORNERS = (
    ("monza", "T1_Rettifilo", 270, 310, 370, 230, 70, 85),
    ("monza", "T2_Variante_della_Roggia", 370, 430, 490, 340, 60, 75),
    ("monza", "T3_Curva_Grande", 700, 820, 950, 680, 200, 240),
    ("monza", "T4_Variante_della_Roggia_2", 1400, 1460, 1520, 1340, 70, 90),
    ("monza", "T5_Lesmo_1", 1980, 2060, 2130, 1920, 140, 170),
    ("monza", "T6_Lesmo_2", 2250, 2330, 2400, 2190, 130, 155),
    ("monza", "T8_Ascari", 3400, 3520, 3640, 3320, 140, 165),
    ("monza", "T11_Parabolica", 4700, 4900, 5100, 4620, 130, 160),
    ("spa", "T1_La_Source", 180, 230, 300, 100, 60, 80),
    ("spa", "T3_Eau_Rouge", 580, 640, 720, None, 250, 285),
    ("spa", "T4_Raidillon", 720, 800, 900, None, 210, 255),
    ("spa", "T7_Les_Combes", 1960, 2050, 2130, 1850, 90, 120),
    ("spa", "T10_Pouhon", 3000, 3180, 3350, 2900, 170, 210),
    ("spa", "T12_Fagnes", 3750, 3850, 3950, 3650, 130, 160),
    ("spa", "T14_Stavelot", 4150, 4280, 4400, 4050, 140, 170),
    ("spa", "T15_Blanchimont", 5300, 5500, 5700, None, 250, 275),
    ("spa", "T19_Bus_Stop", 6350, 6500, 6650, 6200, 75, 100),
)
