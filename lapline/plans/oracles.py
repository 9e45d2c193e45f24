"""The SQL each query must equal, written independently of the operators, for DuckDB."""

from lapline import fixed_values as fixed
from lapline import schemas
from lapline.plans.binding import COLUMNS, WITH_SAMPLES

ORACLES: dict[str, str] = {}
_LAP = "session_id, completed_laps"
_TYRES = [f"{p}_{w}" for p in ("tyre_temp", "tyre_pressure") for w in fixed.WHEELS]
_ORDER = "ORDER BY timestamp_wall, packet_id"


def oracle(name: str, body: str, doubles: str = "", ctes: str = "", digits: int = 6,
           samples: str = WITH_SAMPLES) -> None:
    """Register ``body`` over the samples ``t``; ``doubles`` are rounded, in the same steps as there."""
    scale = f"1e{digits}::DOUBLE"
    replaced = ", ".join(
        f"floor(CAST({c} AS DOUBLE) * {scale} + 0.5::DOUBLE) / {scale} AS {c}" for c in doubles.split())
    chosen = f"* REPLACE ({replaced})" if replaced else "*"
    ORACLES[name] = f"{samples}{ctes}, r AS ({body}) SELECT {chosen} FROM r"


def _label(ms: str) -> str:
    return (f"CASE WHEN {ms} > 0 THEN printf('%d:%06.3f', CAST(floor({ms} / 60000) AS BIGINT), "
            f"({ms} % 60000) / 1000.0::DOUBLE) ELSE '--:--.---' END")


def _iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"


def _f(expression: str) -> str:
    """As a 4-byte float, seen as a double."""
    return f"CAST(CAST({expression} AS FLOAT) AS DOUBLE)"


def _count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


_PIT_OK = "status = 'live' AND NOT is_in_pit"

# ---- projections and filters ---------------------------------------------------------

oracle("nested_wheels_flattened",
       "SELECT packet_id, " + ", ".join(f.name for f in schemas._WHEEL_COLUMNS) + " FROM t",
       " ".join(f.name for f in schemas._WHEEL_COLUMNS))

_lap_floats = [f.name for f in schemas.LAP_FILE.fields if f.dataType.typeName() == "float"]
_lap_small = [f.name for f in schemas.LAP_FILE.fields if f.dataType.typeName() == "byte"]
oracle("lap_file_columns", "SELECT " + ", ".join(
    _f(n) + f" AS {n}" if n in _lap_floats else f"CAST({n} AS TINYINT) AS {n}" if n in _lap_small
    else "completed_laps AS lap_number" if n == "lap_number" else n
    for n in schemas.LAP_FILE.names if n != "timestamp_wall") + " FROM t", " ".join(_lap_floats))

oracle("derived_columns", """
    SELECT packet_id, timestamp_wall AS timestamp_parsed,
           (tyre_temp_fl + tyre_temp_fr + tyre_temp_rl + tyre_temp_rr) / 4 AS avg_tyre_temp,
           (tyre_pressure_fl + tyre_pressure_fr + tyre_pressure_rl + tyre_pressure_rr) / 4
               AS avg_tyre_pressure,
           brake > 0.8 AS is_heavy_braking, throttle > 0.95 AS is_full_throttle FROM t""",
       "avg_tyre_temp avg_tyre_pressure")
oracle("on_track_samples", f"SELECT packet_id, {_LAP}, speed_kmh FROM t WHERE {_PIT_OK}", "speed_kmh")
oracle("usable_samples", "SELECT packet_id, status, car, track FROM t WHERE status <> 'off'")


def _names(code: str, names: dict[int, str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in names.items())
    return f"CASE {code} {cases} ELSE 'unknown' END"


oracle("decoded_codes", f"""
    SELECT event_id AS packet_id, {_names('k % 6 - 1', fixed.STATUS_CODES)} AS status,
           {_names('k % 11 - 1', fixed.SESSION_TYPE_CODES)} AS session_type,
           {_names('k % 9 - 1', fixed.GRIP_CODES)} AS track_grip,
           {_names('k % 8 - 1', fixed.RAIN_CODES)} AS rain_intensity FROM base""")
oracle("brake_bias_percent", """
    SELECT event_id AS packet_id, k / 100e0 * 100 + CASE event_id % 14
        WHEN 12 THEN -7 WHEN 3 THEN -14 WHEN 2 THEN -17 ELSE -5 END AS bias FROM base""", "bias")
oracle("session_names", """
    SELECT packet_id, 'acc_' || strftime(timestamp_wall, '%Y%m%d_%H%M%S') || '_' ||
               CASE WHEN track = 'Monza' THEN 'monza' ELSE 'circuit_de_spa-francorchamps' END
               || '_gt3' AS name,
           replace(car, ' ', '_') AS car_folder, printf('lap_%03d', completed_laps) AS lap_file
    FROM t""")
oracle("lap_time_labels", f"""
    SELECT packet_id, {_label('ms')} AS label,
           CASE WHEN ms > 0 THEN '+' ELSE '' END || printf('%.3fs', ms / 1000.0::DOUBLE) AS delta,
           CASE WHEN ms > 0 THEN 'warn' ELSE 'good' END AS band,
           CASE gear WHEN 0 THEN 'R' WHEN 1 THEN 'N' ELSE CAST(gear - 1 AS VARCHAR) END AS gear
    FROM (SELECT *, last_lap_time_ms - 90000 AS ms FROM t)""")
oracle("normalized_speed", f"""
    SELECT packet_id, CASE WHEN top <> 0 THEN speed_kmh / top END AS speed_normalized
    FROM (SELECT *, max(speed_kmh) OVER (PARTITION BY {_LAP}) AS top FROM t WHERE status = 'live')""",
       "speed_normalized")
oracle("lap_points", f"""
    SELECT {_LAP}, timestamp_wall, packet_id, distance_into_lap, speed_kmh, throttle, brake
    FROM t WHERE status = 'live'""", "distance_into_lap speed_kmh throttle brake")

_MULTI = f"""SELECT {_LAP}, max(speed_kmh) AS max_speed, avg(speed_kmh) AS avg_speed,
    max(current_lap_time_ms) AS lap_time_ms,
    {", ".join(f"avg(tyre_temp_{w}) AS avg_temp_{w}" for w in fixed.WHEELS)},
    avg(fuel_remaining) AS avg_fuel, min(fuel_remaining) AS min_fuel,
    avg(brake_bias) AS avg_brake_bias, count(*) AS sample_count, count(speed_kmh) AS speed_count
    FROM t WHERE status = 'live' AND completed_laps IS NOT NULL GROUP BY ALL"""
_MULTI_CTE = f", laps AS ({_MULTI})"
oracle("multi_lap_summary", _MULTI, "max_speed avg_speed avg_temp_fl avg_temp_fr avg_temp_rl "
       "avg_temp_rr avg_fuel min_fuel avg_brake_bias")
oracle("summary_display", f"""
    SELECT session_id, completed_laps AS lap, {_label('lap_time_ms')} AS time, max_speed AS max_spd,
           avg_speed AS avg_spd,
           round_even((avg_temp_fl + avg_temp_fr + avg_temp_rl + avg_temp_rr) / 4, 1) AS avg_tyre,
           avg_fuel AS fuel, sample_count AS samples FROM laps""",
       "max_spd avg_spd avg_tyre fuel", ctes=_MULTI_CTE)


def _text(field) -> str:
    name, kind = field.name, field.dataType.typeName()
    digits = fixed.CSV_DECIMALS.get(name, fixed.CSV_DECIMALS.get(name[:-3]))
    if digits is not None:
        return f"printf('%.{digits}f', {_f(name)}) AS {name}"
    if kind == "boolean":
        return f"CASE WHEN {name} THEN 'True' WHEN NOT {name} THEN 'False' END AS {name}"
    return f"CAST({name} AS VARCHAR) AS {name}"


oracle("recording_text", "SELECT CAST(packet_id AS VARCHAR) AS packet_id, " + ", ".join(
    _text(f) for f in schemas.SAMPLE.fields if f.name != "timestamp_wall") + " FROM t")

# ---- aggregations --------------------------------------------------------------------

oracle("lap_summary", f"""
    SELECT {_LAP}, car, track, max(speed_kmh) AS max_speed_kmh, avg(speed_kmh) AS avg_speed_kmh,
           avg((tyre_temp_fl + tyre_temp_fr + tyre_temp_rl + tyre_temp_rr) / 4) AS avg_tyre_temp,
           avg((tyre_pressure_fl + tyre_pressure_fr + tyre_pressure_rl + tyre_pressure_rr) / 4)
               AS avg_tyre_pressure,
           avg(fuel_remaining) AS avg_fuel, min(fuel_remaining) AS min_fuel,
           {_count('brake > 0.8')} AS heavy_braking_count,
           {_count('throttle > 0.95')} AS full_throttle_count, count(*) AS sample_count,
           min(timestamp_wall) AS lap_start_time, max(timestamp_wall) AS lap_end_time
    FROM t WHERE {_PIT_OK} GROUP BY ALL""",
       "max_speed_kmh avg_speed_kmh avg_tyre_temp avg_tyre_pressure avg_fuel min_fuel")
oracle("available_laps", f"SELECT DISTINCT {_LAP} FROM t WHERE status = 'live'")
oracle("laps_but_first",
       f"SELECT DISTINCT {_LAP} FROM t WHERE status = 'live' AND completed_laps <> 0")
oracle("status_counts", f"SELECT {_LAP}, status, count(*) AS cnt FROM t GROUP BY ALL")
oracle("gear_histogram", """
    SELECT session_id, gear, count(*) AS samples,
           count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY session_id) AS percent,
           CASE gear WHEN 0 THEN 'R' WHEN 1 THEN 'N' ELSE CAST(gear - 1 AS VARCHAR) END AS label
    FROM t GROUP BY session_id, gear""", "percent")
oracle("track_speed", "SELECT track, avg(speed_kmh) AS avg_speed FROM t GROUP BY track", "avg_speed")
_COUNTS = (f"SELECT count(*) AS total, {_count(chr(39).join(['status = ', 'live', '']))} AS live, "
           f"{_count(_PIT_OK)} AS kept FROM t")
oracle("filter_counts", _COUNTS)
_SESSIONS = """SELECT session_id, car, track, session_type, max(completed_laps) AS total_laps,
    min(timestamp_wall) AS session_start, max(timestamp_wall) AS session_end,
    avg(speed_kmh) AS avg_speed FROM t WHERE status = 'live'
    GROUP BY session_id, car, track, session_type"""
oracle("session_list", _SESSIONS, "avg_speed")
oracle("newest_sessions", _SESSIONS + " ORDER BY session_start DESC, session_id LIMIT 10", "avg_speed")

_STACKED = ("(" + " + ".join(f"sum(tyre_temp_{w})" for w in fixed.WHEELS) + ") / ("
            + " + ".join(f"count(tyre_temp_{w})" for w in fixed.WHEELS) + ")")
oracle("lap_headline", f"""
    SELECT *, {_label('lap_time_ms')} AS lap_time,
           CASE WHEN fuel_used > 3.5 THEN 'warn' ELSE '' END AS fuel_band,
           CASE WHEN avg_tyre_temp > 100 THEN 'warn' WHEN avg_tyre_temp > 75 THEN 'good' ELSE '' END
               AS tyre_band
    FROM (SELECT {_LAP}, max(speed_kmh) AS max_speed, avg(speed_kmh) AS avg_speed,
                 max(current_lap_time_ms) AS lap_time_ms,
                 max(fuel_remaining) - min(fuel_remaining) AS fuel_used,
                 max(sqrt(g_lat * g_lat + g_lon * g_lon)) AS peak_g, {_STACKED} AS avg_tyre_temp
          FROM t WHERE status = 'live' GROUP BY ALL)""",
       "max_speed avg_speed fuel_used peak_g avg_tyre_temp")
oracle("lap_pair_deltas", """
    SELECT *, CASE WHEN delta_ms > 0 THEN '+' ELSE '' END
               || printf('%.3fs', delta_ms / 1000.0::DOUBLE) AS delta,
           CASE WHEN delta_ms > 0 THEN 'warn' ELSE 'good' END AS delta_band
    FROM (SELECT session_id, a.max_speed AS max_speed_a, a.avg_speed AS avg_speed_a,
                 a.lap_time_ms AS lap_time_ms_a, b.max_speed AS max_speed_b,
                 b.avg_speed AS avg_speed_b, b.lap_time_ms AS lap_time_ms_b,
                 a.lap_time_ms - b.lap_time_ms AS delta_ms
          FROM (SELECT * FROM laps WHERE completed_laps = 0) a
          JOIN (SELECT * FROM laps WHERE completed_laps = 1) b USING (session_id))""",
       "max_speed_a avg_speed_a max_speed_b avg_speed_b", ctes=_MULTI_CTE)
oracle("tyre_balance", f"""
    SELECT {_LAP}, 'Front' AS axle, round_even(avg_temp_fl, 1) AS "left",
           round_even(avg_temp_fr, 1) AS "right" FROM laps
    UNION ALL SELECT {_LAP}, 'Rear', round_even(avg_temp_rl, 1), round_even(avg_temp_rr, 1)
    FROM laps""", '"left" "right"', ctes=_MULTI_CTE)
oracle("wheel_means", " UNION ALL ".join(f"""
    SELECT {_LAP}, '{w}' AS wheel, avg(tyre_temp_{w}) AS avg_temp,
           avg(tyre_pressure_{w}) AS avg_pressure
    FROM t WHERE status = 'live' GROUP BY ALL""" for w in fixed.WHEELS), "avg_temp avg_pressure")
oracle("stacked_wheels", " UNION ALL ".join(
    f"SELECT packet_id, '{w}' AS wheel, tyre_temp_{w} AS tyre_temp FROM t" for w in fixed.WHEELS),
    "tyre_temp")
oracle("tyre_window_share", " UNION ALL ".join(f"""
    SELECT {_LAP}, '{c}' AS compound, '{w}' AS wheel,
           avg(CASE WHEN tyre_temp_{w} < {lo} THEN 1e0 ELSE 0e0 END) AS below,
           avg(CASE WHEN tyre_temp_{w} BETWEEN {lo} AND {hi} THEN 1e0 ELSE 0e0 END) AS inside,
           avg(CASE WHEN tyre_temp_{w} > {hi} THEN 1e0 ELSE 0e0 END) AS above
    FROM t WHERE status = 'live' GROUP BY {_LAP}"""
    for c, (lo, hi) in fixed.TYRE_WINDOWS.items() for w in fixed.WHEELS), "below inside above")
oracle("braking_stats", f"""
    SELECT {_LAP}, {_count('brake > 0.8')} AS heavy_samples,
           {_count('brake > 0.8')} * 100e0 / count(*) AS heavy_percent, max(brake) AS max_brake
    FROM t WHERE status = 'live' GROUP BY {_LAP}""", "heavy_percent max_brake")
oracle("g_stats", f"""
    SELECT {_LAP}, max(abs(g_lat)) AS max_lat_g, min(g_lon) AS max_braking_g,
           max(g_lon) AS max_accel_g FROM t WHERE status = 'live' GROUP BY {_LAP}""",
       "max_lat_g max_braking_g max_accel_g")
oracle("fuel_forecast", f"""
    SELECT *, CASE WHEN laps_left < 3 THEN 'warn' ELSE 'good' END AS laps_left_band
    FROM (SELECT *, CASE WHEN fuel_per_lap > 0 THEN fuel_remaining / fuel_per_lap ELSE 0 END
                     AS laps_left
          FROM (SELECT {_LAP}, arg_max(fuel_remaining, timestamp_wall) AS fuel_remaining,
                       avg(fuel_per_lap) AS fuel_per_lap
                FROM t WHERE status = 'live' GROUP BY {_LAP}))""",
       "fuel_remaining fuel_per_lap laps_left")
oracle("electronics_means", f"""
    SELECT {_LAP}, avg(tc_level) AS avg_tc_level, avg(abs_level) AS avg_abs_level,
           avg(brake_bias) AS avg_brake_bias FROM t WHERE status = 'live' GROUP BY {_LAP}""",
       "avg_tc_level avg_abs_level avg_brake_bias")
oracle("lap_summary_listing",
       f"SELECT {_LAP}, count(*) AS sample_count FROM t WHERE {_PIT_OK} GROUP BY {_LAP}")

# ---- sequences -----------------------------------------------------------------------

oracle("fuel_burn", f"""
    SELECT {_LAP}, coalesce(abs(avg_fuel - lag(avg_fuel) OVER (
        PARTITION BY session_id ORDER BY completed_laps)), 0) AS burn FROM laps""",
       "burn", ctes=_MULTI_CTE)
oracle("lap_progression", f"""
    SELECT {_LAP}, lap_time_ms, lap_time_ms / 1000.0::DOUBLE AS lap_time_s,
           {_label('lap_time_ms')} AS label,
           row_number() OVER (PARTITION BY session_id ORDER BY lap_time_ms, completed_laps) = 1
               AS is_best
    FROM laps WHERE lap_time_ms > 0""", "lap_time_s", ctes=_MULTI_CTE)

_TOLD = ("track", "car", "session_type", "completed_laps", "best_lap_time_ms")
_STATES = f""", st AS (
    SELECT *, last_value(CASE WHEN status IN ('live', 'off', 'pause') THEN status END IGNORE NULLS)
                  OVER (PARTITION BY session_id {_ORDER}
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bs,
           {", ".join(f"lag({c}) OVER (PARTITION BY session_id {_ORDER}) AS p_{c}" for c in _TOLD)}
    FROM t),
m AS (
    SELECT *, status = 'live' AND bs IS DISTINCT FROM 'live' AS opens,
           status IN ('off', 'pause') AND coalesce(bs = 'live', false) AS closes,
           CASE WHEN status IN ('live', 'off', 'pause') THEN status = 'live'
                ELSE coalesce(bs = 'live', false) END AS member
    FROM st),
n AS (
    SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (
        PARTITION BY session_id {_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM m),
lv AS (
    SELECT *, lag(completed_laps) OVER s AS o_laps,
           {", ".join(f"lag({p}) OVER s AS o_{p}" for p in fixed.SETUP_PARAMETERS)}
    FROM n WHERE status = 'live'
    WINDOW s AS (PARTITION BY session_id, session_no {_ORDER}))"""


def _differs(p: str) -> str:
    close = f" AND NOT abs(o_{p} - {p}) < 0.01" if p == "brake_bias" else ""
    return f"(o_{p} IS NOT NULL AND o_{p} <> {p}{close})"


_EVENTS = """SELECT CASE WHEN opens THEN 'session_start' ELSE 'session_end' END AS event_type,
    session_id, session_no, 'ACC' AS platform,
    CASE WHEN opens THEN track ELSE p_track END AS track,
    CASE WHEN opens THEN car ELSE p_car END AS car,
    CASE WHEN opens THEN session_type ELSE p_session_type END AS session_type,
    timestamp_wall AS "timestamp", CASE WHEN closes THEN p_completed_laps END AS total_laps,
    CASE WHEN closes THEN p_best_lap_time_ms END AS best_lap_ms FROM n WHERE opens OR closes"""
_COMPLETIONS = f"""SELECT session_id, session_no, completed_laps AS lap_number, last_lap_time_ms AS lap_time_ms,
    last_sector_time_ms, is_valid_lap AS is_valid, fuel_remaining, {", ".join(_TYRES)},
    timestamp_wall AS "timestamp" FROM lv WHERE completed_laps > o_laps AND o_laps >= 0"""
_CHANGES = " UNION ALL ".join(f"""
    SELECT session_id, session_no, '{p}' AS parameter, CAST(o_{p} AS DOUBLE) AS old_value,
           CAST({p} AS DOUBLE) AS new_value, completed_laps AS lap_number,
           timestamp_wall AS "timestamp" FROM lv WHERE {_differs(p)}""" for p in fixed.SETUP_PARAMETERS)
_PARAMETERS = ", ".join(fixed.SETUP_PARAMETERS)
_CHANGED = " OR ".join(_differs(p) for p in fixed.SETUP_PARAMETERS)


def _snapshots(distinct: bool) -> str:
    columns = 'session_id, session_no, car, track, timestamp_wall AS "timestamp"'
    first = f"SELECT {columns}, 0 AS lap_applied_from, {_PARAMETERS} FROM lv WHERE opens"
    if distinct:
        return (f"{first} UNION ALL SELECT {columns}, completed_laps, {_PARAMETERS} FROM lv "
                f"WHERE {_CHANGED}")
    return f"{first} UNION ALL " + " UNION ALL ".join(
        f"SELECT {columns}, completed_laps, {_PARAMETERS} FROM lv WHERE {_differs(p)}"
        for p in fixed.SETUP_PARAMETERS)


_COMPLETION_DOUBLES = "fuel_remaining " + " ".join(_TYRES)
oracle("sessionized", "SELECT packet_id, session_id, session_no FROM n WHERE member", ctes=_STATES)
oracle("session_events", _EVENTS, ctes=_STATES)
oracle("lap_completions", _COMPLETIONS, _COMPLETION_DOUBLES, ctes=_STATES)
oracle("setup_changes", _CHANGES, "old_value new_value", ctes=_STATES)
oracle("setup_snapshots", _snapshots(False), "brake_bias", ctes=_STATES)
oracle("distinct_setup_snapshots", _snapshots(True), "brake_bias", ctes=_STATES)

_SEGMENTS_CTE = _STATES + f""",
cut AS (
    SELECT *, opens OR (member AND NOT opens AND coalesce(
        completed_laps > p_completed_laps AND p_completed_laps >= 0, false)) AS cuts FROM n),
sg AS (
    SELECT *, CAST(sum(CASE WHEN cuts THEN 1 ELSE 0 END) OVER (
        PARTITION BY session_id {_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_no FROM cut),
segments AS (
    SELECT session_id, session_no, segment_no,
           arg_max(completed_laps, timestamp_wall) AS lap_number,
           {_count("driven")} AS samples, max(speed_kmh) FILTER (WHERE driven) AS max_speed,
           avg(speed_kmh) FILTER (WHERE driven) AS avg_speed,
           max(fuel_remaining) FILTER (WHERE driven) - min(fuel_remaining) FILTER (WHERE driven)
               AS fuel_used,
           min(timestamp_wall) FILTER (WHERE driven) AS first_time,
           max(timestamp_wall) FILTER (WHERE driven) AS last_time
    FROM (SELECT *, NOT coalesce(is_in_pit, false) AS driven FROM sg WHERE member)
    GROUP BY session_id, session_no, segment_no HAVING samples > 0)"""
oracle("lap_segments", "SELECT * FROM segments", "max_speed avg_speed fuel_used", ctes=_SEGMENTS_CTE)
oracle("without_repeated_packets", """
    SELECT session_id, timestamp_wall, gear AS packet_id
    FROM (SELECT *, lag(gear) OVER (PARTITION BY session_id ORDER BY timestamp_wall, gear) AS o,
                 row_number() OVER (PARTITION BY session_id ORDER BY timestamp_wall, gear) AS i
          FROM t) WHERE i = 1 OR o IS DISTINCT FROM gear""")
oracle("setup_on_laps", f"""
    SELECT l.session_id, l.session_no, l.completed_laps, s.lap_applied_from, {", ".join(f"s.{p}" for p in fixed.SETUP_PARAMETERS)}
    FROM (SELECT DISTINCT {_LAP}, session_no FROM lv) l
    LEFT JOIN snaps s ON s.session_id = l.session_id AND s.session_no = l.session_no
         AND s.lap_applied_from <= l.completed_laps
    QUALIFY row_number() OVER (PARTITION BY l.session_id, l.session_no, l.completed_laps
                               ORDER BY s.lap_applied_from DESC, s."timestamp" DESC) = 1""",
       "brake_bias", ctes=f"{_STATES}, snaps AS ({_snapshots(True)})")

_NUMBERED = f"""SELECT *, row_number() OVER (PARTITION BY session_id {_ORDER}) AS i,
    count(*) OVER (PARTITION BY session_id) AS c FROM t"""
# all samples of a track as one stream
_BY_TRACK = WITH_SAMPLES.replace("concat('s', user_id) AS session_id", f"{COLUMNS['track']} AS session_id")
_NUMBERED_CTE = f", numbered AS ({_NUMBERED})"
_SAMPLED = "i - 1 >= {0} AND i - 1 < {0} + 200"
_SAMPLED_CTE = _NUMBERED_CTE + ", sampled AS (SELECT * FROM numbered WHERE " + " OR ".join(
    "(" + _SAMPLED.format(start) + ")" for start in (
        "CASE WHEN c > 1000 THEN least(500, c // 10) ELSE 0 END", "c // 4", "c // 2",
        "3 * c // 4", "greatest(0, c - 500)")) + ")"
oracle("sampled_rows", "SELECT packet_id, session_id FROM sampled", ctes=_SAMPLED_CTE, samples=_BY_TRACK)
oracle("first_hundred_rows", "SELECT packet_id, session_id FROM numbered WHERE i <= 100",
       ctes=_NUMBERED_CTE, samples=_BY_TRACK)

# ---- joins ---------------------------------------------------------------------------

_KEYED_CTE = _SEGMENTS_CTE + f""", ev AS ({_EVENTS}),
starts AS (SELECT session_id || '_' || session_no AS session_id, platform, track, car, session_type,
                  "timestamp" AS start_time FROM ev WHERE event_type = 'session_start'),
ends AS (SELECT session_id || '_' || session_no AS session_id, total_laps, best_lap_ms,
                "timestamp" AS end_time FROM ev WHERE event_type = 'session_end'),
lapt AS (SELECT session_id || '_' || session_no AS session_id, lap_number, samples, max_speed
         FROM segments)"""
oracle("session_ends_merged", """
    SELECT s.*, e.end_time, coalesce(e.total_laps, 0) AS total_laps, e.best_lap_ms
    FROM starts s LEFT JOIN ends e USING (session_id)""", ctes=_KEYED_CTE)
oracle("laps_with_sessions", """
    SELECT l.*, s.car, s.track, s.start_time FROM lapt l JOIN starts s USING (session_id)""",
       "max_speed", ctes=_KEYED_CTE)
oracle("orphan_laps", """
    SELECT * FROM lapt WHERE session_id NOT IN (
        SELECT session_id FROM starts WHERE session_type = 'race')""", "max_speed", ctes=_KEYED_CTE)

_TRACK_ID = "CASE WHEN track = 'Monza' THEN 'monza' ELSE 'spa' END"


def _values(rows) -> str:
    return ", ".join(
        "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row)
        + ")" for row in rows)


_CORNERS_CTE = (f", corners(track_id, corner, entry_m, apex_m, exit_m, brake_m, ref_low, ref_high) "
                f"AS (VALUES {_values(fixed.CORNERS)}), tt AS (SELECT *, {_TRACK_ID} AS track_id "
                f"FROM t WHERE status = 'live')")
_SECTOR_ROWS = [(track_id, i + 1, bounds[i], bounds[i + 1])
                for track_id, _, _, bounds in fixed.TRACKS for i in range(len(bounds) - 1)]
_SECTORS_CTE = f", sectors(track_id, sector, lo, hi) AS (VALUES {_values(_SECTOR_ROWS)})"
_IN_CORNER = ("tt JOIN corners c ON tt.track_id = c.track_id "
              "AND tt.distance_into_lap BETWEEN c.entry_m AND c.exit_m")
oracle("session_tracks", f"SELECT DISTINCT session_id, track, {_TRACK_ID} AS track_id FROM t")
oracle("samples_in_corners", f"SELECT packet_id, corner FROM {_IN_CORNER}", ctes=_CORNERS_CTE)
oracle("corner_stats", f"""
    SELECT {_LAP}, replace(corner, '_', ' ') AS corner, min(speed_kmh) AS min_speed,
           avg(speed_kmh) AS avg_speed, ref_low, ref_high,
           min(speed_kmh) - ref_low AS delta_to_ref_low
    FROM {_IN_CORNER} GROUP BY {_LAP}, corner, ref_low, ref_high""",
       "min_speed avg_speed delta_to_ref_low", ctes=_CORNERS_CTE)
_SECTOR_TIMES = f"""SELECT {_LAP}, e1 AS sector_1_ms, e2 - coalesce(e1, 0) AS sector_2_ms,
    e3 - coalesce(e2, e1, 0) AS sector_3_ms, ms AS lap_time_ms
    FROM (SELECT {_LAP}, {", ".join(f"max(current_lap_time_ms) FILTER (WHERE sector = {i}) AS e{i}" for i in (1, 2, 3))},
                 max(current_lap_time_ms) AS ms
          FROM tt JOIN sectors s ON tt.track_id = s.track_id
               AND distance_into_lap >= lo AND distance_into_lap < hi GROUP BY {_LAP})"""


def _passed(border: str) -> str:
    return (f"min(p_ms + ({border} - p_d) / (distance_into_lap - p_d) * (current_lap_time_ms - p_ms)) "
            f"FILTER (WHERE p_lap = completed_laps AND p_d < {border} AND distance_into_lap >= {border})")


_CROSSINGS = f"""SELECT {_LAP}, e1 AS sector_1_ms, e2 - e1 AS sector_2_ms, ms - e2 AS sector_3_ms, ms AS lap_time_ms
    FROM (SELECT {_LAP}, {_passed('b2')} AS e1, {_passed('b3')} AS e2,
                 CAST(max(current_lap_time_ms) AS DOUBLE) AS ms
          FROM (SELECT *, lag(completed_laps) OVER q AS p_lap, lag(distance_into_lap) OVER q AS p_d,
                       lag(current_lap_time_ms) OVER q AS p_ms
                FROM tt WINDOW q AS (PARTITION BY session_id ORDER BY timestamp_wall, packet_id))
          LEFT JOIN (SELECT track_id, max(lo) FILTER (WHERE sector = 2) AS b2, max(lo) FILTER (WHERE sector = 3) AS b3
                     FROM sectors GROUP BY track_id) USING (track_id) GROUP BY {_LAP})"""
oracle("sector_crossings", _CROSSINGS, "sector_1_ms sector_2_ms sector_3_ms lap_time_ms",
       ctes=_CORNERS_CTE + _SECTORS_CTE)
oracle("measured_sector_sums", f"""
    SELECT session_id, count(*) AS laps, count(*) - count(sector_1_ms + sector_2_ms + sector_3_ms) AS unmeasured,
           count(*) FILTER (WHERE abs(sector_1_ms + sector_2_ms + sector_3_ms - lap_time_ms) > 100) AS sectors_off,
           CASE WHEN count(*) FILTER (WHERE abs(sector_1_ms + sector_2_ms + sector_3_ms - lap_time_ms) > 100) = 0
                THEN 'ok' ELSE 'fail' END AS verdict
    FROM ({_CROSSINGS}) GROUP BY session_id""", ctes=_CORNERS_CTE + _SECTORS_CTE)
oracle("sector_times", _SECTOR_TIMES, ctes=_CORNERS_CTE + _SECTORS_CTE)
ORACLES["corner_stats_from_files"] = ORACLES["corner_stats"]
ORACLES["sector_times_from_files"] = ORACLES["sector_times"]
oracle("lap_records", f"""
    SELECT l.session_id, l.session_no, l.lap_number, l."timestamp", l.lap_time_ms, sector_1_ms, sector_2_ms,
           sector_3_ms, fuel_used, avg_tyre_temp_fl
    FROM ({_COMPLETIONS}) l
    LEFT JOIN (SELECT session_id, session_no, completed_laps, e1 AS sector_1_ms,
                      e2 - coalesce(e1, 0) AS sector_2_ms, e3 - coalesce(e2, e1, 0) AS sector_3_ms
               FROM (SELECT session_id, session_no, completed_laps,
                            {", ".join(f"max(current_lap_time_ms) FILTER (WHERE sector = {i}) AS e{i}" for i in (1, 2, 3))}
                     FROM ls JOIN sectors z ON ls.track_id = z.track_id
                          AND distance_into_lap >= lo AND distance_into_lap < hi GROUP BY ALL)) s
         ON s.session_id = l.session_id AND s.session_no = l.session_no AND s.completed_laps = l.lap_number - 1
    LEFT JOIN (SELECT session_id, session_no, completed_laps,
                      max(fuel_remaining) - min(fuel_remaining) AS fuel_used,
                      avg(tyre_temp_fl) AS avg_tyre_temp_fl FROM ls GROUP BY ALL) f
         ON f.session_id = l.session_id AND f.session_no = l.session_no AND f.completed_laps = l.lap_number - 1""",
       "fuel_used avg_tyre_temp_fl", ctes=f"{_STATES}{_CORNERS_CTE}{_SECTORS_CTE}, "
       f"ls AS (SELECT *, {_TRACK_ID} AS track_id FROM lv)")
oracle("braking_zones", f"""
    SELECT {_LAP}, corner, min(distance_into_lap) FILTER (WHERE brake > 0.05) AS brake_point_m,
           max(brake) AS peak_brake, arg_min(speed_kmh, distance_into_lap) AS entry_speed,
           min(speed_kmh) AS min_speed
    FROM tt JOIN corners c ON tt.track_id = c.track_id
         AND distance_into_lap BETWEEN c.brake_m AND c.apex_m
    GROUP BY {_LAP}, corner""", "brake_point_m peak_brake entry_speed min_speed", ctes=_CORNERS_CTE)

# ---- alignment -----------------------------------------------------------------------

_N = fixed.GRID_POINTS


def _grid(bounds: str, last: str = str(_N - 1)) -> str:
    """Grid points of the (session_id, completed_laps, lo, hi, ...) rows of ``bounds``."""
    return (f"SELECT *, CASE WHEN i >= {_N - 1} THEN hi ELSE i * ((hi - lo) / {_N - 1}e0) + lo END AS x "
            f"FROM (SELECT *, CAST(unnest(range({last} + 1)) AS INT) AS i FROM {bounds})")


def _interpolated(columns: str, outside: str = "clamp") -> str:
    def value(c):
        before, after = (f"b.{c}", f"a.{c}") if outside == "clamp" else (
            "NULL", f"CASE WHEN g.x = a.d THEN a.{c} END")
        return (f"CASE WHEN a.d IS NULL THEN {before} WHEN b.d IS NULL THEN {after} "
                f"ELSE (b.{c} - a.{c}) / (b.d - a.d) * (g.x - a.d) + a.{c} END AS {c}")
    on = "g.session_id = {0}.session_id AND g.completed_laps = {0}.completed_laps"
    return (f"SELECT g.*, {', '.join(value(c) for c in columns.split())} FROM grid g "
            f"ASOF LEFT JOIN p a ON {on.format('a')} AND g.x >= a.d "
            f"ASOF LEFT JOIN p b ON {on.format('b')} AND g.x < b.d")


_POINTS_CTE = f""", p AS (SELECT {_LAP}, distance_into_lap AS d, speed_kmh, throttle, brake,
        CAST(current_lap_time_ms AS DOUBLE) AS ms FROM t WHERE status = 'live'),
bounds AS (SELECT {_LAP}, min(d) AS lo, max(d) AS hi, count(*) AS c, max(ms) AS ms FROM p GROUP BY {_LAP})"""
_OWN_GRID = _grid("bounds", f"CASE WHEN c < 2 THEN 0 ELSE {_N - 1} END")
oracle("resampled_laps", f"""
    SELECT {_LAP}, i AS grid_i, x AS distance_into_lap, speed_kmh, throttle
    FROM ({_interpolated('speed_kmh throttle')})""", "distance_into_lap speed_kmh throttle",
       ctes=f"{_POINTS_CTE}, grid AS ({_OWN_GRID})")


def _between(columns: str, grid: str, outside: str = "clamp") -> str:
    """The same in one pass: points and grid in one order, each grid row with the points next to it."""
    names = columns.split()
    point = ", ".join(f"'{c}': {c}" for c in ["d", *names])

    def value(c):
        before, after = (f"b.{c}", f"a.{c}") if outside == "clamp" else (
            "NULL", f"CASE WHEN x = a.d THEN a.{c} END")
        return (f"CASE WHEN a IS NULL THEN {before} WHEN b IS NULL THEN {after} "
                f"ELSE (b.{c} - a.{c}) / (b.d - a.d) * (x - a.d) + a.{c} END AS {c}")
    kept = "session_id, completed_laps, i, x" + (", best_lap" if outside != "clamp" else "")
    extra = ", NULL AS best_lap" if outside != "clamp" else ""
    return f"""SELECT {kept}, {', '.join(map(value, names))} FROM (
        SELECT {kept},
               last_value(point IGNORE NULLS) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
               first_value(point IGNORE NULLS) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
        FROM (SELECT {kept}, NULL AS point, 1 AS turn FROM {grid}
              UNION ALL SELECT {_LAP}, NULL, d{extra}, {{{point}}}, 0 FROM p)
        WINDOW q AS (PARTITION BY {_LAP} ORDER BY x, turn)) WHERE i IS NOT NULL"""


def _of_lap(number: int, column: str) -> str:
    return f"max({column}) FILTER (WHERE completed_laps = {number})"


_PAIRED = f"""SELECT *, speed_a - speed_b AS speed_delta FROM (
    SELECT session_id, i AS grid_i, {_of_lap(0, 'x')} AS distance, {_of_lap(0, 'speed_kmh')} AS speed_a,
           {_of_lap(1, 'speed_kmh')} AS speed_b, {_of_lap(0, 'throttle')} AS throttle_a,
           {_of_lap(1, 'throttle')} AS throttle_b, {_of_lap(0, 'brake')} AS brake_a, {_of_lap(1, 'brake')} AS brake_b
    FROM v GROUP BY session_id, i HAVING count(*) = 2)"""
_PAIRED_DOUBLES = "distance speed_a speed_b throttle_a throttle_b brake_a brake_b speed_delta"
_SHARED = """, shared AS (SELECT session_id, max(lo) AS lo, min(hi) AS hi FROM bounds
    WHERE completed_laps IN (0, 1) GROUP BY session_id HAVING count(*) = 2)"""
_COMMON = _grid("""(SELECT s.session_id, l.completed_laps, s.lo, s.hi FROM shared s,
    (VALUES (0), (1)) l(completed_laps) WHERE s.lo <= s.hi)""")
# only the two laps that are compared, before any grid is laid
_TWO_LAPS_CTE = _POINTS_CTE.replace("WHERE status = 'live')", "WHERE status = 'live' AND completed_laps IN (0, 1))").replace(
    "p AS (", "p AS MATERIALIZED (", 1).replace("bounds AS (", "bounds AS MATERIALIZED (", 1)
oracle("compared_laps", _PAIRED, _PAIRED_DOUBLES, ctes=(
    f"{_TWO_LAPS_CTE}{_SHARED}, grid AS MATERIALIZED ({_COMMON}), "
    f"v AS ({_between('speed_kmh throttle brake', 'grid')})"))
oracle("compared_laps_positional", _PAIRED, _PAIRED_DOUBLES, ctes=(
    f"{_TWO_LAPS_CTE}{_SHARED}, grid AS MATERIALIZED ({_OWN_GRID}), "
    f"w AS ({_between('speed_kmh throttle brake', 'grid')}), "
    f"v AS (SELECT w.* FROM w JOIN shared s ON s.session_id = w.session_id AND w.x <= s.hi)"))

_LOSS_CTE = f"""{_POINTS_CTE.replace("p AS (", "p AS MATERIALIZED (", 1)}, best AS (
    SELECT session_id, completed_laps AS best_lap, lo, hi FROM bounds WHERE ms > 0
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ms, completed_laps) = 1),
grid AS MATERIALIZED ({_grid("(SELECT b.session_id, b.completed_laps, z.best_lap, z.lo, z.hi FROM bounds b JOIN best z USING (session_id))")}),
v AS ({_between('ms', 'grid', 'null')}),
loss AS (SELECT session_id, completed_laps, best_lap, i AS grid_i, x AS distance_into_lap,
                ms - max(ms) FILTER (WHERE completed_laps = best_lap) OVER (PARTITION BY session_id, i) AS time_delta_ms
         FROM v)"""
oracle("time_loss", "SELECT * FROM loss", "distance_into_lap time_delta_ms", ctes=_LOSS_CTE)
oracle("corner_time_loss", f"""
    SELECT l.session_id, l.completed_laps, corner,
           arg_max(time_delta_ms, grid_i) - arg_min(time_delta_ms, grid_i) AS lost_ms
    FROM loss l JOIN (SELECT DISTINCT session_id, {_TRACK_ID} AS track_id FROM t) k
         ON k.session_id = l.session_id
    JOIN corners c ON c.track_id = k.track_id AND l.distance_into_lap BETWEEN c.entry_m AND c.exit_m
    WHERE time_delta_ms IS NOT NULL GROUP BY l.session_id, l.completed_laps, corner""",
       "lost_ms", ctes=_LOSS_CTE + _CORNERS_CTE)

# ---- quality -------------------------------------------------------------------------

oracle("column_checks", """
    SELECT session_id, 76 AS expected, 0 AS missing, '' AS missing_columns, 'ok' AS verdict
    FROM t GROUP BY session_id""")


def _ranges(source: str, bounds: dict, tolerated: float = 0.05) -> str:
    def bad(f, lo, hi):
        return " OR ".join(([f"{f} < {lo}"] if lo is not None else [])
                           + ([f"{f} > {hi}"] if hi is not None else []))
    return " UNION ALL ".join(f"""
        SELECT *, CASE WHEN n = 0 THEN 'warn' WHEN out_of_range = 0 THEN 'ok'
                       WHEN out_of_range < n * {tolerated} THEN 'warn' ELSE 'fail' END AS verdict
        FROM (SELECT session_id, '{f}' AS field, count({f}) AS n, CAST(min({f}) AS DOUBLE) AS vmin,
                     CAST(max({f}) AS DOUBLE) AS vmax, {_count(bad(f, lo, hi))} AS out_of_range
              FROM {source} GROUP BY session_id)""" for f, (lo, hi) in bounds.items())


oracle("range_checks", _ranges("t", fixed.FIELD_BOUNDS), "vmin vmax")
oracle("track_range_checks", _ranges("t", fixed.FIELD_BOUNDS), "vmin vmax", samples=_BY_TRACK)
oracle("strict_range_checks", _ranges("t", fixed.HEAD_BOUNDS, 0), "vmin vmax", samples=_BY_TRACK)
oracle("required_checks", " UNION ALL ".join(f"""
    SELECT session_id, '{f}' AS field, {_count(f"{f} IS NULL OR CAST({f} AS VARCHAR) = ''")} AS empty,
           CASE WHEN {_count(f"{f} IS NULL OR CAST({f} AS VARCHAR) = ''")} = 0 THEN 'ok' ELSE 'fail' END
               AS verdict
    FROM t GROUP BY session_id""" for f in fixed.REQUIRED_FIELDS), samples=_BY_TRACK)
_BIAS = """SELECT *, CASE WHEN bias_max < 2 THEN 'warn: 0-1 scale'
        WHEN bias_avg > 40 AND bias_avg < 70 THEN 'ok' ELSE 'warn: unusual' END AS verdict
    FROM (SELECT session_id, min(brake_bias) AS bias_min, max(brake_bias) AS bias_max,
                 avg(brake_bias) AS bias_avg
          FROM t WHERE brake_bias > 0 GROUP BY session_id)"""
oracle("brake_bias_checks", _BIAS, "bias_min bias_max bias_avg", samples=_BY_TRACK)

_EVENT_CHECKS = f"""SELECT *, CASE WHEN starts = 0 THEN 'fail'
        WHEN starts = 1 AND ends = 1 AND ends_with_laps > 0 THEN 'ok' ELSE 'warn' END AS verdict, starts = 1 AND ends = 1 AS one_of_each
    FROM (SELECT session_id, session_no, {_count("event_type = 'session_start'")} AS starts,
                 {_count("event_type = 'session_end'")} AS ends,
                 {_count("event_type = 'session_end' AND total_laps > 0")} AS ends_with_laps
          FROM ({_EVENTS}) GROUP BY session_id, session_no)"""
oracle("event_checks", _EVENT_CHECKS, ctes=_STATES)

_LAP_MEASURES = f"""SELECT session_id, session_no, count(*) AS laps,
    {_count("NOT (s > 80 AND s < 200)")} AS implausible,
    {_count("NOT (s >= 90 AND s <= 150)")} AS unrealistic,
    {_count('NOT CASE WHEN i = 1 THEN lap_number = 1 ELSE lap_number = p_lap + 1 END')} AS out_of_turn,
    {_count("i > 1 AND NOT p_fuel - fuel_remaining > 0")} AS not_burning,
    avg(p_fuel - fuel_remaining) FILTER (WHERE i > 1) AS mean_burn,
    {_count("NOT is_valid")} AS invalid, {_count("lap_number * 60 > 100")} AS sectors_off
    FROM (SELECT *, lap_time_ms / 1000e0 AS s, row_number() OVER q AS i, lag(lap_number) OVER q AS p_lap,
                 lag(fuel_remaining) OVER q AS p_fuel
          FROM ({_COMPLETIONS}) WINDOW q AS (PARTITION BY session_id, session_no ORDER BY "timestamp", lap_number))
    GROUP BY session_id, session_no"""


def _check(name: str, verdict: str, value: str) -> str:
    return (f"SELECT session_id, session_no, '{name}' AS \"check\", {verdict} AS verdict, "
            f"CAST({value} AS DOUBLE) AS value FROM lm")


def _ok(condition: str, otherwise: str) -> str:
    return f"CASE WHEN {condition} THEN 'ok' ELSE '{otherwise}' END"


_LAP_CHECKS = [
    _check("lap_time_plausible", _ok("implausible = 0", "fail"), "implausible"),
    _check("lap_time_realistic", _ok("unrealistic = 0", "fail"), "unrealistic"),
    _check("laps_in_turn", _ok("out_of_turn = 0", "fail"), "out_of_turn"),
    _check("fuel_decreasing", f"CASE WHEN laps > 1 THEN {_ok('not_burning = 0', 'warn')} END", "mean_burn"),
    _check("has_invalid_lap", _ok("invalid > 0", "fail"), "invalid"),
]
_LAP_CHECKS_CTE = f"{_STATES}, lm AS ({_LAP_MEASURES})"
oracle("lap_checks", " UNION ALL ".join(
    _LAP_CHECKS + [_check("sectors_add_up", _ok("sectors_off = 0", "fail"), "sectors_off")]),
       "value", ctes=_LAP_CHECKS_CTE)
oracle("lap_report", f"""
    SELECT session_id, session_no, lap_number, {_label('lap_time_ms')} AS time, is_valid, fuel_remaining AS fuel,
           {", ".join(f"tyre_temp_{w} AS {w}" for w in fixed.WHEELS)} FROM ({_COMPLETIONS})""",
       "fuel fl fr rl rr", ctes=_STATES)
oracle("setup_report", f"""
    SELECT session_id, session_no, lap_applied_from, printf('Lap %d: TC=%d TCCut=%d ABS=%d BB=%s Map=%d',
        lap_applied_from, tc_level, tc_cut, abs_level, CAST(brake_bias AS VARCHAR), engine_map) AS line
    FROM ({_snapshots(True)})""", ctes=_STATES)
oracle("session_facts", f"""
    SELECT *, {_label('best_lap_ms')} AS best_lap
    FROM (SELECT session_id, session_no, {", ".join(f'''arg_max({c}, "timestamp") FILTER (WHERE event_type = 'session_start') AS {c}''' for c in ("track", "car", "session_type"))},
                 {", ".join(f'''arg_max({c}, "timestamp") FILTER (WHERE event_type = 'session_end') AS {c}''' for c in ("total_laps", "best_lap_ms"))}
          FROM ({_EVENTS}) GROUP BY session_id, session_no)""", ctes=_STATES)
oracle("validation_summary", f"""
    SELECT session_id, session_no, 'events' AS area, 'start_and_end' AS "check", verdict
    FROM ({_EVENT_CHECKS})
    UNION ALL SELECT session_id, session_no, 'laps', "check", verdict FROM ({" UNION ALL ".join(_LAP_CHECKS)})
    UNION ALL SELECT session_id, NULL, 'fields', field, verdict FROM ({_ranges("t", fixed.FIELD_BOUNDS)})
    UNION ALL SELECT session_id, NULL, 'brake_bias', 'scale', verdict FROM ({_BIAS})""",
       ctes=_LAP_CHECKS_CTE, samples=_BY_TRACK)

# ---- sources and sinks ---------------------------------------------------------------

_SPEED = f"round({_f('speed_kmh')}, 2) AS speed_kmh"
oracle("lake_scan", f"""
    SELECT {_LAP}, {_iso('timestamp_wall')} || '+00:00' AS timestamp_wall, status, gear, is_in_pit, {_SPEED}
    FROM t""")
oracle("lake_filter_counts", _COUNTS)


def _float_mean(prefix: str) -> str:
    total = " + ".join(f"CAST({prefix}_{w} AS FLOAT)" for w in fixed.WHEELS)
    return f"CAST({total} AS DOUBLE) / 4e0"


oracle("processed_table", f"""
    SELECT {_LAP}, epoch_us(timestamp_wall) AS timestamp_parsed, {_f('brake')} > 0.8::DOUBLE AS is_heavy_braking,
           {_f('throttle')} > 0.95::DOUBLE AS is_full_throttle,
           round({_float_mean('tyre_temp')}, 3) AS avg_tyre_temp FROM t WHERE {_PIT_OK}""")
oracle("lap_summary_table", f"""
    SELECT {_LAP}, car, track, max({_f('speed_kmh')}) AS max_speed_kmh,
           avg({_f('speed_kmh')}) AS avg_speed_kmh, avg({_float_mean('tyre_temp')}) AS avg_tyre_temp,
           avg({_float_mean('tyre_pressure')}) AS avg_tyre_pressure,
           avg({_f('fuel_remaining')}) AS avg_fuel, min({_f('fuel_remaining')}) AS min_fuel,
           {_count(f"{_f('brake')} > 0.8::DOUBLE")} AS heavy_braking_count,
           {_count(f"{_f('throttle')} > 0.95::DOUBLE")} AS full_throttle_count,
           count(*) AS sample_count, epoch_us(min(timestamp_wall)) AS lap_start_time,
           epoch_us(max(timestamp_wall)) AS lap_end_time
    FROM t WHERE {_PIT_OK} GROUP BY {_LAP}, car, track""",
       "max_speed_kmh avg_speed_kmh avg_tyre_temp avg_tyre_pressure avg_fuel min_fuel", digits=3)
ORACLES["lap_summary_increments"] = ORACLES["lap_summary_table"]
oracle("clustered_table", f"""
    SELECT {_LAP}, count(*) AS samples, max(speed_kmh) AS max_speed FROM t WHERE {_PIT_OK}
    GROUP BY {_LAP}""", "max_speed")
oracle("external_tables", f"""
    SELECT track, {_count("status = 'live'")} AS samples, {_count(_PIT_OK)} AS processed,
           count(DISTINCT CASE WHEN {_PIT_OK} THEN session_id || '/' || completed_laps END) AS laps,
           (SELECT count(*) FROM t) AS raw_rows
    FROM t GROUP BY track""")
oracle("lap_lookup", f"""
    SELECT {_LAP}, epoch_us(timestamp_wall) AS at, gear, round({_f('speed_kmh')}, 2) AS speed_kmh FROM t
    WHERE {_PIT_OK} AND completed_laps = 1
      AND session_id = (SELECT min(session_id) FROM t WHERE {_PIT_OK})""")
oracle("recording_head", f"""
    SELECT session_id, status, completed_laps, gear FROM t
    ORDER BY timestamp_wall, session_id, CAST(rpm AS INT), gear, status, completed_laps LIMIT 50""")
oracle("latest_recording", "SELECT max(session_id) AS session_id FROM t")
oracle("recording_scan", f"""
    SELECT {_LAP}, status, count(*) AS samples, round(max(speed_kmh), 2) AS max_speed
    FROM t GROUP BY {_LAP}, status""")
oracle("text_json_batches",
       "SELECT session_id, status, completed_laps, gear, is_in_pit, current_lap_time_ms FROM t")
oracle("lap_file_stats", f"""
    SELECT replace(track, ' ', '_') AS track_folder, session_id AS session_folder,
           printf('lap_%03d', completed_laps) AS lap_folder, count(*) AS rows,
           count(*) / 30e0 AS duration_s, round(max(speed_kmh), 2) AS speed_max
    FROM t WHERE NOT coalesce(is_in_pit, false) GROUP BY track, session_id, completed_laps""", "duration_s")
oracle("lap_file_schema_widths", f"""
    SELECT 55 AS columns, count(DISTINCT session_id || '/' || completed_laps) AS files
    FROM t WHERE NOT coalesce(is_in_pit, false)""")
oracle("event_files", f"""
    SELECT * EXCLUDE (session_no) REPLACE ({_iso('"timestamp"')} AS "timestamp") FROM ({_EVENTS})""",
       ctes=_STATES)
oracle("message_round_trip", f"""
    SELECT session_id AS session_key, {_iso('timestamp_wall')} || '+00:00' AS timestamp_wall, status,
           completed_laps, gear, is_in_pit, {_SPEED} FROM t""")

# ---- streams -------------------------------------------------------------------------

oracle("stream_append", """
    SELECT session_id AS session_key, completed_laps, status, count(*) AS samples,
           round(max(speed_kmh), 2) AS max_speed FROM t GROUP BY ALL""")
oracle("stream_without_repeats", "SELECT session_id, packet_id, status FROM t")

_US = "epoch_us(timestamp_wall) AS ts_us"


def _stream(name, body, doubles="", ctes=_STATES):
    oracle(name, body, doubles, ctes=ctes)


_stream("stream_session_starts",
        f"SELECT session_id, {_US}, session_no, car, track, session_type FROM n WHERE opens")
_stream("stream_session_ends", f"""
    SELECT session_id, {_US}, session_no, p_car AS car, p_track AS track, p_session_type AS session_type,
           p_completed_laps AS total_laps, p_best_lap_time_ms AS best_lap_ms FROM n WHERE closes""")
_stream("stream_lap_completions", f"""
    SELECT * EXCLUDE ("timestamp"), epoch_us("timestamp") AS ts_us FROM ({_COMPLETIONS})""",
        _COMPLETION_DOUBLES)
_stream("stream_setup_changes", f"""
    SELECT * EXCLUDE ("timestamp"), epoch_us("timestamp") AS ts_us FROM ({_CHANGES})""", "old_value new_value")
_stream("stream_setup_snapshots", f"""
    SELECT * EXCLUDE ("timestamp") REPLACE ({", ".join(f"CAST({p} AS DOUBLE) AS {p}" for p in fixed.SETUP_PARAMETERS)}),
           epoch_us("timestamp") AS ts_us FROM ({_snapshots(False)})""", " ".join(fixed.SETUP_PARAMETERS))
_stream("stream_lap_segments", """
    SELECT session_id, epoch_us(last_time) AS ts_us, session_no, segment_no, lap_number, samples,
           max_speed, avg_speed, fuel_used, epoch_us(first_time) AS first_us, epoch_us(last_time) AS last_us
    FROM segments""",
        "max_speed avg_speed fuel_used", ctes=_SEGMENTS_CTE)

oracle("stored_sessions", f"""
    SELECT s.* REPLACE ({_iso('start_time')} AS start_time), {_iso('e.end_time')} AS end_time,
           coalesce(e.total_laps, 0) AS total_laps, e.best_lap_ms
    FROM starts s LEFT JOIN ends e USING (session_id)""", ctes=_KEYED_CTE)
oracle("stored_laps", f"""
    SELECT session_id || '_' || session_no AS session_id, completed_laps + 1 AS lap_number,
           max(current_lap_time_ms) AS lap_time_ms, min(fuel_remaining) AS fuel_remaining,
           CAST(NULL AS INT) AS sector_1_ms, {_iso('max(timestamp_wall)')} AS "timestamp"
    FROM n WHERE member GROUP BY session_id, session_no, completed_laps""", "fuel_remaining", ctes=_STATES)
oracle("stored_setups", f"""
    SELECT DISTINCT session_id || '_' || session_no AS session_id, lap_applied_from AS lap_number, car,
           {_PARAMETERS}, {_iso('"timestamp"')} AS "timestamp"
    FROM ({_snapshots(False)})""", "brake_bias", ctes=_STATES)
_LEFT = """SELECT '{0}' AS stored, sid AS session_id, count(*) AS rows FROM (
    SELECT DISTINCT session_id, session_id || '_' || session_no AS sid, {1} FROM ({2}))
    WHERE CAST(substr(session_id, 2) AS BIGINT) % 5 <> 0 GROUP BY sid"""
oracle("stored_after_delete", " UNION ALL ".join([
    _LEFT.format("sessions", "1", "SELECT * FROM n WHERE opens"),
    _LEFT.format("laps", "completed_laps", "SELECT * FROM n WHERE member"),
    _LEFT.format("setups", f'lap_applied_from, car, {_PARAMETERS}, "timestamp"', _snapshots(False))]), ctes=_STATES)
oracle("quarantined_messages", f"""
    SELECT 'lap_completions' AS topic, {_count("status = 'replay'")} AS messages FROM t""")

# the same, whatever the slices
for _name in ("sessionized", "session_events", "lap_segments", "resampled_laps", "sector_crossings"):
    ORACLES[f"{_name}_in_slices"] = ORACLES[_name]

assert set(COLUMNS) >= set(schemas.SAMPLE.names)
