"""Track files, track names, and samples in corners, sectors and braking zones."""

import json

import pytest

from lapline import fixed_values as fixed
from lapline.operators import align, track
from lapline.sources import tracks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tracks")
    for track_id, name, length, bounds in fixed.TRACKS:
        corners = {c[1]: {"entry_m": c[2], "apex_m": c[3], "exit_m": c[4], "braking_zone_start_m": c[5],
                          "typical_speed_range_kmh": [c[6], c[7]]} for c in fixed.CORNERS if c[0] == track_id}
        (path / f"{track_id}.json").write_text(json.dumps({
            "track_name": name, "track_id": track_id, "track_length_m": length, "sector_count": 3,
            "sector_boundaries_m": list(bounds), "corners": corners}, indent=2))
    return str(path)


def test_files_give_the_known_tracks(spark, folder):
    for read, known in ((tracks.read_corners, tracks.known_corners), (tracks.read_sectors, tracks.known_sectors)):
        a, b = read(spark, folder), known(spark)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(
            map(str, b.select(sorted(b.columns)).collect()))


NAMES = [("Autodromo di MONZA", "monza"), ("spa", "spa"), ("Imola", None), (None, None),
         ("monza to spa", "monza")]


@pytest.mark.parametrize("more", [0, 1500])
def test_first_file_whose_name_is_part_of_the_track(spark, more):
    """A list of any length, and tracks without a name, an id or both match no text by that."""
    df = spark.createDataFrame([(n,) for n, _ in NAMES], "track string")
    known = tracks.known_corners(spark).select("file", "track_id", "track_name")
    odd = spark.createDataFrame(
        [("a.json", "zz", None), ("b.json", None, None), ("c.json", "", "")]
        + [(f"x{i}.json", f"other{i}", f"Elsewhere {i}") for i in range(more)],
        "file string, track_id string, track_name string")
    got = {r.track: r.track_id for r in track.resolve_tracks(df, known.unionByName(odd)).collect()}
    assert got == dict(NAMES)


def test_shared_border_counts_in_both_corners(spark, samples):
    t = samples([{"distance_into_lap": d, "speed_kmh": v} for d, v in ((370.0, 80.0), (371.0, 60.0), (600.0, 9.0))])
    rows = {r.corner: r for r in track.corner_stats(t, tracks.known_corners(spark)).collect()}
    assert set(rows) == {"T1 Rettifilo", "T2 Variante della Roggia"}
    second = rows["T2 Variante della Roggia"]
    assert (second.min_speed, second.avg_speed, second.ref_low, second.delta_to_ref_low) == (60.0, 70.0, 60, 0.0)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_zones_without_broadcast_give_the_same(spark, samples, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        t = samples([{"distance_into_lap": float(d), "completed_laps": d % 7} for d in range(0, 5793, 13)])
        got = track.samples_in_corners(t, tracks.known_corners(spark)).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sum(c[2] <= d <= c[4] for d in range(0, 5793, 13) for c in fixed.CORNERS if c[0] == "monza")


def test_zone_without_braking_start_is_left_out(spark, samples):
    t = samples([{"track": "Spa", "distance_into_lap": d, "brake": b, "speed_kmh": s}
                 for d, b, s in ((105.0, 0.0, 200.0), (120.0, 0.9, 150.0), (230.0, 0.2, 70.0), (640.0, 0.5, 200.0))])
    rows = track.braking_zones(t, tracks.known_corners(spark)).collect()
    assert [(r.corner, r.brake_point_m, r.peak_brake, r.entry_speed, r.min_speed) for r in rows] == [
        ("T1_La_Source", 120.0, 0.9, 200.0, 70.0)]


def test_sectors_add_up(spark, samples):
    t = samples([{"distance_into_lap": d, "current_lap_time_ms": ms}
                 for d, ms in ((0.0, 0), (2059.0, 30000), (2060.0, 30500), (4149.0, 61000), (5700.0, 99000))])
    row = track.sector_times(t, tracks.known_sectors(spark)).first()
    assert (row.sector_1_ms, row.sector_2_ms, row.sector_3_ms, row.lap_time_ms) == (30000, 31000, 38000, 99000)


def test_time_lost_in_a_corner(spark, samples):
    rows = [{"completed_laps": lap, "distance_into_lap": float(d),
             "current_lap_time_ms": d * 10 + (300 if lap and d > 320 else 0)} for lap in (0, 1) for d in range(0, 5001, 5)]
    t = samples(rows)
    losses = align.time_loss(t, 1001).crossJoin(t.select("track").limit(1))
    got = {(r.completed_laps, r.corner): r.lost_ms
           for r in track.corner_time_loss(losses, tracks.known_corners(spark)).collect()}
    assert got[(1, "T1_Rettifilo")] == pytest.approx(300)
    assert got[(1, "T2_Variante_della_Roggia")] == pytest.approx(0) == got[(0, "T1_Rettifilo")]


def test_moments_at_which_a_lap_passes_the_borders(spark, samples):
    """Between two samples by the straight line; the first time only; NULL where no two samples lie around."""
    first, second = fixed.TRACKS[0][3][1:3]
    lap = [(0, 0), (first - 10, 20_000), (first + 30, 24_000), (first - 5, 25_000), (first + 5, 26_000),
           (second, 50_000), (second + 100, 60_000)]
    rows = [{"track": "Monza", "distance_into_lap": float(d), "current_lap_time_ms": ms} for d, ms in lap]
    rows += [{"track": "Monza", "completed_laps": 1, "distance_into_lap": float(first + 1 + i), "current_lap_time_ms": i}
             for i in range(3)]
    rows += [{"track": "nowhere", "completed_laps": 2}]
    t = samples([{**r, "packet_id": i} for i, r in enumerate(rows)])
    for size in (1_000_000, 2):
        got = {r.completed_laps: r for r in track.sector_crossings(t, tracks.known_sectors(spark), size).collect()}
        assert (got[0].sector_1_ms, got[0].sector_2_ms, got[0].sector_3_ms) == (21_000, 29_000, 10_000)
        assert got[0].lap_time_ms == 60_000
        assert [got[n].sector_1_ms for n in (1, 2)] == [None, None] and got[1].sector_3_ms is None
    from lapline.operators import quality

    sums = quality.sector_sums(track.sector_crossings(t, tracks.known_sectors(spark))).first()
    assert (sums.laps, sums.unmeasured, sums.sectors_off, sums.verdict) == (3, 2, 0, "ok")
