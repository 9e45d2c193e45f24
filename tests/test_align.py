"""Resampling against numpy.interp, and the two ways to pair laps."""

import random
import re

import numpy as np
import pytest

from lapline.operators import align


@pytest.fixture(scope="module")
def lap_rows():
    """Laps with equal distances, one with a single sample, one that stands still."""
    rng = random.Random(5)
    rows = []
    for lap, count in ((0, 40), (1, 25), (2, 1), (3, 400)):
        distances = sorted(round(rng.uniform(10 * lap, 500 + 40 * lap), 1) for _ in range(count))
        distances[count // 2] = distances[count // 2 - 1]
        rows += [{"completed_laps": lap, "distance_into_lap": d, "speed_kmh": rng.uniform(50, 250),
                  "throttle": rng.random(), "brake": rng.random()} for d in distances]
    rows += [{"completed_laps": 4, "distance_into_lap": 7.0, "speed_kmh": float(v)} for v in (1, 2, 3)]
    return [{**r, "packet_id": i} for i, r in enumerate(rows)]


def interpolated(rows, lap, n, column="speed_kmh", lo=None, hi=None):
    points = [(r["distance_into_lap"], r[column]) for r in rows if r["completed_laps"] == lap]
    d, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    if len(d) < 2 and lo is None:
        return d, y
    x = np.linspace(d.min() if lo is None else lo, d.max() if hi is None else hi, n)
    return x, np.interp(x, d, y)


@pytest.mark.parametrize("n, rows_per_slice", [(1000, 1_000_000), (50, 1_000_000), (50, 10), (2, 10)])
def test_resample_equals_numpy(samples, lap_rows, n, rows_per_slice):
    got = align.resample(samples(lap_rows), ["speed_kmh"], n, rows_per_slice=rows_per_slice).collect()
    for lap in range(4):
        mine = sorted((r for r in got if r.completed_laps == lap), key=lambda r: r.grid_i)
        x, y = interpolated(lap_rows, lap, n)
        assert [r.grid_i for r in mine] == list(range(len(x)))
        assert np.allclose([r.distance_into_lap for r in mine], x, rtol=0, atol=1e-9)
        assert np.allclose([r.speed_kmh for r in mine], y, rtol=0, atol=1e-9)
        assert mine[0].distance_into_lap == x[0] and mine[-1].distance_into_lap == x[-1]
    still = [r for r in got if r.completed_laps == 4]
    assert len(still) == n and {r.speed_kmh for r in still} == {3.0}


def test_samples_are_shuffled_once(spark, samples, lap_rows):
    """To the slices of their laps: neither bounds nor cells move them again, whatever can't be broadcast by itself."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        df = align.resample(samples(lap_rows), ["speed_kmh"], 50, rows_per_slice=10)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and not re.search(r"Exchange hashpartitioning\([^)]*\bu#", plan)
        cut, whole = ({tuple(r) for r in align.resample(samples(lap_rows), ["speed_kmh"], 50, rows_per_slice=size).collect()}
                      for size in (3, 1_000_000))
    finally:
        spark.conf.set(name, before)
    assert cut == whole and len(whole) == 4 * 50 + 1


def test_laps_without_a_name_have_no_grid(samples, lap_rows):
    rows = [{**r, "session_id": None if r["completed_laps"] == 1 else "s"} for r in lap_rows]
    rows = [{**r, "completed_laps": None if r["completed_laps"] == 0 else r["completed_laps"]} for r in rows]
    got = align.resample(samples(rows), ["speed_kmh"], 50).groupBy("completed_laps").count().collect()
    assert {tuple(r) for r in got} == {(2, 1), (3, 50), (4, 50)}


def test_given_grid_clamps_or_leaves_out(spark, samples, lap_rows):
    t = samples(lap_rows).where("completed_laps < 2")
    grid = spark.createDataFrame([("s", 0, -50.0, 900.0), ("s", 1, 100.0, 300.0)],
                                 "session_id string, completed_laps int, lo double, hi double")
    for outside in ("clamp", "null"):
        got = align.resample(t, ["speed_kmh"], 101, grid=grid, outside=outside).collect()
        for lap, lo, hi in ((0, -50.0, 900.0), (1, 100.0, 300.0)):
            x, y = interpolated(lap_rows, lap, 101, lo=lo, hi=hi)
            own = [r["distance_into_lap"] for r in lap_rows if r["completed_laps"] == lap]
            mine = sorted((r for r in got if r.completed_laps == lap), key=lambda r: r.grid_i)
            assert len(mine) == 101
            for r, xi, yi in zip(mine, x, y):
                if outside == "null" and not min(own) <= xi <= max(own):
                    assert r.speed_kmh is None
                else:
                    assert r.speed_kmh == pytest.approx(yi, abs=1e-9)


def test_positional_pairs_points_by_number(samples, lap_rows):
    got = align.compare_laps(samples(lap_rows), 0, 1, 100, align="positional").collect()
    (xa, ya), (xb, yb) = (interpolated(lap_rows, lap, 100) for lap in (0, 1))
    end = min(xa.max(), xb.max())
    n = min((xa <= end).sum(), (xb <= end).sum())
    assert len(got) == n
    for r in got:
        assert r.speed_delta == pytest.approx(ya[r.grid_i] - yb[r.grid_i], abs=1e-9)


def test_common_puts_both_on_one_grid(samples, lap_rows):
    got = align.compare_laps(samples(lap_rows), 0, 1, 100).collect()
    own = [[r["distance_into_lap"] for r in lap_rows if r["completed_laps"] == lap] for lap in (0, 1)]
    lo, hi = max(map(min, own)), min(map(max, own))
    x, ya = interpolated(lap_rows, 0, 100, lo=lo, hi=hi)
    _, yb = interpolated(lap_rows, 1, 100, lo=lo, hi=hi)
    assert len(got) == 100
    for r in got:
        assert (r.distance, r.speed_a, r.speed_b) == (
            pytest.approx(x[r.grid_i]), pytest.approx(ya[r.grid_i]), pytest.approx(yb[r.grid_i]))


def test_time_loss_against_itself_is_zero(samples):
    rows = [{"completed_laps": lap, "distance_into_lap": float(d), "current_lap_time_ms": d * (10 + lap)}
            for lap in (0, 1) for d in range(0, 101, 10)]
    got = align.time_loss(samples(rows), 11).orderBy("completed_laps", "grid_i").collect()
    assert {r.best_lap for r in got} == {0}
    assert [r.time_delta_ms for r in got if r.completed_laps == 0] == [0.0] * 11
    assert [r.time_delta_ms for r in got if r.completed_laps == 1] == pytest.approx([10.0 * i for i in range(11)])


def test_comparisons_shuffle_samples_not_grid_points(samples, lap_rows):
    t = samples(lap_rows)
    for compared in (align.compare_laps(t, 0, 1), align.compare_laps(t, 0, 1, align="positional"), align.time_loss(t)):
        plan = compared._jdf.queryExecution().optimizedPlan().toString()
        # every window, join and aggregate is below the line that writes out the grid points
        above = plan[:plan.index("Generate explode(sequence(")]
        assert not any(word in above for word in ("Aggregate", "Window", "Join"))
