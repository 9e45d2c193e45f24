"""Laps on a grid of evenly spaced distances, and comparisons on that grid.

A grid point needs two samples: the last one at or before it and the first one
after it. Samples are grouped by the grid interval they fall into (combined before
the shuffle), which leaves at most n rows per lap however many samples it has. Each
row then knows the next one, covers the grid points in between, and those are
written out without another shuffle or sort. Laps are compared before that: the
covering rows of both are merged, and grid points are written out of the pairs.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapline import fixed_values as fixed
from lapline.functions import columns as C
from lapline.operators.laps import LAP
from lapline.operators.ordered import ROWS_PER_SLICE, Slices, time_order

DISTANCE = "distance_into_lap"


def lap_bounds(samples: DataFrame, keys=tuple(LAP)) -> DataFrame:
    d = F.col(DISTANCE).cast("double")
    return samples.groupBy(*keys).agg(
        F.min(d).alias("lo"), F.max(d).alias("hi"), F.count(d).alias("n")
    ).where("n > 0")


def _grid_distance(i: Column, n: int) -> Column:
    step = (F.col("hi") - F.col("lo")) / F.lit(float(n - 1))
    return F.when(i >= n - 1, F.col("hi")).otherwise(i * step + F.col("lo"))


def _interval(n: int) -> Column:
    """Index of the first grid point at or after the sample; n where there is none."""
    d, span = F.col("_d"), F.col("hi") - F.col("lo")
    guess = F.when(span > 0, F.ceil((d - F.col("lo")) / (span / F.lit(float(n - 1))))).otherwise(0)
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(n - 1))
    # the division may land one off the grid point as computed
    near = (
        F.when((guess > 0) & (_grid_distance(guess - 1, n) >= d), guess - 1)
        .when(_grid_distance(guess, n) < d, guess + 1).otherwise(guess)
    )
    return F.when(d > F.col("hi"), F.lit(n)).otherwise(near).cast("int")


def _value(c: str, outside: str = "clamp", side: str = "") -> Column:
    """A column at the grid distance ``x`` from the covering row's samples, see ``resample``."""
    x = F.col(f"{side}x")
    ya, yb, da, db = (F.col(f"{side}{s}.{k}") for k in (c, "_d") for s in "ab")
    inner = (yb - ya) / (db - da) * (x - da) + ya
    before = F.lit(None).cast("double") if outside == "null" else yb
    after = F.when(x == da, ya) if outside == "null" else ya
    return F.when(F.col(f"{side}a").isNull(), before).when(F.col(f"{side}b").isNull(), after).otherwise(inner)


def resample(samples: DataFrame, columns: list[str], n: int = fixed.GRID_POINTS,
             grid: DataFrame | None = None, keys=tuple(LAP), outside: str = "clamp",
             rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Linear interpolation of ``columns`` at n distances of every lap.

    The grid spans each lap's own distances, or what ``grid`` (keys, lo, hi) says; a
    ``grid`` that also has the number of samples ``n`` spares counting them again.
    Grid points a lap does not reach take its end values, or NULL with
    ``outside="null"``. A lap of one sample is given as it is. Of several samples at
    one distance the last counts before it and the first after it.
    """
    filled = _covering(samples, columns, n, grid, keys, rows_per_slice).withColumn(
        "grid_i", F.explode(F.sequence("_first", "_last"))
    ).withColumn("x", _grid_distance(F.col("grid_i"), n))
    return filled.select(
        *keys, "grid_i", F.col("x").alias(DISTANCE), *[_value(c, outside).alias(c) for c in columns]
    )


def _covering(samples: DataFrame, columns: list[str], n: int, grid: DataFrame | None = None, keys=tuple(LAP),
              rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Rows (keys, lo, hi, a, b, _first, _last): grid points _first to _last lie between the samples a and b."""
    keys = list(keys)
    order = [c for c in time_order(samples) if c not in keys]
    rows = samples.where(F.col(DISTANCE).isNotNull()).select(
        *keys, F.col(DISTANCE).cast("double").alias("_d"), *order,
        *[F.col(c).cast("double").alias(c) for c in columns],
    )
    # the columns come last: by then the order is decided
    sample = F.struct("_d", *order, *columns)
    cell = [F.max("s").alias("a"), F.min("s").alias("s_first"),
            F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n")]
    if grid is None:
        named = rows.dropna(subset=keys)  # a lap that has no name has no grid
        return _covering_own(Slices(named, keys, ["_d"], rows_per_slice), sample, cell, n)
    if "n" in grid.columns:
        bounds = grid.select(*keys, "lo", "hi", "n")
    else:
        bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(grid.select(*keys, "lo", "hi"), keys)
    cells = Slices(rows, keys, ["_d"], rows_per_slice).join_per_key(bounds).select(
        *keys, _interval(n).alias("u"), sample.alias("s"), "lo", "hi", "n"
    ).groupBy(*keys, "u").agg(*cell)
    # a grid may begin before the first sample
    cells = cells.unionByName(
        bounds.select(*keys, F.lit(-1).alias("u"), "lo", "hi", "n"), allowMissingColumns=True
    )
    # at most n + 2 rows per lap from here on; each one covers the grid points up to the next
    following = Window.partitionBy(*keys).orderBy("u")
    size = F.lit(n)
    last = F.least(F.coalesce(F.lead("u").over(following), size), size) - 1
    first = F.greatest("u", F.lit(0))
    return cells.select(
        *keys, "lo", "hi", "a", F.lead("s_first").over(following).alias("b"),
        first.alias("_first"), last.alias("_last"),
    ).where("_first <= _last")


def _covering_own(slices: Slices, sample: Column, cell: list[Column], n: int) -> DataFrame:
    """The covering rows on the grid of each lap's own distances.

    Rows are shuffled once, to their slice: a slice is a stretch of distances, so cells and what follows them lie there
    already, and only what a slice has to know of others comes from a small table.
    """
    placed = slices.per_key(lo=F.min, hi=F.max, n=F.count)
    placed = placed.replace(placed.rows.withColumns({"u": _interval(n), "s": sample}))
    cells = placed.grouped("u", *cell)
    size = F.when(F.col("n") < 2, 1).otherwise(n)
    last = F.least(F.coalesce(F.col("_next.u"), size), size) - 1
    # a cell that a cut divides ends before it begins in all slices but its last
    return cells.look_back(_next=cells.following("u", "s_first")).result.select(
        *slices.keys, "lo", "hi", "a", F.col("_next.s_first").alias("b"),
        F.greatest("u", F.lit(0)).alias("_first"), last.alias("_last"),
    ).where("_first <= _last")


def _pairs(covering: DataFrame, by: list[str], left: Column, n: int) -> DataFrame:
    """Grid points that both the left rows and the others of a key cover, as structs ``l`` and ``r``.

    Wherever a covering row begins, the last one of either side that has begun by then holds up to the next beginning.
    """
    here = Window.partitionBy(*by).orderBy("_first")  # rows that begin together see each other
    row = F.struct(*[c for c in covering.columns if c not in {*by, "_first"}])
    merged = covering.select(
        *by, "_first", F.lead("_first").over(here).alias("_next"),
        F.last(F.when(left, row), ignorenulls=True).over(here).alias("l"),
        F.last(F.when(~left, row), ignorenulls=True).over(here).alias("r"),
    ).where("l IS NOT NULL AND r IS NOT NULL")
    end = F.least(F.coalesce(F.col("_next") - 1, F.lit(n - 1)), "l._last", "r._last")
    return merged.withColumn("_end", end).where("_first <= _end").drop("_next")


def _grid_points(pairs: DataFrame, n: int) -> DataFrame:
    """A row per grid point, with its distance on the grid of either side."""
    rows = pairs.withColumn("grid_i", F.explode(F.sequence("_first", "_end")))
    for side in "lr":
        lo, hi, i = F.col(f"{side}.lo"), F.col(f"{side}.hi"), F.col("grid_i")
        rows = rows.withColumn(f"{side}x", F.when(i >= n - 1, hi).otherwise(
            i * ((hi - lo) / F.lit(float(n - 1))) + lo)).withColumns(
            {f"{side}{s}": F.col(f"{side}.{s}") for s in "ab"})
    return rows


COMPARED = {"speed": "speed_kmh", "throttle": "throttle", "brake": "brake"}


def compare_laps(samples: DataFrame, lap_a: int, lap_b: int, n: int = fixed.GRID_POINTS,
                 align: str = "common") -> DataFrame:
    """Two laps of each session point by point; positive delta: lap a is faster.

    ``common`` puts both on one grid over the distance they share. ``positional``
    gives each its own grid, cuts both at the shorter lap's end and pairs points by
    their number, so that paired points may lie at different distances.
    """
    lap = F.col("completed_laps")
    two = samples.where(C.is_live() & lap.isin(lap_a, lap_b))
    bounds = lap_bounds(two)
    shared = bounds.groupBy("session_id").agg(
        F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.count(F.lit(1)).alias("_laps")
    ).where("_laps = 2").drop("_laps")
    values = list(COMPARED.values())
    if align == "common":
        grid = shared.where("lo <= hi").withColumn(
            "completed_laps", F.explode(F.array(F.lit(lap_a), F.lit(lap_b)))
        )
        covering = _covering(two, values, n, grid=grid)
    elif align == "positional":
        covering = _covering(two, values, n)
    else:
        raise ValueError(f"align is common or positional, not {align!r}")

    ends = shared.select("session_id", F.col("hi").alias("_shared"))
    points = _grid_points(_pairs(covering, ["session_id"], lap == lap_a, n).join(ends, "session_id"), n)
    if align == "positional":
        points = points.where((F.col("lx") <= F.col("_shared")) & (F.col("rx") <= F.col("_shared")))
    return points.select(
        "session_id", "grid_i", F.col("lx").alias("distance"),
        *[_value(column, side=side).alias(f"{name}_{label}")
          for name, column in COMPARED.items() for side, label in (("l", "a"), ("r", "b"))],
    ).withColumn("speed_delta", F.col("speed_a") - F.col("speed_b"))


def time_loss(samples: DataFrame, n: int = fixed.GRID_POINTS, of_session: DataFrame | None = None) -> DataFrame:
    """Time behind the session's best lap at each grid point of that lap's distance.

    NULL where a lap has no samples around the point. Columns of ``of_session`` (session_id, ...) go to each point of
    the session, joined before points are written out.
    """
    live = samples.where(C.is_live() & F.col("completed_laps").isNotNull())
    d = F.col(DISTANCE).cast("double")
    laps = live.where(d.isNotNull()).groupBy(*LAP).agg(
        F.max("current_lap_time_ms").alias("ms"), F.min(d).alias("lo"), F.max(d).alias("hi"),
        F.count(F.lit(1)).alias("n"))
    # over the laps of a session, which are one row each by now
    whole = Window.partitionBy("session_id")
    best = F.min(F.when(F.col("ms") > 0, F.struct("ms", "completed_laps", "lo", "hi"))).over(whole)
    grid = laps.withColumn("best", best).where("best is not null").select(
        *LAP, "best.lo", "best.hi", "n", F.col("best.completed_laps").alias("best_lap"))
    covering = _covering(live, ["current_lap_time_ms"], n, grid=grid)
    # the best lap's rows go to each lap of the session, at most n + 2 of them
    copies = grid.select(*LAP, "best_lap").join(
        covering.withColumnRenamed("completed_laps", "best_lap"), ["session_id", "best_lap"])
    sides = covering.withColumns({"best_lap": F.lit(None).cast("int"), "_own": F.lit(True)}).unionByName(
        copies.withColumn("_own", F.lit(False)))
    pairs = _pairs(sides, LAP, F.col("_own"), n)
    extra = []
    if of_session is not None:
        extra = [c for c in of_session.columns if c != "session_id"]
        pairs = pairs.join(of_session, "session_id")
    time = "current_lap_time_ms"
    return _grid_points(pairs, n).select(
        *LAP, F.col("r.best_lap").alias("best_lap"), "grid_i", F.col("lx").alias(DISTANCE),
        (_value(time, "null", "l") - _value(time, "null", "r")).alias("time_delta_ms"), *extra,
    )
