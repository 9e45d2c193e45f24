"""Sessions, laps and setups found in the stream of samples.

A session opens on the first live sample and closes on the first ``off`` or
``pause``; any other status changes nothing. So the state before a sample is the
last of live/off/pause seen, and that one look back answers everything: whether a
live sample opens a session, and which live sample of the same session it follows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapline import fixed_values as fixed
from lapline.functions import columns as C
from lapline.operators.ordered import ROWS_PER_SLICE, SLICE, Slices, order_key, time_order

KEY = ["session_id"]
#: A session: its stream and its number there.
SESSION = ["session_id", "session_no"]


def _changes_state() -> Column:
    return F.col("status").isin("live", "off", "pause")


def _was_live() -> Column:
    return F.coalesce(F.col("_before.status") == "live", F.lit(False))


def _opens() -> Column:
    return F.coalesce(C.is_live(), F.lit(False)) & ~_was_live()


def _member() -> Column:
    return F.when(_changes_state(), C.is_live()).otherwise(_was_live())


def _lap_ends(previous: Column) -> Column:
    return F.coalesce((F.col("completed_laps") > previous) & (previous >= 0), F.lit(False))


def _inside_slices(rows: DataFrame, slices: Slices, extra: tuple, any_row: tuple) -> DataFrame:
    """What a row knows of the rows before it in its slice, and counts for either state.

    ``_opens_live`` and ``_opens_else`` count openings up to the row if a session was live
    before the slice, or was not; ``_cuts_*`` count cuts between laps, except at the first row.
    """
    window = slices._window
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(_changes_state(), F.struct("status", *extra))
    looked = rows.withColumns({
        "_in": F.last(known, ignorenulls=True).over(before),
        "_lag": F.lag(F.struct("completed_laps", *any_row)).over(window),
    })
    live = F.coalesce(C.is_live(), F.lit(False))
    counts = {}
    for state, given in (("live", True), ("else", False)):
        was = F.coalesce(F.col("_in.status") == "live", F.lit(given))
        opens = live & ~was
        member = F.when(_changes_state(), live).otherwise(was)
        cuts = opens | (member & _lap_ends(F.col("_lag.completed_laps")))
        counts[f"_opens_{state}"] = F.sum(opens.cast("long")).over(upto)
        counts[f"_cuts_{state}"] = F.sum(cuts.cast("long")).over(upto)
    return looked.withColumns(counts)


def _handed_on(slices: Slices, extra: tuple, any_row: tuple) -> DataFrame:
    """One row per slice of a cut key: what the slices before it hand on.

    A slice's counts are chosen by the state that reaches it, so one look is enough.
    """
    told = list(dict.fromkeys(("status", "completed_laps", *extra, *any_row)))
    cut = slices.rows.where("_is_cut").select(*slices.keys, SLICE, *slices.order, *told)
    known = F.when(_changes_state(), F.struct(*slices.order))
    place = F.struct(*slices.order)
    tails = _inside_slices(cut, slices, extra, any_row).groupBy(*slices.keys, SLICE).agg(
        F.max_by(F.struct("status", *extra), known).alias("known"),
        F.max_by(F.struct("completed_laps", *any_row), place).alias("last"),
        F.min_by(F.struct("status", "completed_laps"), place).alias("first"),
        *[F.max(c).alias(c) for c in ("_opens_live", "_opens_else", "_cuts_live", "_cuts_else")],
    )
    along = Window.partitionBy(*slices.keys).orderBy(SLICE)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    reached = tails.select(
        "*", F.last("known", ignorenulls=True).over(earlier).alias("_known_in"),
        F.lag("last").over(along).alias("_last_in"),
    ).withColumn("_live_in", F.coalesce(F.col("_known_in.status") == "live", F.lit(False)))
    chosen = lambda kind: F.when(F.col("_live_in"), F.col(f"_{kind}_live")).otherwise(F.col(f"_{kind}_else"))
    status, count = F.col("first.status"), F.col("_last_in.completed_laps")
    first_cuts = F.col("_live_in") & ~F.coalesce(status.isin("off", "pause"), F.lit(False)) & F.coalesce(
        (F.col("first.completed_laps") > count) & (count >= 0), F.lit(False))
    counted = reached.withColumns({"_first_cut": first_cuts.cast("long"), "_opened": chosen("opens")}).withColumn(
        "_cut", chosen("cuts") + F.col("_first_cut"))
    return counted.select(
        *slices.keys, SLICE, "_known_in", "_last_in", "_live_in",
        F.coalesce(F.sum("_opened").over(earlier), F.lit(0)).alias("_opened_in"),
        (F.coalesce(F.sum("_cut").over(earlier), F.lit(0)) + F.col("_first_cut")).alias("_cut_in"),
    )


def _with_state(samples: DataFrame, rows_per_slice: int, extra: tuple = (), any_row: tuple = ()) -> DataFrame:
    """Adds ``_before`` (last live/off/pause row), ``_prev`` (last row of any status), and the numbers of sessions
    and of segments begun up to the row. One exchange of the rows; keys that are cut give their few columns once
    more."""
    slices = Slices(samples, KEY, time_order(samples), rows_per_slice)
    inside = _inside_slices(slices.rows, slices, extra, any_row)
    # one row per cut, see Slices
    joined = inside.join(F.broadcast(_handed_on(slices, extra, any_row)), [*KEY, SLICE], "left")
    live = F.coalesce("_live_in", F.lit(False))

    def number(kind: str, carried: str) -> Column:
        return F.when(live, F.col(f"_{kind}_live")).otherwise(F.col(f"_{kind}_else")) + F.coalesce(
            carried, F.lit(0).cast("long"))

    numbered = joined.withColumns({
        "_before": F.coalesce("_in", "_known_in"), "_prev": F.coalesce("_lag", "_last_in"),
        "session_no": number("opens", "_opened_in"), "segment_no": number("cuts", "_cut_in"),
    })
    return Slices.done(numbered).drop(
        "_in", "_lag", "_known_in", "_last_in", "_live_in", "_opened_in", "_cut_in",
        "_opens_live", "_opens_else", "_cuts_live", "_cuts_else")


def sessionize(samples: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Samples inside a session, numbered from 1 within their stream.

    The sample that opens a session belongs to it, the one that closes it does not.
    """
    return _with_state(samples, rows_per_slice).where(_member()).drop("_before", "_prev", "segment_no")


def session_events(samples: DataFrame, rows_per_slice: int = ROWS_PER_SLICE,
                   platform: str = "ACC") -> DataFrame:
    """One start and one end row per session; an open session has no end row.

    An end row takes laps, best lap, car, track and type from the sample before it.
    """
    state = _with_state(samples, rows_per_slice, any_row=("track", "car", "session_type", "best_lap_time_ms"))
    opens, closes = _opens(), F.col("status").isin("off", "pause") & _was_live()
    marked = state.withColumn(
        "event_type", F.when(opens, "session_start").when(closes, "session_end")
    ).where(F.col("event_type").isNotNull())
    ended = F.col("event_type") == "session_end"

    def from_sample(name):
        return F.when(ended, F.col(f"_prev.{name}")).otherwise(F.col(name)).alias(name)

    return marked.select(
        "event_type", *SESSION, F.lit(platform).alias("platform"),
        *[from_sample(c) for c in ("track", "car", "session_type")],
        F.col("timestamp_wall").alias("timestamp"),
        F.when(ended, F.col("_prev.completed_laps")).alias("total_laps"),
        F.when(ended, F.col("_prev.best_lap_time_ms")).alias("best_lap_ms"),
    )


def lap_completions(samples: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """A row where the lap count of a live sample exceeds that of the live sample before it."""
    state = _with_state(samples, rows_per_slice, extra=("completed_laps",))
    before = F.col("_before.completed_laps")
    crossed = C.is_live() & _was_live() & (F.col("completed_laps") > before) & (before >= 0)
    return state.where(crossed).select(
        *SESSION, F.col("completed_laps").alias("lap_number"),
        F.col("last_lap_time_ms").alias("lap_time_ms"), "last_sector_time_ms",
        F.col("is_valid_lap").alias("is_valid"), "fuel_remaining",
        *C.wheel_columns("tyre_temp"), *C.wheel_columns("tyre_pressure"),
        F.col("timestamp_wall").alias("timestamp"),
    )


def _changed(parameter: str) -> Column:
    old, new = F.col(f"_before.{parameter}"), F.col(parameter)
    differs = old.isNotNull() & ~old.eqNullSafe(new)
    if parameter == "brake_bias":
        small = F.coalesce(F.abs(old - new) < fixed.BRAKE_BIAS_TOLERANCE, F.lit(False))
        differs = differs & ~small
    return differs


def _setup_rows(samples: DataFrame, rows_per_slice: int) -> DataFrame:
    state = _with_state(samples, rows_per_slice, extra=fixed.SETUP_PARAMETERS)
    changes = F.array_compact(F.array(*[
        F.when(_was_live() & _changed(p), F.struct(
            F.lit(p).alias("parameter"),
            F.col(f"_before.{p}").cast("double").alias("old_value"),
            F.col(p).cast("double").alias("new_value"),
        )) for p in fixed.SETUP_PARAMETERS
    ]))
    return state.where(C.is_live()).withColumn("_changes", changes)


def setup_changes(samples: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """A row per parameter that differs from the live sample before it.

    The brake bias has to move by 0.01 or more from one sample to the next, so a
    slow drift is never reported.
    """
    return _setup_rows(samples, rows_per_slice).select(
        *SESSION, F.explode("_changes").alias("_c"),
        F.col("completed_laps").alias("lap_number"), F.col("timestamp_wall").alias("timestamp"),
    ).select(*SESSION, "_c.*", "lap_number", "timestamp")


def setup_snapshots(samples: DataFrame, rows_per_slice: int = ROWS_PER_SLICE,
                    distinct: bool = False) -> DataFrame:
    """The full setup when a session opens (from lap 0) and at each change.

    A sample that changes k parameters gives k equal rows, or one with ``distinct``.
    """
    at = F.when(_was_live(), F.col("completed_laps")).otherwise(0)
    number = F.size("_changes")
    copies = F.when(_was_live(), F.least(number, F.lit(1)) if distinct else number).otherwise(1)
    return _setup_rows(samples, rows_per_slice).withColumn("_n", copies).where("_n > 0").select(
        *SESSION, "car", "track", F.col("timestamp_wall").alias("timestamp"),
        at.alias("lap_applied_from"), *fixed.SETUP_PARAMETERS,
        F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"),
    ).drop("_copy")


def laps_driven(samples: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The lap counts that the live samples of each session have."""
    return sessionize(samples, rows_per_slice).where(C.is_live()).select(*SESSION, "completed_laps").distinct()


def setup_on_laps(laps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each lap with the latest setup of its session applied on or before it.

    An as-of look over the laps and setups of one session, not a join.
    """
    latest = snapshots.groupBy(*SESSION, F.col("lap_applied_from").alias("lap")).agg(
        F.max_by(F.struct("lap_applied_from", *fixed.SETUP_PARAMETERS), "timestamp").alias("setup")
    ).withColumn("is_lap", F.lit(0))
    asked = laps.select(*SESSION, F.col("completed_laps").alias("lap"), F.lit(1).alias("is_lap"))
    upto = Window.partitionBy(*SESSION).orderBy("lap", "is_lap").rowsBetween(Window.unboundedPreceding, 0)
    known = latest.unionByName(asked, allowMissingColumns=True).withColumn(
        "active", F.last("setup", ignorenulls=True).over(upto))
    return known.where("is_lap = 1").select(*SESSION, F.col("lap").alias("completed_laps"), "active.*")


def drop_repeated_packets(samples: DataFrame, packet: str = "packet_id",
                          rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Without samples whose packet number equals that of the sample just before."""
    slices = Slices(samples, KEY, ["timestamp_wall", packet], rows_per_slice)
    seen = slices.look_back(_seen=slices.previous(packet)).result
    same = F.col("_seen").isNotNull() & F.col(f"_seen.{packet}").eqNullSafe(F.col(packet))
    return seen.where(~same).drop("_seen")


def with_sessions(children: DataFrame, session_table: DataFrame) -> DataFrame:
    """Laps or setups with the columns of their session."""
    return children.join(session_table, "session_id")


def orphans(children: DataFrame, session_table: DataFrame) -> DataFrame:
    """Laps or setups whose session is not known."""
    return children.join(session_table, "session_id", "left_anti")


def merge_session_end(stored: DataFrame, ends: DataFrame) -> DataFrame:
    """Session rows updated by their end event.

    A value missing from the event keeps the stored one; an end of an unknown
    session changes nothing. Of several ends the latest that has a value counts.
    """
    ended = F.struct("timestamp")
    latest = ends.groupBy("session_id").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), ended)).alias(f"_{c}")
        for c in ("total_laps", "best_lap_ms", "timestamp")
    ])
    return stored.join(latest, "session_id", "left").withColumns({
        "total_laps": F.coalesce("_total_laps", "total_laps"),
        "best_lap_ms": F.coalesce("_best_lap_ms", "best_lap_ms"),
        "end_time": F.coalesce("_timestamp", "end_time"),
    }).select(*stored.columns)


def lap_segments(samples: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Laps as they are cut from a running session, in numbers.

    A lap ends where the count of any sample in the session exceeds that of the sample
    before, pit samples included; the numbers are over samples outside the pit. It
    carries the count of its last sample.
    """
    counted = _with_state(samples, rows_per_slice).where(_member())
    driven = ~F.coalesce(F.col("is_in_pit"), F.lit(False))

    def of(how, column):
        return how(F.when(driven, F.col(column)))

    return counted.groupBy(*SESSION, "segment_no").agg(
        F.max_by("completed_laps", order_key(samples)).alias("lap_number"),
        F.count_if(driven).alias("samples"),
        of(F.max, "speed_kmh").alias("max_speed"), of(F.avg, "speed_kmh").alias("avg_speed"),
        (of(F.max, "fuel_remaining") - of(F.min, "fuel_remaining")).alias("fuel_used"),
        of(F.min, "timestamp_wall").alias("first_time"),
        of(F.max, "timestamp_wall").alias("last_time"),
    ).where("samples > 0")
