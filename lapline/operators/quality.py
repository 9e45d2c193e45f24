"""Data-quality checks: one row per check and session, from grouped aggregates."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapline import fixed_values as fixed
from lapline import schemas
from lapline.functions import columns as C
from lapline.operators.ordered import ROWS_PER_SLICE, first_of_each, numbered, time_order
from lapline.operators.sessions import SESSION

KEY = ["session_id"]


def _verdict(ok: Column, otherwise: str) -> Column:
    return F.when(ok, F.lit("ok")).otherwise(F.lit(otherwise))


def _rows(wide: DataFrame, structs: list[Column], keys: list[str] = KEY) -> DataFrame:
    return wide.select(*keys, F.explode(F.array(*structs)).alias("_r")).select(*keys, "_r.*")


def column_checks(samples: DataFrame, expected=schemas.SAMPLE) -> DataFrame:
    """Per session: how many expected columns the frame lacks, and which."""
    missing = schemas.missing_columns(samples, expected)
    return samples.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).select(
        *KEY, F.lit(len(expected.names)).alias("expected"), F.lit(len(missing)).alias("missing"),
        F.lit(",".join(missing)).alias("missing_columns"),
        F.lit("fail" if missing else "ok").alias("verdict"),
    )


def slice_sample(samples: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Five blocks of 200 rows of each session: near the start, at the quarters, near the end.

    The first rows are left out of a long recording. Overlapping blocks give a row once.
    """
    order = time_order(samples)
    slices = numbered(samples, KEY, order, "_row", rows_per_slice)
    counts = samples.groupBy(*KEY).agg(F.count(F.lit(1)).cast("long").alias("_all"))
    rows = slices.join_per_key(counts)
    n, at = F.col("_all"), F.col("_row") - 1
    quarter = F.floor(n / 4)
    starts = [
        F.when(n > 1000, F.least(F.lit(500), F.floor(n / 10))).otherwise(0),
        quarter, F.floor(n / 2), F.floor(n * 3 / 4), F.greatest(F.lit(0), n - 500),
    ]
    chosen = F.lit(False)
    for start in starts:
        chosen = chosen | ((at >= start) & (at < start + 200))
    return rows.where(chosen).drop("_row", "_all")


def first_rows(samples: DataFrame, n: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The first n rows of each session in time order."""
    return first_of_each(samples, KEY, time_order(samples), n, rows_per_slice)


def _bad(value: Column, low, high) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return bad


def range_checks(samples: DataFrame, bounds: dict = fixed.FIELD_BOUNDS,
                 tolerated: float = 0.05) -> DataFrame:
    """Per session and field: values, extremes, how many are out of bounds, and a verdict.

    No value at all or few outliers warn, more fail. An absent column counts as zeros.
    """
    measures, rows = [], []
    for field, (low, high) in bounds.items():
        present = field in samples.columns
        value = (F.col(field) if present else F.lit(0)).cast("double")
        measures += [
            F.count(value).alias(f"{field}_n"), F.min(value).alias(f"{field}_min"),
            F.max(value).alias(f"{field}_max"), F.count_if(_bad(value, low, high)).alias(f"{field}_bad"),
        ]
        n, bad = F.col(f"{field}_n"), F.col(f"{field}_bad")
        verdict = (
            F.when(n == 0, "warn").when(bad == 0, "ok")
            .when(bad < n * tolerated, "warn").otherwise("fail")
        )
        rows.append(F.struct(
            F.lit(field).alias("field"), n.alias("n"), F.col(f"{field}_min").alias("vmin"),
            F.col(f"{field}_max").alias("vmax"), bad.alias("out_of_range"), verdict.alias("verdict"),
        ))
    return _rows(samples.groupBy(*KEY).agg(*measures), rows)


def strict_range_checks(samples: DataFrame) -> DataFrame:
    """The strict bounds; one outlier fails."""
    return range_checks(samples, fixed.HEAD_BOUNDS, tolerated=0.0)


def required_checks(samples: DataFrame) -> DataFrame:
    """Empty required fields."""
    empty = {
        f: F.count_if(F.col(f).isNull() | (F.col(f).cast("string") == "")) for f in fixed.REQUIRED_FIELDS
    }
    wide = samples.groupBy(*KEY).agg(*[c.alias(f) for f, c in empty.items()])
    return _rows(wide, [
        F.struct(F.lit(f).alias("field"), F.col(f).alias("empty"),
                 _verdict(F.col(f) == 0, "fail").alias("verdict")) for f in empty
    ])


def lap_checks(laps: DataFrame) -> DataFrame:
    """Checks over lap completions in time order, one row per session and check.

    ``value`` is the number of laps that break the rule; for fuel it is the mean burn.
    """
    along = Window.partitionBy(*SESSION).orderBy("timestamp", "lap_number")
    looked = laps.withColumn("_p", F.lag(F.struct("lap_number", "fuel_remaining")).over(along))
    first = F.col("_p").isNull()
    seconds = F.col("lap_time_ms") / F.lit(1000.0)
    in_turn = F.when(first, F.col("lap_number") == 1).otherwise(
        F.col("lap_number") == F.col("_p.lap_number") + 1
    )
    burn = F.col("_p.fuel_remaining") - F.col("fuel_remaining")
    measures = {
        "laps": F.count(F.lit(1)),
        "implausible": F.count_if(~((seconds > 80) & (seconds < 200))),
        "unrealistic": F.count_if(~seconds.between(90, 150)),
        "out_of_turn": F.count_if(~in_turn),
        "not_burning": F.count_if(~first & ~(burn > 0)),
        "mean_burn": F.avg(F.when(~first, burn)),
        "invalid": F.count_if(~F.col("is_valid")),
    }
    if "sector_1_ms" in laps.columns:
        off = F.abs(F.col("sector_1_ms") + F.col("sector_2_ms") + F.col("sector_3_ms")
                    - F.col("lap_time_ms"))
        measures["sectors_off"] = F.count_if(off > 100)
    wide = looked.groupBy(*SESSION).agg(*[m.alias(k) for k, m in measures.items()])

    def check(name, verdict, value):
        return F.struct(F.lit(name).alias("check"), verdict.alias("verdict"),
                        F.col(value).cast("double").alias("value"))

    none = lambda c: F.col(c) == 0
    rows = [
        check("lap_time_plausible", _verdict(none("implausible"), "fail"), "implausible"),
        check("lap_time_realistic", _verdict(none("unrealistic"), "fail"), "unrealistic"),
        check("laps_in_turn", _verdict(none("out_of_turn"), "fail"), "out_of_turn"),
        check("fuel_decreasing",
              F.when(F.col("laps") > 1, _verdict(none("not_burning"), "warn")), "mean_burn"),
        check("has_invalid_lap", _verdict(F.col("invalid") > 0, "fail"), "invalid"),
    ]
    if "sectors_off" in measures:
        rows.append(check("sectors_add_up", _verdict(none("sectors_off"), "fail"), "sectors_off"))
    return _rows(wide, rows, SESSION)


def sector_sums(laps: DataFrame, off_by_ms: float = 100) -> DataFrame:
    """Laps of each session whose measured sectors don't add up to the lap, and laps with a sector missing."""
    sectors = [F.col(f"sector_{i}_ms") for i in (1, 2, 3)]
    missing = sectors[0].isNull() | sectors[1].isNull() | sectors[2].isNull()
    off = F.abs(sectors[0] + sectors[1] + sectors[2] - F.col("lap_time_ms")) > off_by_ms
    return laps.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("laps"), F.count_if(missing).alias("unmeasured"), F.count_if(off).alias("sectors_off")
    ).select(*KEY, "laps", "unmeasured", "sectors_off", _verdict(F.col("sectors_off") == 0, "fail").alias("verdict"))


def event_checks(events: DataFrame) -> DataFrame:
    """Starts, ends and ends that tell laps.

    No start fails; no end, more than one of either, or an end without laps warns.
    """
    kind = F.col("event_type")
    return events.groupBy(*SESSION).agg(
        F.count_if(kind == "session_start").alias("starts"),
        F.count_if(kind == "session_end").alias("ends"),
        F.count_if((kind == "session_end") & (F.col("total_laps") > 0)).alias("ends_with_laps"),
    ).withColumn(
        "verdict", F.when(F.col("starts") == 0, "fail").when(
            (F.col("starts") > 1) | (F.col("ends") != 1) | (F.col("ends_with_laps") == 0), "warn").otherwise("ok")
    ).withColumn("one_of_each", (F.col("starts") == 1) & (F.col("ends") == 1))


def brake_bias_checks(samples: DataFrame) -> DataFrame:
    """Scale of the brake bias, without zeros."""
    bias = F.col("brake_bias").cast("double")
    used = samples.where(bias > 0).groupBy(*KEY).agg(
        F.min(bias).alias("bias_min"), F.max(bias).alias("bias_max"), F.avg(bias).alias("bias_avg")
    )
    mean = F.col("bias_avg")
    return used.withColumn(
        "verdict",
        F.when(F.col("bias_max") < 2.0, "warn: 0-1 scale")
        .when((mean > 40) & (mean < 70), "ok").otherwise("warn: unusual"),
    )


def lap_report(laps: DataFrame) -> DataFrame:
    """Lap table for reading; either of the two temperature columns, else 0."""
    def temperature(w):
        both = [F.col(c) for c in (f"tyre_temp_{w}", f"avg_tyre_temp_{w}") if c in laps.columns]
        return F.coalesce(*both, F.lit(0.0)).alias(w)

    return laps.select(
        *SESSION, "lap_number", C.lap_time_label(F.col("lap_time_ms")).alias("time"),
        F.coalesce("is_valid", F.lit(True)).alias("is_valid"),
        F.coalesce("fuel_remaining", F.lit(0.0)).alias("fuel"),
        *[temperature(w) for w in fixed.WHEELS],
    )


def setup_report(snapshots: DataFrame) -> DataFrame:
    """One line per snapshot; a question mark for what is not known."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("?"))

    return snapshots.select(
        *SESSION, "lap_applied_from",
        F.format_string(
            "Lap %s: TC=%s TCCut=%s ABS=%s BB=%s Map=%s",
            *[text(c) for c in ("lap_applied_from", "tc_level", "tc_cut", "abs_level",
                                "brake_bias", "engine_map")],
        ).alias("line"),
    )


def validation_summary(samples: DataFrame, events: DataFrame, laps: DataFrame) -> DataFrame:
    """All checks as (stream, session, area, check, verdict); those over whole streams have no session number."""
    def area(df, name, check):
        number = F.col("session_no") if "session_no" in df.columns else F.lit(None)
        return df.select(*KEY, number.cast("long").alias("session_no"), F.lit(name).alias("area"),
                         check.alias("check"), "verdict")

    return (
        area(event_checks(events), "events", F.lit("start_and_end"))
        .unionByName(area(lap_checks(laps), "laps", F.col("check")))
        .unionByName(area(range_checks(samples), "fields", F.col("field")))
        .unionByName(area(brake_bias_checks(samples), "brake_bias", F.lit("scale")))
    )


def session_facts(events: DataFrame) -> DataFrame:
    """Track, car, type from the latest start, laps and best lap from the latest end."""
    started = F.when(F.col("event_type") == "session_start", F.col("timestamp"))
    ended = F.when(F.col("event_type") == "session_end", F.col("timestamp"))
    return events.groupBy(*SESSION).agg(
        *[F.max_by(c, started).alias(c) for c in ("track", "car", "session_type")],
        *[F.max_by(c, ended).alias(c) for c in ("total_laps", "best_lap_ms")],
    ).withColumn("best_lap", C.lap_time_label(F.col("best_lap_ms")))
