"""Column expressions: all built-ins, so they stay inside generated code."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapline import fixed_values as fixed


def wheel_columns(prefix: str) -> list[str]:
    return [f"{prefix}_{wheel}" for wheel in fixed.WHEELS]


def wheel_mean(prefix: str) -> Column:
    """Mean of the four wheels of one row; NULL if one of them is."""
    return reduce(add, [F.col(c) for c in wheel_columns(prefix)]) / F.lit(4.0)


def stacked_mean(prefix: str) -> Column:
    """Aggregate: mean of all values of the four wheel columns, NULLs left out."""
    columns = [F.col(c).cast("double") for c in wheel_columns(prefix)]
    total = reduce(add, [F.coalesce(F.sum(c), F.lit(0.0)) for c in columns])
    count = reduce(add, [F.count(c) for c in columns])
    return F.when(count > 0, total / count)


def is_live() -> Column:
    return F.col("status") == "live"


def out_of_pit() -> Column:
    """False for pit samples, NULL (so filtered out) where the flag is missing."""
    return ~F.col("is_in_pit")


def heavy_braking() -> Column:
    return F.col("brake") > F.lit(fixed.HEAVY_BRAKE)


def full_throttle() -> Column:
    return F.col("throttle") > F.lit(fixed.FULL_THROTTLE)


def peak_g() -> Column:
    return F.sqrt(F.col("g_lat") * F.col("g_lat") + F.col("g_lon") * F.col("g_lon"))


def parse_time(column: str) -> Column:
    """ISO-8601 text to a timestamp; unreadable text becomes NULL instead of an error."""
    return F.try_to_timestamp(F.col(column))


def parsed_time(df: DataFrame, column: str = "timestamp_wall") -> Column:
    """As above for text; a column that already is a timestamp is taken as it is."""
    if df.schema[column].dataType.typeName() == "string":
        return parse_time(column)
    return F.col(column)


def lap_time_label(ms: Column) -> Column:
    """``M:SS.mmm``; a placeholder where there is no time."""
    whole = ms.cast("long")
    label = F.format_string(
        "%d:%06.3f", F.floor(whole / 60000), (whole % 60000) / F.lit(1000.0)
    )
    return F.when(ms > 0, label).otherwise(F.lit(fixed.NO_LAP_TIME))


def delta_label(ms: Column) -> Column:
    """Signed seconds with three decimals; no sign on zero."""
    seconds = F.format_string("%.3fs", ms / F.lit(1000.0))
    return F.when(ms > 0, F.concat(F.lit("+"), seconds)).otherwise(seconds)


def from_code(code: Column, names: dict[int, str]) -> Column:
    """Name of an integer code, ``unknown`` for any other value."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit("unknown"))


def status_name(code: Column) -> Column:
    return from_code(code, fixed.STATUS_CODES)


def session_type_name(code: Column) -> Column:
    return from_code(code, fixed.SESSION_TYPE_CODES)


def grip_name(code: Column) -> Column:
    return from_code(code, fixed.GRIP_CODES)


def rain_name(code: Column) -> Column:
    return from_code(code, fixed.RAIN_CODES)


def brake_bias_percent(raw: Column, car: Column) -> Column:
    """Raw bias x 100 plus the car's offset; most cars have the default one."""
    pairs = [F.lit(x) for item in fixed.BRAKE_BIAS_OFFSETS.items() for x in item]
    offset = F.coalesce(
        F.try_element_at(F.create_map(*pairs), car), F.lit(fixed.DEFAULT_BRAKE_BIAS_OFFSET)
    )
    return raw * F.lit(100.0) + offset


def session_name(platform: Column, started: Column, track: Column, car_class: Column) -> Column:
    return F.concat_ws(
        "_", F.lower(platform), F.date_format(started, "yyyyMMdd_HHmmss"),
        F.lower(path_safe(track)), F.lower(car_class),
    )


def path_safe(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def lap_file_name(lap: Column) -> Column:
    """``lap_007``; longer numbers keep all their digits."""
    digits = lap.cast("string")
    return F.concat(
        F.lit("lap_"), F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0"))
    )


def gear_label(gear: Column) -> Column:
    return (
        F.when(gear == 0, F.lit("R")).when(gear == 1, F.lit("N"))
        .otherwise((gear - 1).cast("string"))
    )


def fuel_used_band(litres: Column) -> Column:
    return F.when(litres > fixed.FUEL_USED_WARN, F.lit("warn")).otherwise(F.lit(""))


def tyre_temp_band(degrees: Column) -> Column:
    return (
        F.when(degrees > fixed.TYRE_TEMP_WARN, F.lit("warn"))
        .when(degrees > fixed.TYRE_TEMP_GOOD, F.lit("good")).otherwise(F.lit(""))
    )


def laps_left_band(laps: Column) -> Column:
    return F.when(laps < fixed.LAPS_LEFT_WARN, F.lit("warn")).otherwise(F.lit("good"))


def delta_band(ms: Column) -> Column:
    return F.when(ms > 0, F.lit("warn")).otherwise(F.lit("good"))


def fixed_decimals(value: Column, digits: int) -> Column:
    """Text with this many decimals, ties to even; a minus stays on what rounds to zero.

    The scaled product is exact for 4-byte floats, which recordings hold.
    """
    number, scale = value.cast("double"), F.lit(float(10 ** digits))
    scaled = F.rint(number * scale)
    text = (scaled / scale).try_cast(f"decimal(20,{digits})").cast("string")
    zero = F.lit(f"-{0:.{digits}f}")
    # the last is for what is infinite, no number, or longer than 20 digits
    return F.coalesce(
        F.when((number < 0) & (scaled == 0), zero).otherwise(text),
        F.when(number.isNotNull(), F.format_string(f"%.{digits}f", number)),
    )
