"""Operators over the four wheels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapline import fixed_values as fixed
from lapline.functions import columns as C
from lapline.operators.laps import LAP


def stack_wheels(samples: DataFrame, prefix: str, keys=tuple(LAP)) -> DataFrame:
    """Four wheel columns as one series with the wheel's name."""
    return samples.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(w).alias("wheel"), F.col(f"{prefix}_{w}").alias(prefix))
            for w in fixed.WHEELS
        ])).alias("_w"),
    ).select(*keys, "_w.*")


def tyre_balance(samples: DataFrame, keys=tuple(LAP)) -> DataFrame:
    """Mean temperature by axle and side, one decimal; 0.0 for an absent column."""
    columns = {w: f"tyre_temp_{w}" for w in fixed.WHEELS}
    means = samples.groupBy(*keys).agg(*[
        (F.bround(F.avg(c), 1) if c in samples.columns else F.lit(0.0)).alias(w)
        for w, c in columns.items()
    ])
    rows = F.array(
        F.struct(F.lit("Front").alias("axle"), F.col("fl").alias("left"), F.col("fr").alias("right")),
        F.struct(F.lit("Rear").alias("axle"), F.col("rl").alias("left"), F.col("rr").alias("right")),
    )
    return means.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def wheel_means(samples: DataFrame, keys=tuple(LAP)) -> DataFrame:
    """Mean temperature and pressure of each wheel. The four means come first, then the rows."""
    means = samples.groupBy(*keys).agg(*[
        F.avg(c).alias(c) for p in ("tyre_temp", "tyre_pressure") for c in C.wheel_columns(p)
    ])
    rows = F.array(*[
        F.struct(
            F.lit(w).alias("wheel"), F.col(f"tyre_temp_{w}").alias("avg_temp"),
            F.col(f"tyre_pressure_{w}").alias("avg_pressure"),
        ) for w in fixed.WHEELS
    ])
    return means.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def tyre_window_share(samples: DataFrame, keys=tuple(LAP), windows=None) -> DataFrame:
    """Share of samples below, in and above each compound's window, per wheel.

    All shares of a lap come out of one pass: there are as many counters as
    compounds x wheels, not as many rows.
    """
    windows = windows or fixed.TYRE_WINDOWS
    counters, rows = [], []
    for compound, (low, high) in windows.items():
        for wheel in fixed.WHEELS:
            value, name = F.col(f"tyre_temp_{wheel}"), f"{compound}_{wheel}"
            counters += [
                F.count_if(value < low).alias(f"{name}_below"),
                F.count_if(value > high).alias(f"{name}_above"),
            ]
            known = F.col(f"n_{wheel}")
            below, above = F.col(f"{name}_below"), F.col(f"{name}_above")
            share = lambda n: F.when(known > 0, n / known)
            rows.append(F.struct(
                F.lit(compound).alias("compound"), F.lit(wheel).alias("wheel"),
                share(below).alias("below"), share(known - below - above).alias("inside"),
                share(above).alias("above"),
            ))
    counters += [F.count(f"tyre_temp_{w}").alias(f"n_{w}") for w in fixed.WHEELS]
    return samples.groupBy(*keys).agg(*counters).select(
        *keys, F.explode(F.array(*rows)).alias("_r")
    ).select(*keys, "_r.*")
