import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lapline import schemas, session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session.build("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


DEFAULTS = {
    "session_id": "s", "car": "Audi R8", "track": "Monza", "session_type": "race", "status": "live",
    "completed_laps": 0, "current_lap_time_ms": 0, "last_lap_time_ms": 100000,
    "best_lap_time_ms": 99000, "distance_into_lap": 0.0, "last_sector_time_ms": 30000,
    "is_valid_lap": True, "is_in_pit": False, "throttle": 0.5, "brake": 0.1, "speed_kmh": 100.0,
    "gear": 3, "fuel_remaining": 50.0, "fuel_per_lap": 2.0, "tc_level": 1, "tc_cut": 0,
    "abs_level": 2, "engine_map": 1, "brake_bias": 57.0, "packet_id": 0, "steering": 0.0,
    "air_temp": 20.0, "road_temp": 30.0, "g_lat": 0.0, "g_lon": 0.0,
    **{f"tyre_temp_{w}": 80.0 for w in ("fl", "fr", "rl", "rr")},
    **{f"tyre_pressure_{w}": 27.0 for w in ("fl", "fr", "rl", "rr")},
    "brake_temp_fl": 300.0, "brake_temp_fr": 300.0,
}


def _type(name):
    if name == "packet_id":
        return "bigint"
    kinds = {f.name: f.dataType.simpleString() for f in schemas.LAKE_SAMPLE.fields}
    return {"float": "double"}.get(kinds[name], kinds[name])


@pytest.fixture(scope="session")
def samples(spark):
    """Samples from dicts; row i is at second i unless it says otherwise."""
    def make(rows):
        full = [{"ts": i, **DEFAULTS, **row} for i, row in enumerate(rows)]
        names = list(DEFAULTS)
        ddl = "ts double, " + ", ".join(f"{n} {_type(n)}" for n in names)
        df = spark.createDataFrame([tuple([float(r["ts"])] + [r[n] for n in names]) for r in full], ddl)
        return df.selectExpr("timestamp_micros(CAST(ts * 1000000 + 1704067200000000 AS BIGINT)) AS timestamp_wall",
                             *names)
    return make
