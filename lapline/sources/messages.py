"""Keyed messages: Kafka topics, or files with the same columns."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapline import fixed_values as fixed
from lapline import schemas


def kafka_options(servers: str, topics=(fixed.TELEMETRY_TOPIC,), starting: str = "earliest",
                  per_trigger: int | None = None) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers, "subscribe": ",".join(topics),
        "startingOffsets": starting, "failOnDataLoss": "false",
    }
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return options


def kafka_stream(spark: SparkSession, servers: str, topics=(fixed.TELEMETRY_TOPIC,),
                 **options) -> DataFrame:
    """A stream of (key, value, topic, timestamp, ...); needs the Kafka connector jar."""
    return spark.readStream.format("kafka").options(
        **kafka_options(servers, topics, **options)).load()


def event_stream(spark: SparkSession, servers: str) -> DataFrame:
    """All three event topics from the earliest message on."""
    return kafka_stream(spark, servers, fixed.EVENT_TOPICS)


def message_files(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The same rows from a folder of Parquet files that others add to."""
    return spark.readStream.schema(schemas.MESSAGE).option(
        "maxFilesPerTrigger", per_trigger).parquet(path)


def encode(df: DataFrame, topic: str, key: str = "session_id", time: str | None = None) -> DataFrame:
    """Rows as messages: the key's bytes, and a JSON object without NULL fields."""
    return df.select(
        F.col(key).cast("string").cast("binary").alias("key"),
        F.to_json(F.struct(*df.columns)).cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        (F.col(time).cast("timestamp") if time else F.current_timestamp()).alias("timestamp"),
    )


def decode(messages: DataFrame, schema: T.StructType = schemas.SAMPLE) -> DataFrame:
    """``session_key`` from the key, the value's fields as columns; no row is lost.

    A value that is no JSON object gives NULLs.
    """
    return messages.select(
        F.col("key").cast("string").alias("session_key"),
        F.from_json(F.col("value").cast("string"), schema).alias("data"),
    ).select("session_key", "data.*")


def is_readable() -> Column:
    return F.json_object_keys(F.col("value").cast("string")).isNotNull()


def unreadable(messages: DataFrame) -> DataFrame:
    """Messages whose value is no JSON object, as they came."""
    return messages.where(~is_readable())
