"""Kafka records. Reading needs the Kafka connector jar; decoding works on any frame with the
columns key, value, topic, partition, offset and timestamp."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = ("key", "topic", "partition", "offset", "timestamp")


def kafka_options(servers: str, topic: str, *, starting: str = "latest", ending: str | None = None, group_id: str | None = None,
                  streaming: bool = False, options: Mapping[str, object] | None = None) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if not streaming:
        out["startingOffsets"] = "earliest" if starting == "latest" else starting    # a batch cannot start at the end
        out["endingOffsets"] = ending or "latest"
    if group_id:
        out["kafka.group.id"] = group_id
    return out | {k: str(v) for k, v in (options or {}).items()}


def read_kafka(spark: SparkSession, servers: str, topic: str, *, streaming: bool = False, **kw) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(**kafka_options(servers, topic, streaming=streaming, **kw)).load()


def _metadata() -> list:
    return [(F.col(c).cast("string") if c == "key" else F.col(c)).alias(f"_kafka_{c}") for c in METADATA]


def decode_json(df: DataFrame, schema, *, watermark: str | None = None) -> DataFrame:
    """JSON value spread into columns, plus ``_kafka_*``. The watermark sits on ``_kafka_timestamp``."""
    parsed = df.select(F.from_json(F.col("value").cast("string"), schema).alias("_data"), *_metadata())
    out = parsed.select("_data.*", *[f"_kafka_{c}" for c in METADATA])
    return out.withWatermark("_kafka_timestamp", watermark) if watermark else out


def decode_text(df: DataFrame, *, watermark: str | None = None) -> DataFrame:
    out = df.select(F.col("value").cast("string").alias("value"), *_metadata())
    return out.withWatermark("_kafka_timestamp", watermark) if watermark else out


def decode_avro(df: DataFrame, avro_schema: str, *, watermark: str | None = None) -> DataFrame:
    from pyspark.sql.avro.functions import from_avro     # needs the spark-avro jar

    out = df.select(from_avro(F.col("value"), avro_schema).alias("_data"), *_metadata()).select("_data.*", *[f"_kafka_{c}" for c in METADATA])
    return out.withWatermark("_kafka_timestamp", watermark) if watermark else out
