"""Event envelopes: JSON messages ``{ts, source, type, data}`` from Kafka or from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("data", T.StringType()),
])

BROKER_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])


def best_effort_ts(text: Column) -> Column:
    """ISO text, epoch seconds or epoch milliseconds; NULL when it is none of them."""
    return (
        F.when(text.rlike("^[0-9]{9,10}$"), F.timestamp_seconds(text.cast("bigint")))
        .when(text.rlike("^[0-9]{12,13}$"), F.timestamp_millis(text.cast("bigint")))
        .otherwise(text.try_cast("timestamp"))
    )


def envelope_normalize(messages: DataFrame) -> DataFrame:
    """Broker rows to typed envelopes. What cannot be read falls back to broker time and defaults."""
    body = F.from_json("value", ENVELOPE)
    return messages.withColumn("_e", body).select(
        F.coalesce(best_effort_ts(F.col("_e.ts")), F.col("timestamp")).alias("ts"),
        F.coalesce("_e.source", F.lit("unknown")).alias("source"),
        F.coalesce("_e.type", F.lit("unknown")).alias("type"),
        F.coalesce("_e.data", F.lit("{}")).alias("data"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").cast("int").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
        F.coalesce(F.col("key"), F.lit("")).alias("kafka_key"),
    )


def kafka_events(spark: SparkSession, servers: str, topics: str, starting: str = "latest",
                 max_offsets: int | None = None) -> DataFrame:
    """Streaming envelopes of one or more topics. Needs the Spark Kafka package on the classpath."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
        .option("startingOffsets", starting).option("failOnDataLoss", "false"))
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    raw = reader.load()
    return envelope_normalize(raw.withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")}))


def file_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same stream read from a folder of broker dumps in Parquet."""
    reader = spark.readStream.schema(BROKER_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return envelope_normalize(reader.parquet(path))


def batch_events(spark: SparkSession, path: str) -> DataFrame:
    return envelope_normalize(spark.read.schema(BROKER_SCHEMA).parquet(path))
