"""Landing search events as partitioned JSON lines, by Structured Streaming."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import FLUSH_ROWS
from ..functions.time import utc_date, utc_hour

TOPICS = ("prefix-search", "place-selection")


def kafka_events(spark: SparkSession, servers: str) -> DataFrame:
    """(event_type, value) of both topics from the start; needs Spark's Kafka connector."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(TOPICS)).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", FLUSH_ROWS).load()
    return rows.select(F.col("topic").alias("event_type"), F.col("value").cast("string").alias("value"))


def file_events(spark: SparkSession, root: str, files_per_trigger: int = 16) -> DataFrame:
    """The same from text files in ``event_type=...`` folders."""
    return spark.readStream.schema("value string, event_type string").option("maxFilesPerTrigger", files_per_trigger).text(root).select("event_type", "value")


def to_landed(events: DataFrame) -> DataFrame:
    """Rows that are JSON objects, with the UTC date and hour of each row's own timestamp, or of now."""
    ms = F.coalesce(F.get_json_object("value", "$.timestampMs").try_cast("long"), F.unix_millis(F.current_timestamp()))
    whole = events.where(F.get_json_object("value", "$.sessionId").isNotNull())
    return whole.select("value", "event_type", utc_date(ms).alias("date"), utc_hour(ms).alias("hour"))


def land(events: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the landing; the file sink with its checkpoint writes each row once."""
    writer = to_landed(events).writeStream.format("text").partitionBy("event_type", "date", "hour").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start(out)


def stop(query: StreamingQuery, wait_s: float = 30.0) -> None:
    """Stops a landing between two batches: waits for a running one, so its rows are written once and its offsets kept."""
    end = time.time() + wait_s
    while query.isActive and query.status["isTriggerActive"] and time.time() < end:
        time.sleep(0.1)
    query.stop()


def emit_quietly(rows: DataFrame, topic: str, servers: str | None = None, root: str | None = None) -> bool:
    """``emit``, for callers whose answer must not depend on it: a failure is logged, not raised."""
    try:
        emit(rows, topic, servers, root)
    except Exception as e:  # whatever the sink says, the caller goes on
        logging.getLogger(__name__).warning("event to %s not sent: %s", topic, e)
        return False
    return True


def emit(rows: DataFrame, topic: str, servers: str | None = None, root: str | None = None) -> None:
    """Sends events keyed by session to Kafka, or as files that ``file_events`` reads."""
    value = rows.select(F.col("sessionId").alias("key"), F.to_json(F.struct("*")).alias("value"))
    if servers:
        value.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "0").save()
    else:
        value.select("value").write.mode("append").text(f"{root}/event_type={topic}")
