"""Batches of raw events as JSON: the ingest source, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_EVENTS = 500

_TEXT = (
    "event_id request_id org_id account_id seat_id source_id virtual_key_id virtual_key_alias oauth_identity provider_code model request_status "
    "error_code app_slug session_id content_hash raw_event_json"
).split()
_LONGS = "source_seq input_tokens cached_input_tokens cache_creation_input_tokens output_tokens total_tokens".split()
_TIMES = "event_time occurred_at started_at finished_at".split()  # milliseconds since 1970 on the wire; 0 means absent

EVENT = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.LongType()) for c in (*_LONGS, *_TIMES)]
    + [T.StructField(c, T.IntegerType()) for c in ("request_count", "http_status_code", "schema_version")]
)
BATCH = T.StructType([T.StructField("subject", T.StringType()), T.StructField("allocated_seq", T.LongType()), T.StructField("events", T.ArrayType(EVENT))])


_TURN_TEXT = (
    "event_id org_id session_id owner_account_id seat_id virtual_key_id source_id model provider_code user_text assistant_text system_text request_status"
).split()
_TURN_LONGS = (
    "source_seq input_tokens output_tokens cached_input_tokens cache_creation_input_tokens reasoning_tokens total_tokens duration_ms content_bytes created_at"
).split()
TURN = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TURN_TEXT] + [T.StructField(c, T.LongType()) for c in _TURN_LONGS] + [T.StructField("cache_enabled",
        T.BooleanType())]
)
TURN_BATCH = T.StructType([T.StructField("records", T.ArrayType(TURN))])


def turns_of(batches: DataFrame) -> DataFrame:
    """One row per conversation turn with ``pos``, its place in its batch; empty and too large batches as in :func:`events_of`."""
    size = F.coalesce(F.size("records"), F.lit(0))
    ok = F.when(size <= MAX_EVENTS, F.col("records"))
    rows = batches.select((size > MAX_EVENTS).alias("too_large"), F.posexplode_outer(ok).alias("pos", "e")).filter(F.col("e").isNotNull() | F.col("too_large"))
    out = rows.select("pos", F.when(F.col("too_large"), "more than 500 records").alias("batch_error"), "e.*")
    return out.withColumn("created_at", F.when(F.col("created_at") != 0, F.timestamp_millis("created_at")))


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    return turns_of(spark.read.schema(TURN_BATCH).json(path))


def stream_turns(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return turns_of(spark.readStream.schema(TURN_BATCH).option("maxFilesPerTrigger", files_per_trigger).json(path))


def events_of(batches: DataFrame) -> DataFrame:
    """One row per event with ``pos``, its place in its batch.

    The authenticated ``subject`` overrides the account; empty batches give no rows and one of
    more than 500 events none but a row with ``batch_error``.  Absent numbers of schema and
    requests become 1.
    """
    size = F.coalesce(F.size("events"), F.lit(0))
    ok = F.when(size <= MAX_EVENTS, F.col("events"))
    rows = batches.select("subject", (size > MAX_EVENTS).alias("too_large"), F.posexplode_outer(ok).alias("pos", "e"))
    rows = rows.filter(F.col("e").isNotNull() | F.col("too_large"))
    out = rows.select("pos", F.when(F.col("too_large"), "more than 500 events").alias("batch_error"), "subject", "e.*")
    times = {c: F.when(F.col(c) != 0, F.timestamp_millis(c)) for c in _TIMES}
    ones = {c: F.when(F.coalesce(c, F.lit(0)) == 0, 1).otherwise(F.col(c)) for c in ("request_count", "schema_version")}
    return out.withColumns(times | ones | {"account_id": F.coalesce(F.nullif("subject", F.lit("")), "account_id")}).drop("subject")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return events_of(spark.read.schema(BATCH).json(path))


def stream_batches(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return events_of(spark.readStream.schema(BATCH).option("maxFilesPerTrigger", files_per_trigger).json(path))
