"""Facts from raw events: base copy, local dimensions as of event time, latency and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.operators import asof
from tallyforge.operators.ingest import dispositions, generates
from tallyforge.runtime import checkpoint

_TEXT = ("org_id", "account_id", "seat_id", "virtual_key_id", "virtual_key_alias", "provider_code", "model", "request_status", "session_id", "app_slug")
_NUMBERS = ("input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "output_tokens", "total_tokens")


def control_lookup(events: DataFrame, control: DataFrame) -> DataFrame:
    """Events with the control event in effect at their time, whenever it was recorded.

    Of overlapping versions the latest start wins, then the highest revision; when it ends,
    an older one that is still open holds again.
    """
    number = F.col("revision").try_cast("decimal(38,0)")
    return asof.attributes_asof(
        events, control, key="virtual_key_id", event_time="event_time", effective_from="effective_from", effective_to="effective_to",
        recorded_at="effective_from", priority=[F.col("effective_from"), number],
        attributes={"control_event_id": F.col("event_id"), "control_seat_id": F.col("seat_id"), "control_provider_id": F.col("provider_id")}, row_id="ods_id",
    )


def base_facts(ods: DataFrame) -> DataFrame:
    """Accepted first deliveries as facts: absent texts become '', absent token counts 0; attempt and
    sequence numbers stay NULL."""
    rows = dispositions(ods).filter("disposition = 'accepted' and virtual_key_id is distinct from '__canary__'")
    latency = F.coalesce(C.millis("finished_at") - C.millis("started_at"), F.lit(0)).cast("bigint")
    spent = F.coalesce("total_tokens", F.lit(0))
    return rows.select(
        "ods_id", "event_id", "event_time",
        F.to_date("event_time").alias("usage_date"),
        F.date_format("event_time", "yyyy-MM").alias("billing_period"),
        *(C.or_empty(c).alias(c) for c in _TEXT),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in _NUMBERS),
        "source_id", "source_seq", latency.alias("latency_ms"),
        F.when((spent <= 0) & ~generates(), "non_generation").otherwise("normal").alias("user_usage_scope"),
    )


def project(ods: DataFrame, control: DataFrame) -> DataFrame:
    """Facts, with the seat filled in from the control event where the event named none."""
    # The lookup reads its events several times: the deliveries are sorted out once.
    facts = control_lookup(checkpoint(base_facts(ods)), control)
    seat = F.coalesce(F.nullif("seat_id", F.lit("")), "control_seat_id", F.lit(""))
    return facts.withColumn("seat_id", seat)


def backlog(ods: DataFrame, fact: DataFrame) -> DataFrame:
    """Accepted events without a fact, and the age of the oldest in ms at the newest receipt."""
    waiting = ods.filter("ingest_status = 'accepted'").join(fact.select("org_id", "event_id"), ["org_id", "event_id"], "left_anti")
    newest = ods.agg(F.max("ingest_received_at").alias("now"))
    per = waiting.agg(F.count(F.lit(1)).alias("pending"), F.min("ingest_received_at").alias("oldest"))
    age = F.greatest(F.coalesce(C.millis("now") - C.millis("oldest"), F.lit(0)), F.lit(0))
    # Two single rows.
    return per.join(F.broadcast(newest), F.lit(True)).select("pending", age.cast("bigint").alias("age_ms"))


def pipeline_watermarks(ods: DataFrame, fact: DataFrame) -> DataFrame:
    """Newest receipt and newest projection per organisation; of canaries and business as a whole see ``health.watermarks``."""
    a = ods.groupBy("org_id").agg(C.millis(F.max("ingest_received_at")).alias("received_ms"))
    b = fact.groupBy("org_id").agg(C.millis(F.max("projected_at")).alias("projected_ms"))
    return a.join(b, "org_id", "full_outer")


def vault_origin(key: str = "virtual_key_id") -> Column:
    """Whether a key comes from a personal vault and has no control versions: told by its prefix."""
    return F.coalesce(F.col(key).rlike("^(personal|oauth|app|probe):"), F.lit(False))
