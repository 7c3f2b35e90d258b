"""The given tables in the shape of the queries.

The fact table lacks some columns of the data model.  What its delivery knows is joined by
``ods_id``; protocol, billing scope, route and quality, which no table holds, follow from
row numbers and key kinds so that every branch of the queries meets NULL, '' and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.runtime import table


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    rest = F.pmod("ods_id", F.lit(9))
    route = F.when(rest == 0, F.lit(None).cast("string")).when(rest == 1, "canary").otherwise("proxy")
    return table(spark, d, "usage_event_ods").withColumn("route_source", route)


def facts(spark: SparkSession, d: str, scope: Column | None = None) -> DataFrame:
    """Facts with what their deliveries and row numbers add.

    ``scope``: a condition that the raw events of all wanted facts meet (``raw_identity``, a time window that
    facts copy from their events); the others are neither shuffled nor joined.
    """
    raw = raw_events(spark, d)
    o = (raw if scope is None else raw.filter(scope)).select(
        "ods_id", "request_id", F.coalesce("request_count", F.lit(1)).alias("request_count"), "app_slug", "http_status_code", "oauth_identity", "occurred_at",
        "source_id", "source_seq", "content_hash", F.get_json_object("raw_event_json", "$.request_path").alias("path"),
    )
    rest = lambda n: F.pmod("dwd_id", F.lit(n))
    text = F.lit(None).cast("string")
    derived = {
        "protocol_type": F.when(F.col("path").contains("/messages"), "messages").when(F.col("path").contains("completions"), "completions"),
        "billing_scope": F.when(F.col("virtual_key_id").startswith("personal:"), "org_only").when(rest(6) == 0, "hold_for_review").otherwise("org_and_user"),
        "route_source": F.when(rest(9) == 0, text).when(rest(9) == 1, "canary").otherwise("proxy"),
        "fallback_reason": F.when(F.col("fallback_attempt") == 2, "UPSTREAM_5XX").when(F.col("fallback_attempt") > 2, "UPSTREAM_TIMEOUT"),
        "quality_status": F.when(rest(4) == 0, "partial").when(rest(4) == 1, "").otherwise("exact"),
        "reasoning_tokens": F.when(rest(5) == 0, 20).otherwise(0).cast("bigint"),
        "credential_id": F.when(rest(7) == 0, text).when(rest(7) == 1, "").otherwise(F.concat(F.lit("cred-"), rest(7).cast("string"))),
        "validation_code": F.when(rest(10) == 0, "stale_key_revision"),
        "anomaly_type": F.when(rest(6) == 1, "pending_review").when(rest(6) == 2, ""),
        "completion_source": F.when(rest(4) == 0, "control_event").otherwise("exact"),
    }
    return table(spark, d, "usage_fact_dwd").join(o, "ods_id", "left").withColumns(derived).drop("path")
