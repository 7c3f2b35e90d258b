"""Pipeline health: watermarks of business and canary events, a verdict, canary checks, retries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANARY = "__canary__"
FRESH = dt.timedelta(minutes=15)
MOST_RETRIES = 20


def watermarks(ods: DataFrame, fact: DataFrame) -> DataFrame:
    """One row of times in ms: the newest receipt and projection of business events, the newest receipt and acknowledged receipt of canaries.

    Canaries never become facts: their status in the raw events tells that they were projected.  NULL organisations count on neither side.
    """
    of = lambda c, condition: F.max(F.when(condition, F.unix_millis(c)))
    canary, business = F.col("org_id") == CANARY, F.col("org_id") != CANARY
    acked = canary & (F.col("dwd_status") == "projected") if "dwd_status" in ods.columns else F.lit(False)
    raw = ods.agg(of("ingest_received_at", business).alias("business_received_ms"), of("ingest_received_at", canary).alias("canary_received_ms"),
        of("ingest_received_at", acked).alias("canary_projected_ms"))
    done = fact.agg(of("projected_at", business).alias("business_projected_ms"))
    # Two single rows.
    return raw.join(F.broadcast(done), F.lit(True))


def verdict(now: dt.datetime, fresh: dt.timedelta = FRESH) -> tuple[Column, Column]:
    """(health, stale_stage) of a watermarks row, judged by canaries alone: idle business traffic is no fault.

    Healthy with an acknowledged canary younger than 15 minutes, or without any canary yet; else
    degraded, at the projector if a canary was received lately, at the collector if not.
    """
    at = F.unix_millis(F.lit(now).cast("timestamp"))
    young = lambda c: F.coalesce(at - F.col(c) < fresh // dt.timedelta(milliseconds=1), F.lit(False))
    received, projected = F.col("canary_received_ms"), F.col("canary_projected_ms")
    # An acknowledged canary was received, too: without any receipt there is nothing to judge.
    healthy = received.isNull() | (projected.isNotNull() & young("canary_projected_ms"))
    stage = F.when(healthy, F.lit(None).cast("string")).when(young("canary_received_ms"), "projector").otherwise("collector")
    return F.when(healthy, "healthy").otherwise("degraded"), stage


def canary_check(ods: DataFrame, event_id: str) -> DataFrame:
    """One row: whether a canary event was received and projected.  Ids of other events are an error."""
    if not event_id.startswith("canary-"):
        raise ValueError(f"not the id of a canary: {event_id!r}")
    hit = ods.filter(F.col("event_id") == event_id)
    return hit.agg((F.count(F.lit(1)) > 0).alias("received"), F.coalesce(F.max(F.col("dwd_status") == "projected"), F.lit(False)).alias("projected"))


def pending(state: DataFrame, now: dt.datetime, limit: int | None = None) -> DataFrame:
    """Work that is due: pending rows, and retries whose time has come, oldest row id first."""
    due = (F.col("status") == "pending") | ((F.col("status") == "retry") & (F.col("next_retry_at") <= F.lit(now)))
    rows = state.filter(due).orderBy("ods_id")
    return rows if limit is None else rows.limit(limit)


def retry_state(count: Column, now: dt.datetime) -> tuple[Column, Column]:
    """(status, next_retry_at) after the ``count``-th failure: a minute up to 3, ten up to 10, then an hour; at 20 the row is given up."""
    wait = F.when(count <= 3, F.expr("INTERVAL 1 MINUTE")).when(count <= 10, F.expr("INTERVAL 10 MINUTE")).otherwise(F.expr("INTERVAL 60 MINUTE"))
    over = count >= MOST_RETRIES
    return F.when(over, "dead_letter").otherwise("retry"), F.when(~over, F.lit(now).cast("timestamp") + wait)
