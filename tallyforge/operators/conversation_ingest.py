"""Ingest of conversation turns: validation, sequence conflicts, first delivery wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.integrity import seq_owners

REQUIRED = ("event_id", "org_id", "created_at", "request_status")
KEY = ["event_id", "conv_date"]


def reject_reason() -> Column:
    """The first required field that is missing or '', or NULL."""
    reason = F.when(F.lit(False), "")
    for c in REQUIRED:
        reason = reason.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"{c} is required")
    return reason


def dispositions(records: DataFrame, arrival: str | list[str], stored: DataFrame | None = None, pinned_org: str = "") -> DataFrame:
    """Every record with ``disposition`` (rejected, duplicated, quarantined, accepted), ``reject_reason`` and ``conv_date``.

    ``arrival`` names columns that are unique together and in the order of delivery.  The first delivery of an (event id, UTC day) is kept, one that is ``stored``
    or repeated is a duplicate.  A kept record whose (org, source, sequence number) belongs to an earlier event
    of another id is quarantined: stored and flagged.  ``pinned_org`` replaces the organisation, where a cluster serves one only.
    """
    rows = records.withColumn("org_id", F.lit(pinned_org)) if pinned_org else records
    rows = rows.withColumns({"reject_reason": reject_reason(), "conv_date": F.to_date("created_at")})
    good = rows.filter("reject_reason is null")
    order = F.struct(*([arrival] if isinstance(arrival, str) else arrival))
    first = good.groupBy(*KEY).agg(F.min(order).alias("__first"))
    source = ["org_id", "source_id"]
    claims = good.select(*source, "source_seq", "event_id", F.struct(F.lit(True).alias("new"), order.alias("order")).alias("__at"))
    if stored is not None:
        first = first.join(stored.select(*KEY).distinct().withColumn("__old", F.lit(True)), KEY, "left")
        earlier = F.struct(F.lit(False).alias("new"), F.lit(None).cast(claims.schema["__at"].dataType["order"].dataType).alias("order"))
        claims = claims.unionByName(stored.select(*source, "source_seq", "event_id", earlier.alias("__at")))
    owners = seq_owners(claims, source, ["__at"]).select(*source, F.col("seq").alias("source_seq"), "owner")
    old = F.coalesce("__old", F.lit(False)) if stored is not None else F.lit(False)
    conflict = F.coalesce(F.col("owner") != F.col("event_id"), F.lit(False))
    fate = (
        F.when(F.col("reject_reason").isNotNull(), "rejected")
        .when(old | (order != F.col("__first")), "duplicated")
        .when(conflict, "quarantined")
        .otherwise("accepted")
    )
    joined = rows.join(first, KEY, "left").join(owners, [*source, "source_seq"], "left")
    return joined.withColumn("disposition", fate).drop("__first", "__old", "owner")


def to_store(disposed: DataFrame) -> DataFrame:
    """What is stored: accepted and quarantined records with their ``ingest_status``."""
    kept = disposed.filter(F.col("disposition").isin("accepted", "quarantined"))
    return kept.withColumn("ingest_status", F.col("disposition")).drop("disposition", "reject_reason")
