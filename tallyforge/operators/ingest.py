"""Ingest of raw events: validation, content hashes, first delivery wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.runtime import checkpoint, hot_keys

REQUIRED = ("event_id", "org_id", "event_time", "occurred_at", "request_status")
HASHED = ("event_id", "input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "output_tokens", "total_tokens", "model")
SCHEME = "sha256:tf1:"
GENERATION_PATHS = ("/messages", "/completions", "/responses")


def reject_reason() -> Column:
    """The first required field that is missing or '', or NULL."""
    reason = F.when(F.lit(False), "")
    for c in REQUIRED:
        reason = reason.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"{c} is required")
    return reason


def content_hash() -> Column:
    """This package's own canonical hash: each field as its length and text, NULL apart from ''."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"),
        F.col(c).cast("string"))) for c in HASHED]
    return F.concat(F.lit(SCHEME), F.sha2(F.concat_ws("\x1f", *parts), 256))


def hash_mismatch() -> Column:
    """A hash of the known scheme that does not fit; absent and unknown ones are accepted."""
    given = F.coalesce(F.col("content_hash"), F.lit(""))
    return given.startswith(SCHEME) & (given != content_hash())


def generates(raw_json: str = "raw_event_json") -> Column:
    """Whether the request path produces text; an absent path counts as yes."""
    path = F.lower(F.rtrim(F.get_json_object(raw_json, "$.request_path"), F.lit("/")))
    hit = F.lit(False)
    for p in GENERATION_PATHS:
        hit = hit | path.endswith(p)
    return F.coalesce(hit, F.lit(True))


def dispositions(df: DataFrame, row_id: str = "ods_id", rows_per_task: int = 2_000_000) -> DataFrame:
    """Every delivery with what became of it: rejected, quarantined, accepted, conflict or duplicate.

    The first delivery (smallest row id) of an (org, event id) is kept, a later one is a
    duplicate, or a conflict if both have a hash and these differ.  First deliveries are found
    by a plain aggregation and joined back on the key; those of messages with more than ``rows_per_task``
    deliveries, of which there are at most rows / ``rows_per_task``, are broadcast, so a message repeated in a third of all rows is no hot group.
    """
    keys = ["org_id", "event_id"]
    valid = df.withColumn("reject_reason", reject_reason())
    good = valid.filter(F.col("reject_reason").isNull())
    first = good.groupBy(*keys).agg(F.min(F.struct(row_id, "content_hash")).alias("__first"))
    hot = checkpoint(hot_keys(good, keys, rows_per_task).select(*keys))
    if hot.isEmpty():
        joined = valid.join(first, keys, "left")
    else:
        often = F.broadcast(first.join(F.broadcast(hot), keys, "left_semi"))
        joined = valid.join(F.broadcast(hot), keys, "left_anti").join(first, keys, "left").unionByName(valid.join(often, keys))
    hashes = (F.coalesce("__first.content_hash", F.lit("")), F.coalesce("content_hash", F.lit("")))
    differs = (hashes[0] != "") & (hashes[1] != "") & (hashes[0] != hashes[1])
    fate = (
        F.when(F.col("reject_reason").isNotNull(), "rejected")
        .when(F.col(row_id) != F.col(f"__first.{row_id}"), F.when(differs, "conflict").otherwise("duplicate"))
        .when((F.col("ingest_status") == "quarantined") | hash_mismatch(), "quarantined")
        .otherwise("accepted")
    )
    return joined.withColumn("disposition", fate).drop("__first")


def tally(disposed: DataFrame) -> DataFrame:
    return disposed.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def insert_or_ignore(incoming: DataFrame, stored_keys: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The rows of a batch whose keys are new: the first per key within the batch, none that is stored."""
    columns = incoming.columns
    others = [c for c in columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(arrival, F.xxhash64(*others)))
    one = incoming.groupBy(*keys).agg(first.alias("r")).select(*keys, "r.*").select(*columns)
    return one.join(stored_keys.select(*keys), keys, "left_anti")


def check_conservation(counts: dict[str, int], arrived: int) -> None:
    """No row may vanish: the fates must add up to what arrived."""
    if sum(counts.values()) != arrived:
        raise AssertionError(f"{arrived} rows arrived, {counts} are accounted for")
