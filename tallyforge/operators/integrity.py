"""Delivery integrity per source: completeness states, losses that are promoted or confirmed, gap listings.

Watermarks are rows (keys, contiguous_seq, max_seen_seq, client_allocated_seq, updated_at, last_event_at);
the ledger holds (keys, seq, reason) of numbers given up.  ``now`` is a parameter, so results repeat.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import sequences

MAX_LISTED = 10_000


@dataclass(frozen=True)
class Criteria:
    """How old a gap, a tail or a silence must be to count, and a gap to be given up."""

    middle_gap: dt.timedelta = dt.timedelta(minutes=10)
    tail_gap: dt.timedelta = dt.timedelta(minutes=10)
    silence: dt.timedelta = dt.timedelta(hours=24)
    known_loss: dt.timedelta = dt.timedelta(hours=24)


def _ms(d: dt.timedelta) -> int:
    return d // dt.timedelta(milliseconds=1)


def _age(column: str, now: dt.datetime) -> Column:
    return F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col(column).cast("timestamp"))


def classify(watermarks: DataFrame, now: dt.datetime, c: Criteria = Criteria()) -> DataFrame:  # noqa: B008
    """Watermarks with ``status``, ``tail_pending``, ``promotable`` and both ages in seconds.

    The most severe state holds: a hole below the largest seen number, then a tail that was allocated and never came,
    then silence.  An unknown age is never too old; ages are compared in milliseconds.
    """
    stale, quiet = _age("updated_at", now), _age("last_event_at", now)
    late = lambda age, limit: F.coalesce(age > _ms(limit), F.lit(False))
    reach, seen, allocated = (F.coalesce(n, F.lit(0)) for n in ("contiguous_seq", "max_seen_seq", "client_allocated_seq"))
    status = (
        F.when((reach < seen) & late(stale, c.middle_gap), "middle_gap")
        .when((reach < allocated) & late(stale, c.tail_gap), "tail_gap")
        .when(late(quiet, c.silence), "silent")
        .otherwise("ok")
    )
    return watermarks.withColumns(
        {
            "status": status,
            "tail_pending": F.greatest(allocated - F.greatest(seen, reach), F.lit(0)),
            "promotable": (reach < F.greatest(seen, allocated)) & late(stale, c.known_loss),
            "stale_seconds": F.floor(stale / 1000),
            "last_event_age_seconds": F.floor(quiet / 1000),
        }
    )


def source_completeness(
    df: DataFrame, ledger: DataFrame, watermarks: DataFrame, keys: list[str], now: dt.datetime, c: Criteria = Criteria(), seq: str = "source_seq"  # noqa: B008
) -> DataFrame:
    """Classified watermarks with ``gap_count`` (numbers unaccounted for below the largest seen, of middle gaps), ``known_loss`` and ``quarantined``."""
    marks = classify(watermarks, now, c)
    accounted = sequences.received(df, keys, seq, ledger.select(*keys, "seq"))
    gapped = marks.filter("status = 'middle_gap'").select(*keys, "contiguous_seq", "max_seen_seq")
    inside = accounted.join(gapped, keys).filter((F.col("seq") > F.col("contiguous_seq")) & (F.col("seq") <= F.col("max_seen_seq")))
    there = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("there"))
    held = df.filter((F.col("ingest_status") == "quarantined") & F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("quarantined"))
    lost = sequences.known_losses(df, ledger, keys, seq).withColumnRenamed("lost", "known_loss")
    out = marks.join(there, keys, "left").join(held, keys, "left").join(lost, keys, "left")
    holes = F.greatest(F.col("max_seen_seq") - F.col("contiguous_seq") - F.coalesce("there", F.lit(0)), F.lit(0))
    return out.withColumns(
        {
            "gap_count": F.when(F.col("status") == "middle_gap", holes).otherwise(F.lit(0).cast("bigint")),
            "known_loss": F.coalesce("known_loss", F.lit(0)),
            "quarantined": F.coalesce("quarantined", F.lit(0)),
        }
    ).drop("there")


def rollup(completeness: DataFrame) -> DataFrame:
    """One row: sources, those with a gap or silence, quarantined rows, and whether both are none.  Documented losses are healthy."""
    out = completeness.agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("status") != "ok").alias("gap_sources"), F.coalesce(F.sum("quarantined"),
            F.lit(0)).cast("bigint").alias("quarantined")
    )
    return out.withColumn("healthy", (F.col("gap_sources") == 0) & (F.col("quarantined") == 0))


def unaccounted(watermarks: DataFrame, accounted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_seq, last_seq) of the missing runs above ``contiguous_seq``, up to the largest number seen or allocated.

    ``accounted``: distinct (keys, seq) received or entered as lost, as of ``sequences.received``.
    """
    ceiling = F.greatest(F.coalesce("max_seen_seq", F.lit(0)), F.coalesce("client_allocated_seq", F.lit(0)))
    marks = watermarks.select(*keys, F.coalesce("contiguous_seq", F.lit(0)).alias("__from"), ceiling.alias("__to"))
    largest = accounted.groupBy(*keys).agg(F.max("seq").alias("top"))
    tail = marks.join(largest, keys, "left").select(*keys, "__from", "__to", (F.coalesce("top", F.lit(0)) + 1).alias("first_seq"), F.col("__to").alias("last_seq"))
    runs = sequences.gaps(accounted, keys).join(marks, keys).select(*keys, "__from", "__to", "first_seq", "last_seq").unionByName(tail)
    return runs.select(*keys, F.greatest("first_seq", F.col("__from") + 1).alias("first_seq"), F.least("last_seq",
        "__to").alias("last_seq")).filter("first_seq <= last_seq")


def promote_losses(classified: DataFrame, accounted: DataFrame, keys: list[str], reason: str | None = None) -> DataFrame:
    """Ledger rows (keys, seq, reason) of the promotable sources' missing numbers; the reason is ``stale_`` and the state unless given."""
    stale = classified.filter("promotable")
    runs = unaccounted(stale, accounted, keys).join(stale.select(*keys, "status"), keys)
    why = F.concat(F.lit("stale_"), "status") if reason is None else F.lit(reason)
    return runs.select(*keys, F.explode(F.sequence("first_seq", "last_seq")).alias("seq"), why.alias("reason"))


def confirm_losses(watermarks: DataFrame, accounted: DataFrame, claims: DataFrame, keys: list[str], reason: str = "client_confirmed") -> DataFrame:
    """Ledger rows of the claimed (keys, seq) that are truly absent.

    A number that was received or entered, is not positive, or is larger than any seen or
    allocated is no loss, whatever the client says; claims of unknown sources count for nothing.
    """
    ceiling = F.greatest(F.coalesce("max_seen_seq", F.lit(0)), F.coalesce("client_allocated_seq", F.lit(0)))
    able = claims.select(*keys, F.col("seq").cast("long").alias("seq")).distinct().join(watermarks.select(*keys, ceiling.alias("__to")), keys)
    absent = able.filter((F.col("seq") > 0) & (F.col("seq") <= F.col("__to"))).join(accounted, [*keys, "seq"], "left_anti")
    return absent.select(*keys, "seq", F.lit(reason).alias("reason"))


def append_ledger(ledger: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger with new rows; a number that is entered already keeps its reason."""
    return ledger.select(*keys, "seq", "reason").unionByName(news.join(ledger, [*keys, "seq"], "left_anti").select(*keys, "seq", "reason"))


def apply_floors(watermarks: DataFrame, floors: DataFrame, keys: list[str]) -> DataFrame:
    """Watermarks with declared stream floors (keys, floor_seq): what lies below was never sent, which is no loss.

    Floors and contiguous numbers only grow; a source without a watermark gets one; a repeated
    declaration changes nothing; floors that are not positive are ignored.
    """
    most = floors.filter("floor_seq > 0").groupBy(*keys).agg(F.max("floor_seq").cast("long").alias("__floor"))
    out = watermarks.join(most, keys, "full_outer")
    zero = F.lit(0).cast("long")
    old = F.coalesce("stream_floor_seq", zero) if "stream_floor_seq" in watermarks.columns else zero
    floor = F.greatest(old, F.coalesce("__floor", zero))
    raised = {"stream_floor_seq": floor, "contiguous_seq": F.greatest(F.coalesce("contiguous_seq", zero), floor)}
    others = {c: F.coalesce(c, zero) for c in ("max_seen_seq", "client_allocated_seq")}
    return out.withColumns(raised | others).drop("__floor")


def gap_listing(watermarks: DataFrame, accounted: DataFrame, keys: list[str], limit: int = MAX_LISTED) -> DataFrame:
    """(keys, seq, truncated) of the numbers missing within ``limit`` above each source's contiguous number.

    ``truncated``: the span is longer than the limit, and the rest follows once these are settled.  A limit
    that is not positive or above 10,000 counts as 10,000; for whole reports see :func:`unaccounted`.
    """
    limit = limit if 0 < limit <= MAX_LISTED else MAX_LISTED
    ceiling = F.greatest(F.coalesce("max_seen_seq", F.lit(0)), F.coalesce("client_allocated_seq", F.lit(0)))
    span = watermarks.select(*keys, (F.coalesce("contiguous_seq", F.lit(0)) + limit).alias("__until"), (ceiling - F.coalesce("contiguous_seq",
        F.lit(0)) > limit).alias("truncated"))
    runs = unaccounted(watermarks, accounted, keys).join(span, keys)
    runs = runs.withColumn("last_seq", F.least("last_seq", "__until")).filter("first_seq <= last_seq")
    return runs.select(*keys, F.explode(F.sequence("first_seq", "last_seq")).alias("seq"), "truncated")


def watermarks_of(df: DataFrame, keys: list[str], seq: str = "source_seq", allocated: Column | None = None, event_time: str = "event_time",
    arrival: str = "ingest_received_at") -> DataFrame:
    """Watermarks from everything received: numbers, newest event and receipt; ``allocated`` is an aggregate of what clients say they handed out."""
    seqs = sequences.received(df, keys, seq)
    most = F.max(seq).cast("long") if allocated is None else allocated
    times = df.filter(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.max(event_time).alias("last_event_at"), F.max(arrival).alias("updated_at"),
        most.alias("client_allocated_seq"))
    return sequences.contiguous(seqs, keys).join(times, keys)


def seq_owners(df: DataFrame, keys: list[str], order: list[str], seq: str = "source_seq", event_id: str = "event_id") -> DataFrame:
    """(keys, seq, owner): the first event that claimed a number, by ``order`` and then the event id."""
    rows = df.filter(F.col(seq).isNotNull() & (F.coalesce(F.col(keys[-1]), F.lit("")) != ""))
    return rows.groupBy(*keys, F.col(seq).alias("seq")).agg(F.min_by(event_id, F.struct(*order, event_id)).alias("owner"))


def repeated_claims(df: DataFrame, keys: list[str], seq: str = "source_seq", event_id: str = "event_id") -> DataFrame:
    """(keys, seq, events) of numbers that several events claim."""
    rows = df.filter(F.col(seq).isNotNull() & F.col(keys[-1]).isNotNull()).select(*keys, F.col(seq).alias("seq"), event_id).distinct()
    return rows.groupBy(*keys, "seq").agg(F.count(F.lit(1)).alias("events")).filter("events > 1")

