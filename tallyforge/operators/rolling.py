"""Totals and averages over trailing periods, idle days included.

Method: a calendar of every day between an entity's first and last activity is
range-joined to the entity's daily totals.  Both sides carry a coarse date
bucket as wide as the longest period, so a calendar day can only meet totals of
its own bucket and the one before; the daily totals (the smaller side) are put
into both buckets they can serve, hence each calendar day sits in exactly one
(entity, bucket) and join and aggregation share a single shuffle on these keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.runtime import checkpoint


def daily_totals(df: DataFrame, entity: list[str], day: str, measures: list[str]) -> DataFrame:
    """One row per entity and day.  Rows with a NULL entity column or day belong to no calendar."""
    known = F.lit(True)
    for c in [*entity, day]:
        known = known & F.col(c).isNotNull()
    return (
        df.filter(known)
        .groupBy(*entity, F.col(day).cast("date").alias("day"))
        .agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures))
    )


def rolling_totals(
    df: DataFrame, entity: list[str], day: str, measures: list[str], periods: tuple[int, ...] = (7, 30)
) -> DataFrame:
    """For each entity and calendar day, sum and daily average of each measure per trailing period.

    Output: entity columns, ``day`` and for measure m and period p ``m_sum_p`` and
    ``m_avg_p`` (the sum divided by p: idle days and days before the first count as 0).
    NULL measures count as 0; an empty input gives an empty result; an entity with one
    row gives one day; further columns of ``df`` are ignored.
    """
    longest = max(periods)
    totals = daily_totals(df, entity, day, measures)
    number = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    bucket = F.floor(number / longest).cast("int")
    # Both sides of the join read the totals: written once, so that the events are scanned once.
    totals = checkpoint(totals.select(*entity, "day", *measures))

    calendar = (
        totals.groupBy(*entity)
        .agg(F.min("day").alias("first"), F.max("day").alias("last"))
        .select(*entity, F.explode(F.sequence("first", "last")).alias("day"))
        .withColumn("bucket", bucket)
    )
    reach = totals.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    reach = reach.select(*entity, "bucket", F.col("day").alias("total_day"), *(F.col(m).alias(f"m{i}") for i, m in enumerate(measures)))
    within = [F.col(f"c.{k}") == F.col(f"t.{k}") for k in [*entity, "bucket"]]
    near = (F.col("t.total_day") <= F.col("c.day")) & (F.col("t.total_day") > F.date_sub(F.col("c.day"), longest))
    joined = calendar.alias("c").join(reach.alias("t"), [*within, near], "left").select(
        *(F.col(f"c.{k}").alias(k) for k in [*entity, "bucket"]),
        "c.day",
        F.datediff("c.day", "t.total_day").alias("age"),
        *(F.col(f"t.m{i}") for i in range(len(measures))),
    )
    sums = []
    for p in periods:
        for i in range(len(measures)):
            value = F.col(f"m{i}") if p == longest else F.when(F.col("age") < p, F.col(f"m{i}"))
            sums.append(F.coalesce(F.sum(value), F.lit(0)).alias(f"s{p}_{i}"))
    found = joined.groupBy(*entity, "bucket", "day").agg(*sums)
    out = []
    for p in periods:
        for i, m in enumerate(measures):
            total = F.col(f"s{p}_{i}")
            out += [total.alias(f"{m}_sum_{p}"), (total.cast("double") / p).alias(f"{m}_avg_{p}")]
    return found.select(*entity, "day", *out)
