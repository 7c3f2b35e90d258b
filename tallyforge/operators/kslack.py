"""Totals by event time, corrected by late events up to a cut-off (K-slack reordering).

Every event waits in the buffer of its period until the period's end plus the
lateness bound has passed on the arrival clock.  Until then provisional totals
of the buffer are published; at the bound the period's events are released in
event-time order into the final, order-sensitive aggregation.  What arrives at
or after the bound is rejected.

The release is spread over tasks by *ranges* of (event time, row id), never by
period, so a period with a third of all rows is still shared by many tasks; each
task folds its stretch into one segment per period and the few segments of a
period are merged in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.runtime import checkpoint

ON_TIME, CORRECTS, REJECTED = "on_time", "corrects", "rejected"


def buffered(df: DataFrame, event_time: str, arrival: str, lateness_days: int = 3) -> DataFrame:
    """Every row with its ``period`` (UTC day), ``closes_at``, ``release_at`` and ``outcome``.

    ``on_time``: received before the period's end; ``corrects``: before the release;
    ``rejected``: at or after it.  A row with a NULL event or arrival time has a NULL
    outcome and enters no total.  Columns of these four names in ``df`` are replaced.
    """
    period = F.to_date(event_time)
    closes = F.date_add(F.to_date(event_time), 1).cast("timestamp")
    release = F.date_add(F.to_date(event_time), 1 + lateness_days).cast("timestamp")
    return df.withColumns(
        {
            "period": period,
            "closes_at": closes,
            "release_at": release,
            "outcome": F.when(F.col(event_time).isNull() | F.col(arrival).isNull(), F.lit(None).cast("string"))
            .when(F.col(arrival) < closes, ON_TIME)
            .when(F.col(arrival) < release, CORRECTS)
            .otherwise(REJECTED),
        }
    )


def provisional_totals(buffer: DataFrame, arrival: str, measure: str, lateness_days: int = 3) -> DataFrame:
    """Totals of each period's buffer as published at every midnight from its end to its release.

    One row per period and publication (``as_of``); the last one, at the release,
    equals the final total.  Pre-aggregated by arrival day, so a period has at most
    ``lateness_days`` + 1 rows before the running sum.
    """
    step = F.greatest(F.datediff(F.to_date(arrival), F.col("period")), F.lit(0))
    parts = (
        buffer.filter(F.col("outcome").isin(ON_TIME, CORRECTS))
        .groupBy("period", step.alias("step"))
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(measure), F.lit(0)).alias("total"))
    )
    every = parts.select("period").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(lateness_days))))
    running = Window.partitionBy("period").orderBy("step")
    return every.join(parts, ["period", "step"], "left").select(
        "period",
        F.date_add("period", F.col("step") + 1).alias("as_of"),
        (F.col("step") == lateness_days).alias("is_final"),
        F.coalesce(F.sum("n").over(running), F.lit(0)).alias("events"),
        F.coalesce(F.sum("total").over(running), F.lit(0)).alias(measure),
    )


def released(df: DataFrame, event_time: str, arrival: str, row_id: str, lateness_days: int = 3) -> DataFrame:
    """(``row_id``, ``outcome``): each row as it leaves the buffer when the arrivals are replayed.

    Every task replays one range of (arrival, row id), in order, behind a clock of its own arrivals.
    At each midnight the clock passes, periods at their bound are released in event-time order;
    a released row is ``on_time`` or, if it came in after its period's first provisional total was
    published, ``corrects``.  A row whose period the clock has released already is turned away
    (``rejected``).  What is buffered at the end of a range is released then: its bound passes in a later
    range or with the end of the table.  A row with a NULL event or arrival time is not taken in.
    """
    arrivals = df.filter(F.col(event_time).isNotNull() & F.col(arrival).isNotNull()).select(
        F.col(arrival).alias("a"),
        F.col(row_id).cast("long").alias("id"),
        F.unix_micros(F.col(event_time).cast("timestamp")).alias("t"),
        F.unix_date(F.to_date(event_time)).alias("period"),
        F.unix_date(F.to_date(arrival)).alias("day"),
    )

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        midnight = None

        def release(rows: pd.DataFrame) -> pd.DataFrame:
            return rows.sort_values(["t", "id"])[["id", "outcome"]]

        for pdf in batches:
            for day, came in pdf.groupby("day"):
                if day != midnight and held:
                    buffer = pd.concat(held)
                    due = buffer["period"] + 1 + lateness_days <= day
                    yield release(buffer[due])
                    held = [buffer[~due]]
                midnight = day
                shut = came["period"] + 1 + lateness_days <= day
                yield came[shut].assign(outcome=REJECTED)[["id", "outcome"]]
                published = came["period"] + 1 <= day
                for rows, outcome in ((came[~shut & ~published], ON_TIME), (came[~shut & published], CORRECTS)):
                    if len(rows):
                        held.append(rows[["id", "t", "period"]].assign(outcome=outcome))
        if held:
            yield release(pd.concat(held))

    # Sampling for the ranges reads the arrivals once more than the replay.
    replayed = checkpoint(arrivals).repartitionByRange("a", "id").sortWithinPartitions("a", "id").mapInPandas(replay, "id long, outcome string")
    return replayed.select(F.col("id").alias(row_id), "outcome")


_SEGMENT = "period date, lo timestamp, lo_id long, hi timestamp, hi_id long, lo_state string, hi_state string, events long, total long, max_gap_us long, switches long"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of a sorted stretch; holds one open segment, whatever the stretch's length."""
    open_: dict | None = None
    for pdf in batches:
        out = []
        for period, g in pdf.groupby("period", sort=False):
            t, state = g["t"], g["state"].fillna("")
            seg = {
                "period": period, "lo": t.iloc[0], "lo_id": g["id"].iloc[0], "hi": t.iloc[-1], "hi_id": g["id"].iloc[-1],
                "lo_state": state.iloc[0], "hi_state": state.iloc[-1], "events": len(g), "total": int(g["v"].sum()),
                "max_gap_us": int(t.diff().max() / pd.Timedelta(microseconds=1)) if len(g) > 1 else 0,
                "switches": int((state.values[1:] != state.values[:-1]).sum()),
            }
            if open_ and open_["period"] == period:
                open_ |= {
                    "max_gap_us": max(open_["max_gap_us"], seg["max_gap_us"], int((seg["lo"] - open_["hi"]) / pd.Timedelta(microseconds=1))),
                    "switches": open_["switches"] + seg["switches"] + (open_["hi_state"] != seg["lo_state"]),
                    "events": open_["events"] + seg["events"], "total": open_["total"] + seg["total"],
                    "hi": seg["hi"], "hi_id": seg["hi_id"], "hi_state": seg["hi_state"],
                }
            else:
                if open_:
                    out.append(open_)
                open_ = seg
        if out:
            yield pd.DataFrame(out)
    if open_:
        yield pd.DataFrame([open_])


def final_totals(buffer: DataFrame, event_time: str, row_id: str, measure: str, state: str) -> DataFrame:
    """Final aggregation of each period's released events, in order of (event time, row id).

    Output per period: events, the measure's total, first and last row id, the longest
    silence between neighbours in seconds and how often ``state`` changed.  NULL measures
    count as 0, NULL states as ''.  An empty buffer gives no rows.
    """
    released = buffer.filter(F.col("outcome").isin(ON_TIME, CORRECTS)).select(
        "period", F.col(event_time).alias("t"), F.col(row_id).alias("id"), F.coalesce(F.col(measure), F.lit(0)).cast("long").alias("v"), F.col(state).alias("state")
    )
    segments = released.repartitionByRange("t", "id").sortWithinPartitions("t", "id").mapInPandas(_fold, _SEGMENT)
    # A period has at most one segment for each task: bounded by the number of tasks.
    order = Window.partitionBy("period").orderBy("lo", "lo_id")
    linked = segments.withColumns(
        {
            "gap_us": F.coalesce(F.unix_micros("lo") - F.unix_micros(F.lag("hi").over(order)), F.lit(0)),
            "switch": F.when(F.lag("hi_state").over(order) != F.col("lo_state"), 1).otherwise(0),
        }
    )
    return linked.groupBy("period").agg(
        F.sum("events").alias("events"),
        F.sum("total").alias(measure),
        F.min_by("lo_id", F.struct("lo", "lo_id")).alias("first_id"),
        F.max_by("hi_id", F.struct("hi", "hi_id")).alias("last_id"),
        (F.greatest(F.max("max_gap_us"), F.max("gap_us")) / 1e6).alias("longest_silence_s"),
        (F.sum("switches") + F.sum("switch")).alias("state_switches"),
    )
