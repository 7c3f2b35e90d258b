"""Exact percentiles per group by distributed multi-select.

Values are first counted per (group, value), map-side, which is also the state
that days or partitions exchange: ``merge_counts`` adds such tables up, and the
percentiles of the sum are those of the whole.  Then, for every group and wanted
rank at once, rounds narrow a value range: each partition of the counts proposes
the local medians of the equal-weight stretches of its part of the range, the
weighted median of all proposals becomes a pivot, with the weighted quantiles at
both sides of it as further pivots, weights below, at and above the pivots are
counted, and the ranges that cannot hold the rank are discarded.  What is left is
written to the shared folder, so the rounds read a shrinking table.  With one
stretch and one pivot this is the plain median rule; several cut the rounds to a
quarter.  Only whether a rank is still open reaches the driver.

Error: none (the value at rank ceil(q * n) is returned).  With ``relative_error``
e > 0, values are counted in logarithmic bins, which bounds the size of the
mergeable state; a result then lies within a factor 1 +- e of the exact one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.runtime import checkpoint

_ROUNDS = 100  # each round discards a constant share of the candidates


def value_counts(df: DataFrame, group: list[str], value: str, relative_error: float = 0.0) -> DataFrame:
    """Mergeable state: group columns, ``value`` (double), ``weight``.  NULL and NaN values are left out."""
    v = F.col(value).cast("double")
    rows = df.select(*group, v.alias("value")).filter(v.isNotNull() & ~F.isnan(v))
    if relative_error:
        rows = rows.withColumn("value", _bin(F.col("value"), relative_error))
    return rows.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("weight"))


def _bin(v: Column, e: float) -> Column:
    """The representative of a value's logarithmic bin, within a factor 1 +- e of it."""
    base = (1 + e) / (1 - e)
    middle = F.lit(2.0) / (1 + base) * F.pow(F.lit(base), F.ceil(F.log(F.abs(v)) / math.log(base)))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * middle)


def merge_counts(*states: DataFrame, group: list[str]) -> DataFrame:
    """The state of several parts or days taken together."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy(*group, "value").agg(F.sum("weight").alias("weight"))


def _local_medians(stretches: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def medians(b: pd.DataFrame) -> pd.DataFrame:
        """The weighted median of each equal-weight stretch of each target."""
        b = b.sort_values(["target", "value"], kind="stable")
        total = b.groupby("target")["weight"].transform("sum")
        upto = b.groupby("target")["weight"].cumsum()
        # Row i covers the weights (upto - weight, upto]; a stretch's median is the row over its middle.
        last = (upto * stretches / total + 0.5).astype("int64").clip(upper=stretches)
        first = ((upto - b["weight"]) * stretches / total + 0.5).astype("int64")
        b = b.assign(weight=(last - first) * (total / stretches))[last > first]
        return b

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [medians(b) for b in batches if len(b)]
        if parts:
            yield medians(pd.concat(parts, ignore_index=True))

    return each


_LISTED, _SALTS = 10_000, 16


def _beside(left: DataFrame, chosen: DataFrame, targets: int) -> DataFrame:
    """Candidates with their target's pivots: broadcast for at most 10,000 targets (a few MB), or else joined on the
    target and a salt, as one target may hold a third of the candidates."""
    if targets <= _LISTED:
        return left.join(F.broadcast(chosen), "target")
    salted = left.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(_SALTS)).cast("int"))
    every = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(every, ["target", "salt"]).drop("salt")


def percentiles(counts: DataFrame, group: list[str], qs: list[float], pivots: int = 15) -> DataFrame:
    """The values at rank ceil(q * n) of each group.

    Output: group columns, ``q``, ``value``, ``n`` (the group's weight).  NULL group
    values form a group of their own; a group of one value gives it for every q; an
    empty input gives no rows.
    """
    counts = checkpoint(counts.select(*group, "value", "weight"))
    state = (
        counts.groupBy(*group)
        .agg(F.sum("weight").alias("n"))
        .select(*group, F.explode(F.array(*(F.lit(float(q)) for q in qs))).alias("q"), "n")
        .withColumn("rank", F.greatest(F.ceil(F.col("q") * F.col("n") - F.lit(1e-9)), F.lit(1)).cast("long"))
        .withColumn("target", F.monotonically_increasing_id())
    )
    state = checkpoint(state)
    targets = state.count()
    # State is (groups x percentiles) rows; whether it is broadcast is up to its measured size.
    s = state.select("target", "rank", *(F.col(g).alias(f"s_{i}") for i, g in enumerate(group)))
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"s_{i}")) for i, g in enumerate(group)]
    left = counts.alias("c").join(s, same).select("target", "c.value", "c.weight", "rank", F.lit(0).cast("long").alias("below"))
    found: list[DataFrame] = []
    by_target, ordered = Window.partitionBy("target"), Window.partitionBy("target").orderBy("value")
    for _ in range(_ROUNDS):
        proposals = left.select("target", "value", "weight").mapInPandas(_local_medians(pivots), "target long, value double, weight double")
        # A target has at most (partitions x stretches) proposals.
        share = F.sum("weight").over(ordered) / F.sum("weight").over(by_target)
        before = share - F.col("weight") / F.sum("weight").over(by_target)
        steps = lambda c: F.floor(c * (pivots + 1) + 1e-9)
        chosen = proposals.withColumns({"since": steps(before), "upto": steps(share)}).filter("upto > since")
        chosen = chosen.groupBy("target").agg(F.array_sort(F.collect_set("value")).alias("pivots"))
        below_v = F.size(F.filter("pivots", lambda p: p < F.col("value")))
        slot = 2 * below_v + F.array_contains("pivots", F.col("value")).cast("int")
        counted = (
            _beside(left, chosen, targets)
            .groupBy("target", slot.alias("slot"))
            .agg(F.sum("weight").alias("weight"), F.first("pivots").alias("pivots"), F.first("rank").alias("rank"), F.first("below").alias("below"))
        )
        # At most 2 x pivots + 1 slots for each target.
        upto = F.col("below") + F.sum("weight").over(Window.partitionBy("target").orderBy("slot"))
        at = counted.withColumn("upto", upto).filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("weight")))
        odd, place = F.col("slot") % 2 == 1, F.floor(F.col("slot") / 2).cast("int")
        at = checkpoint(
            at.select(
                "target",
                F.when(odd, F.get("pivots", place)).alias("value"),
                F.get("pivots", place - 1).alias("lo"),
                F.get("pivots", place).alias("hi"),
                (F.col("upto") - F.col("weight")).alias("passed"),
            )
        )
        found.append(at.filter("value is not null").select("target", "value"))
        if at.filter("value is null").isEmpty():
            break
        open_ = at.filter("value is null").drop("value")
        inside = (F.col("lo").isNull() | (F.col("value") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") < F.col("hi")))
        left = checkpoint(left.join(open_, "target").filter(inside).select("target", "value", "weight", "rank", F.col("passed").alias("below")))
    else:
        raise RuntimeError("multi-select did not converge")
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    return state.join(values, "target").select(*group, "q", "value", "n")
