"""Delivery completeness from per-source sequence numbers.

Numbers are cut into blocks of 65,536.  A block is judged by its count, and only one block
per source is looked into, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def _block(seq: str = "seq") -> Column:
    return F.floor((F.col(seq) - 1) / BLOCK).cast("long")


def received(df: DataFrame, keys: list[str], seq: str = "source_seq", ledger: DataFrame | None = None) -> DataFrame:
    """Distinct (keys, seq) that arrived or are entered as lost; NULL sources and numbers below 1 are left out."""
    rows = df.select(*keys, F.col(seq).cast("long").alias("seq"))
    if ledger is not None:
        rows = rows.unionByName(ledger.select(*keys, F.col("seq").cast("long").alias("seq")))
    return rows.filter((F.col("seq") >= 1) & F.col(keys[-1]).isNotNull()).distinct()


def contiguous(seqs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, contiguous_seq, max_seen_seq): the number up to which nothing is missing, 0 if 1 is missing."""
    blocks = seqs.groupBy(*keys, _block().alias("block")).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("top"))
    # A source has one row for each 65,536 numbers here.
    along = Window.partitionBy(*keys).orderBy("block")
    whole = (F.col("n") == BLOCK) & (F.row_number().over(along) == F.col("block") + 1)
    marked = blocks.withColumn("whole", whole)
    broken = F.min(F.when(~F.col("whole"), F.col("block")))
    per = marked.groupBy(*keys).agg(broken.alias("block"), F.max("block").alias("last"), F.max("top").alias("max_seen_seq"))
    per = per.withColumn("block", F.coalesce("block", F.col("last") + 1))
    first = marked.join(per.select(*keys, F.col("block").alias("to")), keys).filter(F.col("block") < F.col("to")).groupBy(*keys).agg(F.count(F.lit(1)).alias("full"))
    per = per.join(first, keys, "left").withColumn("base", F.coalesce("full", F.lit(0)) * BLOCK)
    inside = seqs.join(per.select(*keys, "base"), keys).filter((F.col("seq") > F.col("base")) & (F.col("seq") <= F.col("base") + BLOCK))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    reach = inside.withColumn("place", place).filter(F.col("seq") == F.col("base") + F.col("place")).groupBy(*keys).agg(F.max("seq").alias("reach"))
    return per.join(reach, keys, "left").select(*keys, F.coalesce("reach", "base").alias("contiguous_seq"), "max_seen_seq")


def gaps(seqs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_seq, last_seq) of every run of missing numbers between 1 and the largest seen.

    Neighbours are compared within a block; a block's first number is compared with the largest
    of the blocks before, of which a source has one row for each 65,536 numbers.
    """
    rows = seqs.withColumn("block", _block())
    tops = rows.groupBy(*keys, "block").agg(F.max("seq").alias("top"))
    earlier = F.lag("top", 1).over(Window.partitionBy(*keys).orderBy("block"))
    tops = tops.select(*keys, "block", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    inside = F.lag("seq").over(Window.partitionBy(*keys, "block").orderBy("seq"))
    linked = rows.withColumn("before", inside).join(tops, [*keys, "block"])
    first = F.coalesce("before", "earlier") + 1
    return linked.select(*keys, first.alias("first_seq"), (F.col("seq") - 1).alias("last_seq")).filter("first_seq <= last_seq")


def missing(seqs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq) of every missing number.  Long gaps make many rows: prefer :func:`gaps` for reports."""
    return gaps(seqs, keys).select(*keys, F.explode(F.sequence("first_seq", "last_seq")).alias("seq"))


def advance(watermarks: DataFrame, batch: DataFrame, keys: list[str], floors: DataFrame | None = None) -> DataFrame:
    """Stored (keys, contiguous_seq, max_seen_seq) after a batch: both only ever grow.

    ``batch`` has contiguous_seq and max_seen_seq over everything received so far; ``floors``
    (keys, floor_seq) lifts the contiguous number over what was never sent, which is no loss.
    """
    out = watermarks.select(*keys, F.col("contiguous_seq").alias("c"), F.col("max_seen_seq").alias("m")).join(batch, keys, "full_outer")
    at_least = [F.coalesce("contiguous_seq", F.lit(0)), F.coalesce("c", F.lit(0))]
    if floors is not None:
        out = out.join(floors.select(*keys, "floor_seq"), keys, "full_outer")
        at_least.append(F.coalesce("floor_seq", F.lit(0)))
    most = F.greatest(F.coalesce("max_seen_seq", F.lit(0)), F.coalesce("m", F.lit(0)))
    return out.select(*keys, F.greatest(*at_least).alias("contiguous_seq"), most.alias("max_seen_seq"))


def known_losses(df: DataFrame, ledger: DataFrame, keys: list[str], seq: str = "source_seq") -> DataFrame:
    """Per keys, the ledger's numbers that did not arrive after all."""
    there = received(df, keys, seq)
    return ledger.select(*keys, "seq").distinct().join(there, [*keys, "seq"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("lost"))


def completeness(df: DataFrame, keys: list[str], seq: str = "source_seq", ledger: DataFrame | None = None) -> DataFrame:
    """Per keys: span, contiguous and missing numbers, and how many rows are quarantined."""
    seqs = received(df, keys, seq, ledger)
    counts = seqs.groupBy(*keys).agg(F.count(F.lit(1)).alias("received"))
    held = df.filter((F.col("ingest_status") == "quarantined") & F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("quarantined"))
    out = contiguous(seqs, keys).join(counts, keys).join(held, keys, "left")
    holes = F.greatest(F.col("max_seen_seq") - F.col("received"), F.lit(0))
    return out.select(*keys, "contiguous_seq", "max_seen_seq", "received", holes.alias("missing"), F.coalesce("quarantined", F.lit(0)).alias("quarantined"))
