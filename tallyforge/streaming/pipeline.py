"""Structured Streaming around the batch operators: each micro-batch is a pure function of
what is stored and what arrived, and a repeated batch id changes nothing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from tallyforge.operators import kslack
from tallyforge.operators.idindex import IdentifierIndex, named
from tallyforge.runtime import normal_id


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _fields(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def write_once(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder a batch, replaced if the batch is repeated."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


class DedupStream:
    """Keeps the first delivery of each message, over any horizon, in an index on disk.

    As in ``kept_deliveries``, a row of which a part of the identifier is NULL is always kept.
    ``row_id`` must be a 64-bit number that is unique among all deliveries.
    """

    def __init__(self, spark: SparkSession, root: str, row_id: str, order: str, parts: list[Column] | None = None, expected: int = 100_000_000) -> None:
        self.index = IdentifierIndex(spark, f"{root}/index", IdentifierIndex.bits_for(expected))
        self.spark, self.root, self.row_id, self.order = spark, root, row_id, order
        self.parts = parts or [normal_id("org_id"), normal_id("event_id")]

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Kept rows are written before the batch counts as taken in: a failure anywhere between repeats both."""

        def write(run: str) -> None:
            kept = self.index.kept_rows([run], self.row_id)
            first = batch.filter(named(self.parts)).join(kept, self.row_id, "left_semi")
            write_once(first.unionByName(batch.filter(~named(self.parts))), f"{self.root}/kept", batch_id)

        self.index.add(batch, self.parts, self.row_id, [self.order], merge_every=8, batch_id=batch_id, before=write)

    def start(self, stream: DataFrame) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def kept(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/kept").drop("batch")


class KSlackStream:
    """K-slack over micro-batches: a buffer on disk, provisional totals while periods are open,
    final ones once the arrival clock has passed their release.

    The clock is the largest arrival seen.  A batch appends its rows to the buffer, by period, and reads
    only the periods it releases; provisional totals are added up from each batch's sums.  What batch n writes lies
    under n and follows from what lies under smaller numbers, so a repeated batch changes
    nothing.  Rows without an event or arrival time are set aside in ``undated``.
    """

    def __init__(self, spark: SparkSession, root: str, event_time: str, arrival: str, row_id: str, measure: str, state: str, lateness_days: int = 3) -> None:
        self.spark, self.root, self.lateness_days = spark, root, lateness_days
        self.event_time, self.arrival, self.row_id, self.measure, self.state = event_time, arrival, row_id, measure, state

    def _clock(self, batch_id: int) -> dt.datetime | None:
        """The clock after the batches before this one."""
        if not _exists(self.spark, f"{self.root}/clock"):
            return None
        return self.spark.read.schema("clock timestamp, batch int").parquet(f"{self.root}/clock").filter(F.col("batch") < batch_id).agg(F.max("clock")).first()[0]

    def _buffer(self, schema: StructType, batch_id: int) -> DataFrame:
        whole = StructType([*schema.fields, *_fields("batch int, period date")])
        if not _exists(self.spark, f"{self.root}/buffer"):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.root}/buffer").filter(F.col("batch") < batch_id)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        columns = [self.event_time, self.arrival, self.row_id, self.measure, self.state]
        rows = batch.select(*columns)
        stored = self._clock(batch_id)
        clock = max((c for c in (rows.agg(F.max(self.arrival)).first()[0], stored) if c is not None), default=None)
        marked = kslack.buffered(rows, self.event_time, self.arrival, self.lateness_days)
        if stored is not None:
            # What was received in time but comes in after its period was released changes nothing any more.
            gone = F.col("outcome").isNotNull() & (F.col("release_at") <= F.lit(stored))
            marked = marked.withColumn("outcome", F.when(gone, kslack.REJECTED).otherwise(F.col("outcome")))
        timely = marked.filter(F.col("outcome").isin(kslack.ON_TIME, kslack.CORRECTS))
        write_once(marked.filter("outcome is null").select(*columns), f"{self.root}/undated", batch_id)
        write_once(marked.filter(F.col("outcome") == kslack.REJECTED), f"{self.root}/rejected", batch_id)
        release = F.date_add("period", 1 + self.lateness_days).cast("timestamp")
        due = F.col("release_at") <= F.lit(clock)
        timely.filter(~due).select(*columns, "period").write.mode("overwrite").partitionBy("period").parquet(f"{self.root}/buffer/batch={batch_id}")
        since = F.lit(True) if stored is None else release > F.lit(stored)
        held = self._buffer(rows.schema, batch_id).filter((release <= F.lit(clock)) & since).select(*columns)
        released = kslack.buffered(held, self.event_time, self.arrival, self.lateness_days).unionByName(timely.filter(due))
        write_once(kslack.final_totals(released, self.event_time, self.row_id, self.measure, self.state), f"{self.root}/final", batch_id)
        sums = timely.groupBy("period").agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(self.measure), F.lit(0)).cast("long").alias(self.measure))
        write_once(sums, f"{self.root}/sums", batch_id)
        every = self.spark.read.schema(StructType([*sums.schema.fields, *_fields("batch int")])).parquet(f"{self.root}/sums").filter(F.col("batch") <= batch_id)
        is_open = (release > F.lit(clock)) if clock is not None else F.lit(True)
        provisional = every.filter(is_open).groupBy("period").agg(F.sum("events").alias("events"), F.sum(self.measure).alias(self.measure))
        write_once(provisional, f"{self.root}/provisional", batch_id)
        write_once(self.spark.range(1).select(F.lit(clock).cast("timestamp").alias("clock")), f"{self.root}/clock", batch_id)
        if stored is not None:
            self._forget(stored)

    def _forget(self, stored: dt.datetime) -> None:
        """Delete the buffered rows of periods that earlier batches have released."""
        glob = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/buffer/batch=*/period=*")
        fs = glob.getFileSystem(self.spark._jsc.hadoopConfiguration())
        # A day more, as the clock comes back in the driver's own time zone.
        last = (stored - dt.timedelta(days=2 + self.lateness_days)).date()
        for found in fs.globStatus(glob) or []:
            name = found.getPath().getName().removeprefix("period=")
            if name[:4].isdigit() and dt.date.fromisoformat(name) <= last:
                fs.delete(found.getPath(), True)

    def start(self, stream: DataFrame) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def final(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/final").drop("batch")
