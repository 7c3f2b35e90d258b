"""Raw events to facts, and conversations to records, as streams of micro-batches.

What batch n writes lies in folders of its own and follows from what smaller batches wrote, so a
repeated batch replaces itself: a failure anywhere in it leaves nothing half done.  Rows that cannot
become facts are told apart by expressions and set aside; they never fail the batch of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators import conversation_ingest, projector
from tallyforge.operators.ingest import check_conservation, hash_mismatch, insert_or_ignore, reject_reason
from tallyforge.runtime import checkpoint
from tallyforge.streaming.pipeline import _exists, write_once


def _start(stream: DataFrame, process, root: str, every: str | None) -> StreamingQuery:
    """``every``: an interval such as '5 seconds'; without one, what is there is worked off and the query ends."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger).start()


class ProjectionStream:
    """Facts under ``root/facts``, one folder a batch and in it one a day; canaries only acknowledged, the rest by fate in ``root/aside``.

    A fact is inserted once per (organisation, event id, day), by whichever batch; only days that a batch
    has are looked up in the stored facts.
    """

    def __init__(self, spark: SparkSession, root: str, control: DataFrame) -> None:
        self.spark, self.root, self.control = spark, root, control

    def _stored(self, batch_id: int, days: list) -> DataFrame | None:
        if not _exists(self.spark, f"{self.root}/facts"):
            return None
        stored = self.spark.read.schema("org_id string, event_id string, batch int, usage_date date").parquet(f"{self.root}/facts")
        # The list of days prunes folders; a batch with very many days reads all.
        stored = stored.filter(F.col("usage_date").isin(days)) if len(days) <= 1_000 else stored
        return stored.filter(F.col("batch") < batch_id).select("org_id", "event_id", "usage_date")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        fate = (
            F.when(F.col("virtual_key_id").eqNullSafe("__canary__"), "canary")
            .when(reject_reason().isNotNull(), "rejected")
            .when(F.col("ingest_status").eqNullSafe("quarantined") | hash_mismatch(), "quarantined")
            .otherwise("valid")
        )
        rows = checkpoint(batch.withColumns({"reason": reject_reason(), "fate": fate}))
        valid = rows.filter("fate = 'valid'").drop("reason", "fate")
        made = checkpoint(projector.project(valid, self.control))
        days = [r[0] for r in made.select("usage_date").distinct().limit(1_001).collect()]
        keys = ["org_id", "event_id", "usage_date"]
        stored = self._stored(batch_id, days)
        stored = stored if stored is not None else made.limit(0)
        new = insert_or_ignore(made, stored, keys, "ods_id")
        new.write.mode("overwrite").partitionBy("usage_date").parquet(f"{self.root}/facts/batch={batch_id}")
        write_once(rows.filter("fate <> 'valid'"), f"{self.root}/aside", batch_id)
        counts = {r["fate"]: r["count"] for r in rows.groupBy("fate").count().collect()}
        check_conservation(counts, rows.count())
        summary = [(k, n) for k, n in sorted(counts.items())] or [("valid", 0)]
        write_once(self.spark.createDataFrame(summary, "fate string, n long"), f"{self.root}/tally", batch_id)

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        return _start(stream, self.process, self.root, every)

    def facts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/facts").drop("batch")


class ConversationStream:
    """Conversation records under ``root/records``, one folder a batch and in it one a day; rejected and repeated ones in ``root/aside``."""

    def __init__(self, spark: SparkSession, root: str, arrival: str = "arrival", pinned_org: str = "") -> None:
        self.spark, self.root, self.arrival, self.pinned_org = spark, root, arrival, pinned_org

    def process(self, batch: DataFrame, batch_id: int) -> None:
        stored = None
        if _exists(self.spark, f"{self.root}/records"):
            columns = "event_id string, org_id string, source_id string, source_seq long, batch int, conv_date date"
            stored = self.spark.read.schema(columns).parquet(f"{self.root}/records").filter(F.col("batch") < batch_id)
        rows = checkpoint(conversation_ingest.dispositions(batch, self.arrival, stored, self.pinned_org))
        conversation_ingest.to_store(rows).write.mode("overwrite").partitionBy("conv_date").parquet(f"{self.root}/records/batch={batch_id}")
        write_once(rows.filter(~F.col("disposition").isin("accepted", "quarantined")), f"{self.root}/aside", batch_id)

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        return _start(stream, self.process, self.root, every)

    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/records").drop("batch")
