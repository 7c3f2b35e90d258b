"""Attributes as known at event time, from independent change histories per attribute.

Every attribute has a change log of its own, with its own source, times and priority; logs are stored and
appended to separately (:class:`HistoryStore`), so one attribute can change without any version of the others.
A version of an attribute counts at time e if it took effect and was recorded by e
and has not ended; of several the one with the highest priority holds.  So it
competes over [max(effective, recorded), end), and its value at e is the highest
priority among the intervals that contain e.

Logs are resolved without pairing versions of a key: the times at which an (attribute, key) can
change are numbered in order, densely; each interval of
numbers is split into its canonical dyadic pieces and a piece keeps only its best
version (a plain max, combined map-side); the version that holds from a time on
is the best over the pieces around its number, one for each level that has any.  At a low level at
most 65,536 numbers share a piece; pieces of higher levels are few (at most numbers / 32,768) and broadcast.

The resolved changes of each attribute, and only its own, are stored by attribute, cut at coarse time buckets.
Events and changes meet sorted by time within (key, bucket): one pass takes the last
known change of each attribute separately and turns them back into columns, with one shuffle
whatever the number of attributes.

The numbering works on chunks of a range partitioning, so a key with a third of
all versions spans many tasks; (key, bucket) pairs with many events are salted.
Columns whose names begin with two underscores are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.runtime import checkpoint, hot_keys, shared_dir

_DAY_US = 86_400_000_000
_LOW = 16  # levels whose pieces cover at most 2 ** 15 numbers and their neighbours


@dataclass(frozen=True)
class Attribute:
    """One attribute's change log: where its versions are, their times, which wins, and the value."""

    versions: DataFrame
    key: str
    effective_from: str
    effective_to: str
    recorded_at: str
    priority: list[Column]
    value: Column


class HistoryStore:
    """Stored change logs below ``path``, a folder an attribute and in it one for every appended batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, name: str, batch_id: int, log: Attribute) -> None:
        """Append versions of one attribute; a batch id that is repeated replaces itself."""
        ranks = [p.alias(f"p{i}") for i, p in enumerate(log.priority)]
        times = [F.col(c).cast("timestamp").alias(n) for c, n in ((log.effective_from, "since"), (log.effective_to, "until"), (log.recorded_at, "recorded"))]
        log.versions.select(F.col(log.key).alias("key"), *times, *ranks,
            log.value.alias("value")).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")

    def log(self, name: str) -> Attribute:
        """Everything appended to an attribute so far."""
        rows = self.spark.read.parquet(f"{self.path}/{name}").drop("batch")
        ranks = sorted((c for c in rows.columns if c[0] == "p" and c[1:].isdigit()), key=lambda c: int(c[1:]))
        return Attribute(rows, "key", "since", "until", "recorded", [F.col(c) for c in ranks], F.col("value"))


def _shift(name: str, value: Column, bits: Column) -> Column:
    return F.call_function(name, value, bits)


def _bits(value: Column) -> Column:
    """Number of binary digits of a number >= 1."""
    return F.length(F.bin(value)).cast("int")


_OF = ["__attr", "__key"]


def _numbered(versions: DataFrame) -> DataFrame:
    """(attr, key, chunk, start, end, id) of every time at which a key can change, numbered from 1 without gaps."""
    points = versions.select(*_OF, F.explode(F.array("__s", "__t")).alias("__start")).distinct()
    points = checkpoint(points.repartitionByRange(*_OF, "__start").withColumn("__chunk", F.spark_partition_id()))
    in_chunk = Window.partitionBy("__chunk").orderBy(*_OF, "__start")
    # One row for each range partition: its first point and the numbers before it.
    chunks = points.groupBy("__chunk").agg(F.min(F.struct(*_OF, "__start")).alias("head"), F.count(F.lit(1)).alias("size"))
    along = Window.orderBy("__chunk")
    chunks = chunks.select("__chunk", F.lead("head").over(along).alias("h"), (F.sum("size").over(along) - F.col("size")).alias("offset"))
    rows = points.withColumns({"__place": F.row_number().over(in_chunk), "n": F.lead(F.struct(*_OF, "__start")).over(in_chunk)})
    rows = rows.join(F.broadcast(chunks), "__chunk")
    after = F.coalesce("n", "h")
    same = (after["__key"] == F.col("__key")) & (after["__attr"] == F.col("__attr"))
    return checkpoint(rows.select(*_OF, "__chunk", "__start", F.when(same, after["__start"]).alias("__end"),
        (F.col("offset") + F.col("__place")).cast("long").alias("__id")))


def _resolved(versions: DataFrame, best: str) -> DataFrame:
    """Non-overlapping stretches (attr, key, chunk, id, start, end, best) from (attr, key, __s, __t, best)."""
    numbered = _numbered(versions)
    at = lambda name, alias: numbered.select(*_OF, F.col("__start").alias(name), F.col("__id").alias(alias))
    ranged = versions.join(at("__s", "a"), [*_OF, "__s"]).join(at("__t", "b"), [*_OF, "__t"])
    lo = _shift("shiftright", F.col("a") + _shift("shiftleft", F.lit(1).cast("long"), F.col("level")) - 1, F.col("level"))
    hi = _shift("shiftright", F.col("b"), F.col("level"))
    odd = lambda c: F.pmod(c, F.lit(2)) == 1
    nodes = F.array(F.when(odd(F.col("lo")), F.col("lo")), F.when(odd(F.col("hi")), F.col("hi") - 1))
    pieces = checkpoint(
        ranged.withColumn("level", F.explode(F.sequence(F.lit(0), _bits(F.col("b") - F.col("a")))))
        .withColumns({"lo": lo, "hi": hi})
        .filter("lo < hi")
        .select(*_OF, "level", F.explode(nodes).alias("node"), best)
        .filter("node is not null")
        .groupBy(*_OF, "level", "node")
        .agg(F.max(best).alias(best))
    )
    levels = pieces.groupBy(*_OF).agg(F.collect_set("level").alias("levels"))
    looked = numbered.join(levels, _OF).withColumn("level", F.explode("levels")).drop("levels")
    looked = looked.withColumn("node", _shift("shiftright", F.col("__id"), F.col("level")))
    on = [*_OF, "level", "node"]
    low = looked.filter(F.col("level") < _LOW).join(pieces.filter(F.col("level") < _LOW), on)
    high = looked.filter(F.col("level") >= _LOW).join(F.broadcast(pieces.filter(F.col("level") >= _LOW)), on)
    return (
        low.unionByName(high)
        .groupBy(*_OF, "__chunk", "__id")
        .agg(F.min("__start").alias("__start"), F.min("__end").alias("__end"), F.max(best).alias(best))
    )


def _changes(stretches: DataFrame, value: Column) -> DataFrame:
    """Each attribute's own changes: adjoining stretches of equal value become one (within a chunk)."""
    order = Window.partitionBy("__chunk").orderBy("__id")
    rows = stretches.select(*_OF, "__chunk", "__id", "__start", "__end", value.alias("__value"))
    same = (
        (F.lag("__attr").over(order) == F.col("__attr"))
        & (F.lag("__key").over(order) == F.col("__key"))
        & (F.lag("__end").over(order) == F.col("__start"))
        & F.lag("__value").over(order).eqNullSafe(F.col("__value"))
    )
    rows = rows.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(order))
    return rows.groupBy(*_OF, "__chunk", "__run").agg(F.min("__start").alias("__start"), F.max("__end").alias("__end"), F.min_by("__value", "__id").alias("__value"))


def _log(number: int, log: Attribute, values: list[Column], micros, until: int) -> DataFrame:
    """One attribute's versions as (attr, key, s, t, best); ``best`` has a field for each attribute, of which it fills its own."""
    both = F.when(F.col(log.effective_from).isNotNull() & F.col(log.recorded_at).isNotNull(), F.greatest(micros(log.effective_from), micros(log.recorded_at)))
    ranks = [p.alias(f"p{i}") for i, p in enumerate(log.priority)]
    v = log.versions.select(
        F.lit(number).alias("__attr"),
        F.col(log.key).alias("__key"),
        F.greatest(both, F.when(both.isNotNull(), F.lit(0))).alias("__s"),
        F.least(F.coalesce(micros(log.effective_to), F.lit(until)), F.lit(until)).alias("__t"),
        F.struct(*ranks).alias("__rank"),
        F.struct(*values).alias("__all"),
    )
    return v.filter(F.col("__key").isNotNull() & F.col("__s").isNotNull() & (F.col("__s") < F.col("__t"))).distinct()


def match(
    events: DataFrame, logs: dict[str, Attribute], *, key: str, event_time: str, row_id: str, bucket_days: int = 7, rows_per_task: int = 2_000_000,
        path: str | None = None
) -> DataFrame:
    """Every event row with each attribute of ``logs`` as in effect and already recorded at its time.

    Attributes are NULL where no version applies: unknown or NULL key, NULL event time, no
    versions at all.  A version with a NULL start or recording time never applies; a NULL end is open; full ties of
    priority are broken by the greater value.  Repeated versions and events do no
    harm; events keep all their columns, of which those named like an attribute are
    replaced.  The priorities of all logs have the same types.  ``path``: where the resolved histories are stored.
    """
    spark, names = events.sparkSession, list(logs)
    kept = [c for c in events.columns if c.lower() not in {a.lower() for a in names}]
    kinds = [log.versions.select(log.value.alias("v")).schema["v"].dataType for log in logs.values()]
    none = [F.lit(None).cast(t).alias(n) for n, t in zip(names, kinds, strict=True)]
    bounds = events.agg(F.min(event_time).alias("lo"), F.max(event_time).alias("hi"))
    bounds = bounds.select(F.unix_micros(F.col("lo").cast("timestamp")), F.unix_micros(F.col("hi").cast("timestamp"))).first()
    if bounds[0] is None:
        return events.select(*kept, *none)
    origin, until = bounds[0], bounds[1] + 1 - bounds[0]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) - origin
    parts = []
    for i, log in enumerate(logs.values()):
        values = [(log.value if j == i else F.lit(None)).cast(t).alias(f"v{j}") for j, t in enumerate(kinds)]
        parts.append(_log(i, log, values, micros, until))
    versions = reduce(DataFrame.unionByName, parts).withColumn("__best", F.struct("__rank", "__all")).drop("__rank", "__all")
    changes = _changes(_resolved(versions, "__best"), F.col("__best.__all"))

    # The histories are stored by attribute, cut at the buckets: a bucket begins with what was known before it.
    width = bucket_days * _DAY_US
    bucket = F.explode(F.sequence(F.floor(F.col("__start") / width).cast("int"), F.floor((F.col("__end") - 1) / width).cast("int")))
    path = path or shared_dir(spark, "histories")
    cut = changes.select(*_OF, "__start", "__end", "__value", bucket.alias("__bucket")).withColumn("__start", F.greatest("__start",
        F.col("__bucket").cast("long") * width))
    cut.write.mode("overwrite").partitionBy("__attr").parquet(path)
    history = spark.read.schema(cut.schema).parquet(path)

    timed = events.withColumns({"__e": micros(event_time), "__key": F.col(key)})
    known = F.col("__key").isNotNull() & F.col("__e").isNotNull()
    rows = timed.filter(known).withColumn("__bucket", F.floor(F.col("__e") / width).cast("int"))
    # At most (events / rows_per_task) rows.
    hot = checkpoint(hot_keys(rows, ["__key", "__bucket"], rows_per_task))
    on = ["__key", "__bucket"]
    if not hot.isEmpty():
        salts = F.coalesce("__salts", F.lit(1))
        rows = rows.join(F.broadcast(hot), on, "left").withColumn("__salt", F.pmod(F.xxhash64(row_id), salts).cast("int")).drop("__salts")
        history = history.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
        on = [*on, "__salt"]
    carried = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(1))
    rows = rows.select(*on, F.col("__e").alias("__at"), carried.alias("__row"), F.lit(None).cast("int").alias("__attr"))
    rows = rows.withColumns({"__end": F.lit(None).cast("long"), "__value": F.lit(None).cast(cut.schema["__value"].dataType)})
    news = history.select(*on, F.col("__start").alias("__at"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), "__attr", "__end", "__value")
    # A change comes before the events of its moment.  Each attribute looks for its own last change.
    past = Window.partitionBy(*on).orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(news)
    last = {f"__last{i}": F.last(F.when(F.col("__attr") == i, F.struct("__end", F.col(f"__value.v{i}").alias("v"))),
        ignorenulls=True).over(past) for i in range(len(names))}
    found = both.withColumns(last).filter("__row is not null")
    columns = [F.when(F.col(f"__last{i}.__end") > F.col("__at"), F.col(f"__last{i}.v")).alias(n) for i, n in enumerate(names)]
    found = found.select(*([F.col(f"__row.`{c}`").alias(c) for c in kept]), *columns)
    return found.unionByName(timed.filter(~known).select(*kept, *none))


def attributes_asof(
    events: DataFrame,
    versions: DataFrame,
    *,
    key: str,
    event_time: str,
    effective_from: str,
    effective_to: str,
    recorded_at: str,
    priority: list[Column],
    attributes: dict[str, Column],
    row_id: str,
    bucket_days: int = 7,
    rows_per_task: int = 2_000_000,
) -> DataFrame:
    """:func:`match` for attributes that come with one table of versions: each gets a log and a history of its own."""
    logs = {n: Attribute(versions, key, effective_from, effective_to, recorded_at, priority, v) for n, v in attributes.items()}
    return match(events, logs, key=key, event_time=event_time, row_id=row_id, bucket_days=bucket_days, rows_per_task=rows_per_task)
