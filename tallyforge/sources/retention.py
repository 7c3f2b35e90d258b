"""Tables written by day, and the deletion of their old months."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession


def write_by_day(df: DataFrame, path: str, day: str, mode: str = "append") -> None:
    """One folder a day, so that predicates on the day skip files; rows are gathered by day first, a large day by several tasks."""
    df.repartitionByRange(day, *(c for c in df.columns[:1] if c != day)).write.mode(mode).partitionBy(day).parquet(path)


def cutoff(today: dt.date, keep_months: int) -> dt.date:
    """The first day that is kept: the current month and ``keep_months`` before it."""
    months = today.year * 12 + today.month - 1 - keep_months
    return dt.date(months // 12, months % 12 + 1, 1)


def drop_months(spark: SparkSession, path: str, day: str, today: dt.date, keep_months: int = 12) -> list[str]:
    """Delete whole months of days before the cut-off; the names of the deleted folders.

    A folder whose name is no day, as that of NULL days, is left alone; fewer than one month to keep is an error.
    """
    if keep_months < 1:
        raise ValueError("at least one month must be kept")
    first, gone = cutoff(today, keep_months), []
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.listStatus(root) if fs.exists(root) else []:
        name = found.getPath().getName()
        try:
            at = dt.date.fromisoformat(name.removeprefix(f"{day}="))
        except ValueError:
            continue
        if name.startswith(f"{day}=") and at < first:
            fs.delete(found.getPath(), True)
            gone.append(name)
    return sorted(gone)
