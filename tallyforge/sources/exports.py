"""Sinks: CSV of the audit list, Markdown files of conversations and their ZIP archive."""

from __future__ import annotations

import io
import zipfile
from typing import BinaryIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_TIMES = {"occurred_ms": "occurred_at"}


def csv_cell(name: str, kind: str) -> Column:
    """A cell as text: NULL is blank, milliseconds become RFC 3339 seconds in UTC, 0 of them blank."""
    c = F.col(name)
    if name.endswith("_ms") and name != "latency_ms":
        text = F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return F.when(F.coalesce(c, F.lit(0)) == 0, "").otherwise(text).alias(_TIMES.get(name, name.removesuffix("_ms") + "_time"))
    return F.coalesce(c.cast("string"), F.lit("")).alias(name)


def csv_rows(df: DataFrame) -> DataFrame:
    return df.select(*(csv_cell(n, k) for n, k in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    """Distributed: one file a partition, each with the header."""
    csv_rows(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_markdown(sessions: DataFrame, path: str) -> None:
    """(file_name, body) rows as text, a folder per file."""
    sessions.select("file_name", F.col("body").alias("value")).write.mode("overwrite").partitionBy("file_name").text(path)


def zip_sessions(sessions: DataFrame, target: str | BinaryIO | None = None) -> bytes | None:
    """One seat's sessions as a ZIP archive, oldest name first, read one partition at a time; equal names get a number.

    Written to ``target`` as it comes; without one, the archive is returned, which suits small seats.
    """
    out = io.BytesIO() if target is None else target
    seen: dict[str, int] = {}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for row in sessions.orderBy("file_name").toLocalIterator():
            n = seen[row["file_name"]] = seen.get(row["file_name"], 0) + 1
            name = row["file_name"] if n == 1 else f"{row['file_name'].removesuffix('.md')}-{n}.md"
            archive.writestr(name, row["body"])
    return out.getvalue() if target is None else None


def write_threads(turns: DataFrame, path: str) -> None:
    """(file_name, created_at, event_id, text) turns as text, a folder per session and its turns in order, whatever their number.

    Sorted by ranges: a long session is written by many tasks, its files follow each other by name.
    """
    order = ["file_name", "created_at", "event_id"]
    turns.repartitionByRange(*order).sortWithinPartitions(*order).select("file_name",
        F.col("text").alias("value")).write.mode("overwrite").partitionBy("file_name").text(path)
