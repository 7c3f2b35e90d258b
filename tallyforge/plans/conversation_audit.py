"""Conversation audit: seats, sessions, threads, and their export as Markdown."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.params import clamp


MAX_SEAT_KEYS = 1000


def seat_key() -> Column:
    return F.coalesce(F.nullif("seat_id", F.lit("")), F.col("owner_account_id"))


def session_key() -> Column:
    """Only a NULL session stands alone under its event id; '' is a session."""
    return F.coalesce("session_id", "event_id")


def _rows(records: DataFrame, org_id: str, first: dt.date | None, last: dt.date | None) -> DataFrame:
    since = F.col("conv_date") >= F.lit(first) if first else None
    until = F.col("conv_date") <= F.lit(last) if last else None
    return records.filter(C.both(F.col("org_id") == org_id, since, until))


def seat_summaries(
    records: DataFrame, org_id: str, first: dt.date | None = None, last: dt.date | None = None,
    search: str = "", exact: list[str] | None = None, sort: str = "tokens", limit: int = 20, offset: int = 0,
) -> DataFrame:
    """Seats with sessions, turns, bytes and tokens.

    A search, even one that found no seats, restricts the list; more than 1000 exact keys are an error, never cut.
    """
    if exact is not None and len(exact) > MAX_SEAT_KEYS:
        raise ValueError(f"at most {MAX_SEAT_KEYS} seat keys, not {len(exact)}: narrow the search")
    rows = _rows(records, org_id, first, last).withColumn("seat", seat_key())
    if exact is not None or search:
        hit = F.col("seat").isin(exact) if exact else F.lit(False)
        rows = rows.filter(hit | (C.contains_text(F.col("seat"), search) if search else F.lit(False)))
    # Sessions are counted per (seat, session) first: partial sums, then one distinct key a row.
    per = rows.groupBy("seat", session_key().alias("session")).agg(
        F.count(F.lit(1)).alias("turns"), F.sum("content_bytes").alias("bytes"), F.sum("total_tokens").alias("tokens"), F.max("created_at").alias("last")
    )
    out = per.groupBy("seat").agg(
        F.count("session").alias("sessions"), F.sum("turns").alias("turns"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), C.millis(F.max("last")).alias("last_ms"),
    )
    by = {"sessions": "sessions", "turns": "turns", "tokens": "tokens", "activity": "last_ms"}.get(sort, "tokens")
    return out.orderBy(F.desc(by), F.desc("last_ms"), F.asc_nulls_last("seat")).offset(max(0, offset)).limit(clamp(limit, 20, 1000))


def seat_total(records: DataFrame, org_id: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Number of seats for paging; a NULL seat is listed but not counted."""
    return _rows(records, org_id, first, last).agg(F.count_distinct(seat_key()).alias("n"))


def session_total(records: DataFrame, org_id: str, seat: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Number of a seat's sessions for paging."""
    return _rows(records, org_id, first, last).filter(seat_key() == seat).agg(F.count_distinct(session_key()).alias("n"))


def session_prompt(prompts: DataFrame, org_id: str, owner: str, session: str | None) -> DataFrame:
    """One row: the stored prompt of a session as its own seat or account sees it, '' where there is none."""
    hit = (F.col("org_id") == org_id) & (F.col("owner_account_id") == owner) & (F.col("session_id") == (session or ""))
    return prompts.filter(hit).agg(F.coalesce(F.min("system_text"), F.lit("")).alias("system_text"))


def session_summaries(
    records: DataFrame, org_id: str, seat: str, first: dt.date | None = None, last: dt.date | None = None, sort: str = "activity", limit: int = 20, offset: int = 0
) -> DataFrame:
    rows = _rows(records, org_id, first, last).filter(seat_key() == seat)
    out = rows.groupBy(session_key().alias("session")).agg(
        C.millis(F.min("created_at")).alias("first_ms"), C.millis(F.max("created_at")).alias("last_ms"), F.count(F.lit(1)).alias("turns"),
            F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens")
    )
    by = {"created": "first_ms", "turns": "turns", "tokens": "tokens", "activity": "last_ms"}.get(sort, "last_ms")
    return out.orderBy(F.desc(by), F.desc("first_ms"), "session").offset(max(0, offset)).limit(clamp(limit, 20, 1000))


def thread(records: DataFrame, org_id: str, seat: str, session: str, limit: int | None = 1000) -> DataFrame:
    """The turns of a session in order; no limit for an export."""
    rows = records.filter((F.col("org_id") == org_id) & (seat_key() == seat) & (session_key() == session))
    rows = rows.orderBy("created_at", "event_id")
    rows = rows if limit is None else rows.limit(clamp(limit, 1000, 1000))
    return rows.select("event_id", C.millis("created_at").alias("created_ms"), "user_text", "assistant_text", "model", "total_tokens")


def session_ids(records: DataFrame, org_id: str, seat: str) -> DataFrame:
    rows = records.filter((F.col("org_id") == org_id) & (seat_key() == seat))
    return rows.groupBy(session_key().alias("session")).agg(C.millis(F.min("created_at")).alias("first_ms")).orderBy("first_ms", "session")


def session_prompts(messages: DataFrame) -> DataFrame:
    """The first system text of each (org, session); a later one does not replace it.  NULL sessions count as ''."""
    rows = messages.filter(C.or_empty("system_text") != "")
    first = F.min_by(F.struct("owner_account_id", "system_text"), F.struct("created_at", "event_id", "system_text"))
    return rows.groupBy("org_id", C.or_empty("session_id").alias("session_id")).agg(first.alias("f")).select("org_id", "session_id", "f.*")


def _turns(records: DataFrame, org_id: str, seat: str) -> DataFrame:
    rows = records.filter((F.col("org_id") == org_id) & (seat_key() == seat))
    time = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss 'UTC'")
    turn = F.concat(F.lit("## "), time, F.lit("\n\n**User:** "), C.or_empty("user_text"), F.lit("\n\n**Assistant:** "), C.or_empty("assistant_text"), F.lit("\n"))
    return rows.select(session_key().alias("session"), "created_at", "event_id", turn.alias("turn"))


def _file_name() -> Column:
    name = F.coalesce(F.nullif(F.regexp_replace("session", "[^A-Za-z0-9._-]", "_"), F.lit("")), F.lit("unknown"))
    return F.concat(name, F.lit(".md"))


def markdown_turns(records: DataFrame, org_id: str, seat: str) -> DataFrame:
    """(file_name, created_at, event_id, text) of each turn, for ``write_threads``: sessions of any length."""
    return _turns(records, org_id, seat).select(_file_name().alias("file_name"), "created_at", "event_id", F.col("turn").alias("text"))


def markdown_sessions(records: DataFrame, org_id: str, seat: str) -> DataFrame:
    """(file_name, body) of each session of a seat, its turns in one row: for sessions that fit a file to be read by people."""
    each = _turns(records, org_id, seat).select("session", F.struct("created_at", "event_id", "turn").alias("t"))
    turns = F.sort_array(F.collect_list("t"))
    body = each.groupBy("session").agg(F.array_join(F.transform(turns, lambda t: t["turn"]), "\n").alias("turns"))
    return body.select(_file_name().alias("file_name"), F.concat(F.lit("# Session "), "session", F.lit("\n\n"), "turns").alias("body"))
