"""Column helpers shared by the queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.params import QueryParams


def both(*conditions: Column | None) -> Column:
    """All conditions that are given; none at all is true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def local_date(ts: str, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd")


def local_hour(ts: str, tz: str) -> Column:
    return F.hour(F.from_utc_timestamp(ts, tz)).cast("int")


def millis(ts: str | Column) -> Column:
    return F.unix_millis(F.col(ts) if isinstance(ts, str) else ts)


def or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def or_unknown(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))


def provider() -> Column:
    return F.coalesce("provider_code", "protocol_type", F.lit(""))


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive literal search; % and _ mean themselves."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.lit(text)))


def in_window(p: QueryParams, ts: str = "event_time") -> Column:
    since, until = p.window()
    return (F.col(ts) >= F.lit(since)) & (F.col(ts) < F.lit(until))


def on_days(p: QueryParams, day: str = "usage_date") -> Column:
    """A predicate on the partition column that is implied by the window: prunes, never filters."""
    days = p.prune_days()
    return F.lit(True) if days is None else F.col(day).between(F.lit(days[0]), F.lit(days[1]))


def identity(p: QueryParams) -> Column:
    """Whose rows: everyone's locally, else a seat's, else the personal ones, else an account's, in this order.

    Personal rows are told by their organisation alone: they often carry no account.
    """
    if p.local_all:
        return F.lit(True)
    if p.seat_id:
        return F.col("seat_id") == p.seat_id
    if p.org_id == "personal":
        return F.col("org_id") == "personal"
    return F.col("account_id") == p.account_id


def raw_identity(p: QueryParams) -> Column:
    """What :func:`identity` or the organisation of ``p`` implies for the raw event of a fact.

    A fact copies organisation and account of its event, absent ones as ''; its seat may have been filled in from a
    control event where the event named none, so events without a seat pass.
    """
    if p.local_all:
        return F.lit(True)
    if p.seat_id:
        return or_empty("seat_id").isin(p.seat_id, "")
    if p.org_id:
        return F.col("org_id") == p.org_id
    return or_empty("account_id") == p.account_id


def amount(total: Column) -> Column:
    """A decimal total with eight places as double, divided once from a whole number."""
    return F.coalesce(as_double(total), F.lit(0.0))


def as_double(value: Column) -> Column:
    """An amount as double; NULL stays."""
    return (value * 100_000_000).cast("bigint").cast("double") / 1e8


def tokens() -> Column:
    return F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("tokens")


def requests() -> Column:
    return F.coalesce(F.sum("client_request_count"), F.lit(0)).cast("bigint").alias("requests")


def cost() -> Column:
    usd = F.when(F.col("currency") == "USD", F.col("billable_amount")).otherwise(F.lit(0).cast("decimal(20,8)"))
    return amount(F.sum(usd)).alias("cost_usd")


def trio() -> list[Column]:
    """Tokens, requests, cost, and the requests with and without a price."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("client_request_count")).otherwise(0)), F.lit(0)).cast("bigint")
    unpriced = F.col("billable_amount").isNull()
    return [tokens(), requests(), cost(), part(~unpriced).alias("priced"), part(unpriced).alias("unpriced")]


def segments() -> list[Column]:
    """The four kinds of tokens."""
    names = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_creation_input_tokens")
    return [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names]
