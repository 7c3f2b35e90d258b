"""The audit list: filters, search, sorting, pages, facets and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.params import QueryParams, clamp
from tallyforge.plans.usage import audit

FILTERS = {
    "account": "account_id", "seat": "seat_id", "key": "virtual_key_id", "provider": "provider_code", "model": "model",
    "status": "request_status", "scope": "user_usage_scope", "app": "app_slug", "quality": "quality_status",
}
FACETS = ("provider", "model", "status", "app", "quality")
SEARCHED = ("event_id", "model", "virtual_key_alias", "oauth_identity", "alias", "invited_email")


def _sorts() -> dict[str, Column]:
    return {
        "time": F.col("event_time"),
        "seat": F.coalesce("alias", "invited_email", "seat_id"),
        "identity": C.or_empty("oauth_identity"),
        "provider": C.or_empty("provider_code"),
        "model": C.or_empty("model"),
        "tokens": F.col("total_tokens"),
        "cost": F.coalesce("billable_amount", F.lit(-1)),
        "quality": C.or_empty("quality_status"),
        "failover": F.coalesce("fallback_attempt", F.lit(0)),
    }


def audit_rows(fact: DataFrame, seats: DataFrame, p: QueryParams, priced: str = "", keyword: str = "", without: str = "") -> DataFrame:
    """The organisation's facts of the UTC days, with seat names, filtered; ``without`` skips one filter."""
    first, last = p.days()
    if priced not in ("", "priced", "unpriced"):
        raise ValueError(f"priced must be priced or unpriced, not {priced!r}")
    unknown = set(p.filters) - set(FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    names = seats.groupBy("seat_id").agg(F.min(F.struct("alias", "invited_email")).alias("s")).select("seat_id", "s.alias", "s.invited_email")
    conditions = [F.col("org_id") == p.org_id, F.col("usage_date").between(F.lit(first), F.lit(last)), audit()]
    conditions += [F.col(FILTERS[k]) == v for k, v in p.filters.items() if v and k != without]
    if priced:
        conditions.append(F.col("billable_amount").isNotNull() if priced == "priced" else F.col("billable_amount").isNull())
    rows = fact.filter(C.both(*conditions)).join(names, "seat_id", "left")
    if keyword:
        found = F.lit(False)
        for c in SEARCHED:
            found = found | C.contains_text(F.col(c), keyword)
        rows = rows.filter(found)
    return rows


def audit_detail(rows: DataFrame, sort: str = "time", ascending: bool = False, limit: int = 1000, offset: int = 0) -> DataFrame:
    """One page; unknown sorts fall back to time, ties go by time, event id and row id, newest first."""
    by = _sorts().get(sort, F.col("event_time"))
    order = [by.asc() if ascending else by.desc(), F.col("event_time").desc(), F.col("event_id").desc(), F.col("dwd_id").desc()]
    return export_columns(rows.orderBy(*order).offset(max(0, offset)).limit(clamp(limit, 1000, 5000)))


# The columns of the audit row in their order; importers address them by place.
AUDIT_ROW = (
    "event_id event_ms occurred_ms usage_date billing_period account_id seat_id seat_alias provider_code model protocol_type route_source "
    "virtual_key_id virtual_key_hash credential_id oauth_identity credential_fingerprint real_key_hash binding_id "
    "input_tokens output_tokens cached_input_tokens cache_creation_input_tokens reasoning_tokens total_tokens "
    "billable_amount currency pricing_snapshot_id quality_status validation_code anomaly_type completion_source content_hash source_id source_seq "
    "fallback_attempt fallback_reason"
).split()
_NULLABLE = ("billable_amount", "source_seq", "fallback_attempt")  # NULL is a third state there
_COUNTED = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_creation_input_tokens", "reasoning_tokens", "total_tokens")


def export_columns(rows: DataFrame) -> DataFrame:
    """The 37 columns of the audit row; absent texts are '', a column the table lacks is blank."""
    of = {"event_ms": C.millis("event_time"), "usage_date": F.date_format("usage_date", "yyyy-MM-dd")}
    of["occurred_ms"] = C.millis("occurred_at") if "occurred_at" in rows.columns else F.lit(None).cast("bigint")
    of["seat_alias"] = C.or_empty("alias")

    def column(name: str) -> Column:
        if name in of:
            return of[name]
        if name not in rows.columns:
            return F.lit(None).cast("bigint") if name in _NULLABLE else F.lit(0).cast("bigint") if name in _COUNTED else F.lit("")
        return F.col(name) if name in _NULLABLE else F.coalesce(name, F.lit(0)) if name in _COUNTED else C.or_empty(name)

    return rows.select(*(column(n).alias(n) for n in AUDIT_ROW))


def audit_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"))


def audit_facets(fact: DataFrame, seats: DataFrame, p: QueryParams, most: int = 200) -> DataFrame:
    """Per dimension the values left under all other filters, sorted, at most 200.

    Without filters the dimensions share one scan: values are made rows and made distinct
    together.  A filtered dimension needs rows of its own.
    """
    filtered = [d for d in FACETS if p.filters.get(d)]
    free = [d for d in FACETS if d not in filtered]
    pairs = lambda rows, dims: rows.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"),
        F.col(FILTERS[d]).alias("value")) for d in dims))).alias("x")).select("x.*")
    out = [pairs(audit_rows(fact, seats, p), free)] if free else []
    out += [pairs(audit_rows(fact, seats, p, without=d), [d]) for d in filtered]
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    whole = whole.filter(F.col("value") != "").distinct()
    order = Window.partitionBy("dimension").orderBy("value")
    return whole.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def audit_export(rows: DataFrame) -> DataFrame:
    """The whole list, newest first: sorted by ranges, so that it is written in order by many tasks (:func:`write_csv`)."""
    return export_columns(rows.orderBy(F.desc("event_time"), F.desc("dwd_id")))


def event_audit(fact: DataFrame, event_id: str, org_id: str | None = None) -> DataFrame:
    """Every fact of one event: the amounts as they were set, with its prices as JSON where they are valid.

    Event ids are unique within an organisation only: without one, all facts of the id are listed.
    """
    rows = fact.filter(F.col("event_id") == event_id)
    rows = rows if org_id is None else rows.filter(F.col("org_id") == org_id)
    texts = ("model", "provider_code", "currency", "billing_period", "region", "endpoint_url", "credential_id", "pricing_snapshot_id")
    prices = F.lit(None).cast("string")
    if "unit_prices_snapshot" in fact.columns:
        given = F.nullif("unit_prices_snapshot", F.lit(""))
        prices = F.when(F.try_parse_json(given).isNotNull(), given)
    return rows.select(
        "dwd_id", "org_id", "event_id", *((C.or_empty(t) if t in fact.columns else F.lit("")).alias(t) for t in texts),
        C.as_double(F.col("billable_amount")).alias("billable_amount"), prices.alias("unit_prices"),
    )
