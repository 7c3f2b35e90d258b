"""Personal and organisation-wide usage queries over the reporting view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.params import QueryParams, clamp


def reporting_view(fact: DataFrame, scope: Column | None = None) -> DataFrame:
    """Facts with ``client_request_count``: of the attempts of one client request exactly one counts.

    Attempts share org, account, seat (NULL as '') and a non-empty request id; the successful,
    then latest, then largest ``dwd_id`` counts 1, the others 0; rows without a request id count
    their ``request_count``.  ``scope`` may restrict org, account or seat, never time: attempts on
    other days decide, too.  Rows without a request id are spread by their own id, so they form
    no hot group.
    """
    rows = fact if scope is None else fact.filter(scope)
    request = F.nullif(F.col("request_id"), F.lit(""))
    group = F.coalesce(request, F.concat(F.lit("\x00"), F.col("dwd_id").cast("string")))
    order = Window.partitionBy(C.or_empty("org_id"), C.or_empty("account_id"), C.or_empty("seat_id"), group).orderBy(
        F.coalesce(F.col("request_status") == "success", F.lit(False)).desc(), F.col("event_time").desc(), F.col("dwd_id").desc()
    )
    first = F.when(F.row_number().over(order) == 1, 1).otherwise(0)
    return rows.withColumn("client_request_count", F.when(request.isNull(), F.col("request_count")).otherwise(first))


def stats() -> Column:
    return F.col("user_usage_scope") == "normal"


def audit() -> Column:
    return F.col("user_usage_scope") != "non_generation"


def app(p: QueryParams) -> Column | None:
    return F.col("app_slug") == p.app_slug if p.app_slug else None


def session(p: QueryParams) -> Column | None:
    return C.or_empty("session_id") == p.session_id if p.session_id else None


def personal(fact: DataFrame, p: QueryParams, *more: Column | None, scope: Column | None = None) -> DataFrame:
    """The caller's rows of the view in the window."""
    view = reporting_view(fact, C.identity(p))
    return view.filter(C.both(C.in_window(p), C.on_days(p), stats() if scope is None else scope, *more))


def personal_timeline(fact: DataFrame, p: QueryParams) -> DataFrame:
    by = C.local_date("event_time", p.zone.key).alias("date")
    return personal(fact, p, app(p)).groupBy(by).agg(C.tokens(), C.requests(), C.cost())


def personal_hourly(fact: DataFrame, p: QueryParams, by_provider: bool = False) -> DataFrame:
    keys = [C.local_hour("event_time", p.zone.key).alias("hour")]
    if by_provider:
        keys.append(C.or_empty("provider_code").alias("provider"))
    return personal(fact, p, app(p)).groupBy(*keys).agg(C.tokens(), C.requests(), C.cost())


def by_protocol_timeline(fact: DataFrame, p: QueryParams) -> DataFrame:
    by = [C.local_date("event_time", p.zone.key).alias("date"), C.provider().alias("protocol")]
    return personal(fact, p).groupBy(*by).agg(C.tokens(), C.requests())


def by_protocol_hourly(fact: DataFrame, p: QueryParams) -> DataFrame:
    by = [C.local_hour("event_time", p.zone.key).alias("hour"), C.provider().alias("protocol")]
    return personal(fact, p).groupBy(*by).agg(C.tokens(), C.requests())


def by_protocol_total(fact: DataFrame, p: QueryParams) -> DataFrame:
    return personal(fact, p).groupBy(C.provider().alias("protocol")).agg(*C.trio())


def by_app_total(fact: DataFrame, p: QueryParams) -> DataFrame:
    return personal(fact, p).groupBy(C.or_empty("app_slug").alias("app"), C.provider().alias("provider")).agg(*C.trio())


def by_agent_total(fact: DataFrame, seats: DataFrame, p: QueryParams) -> DataFrame:
    """Per seat of a person and their agents; without a seat there is nothing to show."""
    family = seats.filter((F.col("seat_id") == p.seat_id) | (F.col("parent_seat_id") == p.seat_id)) if p.seat_id else seats.limit(0)
    family = family.select("seat_id", "alias", "seat_type", "parent_seat_id")
    members = [r["seat_id"] for r in family.select("seat_id").take(10_001)]
    # A person's agents are few; beyond that the seats are joined instead of listed.
    listed = F.col("seat_id").isin([p.seat_id, *members]) if len(members) <= 10_000 else None
    rows = reporting_view(fact, listed if p.seat_id else F.lit(False)).filter(C.both(C.in_window(p), C.on_days(p), stats()))
    rows = rows.join(family, "seat_id", "left").filter((F.col("seat_id") == p.seat_id) | (F.col("parent_seat_id") == p.seat_id))
    agent = (F.coalesce("seat_type", F.lit("human")) != "human").alias("is_agent")
    return rows.groupBy("seat_id", C.or_empty("alias").alias("alias"), agent, C.or_empty("parent_seat_id").alias("parent_seat_id")).agg(*C.trio())


def latest_agent_route(ods: DataFrame, seats: DataFrame, p: QueryParams) -> DataFrame:
    """The newest event of each seat of the family, whenever it was; canaries and rows without account are left out."""
    family = seats.filter((F.col("seat_id") == p.seat_id) | (F.col("parent_seat_id") == p.seat_id)).select("seat_id", "org_id")
    rows = ods.join(family, ["seat_id", "org_id"]).filter((F.col("account_id") != "") & (C.or_empty("route_source") != "canary"))
    newest = F.max_by(F.struct("account_id", "oauth_identity", "event_time", "request_status"), F.struct("event_time", "ods_id"))
    return rows.groupBy("seat_id").agg(newest.alias("r")).select(
        "seat_id",
        F.col("r.account_id").alias("last_account"),
        C.or_empty("r.oauth_identity").alias("last_identity"),
        C.millis("r.event_time").alias("last_ms"),
        F.col("r.request_status").alias("last_status"),
    )


def agents_with_routes(fact: DataFrame, ods: DataFrame, seats: DataFrame, p: QueryParams) -> DataFrame:
    """Usage per agent with its latest route.

    An agent whose latest request lies before the window has zero totals and its name; one without any
    request keeps its totals.
    """
    routes = latest_agent_route(ods, seats, p)
    agent = (F.coalesce("seat_type", F.lit("human")) != "human").alias("r_agent")
    names = seats.groupBy("seat_id").agg(F.min(F.struct("alias", "seat_type", "parent_seat_id")).alias("s")).select("seat_id", "s.*")
    names = names.select("seat_id", C.or_empty("alias").alias("r_alias"), agent, C.or_empty("parent_seat_id").alias("r_parent"))
    out = by_agent_total(fact, seats, p).join(routes.join(names, "seat_id", "left"), "seat_id", "full_outer")
    named = {"alias": F.coalesce("alias", "r_alias"), "is_agent": F.coalesce("is_agent", "r_agent"), "parent_seat_id": F.coalesce("parent_seat_id", "r_parent")}
    zeros = {c: F.coalesce(c, F.lit(0).cast(t)) for c, t in out.dtypes if c in ("tokens", "requests", "cost_usd", "priced", "unpriced")}
    return out.withColumns(named | zeros).drop("r_alias", "r_agent", "r_parent")


def _identities(ods: DataFrame) -> DataFrame:
    return ods.groupBy("virtual_key_id").agg(F.max("oauth_identity").alias("identity"))


def by_key_total(fact: DataFrame, ods: DataFrame, p: QueryParams) -> DataFrame:
    """Per identity (keys of one identity are one line) and app."""
    rows = personal(fact, p, session(p)).join(_identities(ods), "virtual_key_id", "left")
    key = F.coalesce(F.nullif("identity", F.lit("")), C.or_empty("virtual_key_id"))
    out = rows.groupBy(key.alias("key"), C.or_empty("app_slug").alias("app")).agg(
        F.min("virtual_key_id").alias("virtual_key_id"), F.max("virtual_key_alias").alias("alias"), F.max("identity").alias("identity"), *C.segments(), *C.trio()
    )
    alias = F.coalesce(F.nullif("alias", F.lit("")), F.replace(F.col("virtual_key_id"), F.lit("personal:"), F.lit("")))
    return out.drop("key").withColumns({"alias": alias, "identity": C.or_empty("identity")})


def by_model_total(fact: DataFrame, p: QueryParams, top: int = 20) -> DataFrame:
    out = personal(fact, p, app(p), session(p)).groupBy(C.or_unknown("model").alias("model")).agg(*C.segments(), *C.trio())
    return out.orderBy(F.desc("tokens"), "model").limit(top)


def by_session_total(fact: DataFrame, ods: DataFrame, p: QueryParams, top: int = 10) -> DataFrame:
    rows = personal(fact, p).join(_identities(ods), "virtual_key_id", "left")
    samples = [F.min("virtual_key_id").alias("virtual_key_id"), F.max("virtual_key_alias").alias("alias"), F.max("identity").alias("identity"),
        F.max("app_slug").alias("app")]
    out = rows.groupBy(C.or_empty("session_id").alias("session")).agg(*samples, *C.segments(), C.tokens(), C.requests())
    return out.orderBy(F.desc("tokens"), "session").limit(top)


def personal_recent(ods: DataFrame, p: QueryParams, limit: int = 5) -> DataFrame:
    """The newest events, whenever they were; rows without a route source are left out like canaries."""
    rows = ods.filter(C.identity(p) & (F.col("route_source") != "canary"))
    return rows.orderBy(F.desc("event_time"), F.desc("ods_id")).limit(clamp(limit, 5, 50)).select("ods_id", "event_id", "model", "request_status", "total_tokens",
        C.millis("event_time").alias("event_ms"))


_DETAIL = {"model": "model", "key": "virtual_key_id", "session": "session_id", "app": "app_slug", "protocol": "protocol_type", "identity": "oauth_identity"}


def personal_detail(fact: DataFrame, ods: DataFrame, p: QueryParams, limit: int = 500) -> DataFrame:
    """Single facts, newest first; error and timing are joined from the raw events after the limit.  Unknown filters are an error."""
    unknown = set(p.filters) - set(_DETAIL) - {"unpriced"}
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    more = [F.col(_DETAIL[k]) == v for k, v in p.filters.items() if k in _DETAIL]
    if p.filters.get("unpriced"):
        more.append(F.col("billable_amount").isNull())
    rows = fact.filter(C.both(C.identity(p), C.in_window(p), C.on_days(p), audit(), F.col("route_source") != "canary", *more))
    page = rows.select("dwd_id", "ods_id", "event_id", "event_time", "model", "total_tokens").orderBy(F.desc("event_time"), F.desc("dwd_id")).limit(clamp(limit, 500,
        1000))
    raw = ods.select("ods_id", "error_code", (C.millis("finished_at") - C.millis("started_at")).alias("latency_ms"))
    joined = page.join(raw, "ods_id", "left").withColumn("event_ms", C.millis("event_time"))
    return joined.orderBy(F.desc("event_time"), F.desc("dwd_id")).drop("event_time")


def master_rows(fact: DataFrame, p: QueryParams, *more: Column) -> DataFrame:
    return reporting_view(fact, F.col("org_id") == p.org_id).filter(C.both(C.in_window(p), C.on_days(p), *more))


def billed() -> Column:
    return F.col("billing_scope").isin("org_only", "org_and_user")


def master_ranking(fact: DataFrame, p: QueryParams) -> DataFrame:
    out = master_rows(fact, p, stats()).groupBy("account_id", "seat_id").agg(*C.trio()).drop("priced")
    return out.orderBy(F.desc("tokens"), "account_id", "seat_id").limit(clamp(p.limit, 50, 1000))


def master_by_protocol(fact: DataFrame, p: QueryParams) -> DataFrame:
    return master_rows(fact, p, billed(), audit()).groupBy(C.provider().alias("protocol")).agg(*C.trio())


def master_timeline(fact: DataFrame, p: QueryParams) -> DataFrame:
    by = C.local_date("event_time", p.zone.key).alias("date")
    return master_rows(fact, p, billed(), audit()).groupBy(by).agg(C.tokens(), C.requests(), C.cost())


def step_arounds(fact: DataFrame, p: QueryParams) -> DataFrame:
    """How often later attempts had to step around a provider; a NULL attempt is no second one."""
    rows = fact.filter(C.both(F.col("org_id") == p.org_id, C.in_window(p), C.on_days(p), F.col("fallback_attempt") > 1))
    by = [C.or_empty("provider_code").alias("provider"), C.or_empty("fallback_reason").alias("reason")]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), C.millis(F.max("event_time")).alias("last_ms"))


def upstream_latency(ods: DataFrame, p: QueryParams, share: int = 95) -> DataFrame:
    """The latency at 0-based rank min(n * 95 / 100, n - 1); 0 without samples.  Always one row.

    Exact in two aggregations: first the block of 1,024 ms that holds the rank, then the value
    in it, so no task sorts more than the blocks or one block's values.
    """
    latency = C.millis("finished_at") - C.millis("started_at")
    rows = ods.filter(C.both(F.col("org_id") == p.org_id, C.in_window(p))).select(latency.alias("ms")).filter("ms > 0")
    counts = rows.groupBy("ms").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("ms") / 1024))
    everything = Window.partitionBy(F.lit(0))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.withColumns({"upto": F.sum("n").over(everything.orderBy("block")), "samples": F.sum("n").over(everything)})
    rank = F.least(F.floor(F.col("samples") * share / 100), F.col("samples") - 1)
    at = blocks.withColumn("rank", rank).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    at = at.select("block", "samples", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("place"))
    inside = counts.join(at, "block").withColumn("upto", F.sum("n").over(everything.orderBy("ms")))
    found = inside.filter(F.col("upto") > F.col("place")).agg(F.min("ms").alias("p95"), F.max("samples").alias("samples"))
    return found.select(F.coalesce("p95", F.lit(0)).cast("bigint").alias("p95_ms"), F.coalesce("samples", F.lit(0)).cast("bigint").alias("samples"),
        F.lit(7).alias("window_days"))


UNPRICED_STATUS = ("pending", "acknowledged", "fixed")


def unpriced_list(state: DataFrame, status: str = "all") -> DataFrame:
    """The stored list (model, provider, first_ms, last_ms, n, status), most frequent first; '' and ``all`` list every status."""
    if status not in ("", "all", *UNPRICED_STATUS):
        raise ValueError(f"status must be one of all, {', '.join(UNPRICED_STATUS)}, not {status!r}")
    rows = state if status in ("", "all") else state.filter(F.col("status") == status)
    return rows.orderBy(F.desc("n"), F.desc("last_ms"), "model", "provider")


def set_unpriced_status(state: DataFrame, model: str, provider: str, status: str) -> DataFrame:
    """The list with one model's status changed; a model that is not listed and an unknown status are errors."""
    if status not in UNPRICED_STATUS:
        raise ValueError(f"status must be one of {', '.join(UNPRICED_STATUS)}, not {status!r}")
    hit = (F.col("model") == model) & (F.col("provider") == provider)
    if state.filter(hit).isEmpty():
        raise LookupError(f"{model!r} of {provider!r} is not listed")
    return state.withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def unpriced_models(fact: DataFrame) -> DataFrame:
    """Models whose facts have no price: first and last seen, and how often."""
    rows = fact.filter(F.col("billable_amount").isNull() & (C.or_empty("model") != ""))
    return rows.groupBy("model", C.or_empty("provider_code").alias("provider")).agg(
        C.millis(F.min("event_time")).alias("first_ms"), C.millis(F.max("event_time")).alias("last_ms"), F.count(F.lit(1)).alias("n")
    )


def merge_unpriced(state: DataFrame, news: DataFrame) -> DataFrame:
    """Add a batch's counts to the stored ones; a stored status stays, new models are pending."""
    s = state.select("model", "provider", *(F.col(c).alias(f"s_{c}") for c in ("first_ms", "last_ms", "n", "status")))
    joined = s.join(news, ["model", "provider"], "full_outer")
    return joined.select(
        "model", "provider", F.least("first_ms", "s_first_ms").alias("first_ms"), F.greatest("last_ms", "s_last_ms").alias("last_ms"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("s_n", F.lit(0))).alias("n"), F.coalesce("s_status", F.lit("pending")).alias("status"),
    )


def quota_usage(fact: DataFrame) -> DataFrame:
    """Tokens and amount of each seat per day, ISO week and month, of any scope and currency."""
    day = F.col("usage_date")
    week = F.format_string("weekly:%04d-W%02d", F.year(F.date_add(F.date_trunc("week", day).cast("date"), 3)), F.weekofyear(day))
    periods = F.array(F.concat(F.lit("daily:"), day.cast("string")), week, F.concat(F.lit("monthly:"), F.date_format(day, "yyyy-MM")))
    kinds = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_creation_input_tokens", "reasoning_tokens")
    spent = sum((F.coalesce(c, F.lit(0)) for c in kinds), F.lit(0))
    daily = fact.filter(C.or_empty("seat_id") != "").groupBy("seat_id", "usage_date").agg(F.sum(spent).alias("tokens"), F.sum("billable_amount").alias("amount"))
    per = daily.select("seat_id", F.explode(periods).alias("period"), "tokens", "amount").groupBy("seat_id", "period")
    return per.agg(F.sum("tokens").cast("bigint").alias("tokens"), C.amount(F.sum("amount")).alias("amount"))
