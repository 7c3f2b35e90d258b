"""Every dashboard, audit, delivery and conversation query with its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.operators import conversation_ingest, health, ingest, integrity, projector, sequences
from tallyforge.params import QueryParams
from tallyforge.plans import audit, conversation_audit, usage
from tallyforge.runtime import checkpoint, table
from tallyforge.sources.exports import csv_rows
from tallyforge.sources.tables import facts, raw_events

NOW = dt.datetime(2025, 5, 20, tzinfo=dt.UTC)
SEAT, ORG, ACCOUNT, APP, SESSION = "seat-pool-0001", "org-brindle", "acc-pool-0001", "code-buddy", "s-a3310c0405"
ME = QueryParams(now=NOW, seat_id=SEAT, tz="Asia/Shanghai", start=dt.date(2025, 2, 10), end=dt.date(2025, 3, 21))
BOSS = QueryParams(now=NOW, org_id=ORG, tz="Europe/Berlin", start=dt.date(2025, 3, 1), end=dt.date(2025, 4, 15))

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_FACT = """
fact AS (
  SELECT d.*, o.request_id, coalesce(o.request_count, 1) AS request_count, o.app_slug, o.http_status_code, o.oauth_identity, o.source_id, o.source_seq,
    CASE WHEN o.raw_event_json->>'$.request_path' LIKE '%/messages%' THEN 'messages' WHEN o.raw_event_json->>'$.request_path' LIKE '%completions%'
        THEN 'completions' END AS protocol_type,
    CASE WHEN d.virtual_key_id LIKE 'personal:%' THEN 'org_only' WHEN d.dwd_id % 6 = 0 THEN 'hold_for_review' ELSE 'org_and_user' END AS billing_scope,
    CASE d.dwd_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'canary' ELSE 'proxy' END AS route_source,
    CASE WHEN d.fallback_attempt = 2 THEN 'UPSTREAM_5XX' WHEN d.fallback_attempt > 2 THEN 'UPSTREAM_TIMEOUT' END AS fallback_reason,
    CASE d.dwd_id % 4 WHEN 0 THEN 'partial' WHEN 1 THEN '' ELSE 'exact' END AS quality_status, o.occurred_at, o.content_hash,
    CASE WHEN d.dwd_id % 5 = 0 THEN 20 ELSE 0 END AS reasoning_tokens, CASE d.dwd_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ''
        ELSE 'cred-' || CAST(d.dwd_id % 7 AS VARCHAR) END AS credential_id,
    CASE WHEN d.dwd_id % 10 = 0 THEN 'stale_key_revision' END AS validation_code, CASE d.dwd_id % 6 WHEN 1 THEN 'pending_review' WHEN 2 THEN '' END AS anomaly_type,
    CASE d.dwd_id % 4 WHEN 0 THEN 'control_event' ELSE 'exact' END AS completion_source
  FROM usage_fact_dwd d LEFT JOIN usage_event_ods o ON o.ods_id = d.ods_id),
raw AS (SELECT *, CASE ods_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'canary' ELSE 'proxy' END AS route_source FROM usage_event_ods),
view AS (
  SELECT *, CASE WHEN coalesce(request_id, '') = '' THEN request_count
    WHEN row_number() OVER (PARTITION BY coalesce(org_id, ''), coalesce(account_id, ''), coalesce(seat_id, ''), request_id
      ORDER BY coalesce(request_status = 'success', false) DESC, event_time DESC, dwd_id DESC) = 1 THEN 1 ELSE 0 END AS client_request_count FROM fact),
me AS (SELECT *, event_time AT TIME ZONE 'Asia/Shanghai' AS local FROM view WHERE seat_id = 'seat-pool-0001'
  AND event_time >= TIMESTAMPTZ '2025-02-09 16:00:00+00' AND event_time < TIMESTAMPTZ '2025-03-21 16:00:00+00' AND user_usage_scope = 'normal'),
boss AS (SELECT *, event_time AT TIME ZONE 'Europe/Berlin' AS local FROM view WHERE org_id = 'org-brindle'
  AND event_time >= TIMESTAMPTZ '2025-02-28 23:00:00+00' AND event_time < TIMESTAMPTZ '2025-04-15 22:00:00+00'),
identities AS (SELECT virtual_key_id, max(oauth_identity) AS identity FROM usage_event_ods GROUP BY 1)
"""
_AMOUNT = "CAST(CAST(coalesce(sum(CASE WHEN currency = 'USD' THEN billable_amount ELSE 0 END), 0) * 100000000 AS BIGINT) AS DOUBLE) / 1e8 AS cost_usd"
_TWO = "CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(client_request_count), 0) AS BIGINT) AS requests"
_UNPRICED = "CAST(coalesce(sum(CASE WHEN billable_amount IS NULL THEN client_request_count ELSE 0 END), 0) AS BIGINT) AS unpriced"
_PRICED = f"CAST(coalesce(sum(CASE WHEN billable_amount IS NOT NULL THEN client_request_count ELSE 0 END), 0) AS BIGINT) AS priced, {_UNPRICED}"
_SEGMENTS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cached_input_tokens",
    "cache_creation_input_tokens"))
_PROVIDER = "coalesce(provider_code, protocol_type, '')"
_DAY = "strftime(local, '%Y-%m-%d')"
_MS = "epoch_us({}) // 1000"


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str, facts_needed: bool = True) -> None:
    _Q[name] = query
    _SQL[name] = f"WITH {_FACT} {sql}" if facts_needed else sql


def _usage() -> None:
    _add(
        "reporting_view",
        lambda s, d: usage.reporting_view(facts(s, d)).select("dwd_id", F.col("client_request_count").cast("bigint").alias("client_request_count")),
        "SELECT dwd_id, CAST(client_request_count AS BIGINT) AS client_request_count FROM view",
    )
    _add("personal_timeline", lambda s, d: usage.personal_timeline(facts(s, d, C.raw_identity(ME)), ME),
        f"SELECT {_DAY} AS date, {_TWO}, {_AMOUNT} FROM me GROUP BY 1")
    _add("personal_hourly", lambda s, d: usage.personal_hourly(facts(s, d, C.raw_identity(ME)), ME),
        f"SELECT CAST(hour(local) AS INT) AS hour, {_TWO}, {_AMOUNT} FROM me GROUP BY 1")
    _add(
        "personal_hourly_by_provider",
        lambda s, d: usage.personal_hourly(facts(s, d, C.raw_identity(ME)), ME, by_provider=True),
        f"SELECT CAST(hour(local) AS INT) AS hour, coalesce(provider_code, '') AS provider, {_TWO}, {_AMOUNT} FROM me GROUP BY 1, 2",
    )
    _add("by_protocol_timeline", lambda s, d: usage.by_protocol_timeline(facts(s, d, C.raw_identity(ME)), ME),
        f"SELECT {_DAY} AS date, {_PROVIDER} AS protocol, {_TWO} FROM me GROUP BY 1, 2")
    _add("by_protocol_hourly", lambda s, d: usage.by_protocol_hourly(facts(s, d, C.raw_identity(ME)), ME),
        f"SELECT CAST(hour(local) AS INT) AS hour, {_PROVIDER} AS protocol, {_TWO} FROM me GROUP BY 1, 2")
    _add("by_protocol_total", lambda s, d: usage.by_protocol_total(facts(s, d, C.raw_identity(ME)), ME),
        f"SELECT {_PROVIDER} AS protocol, {_TWO}, {_AMOUNT}, {_PRICED} FROM me GROUP BY 1")
    _add("by_app_total", lambda s, d: usage.by_app_total(facts(s, d, C.raw_identity(ME)), ME),
        f"SELECT coalesce(app_slug, '') AS app, {_PROVIDER} AS provider, {_TWO}, {_AMOUNT}, {_PRICED} FROM me GROUP BY 1, 2")
    family = f"""family AS (SELECT seat_id, org_id, alias, seat_type, parent_seat_id FROM org_seats WHERE seat_id = '{SEAT}' OR parent_seat_id = '{SEAT}'),
        agents AS (SELECT v.seat_id, coalesce(alias, '') AS alias, coalesce(seat_type, 'human') <> 'human' AS is_agent, coalesce(parent_seat_id,
            '') AS parent_seat_id, {_TWO}, {_AMOUNT}, {_PRICED}
          FROM view v LEFT JOIN family f USING (seat_id) WHERE (v.seat_id = '{SEAT}' OR parent_seat_id = '{SEAT}') AND user_usage_scope = 'normal'
          AND event_time >= TIMESTAMPTZ '2025-02-09 16:00:00+00' AND event_time < TIMESTAMPTZ '2025-03-21 16:00:00+00' GROUP BY 1, 2, 3, 4),
        routes AS (SELECT r.seat_id, account_id AS last_account, coalesce(oauth_identity, '') AS last_identity, {_MS.format("event_time")} AS last_ms,
            request_status AS last_status
          FROM raw r JOIN family f ON f.seat_id = r.seat_id AND f.org_id = r.org_id WHERE account_id <> '' AND coalesce(route_source, '') <> 'canary'
          QUALIFY row_number() OVER (PARTITION BY r.seat_id ORDER BY event_time DESC, ods_id DESC) = 1)"""
    seats = lambda s, d: table(s, d, "org_seats")
    _add("by_agent_total", lambda s, d: usage.by_agent_total(facts(s, d), seats(s, d), ME), f", {family} SELECT * FROM agents")
    _add("latest_agent_route", lambda s, d: usage.latest_agent_route(raw_events(s, d), seats(s, d), ME), f", {family} SELECT * FROM routes")
    _add("agents_with_routes", lambda s, d: usage.agents_with_routes(facts(s, d), raw_events(s, d), seats(s, d), ME), f""", {family} SELECT seat_id,
        coalesce(a.alias, f.alias, '') AS alias, coalesce(is_agent, coalesce(seat_type, 'human') <> 'human') AS is_agent,
            coalesce(a.parent_seat_id, f.parent_seat_id, '') AS parent_seat_id, coalesce(tokens, 0) AS tokens, coalesce(requests, 0) AS requests, coalesce(cost_usd,
                0) AS cost_usd,
            coalesce(priced, 0) AS priced, coalesce(unpriced, 0) AS unpriced, last_account, last_identity, last_ms, last_status
          FROM agents a FULL JOIN routes USING (seat_id) LEFT JOIN family f USING (seat_id)""")
    _add(
        "by_key_total",
        lambda s, d: usage.by_key_total(facts(s, d, C.raw_identity(ME)), raw_events(s, d), ME),
        f"""SELECT coalesce(app_slug, '') AS app, min(virtual_key_id) AS virtual_key_id,
            coalesce(nullif(max(virtual_key_alias), ''), replace(min(virtual_key_id), 'personal:', '')) AS alias, coalesce(max(identity), '') AS identity,
                {_SEGMENTS}, {_TWO}, {_AMOUNT}, {_PRICED}
            FROM me LEFT JOIN identities USING (virtual_key_id) GROUP BY coalesce(nullif(identity, ''), coalesce(virtual_key_id, '')), 1""",
    )
    _add(
        "by_model_total",
        lambda s, d: usage.by_model_total(facts(s, d, C.raw_identity(ME)), ME),
        f"SELECT coalesce(nullif(model, ''), 'unknown') AS model, {_SEGMENTS}, {_TWO}, {_AMOUNT}, {_PRICED} FROM me GROUP BY 1 ORDER BY tokens DESC, 1 LIMIT 20",
    )
    _add(
        "by_session_total",
        lambda s, d: usage.by_session_total(facts(s, d, C.raw_identity(ME)), raw_events(s, d), ME),
        f"""SELECT coalesce(session_id, '') AS session, min(virtual_key_id) AS virtual_key_id, max(virtual_key_alias) AS alias, max(identity) AS identity,
            max(app_slug) AS app,
            {_SEGMENTS}, {_TWO} FROM me LEFT JOIN identities USING (virtual_key_id) GROUP BY 1 ORDER BY tokens DESC, 1 LIMIT 10""",
    )
    _add(
        "personal_recent",
        lambda s, d: usage.personal_recent(raw_events(s, d), ME, 20),
        f"""SELECT ods_id, event_id, model, request_status, total_tokens, {_MS.format("event_time")} AS event_ms FROM raw
            WHERE seat_id = '{SEAT}' AND route_source <> 'canary' ORDER BY event_time DESC, ods_id DESC LIMIT 20""",
    )
    _add(
        "personal_detail",
        lambda s, d: usage.personal_detail(facts(s, d, C.raw_identity(ME) & C.in_window(ME)), raw_events(s, d), ME),
        f"""SELECT f.dwd_id, f.ods_id, f.event_id, f.model, f.total_tokens, o.error_code, {_MS.format("o.finished_at")} - {_MS.format("o.started_at")} AS latency_ms,
              {_MS.format("f.event_time")} AS event_ms
            FROM (SELECT * FROM fact WHERE seat_id = '{SEAT}' AND user_usage_scope <> 'non_generation' AND route_source <> 'canary'
              AND event_time >= TIMESTAMPTZ '2025-02-09 16:00:00+00' AND event_time < TIMESTAMPTZ '2025-03-21 16:00:00+00'
              ORDER BY event_time DESC, dwd_id DESC LIMIT 500) f LEFT JOIN usage_event_ods o ON o.ods_id = f.ods_id""",
    )
    _add(
        "master_ranking",
        lambda s, d: usage.master_ranking(facts(s, d, C.raw_identity(BOSS)), BOSS),
        f"SELECT account_id, seat_id, {_TWO}, {_AMOUNT}, {_UNPRICED} FROM boss WHERE user_usage_scope = 'normal' GROUP BY 1, 2 ORDER BY tokens DESC, 1, 2 LIMIT 50",
    )
    billed = "billing_scope IN ('org_only', 'org_and_user') AND user_usage_scope <> 'non_generation'"
    _add("master_by_protocol", lambda s, d: usage.master_by_protocol(facts(s, d, C.raw_identity(BOSS)), BOSS),
        f"SELECT {_PROVIDER} AS protocol, {_TWO}, {_AMOUNT}, {_PRICED} FROM boss WHERE {billed} GROUP BY 1")
    _add("master_timeline", lambda s, d: usage.master_timeline(facts(s, d, C.raw_identity(BOSS)), BOSS),
        f"SELECT {_DAY} AS date, {_TWO}, {_AMOUNT} FROM boss WHERE {billed} GROUP BY 1")
    _add(
        "step_arounds",
        lambda s, d: usage.step_arounds(facts(s, d, C.raw_identity(BOSS) & C.in_window(BOSS)), BOSS),
        f"""SELECT coalesce(provider_code, '') AS provider, coalesce(fallback_reason, '') AS reason, count(*) AS n, {_MS.format("max(event_time)")} AS last_ms
            FROM boss WHERE fallback_attempt > 1 GROUP BY 1, 2""",
    )
    _add(
        "upstream_latency",
        lambda s, d: usage.upstream_latency(raw_events(s, d), BOSS),
        f"""SELECT coalesce(max(CASE WHEN i = least(n * 95 // 100, n - 1) THEN ms END), 0) AS p95_ms, coalesce(max(n), 0) AS samples, 7 AS window_days FROM (
              SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i, count(*) OVER () AS n FROM (
                SELECT {_MS.format("finished_at")} - {_MS.format("started_at")} AS ms FROM raw WHERE org_id = '{ORG}'
                  AND event_time >= TIMESTAMPTZ '2025-02-28 23:00:00+00' AND event_time < TIMESTAMPTZ '2025-04-15 22:00:00+00') WHERE ms > 0)""",
    )
    _add(
        "unpriced_models",
        lambda s, d: usage.unpriced_models(facts(s, d)),
        f"""SELECT model, coalesce(provider_code, '') AS provider, {_MS.format("min(event_time)")} AS first_ms, {_MS.format("max(event_time)")} AS last_ms,
            count(*) AS n
            FROM fact WHERE billable_amount IS NULL AND coalesce(model, '') <> '' GROUP BY 1, 2""",
    )
    for name, p, where in (
        ("by_model_of_personal_rows", QueryParams(now=NOW, org_id="personal", account_id="acc-none", start=ME.start, end=ME.end), "org_id = 'personal'"),
        ("by_model_of_an_account", QueryParams(now=NOW, account_id=ACCOUNT, start=ME.start, end=ME.end), f"account_id = '{ACCOUNT}'"),
        ("by_model_of_everyone", QueryParams(now=NOW, local_all=True, start=ME.start, end=ME.end), "true"),
        ("by_model_of_an_app", QueryParams(now=NOW, local_all=True, start=ME.start, end=ME.end, app_slug=APP), f"app_slug = '{APP}'"),
        ("by_model_of_a_session", QueryParams(now=NOW, local_all=True, start=ME.start, end=ME.end, session_id=SESSION), f"session_id = '{SESSION}'"),
    ):
        _add(
            name,
            lambda s, d, p=p: usage.by_model_total(facts(s, d, C.raw_identity(p)), p),
            f"""SELECT coalesce(nullif(model, ''), 'unknown') AS model, {_SEGMENTS}, {_TWO}, {_AMOUNT}, {_PRICED} FROM view WHERE {where}
                AND user_usage_scope = 'normal'
              AND event_time >= TIMESTAMPTZ '2025-02-10 00:00:00+00' AND event_time < TIMESTAMPTZ '2025-03-22 00:00:00+00' GROUP BY 1 ORDER BY tokens DESC,
                  1 LIMIT 20""",
        )
    drill = QueryParams(now=NOW, seat_id=SEAT, tz="Asia/Shanghai", start=ME.start, end=ME.end, filters={"protocol": "messages", "unpriced": "1"})
    _add(
        "personal_detail_filtered",
        lambda s, d: usage.personal_detail(facts(s, d, C.raw_identity(drill) & C.in_window(drill)), raw_events(s, d), drill, 1000).select("dwd_id", "event_ms"),
        f"""SELECT dwd_id, {_MS.format("event_time")} AS event_ms FROM fact WHERE seat_id = '{SEAT}' AND user_usage_scope <> 'non_generation'
            AND route_source <> 'canary'
          AND protocol_type = 'messages' AND billable_amount IS NULL AND event_time >= TIMESTAMPTZ '2025-02-09 16:00:00+00'
              AND event_time < TIMESTAMPTZ '2025-03-21 16:00:00+00'
          ORDER BY fact.event_time DESC, dwd_id DESC LIMIT 1000""",
    )

    def unpriced_state(s: SparkSession, d: str) -> DataFrame:
        """The list after two batches, the facts up to March and those after."""
        whole = facts(s, d)
        early, late = (usage.unpriced_models(whole.filter(c)) for c in (F.col("usage_date") < "2025-03-01", F.col("usage_date") >= "2025-03-01"))
        status = F.when(F.col("model") < "m", "acknowledged").otherwise("pending")
        return usage.merge_unpriced(early.withColumn("status", status), late)

    _add(
        "unpriced_list",
        lambda s, d: usage.unpriced_list(unpriced_state(s, d), "acknowledged"),
        f"""SELECT model, coalesce(provider_code, '') AS provider, {_MS.format("min(event_time)")} AS first_ms, {_MS.format("max(event_time)")} AS last_ms,
            count(*) AS n, 'acknowledged' AS status
            FROM fact WHERE billable_amount IS NULL AND coalesce(model, '') <> '' AND model < 'm' GROUP BY 1, 2 HAVING min(usage_date) < DATE '2025-03-01'""",
    )
    _add(
        "quota_usage",
        lambda s, d: usage.quota_usage(facts(s, d)),
        """, periods AS (SELECT seat_id, unnest(['daily:' || CAST(usage_date AS VARCHAR), 'weekly:' || strftime(usage_date, '%G-W%V'),
            'monthly:' || strftime(usage_date, '%Y-%m')]) AS period,
              coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cached_input_tokens, 0) + coalesce(cache_creation_input_tokens,
                  0) + reasoning_tokens AS tokens, billable_amount
            FROM fact WHERE coalesce(seat_id, '') <> '')
            SELECT seat_id, period, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(CAST(coalesce(sum(billable_amount),
                0) * 100000000 AS BIGINT) AS DOUBLE) / 1e8 AS amount FROM periods GROUP BY 1, 2""",
    )


def _audit() -> None:
    seats = lambda s, d: table(s, d, "org_seats")
    p = QueryParams(now=NOW, org_id=ORG, start=dt.date(2025, 3, 1), end=dt.date(2025, 4, 15), filters={"status": "success"})
    # Facts copy the time of their events: the UTC days prune the raw side, too.
    days = lambda: (F.col("event_time") >= F.lit(dt.datetime(2025, 3, 1, tzinfo=dt.UTC))) & (F.col("event_time") < F.lit(dt.datetime(2025, 4, 16,
        tzinfo=dt.UTC)))
    listed = lambda s, d: facts(s, d, C.raw_identity(p) & days())
    rows = lambda s, d, **k: audit.audit_rows(listed(s, d), seats(s, d), p, **k)
    base = f""", listed AS (SELECT f.*, n.alias, n.invited_email FROM fact f LEFT JOIN org_seats n USING (seat_id)
        WHERE f.org_id = '{ORG}' AND usage_date BETWEEN DATE '2025-03-01' AND DATE '2025-04-15' AND user_usage_scope <> 'non_generation')"""
    given = {
        "event_ms": _MS.format("event_time"), "occurred_ms": _MS.format("occurred_at"), "usage_date": "strftime(usage_date, '%Y-%m-%d')",
            "seat_alias": "coalesce(alias, '')",
        "billable_amount": "billable_amount", "source_seq": "source_seq", "fallback_attempt": "fallback_attempt",
    }
    given |= {c: f"coalesce({c}, 0)" for c in ("input_tokens", "output_tokens", "cached_input_tokens", "cache_creation_input_tokens", "reasoning_tokens",
        "total_tokens")}
    absent = ("virtual_key_hash", "credential_fingerprint", "real_key_hash", "binding_id", "pricing_snapshot_id")
    given |= dict.fromkeys(absent, "''")
    column = {c: given.get(c, f"coalesce({c}, '')") for c in audit.AUDIT_ROW}
    columns = ", ".join(f"{e} AS {c}" for c, e in column.items())
    done = "request_status = 'success'"
    _add(
        "audit_detail",
        lambda s, d: audit.audit_detail(rows(s, d), sort="cost", limit=200, offset=50),
        f"{base} SELECT {columns} FROM listed WHERE {done} ORDER BY coalesce(billable_amount, -1) DESC, event_time DESC, event_id DESC, dwd_id DESC LIMIT 200 OFFSET 50",
    )
    _add("audit_total", lambda s, d: audit.audit_total(rows(s, d, priced="unpriced")),
        f"{base} SELECT count(*) AS n FROM listed WHERE {done} AND billable_amount IS NULL")
    hit = " OR ".join(f"contains(lower(coalesce({c}, '')), 'or')" for c in audit.SEARCHED)
    _add("audit_keyword", lambda s, d: audit.export_columns(rows(s, d, keyword="OR")), f"{base} SELECT {columns} FROM listed WHERE {done} AND ({hit})")
    facet = " UNION ALL ".join(
        f"(SELECT DISTINCT '{name}' AS dimension, {audit.FILTERS[name]} AS value FROM listed WHERE {audit.FILTERS[name]} <> ''" + (f" AND {done}" if name != "status" else "") + " ORDER BY 2 LIMIT 200)"
        for name in audit.FACETS
    )
    _add("audit_facets", lambda s, d: audit.audit_facets(listed(s, d), seats(s, d), p), f"{base} {facet}")
    time = "coalesce(strftime({} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), '')"
    text = {c: f"coalesce(CAST({e} AS VARCHAR), '')" for c, e in column.items() if not c.endswith("_ms")}
    text |= {"event_time": time.format("event_time"), "occurred_at": time.format("occurred_at")}
    _add(
        "audit_export",
        lambda s, d: csv_rows(audit.audit_export(rows(s, d))),
        f"{base} SELECT {', '.join(f'{e} AS {c}' for c, e in text.items())} FROM (SELECT * FROM listed WHERE {done})",
    )
    event = "(SELECT event_id FROM usage_fact_dwd GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"

    def most_projected(s: SparkSession, d: str) -> str:
        first = table(s, d, "usage_fact_dwd").groupBy("event_id").count().orderBy(F.desc("count"), "event_id").first()
        return first["event_id"] if first else ""

    _add(
        "event_audit",
        lambda s, d: audit.event_audit(facts(s, d), most_projected(s, d)),
        f"""SELECT dwd_id, org_id, event_id, coalesce(model, '') AS model, coalesce(provider_code, '') AS provider_code, coalesce(currency, '') AS currency,
            coalesce(billing_period, '') AS billing_period,
          '' AS region, '' AS endpoint_url, coalesce(credential_id, '') AS credential_id, '' AS pricing_snapshot_id,
          CAST(CAST(billable_amount * 100000000 AS BIGINT) AS DOUBLE) / 1e8 AS billable_amount, CAST(NULL AS VARCHAR) AS unit_prices FROM fact
              WHERE event_id = {event}""",
    )


def _delivery() -> None:
    source, pair = ["source_id"], ["org_id", "source_id"]
    ods = lambda s, d: table(s, d, "usage_event_ods")
    seqs = "seqs AS (SELECT DISTINCT source_id, source_seq AS seq FROM usage_event_ods WHERE source_seq >= 1 AND source_id IS NOT NULL)"
    mark = "SELECT source_id, coalesce(max(seq) FILTER (seq = rn), 0) AS contiguous_seq, max(seq) AS max_seen_seq FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS rn FROM seqs) GROUP BY 1"
    _add("watermark_contiguous", lambda s, d: sequences.contiguous(sequences.received(ods(s, d), source), source), f"WITH {seqs} {mark}", False)
    gaps = """gaps AS (SELECT * FROM (SELECT source_id, lag(seq, 1, 0) OVER (PARTITION BY source_id ORDER BY seq) + 1 AS first_seq, seq - 1 AS last_seq FROM seqs)
        WHERE first_seq <= last_seq)"""
    _add("missing_seqs", lambda s, d: sequences.gaps(sequences.received(ods(s, d), source), source), f"WITH {seqs}, {gaps} SELECT * FROM gaps", False)

    def ledger(s: SparkSession, d: str) -> DataFrame:
        gone = sequences.gaps(sequences.received(ods(s, d), source), source).select(*source, F.col("first_seq").alias("seq"))
        late = sequences.received(ods(s, d), source).filter(F.pmod("seq", F.lit(97)) == 0)
        return gone.unionByName(late)

    book = "book AS (SELECT source_id, first_seq AS seq FROM gaps UNION ALL SELECT source_id, seq FROM seqs WHERE seq % 97 = 0)"
    _add(
        "known_loss_counts",
        lambda s, d: sequences.known_losses(ods(s, d), ledger(s, d), source),
        f"WITH {seqs}, {gaps}, {book} SELECT source_id, count(*) AS lost FROM (SELECT DISTINCT * FROM book EXCEPT SELECT * FROM seqs) GROUP BY 1",
        False,
    )
    _add(
        "watermark_with_losses",
        lambda s, d: sequences.contiguous(sequences.received(ods(s, d), source, ledger=ledger(s, d)), source),
        f"WITH {seqs.replace('seqs AS', 'arrived AS')}, {gaps.replace('seqs', 'arrived')}, {book.replace('seqs', 'arrived')}, seqs AS (SELECT * FROM arrived UNION SELECT * FROM book) {mark}",
        False,
    )
    _add(
        "completeness",
        lambda s, d: sequences.completeness(ods(s, d), pair),
        """WITH seqs AS (SELECT DISTINCT org_id, source_id, source_seq AS seq FROM usage_event_ods WHERE source_seq >= 1 AND source_id IS NOT NULL),
          held AS (SELECT org_id, source_id, count(*) AS quarantined FROM usage_event_ods WHERE ingest_status = 'quarantined' AND source_id IS NOT NULL GROUP BY 1,
              2),
          marks AS (SELECT org_id, source_id, coalesce(max(seq) FILTER (seq = rn), 0) AS contiguous_seq, max(seq) AS max_seen_seq, count(*) AS received
            FROM (SELECT *, row_number() OVER (PARTITION BY org_id, source_id ORDER BY seq) AS rn FROM seqs) GROUP BY 1, 2)
          SELECT m.*, greatest(max_seen_seq - received, 0) AS missing, coalesce(quarantined, 0) AS quarantined FROM marks m LEFT JOIN held USING (org_id,
              source_id)""",
        False,
    )
    def marks(s: SparkSession, d: str) -> DataFrame:
        # What clients handed out is in no table: up to two more than were seen.
        most = F.max("source_seq")
        return integrity.watermarks_of(ods(s, d), pair, allocated=(most + F.pmod(most, F.lit(3))).cast("long"))

    def book(s: SparkSession, d: str) -> DataFrame:
        gone = sequences.gaps(sequences.received(ods(s, d), pair), pair).filter("first_seq % 2 = 0")
        return gone.select(*pair, F.col("first_seq").alias("seq"), F.lit("stale_gap").alias("reason"))

    accounted = lambda s, d: sequences.received(ods(s, d), pair, ledger=book(s, d))
    at = dt.datetime(2025, 5, 2, tzinfo=dt.UTC)
    states = """WITH seqs AS (SELECT DISTINCT org_id, source_id, source_seq AS seq FROM usage_event_ods WHERE source_seq >= 1 AND source_id IS NOT NULL),
        gaps AS (SELECT * FROM (SELECT org_id, source_id, lag(seq, 1, 0) OVER (PARTITION BY org_id, source_id ORDER BY seq) + 1 AS first_seq, seq - 1 AS last_seq
            FROM seqs) WHERE first_seq <= last_seq),
        book AS (SELECT org_id, source_id, first_seq AS seq FROM gaps WHERE first_seq % 2 = 0),
        known AS (SELECT * FROM seqs UNION SELECT * FROM book),
        times AS (SELECT org_id, source_id, max(event_time) AS last_event_at, max(ingest_received_at) AS updated_at,
            max(source_seq) + max(source_seq) % 3 AS client_allocated_seq
          FROM usage_event_ods WHERE source_id IS NOT NULL GROUP BY 1, 2),
        marks AS (SELECT org_id, source_id, coalesce(max(seq) FILTER (seq = rn), 0) AS contiguous_seq, max(seq) AS max_seen_seq FROM
          (SELECT *, row_number() OVER (PARTITION BY org_id, source_id ORDER BY seq) AS rn FROM seqs) GROUP BY 1, 2),
        aged AS (SELECT *, 1746144000000 - epoch_us(updated_at) // 1000 AS stale, 1746144000000 - epoch_us(last_event_at) // 1000 AS quiet FROM marks
            JOIN times USING (org_id, source_id)),
        states AS (SELECT *, CASE WHEN contiguous_seq < max_seen_seq AND stale > 600000 THEN 'middle_gap' WHEN contiguous_seq < client_allocated_seq
            AND stale > 600000 THEN 'tail_gap'
          WHEN quiet > 86400000 THEN 'silent' ELSE 'ok' END AS status, client_allocated_seq - max_seen_seq AS tail_pending,
          contiguous_seq < greatest(max_seen_seq, client_allocated_seq) AND stale > 86400000 AS promotable FROM aged),
        missing AS (SELECT org_id, source_id, unnest(range(contiguous_seq + 1, greatest(max_seen_seq, client_allocated_seq) + 1)) AS seq FROM states),
        absent AS (SELECT * FROM missing EXCEPT SELECT * FROM known)"""
    _add(
        "source_states",
        lambda s, d: integrity.source_completeness(ods(s, d), book(s, d), marks(s, d), pair, at).select(
            *pair, "contiguous_seq", "max_seen_seq", "client_allocated_seq", "status", "tail_pending", "promotable", "gap_count", "known_loss", "quarantined",
                "stale_seconds", "last_event_age_seconds"
        ),
        f"""{states}, holes AS (SELECT org_id, source_id, count(*) AS gap_count FROM absent JOIN states USING (org_id, source_id) WHERE seq <= max_seen_seq
            AND status = 'middle_gap' GROUP BY 1, 2),
          lost AS (SELECT org_id, source_id, count(*) AS known_loss FROM book GROUP BY 1, 2),
          held AS (SELECT org_id, source_id, count(*) AS quarantined FROM usage_event_ods WHERE ingest_status = 'quarantined' AND source_id IS NOT NULL GROUP BY 1,
              2)
          SELECT org_id, source_id, contiguous_seq, max_seen_seq, client_allocated_seq, status, tail_pending, promotable, coalesce(gap_count, 0) AS gap_count,
              coalesce(known_loss, 0) AS known_loss,
            coalesce(quarantined, 0) AS quarantined, CAST(floor(stale / 1000) AS BIGINT) AS stale_seconds,
                CAST(floor(quiet / 1000) AS BIGINT) AS last_event_age_seconds
          FROM states LEFT JOIN holes USING (org_id, source_id) LEFT JOIN lost USING (org_id, source_id) LEFT JOIN held USING (org_id, source_id)""",
        False,
    )
    _add(
        "completeness_rollup",
        lambda s, d: integrity.rollup(integrity.source_completeness(ods(s, d), book(s, d), marks(s, d), pair, at)),
        f"""{states}, held AS (SELECT count(*) AS quarantined FROM usage_event_ods JOIN states USING (org_id, source_id) WHERE ingest_status = 'quarantined')
          SELECT count(*) AS sources, count(*) FILTER (status <> 'ok') AS gap_sources, any_value(quarantined) AS quarantined, count(*) FILTER (status <> 'ok') = 0
              AND any_value(quarantined) = 0 AS healthy
          FROM states, held""",
        False,
    )
    _add(
        "promoted_losses",
        lambda s, d: integrity.promote_losses(integrity.classify(marks(s, d), at), accounted(s, d), pair),
        f"{states} SELECT org_id, source_id, seq, 'stale_' || status AS reason FROM absent JOIN states USING (org_id, source_id) WHERE promotable",
        False,
    )
    _add(
        "confirmed_losses",
        lambda s, d: integrity.confirm_losses(marks(s, d), accounted(s, d), marks(s, d).select(*pair, F.explode(F.sequence(F.lit(-1), F.lit(300))).alias("seq")),
            pair),
        f"""{states}, claims AS (SELECT org_id, source_id, unnest(range(1, 301)) AS seq FROM states)
          SELECT org_id, source_id, seq, 'client_confirmed' AS reason FROM (SELECT * FROM claims EXCEPT SELECT * FROM known) JOIN states USING (org_id, source_id)
          WHERE seq <= greatest(max_seen_seq, client_allocated_seq)""",
        False,
    )
    _add(
        "gap_listing",
        lambda s, d: integrity.gap_listing(marks(s, d), accounted(s, d), pair, 500),
        f"""{states} SELECT org_id, source_id, seq, greatest(max_seen_seq, client_allocated_seq) - contiguous_seq > 500 AS truncated
          FROM absent JOIN states USING (org_id, source_id) WHERE seq <= contiguous_seq + 500""",
        False,
    )
    _add(
        "stream_floors",
        lambda s, d: integrity.apply_floors(marks(s, d), marks(s, d).select(*pair, (F.col("max_seen_seq") - 40).alias("floor_seq")), pair).select(*pair,
            "contiguous_seq", "max_seen_seq", "stream_floor_seq"),
        f"""{states} SELECT org_id, source_id, greatest(contiguous_seq, max_seen_seq - 40, 0) AS contiguous_seq, max_seen_seq, greatest(max_seen_seq - 40,
            0) AS stream_floor_seq FROM states""",
        False,
    )
    # No table holds canaries or their status: every fiftieth event counts as one.

    def marked(s: SparkSession, d: str) -> DataFrame:
        status = F.when(F.pmod("ods_id", F.lit(3)) == 0, "pending").otherwise("projected")
        return ods(s, d).withColumns({"org_id": F.when(F.pmod("ods_id", F.lit(50)) == 0, health.CANARY).otherwise(F.col("org_id")), "dwd_status": status})

    ms = lambda c, w: f"max(epoch_us({c}) // 1000) FILTER ({w})"

    def verdict(s: SparkSession, d: str) -> DataFrame:
        judged, stage = health.verdict(dt.datetime(2025, 5, 2, 12, tzinfo=dt.UTC))
        return health.watermarks(marked(s, d), table(s, d, "usage_fact_dwd")).withColumns({"health": judged, "stale_stage": F.coalesce(stage, F.lit(""))})

    _add(
        "pipeline_health",
        verdict,
        f"""WITH o AS (SELECT {ms("ingest_received_at", "ods_id % 50 <> 0 AND org_id IS NOT NULL")} AS business_received_ms,
            {ms("ingest_received_at", "ods_id % 50 = 0")} AS canary_received_ms,
            {ms("ingest_received_at", "ods_id % 50 = 0 AND ods_id % 3 <> 0")} AS canary_projected_ms FROM usage_event_ods),
          f AS (SELECT max(epoch_us(projected_at) // 1000) AS business_projected_ms FROM usage_fact_dwd WHERE org_id <> '__canary__')
          SELECT *, CASE WHEN canary_received_ms IS NULL OR 1746187200000 - canary_projected_ms < 900000 THEN 'healthy' ELSE 'degraded' END AS health,
            CASE WHEN canary_received_ms IS NULL OR 1746187200000 - canary_projected_ms < 900000 THEN '' WHEN 1746187200000 - canary_received_ms < 900000
                THEN 'projector' ELSE 'collector' END AS stale_stage FROM o, f""",
        False,
    )
    _add(
        "vault_origin",
        lambda s, d: ods(s, d).groupBy(projector.vault_origin().alias("vault")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT coalesce(regexp_matches(virtual_key_id, '^(personal|oauth|app|probe):'), false) AS vault, count(*) AS n FROM usage_event_ods GROUP BY 1",
        False,
    )
    fate = """fate AS (SELECT ods_id, CASE
        WHEN coalesce(event_id, '') = '' OR coalesce(org_id, '') = '' OR event_time IS NULL OR occurred_at IS NULL OR coalesce(request_status, '') = ''
            THEN 'rejected'
        WHEN ods_id <> first_value(ods_id) OVER w THEN CASE WHEN coalesce(content_hash, '') <> '' AND coalesce(first_value(content_hash) OVER w, '') <> ''
          AND content_hash <> first_value(content_hash) OVER w THEN 'conflict' ELSE 'duplicate' END
        WHEN ingest_status = 'quarantined' THEN 'quarantined' ELSE 'accepted' END AS disposition
      FROM usage_event_ods WINDOW w AS (PARTITION BY org_id, event_id ORDER BY ods_id))"""
    _add("ingest_dispositions", lambda s, d: ingest.dispositions(ods(s, d)).select("ods_id", "disposition"), f"WITH {fate} SELECT * FROM fate", False)
    _add("ingest_tally", lambda s, d: ingest.tally(ingest.dispositions(ods(s, d))), f"WITH {fate} SELECT disposition, count(*) AS n FROM fate GROUP BY 1", False)
    _add(
        "ingest_dedup",
        lambda s, d: ingest.insert_or_ignore(
            ods(s, d).select("org_id", "event_id", "ods_id", "total_tokens"), ods(s, d).filter(F.pmod("ods_id", F.lit(5)) == 0), ["org_id", "event_id"], "ods_id"
        ),
        """SELECT org_id, event_id, min(ods_id) AS ods_id, arg_min(struct_pack(t := total_tokens), ods_id).t AS total_tokens FROM usage_event_ods
          WHERE (org_id, event_id) NOT IN (SELECT (org_id, event_id) FROM usage_event_ods WHERE ods_id % 5 = 0) GROUP BY 1, 2""",
        False,
    )
    control = """SELECT o.ods_id, v.event_id AS control_event_id, v.seat_id AS control_seat_id FROM usage_event_ods o
        LEFT JOIN (SELECT DISTINCT * FROM managed_key_control_events) v ON v.virtual_key_id = o.virtual_key_id AND v.effective_from <= o.event_time
          AND (v.effective_to IS NULL OR o.event_time < v.effective_to)
        QUALIFY row_number() OVER (PARTITION BY o.ods_id ORDER BY v.effective_from DESC, CAST(v.revision AS BIGINT) DESC) = 1"""
    _add(
        "control_lookup",
        lambda s, d: projector.control_lookup(ods(s, d).select("ods_id", "virtual_key_id", "event_time"), table(s, d, "managed_key_control_events")).select("ods_id",
            "control_event_id", "control_seat_id"),
        control,
        False,
    )
    path = "rtrim(lower(raw_event_json->>'$.request_path'), '/')"
    generates = f"coalesce({path} LIKE '%/messages' OR {path} LIKE '%/completions' OR {path} LIKE '%/responses', true)"
    _add("generation_scope", lambda s, d: ods(s, d).select("ods_id", ingest.generates().alias("generates")),
        f"SELECT ods_id, {generates} AS generates FROM usage_event_ods", False)
    _add(
        "project_dwd",
        lambda s, d: projector.project(ods(s, d), table(s, d, "managed_key_control_events")).select(
            "ods_id", "event_id", "org_id", F.col("usage_date").cast("string").alias("usage_date"), "billing_period", "seat_id", "model", "total_tokens",
                "source_seq", "latency_ms", "user_usage_scope"
        ),
        f"""WITH {fate}, control AS ({control})
          SELECT o.ods_id, event_id, org_id, strftime(event_time AT TIME ZONE 'UTC', '%Y-%m-%d') AS usage_date, strftime(event_time AT TIME ZONE 'UTC',
              '%Y-%m') AS billing_period,
            coalesce(nullif(seat_id, ''), control_seat_id, '') AS seat_id, coalesce(model, '') AS model, coalesce(total_tokens, 0) AS total_tokens, source_seq,
            coalesce({_MS.format("finished_at")} - {_MS.format("started_at")}, 0) AS latency_ms,
            CASE WHEN coalesce(total_tokens, 0) <= 0 AND NOT {generates} THEN 'non_generation' ELSE 'normal' END AS user_usage_scope
          FROM usage_event_ods o JOIN fate USING (ods_id) LEFT JOIN control USING (ods_id) WHERE disposition = 'accepted'""",
        False,
    )
    _add(
        "backlog",
        lambda s, d: projector.backlog(ods(s, d), table(s, d, "usage_fact_dwd")),
        """SELECT count(*) AS pending, CAST(coalesce((SELECT epoch_us(max(ingest_received_at)) // 1000
            FROM usage_event_ods) - epoch_us(min(ingest_received_at)) // 1000, 0) AS BIGINT) AS age_ms
          FROM usage_event_ods o WHERE ingest_status = 'accepted' AND NOT EXISTS (SELECT 1 FROM usage_fact_dwd d WHERE d.org_id = o.org_id
              AND d.event_id = o.event_id)""",
        False,
    )
    _add(
        "pipeline_watermarks",
        lambda s, d: projector.pipeline_watermarks(ods(s, d), table(s, d, "usage_fact_dwd")),
        """SELECT * FROM (SELECT org_id, epoch_us(max(ingest_received_at)) // 1000 AS received_ms FROM usage_event_ods GROUP BY 1)
          FULL JOIN (SELECT org_id, epoch_us(max(projected_at)) // 1000 AS projected_ms FROM usage_fact_dwd GROUP BY 1) USING (org_id)""",
        False,
    )


def _first_prompt(s: SparkSession, d: str) -> tuple[str, str, str]:
    prompts = conversation_audit.session_prompts(table(s, d, "conversation_messages")).filter("owner_account_id is not null")
    first = prompts.orderBy("org_id", "session_id", "owner_account_id").first()
    return (first["org_id"], first["owner_account_id"], first["session_id"]) if first else ("", "", "")


def _conversations() -> None:
    org = "org-castern"
    records = lambda s, d: table(s, d, "conversation_records")
    keyed = f"""WITH k AS (SELECT *, coalesce(nullif(seat_id, ''), owner_account_id) AS seat, coalesce(session_id, event_id) AS session,
        epoch_us(created_at) // 1000 AS ms
        FROM conversation_records WHERE org_id = '{org}')"""
    _add(
        "conv_seats",
        lambda s, d: conversation_audit.seat_summaries(records(s, d), org, limit=50),
        f"""{keyed} SELECT seat, count(DISTINCT session) AS sessions, CAST(count(*) AS BIGINT) AS turns, CAST(coalesce(sum(content_bytes), 0) AS BIGINT) AS bytes,
          CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens, max(ms) AS last_ms FROM k GROUP BY 1 ORDER BY tokens DESC, last_ms DESC, seat LIMIT 50""",
        False,
    )
    _add("conv_seat_total", lambda s, d: conversation_audit.seat_total(records(s, d), org), f"{keyed} SELECT count(DISTINCT seat) AS n FROM k", False)
    busiest = "(SELECT seat FROM k GROUP BY 1 ORDER BY count(*) DESC, seat LIMIT 1)"

    def seat(s: SparkSession, d: str) -> str:
        rows = records(s, d).filter(F.col("org_id") == org).groupBy(conversation_audit.seat_key().alias("seat")).count()
        first = rows.orderBy(F.desc("count"), "seat").first()
        return first["seat"] if first else ""

    _add(
        "conv_sessions",
        lambda s, d: conversation_audit.session_summaries(records(s, d), org, seat(s, d), limit=100),
        f"""{keyed} SELECT session, min(ms) AS first_ms, max(ms) AS last_ms, CAST(count(*) AS BIGINT) AS turns, CAST(coalesce(sum(total_tokens),
            0) AS BIGINT) AS tokens
          FROM k WHERE seat = {busiest} GROUP BY 1 ORDER BY last_ms DESC, first_ms DESC, session LIMIT 100""",
        False,
    )
    _add(
        "conv_session_ids",
        lambda s, d: conversation_audit.session_ids(records(s, d), org, seat(s, d)),
        f"{keyed} SELECT session, min(ms) AS first_ms FROM k WHERE seat = {busiest} GROUP BY 1",
        False,
    )

    def longest(s: SparkSession, d: str) -> str:
        rows = records(s, d).filter((F.col("org_id") == org) & (conversation_audit.seat_key() == seat(s, d)))
        first = rows.groupBy(conversation_audit.session_key().alias("session")).count().orderBy(F.desc("count"), "session").first()
        return first["session"] if first else ""

    _add(
        "conv_thread",
        lambda s, d: conversation_audit.thread(records(s, d), org, seat(s, d), longest(s, d)),
        f"""{keyed} SELECT event_id, ms AS created_ms, user_text, assistant_text, model, total_tokens FROM k WHERE seat = {busiest}
          AND session = (SELECT session FROM k WHERE seat = {busiest} GROUP BY 1 ORDER BY count(*) DESC, session LIMIT 1) ORDER BY created_at,
              event_id LIMIT 1000""",
        False,
    )
    _add(
        "conv_system_text",
        lambda s, d: conversation_audit.session_prompts(table(s, d, "conversation_messages")),
        """SELECT org_id, coalesce(session_id, '') AS session_id, owner_account_id, system_text FROM conversation_messages WHERE coalesce(system_text, '') <> ''
          QUALIFY row_number() OVER (PARTITION BY org_id, coalesce(session_id, '') ORDER BY created_at, event_id, system_text, owner_account_id) = 1""",
        False,
    )
    _add("conv_session_total", lambda s, d: conversation_audit.session_total(records(s, d), org, seat(s, d)),
        f"{keyed} SELECT count(DISTINCT session) AS n FROM k WHERE seat = {busiest}", False)
    _add(
        "conv_session_prompt",
        lambda s, d: conversation_audit.session_prompt(conversation_audit.session_prompts(table(s, d, "conversation_messages")), *_first_prompt(s, d)),
        """WITH p AS (SELECT org_id, coalesce(session_id, '') AS session_id, owner_account_id, system_text FROM conversation_messages WHERE coalesce(system_text,
            '') <> ''
            QUALIFY row_number() OVER (PARTITION BY org_id, coalesce(session_id, '') ORDER BY created_at, event_id, system_text, owner_account_id) = 1)
          SELECT coalesce(min(system_text), '') AS system_text FROM (SELECT * FROM p WHERE owner_account_id IS NOT NULL ORDER BY org_id, session_id,
              owner_account_id LIMIT 1)""",
        False,
    )

    def dated(s: SparkSession, d: str) -> DataFrame:
        return conversation_audit.seat_summaries(records(s, d), org, dt.date(2025, 3, 1), dt.date(2025, 3, 31), search="E1", exact=[seat(s, d)], sort="turns",
            limit=100)

    _add(
        "conv_seats_searched",
        dated,
        f"""{keyed} SELECT seat, count(DISTINCT session) AS sessions, CAST(count(*) AS BIGINT) AS turns, CAST(coalesce(sum(content_bytes), 0) AS BIGINT) AS bytes,
          CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens, max(ms) AS last_ms FROM k WHERE conv_date BETWEEN DATE '2025-03-01' AND DATE '2025-03-31'
          AND (seat = {busiest} OR contains(lower(coalesce(seat, '')), 'e1')) GROUP BY 1 ORDER BY turns DESC, last_ms DESC, seat LIMIT 100""",
        False,
    )

    def claims(s: SparkSession, d: str) -> DataFrame:
        """Records with arrival numbers; sequence numbers are folded, as the table has no conflicts, and some rows lack a status."""
        rows = records(s, d).withColumns({"source_seq": F.pmod("source_seq", F.lit(40)), "request_status": F.when(F.pmod("content_bytes", F.lit(53)) == 0,
            "").otherwise(F.col("request_status"))})
        # Fixed once, so that every use of the rows sees the same numbers.
        return checkpoint(rows.withColumn("arrival", F.monotonically_increasing_id()))

    fates = """rows AS (SELECT *, source_seq % 40 AS claimed, CASE WHEN content_bytes % 53 = 0 THEN '' ELSE request_status END AS state,
        CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day FROM conversation_records),
        good AS (SELECT * FROM rows WHERE coalesce(event_id, '') <> '' AND coalesce(org_id, '') <> '' AND created_at IS NOT NULL AND coalesce(state, '') <> ''),
        owners AS (SELECT org_id, source_id, claimed, arg_min(event_id, (created_at, event_id)) AS owner FROM good WHERE claimed IS NOT NULL AND coalesce(source_id,
            '') <> '' GROUP BY 1, 2, 3),
        firsts AS (SELECT DISTINCT event_id, day FROM good)"""
    _add(
        "conv_ingest_tally",
        lambda s, d: ingest.tally(conversation_ingest.dispositions(claims(s, d), ["created_at", "event_id", "arrival"])),
        f"""WITH {fates}, kept AS (SELECT f.event_id, any_value(g.org_id) AS org_id, any_value(g.source_id) AS source_id, any_value(g.claimed) AS claimed
            FROM firsts f JOIN good g USING (event_id, day) GROUP BY f.event_id, f.day)
          SELECT * FROM (SELECT 'rejected' AS disposition, (SELECT count(*) FROM rows) - (SELECT count(*) FROM good) AS n UNION ALL
            SELECT 'duplicated', (SELECT count(*) FROM good) - (SELECT count(*) FROM firsts) UNION ALL
            SELECT CASE WHEN owner <> event_id THEN 'quarantined' ELSE 'accepted' END, count(*) FROM kept LEFT JOIN owners USING (org_id, source_id, claimed)
                GROUP BY 1) WHERE n > 0""",
        False,
    )
    _add(
        "conv_seq_owners",
        lambda s, d: integrity.seq_owners(claims(s, d), ["org_id", "source_id"], ["created_at"]),
        """SELECT org_id, source_id, source_seq % 40 AS seq, arg_min(event_id, (created_at, event_id)) AS owner FROM conversation_records
          WHERE source_seq IS NOT NULL AND coalesce(source_id, '') <> '' GROUP BY 1, 2, 3""",
        False,
    )
    turn = r"""'## ' || strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S UTC') || chr(10) || chr(10) || '**User:** ' || coalesce(user_text,
        '') || chr(10) || chr(10) || '**Assistant:** ' || coalesce(assistant_text, '') || chr(10)"""
    _add(
        "conv_export",
        lambda s, d: conversation_audit.markdown_sessions(records(s, d), org, seat(s, d)),
        f"""{keyed} SELECT coalesce(nullif(regexp_replace(session, '[^A-Za-z0-9._-]', '_', 'g'), ''), 'unknown') || '.md' AS file_name,
          '# Session ' || session || chr(10) || chr(10) || string_agg(turn, chr(10) ORDER BY created_at, event_id, turn) AS body
          FROM (SELECT *, {turn} AS turn FROM k WHERE seat = {busiest}) GROUP BY session""",
        False,
    )


for _define in (_usage, _audit, _delivery, _conversations):
    _define()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
