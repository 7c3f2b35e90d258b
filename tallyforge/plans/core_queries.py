"""Queries p1 to p5 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import asof, idindex, kslack, multiselect, rolling
from tallyforge.runtime import normal_id, table

LATENESS_DAYS = 3


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    fact = table(spark, d, "usage_fact_dwd").filter(F.col("seat_id") != "")
    return rolling.rolling_totals(fact, ["seat_id"], "usage_date", ["total_tokens", "billable_amount"])


def _units(amount: str) -> Column:
    """An amount of eight decimals as a whole number: the same double on every engine once divided."""
    return (F.col(amount) * 100_000_000).cast("bigint").cast("double")


def p1_rolling_totals(spark: SparkSession, d: str) -> DataFrame:
    r = _rolling(spark, d)
    return r.select(
        "seat_id",
        F.col("day").cast("string").alias("usage_date"),
        *(F.col(f"total_tokens_{k}_{p}").cast(t).alias(f"tokens_{k}_{p}") for p in (7, 30) for k, t in (("sum", "bigint"), ("avg", "double"))),
        *((_units(f"billable_amount_sum_{p}") / (1e8 * (p if k == "avg" else 1))).alias(f"amount_{k}_{p}") for p in (7, 30) for k in ("sum", "avg")),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    fact = table(spark, d, "usage_fact_dwd").filter(F.col("seat_id") != "")
    r = rolling.rolling_totals(fact, ["seat_id"], "usage_date", ["total_tokens"])
    idle = (F.col("total_tokens_sum_7") == 0) & (F.col("total_tokens_sum_30") > 0)
    return r.filter(idle).select("seat_id", F.col("day").cast("string").alias("usage_date"))


def _event_id() -> list[Column]:
    return [normal_id("org_id"), normal_id("event_id")]


def _kept_rows(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    ods = table(spark, d, "usage_event_ods")
    kept = idindex.kept_deliveries(ods, _event_id(), "ods_id", "ingest_received_at")
    return ods.select("ods_id", "event_time", "ingest_received_at", *columns).join(kept, "ods_id", "left_semi")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    left = kslack.released(_kept_rows(spark, d), "event_time", "ingest_received_at", "ods_id", LATENESS_DAYS)
    return left.filter(F.col("outcome").isin(kslack.CORRECTS, kslack.REJECTED))


def _kept_buffer(spark: SparkSession, d: str) -> DataFrame:
    rows = _kept_rows(spark, d, "total_tokens", "request_status")
    return kslack.buffered(rows, "event_time", "ingest_received_at", LATENESS_DAYS)


def p2_provisional_totals(spark: SparkSession, d: str) -> DataFrame:
    r = kslack.provisional_totals(_kept_buffer(spark, d), "ingest_received_at", "total_tokens", LATENESS_DAYS)
    return r.select(
        F.col("period").cast("string").alias("usage_date"),
        F.col("as_of").cast("string").alias("as_of"),
        "is_final",
        F.col("events").cast("bigint").alias("events"),
        F.col("total_tokens").cast("bigint").alias("total_tokens"),
    )


def p2_final_totals(spark: SparkSession, d: str) -> DataFrame:
    r = kslack.final_totals(_kept_buffer(spark, d), "event_time", "ods_id", "total_tokens", "request_status")
    return r.withColumn("usage_date", F.col("period").cast("string")).drop("period")


def _latencies(spark: SparkSession, d: str) -> DataFrame:
    fact = table(spark, d, "usage_fact_dwd").filter("latency_ms > 0 and provider_code <> '' and model <> ''")
    return multiselect.value_counts(fact, ["provider_code", "model"], "latency_ms")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    group = ["provider_code", "model"]
    r = multiselect.percentiles(_latencies(spark, d), group, [0.5, 0.95]).filter("n >= 100")
    r = r.groupBy(*group).agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95"))
    return r.filter(F.col("p95") >= 10 * F.col("p50")).select(*group)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The whole's percentiles from the merged states of separate days."""
    group = ["provider_code", "model"]
    fact = table(spark, d, "usage_fact_dwd").filter("latency_ms > 0 and provider_code <> '' and model <> ''")
    daily = multiselect.value_counts(fact, ["usage_date", *group], "latency_ms")
    whole = multiselect.merge_counts(daily.drop("usage_date"), group=group)
    r = multiselect.percentiles(whole, group, [0.5, 0.9, 0.95, 0.99])
    return r.select(*group, "q", F.col("value").cast("bigint").alias("latency_ms"), F.col("n").cast("bigint").alias("n"))


def _asof(spark: SparkSession, d: str, extra: bool) -> DataFrame:
    ods = table(spark, d, "usage_event_ods").select("ods_id", "virtual_key_id", "event_time")
    control = table(spark, d, "managed_key_control_events")
    number = F.col("revision").try_cast("decimal(38,0)")
    newest = control.groupBy("virtual_key_id").agg(F.max(number).alias("newest"))
    versions = control.join(newest, "virtual_key_id")
    attributes = {"control_event_id": F.col("event_id"), "superseded": ~number.eqNullSafe(F.col("newest"))}
    if extra:
        attributes |= {f"control_{c}": F.col(c) for c in ("seat_id", "account_id", "provider_id", "credential_id")}
    return asof.attributes_asof(
        ods, versions, key="virtual_key_id", event_time="event_time", effective_from="effective_from", effective_to="effective_to",
        recorded_at="recorded_at", priority=[F.col("effective_from"), number], attributes=attributes, row_id="ods_id",
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, extra=False).filter("superseded").select("ods_id", "control_event_id")


def p4_attributes(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, extra=True).drop("event_time", "superseded")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ods = table(spark, d, "usage_event_ods")
    return idindex.deliveries(ods, _event_id(), "ods_id", "ingest_received_at").filter("not first").select("ods_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_rolling_totals, p1_found, p2_found, p2_provisional_totals, p2_final_totals, p3_found, p3_percentiles, p4_found, p4_attributes,
        p5_found)}


_KEPT = """
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(trim(org_id)), lower(trim(event_id)) ORDER BY ingest_received_at, ods_id) AS rn
    FROM usage_event_ods) WHERE rn = 1),
buffered AS (
  SELECT *, CAST(event_time AT TIME ZONE 'UTC' AS DATE) AS period,
    CASE WHEN (ingest_received_at AT TIME ZONE 'UTC') < CAST(event_time AT TIME ZONE 'UTC' AS DATE) + INTERVAL 1 DAY THEN 'on_time'
         WHEN (ingest_received_at AT TIME ZONE 'UTC') < CAST(event_time AT TIME ZONE 'UTC' AS DATE) + INTERVAL 4 DAY THEN 'corrects'
         ELSE 'rejected' END AS outcome
  FROM kept)"""
_DAILY = """
daily AS (
  SELECT seat_id, usage_date AS day, sum(coalesce(total_tokens, 0)) AS tokens, sum(coalesce(billable_amount, 0)) AS amount
  FROM usage_fact_dwd WHERE seat_id <> '' AND usage_date IS NOT NULL GROUP BY ALL),
calendar AS (
  SELECT seat_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY seat_id),
totals AS (
  SELECT c.seat_id, CAST(c.day AS VARCHAR) AS usage_date,
    coalesce(sum(t.tokens) FILTER (t.day > c.day - 7), 0) AS t7, coalesce(sum(t.tokens), 0) AS t30,
    coalesce(sum(t.amount) FILTER (t.day > c.day - 7), 0) AS a7, coalesce(sum(t.amount), 0) AS a30
  FROM calendar c LEFT JOIN daily t ON t.seat_id = c.seat_id AND t.day <= c.day AND t.day > c.day - 30
  GROUP BY c.seat_id, c.day)"""
_APPLIES = """
versions AS (
  SELECT DISTINCT *, CAST(revision AS BIGINT) AS number, max(CAST(revision AS BIGINT)) OVER (PARTITION BY virtual_key_id) AS newest
  FROM managed_key_control_events),
applies AS (
  SELECT o.ods_id, o.virtual_key_id, v.event_id AS control_event_id, v.number, v.newest, v.seat_id, v.account_id, v.provider_id, v.credential_id
  FROM usage_event_ods o JOIN versions v ON v.virtual_key_id = o.virtual_key_id AND v.effective_from <= o.event_time
    AND v.recorded_at <= o.event_time AND (v.effective_to IS NULL OR o.event_time < v.effective_to)
  QUALIFY row_number() OVER (PARTITION BY o.ods_id ORDER BY v.effective_from DESC, v.number DESC) = 1)"""


def oracle_sql() -> dict[str, str]:
    latencies = "FROM usage_fact_dwd WHERE latency_ms > 0 AND provider_code <> '' AND model <> ''"
    return {
        "p1_rolling_totals": f"""WITH {_DAILY}
            SELECT seat_id, usage_date, CAST(t7 AS BIGINT) AS tokens_sum_7, CAST(t7 AS DOUBLE) / 7 AS tokens_avg_7,
              CAST(t30 AS BIGINT) AS tokens_sum_30, CAST(t30 AS DOUBLE) / 30 AS tokens_avg_30,
              CAST(CAST(a7 * 100000000 AS BIGINT) AS DOUBLE) / 1e8 AS amount_sum_7, CAST(CAST(a7 * 100000000 AS BIGINT) AS DOUBLE) / 7e8 AS amount_avg_7,
              CAST(CAST(a30 * 100000000 AS BIGINT) AS DOUBLE) / 1e8 AS amount_sum_30, CAST(CAST(a30 * 100000000 AS BIGINT) AS DOUBLE) / 3e9 AS amount_avg_30
                  FROM totals""",
        "p1_found": f"WITH {_DAILY} SELECT seat_id, usage_date FROM totals WHERE t7 = 0 AND t30 > 0",
        "p2_found": f"WITH {_KEPT} SELECT ods_id, outcome FROM buffered WHERE outcome <> 'on_time'",
        "p2_provisional_totals": f"""WITH {_KEPT}, steps AS (SELECT unnest(range(0, {LATENESS_DAYS + 1})) AS step),
            periods AS (SELECT DISTINCT period, step FROM buffered, steps WHERE outcome <> 'rejected')
            SELECT CAST(p.period AS VARCHAR) AS usage_date, CAST(p.period + CAST(p.step AS INT) + 1 AS VARCHAR) AS as_of, p.step = {LATENESS_DAYS} AS is_final,
              count(b.ods_id) AS events, CAST(coalesce(sum(b.total_tokens), 0) AS BIGINT) AS total_tokens
            FROM periods p LEFT JOIN buffered b ON b.period = p.period AND b.outcome <> 'rejected'
              AND (b.ingest_received_at AT TIME ZONE 'UTC') < p.period + CAST(p.step + 1 AS INT) * INTERVAL 1 DAY GROUP BY p.period, p.step""",
        "p2_final_totals": f"""WITH {_KEPT}, linked AS (
              SELECT *, lag(event_time) OVER w AS before, lag(coalesce(request_status, '')) OVER w AS was
              FROM buffered WHERE outcome <> 'rejected' WINDOW w AS (PARTITION BY period ORDER BY event_time, ods_id))
            SELECT CAST(period AS VARCHAR) AS usage_date, count(*) AS events, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
              arg_min(ods_id, (event_time, ods_id)) AS first_id, arg_max(ods_id, (event_time, ods_id)) AS last_id,
              coalesce(max(epoch_us(event_time) - epoch_us(before)), 0) / 1e6 AS longest_silence_s,
              CAST(count(*) FILTER (was <> coalesce(request_status, '')) AS BIGINT) AS state_switches
            FROM linked GROUP BY period""",
        "p3_found": f"""SELECT provider_code, model {latencies} GROUP BY ALL
            HAVING count(*) >= 100 AND quantile_disc(latency_ms, 0.95) >= 10 * quantile_disc(latency_ms, 0.5)""",
        "p3_percentiles": f"""WITH qs AS (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS q),
            ranked AS (SELECT provider_code, model, latency_ms, row_number() OVER w AS r, count(*) OVER (PARTITION BY provider_code, model) AS n
              {latencies} WINDOW w AS (PARTITION BY provider_code, model ORDER BY latency_ms))
            SELECT provider_code, model, q, latency_ms, n FROM ranked, qs WHERE r = greatest(1, ceil(q * n - 1e-9))""",
        "p4_found": f"WITH {_APPLIES} SELECT ods_id, control_event_id FROM applies WHERE number <> newest",
        "p4_attributes": f"""WITH {_APPLIES} SELECT o.ods_id, o.virtual_key_id, a.control_event_id, a.seat_id AS control_seat_id,
            a.account_id AS control_account_id, a.provider_id AS control_provider_id, a.credential_id AS control_credential_id
            FROM usage_event_ods o LEFT JOIN applies a USING (ods_id)""",
        "p5_found": f"WITH {_KEPT} SELECT ods_id FROM usage_event_ods WHERE ods_id NOT IN (SELECT ods_id FROM kept)",
    }
