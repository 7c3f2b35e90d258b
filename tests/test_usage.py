import datetime as dt
import json
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import ingest
from tallyforge.params import QueryParams, clamp
from tallyforge.plans import audit, conversation_audit, reference_queries, usage
from tallyforge.sources import batches, exports
from tests.oracle import compare

NOW = dt.datetime(2025, 3, 10, 12, tzinfo=dt.UTC)
FACT = (
    "dwd_id long, ods_id long, event_id string, request_id string, org_id string, account_id string, seat_id string, request_count int, request_status string, event_time timestamp, "
    "usage_date date, total_tokens long, input_tokens long, output_tokens long, cached_input_tokens long, cache_creation_input_tokens long, billable_amount decimal(20,8), currency string, "
    "user_usage_scope string, provider_code string, protocol_type string, model string, app_slug string, session_id string, virtual_key_id string, virtual_key_alias string, quality_status string, "
    "fallback_attempt int, oauth_identity string"
)


def fact(spark, rows):
    base = {
        "org_id": "o", "account_id": "a", "seat_id": "s", "request_count": 1, "request_status": "success", "event_time": dt.datetime(2025, 3, 1, 4), "total_tokens": 10, "currency": "USD",
        "user_usage_scope": "normal", "input_tokens": 1, "output_tokens": 2, "cached_input_tokens": 3, "cache_creation_input_tokens": 4,
    }
    names = [f.split()[0] for f in FACT.split(", ")]
    full = []
    for i, r in enumerate(rows):
        r = base | {"dwd_id": i, "ods_id": i, "event_id": f"e{i}"} | r
        r["usage_date"] = r["event_time"].date()
        full.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(full, FACT)


ME = QueryParams(now=NOW, seat_id="s", start=dt.date(2025, 3, 1), end=dt.date(2025, 3, 2))


def test_one_attempt_of_a_request_counts(spark):
    rows = [
        {"request_id": "r", "request_status": "error"}, {"request_id": "r", "event_time": dt.datetime(2025, 3, 1, 1)}, {"request_id": "r", "request_status": "error", "event_time": dt.datetime(2025, 3, 9)},
        {"request_id": None, "request_count": 3}, {"request_id": "", "request_count": 2}, {"request_id": "r", "seat_id": None}, {"request_id": "r", "seat_id": ""},
        {"request_id": "t"}, {"request_id": "t"}, {"request_id": "u", "request_status": None},
    ]
    got = {r["dwd_id"]: r["client_request_count"] for r in usage.reporting_view(fact(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 2, 5: 0, 6: 1, 7: 0, 8: 1, 9: 1}


def test_cost_counts_dollars_only_and_prices_add_up(spark):
    from decimal import Decimal

    rows = [{"billable_amount": Decimal("0.005"), "provider_code": "x"}, {"billable_amount": Decimal("2"), "currency": "EUR", "provider_code": "x"}, {"provider_code": "x"}, {"user_usage_scope": "excluded", "provider_code": "x"}]
    r = usage.by_protocol_total(fact(spark, rows), ME).first()
    assert (r["cost_usd"], r["priced"], r["unpriced"], r["requests"], r["tokens"]) == (0.005, 2, 1, 3, 30)


def test_local_days_and_hours(spark):
    rows = [{"event_time": dt.datetime(2025, 3, 1, 17)}, {"event_time": dt.datetime(2025, 3, 1, 4)}]
    p = QueryParams(now=NOW, seat_id="s", tz="Asia/Shanghai", start=dt.date(2025, 3, 1), end=dt.date(2025, 3, 2))
    assert {r["date"] for r in usage.personal_timeline(fact(spark, rows), p).collect()} == {"2025-03-01", "2025-03-02"}
    assert {r["hour"] for r in usage.personal_hourly(fact(spark, rows), p).collect()} == {12, 1}


def test_params():
    p = QueryParams(now=NOW, tz="Nowhere/Land")
    assert p.zone.key == "UTC" and p.days() == (dt.date(2025, 2, 8), dt.date(2025, 3, 10))
    spring = QueryParams(now=NOW, tz="Europe/Berlin", start=dt.date(2025, 3, 30), end=dt.date(2025, 3, 30))
    since, until = spring.window()
    assert until - since == dt.timedelta(hours=23)
    assert QueryParams(now=NOW, start=dt.date(2025, 3, 9), end=dt.date(2025, 3, 1)).prune_days() is None
    assert [clamp(x, 20, 1000) for x in (0, -1, 5, 2000)] == [20, 20, 5, 1000]


def test_model_list_is_cut_at_twenty_and_names_the_unknown(spark):
    rows = [{"model": f"m{i:02}", "total_tokens": i} for i in range(25)] + [{"model": None, "total_tokens": 400}, {"model": "", "total_tokens": 100}]
    got = usage.by_model_total(fact(spark, rows), ME).collect()
    assert len(got) == 20 and (got[0]["model"], got[0]["tokens"]) == ("unknown", 500) and got[-1]["model"] == "m06"


def test_latency_rank(spark):
    def p95(ms):
        rows = [("o", T0, T0 + dt.timedelta(milliseconds=m) if m is not None else None, T0) for m in ms]
        df = spark.createDataFrame(rows, "org_id string, started_at timestamp, finished_at timestamp, event_time timestamp")
        r = usage.upstream_latency(df, QueryParams(now=NOW, org_id="o", start=dt.date(2025, 3, 1), end=dt.date(2025, 3, 2))).collect()
        return [(x["p95_ms"], x["samples"], x["window_days"]) for x in r]

    T0 = dt.datetime(2025, 3, 1, 5)
    assert p95(range(1, 21)) == [(20, 20, 7)]
    assert p95([5000 * i for i in range(1, 101)]) == [(5000 * 96, 100, 7)]
    assert p95([7, None, 0, -3]) == [(7, 1, 7)]
    assert p95([]) == [(0, 0, 7)]


def test_audit_filters(spark):
    rows = [{"model": "50%_off", "event_id": "x"}, {"model": "other", "event_id": "y", "fallback_attempt": None}, {"user_usage_scope": "non_generation"}, {"event_time": dt.datetime(2025, 3, 9)}]
    seats = spark.createDataFrame([("s", "Ann", "ann@x.example", "human"), ("s", None, None, "human")], "seat_id string, alias string, invited_email string, seat_type string")
    f = fact(spark, rows)
    p = QueryParams(now=NOW, org_id="o", start=dt.date(2025, 3, 1), end=dt.date(2025, 3, 2))
    assert audit.audit_rows(f, seats, p).count() == 2
    assert [r["event_id"] for r in audit.audit_rows(f, seats, p, keyword="50%_").collect()] == ["x"]
    assert audit.audit_rows(f, seats, p, keyword="ANN@").count() in (0, 2)
    with pytest.raises(ValueError):
        audit.audit_rows(f, seats, p, priced="maybe")
    pages = [audit.audit_detail(audit.audit_rows(f, seats, p), limit=1, offset=n).first()["event_id"] for n in (0, 1)]
    assert sorted(pages) == ["x", "y"]


def test_conversation_keys(spark):
    columns = "event_id string, conv_date date, org_id string, session_id string, seat_id string, owner_account_id string, user_text string, assistant_text string, model string, total_tokens long, content_bytes long, created_at timestamp"
    d, t = dt.date(2025, 3, 1), dt.datetime(2025, 3, 1)
    rows = [("1", d, "o", None, "", "own", "q", "a", "m", 1, 1, t), ("2", d, "o", "", "", "own", "q", "a", "m", 1, 1, t), ("3", d, "o", "", "s", "own", "q", None, "m", None, 1, t), ("4", d, "o", "x/y", None, None, "q", "a", "m", 1, 1, t)]
    df = spark.createDataFrame(rows, columns)
    got = {r["seat"]: (r["sessions"], r["turns"], r["tokens"]) for r in conversation_audit.seat_summaries(df, "o").collect()}
    assert got == {"own": (2, 2, 2), "s": (1, 1, 0), None: (1, 1, 1)}
    assert conversation_audit.seat_total(df, "o").first()["n"] == 2
    assert conversation_audit.seat_summaries(df, "o", exact=[]).count() == 0
    assert conversation_audit.seat_summaries(df, "o", search="OW").count() == 1
    files = conversation_audit.markdown_sessions(df, "o", "own")
    assert {r["file_name"] for r in files.collect()} == {"1.md", "unknown.md"}
    with zipfile.ZipFile(BytesIO(exports.zip_sessions(files))) as z:
        assert sorted(z.namelist()) == ["1.md", "unknown.md"] and z.read("1.md").decode().startswith("# Session 1\n\n## 2025-03-01 00:00:00 UTC")


def test_batches_dispositions_and_conservation(spark, tmp_path):
    event = {"event_id": "e1", "org_id": "o", "account_id": "mine", "event_time": 1740787200123, "occurred_at": 1740787200123, "request_status": "success", "request_count": 0, "unknown": 1}
    lines = [
        {"subject": "me", "events": [event, event, event | {"event_id": ""}, event | {"event_id": "e2", "event_time": 0}]}, {"events": []}, {"subject": "", "events": [event | {"event_id": "e3"}]},
        {"subject": "me", "events": [event] * 501},
    ]
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, lines)))
    got = batches.read_batches(spark, str(tmp_path)).withColumns({"ods_id": F.monotonically_increasing_id(), "ingest_status": F.lit("accepted")})
    assert got.filter("batch_error is not null").count() == 1
    rows = got.filter("batch_error is null")
    assert {r["account_id"] for r in rows.collect()} == {"me", "mine"} and {r["request_count"] for r in rows.collect()} == {1}
    counts = {r["disposition"]: r["n"] for r in ingest.tally(ingest.dispositions(rows)).collect()}
    assert counts == {"accepted": 2, "duplicate": 1, "rejected": 2}
    ingest.check_conservation(counts, rows.count())
    with pytest.raises(AssertionError):
        ingest.check_conservation(counts, 6)


def test_content_hash_quarantines_only_known_schemes(spark):
    columns = "ods_id long, event_id string, org_id string, event_time timestamp, occurred_at timestamp, request_status string, ingest_status string, content_hash string, model string, input_tokens long, cached_input_tokens long, cache_creation_input_tokens long, output_tokens long, total_tokens long, first string"
    row = lambda i, h: (i, f"e{i}", "o", NOW, NOW, "ok", "accepted", h, "m", 1, 2, 3, 4, None, "clash")
    df = spark.createDataFrame([row(1, None), row(2, "sha256:v1:ff"), row(3, ingest.SCHEME + "ff"), row(4, "x")], columns)
    right = df.filter("ods_id = 4").withColumn("content_hash", ingest.content_hash())
    got = {r["ods_id"]: r["disposition"] for r in ingest.dispositions(df.filter("ods_id < 4").unionByName(right)).collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "quarantined", 4: "accepted"}


def test_a_message_repeated_very_often_is_no_hot_group(spark):
    columns = (
        "ods_id long, event_id string, org_id string, event_time timestamp, occurred_at timestamp, request_status string, ingest_status string, content_hash string, "
        "model string, input_tokens long, cached_input_tokens long, cache_creation_input_tokens long, output_tokens long, total_tokens long"
    )
    row = lambda i, e, h: (i, e, "o", NOW, NOW, "ok", "accepted", h, "m", 1, 2, 3, 4, None)
    rows = [row(i, "hot", ["a", "b", None, ""][i % 4]) for i in range(40)] + [row(100 + i, f"e{i // 2}", "c") for i in range(20)] + [row(200, "", None), row(201, None, None)]
    df = spark.createDataFrame(rows, columns)
    whole, split = ({r["ods_id"]: r["disposition"] for r in ingest.dispositions(df, rows_per_task=n).collect()} for n in (10**6, 5))
    assert whole == split and len(whole) == 62
    assert [whole[i] for i in (0, 1, 2, 4, 100, 101, 200, 201)] == ["accepted", "conflict", "duplicate", "duplicate", "accepted", "duplicate", "rejected", "rejected"]


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0, 1740787200123), (None, "", 5, None)], "n long, s string, latency_ms long, event_ms long")
    exports.write_csv(df, str(tmp_path / "csv"))
    lines = sorted(line for f in (tmp_path / "csv").glob("*.csv") for line in f.read_text().splitlines()[1:])
    assert lines == [",,5,", "1,,0,2025-03-01T00:00:00Z"]


@pytest.mark.parametrize("name", ["personal_timeline", "by_key_total", "audit_facets", "missing_seqs", "watermark_with_losses", "project_dwd", "conv_export"])
def test_queries_match_their_sql(spark, name):
    got, want = compare(spark, "/root/testdata/sf0.001", name, reference_queries.queries()[name], reference_queries.oracle_sql()[name])
    assert got == want


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
