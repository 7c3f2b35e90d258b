import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import projector
from tallyforge.plans import audit, conversation_audit, usage
from tallyforge.runtime import table
from tallyforge.sources import batches, exports
from tallyforge.streaming.projection import ConversationStream, ProjectionStream
from tests.test_usage import ME, NOW, fact

D = "/root/testdata/sf0.001"


def test_stream_makes_the_facts_of_the_batch(spark, tmp_path):
    ods, control = table(spark, D, "usage_event_ods"), table(spark, D, "managed_key_control_events")
    stream = ProjectionStream(spark, f"file://{tmp_path}/a", control)
    parts = [ods.filter(F.pmod("ods_id", F.lit(3)) == n) for n in range(3)]
    for n in (0, 1, 1, 2, 0):
        stream.process(parts[n], n)
    one = stream.facts().groupBy("org_id", "event_id").count()
    want = projector.project(ods, control).select("org_id", "event_id").distinct()
    assert one.filter("count > 1").isEmpty()
    assert {tuple(r) for r in one.select("org_id", "event_id").collect()} >= {tuple(r) for r in want.collect()}
    assert {p.name for p in (tmp_path / "a/facts/batch=1").iterdir() if p.is_dir()} <= {f"usage_date={r[0]}" for r in ods.select(F.to_date("event_time").cast("string")).distinct().collect()}
    tally = spark.read.parquet(f"{tmp_path}/a/tally").agg(F.sum("n")).first()[0]
    assert tally == ods.count()


def test_canaries_and_broken_rows_never_become_facts(spark, tmp_path):
    ods, control = table(spark, D, "usage_event_ods").limit(30), table(spark, D, "managed_key_control_events")
    ids = [r["ods_id"] for r in ods.select("ods_id").collect()]
    broken = ods.withColumns(
        {
            "virtual_key_id": F.when(F.col("ods_id") == ids[0], "__canary__").otherwise(F.col("virtual_key_id")),
            "event_id": F.when(F.col("ods_id") == ids[1], "").otherwise(F.col("event_id")),
            "ingest_status": F.when(F.col("ods_id") == ids[2], "quarantined").otherwise("accepted"),
        }
    )
    stream = ProjectionStream(spark, f"file://{tmp_path}/b", control)
    stream.process(broken, 0)
    aside = {r["ods_id"]: (r["fate"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/b/aside").collect()}
    assert {ids[0]: ("canary", None), ids[1]: ("rejected", "event_id is required"), ids[2]: ("quarantined", None)}.items() <= aside.items()
    assert not {r["ods_id"] for r in stream.facts().collect()} & set(ids[:3])
    stream.process(broken.limit(0), 1)
    assert stream.facts().filter("event_id is null").count() == 0


def test_conversation_batches_end_to_end(spark, tmp_path):
    turn = {"event_id": "e1", "org_id": "o", "session_id": "s", "source_id": "x", "source_seq": 1, "created_at": 1740787200123, "request_status": "ok", "user_text": "q", "surprise": 1}
    lines = [{"records": [turn, turn, turn | {"event_id": "e2"}, turn | {"event_id": "e3", "created_at": 0}]}, {"records": []}, {"records": [turn] * 501}]
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.json").write_text("\n".join(map(json.dumps, lines)))
    assert batches.read_turns(spark, str(landing)).filter("batch_error is not null").count() == 1
    stream = ConversationStream(spark, f"file://{tmp_path}/c")
    read = lambda: batches.stream_turns(spark, str(landing)).filter("batch_error is null").withColumn("arrival", F.col("pos").cast("long"))
    stream.start(read()).awaitTermination()
    (landing / "2.json").write_text(json.dumps({"records": [turn, turn | {"event_id": "e4", "source_seq": 2}, turn | {"event_id": "e5", "source_seq": 2}]}))
    stream.start(read()).awaitTermination()
    got = {r["event_id"]: r["ingest_status"] for r in stream.records().collect()}
    assert got == {"e1": "accepted", "e2": "quarantined", "e4": "accepted", "e5": "quarantined"}
    assert {r["disposition"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/c/aside").groupBy("disposition").count().collect()} == {"duplicated": 2, "rejected": 1}


def test_personal_rows_are_told_by_their_organisation(spark):
    rows = [{"org_id": "personal", "seat_id": "", "account_id": a, "model": "m"} for a in (None, "", "set")] + [{"org_id": "o", "account_id": "set", "model": "m"}]
    view = fact(spark, rows)
    from dataclasses import replace

    for account in ("", "set", "other"):
        p = replace(ME, seat_id="", org_id="personal", account_id=account)
        assert usage.by_model_total(view, p).first()["requests"] == 3
    assert usage.by_model_total(view, replace(ME, seat_id="", account_id="set")).first()["requests"] == 2
    assert usage.by_model_total(view, replace(ME, seat_id="", account_id="")).first()["requests"] == 1


def test_nothing_is_cut_or_ignored_in_silence(spark):
    records = table(spark, D, "conversation_records")
    assert conversation_audit.seat_summaries(records, "o", exact=["k"] * 1000).count() == 0
    with pytest.raises(ValueError):
        conversation_audit.seat_summaries(records, "o", exact=["k"] * 1001)
    from dataclasses import replace

    with pytest.raises(ValueError):
        usage.personal_detail(fact(spark, []), fact(spark, []), replace(ME, filters={"colour": "red"}))


def test_unpriced_list_and_its_status(spark):
    state = spark.createDataFrame([("m", "p", 1, 2, 3, "pending"), ("n", "p", 1, 5, 9, "fixed")], "model string, provider string, first_ms long, last_ms long, n long, status string")
    assert [r["model"] for r in usage.unpriced_list(state).collect()] == ["n", "m"] and usage.unpriced_list(state, "pending").count() == 1
    done = usage.set_unpriced_status(state, "m", "p", "acknowledged")
    assert {r["model"]: r["status"] for r in done.collect()} == {"m": "acknowledged", "n": "fixed"}
    for call in (lambda: usage.unpriced_list(state, "odd"), lambda: usage.set_unpriced_status(state, "m", "p", "odd")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(LookupError):
        usage.set_unpriced_status(state, "x", "p", "fixed")


def test_threads_are_written_in_order(spark, tmp_path):
    t = dt.datetime(2025, 3, 1)
    rows = [("o", "seat", "s1", f"e{i:03}", t + dt.timedelta(minutes=i), f"q{i}", f"a{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "org_id string, seat_id string, session_id string, event_id string, created_at timestamp, user_text string, assistant_text string")
    df = df.withColumn("owner_account_id", F.lit(""))
    exports.write_threads(conversation_audit.markdown_turns(df, "o", "seat"), f"file://{tmp_path}/md")
    text = "".join(p.read_text() for p in sorted((tmp_path / "md/file_name=s1.md").glob("part-*")))
    at = [text.index(f"**User:** q{i}\n") for i in range(200)]
    assert at == sorted(at)
    with open(tmp_path / "a.zip", "wb") as f:
        assert exports.zip_sessions(conversation_audit.markdown_sessions(df, "o", "seat"), f) is None
    assert (tmp_path / "a.zip").stat().st_size > 100


def test_an_agent_whose_last_request_lies_before_the_window_keeps_its_name(spark):
    seats = spark.createDataFrame([("s", "o", "Ann", "human", None), ("bot", "o", "Bot", "digital_employee", "s")], "seat_id string, org_id string, alias string, seat_type string, parent_seat_id string")
    raw = spark.createDataFrame([(1, "bot", "o", "acc", "me@x", dt.datetime(2024, 1, 1), "success", None)], "ods_id long, seat_id string, org_id string, account_id string, oauth_identity string, event_time timestamp, request_status string, route_source string")
    got = {r["seat_id"]: r for r in usage.agents_with_routes(fact(spark, [{}]), raw, seats, ME).collect()}
    assert (got["bot"]["alias"], got["bot"]["is_agent"], got["bot"]["parent_seat_id"], got["bot"]["tokens"], got["bot"]["requests"]) == ("Bot", True, "s", 0, 0)
    assert (got["s"]["tokens"], got["s"]["last_account"]) == (10, None)
    assert NOW.tzinfo


def test_every_sort_of_the_audit_list(spark):
    from decimal import Decimal

    rows = [
        {"model": "b", "provider_code": None, "total_tokens": 5, "billable_amount": None, "fallback_attempt": None, "quality_status": "x", "oauth_identity": "z"},
        {"model": None, "provider_code": "p", "total_tokens": 9, "billable_amount": Decimal("0"), "fallback_attempt": 2, "quality_status": None, "oauth_identity": None},
        {"model": "a", "provider_code": "q", "total_tokens": 7, "billable_amount": Decimal("3"), "fallback_attempt": 1, "quality_status": "y", "oauth_identity": "y", "event_time": dt.datetime(2025, 3, 2)},
    ]
    f = fact(spark, rows).withColumns({"alias": F.when(F.col("dwd_id") == 0, "zed"), "invited_email": F.lit(None).cast("string")})
    first = lambda sort, up: audit.audit_detail(f, sort, up, limit=1).first()["event_id"]
    down = {"time": "e2", "seat": "e0", "identity": "e0", "provider": "e2", "model": "e0", "tokens": "e1", "cost": "e2", "quality": "e2", "failover": "e1", "unknown": "e2"}
    assert {s: first(s, False) for s in down} == down
    assert {s: first(s, True) for s in ("model", "cost", "failover", "provider")} == {"model": "e1", "cost": "e0", "failover": "e0", "provider": "e0"}
    row = audit.export_columns(f).first()
    assert len(row) == 37 and list(row.asDict()) == audit.AUDIT_ROW
    assert row["fallback_attempt"] is None and row["virtual_key_hash"] == "" and row["source_seq"] is None
