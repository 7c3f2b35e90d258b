import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import conversation_ingest, health, integrity, sequences
from tallyforge.params import scope_all
from tallyforge.sources import retention

NOW = dt.datetime(2025, 3, 10, 12)
MARKS = "org string, src string, contiguous_seq long, max_seen_seq long, client_allocated_seq long, updated_at timestamp, last_event_at timestamp"
KEYS = ["org", "src"]
M, H = dt.timedelta(minutes=1), dt.timedelta(hours=1)


def marks(spark, rows):
    ago = lambda d: None if d is None else NOW - d
    return spark.createDataFrame([("o", s, c, m, a, ago(u), ago(e)) for s, c, m, a, u, e in rows], MARKS)


def test_states_in_order_of_severity(spark):
    rows = [
        ("middle", 3, 5, 8, 11 * M, 0 * M), ("young", 3, 5, 8, 9 * M, 0 * M), ("tail", 3, 3, 8, 11 * M, 0 * M), ("silent", 8, 8, 8, 0 * M, 25 * H), ("ok", 8, 8, 8, 30 * H, 23 * H),
        ("unknown", 1, 9, 9, None, None), ("tail and silent", 3, 3, 8, 30 * H, 30 * H), ("floor", 9, 5, 8, 30 * H, 0 * M), ("exactly", 3, 5, 5, 10 * M, 24 * H),
    ]
    got = {r["src"]: (r["status"], r["tail_pending"], r["promotable"]) for r in integrity.classify(marks(spark, rows), NOW).collect()}
    assert got == {
        "middle": ("middle_gap", 3, False), "young": ("ok", 3, False), "tail": ("tail_gap", 5, False), "silent": ("silent", 0, False), "ok": ("ok", 0, False), "unknown": ("ok", 0, False),
        "tail and silent": ("tail_gap", 5, True), "floor": ("ok", 0, False), "exactly": ("ok", 0, False),
    }


def frames(spark):
    events = [("o", "a", n, "accepted") for n in (1, 2, 3, 5)] + [("o", "b", n, "quarantined") for n in (1, 2)]
    df = spark.createDataFrame(events, "org string, src string, source_seq long, ingest_status string")
    ledger = spark.createDataFrame([("o", "a", 7, "x"), ("o", "a", 5, "x")], "org string, src string, seq long, reason string")
    return df, ledger, marks(spark, [("a", 3, 8, 9, 30 * H, 0 * M), ("b", 2, 2, 4, 30 * H, 0 * M)])


def test_gaps_losses_and_the_rollup(spark):
    df, ledger, m = frames(spark)
    out = integrity.source_completeness(df, ledger, m, KEYS, NOW)
    assert {r["src"]: (r["status"], r["gap_count"], r["known_loss"], r["quarantined"]) for r in out.collect()} == {"a": ("middle_gap", 3, 1, 0), "b": ("tail_gap", 0, 0, 2)}
    assert tuple(integrity.rollup(out).first()) == (2, 2, 2, False)
    assert tuple(integrity.rollup(out.limit(0)).first()) == (0, 0, 0, True)
    accounted = sequences.received(df, KEYS, "source_seq", ledger.select(*KEYS, "seq"))
    promoted = integrity.promote_losses(integrity.classify(m, NOW), accounted, KEYS)
    want = {("a", n, "stale_middle_gap") for n in (4, 6, 8, 9)} | {("b", n, "stale_tail_gap") for n in (3, 4)}
    assert {(r["src"], r["seq"], r["reason"]) for r in promoted.collect()} == want
    grown = integrity.append_ledger(ledger, promoted, KEYS)
    assert grown.count() == 8 and integrity.append_ledger(grown, promoted, KEYS).count() == 8
    after = sequences.contiguous(sequences.received(df, KEYS, "source_seq", grown.select(*KEYS, "seq")), KEYS)
    assert {r["src"]: r["contiguous_seq"] for r in after.collect()} == {"a": 9, "b": 4}
    claims = spark.createDataFrame([("o", "a", n) for n in (-1, 0, 3, 4, 5, 6, 7, 9, 10, 4)] + [("o", "c", 1)], "org string, src string, seq long")
    assert {r["seq"] for r in integrity.confirm_losses(m, accounted, claims, KEYS).collect()} == {4, 6, 9}
    listed = integrity.gap_listing(m, accounted, KEYS, 3)
    assert {(r["src"], r["seq"], r["truncated"]) for r in listed.collect()} == {("a", 4, True), ("a", 6, True), ("b", 3, False), ("b", 4, False)}


def test_floors_only_rise(spark):
    m = marks(spark, [("a", 3, 8, 9, None, None)])
    floors = lambda *rows: spark.createDataFrame([("o", s, n) for s, n in rows], "org string, src string, floor_seq long")
    once = integrity.apply_floors(m, floors(("a", 5), ("b", 7), ("c", 0)), KEYS)
    twice = integrity.apply_floors(once, floors(("a", 4), ("b", 7)), KEYS)
    for out in (once, twice):
        assert {r["src"]: (r["contiguous_seq"], r["max_seen_seq"], r["stream_floor_seq"]) for r in out.collect()} == {"a": (5, 8, 5), "b": (7, 0, 7)}


def test_empty(spark):
    df, ledger, m = frames(spark)
    nothing = integrity.source_completeness(df.limit(0), ledger.limit(0), m.limit(0), KEYS, NOW)
    assert nothing.count() == 0
    assert integrity.unaccounted(m.limit(0), sequences.received(df, KEYS), KEYS).count() == 0
    assert {(r["src"], r["first_seq"], r["last_seq"]) for r in integrity.unaccounted(m, sequences.received(df.limit(0), KEYS), KEYS).collect()} == {("a", 4, 9), ("b", 3, 4)}


TURNS = "arrival long, event_id string, org_id string, source_id string, source_seq long, created_at timestamp, request_status string"


def test_conversation_dispositions(spark):
    rows = [
        (1, "e1", "o", "s", 1, NOW, "ok"), (2, "e1", "o", "s", 1, NOW, "ok"), (3, "e2", "o", "s", 1, NOW, "ok"), (4, "e3", "p", "s", 1, NOW, "ok"), (5, "e1", "o", "s", 2, NOW + dt.timedelta(days=1), "ok"),
        (6, "", "o", "s", 3, NOW, "ok"), (7, "e4", None, "s", 3, NOW, "ok"), (8, "e5", "o", "s", 3, None, "ok"), (9, "e6", "o", "s", 3, NOW, ""), (10, "e7", "o", "", 1, NOW, "ok"), (11, "e8", "o", "s", None, NOW, "ok"),
        (12, "e9", "o", "s", 9, NOW, "ok"),
    ]
    df = spark.createDataFrame(rows, TURNS)
    stored = spark.createDataFrame([("e9", "o", "s", 2, NOW.date())], "event_id string, org_id string, source_id string, source_seq long, conv_date date")
    got = conversation_ingest.dispositions(df, "arrival")
    fates = {r["arrival"]: r["disposition"] for r in got.collect()}
    want = dict.fromkeys((1, 4, 5, 10, 11, 12), "accepted") | {2: "duplicated", 3: "quarantined"} | dict.fromkeys((6, 7, 8, 9), "rejected")
    assert fates == want
    assert {r["reject_reason"] for r in got.filter("disposition = 'rejected'").collect()} == {f"{c} is required" for c in conversation_ingest.REQUIRED}
    again = {r["arrival"]: r["disposition"] for r in conversation_ingest.dispositions(df, "arrival", stored).collect()}
    assert again == want | {12: "duplicated", 5: "quarantined"}
    assert conversation_ingest.to_store(got).filter("ingest_status = 'quarantined'").count() == 1
    pinned = {r["arrival"]: r["disposition"] for r in conversation_ingest.dispositions(df, "arrival", pinned_org="only").collect()}
    assert (pinned[4], pinned[7]) == ("quarantined", "accepted")


def test_health_and_canaries(spark):
    columns = "event_id string, org_id string, ingest_received_at timestamp, dwd_status string"
    c = health.CANARY
    rows = [("canary-1", c, NOW - 20 * M, "projected"), ("canary-2", c, NOW - 5 * M, "pending"), ("e", "o", NOW, "projected")]
    fact = spark.createDataFrame([("o", NOW - H)], "org_id string, projected_at timestamp")

    def judged(rows, now=NOW):
        status, stage = health.verdict(now)
        r = health.watermarks(spark.createDataFrame(rows, columns), fact).select(status.alias("a"), stage.alias("b")).first()
        return tuple(r)

    assert judged(rows) == ("degraded", "projector")
    assert judged(rows, NOW - 10 * M) == ("healthy", None)
    assert judged(rows, NOW + H) == ("degraded", "collector")
    assert judged(rows[2:]) == ("healthy", None) and judged([]) == ("healthy", None)
    ods = spark.createDataFrame(rows, columns)
    assert [tuple(health.canary_check(ods, f"canary-{n}").first()) for n in (1, 2, 3)] == [(True, True), (True, False), (False, False)]
    with pytest.raises(ValueError):
        health.canary_check(ods, "e")


def test_retries_and_pending_work(spark):
    counts = spark.createDataFrame([(n,) for n in (1, 3, 4, 10, 11, 19, 20)], "n int")
    status, at = health.retry_state(F.col("n"), NOW)
    got = [(r["s"], r["t"] and r["t"] - NOW) for r in counts.select("n", status.alias("s"), at.alias("t")).orderBy("n").collect()]
    assert got == [("retry", M), ("retry", M), ("retry", 10 * M), ("retry", 10 * M), ("retry", H), ("retry", H), ("dead_letter", None)]
    state = spark.createDataFrame([(3, "pending", None), (1, "retry", NOW), (2, "retry", NOW + M), (4, "done", None)], "ods_id long, status string, next_retry_at timestamp")
    assert [r["ods_id"] for r in health.pending(state, NOW).collect()] == [1, 3] and health.pending(state, NOW, 1).count() == 1


def test_retention_deletes_whole_months(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    days = [dt.date(2024, 2, 29), dt.date(2024, 3, 1), dt.date(2025, 3, 9), None]
    retention.write_by_day(spark.createDataFrame([(i, d) for i, d in enumerate(days)], "n long, day date"), path, "day")
    plan = spark.read.parquet(path).filter("day = date'2025-03-09'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert retention.drop_months(spark, path, "day", NOW.date(), 12) == ["day=2024-02-29"]
    assert spark.read.parquet(path).count() == 3
    assert retention.cutoff(dt.date(2025, 1, 31), 1) == dt.date(2024, 12, 1)
    with pytest.raises(ValueError):
        retention.drop_months(spark, path, "day", NOW.date(), 0)


def test_everyone_only_where_the_deployment_is_local():
    assert [scope_all(a, s) for a in (True, False) for s in ("all", "", "mine")] == [True, False, False, False, False, False]
