import datetime as dt
import random

from tallyforge.llm import conversations

KEYS = ["org_id", "session_id", "owner_account_id"]
SCHEMA = "event_id string, org_id string, session_id string, owner_account_id string, created_at timestamp, user_text string, assistant_text string, system_text string, role string, place int"
T = dt.datetime(2025, 3, 1)


def brute(rows):
    whole = {}
    for e, o, s, w, t, u, a, *_ in rows:
        if not s:
            continue
        turns = whole.setdefault((o, s, w), set())
        for role, text in (("user", u), ("assistant", a)):
            if text is not None and text.strip(" \t\n​　\xa0"):
                turns.add((t is not None, t or T, e is not None, e or "", role != "user", text))
    valid = {}
    for k, turns in whole.items():
        r = [x[4] for x in sorted(turns)]
        valid[k] = bool(r) and len(r) % 2 == 0 and all(x == bool(i % 2) for i, x in enumerate(r))
    return whole, valid


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    turns, found = conversations.rebuild(df, KEYS, "event_id", "created_at")
    whole, valid = brute(rows)
    assert {tuple(r[k] for k in KEYS): r["valid"] for r in found.collect()} == valid
    got = {}
    for r in turns.collect():
        got.setdefault(tuple(r[k] for k in KEYS), {})[r["turn"]] = (r["role"], r["text"])
    assert set(got) == {k for k, v in valid.items() if v}
    for k, t in got.items():
        assert [t[i] for i in range(len(t))] == [("assistant" if x[4] else "user", x[5]) for x in sorted(whole[k])]
    _, fast = conversations.rebuild(df, KEYS, "event_id", "created_at", texts=False)
    assert {tuple(r[k] for k in KEYS): r["valid"] for r in fast.collect()} == valid


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        keys = (rng.choice(["o", None]), rng.choice([f"s{c}", "hot", "", None]), rng.choice(["w", None]))
        for n in range(rng.randrange(1, 8)):
            t = T + dt.timedelta(minutes=c * 1000 + n)
            ask = (f"e{c}-{n}", *keys, t, f"q{n}", rng.choice([None, ""]), None, "x", 1)
            reply = (f"e{c}-{n}", *keys, t + rng.choice([dt.timedelta(0), dt.timedelta(seconds=9)]), rng.choice([None, ""]), f"a{n}", None, "x", 1)
            rows += [ask, reply] if rng.random() < 0.93 else [rng.choice([ask, reply])]
            if rng.random() < 0.2:
                rows.append(rng.choice([ask, reply]))
        rows.append((f"z{c}", *keys, None, None, None, "system", "x", 1))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    check(spark, made(1))
    check(spark, made(2))


def test_edges(spark):
    check(spark, [])
    check(spark, [("e", "o", "s", "w", T, "​ 　", "\xa0", None, "", 1)])
    check(spark, [("e", "o", "s", "w", T, "both", "filled", None, "", 1)])
    check(spark, [("e", "o", "s", "w", None, "q", None, None, "", 1), ("e", "o", "s", "w", T, None, "a " * 50_000, None, "", 1)])
    check(spark, [(None, "o", "s", None, T, "q", None, None, "", 1), (None, "o", "s", None, T, "r", None, None, "", 1)])


def test_a_conversation_over_many_tasks(spark):
    n = 400
    rows = [(f"e{i:04}", "o", "hot", "w", T + dt.timedelta(seconds=i), f"q{i}" if i % 2 == 0 else None, f"a{i}" if i % 2 else None, None, "", 1) for i in range(n)]
    check(spark, rows)
    check(spark, rows[:200] + rows[201:])


def test_folding_by_version(spark):
    log = spark.createDataFrame([("t1", 1, "old", False), ("t1", 2, "new", False), ("t1", 2, "new", False), ("t2", 1, "x", False), ("t2", 2, "x", True), ("t3", 5, "y", None)], "turn string, v int, text string, gone boolean")
    from pyspark.sql import functions as F

    got = conversations.fold_turns(log.select("turn", "v", "text", F.col("gone").alias("removed")), ["turn"], [F.col("v")], F.col("removed"))
    assert {(r["turn"], r["text"]) for r in got.collect()} == {("t1", "new"), ("t3", "y")}


def test_rebuilding_with_retries_edits_and_deletes(spark):
    keys = ("o", "s1", "w")
    late = lambda n: T + dt.timedelta(minutes=n)
    rows = [
        ("a", *keys, late(0), "old question", None, 1, False), ("a", *keys, late(0), "new question", None, 2, False), ("a", *keys, late(0), "new question", None, 2, False),
        ("b", *keys, late(1), None, "answer", 3, None), ("b", *keys, late(1), None, "answer", None, None),
        ("c", *keys, late(2), "taken back", None, 4, False), ("c", *keys, late(2), "taken back", None, 5, True),
        ("d", *keys, late(3), "emptied", None, 6, False), ("d", *keys, late(3), None, " ", 7, False),
        ("e", "o", "s2", "w", late(0), "no reply", None, 1, False),
    ]
    df = spark.createDataFrame(rows, "event_id string, org_id string, session_id string, owner_account_id string, created_at timestamp, user_text string, assistant_text string, v long, gone boolean")
    for texts in (True, False):
        turns, found = conversations.rebuild(df, KEYS, "event_id", "created_at", texts, version=["v"], deleted="gone", edits=True)
        assert {(r["session_id"], r["turns"], r["valid"]) for r in found.collect()} == {("s1", 2, True), ("s2", 1, False)}
        if texts:
            assert [(r["turn"], r["role"], r["text"]) for r in turns.orderBy("turn").collect()] == [(0, "user", "new question"), (1, "assistant", "answer")]
    _, found = conversations.rebuild(df, KEYS, "event_id", "created_at", version=["v"])
    assert {(r["session_id"], r["turns"]) for r in found.collect()} == {("s1", 5), ("s2", 1)}
