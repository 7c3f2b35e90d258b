import random

from tallyforge.operators import sequences

S = "org string, src string, seq long, ingest_status string"


def frame(spark, rows):
    return spark.createDataFrame([(o, s, n, "accepted") for o, s, n in rows], S)


def brute(rows):
    have = {}
    for _, s, n in rows:
        if s is not None and n is not None and n >= 1:
            have.setdefault(s, set()).add(n)
    marks, lost = {}, set()
    for s, ns in have.items():
        c = 0
        while c + 1 in ns:
            c += 1
        marks[s] = (c, max(ns))
        lost |= {(s, n) for n in range(1, max(ns)) if n not in ns}
    return marks, lost


def check(spark, rows):
    got = sequences.received(frame(spark, rows), ["src"], "seq")
    marks, lost = brute(rows)
    assert {r["src"]: (r["contiguous_seq"], r["max_seen_seq"]) for r in sequences.contiguous(got, ["src"]).collect()} == marks
    assert {(r["src"], r["seq"]) for r in sequences.missing(got, ["src"]).collect()} == lost


def test_small_blocks_against_the_loop(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK", 8)
    rng = random.Random(1)
    rows = [("o", "full", n) for n in range(1, 25)] + [("o", "late", n) for n in range(3, 40)] + [("o", "one", 1), ("o", "far", 1), ("o", "far", 90)]
    for s in range(12):
        rows += [(rng.choice("op"), f"s{s}", n) for n in range(1, rng.randrange(2, 60)) if rng.random() < 0.95]
    check(spark, rows + rows[:20] + [("o", None, 3), ("o", "x", None), ("o", "x", 0), ("o", "x", -4), ("o", "eight", 8), *(("o", "eight", n) for n in range(1, 8))])


def test_golden_values(spark):
    rows = [("o", "a", n) for n in (1, 2, 3, 5)]
    r = sequences.completeness(frame(spark, rows), ["org", "src"], "seq").first()
    assert (r["contiguous_seq"], r["max_seen_seq"], r["missing"]) == (3, 5, 1)
    one = frame(spark, [("o1", "a", n) for n in (1, 3, 5)] + [("o2", "a", n) for n in (2, 4, 6)])
    r = sequences.contiguous(sequences.received(one, ["src"], "seq"), ["src"]).first()
    assert (r["contiguous_seq"], r["max_seen_seq"]) == (6, 6)


def test_ledger_and_late_arrivals(spark):
    df = frame(spark, [("o", "a", n) for n in (1, 2, 4, 7)])
    ledger = spark.createDataFrame([("a", 3), ("a", 4), ("a", 5)], "src string, seq long")
    seqs = sequences.received(df, ["src"], "seq", ledger)
    assert sequences.contiguous(seqs, ["src"]).first()["contiguous_seq"] == 5
    assert [r["lost"] for r in sequences.known_losses(df, ledger, ["src"], "seq").collect()] == [2]


def test_watermarks_only_grow(spark):
    stored = spark.createDataFrame([("a", 5, 9), ("b", 2, 2)], "src string, contiguous_seq long, max_seen_seq long")
    batch = spark.createDataFrame([("a", 3, 11), ("c", 1, 1)], "src string, contiguous_seq long, max_seen_seq long")
    floors = spark.createDataFrame([("b", 7), ("d", 4)], "src string, floor_seq long")
    got = {r["src"]: (r["contiguous_seq"], r["max_seen_seq"]) for r in sequences.advance(stored, batch, ["src"], floors).collect()}
    assert got == {"a": (5, 11), "b": (7, 2), "c": (1, 1), "d": (4, 0)}


def test_empty(spark):
    check(spark, [])
    assert sequences.completeness(frame(spark, []), ["org", "src"], "seq").count() == 0
