import random
from collections import Counter

import pytest

from tallyforge.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def sized(spark, rows, parts=6):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long").repartition(parts)


def made(seed=1):
    rng = random.Random(seed)
    rows = [(i, "big" if rng.random() < 0.6 else "mid", rng.randrange(50, 900)) for i in range(3000)]
    return rows + [(10_000 + i, "small", rng.randrange(100, 300)) for i in range(60)] + [(20_000, "other", 5), (20_001, None, 5)]


def shares(spark, rows, targets, **kw):
    t = spark.createDataFrame(targets, TARGETS)
    mixed = mixing.mixture(sized(spark, rows), t, "doc_id", "source", **kw)
    return mixed.collect(), {r["source"]: r for r in mixing.shares_reached(mixed, t, "source").collect()}


def test_shares_limits_and_report(spark):
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("none", 0.1, 3)]
    mixed, got = shares(spark, made(), targets)
    assert len(mixed) == len({r["doc_id"] for r in mixed}) and {r["source"] for r in mixed} == {"big", "mid", "small"}
    limits = {s: m for s, _, m in targets}
    assert all(1 <= r["copies"] <= limits[r["source"]] for r in mixed)
    for s, share, _ in targets[:3]:
        assert got[s]["share"] == pytest.approx(share / 0.9, rel=0.02)
    assert (got["none"]["tokens"], got["none"]["share"]) == (0, 0.0)
    assert sum(r["tokens"] * r["copies"] for r in mixed) == sum(r["tokens"] for r in got.values())


def test_number_of_copies_is_the_rate_up_to_one(spark):
    rows = [(i, "a", 10) for i in range(1000)] + [(2000 + i, "b", 10) for i in range(1000)]
    mixed, _ = shares(spark, rows, [("a", 0.5, 3), ("b", 0.5, 3)], size=13_333)
    n = Counter()
    for r in mixed:
        n[r["source"]] += r["copies"]
    assert abs(n["a"] - 666.65) < 1 and abs(n["b"] - 666.65) < 1


def test_every_document_has_the_same_chance():
    hits = Counter()
    for seed in range(3000):
        settled, left = mixing._pivot(list(range(8)), [0.3] * 8, seed)
        up = [i for i, x in settled if x == 1.0]
        assert abs(len(up) + (left[1] if left else 0) - 2.4) < 1e-9
        hits.update(up)
        if left and mixing._uniform(seed, "last", left[0]) < left[1]:
            hits[left[0]] += 1
    assert all(abs(n / 3000 - 0.3) < 0.035 for n in hits.values())


def test_limits_bind_when_more_is_asked(spark):
    mixed, got = shares(spark, [(1, "a", 100), (2, "b", 100)], [("a", 0.9, 2), ("b", 0.1, 5)], size=1_000_000)
    assert {r["doc_id"]: r["copies"] for r in mixed} == {1: 2, 2: 5} and got["a"]["share"] == pytest.approx(2 / 7)


def test_edges(spark):
    assert shares(spark, [], [("a", 1.0, 1)])[0] == []
    assert shares(spark, [(1, "a", 0), (2, None, 4)], [("a", 1.0, 1)])[0] == []
    assert shares(spark, [(1, "a", 7)], [("a", 1.0, 1)])[0][0]["copies"] == 1


def test_tokens_of_whole_texts(spark):
    pytest.importorskip("tiktoken")
    rows = [(1, "a", "one two three", 0), (2, "a", None, 0), (3, None, "", 0), (4, "a", "word " * 20_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    got = {r["doc_id"]: r["tokens"] for r in mixing.count_tokens(df, "doc_id", "source").collect()}
    assert (got[1], got[2], got[3]) == (3, 0, 0) and got[4] >= 20_000


def test_any_partitioning_gives_the_same_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_LEAF", 40)  # 70 leaves and more: two levels above them
    rows, t = made(3), spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 2), ("small", 0.1, 4)], TARGETS)
    got = [sorted(mixing.mixture(sized(spark, rows[::k], parts), t, "doc_id", "source").collect()) for k, parts in ((1, 1), (-1, 7), (1, 23))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 500
    n = Counter()
    for r in got[0]:
        n[r["source"]] += r["copies"]
    rate = {r["source"]: r["rate"] for r in mixing.rates(sized(spark, rows), t, "source").collect()}
    have = Counter(r[1] for r in rows)
    assert all(abs(n[s] - rate[s] * have[s]) < 1.01 for s in rate)


def test_records_repeat_whole_documents(spark):
    docs = spark.createDataFrame([(1, "one", "x", 9), (2, "two", "y", 9), (3, None, "z", 9)], "doc_id long, text string, source string, copies int")
    mixed = spark.createDataFrame([(1, "a", 5, 2), (3, "b", 7, 1)], "doc_id long, source string, tokens long, copies int")
    got = {(r["doc_id"], r["copy"], r["text"], r["source"], r["tokens"]) for r in mixing.records(docs, mixed, "doc_id").collect()}
    assert got == {(1, 1, "one", "a", 5), (1, 2, "one", "a", 5), (3, 1, None, "b", 7)}
