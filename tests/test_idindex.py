import datetime as dt
import json
import random

import numpy as np
from pyspark.sql import functions as F

from tallyforge.operators import idindex
from tallyforge.runtime import normal_id
from tallyforge.streaming.pipeline import DedupStream

SCHEMA = "ods_id long, org_id string, event_id string, at timestamp, hi long, prefix int"
T = dt.datetime(2025, 2, 1)


def parts():
    return [normal_id("org_id"), normal_id("event_id")]


def made(seed, n=500):
    rng = random.Random(seed)
    ids = ["hot"] * 200 + [f"e{i}" for i in range(150)]
    spell = [str, str.upper, lambda s: f"  {s} ", lambda s: f"\t{s}\xa0"]
    return [(i, rng.choice(["o1", "o2", "O1"]), rng.choice(spell)(rng.choice(ids)), T + dt.timedelta(minutes=rng.randrange(60)), 1, 2) for i in range(n)]


def clean(s):
    return s.strip(" \t\xa0").lower()


def brute(rows):
    best, alone = {}, set()
    for r in rows:
        if r[1] is None or r[2] is None:
            alone.add(r[0])
            continue
        key = (clean(r[1]), clean(r[2]))
        rank = (r[3] is None, r[3] or T, r[0])
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r[0])
    return {v[1] for v in best.values()} | alone


def kept(spark, rows, **kw):
    got = [r["ods_id"] for r in idindex.kept_deliveries(spark.createDataFrame(rows, SCHEMA), parts(), "ods_id", "at", **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force_in_any_number_of_batches(spark):
    rows = made(1)
    for batches in (1, 3, 6):
        assert kept(spark, rows, batches=batches) == brute(rows)


def test_edges(spark):
    assert kept(spark, []) == set()
    rows = [(1, None, "a", T, 1, 1), (2, "o", None, T, 1, 1), (3, None, "a", T, 1, 1), (4, "o", "", T, 1, 1), (5, "o", " ", T, 1, 1), (6, "o", "x", None, 1, 1), (7, "o", "X", T, 1, 1)]
    assert kept(spark, rows) == brute(rows) == {1, 2, 3, 4, 7}
    same = [(i, "o", "x", T, 1, 1) for i in range(50)]
    assert kept(spark, same) == {0}


def test_runs_are_searched_and_merged(spark, tmp_path):
    rows = made(2)
    index = idindex.IdentifierIndex(spark, f"file://{tmp_path}", 4)
    for n in range(5):
        part = spark.createDataFrame(rows[n * 100 : n * 100 + 100], SCHEMA)
        index.add(part, parts(), "ods_id", ["at"], merge_every=2)
    _, live = index.runs()
    assert len(live) <= 2
    got = {r["ods_id"] for r in index.kept_rows(live, "ods_id").collect()}
    first = {}
    for n in range(5):  # what an earlier batch has keeps its place
        for r in sorted(rows[n * 100 : n * 100 + 100], key=lambda r: (r[3], r[0])):
            first.setdefault((clean(r[1]), clean(r[2])), (n, r[0]))
    assert got == {v[1] for v in first.values()}


def test_ties_of_the_high_half():
    run = (np.array([1, 5, 5, 5, 9]), np.array([0, 1, 2, 7, 0]))
    hi, lo = np.array([5, 5, 5, 9, 4]), np.array([7, 3, 1, 0, 0])
    assert idindex._contains(run, hi, lo).tolist() == [True, False, True, True, False]
    assert not idindex._contains((np.array([], int), np.array([], int)), hi, lo).any()


def test_stream_over_any_horizon_and_repeated_batches(spark, tmp_path):
    stream = DedupStream(spark, f"file://{tmp_path}", "ods_id", "at", expected=1000)
    rows = made(3, 120)
    late = [(1000 + i, *rows[i][1:3], T + dt.timedelta(days=400), 1, 2) for i in range(40)]
    stream.process(spark.createDataFrame(rows, SCHEMA), 0)
    stream.process(spark.createDataFrame(late, SCHEMA), 1)
    stream.process(spark.createDataFrame(late, SCHEMA), 1)
    assert {r["ods_id"] for r in stream.kept().collect()} == brute(rows)


def test_repeated_batches_after_a_merge(spark, tmp_path):
    stream = DedupStream(spark, f"file://{tmp_path}", "ods_id", "at", expected=1000)
    rows = [(i, "o", f"e{i}", T, 1, 2) for i in range(40)]
    batch = lambda n: spark.createDataFrame(rows[n * 4 : n * 4 + 4], SCHEMA)
    for n in range(9):
        stream.process(batch(n), n)
    assert stream.index.runs()[1] == ["merged-00000009"]
    for n in (8, 3):  # the one that triggered the merge and an older one
        stream.process(batch(n), n)
    stream.process(batch(9), 9)
    assert sorted(r["ods_id"] for r in stream.kept().collect()) == list(range(40))


def test_batch_ids_of_manifests_that_do_not_name_them(spark, tmp_path):
    index = idindex.IdentifierIndex(spark, f"file://{tmp_path}", 4)
    df = spark.createDataFrame(made(5, 40), SCHEMA)
    for n in range(3):
        index.add(df.filter(F.col("ods_id") % 3 == n), parts(), "ods_id", ["at"], merge_every=2, batch_id=n)
    for path in (tmp_path / "manifest").glob("*.json"):
        found = json.loads(path.read_text())
        (tmp_path / "manifest" / f".{path.name}.crc").unlink(missing_ok=True)
        path.write_text(json.dumps({k: found[k] for k in ("version", "runs")}))
    before = index.runs()
    assert index.add(df, parts(), "ods_id", ["at"], batch_id=2) == "run-00000002" and index.runs() == before


def test_stream_and_batch_keep_the_same_rows_where_identifiers_are_null(spark, tmp_path):
    rng = random.Random(6)
    some = lambda p, x: None if rng.random() < p else x
    rows = [(i, some(0.2, "o1"), some(0.3, f"e{i % 11}"), T + dt.timedelta(minutes=i), 1, 2) for i in range(90)]
    stream = DedupStream(spark, f"file://{tmp_path}", "ods_id", "at", expected=1000)
    for n in (0, 1, 1, 2):
        stream.process(spark.createDataFrame(rows[n * 30 : n * 30 + 30], SCHEMA), n)
    got = [r["ods_id"] for r in stream.kept().collect()]
    assert len(got) == len(set(got)) and set(got) == kept(spark, rows) == brute(rows)


def test_structured_streaming_end_to_end(spark, tmp_path):
    rows = made(4, 100)
    df = spark.createDataFrame(rows, SCHEMA)
    source = str(tmp_path / "landing")
    df.filter("ods_id < 60").coalesce(1).write.parquet(source)
    stream = DedupStream(spark, f"file://{tmp_path}/state", "ods_id", "at", expected=1000)
    read = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    stream.start(read()).awaitTermination()
    df.filter("ods_id >= 40").coalesce(1).write.mode("append").parquet(source)
    stream.start(read()).awaitTermination()
    got = stream.kept().agg(F.count("*"), F.count_distinct("org_id", "event_id")).first()
    want = {(clean(r[1]), clean(r[2])) for r in rows}
    assert got[0] == len(want)


def test_every_batch_repeated_after_merges_and_failures_between_writing_and_publishing(spark, tmp_path, monkeypatch):
    stream = DedupStream(spark, f"file://{tmp_path}", "ods_id", "at", expected=1000)
    rows = [(i, "o", f"e{i % 33}", T + dt.timedelta(minutes=i), 1, 2) for i in range(44)]
    batch = lambda n: spark.createDataFrame(rows[n * 4 : n * 4 + 4], SCHEMA)
    publish = idindex.IdentifierIndex._publish

    def fails(*_):
        raise OSError("lost")

    for n in range(11):
        monkeypatch.setattr(idindex.IdentifierIndex, "_publish", fails)
        try:
            stream.process(batch(n), n)
        except OSError:
            pass
        monkeypatch.setattr(idindex.IdentifierIndex, "_publish", publish)
        stream.process(batch(n), n)
    for n in range(11):
        stream.process(batch(n), n)
    assert sorted(r["ods_id"] for r in stream.kept().collect()) == list(range(33))
    names = {p.name for p in (tmp_path / "index").iterdir()}
    assert not {"run-00000000", "run-00000003"} & names  # merged long ago
    assert set(stream.index.runs()[1]) <= names and len(list((tmp_path / "index/manifest").glob("*.json"))) == idindex._KEPT_MANIFESTS


def test_broadcast_and_cogroup_find_the_same(spark, monkeypatch):
    rows = made(7)
    want = brute(rows)
    for limit in (0, 50, 10_000):
        monkeypatch.setattr(idindex, "BROADCAST_IDS", limit)
        assert kept(spark, rows, batches=4) == want


def test_a_small_batch_shuffles_none_of_the_index(spark, tmp_path):
    index = idindex.IdentifierIndex(spark, f"file://{tmp_path}", 4)
    index.add(spark.createDataFrame(made(8, 400), SCHEMA), parts(), "ods_id", ["at"])
    ids = spark.createDataFrame([(5, 5), (-7, 1)], "hi long, lo long")
    plan = index._known(ids, 2, index.runs()[1], index._manifest())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters: [In(prefix" in plan


def test_prefixes_are_split_when_the_index_outgrows_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idindex, "_IDS_PER_PREFIX", 1)
    index = idindex.IdentifierIndex(spark, f"file://{tmp_path}", 1)
    rows = [(i, "o", f"e{i}", T, 1, 2) for i in range(120)]
    for limit in (0, 10_000):
        monkeypatch.setattr(idindex, "BROADCAST_IDS", limit)
        for n in range(6):
            index.add(spark.createDataFrame(rows[n * 20 : n * 20 + 20], SCHEMA), parts(), "ods_id", ["at"], merge_every=2)
    found = index._manifest()
    assert max(found["bits"].values()) > 4
    assert sorted(r["ods_id"] for r in index.kept_rows(found["runs"], "ods_id").collect()) == list(range(120))


def test_older_larger_runs_are_left_alone(spark, tmp_path):
    index = idindex.IdentifierIndex(spark, f"file://{tmp_path}", 4)
    rows = [(i, "o", f"e{i}", T, 1, 2) for i in range(20_060)]
    index.add(spark.createDataFrame(rows[:20_000], SCHEMA), parts(), "ods_id", ["at"], merge_every=2)
    for n in range(3):
        index.add(spark.createDataFrame(rows[20_000 + n * 20 : 20_020 + n * 20], SCHEMA), parts(), "ods_id", ["at"], merge_every=2)
    assert index.runs()[1][0] == "run-00000000"
    assert index.kept_rows(index.runs()[1], "ods_id").count() == 20_060
