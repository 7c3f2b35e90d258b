import datetime as dt
import random

from pyspark.sql import functions as F

from tallyforge.operators import asof
from tallyforge.operators.asof import Attribute, HistoryStore, attributes_asof, match

EVENTS = "id long, k string, t timestamp, name string, salts int, level int"
VERSIONS = "vk string, version string, rev string, a timestamp, b timestamp, known timestamp, name string, k string"
T = dt.datetime(2025, 1, 1)
H = dt.timedelta(hours=1)


def brute(events, versions):
    out = {}
    for i, k, t, *_ in events:
        fit = [v for v in versions if k is not None and t is not None and v[0] == k and v[3] is not None and v[5] is not None and v[3] <= t and v[5] <= t and (v[4] is None or t < v[4])]
        best = max(fit, key=lambda v: (v[3], int(v[2])), default=None)
        out.setdefault((i, best[1] if best else None, best[6] if best else None), 0)
        out[i, best[1] if best else None, best[6] if best else None] += 1
    return out


def run(spark, events, versions, **kw):
    e = spark.createDataFrame(events, EVENTS)
    v = spark.createDataFrame(versions, VERSIONS)
    number = F.col("rev").cast("long")
    got = attributes_asof(
        e, v.drop("k").withColumnRenamed("vk", "k"), key="k", event_time="t", effective_from="a", effective_to="b", recorded_at="known",
        priority=[F.col("a"), number], attributes={"version": F.col("version"), "name": F.col("name")}, row_id="id", **kw,
    )
    assert set(got.columns) == {"id", "k", "t", "version", "name", "salts", "level"}
    out = {}
    for r in got.collect():
        key = (r["id"], r["version"], r["name"])
        out[key] = out.get(key, 0) + 1
    return out


def made(seed, keys=("hot", "hot", "b", "c"), n=60, m=300):
    rng = random.Random(seed)
    versions = []
    for i in range(n):
        a = T + rng.randrange(400) * H
        b = rng.choice([None, a + rng.randrange(1, 200) * H, a])
        versions.append((rng.choice(keys), f"v{i}", str(i), a, b, a + rng.randrange(-50, 100) * H, rng.choice(["x", "y", None]), "clash"))
    versions += versions[:5]
    events = [(i, rng.choice([*keys, "unknown", None]), T + rng.randrange(600) * H / 2, "own", 1, 2) for i in range(m)]
    return events, versions


def test_random_against_brute_force(spark):
    for seed in (1, 2):
        events, versions = made(seed)
        assert run(spark, events, versions) == brute(events, versions)


def test_hot_keys_are_salted(spark):
    events, versions = made(3)
    assert run(spark, events, versions, rows_per_task=10, bucket_days=3) == brute(events, versions)


def test_edges(spark):
    events, versions = made(4)
    assert run(spark, [], versions) == {}
    assert run(spark, events, []) == brute(events, [])
    nulls = [("b", "n1", "1", None, None, T, "x", ""), ("b", "n2", "2", T, None, None, "x", ""), (None, "n3", "3", T, None, T, "x", "")]
    assert run(spark, events, nulls) == brute(events, nulls)
    odd = [*events[:3], events[0], (999, "b", None, "", 1, 1)]
    assert run(spark, odd, versions) == brute(odd, versions)
    assert run(spark, [(1, None, None, "", 1, 1)], versions) == {(1, None, None): 1}


def test_attributes_with_logs_of_their_own_updated_asynchronously(spark, tmp_path):
    rng = random.Random(9)
    store = HistoryStore(spark, f"file://{tmp_path}/logs")
    logs = {"tier": [], "price": []}
    for n in range(6):
        name = rng.choice(["tier", "price"]) if n > 1 else ["tier", "price"][n]
        rows = []
        for i in range(20):
            a = T + rng.randrange(300) * H
            value = rng.choice(["x", "y"]) if name == "tier" else rng.randrange(5)
            rows.append((rng.choice("abc"), a, rng.choice([None, a + rng.randrange(1, 90) * H]), a + rng.randrange(-20, 40) * H, len(logs[name]) + i, value))
        logs[name] += rows
        df = spark.createDataFrame(rows, f"k string, a timestamp, b timestamp, r timestamp, v long, value {'string' if name == 'tier' else 'long'}")
        for _ in range(2):  # a repeated batch replaces itself
            store.append(name, n, Attribute(df, "k", "a", "b", "r", [F.col("a"), F.col("v")], F.col("value")))
    events = [(i, rng.choice("abcd"), T + rng.randrange(400) * H) for i in range(200)]
    e = spark.createDataFrame(events, "id long, k string, t timestamp")
    got = {r["id"]: (r["tier"], r["price"]) for r in match(e, {n: store.log(n) for n in logs}, key="k", event_time="t", row_id="id", bucket_days=2).collect()}

    def holds(name, k, t):
        fit = [r for r in logs[name] if r[0] == k and r[1] <= t and r[3] <= t and (r[2] is None or t < r[2])]
        return max(fit, key=lambda r: (r[1], r[4]))[5] if fit else None

    assert got == {i: (holds("tier", k, t), holds("price", k, t)) for i, k, t in events}


def test_a_key_whose_versions_cross_chunks(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    monkeypatch.setattr(asof, "_LOW", 3)
    try:
        events, versions = made(6, keys=("hot",) * 9 + ("b",), n=400, m=400)
        assert run(spark, events, versions) == brute(events, versions)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbers_have_no_gaps(spark):
    rows = [(0, f"k{i % 7}", i, i + 1 + i % 5) for i in range(300)]
    ids = sorted(r["__id"] for r in asof._numbered(spark.createDataFrame(rows, "__attr int, __key string, __s long, __t long")).collect())
    assert ids == list(range(1, len(ids) + 1))
