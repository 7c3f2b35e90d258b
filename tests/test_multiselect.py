import math
import random

import pytest

from tallyforge.operators import multiselect
from tallyforge.operators.multiselect import merge_counts, percentiles, value_counts

QS = [0.01, 0.5, 0.95, 1.0]


def brute(rows, qs=QS):
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    return {(g, q): sorted(vs)[max(1, math.ceil(q * len(vs) - 1e-9)) - 1] for g, vs in groups.items() for q in qs}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(g, v, 0) for g, v in rows], "g string, v double, weight int")
    return {(r["g"], r["q"]): r["value"] for r in percentiles(value_counts(df, ["g"], "v", **kw), ["g"], QS).collect()}


def test_exact(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.randrange(3000))) for _ in range(4000)] + [("same", 7.0)] * 500 + [("one", -2.5), (None, 1.0), ("n", None), ("n", float("nan")), ("n", 3.0)]
    rows += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-5, 12)) for _ in range(700)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == {}


def test_relative_error_holds(spark):
    rng = random.Random(6)
    rows = [("a", rng.lognormvariate(0, 4)) for _ in range(3000)] + [("b", -rng.random()) for _ in range(100)] + [("b", 0.0)] * 5
    got, want = run(spark, rows, relative_error=0.02), brute(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=0.0201)


def test_days_combine_into_the_whole(spark):
    rng = random.Random(7)
    days = [[("a", float(rng.randrange(100))) for _ in range(50)] for _ in range(3)]
    states = [value_counts(spark.createDataFrame(d, "g string, v double"), ["g"], "v") for d in days]
    got = {(r["g"], r["q"]): r["value"] for r in percentiles(merge_counts(*states, group=["g"]), ["g"], QS).collect()}
    assert got == brute(sum(days, []))


def test_many_targets_are_salted(spark, monkeypatch):
    monkeypatch.setattr(multiselect, "_LISTED", 0)
    rng = random.Random(8)
    rows = [("hot", float(rng.randrange(3000))) for _ in range(2000)] + [("b", float(i)) for i in range(9)] + [(None, 1.0)]
    assert run(spark, rows) == brute(rows)
