import datetime as dt
import random
from decimal import Decimal

from tallyforge.operators.rolling import rolling_totals

SCHEMA = "seat string, day_used date, n long, amount decimal(20,8), bucket string, c int"
D = dt.date(2025, 1, 1)


def brute(rows, periods):
    days = {}
    for seat, day, n, amount, *_ in rows:
        if seat is not None and day is not None:
            t = days.setdefault(seat, {}).setdefault(day, [0, Decimal(0)])
            t[0] += n or 0
            t[1] += amount or 0
    out = {}
    for seat, by_day in days.items():
        day = min(by_day)
        while day <= max(by_day):
            row = []
            for p in periods:
                within = [v for d, v in by_day.items() if day - dt.timedelta(days=p) < d <= day]
                row += [sum(v[0] for v in within), sum(v[1] for v in within)]
            out[seat, day] = row
            day += dt.timedelta(days=1)
    return out


def check(spark, rows, periods=(7, 30)):
    df = spark.createDataFrame(rows, SCHEMA)
    got = rolling_totals(df, ["seat"], "day_used", ["n", "amount"], periods)
    found = {(r["seat"], r["day"]): [r[f"{m}_sum_{p}"] for p in periods for m in ("n", "amount")] for r in got.collect()}
    assert found == brute(rows, periods)


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice(["a", "b", "hot", "hot", None]), D + dt.timedelta(days=rng.randrange(150)), rng.choice([None, 0, 5, 9]), rng.choice([None, Decimal("1.5")]), "x", 1)
        for _ in range(400)
    ]
    check(spark, rows + rows[:50])
    check(spark, rows, (1, 3, 10))


def test_edges(spark):
    check(spark, [])
    check(spark, [("a", D, None, None, None, None)])
    check(spark, [("a", None, 3, None, "", 1), (None, D, 3, None, "", 1)])
    check(spark, [("", D, 1, Decimal(1), "", 1), ("", D + dt.timedelta(days=400), 2, None, "", 1)])
    check(spark, [("a", dt.date(1969, 12, 1), 4, None, "", 1), ("a", dt.date(1970, 1, 20), 2, None, "", 1)])


def test_average_counts_idle_days(spark):
    df = spark.createDataFrame([("a", D, 14, Decimal(7), "", 1)], SCHEMA)
    r = rolling_totals(df, ["seat"], "day_used", ["n", "amount"]).first()
    assert (r["n_avg_7"], r["amount_avg_7"]) == (2.0, 1.0)
