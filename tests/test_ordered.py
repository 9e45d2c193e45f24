"""Slices give what one window over the whole key gives, wherever the cuts fall."""

import random

import pytest
from pyspark.sql import functions as F

from lapline.operators.ordered import SLICE, Slices, first_of_each, numbered, order_key


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; times have ties and values have gaps."""
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        rows.append((key, rng.randrange(400), i, rng.choice([None, 1, 2, 3])))
    df = spark.createDataFrame(rows, "key string, t int, seq int, v int")
    return rows, df


def expected(rows):
    out, by_key = {}, {}
    for key, t, seq, v in sorted(rows, key=lambda r: (r[1], r[2])):
        seen = by_key.setdefault(key, [])
        known = [x for x in seen if x[1] is not None]
        total = sum(x[1] or 0 for x in seen) + (v or 0)
        out[seq] = (seen[-1] if seen else None, known[-1][1] if known else None, total, len(seen) + 1)
        seen.append((seq, v))
    return out


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 200, 20, 2])
def test_look_back_equals_brute_force(skewed, rows_per_slice):
    rows, df = skewed
    s = Slices(df, ["key"], ["t", "seq"], rows_per_slice)
    looked = s.look_back(
        prev=s.previous("seq", "v"), known=s.last_known(F.col("v")),
        total=s.running_sum(F.col("v")), row_no=s.running_sum(F.lit(1)),
    )
    slices = looked.rows.where("key = 'hot'").select(SLICE).distinct().count()
    assert slices == 1 if rows_per_slice == 1_000_000 else slices > 1
    want = expected(rows)
    got = looked.result.collect()
    assert len(got) == len(rows)
    for r in got:
        prev = tuple(r.prev) if r.prev is not None else None
        assert (prev, r.known, r.total, r.row_no) == want[r.seq]


def test_numbers_in_blocks(spark):
    rows = [("a", n, n * 10) for n in range(0, 5000, 7)] + [("b", 3, 1)]
    df = spark.createDataFrame(rows, "key string, n int, v int")
    s = Slices.of_numbers(df, ["key"], ["n"], size=100)
    got = {(r.key, r.n): r.p and r.p.v for r in s.look_back(p=s.previous("v")).result.collect()}
    assert got[("a", 0)] is None and got[("b", 3)] is None
    assert all(got[("a", n)] == (n - 7) * 10 for n in range(7, 5000, 7))


def test_per_key_values_reach_every_slice(skewed):
    rows, df = skewed
    totals = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    joined = Slices(df, ["key"], ["t", "seq"], 20).join_per_key(totals)
    assert joined.count() == len(rows)
    assert joined.where("key = 'hot'").select("n").distinct().collect()[0].n == 500


def test_large_keys_are_cut_evenly_enough(spark):
    df = spark.range(200_000).selectExpr("'hot' AS key", "id AS t")
    counts = [r["count"] for r in Slices(df, ["key"], ["t"], 5000).rows.groupBy(SLICE).count().collect()]
    assert 15 < len(counts) < 90 and max(counts) < 60_000


@pytest.mark.parametrize("rows", [100_000, 400_000])
def test_cuts_grow_with_the_table_and_slices_do_not(spark, rows):
    df = spark.range(rows).selectExpr("id % 3 AS key", "id AS t")
    cuts = Slices(df, ["key"], ["t"], 500).cuts.agg(F.sum(F.size("_cuts"))).first()[0]
    assert rows / 500 * 0.7 < cuts < rows / 500 * 1.3


def test_same_slices_every_time(skewed):
    _, df = skewed
    first, again = (
        sorted(map(tuple, Slices(df.repartition(n), ["key"], ["t", "seq"], 20).rows.select("seq", SLICE).collect()))
        for n in (1, 7))
    assert first == again


def test_numbered(spark):
    df = spark.range(100).selectExpr("'a' AS key", "100 - id AS t")
    rows = numbered(df, ["key"], ["t"], rows_per_slice=10).result.orderBy("t").collect()
    assert [r.row_no for r in rows] == list(range(1, 101))


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 20])
def test_first_of_each(skewed, rows_per_slice):
    rows, df = skewed
    got = {r.seq for r in first_of_each(df, ["key"], ["t", "seq"], 30, rows_per_slice).collect()}
    by_key = {}
    for key, t, seq, _ in rows:
        by_key.setdefault(key, []).append((t, seq))
    assert got == {seq for values in by_key.values() for _, seq in sorted(values)[:30]}


def test_first_of_each_is_cut_down_before_the_shuffle(skewed):
    plan = first_of_each(skewed[1], ["key"], ["t", "seq"], 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # partial and final, inside slices and over keys


def test_order_key(samples):
    t = samples([{"ts": 5, "packet_id": 9, "gear": 1}, {"ts": 5, "packet_id": 10, "gear": 2}, {"ts": 4, "gear": 3}])
    best = t.groupBy("session_id").agg(F.max_by("gear", order_key(t)).alias("gear"))
    assert best.first().gear == 2
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()
    assert t.drop("packet_id").groupBy("session_id").agg(
        F.min_by("gear", order_key(t.drop("packet_id"))).alias("gear")).first().gear == 3
