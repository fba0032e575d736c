import random
import statistics

import pytest
from pyspark.sql import functions as F

from fixwright.functions.order_stats import grouped_median, median_and_mad, running, value_counts
from fixwright.sources.staging import written


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    rows = [("hot", rng.choice([round(rng.uniform(1, 9), 2), 3.0, 4.5])) for _ in range(3000)]
    rows += [(f"g{i}", rng.uniform(0, 5)) for i in range(40) for _ in range(i % 7 + 1)]
    df = spark.createDataFrame(rows, "k string, v double")
    return rows, written(value_counts(df, ["k"], "v"), "test-counts")


def expected(rows):
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    return by


@pytest.mark.parametrize("limit", [1_000_000, 50])
def test_median_and_mad_match_brute_force(table, limit):
    rows, counts = table
    got = {r.k: (r.median, r.mad) for r in median_and_mad(counts, ["k"], "v", limit=limit, parts=16).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for k, vs in want.items():
        m = statistics.median(vs)
        assert got[k][0] == pytest.approx(m, abs=1e-12)
        assert got[k][1] == pytest.approx(statistics.median([abs(v - m) for v in vs]), abs=1e-12)


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_grouped_median_when_most_groups_are_hot(table, limit):
    rows, counts = table
    got = {r.k: r.median for r in grouped_median(counts, ["k"], "v", limit=limit, parts=4).collect()}
    assert got == {k: pytest.approx(statistics.median(vs)) for k, vs in expected(rows).items()}


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_running_totals_match_a_plain_window(spark, limit):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", rng.randint(0, 40), i, rng.uniform(0, 1)) for i in range(600)]
    df = written(spark.createDataFrame(rows, "k string, at int, id int, x double"), "test-running")
    got = running(df, ["k"], ["at", "id"], "at", {"before": ("sum", "x"), "top": ("max", "x")}, limit=limit, parts=8)
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        seen = {r.id: (r.before, r.top) for r in got.where(F.col("k") == k).collect()}
        total, top = 0.0, None
        for _, _, i, x in mine:
            assert seen[i][0] == pytest.approx(total)
            assert seen[i][1] == (pytest.approx(top) if top is not None else None)
            total, top = total + x, x if top is None else max(top, x)


def test_median_and_mad_order_each_group_twice_and_total_it_once(spark):
    """Three windows over a group before the aggregate: two in order, and one whole for its total and one for its median."""
    rows = spark.createDataFrame([("a", 1.0, 2), ("a", 5.0, 1), ("b", 2.0, 1)], "k string, v double, n bigint")
    out = median_and_mad(rows, ["k"], "v", also=(F.sum("n").alias("all"),))
    assert {tuple(r) for r in out.collect()} == {("a", 1.0, 0.0, 3), ("b", 2.0, 0.0, 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 4
