import math

import pytest

from fixwright.operators import ladder as L
from fixwright.operators import term as T


def test_decline_round_trips_and_matches_published_figures(spark):
    rows = [("a", 1.0, 0.60), ("b", 3.0, 0.40), ("c", 1.0, 1.0), ("d", 1.0, 0.1), ("e", 1.0, 1.2)]
    rows += [(f"r{d}", t, (1 - math.exp(-d * t)) / (d * t)) for d in (0.05, 0.5, 2.0) for t in (1.0, 3.0)]
    points = spark.createDataFrame(rows, "vendor string, tenor_years double, price_ratio double")
    got = {(r.vendor, r.tenor_years): r for r in T.implied_declines(points).collect()}
    assert got[("a", 1.0)].decline_rate == pytest.approx(1.12626, abs=1e-5)
    assert got[("a", 1.0)].annual_decline == pytest.approx(0.676, abs=5e-4)
    assert got[("b", 3.0)].annual_decline == pytest.approx(0.525, abs=5e-4)
    assert got[("c", 1.0)].decline_rate == 0.0
    assert got[("d", 1.0)].decline_rate == math.inf and got[("d", 1.0)].annual_decline == 1.0
    assert got[("e", 1.0)].decline_rate is None
    for d in (0.05, 0.5, 2.0):
        for t in (1.0, 3.0):
            assert got[(f"r{d}", t)].decline_rate == pytest.approx(d, abs=1e-8)


def test_premium_lowers_the_decline(spark):
    points = spark.createDataFrame([("a", 1.0, 0.60)], "vendor string, tenor_years double, price_ratio double")
    rates = [r.decline_rate for r in T.premium_sensitivity(points).orderBy("risk_premium").collect()]
    assert len(rates) == 5 and rates == sorted(rates, reverse=True)


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_strip(spark, limit):
    rows = [("x", 12.0, 2.30), ("x", 6.0, 2.52), ("y", 1.0, 2.0), ("y", 2.0, 1.9), ("dup", 1.0, 2.0), ("dup", 1.0, 2.1), ("neg", 0.0, 1.0), ("free", 1.0, 0.0)]
    quotes = spark.createDataFrame(rows, "curve string, tenor double, rate double")
    got = {(r.curve, r.period): r.forward for r in T.strip_forwards(quotes, limit=limit).collect()}
    assert got == {("x", 1): pytest.approx(2.52), ("x", 2): pytest.approx(2.08), ("y", 1): pytest.approx(2.0), ("y", 2): pytest.approx(1.8)}
    why = {r.curve: r.refusal for r in T.refused_curves(quotes).collect()}
    assert why == {"dup": "duplicate tenor", "neg": "tenors must be positive", "free": "rates must be positive"}


def test_consistency_needs_two_tenors(spark):
    rate = lambda d, t: (1 - math.exp(-d * t)) / (d * t) * 0.9
    rows = [("same", 1.0, rate(0.4, 1)), ("same", 3.0, rate(0.4, 3)), ("apart", 1.0, 0.6), ("apart", 3.0, 0.8), ("one", 1.0, 0.6)]
    got = {r.vendor: r for r in T.consistency(spark.createDataFrame(rows, "vendor string, tenor_years double, price_ratio double")).collect()}
    assert set(got) == {"same", "apart"} and got["same"].consistent and not got["apart"].consistent


@pytest.mark.parametrize(
    ("label", "low", "high"),
    [("<$2.00", None, 2.0), ("under $2", None, 2.0), ("$2.00-$2.25", 2.0, 2.25), ("$3.25+", 3.25, None), (">$3", 3.0, None),
     ("Over 4", 4.0, None), ("$2.75", None, 2.75)],
)
def test_bracket_labels(spark, label, low, high):
    b = spark.createDataFrame([(label,)], "label string").select(L.bounds("label").alias("b")).first().b
    assert (b.low, b.high) == (low, high)


LADDER = [("<$2.00", 0.1475), ("$2.00-$2.25", 0.0960), ("$2.25-$2.50", 0.1250), ("$2.50-$2.75", 0.2050), ("$2.75-$3.00", 0.1400), ("$3.00+", 0.2400)]


def test_a_real_ladder_is_refused_for_its_tails(spark):
    rows = [("oct", label, q, 1000.0) for label, q in LADDER]
    brackets = L.with_bounds(spark.createDataFrame(rows, "ladder string, label string, quoted double, volume double"))
    v = L.assess(brackets, ["ladder"]).first()
    book = sum(q for _, q in LADDER)
    mids = [1.875, 2.125, 2.375, 2.625, 2.875, 3.125]
    mean = sum(m * q for m, (_, q) in zip(mids, LADDER, strict=True)) / book
    assert v.book_sum == pytest.approx(book) and v.expected == pytest.approx(mean)
    assert v.dispersion == pytest.approx(math.sqrt(sum((m - mean) ** 2 * q for m, (_, q) in zip(mids, LADDER, strict=True)) / book))
    assert v.withheld and len(v.refusals) == 1 and "open-ended tails" in v.refusals[0]
    spans = {r.open_span: r.expected for r in L.expectations(brackets, ["ladder"], L.SPANS).collect()}
    assert spans[0.25] == pytest.approx(mean) and spans[1.0] != spans[0.25]


def test_a_ladder_without_mass_reads_as_zero(spark):
    brackets = L.with_bounds(spark.createDataFrame([("z", "$1-$2", 0.0, 0.0)], "ladder string, label string, quoted double, volume double"))
    v = L.assess(brackets, ["ladder"]).first()
    assert (v.expected, v.dispersion, v.tail_mass, v.withheld) == (0.0, 0.0, 1.0, True)
