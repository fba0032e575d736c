import random

import oracle
import pytest

from fixwright import rules
from fixwright.operators import estimate as E
from fixwright.operators import reproduce as R

KEYS = ["market", "methodology_version"]
SCHEMA = "market string, methodology_version string, source string, normalized_usd_per_gpu_hour double, tier int"


def frame(spark, markets):
    rows = [(m, "1.2.0", p, x, t) for m, qs in markets.items() for p, x, t in qs]
    return spark.createDataFrame(rows, SCHEMA)


def generated(n=120, seed=11):
    """Markets on a one-cent grid, ties included, 2 to 9 providers of 1 to 4 quotes."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        level = rng.choice([0.5, 2.0, 3.0, 8.0])
        out[f"m{i}"] = [
            (f"v{p % 3}:p{p}", round(max(0.01, rng.choice([level, rng.gauss(level, level / 5), level * rng.choice([1, 1, 40])])), 2),
             rng.choice([1, 2, 2, 3]))
            for p in range(rng.randint(1, 9)) for _ in range(rng.randint(1, 4))
        ]
    return out


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_fixings_match_the_row_by_row_reading(spark, limit):
    markets = generated()
    got = {r.market: r for r in E.fixings(frame(spark, markets), KEYS, rules.registry("1.2.0"), limit).collect()}
    assert set(got) == set(markets)
    for m, quotes in markets.items():
        assert got[m].value == (pytest.approx(oracle.value(quotes), rel=1e-9)), m
        d = oracle.dispersion(quotes)
        assert got[m].dispersion == (pytest.approx(d, abs=1e-12) if d is not None else None), m
        prices = [x for _, x, _ in quotes]
        assert min(prices) - 1e-9 <= got[m].value <= max(prices) + 1e-9
        want = got[m].provider_count >= 4 and got[m].observation_count >= 8 and d is not None and d <= 0.45
        assert got[m].passed == want


@pytest.mark.parametrize("limit", [1_000_000, 3])
@pytest.mark.parametrize("band", [0.5, 0.05])
def test_the_dial_matches_at_narrow_bands(spark, band, limit):
    markets = generated(60, 5)
    versions = {"1.2.0": rules.METHODOLOGIES["1.2.0"].revised("1.2.0", robustness_band=band)}
    got = {r.market: r.value for r in E.fixings(frame(spark, markets), KEYS, versions, limit).collect()}
    for m, quotes in markets.items():
        assert got[m] == pytest.approx(oracle.value(quotes, band), rel=1e-9), m


def test_the_cap_stops_after_as_many_rounds_as_providers(spark):
    quotes = [("a", 3.0, 1), ("b", 3.1, 1), ("c", 3.2, 3)]
    rows = {r.provider: r for r in E.contributions(frame(spark, {"x": quotes}), KEYS, rules.registry("1.2.0")).collect()}
    assert rows["a"].weight == pytest.approx(0.40225, abs=1e-5)
    assert rows["b"].weight == pytest.approx(0.40225, abs=1e-5)
    assert rows["c"].weight == 0.25


def test_a_cap_with_no_legal_allocation_is_left_alone(spark):
    rows = E.contributions(frame(spark, {"x": [("a", 3.0, 1), ("b", 3.1, 3)]}), KEYS, rules.registry("1.2.0")).collect()
    assert {r.provider: r.weight for r in rows} == {"a": 1.0, "b": 0.25}


def test_an_extreme_quote_against_an_exact_consensus_is_screened(spark):
    quotes = [(p, 3.0, 2) for p in "abcd"] + [("e", 1_000_000.0, 2), ("f", 0.01, 2), ("g", 9.0, 2)]
    rows = {r.provider: r for r in E.contributions(frame(spark, {"x": quotes}), KEYS, rules.registry("1.2.0")).collect()}
    assert rows["e"].screened_out and rows["f"].screened_out
    assert not rows["g"].screened_out  # exactly three times the consensus is kept
    assert rows["e"].weight == 0.0


def test_the_screen_boundary_does_not_depend_on_scale(spark):
    markets = {str(k): [("a", 0.9 * k, 2), ("b", 2.7 * k, 2), ("c", 2.7 * k, 2), ("d", 2.7 * k, 2)] for k in (1, 33, 0.1, 7.7)}
    rows = E.contributions(frame(spark, markets), KEYS, rules.registry("1.2.0")).collect()
    assert not any(r.screened_out for r in rows)


def test_gates_word_their_failures(spark):
    fix = E.fixings(frame(spark, {"thin": [("a", 3.0, 2), ("b", 3.1, 2)]}), KEYS, rules.registry("1.2.0")).collect()[0]
    assert fix.failed_gates == (
        "min_providers: 2 of 4 required; min_observations: 2 of 8 required; "
        "dispersion: not computable with fewer than 3 providers"
    )
    strict = {"1.2.0": rules.METHODOLOGIES["1.2.0"].revised("1.2.0", require_tier1=True)}
    fix = E.fixings(frame(spark, {"thin": [("a", 3.0, 2)]}), KEYS, strict).collect()[0]
    assert "executable_input: rate cards only" in fix.failed_gates


def test_concentration_takes_the_worse_unit(spark):
    quotes = [("hub:a", 3.0, 3), ("hub:b", 3.0, 3), ("hub:c", 3.1, 3), ("x", 3.0, 1), ("y", 3.1, 2), ("z", 3.0, 2)]
    weighted = E.contributions(frame(spark, {"x": quotes}), KEYS, rules.registry("1.2.0"))
    row = E.concentration(E.venues(weighted, KEYS), KEYS).collect()[0]
    assert (row.count_venue, row.count_share, row.flagged) == ("hub", 0.5, False)
    quotes.append(("hub:d", 3.0, 3))
    weighted = E.contributions(frame(spark, {"x": quotes}), KEYS, rules.registry("1.2.0"))
    row = E.concentration(E.venues(weighted, KEYS), KEYS).collect()[0]
    assert (row.lead_venue, row.flagged) == ("hub", True)


def test_sweep_ends_meet_the_mean_and_the_single_band_form(spark):
    markets = generated(20, 9)
    versions = rules.registry("1.2.0")
    weighted = E.contributions(frame(spark, markets), KEYS, versions)
    votes = E.ballot(weighted, KEYS, versions)
    swept = {(r.market, r.band): r.value for r in E.interquantile_sweep(votes, KEYS, [1.0, 0.5]).collect()}
    for m, quotes in markets.items():
        assert swept[(m, 1.0)] == pytest.approx(oracle.value(quotes), rel=1e-9)
        assert swept[(m, 0.5)] == pytest.approx(oracle.value(quotes, 0.5), rel=1e-9)


def test_impact_tells_a_flip_from_a_move(spark):
    rows = spark.createDataFrame(
        [("H100", "d1", "s", "1.1.0", 3.0), ("H100", "d2", "s2", "1.1.0", None), ("H100", "d3", "s3", "1.1.0", None), ("H100", "d4", "s4", "1.1.0", 3.0)],
        "index_code string, index_date string, snapshot string, methodology_version string, value double",
    )
    values = spark.createDataFrame(
        [("s", "H100", "1.2.0", 3.004), ("s2", "H100", "1.2.0", 2.0), ("s3", "H100", "1.2.0", None), ("s4", "H100", "1.2.0", 3.3)],
        "snapshot string, index_code string, methodology_version string, published_value double",
    )
    got = {r.index_date: (r.differs, r.change) for r in R.version_impact(rows, values, "1.2.0").collect()}
    assert got["d1"][0] is False
    assert got["d2"] == (True, None)
    assert got["d3"] == (False, None)
    assert got["d4"] == (True, pytest.approx(0.1))
