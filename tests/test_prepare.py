import hashlib
import json

import pytest
from conftest import quote
from pyspark.sql import functions as F

from fixwright import rules
from fixwright.functions import labels, regions
from fixwright.functions.fingerprint import fingerprint
from fixwright.operators import aliases as A
from fixwright.operators import evidence as V
from fixwright.operators import prepare as P

RUN = ["snapshot"]


def outcomes(observations, rows, *versions):
    got = P.prepare(observations(rows), RUN, rules.registry(*versions)).collect()
    return {(r.source_sku, r.methodology_version): r for r in got}


@pytest.mark.parametrize(
    ("label", "code"),
    [
        ("H100", "H100"), ("h100-sxm5", "H100"), ("H100 SXM 80GB TDP350", "H100"), ("H1000", None), ("H100_nvl", "H100"),
        ("  NVIDIA   H100 80GB HBM3 ", "H100"), ("H200_sxm5 x", "H200"), ("A100X", "A100"), ("A100-SXM4-80GB", "A100"),
        ("MI300", "MI300X"), ("NVIDIA B200", "B200"), ("NVIDIA H100", None), ("RTX 4090", None), ("", None),
    ],
)
def test_labels_name_contracts(spark, label, code):
    row = spark.createDataFrame([(label,)], "l string").select(labels.contract_code(labels.words("l")).alias("c")).first()
    assert row.c == code


@pytest.mark.parametrize(
    ("region", "loose", "exact"),
    [
        (None, True, True), ("", False, True), ("  ", False, True), ("us-east-1", True, True), ("US", True, True), ("u.s.", False, True),
        ("Texas, US", True, True), ("US, Austin, TX", True, True), ("eastus2", True, True), ("southcentralus", True, True),
        ("Australia, AU", True, False), ("Russia, RU", True, False), ("Austria, AT", True, False), ("IL, Jerusalem", True, False),
        ("Georgia", True, False), ("Alberta, CA", False, False), ("Salt Lake City", True, True), ("new-york", True, True),
        ("Germany, DE", False, False), ("eu-west-1", False, False), ("Chisinau, MD", False, False), ("united states", True, True),
    ],
)
def test_region_rules(spark, region, loose, exact):
    df = spark.createDataFrame([(region,)], "region string")
    row = df.select(regions.passes_substring().alias("a"), regions.passes_exact().alias("b")).first()
    assert (row.a, row.b) == (loose, exact)


def test_each_label_and_region_is_read_once(spark, observations):
    shown = [("H100 SXM", "us-east-1"), ("H100 SXM", None), (None, ""), ("", "Germany, DE"), (None, None), ("A100_x", "us-east-1")] * 3
    obs = observations([quote(source_sku=str(i), gpu_model=m, region=r) for i, (m, r) in enumerate(shown)])
    plain = P.with_index(obs).withColumns({"region_exact": regions.passes_exact(), "region_loose": regions.passes_substring()})
    facts = P.with_facts(obs)
    assert sorted(facts.columns) == sorted(plain.columns) and facts.count() == len(shown)
    assert facts.select(plain.columns).exceptAll(plain).isEmpty() and plain.exceptAll(facts.select(plain.columns)).isEmpty()
    rows = P.prepare(obs, RUN, rules.registry())
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()  # a text is not read again for each of its rows


@pytest.mark.parametrize(
    "over",
    [{}, {"region": None}, {"region": "Québec, \"CA\"\\ 😀"}, {"usd_per_hour_total": 0.35}, {"usd_per_hour_total": 12345678.9},
     {"usd_per_hour_total": 1.2e-05}, {"usd_per_hour_total": 1e-06}, {"usd_per_hour_total": 31.92}, {"source_sku": "tab\there"}],
)
def test_fingerprint_is_the_hash_of_canonical_json(observations, over):
    q = quote(**over)
    text = json.dumps(
        {"source": q["source"], "sku": q["source_sku"], "gpus": q["gpu_count"], "price": round(q["usd_per_hour_total"], 6),
         "commitment": q["commitment"], "region": q["region"]},
        sort_keys=True,
    )
    got = observations([q]).select(fingerprint().alias("f")).first().f
    assert got == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_the_first_failing_rule_names_the_rejection(observations):
    rows = [
        quote(source_sku="ok"),
        quote(source_sku="model", gpu_model="RTX 4090", price_kind="from_floor"),
        quote(source_sku="floor", price_kind="from_floor", currency="EUR"),
        quote(source_sku="money", currency="EUR", gpu_model="H100 NVL"),
        quote(source_sku="usd", currency="usd"),
        quote(source_sku="nvl", gpu_model="H100 NVL", region="Germany, DE"),
        quote(source_sku="gb40", gpu_model="A100 40GB", vram_gb=None),
        quote(source_sku="node", gpu_count=2, vram_gb=160),
        quote(source_sku="card", gpu_count=8, vram_gb=320),
        quote(source_sku="edge", vram_gb=88, gpu_count=1),
        quote(source_sku="place", region="Australia, AU"),
        quote(source_sku="free", usd_per_hour_total=0.0),
        quote(source_sku="far", form_factor="pcie", interconnect="none", commitment="spot"),
    ]
    got = outcomes(observations, rows, "1.0.0", "1.2.0")
    new = {sku: r.outcome for (sku, v), r in got.items() if v == "1.2.0"}
    assert new == {
        "ok": "kept", "model": "unmatched_model", "floor": "from_floor", "money": "currency_unsupported", "usd": "kept",
        "nvl": "product_identity", "gb40": "product_identity", "node": "kept", "card": "product_identity", "edge": "kept",
        "place": "region_mismatch", "free": "nonpositive_price", "far": "over_adjusted",
    }
    old = {sku: r.outcome for (sku, v), r in got.items() if v == "1.0.0"}
    assert old["floor"] == "kept" and old["place"] == "kept" and old["gb40"] == "kept"
    assert old["nvl"] == "region_mismatch"


def test_factors_multiply_in_order_and_are_audited(observations):
    row = quote(form_factor="pcie", interconnect="ethernet", commitment="community", gpu_count=4, usd_per_hour_total=8.0)
    got = P.prepare(observations([row]), RUN, rules.registry("1.2.0"))
    r = got.select("*", P.adjustments().alias("adj")).first()
    assert r.total_x == 1.18 * 1.12 * 1.30 * 0.98
    assert r.normalized_usd_per_gpu_hour == 2.0 * (1.18 * 1.12 * 1.30 * 0.98)
    assert [(a.name, a.factor) for a in r.adj] == [
        ("form_factor", 1.18), ("interconnect", 1.12), ("commitment", 1.30), ("node_size", 0.98)
    ]


@pytest.mark.parametrize(("count", "factor"), [(16, 1.0), (8, 1.0), (7, 0.98), (4, 0.98), (3, 0.95), (2, 0.95), (1, 0.92), (0, 0.92)])
def test_node_curve(spark, count, factor):
    df = spark.createDataFrame([(count, "1.2.0")], "gpu_count int, methodology_version string")
    assert df.select(P.node_factor(rules.rules_of(rules.registry())["node_curve"]).alias("f")).first().f == factor


def pairs(source, ratio, n, jitter=0.0):
    out = []
    for i in range(n):
        base = 2.0 + i
        other = base / (ratio + jitter * (i % 3))
        out.append(quote(source=source, source_sku=f"{source}-od{i}", gpu_model=f"card {i}", usd_per_hour_total=8 * base))
        out.append(quote(source=source, source_sku=f"{source}-sp{i}", gpu_model=f" CARD {i}", commitment="spot", usd_per_hour_total=8 * other))
    return out


def test_a_constant_ratio_is_a_policy_and_removes_all_its_rows(observations):
    rows = pairs("policy", 2.0, 6) + pairs("market", 2.0, 6, jitter=0.4) + pairs("few", 2.0, 4)
    rows.append(quote(source="policy", source_sku="lone", commitment="spot"))
    got = outcomes(observations, rows, "1.2.0")
    dropped = {sku for (sku, _), r in got.items() if r.outcome == "administered"}
    assert dropped == {f"policy-sp{i}" for i in range(6)} | {"lone"}
    found = {r.source: r for r in V.commitment_evidence(P.with_index(observations(rows)), RUN).collect()}
    assert found["policy"].administered and found["policy"].cv == pytest.approx(0, abs=1e-12)
    assert not found["market"].administered and not found["few"].administered
    verdicts = {r.source: r.verdict for r in V.against_schedule(V.commitment_evidence(P.with_index(observations(rows)), RUN)).collect()}
    assert verdicts == {"policy": "administered", "market": "disagrees", "few": "disagrees"}


def book(n, prefix, region="Texas, US", hosts=None, machines=None):
    return [
        quote(source="vastai", source_sku=f"{prefix}{i}", region=region, tier=1,
              machine_id=(machines[i] if machines else i), host_id=(hosts[i] if hosts else i))
        for i in range(n)
    ]


def test_the_floor_counts_the_version_s_own_population(observations):
    rows = book(3, "us", machines=[1, 1, 1], hosts=[1, 1, 1]) + book(10, "de", region="Germany, DE")
    got = outcomes(observations, rows, "1.0.0", "1.1.0", "1.2.0")
    assert got[("us0", "1.0.0")].outcome == "kept"
    assert got[("us0", "1.1.0")].outcome == "kept"  # ten foreign machines carry it over
    assert got[("us0", "1.2.0")].outcome == "book_population_floor"
    assert got[("de0", "1.2.0")].outcome == "region_mismatch"


@pytest.mark.parametrize(
    ("machines", "hosts", "why"),
    [
        ([None] * 4, [None] * 4, "none of its 4 priced rows identify a machine or host, so the population is unproven"),
        ([1, 2, 3, 3], [1, 2, 3, 4], "3 distinct machines of 4 required across 4 priced rows"),
        ([None] * 4, [1, 2, 3, 4], "0 distinct machines of 4 required across 4 priced rows"),
        ([1, 2, 3, 4], [1, 1, 2, 2], "2 distinct hosts of 3 required across 4 priced rows"),
        ([1, 2, 3, 4], [1, 2, 3, 3], None),
    ],
)
def test_floor_reasons(observations, machines, hosts, why):
    prepared = P.prepare(observations(book(4, "m", machines=machines, hosts=hosts)), RUN, rules.registry("1.2.0"))
    row = P.book_population(prepared, RUN, rules.registry("1.2.0")).first()
    assert row.held_reason == why
    cell = P.venue_holdouts(P.book_population(prepared, RUN, rules.registry("1.2.0")), RUN).collect()
    assert len(cell) == (1 if why else 0)


def test_funnel_accounts_for_every_row(observations):
    rows = [quote(source_sku="a"), quote(source_sku="b", region="Germany, DE"), quote(source_sku="c", currency="EUR")]
    f = P.funnel(P.prepare(observations(rows), RUN, rules.registry("1.2.0")), RUN).first()
    assert (f.raw, f.region_mismatch, f.currency_unsupported, f.normalised) == (3, 1, 1, 1)


def test_trace_shows_the_running_product(observations):
    prepared = P.prepare(observations([quote(form_factor="pcie", gpu_count=1)]), RUN, rules.registry("1.2.0"))
    steps = P.trace(prepared, ["source"]).orderBy("step").collect()
    assert [s.name for s in steps] == ["form_factor", "node_size"]
    assert steps[-1].cumulative == 1.18 * 0.92
    assert steps[-1].headroom == pytest.approx(1.75 - 1.18 * 0.92)


def test_form_factor_is_compared_within_one_configuration(observations):
    rows = [
        quote(source="v", source_sku="s", usd_per_hour_total=32.0), quote(source="v", source_sku="p", form_factor="pcie", usd_per_hour_total=24.0),
        quote(source="v", source_sku="q", form_factor="pcie", gpu_count=1, usd_per_hour_total=1.0),
    ]
    found = V.form_factor_evidence(P.with_index(observations(rows)), RUN).collect()
    assert [(r.pairs, r.median_ratio) for r in found] == [(1, 0.75)]
    pooled = V.form_factor_pooled(V.form_factor_evidence(P.with_index(observations(rows)), RUN), RUN).first()
    assert pooled.implied_factor == pytest.approx(1 / 0.75)


def test_contract_and_rule_dimensions(spark):
    assert rules.contracts_frame(spark).count() == 5
    table = rules.methodology_frame(spark).orderBy("version").collect()
    assert [r.version for r in table] == ["1.0.0", "1.1.0", "1.2.0"]
    assert [r.exact_region for r in table] == [False, False, True]
    unknown = spark.createDataFrame([("0.9.0",)], "methodology_version string").select(rules.rules_of(rules.registry()).alias("m"))
    assert unknown.where(F.col("m").isNull()).count() == 1


def test_alias_table_reads_labels_as_the_registry_does(spark, observations):
    shown = ["H100 SXM", "nvidia_h100-sxm5  80GB", "NVIDIA H200", "h200x", "", None, "A100", "MI300X OAM", "B200_sxm6 x", "NVIDIA", "L40S"]
    obs = observations([quote(source_sku=str(i), gpu_model=m) for i, m in enumerate(shown)])
    plain = {r.source_sku: r.index_code for r in P.with_index(obs).collect()}
    assert {r.source_sku: r.index_code for r in P.with_index(obs, A.registered(spark)).collect()} == plain
    none = A.registered(spark).limit(0)
    assert {r.index_code for r in P.with_index(obs, none).collect()} == {None}
    prepared = P.prepare(obs, ["snapshot"], rules.registry(), A.registered(spark)).groupBy("outcome").count().collect()
    assert sorted(map(tuple, prepared)) == sorted(map(tuple, P.prepare(obs, ["snapshot"], rules.registry()).groupBy("outcome").count().collect()))


def test_a_hundred_thousand_aliases_leave_the_plan_as_it_is(spark, observations):
    many = spark.range(100_000).selectExpr("concat('c', id % 977) as code", "concat('card ', id div 4, case when id % 4 = 0 then '' else concat(' rev-', id % 4) end) as alias", "id as place")
    twice = many.union(spark.createDataFrame([("late", "Card_7", 10**9), ("early", "card 9 REV 2", -1)], "code string, alias string, place long"))
    labels_ = ["card 7", "Card-7 rev", "card_7 rev-1 x", "card 9 rev 2", "card 24999 rev 3", "card", "card 25000", "card 7" + " rev" * 5000]
    obs = observations([quote(source_sku=str(i), gpu_model=m) for i, m in enumerate(labels_)])
    found = P.with_index(obs, twice)
    got = {r.source_sku: r.index_code for r in found.collect()}
    assert [got[str(i)] for i in range(8)] == ["c28", "c28", "c29", "early", f"c{99999 % 977}", None, None, "c28"]
    small = P.with_index(obs, twice.limit(3))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(found) - size(small)) < 200
