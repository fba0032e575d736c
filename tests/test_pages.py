import datetime as dt
import json

import pytest

from fixwright.functions import markup
from fixwright.operators import backseries as B
from fixwright.operators import ratecards as C
from fixwright.sources import feeds, listings


@pytest.fixture(scope="module")
def pages(spark):
    return lambda *html: spark.createDataFrame(
        [(f"s{i}", "20250115120000", h) for i, h in enumerate(html)], "source string, captured string, html string"
    )


def test_cells_are_what_a_reader_sees(pages):
    html = (
        "<html><head><title>t</title></head><body><!-- <p>no</p> --><script>var a='</p>'</script><p>A &amp; B&nbsp;<i>c</i></p>"
        "<div title=\"x > y\">4 &#8212; &#x1F600; 5</div><svg><p>hidden</p></svg>tail &lt;b&gt; &amp;lt;<br>end</body></html>"
    )
    got = pages(html).select(markup.cells("html").alias("c")).first().c
    assert got == ["A & B c", "4 — 😀 5", "tail <b> &lt;", "end"]


def test_amounts(pages):
    got = pages("$1,234.50 and $ 3 or $2.50/hr, 9").select(markup.amounts("html").alias("a")).first().a
    assert got == [1234.5, 3.0, 2.5]


@pytest.mark.parametrize(
    ("label", "model", "form", "fabric", "memory"),
    [
        ("NVIDIA H100 SXM5", "H100 SXM", "sxm", "nvlink", None), ("HGX B200", "B200 SXM", "sxm", "nvlink", None),
        ("A100-PCIe 40GB", "A100 PCIe 40GB", "pcie", "none", 40), ("H100 NVL", "H100 NVL", "pcie", "nvlink", None),
        ("H200 PCIe NVLink", "H200", "pcie", "nvlink", None), ("A100 80GB", "A100", "unknown", "unknown", 80),
        ("GH200", None, None, None, None), ("GB 200", None, None, None, None), ("H1000", None, None, None, None),
        ("H800", None, None, None, None), ("L40S", None, None, None, None),
    ],
)
def test_labels(spark, label, model, form, fabric, memory):
    r = spark.createDataFrame([(label,)], "l string").select(C.label_reading("l").alias("r")).first().r
    assert (tuple(r) if r else (None,) * 4) == (model, form, fabric, memory)


def row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def test_a_placeholder_keeps_its_column(pages):
    html = (
        "<table>" + row("GPU", "On-Demand Price (/hr)", "6 Month Price (/hr)", "Dynamic price", "Spot price")
        + row("H100 SXM", "80", "n/a", "$2.45", "$9", "$1.10") + row("H200", "$3.50", "$3.00") + "</table>"
        + row("B200", "$5.00", "needs a contract")
    )
    rows = C.priced_table(C.page_cells(pages(html))).collect()
    got = {(r.gpu_model, r.commitment): r.price_per_instance_hour for r in rows}
    assert got == {("H100 SXM", "reserved"): 2.45, ("H100 SXM", "spot"): 1.10, ("H200", "on_demand"): 3.5, ("H200", "reserved"): 3.0}
    assert {r.vram_gb for r in rows if r.gpu_model == "H100 SXM"} == {80}


def test_a_section_heading_lends_its_commitment(pages):
    html = "<h2>On-Demand Cloud GPU Pricing</h2><p>GPU</p><p>Price per hour</p><p>H100</p><p>$2.00</p>"
    cells = C.page_cells(pages(html))
    assert [r.commitment for r in C.priced_table(cells, sections=True).collect()] == ["on_demand"]
    assert C.priced_table(cells).count() == 0


def test_a_page_that_bills_the_host_apart_prices_a_component(pages):
    table = "<p>On-Demand Price (/hr)</p><p>H100</p><p>$2.00</p>"
    cells = C.page_cells(pages(table + "<p>Max vCPUs per GPU ($0.01/hr)</p>", table))
    got = {r.source: r.basis for r in C.component_priced(C.priced_table(cells), cells).collect()}
    assert got == {"s0": "gpu_component", "s1": "instance"}


CARD = (
    "source string, captured string, sku string, gpu_model string, gpu_count int, price_per_instance_hour double, commitment string, "
    "form_factor string, interconnect string, vram_gb int, currency string, price_kind string, basis string, note string"
)


def card(source, captured, price, **over):
    base = dict(sku="x", gpu_model="H100 SXM", gpu_count=8, commitment="on_demand", form_factor="sxm", interconnect="nvlink",
                vram_gb=80, currency="USD", price_kind="quoted", basis="instance", note="")
    base.update(over)
    return (source, captured, base["sku"], base["gpu_model"], base["gpu_count"], 8.0 * price if base["gpu_count"] == 8 else price,
            *[base[k] for k in ("commitment", "form_factor", "interconnect", "vram_gb", "currency", "price_kind", "basis", "note")])


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_back_series(spark, limit):
    rows = [
        card("a", "20250110000000", 3.0), card("b", "20250111000000", 3.2), card("c", "20250112000000", 4.0), card("c", "20250113000000", 5.0),
        card("a", "20250210000000", 3.3), card("b", "20250211000000", 3.52), card("c", "20250212000000", 4.95),
        card("a", "20250410000000", 3.3), card("a", "20250110000000", 2.0, commitment="reserved"), card("a", "20250110000000", 1.0, commitment="spot"),
        card("d", "20250110000000", 2.0, basis="gpu_component"), card("e", "20250110000000", 2.0, gpu_model="MI300X", vram_gb=192),
        card("f", "20250110000000", 2.0, gpu_model="H100 NVL"),
    ]
    restated = B.restate(spark.createDataFrame(rows, CARD))
    codes = [r.outcome for r in restated.collect()]
    assert [c for c in codes if c != "restated"] == ["not_on_demand", "not_on_demand", "component_price", "out_of_scope", "product_identity"]
    spine = B.spine(spark, "2025-01-01", "2025-04-28", "month")
    got = {r.period: r for r in B.period_series(restated, spine, "month", limit).where("index_code = 'H100'").collect()}
    jan, feb, mar, apr = (got[f"2025-0{i}"] for i in (1, 2, 3, 4))
    assert (jan.status, jan.value, jan.provider_count, jan.observation_count, jan.snapshot_count) == ("published", pytest.approx(3.2), 3, 4, 4)
    assert jan.reserved_raw_median == 2.0 and jan.spot_raw_median == 1.0 and jan.matched_log_change is None
    assert feb.matched_providers == 3 and feb.matched_log_change == pytest.approx(0.0953102, abs=1e-6)
    assert (mar.status, mar.value, mar.provider_count, mar.withheld_reason) == ("withheld", None, 0, "min_providers: 0 of 3 required")
    assert apr.matched_providers == 0 and apr.status == "withheld" and apr.provider_count == 1
    cover = {(r.source, r.period): r.H100 for r in B.coverage(restated.select("source", "captured").distinct(), restated, "2025-01-01", "2025-04-28", restated).collect()}
    assert cover[("a", "2025-01")] == 1 and cover[("a", "2025-03")] == 0 and len(cover) == 6 * 4


def test_weeks_are_named_by_their_monday(spark):
    df = spark.createDataFrame([("20241231000000",), ("20250106000000",)], "captured string")
    got = [r.w for r in df.select(B.period(B.captured_day(), "week").alias("w")).collect()]
    assert got == ["2024-12-30", "2025-01-06"]


def test_listing_takes_the_first_available_of_three(spark, tmp_path):
    head = ["timestamp", "original", "mimetype", "statuscode", "digest"]
    line = lambda ts, status="200", mime="text/html": [ts, "u", mime, status, "d" + ts]
    doc = {"source": "lambda", "listings": {"u": [head, line("20250106000000"), line("20250107000000"), line("20250108000000"),
           line("20250109000000"), line("20250113000000", "301"), line("20250114000000", mime="warc/revisit"), line("20250120000000")]}}
    (tmp_path / "lambda.json").write_text(json.dumps(doc))
    captures = listings.read_listings(spark, str(tmp_path))
    assert captures.count() == 7 and listings.usable(captures).count() == 5
    on_file = spark.createDataFrame([("lambda", "20250108000000"), ("lambda", "20250109000000")], "source string, timestamp string")
    got = listings.selected(captures, on_file).collect()
    assert [(r.period, r.timestamp) for r in got] == [("2025-01-06", "20250108000000")]
    none = listings.selected(captures, on_file.where("timestamp = '20250109000000'"))
    assert none.count() == 0  # the fourth capture is not a candidate


def test_offers_and_catalogue(spark):
    at = dt.datetime(2026, 9, 1, 12)
    offers = {"offers": [
        {"id": 1, "gpu_name": "H100 SXM", "num_gpus": 2, "dph_total": 5.0, "rentable": True, "reliability2": 0.99, "geolocation": "Texas, US", "machine_id": 7, "host_id": 8},
        {"id": 2, "gpu_name": "H100 SXM", "num_gpus": 2, "dph_total": 5.0, "rentable": True, "reliability2": 0.90},
        {"id": 3, "gpu_name": "H100 SXM", "num_gpus": 0, "dph_total": 5.0},
    ]}
    docs = spark.createDataFrame([(json.dumps(offers), at)], "doc string, captured_at timestamp")
    rows = feeds.marketplace_offers(docs, "doc").orderBy("source_sku").collect()
    assert [(r.source_sku, r.tier, r.machine_id, r.interconnect) for r in rows] == [("H100 SXM:1", 1, 7, "nvlink"), ("H100 SXM:2", 2, None, "nvlink")]
    item = {"cloud": "lambdalabs", "shade_instance_type": "h100x8", "gpu_type": "H100", "num_gpus": 8, "hourly_price": 3192, "interconnect": "sxm5",
            "configuration": {"vram_per_gpu_in_gb": 80}, "availability": [{"region": "a", "available": False}, {"region": "b", "display_name": "US, B", "available": True}]}
    docs = spark.createDataFrame([(json.dumps({"instance_types": [item, {**item, "hourly_price": 0}]}), at)], "doc string, captured_at timestamp")
    r = feeds.aggregator_catalogue(docs, "doc").collect()
    assert len(r) == 1 and (r[0].source, r[0].usd_per_hour_total, r[0].region, r[0].tier, r[0].form_factor) == ("shadeform:lambdalabs", 31.92, "US, B", 1, "sxm")


def test_labels_of_rows_on_file_are_read_once_with_the_same_outcome(spark):
    names = CARD.split(", ")
    fields = [f.split()[0] for f in names]
    row = {"source": "x", "captured": "20240115000000", "gpu_model": "H100 SXM", "gpu_count": 8, "price_per_instance_hour": 24.0, "basis": "instance",
           "commitment": "on_demand", "form_factor": "sxm", "interconnect": "nvlink", "currency": "USD", "price_kind": "quoted"}
    rows = [dict(row, gpu_model=m) for m in ("H100 SXM", "H100 SXM", "A100 PCIE", "nothing known", None, "") for _ in range(2)]
    df = spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], CARD)
    once, each = B.restate(df, on_file=True), B.restate(df)
    show = lambda x: sorted(map(str, x.select("gpu_model", "index_code", "outcome", "normalized_usd_per_gpu_hour").collect()))
    assert show(once) == show(each) and once.count() == len(rows)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp" not in plan.lower()
