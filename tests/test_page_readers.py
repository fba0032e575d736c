"""Hand-written pages with written-out answers, one for each rule of the cleaner and the readers."""

import html
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from fixwright.functions import markup
from fixwright.operators import ratecards as C

PAGES = [
    ("<p>one</p><!-- <script> --><p>$2.00</p><script>x</script><p>three</p>", ["one", "$2.00", "three"]),
    ('<a href=foo"bar>$3.00</a>', ["$3.00"]),
    ("<p>a &#150; b &Ntilde; &#8211 x &amp;lt; &copy2 &notit; &bogus;</p>", ["a – b Ñ – x &lt; ©2 ¬it; &bogus;"]),
    ("<p>a</p><svg><text>hidden</p>", ["a"]),
    ("<p>a</p><template>x<template>y</template>z</template><p>b</p>", ["a", "b"]),
    ('<head><title>t</title><script>"</head>"</script><noscript>n</noscript></head><body>b', ["b"]),
    ("<svg/>shown<p>x", ["shown", "x"]),
    ('<p>a<b title="x > y">c</b></p>', ["a", "c"]),
    ("<p>x</p><script>never closed <p>y</p>", ["x"]),
    ("a<!-- open <p>b", ["a"]),
    ("<p data-x='1' data-y=\"'>\">q</p>", ["q"]),
    ("<p>5 &lt; 6 < 7</p>", ["5 < 6 < 7"]),
    ("<style>p{}</style ><p>x</p>", ["x"]),
    ("", []),
]


def test_cells(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)] + [(99, None)], "i int, html string")
    got = {r.i: r.c for r in rows.select("i", markup.cells("html").alias("c")).collect()}
    assert [got[i] for i in range(len(PAGES))] == [want for _, want in PAGES] and got[99] is None


def test_references_are_the_standard_s(spark):
    rng = random.Random(1)
    names = list(html5)
    part = lambda: rng.choice([
        "&" + rng.choice(names), f"&#{rng.randrange(70000)};", f"&#x{rng.randrange(1200000):x}", "a", " ", "&", ";", "&amp", "&nots",
        "&#" + "9" * 12 + ";", "&" + rng.choice(names)[:4],
    ])
    texts = ["".join(part() for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", markup.unescape(F.col("t")).alias("u")).collect()
    assert [(r.t, r.u) for r in rows if r.u != html.unescape(r.t)] == []


def page(*cells):
    return "".join(f"<td>{html.escape(c)}</td>" for c in cells)


@pytest.fixture(scope="module")
def read(spark):
    def go(reader, *cells, raw=None, joined=True):
        pages = spark.createDataFrame([("s", "20250101000000", page(*cells) if raw is None else raw)], "source string, captured string, html string")
        if reader in (C.embedded_records, C.structured_offers, C.row_attributes):
            rows = reader(pages)
        else:
            numbered = C.page_cells(pages)
            rows = reader(C.joined_prices(numbered) if joined else numbered)
        keep = ["gpu_model", "gpu_count", "price_per_instance_hour", "commitment", "form_factor"]
        return sorted(tuple(r[c] for c in keep) for r in rows.collect())

    return go


def test_a_counted_label_keeps_its_count(read):
    assert read(C.priced_table, "GPU", "On-demand price per hour", "8 x NVIDIA H100 SXM", "$23.6", "NVIDIA H200 SXM", "$3.5") == [
        ("H100 SXM", 8, 23.6, "on_demand", "sxm"), ("H200 SXM", 1, 3.5, "on_demand", "sxm")
    ]
    assert read(C.priced_table, "GPU", "On-demand price per GPU-hour", "8 x NVIDIA H100 SXM", "$2.95") == [
        ("H100 SXM", 8, 23.6, "on_demand", "sxm")
    ]


def test_an_instance_price_is_not_a_card_price(read):
    cells = ("On-demand GPU instances", "NVIDIA H100 SXM", "8", "80", "128", "2,048", "61.44", "$49.24", "NVIDIA H200 SXM", "3", "141", "$9.00")
    assert read(C.sized_instances, *cells) == [("H100 SXM", 8, 49.24, "on_demand", "sxm")]
    twice = ("On-demand GPU instances", "NVIDIA H100 SXM", "NVIDIA H100 SXM", "8", "80", "128", "$49.24")
    assert set(read(C.sized_instances, *twice)) == {("H100 SXM", 8, 49.24, "on_demand", "sxm")}  # rows that repeat collapse later
    assert read(C.sized_instances, *cells[1:]) == []


def test_component_prices_are_marked(spark, read):
    cells = ("GPU Component Cost Per Hour", "NVIDIA H100 PCIe", "80", "48", "256", "$4.25", "A100 40GB", "40", "n/a", "$2.06")
    assert read(C.component_table, *cells) == [("H100 PCIe", 1, 4.25, "on_demand", "pcie")]
    assert read(C.component_table, *cells[1:]) == []
    pages = spark.createDataFrame(
        [("s", "20250101000000", page("On-demand", "H100 SXM", "$", "2.40 per hour", "vCPU", "$0.01")),
         ("t", "20250101000000", page("On-demand", "H100 SXM", "$2.40 per hour"))], "source string, captured string, html string")
    cells = C.page_cells(pages)
    rows = C.component_priced(C.sectioned_list(C.joined_prices(cells)), cells).collect()
    assert sorted((r.source, r.price_per_instance_hour, r.basis) for r in rows) == [("s", 2.4, "gpu_component"), ("t", 2.4, "instance")]


def record(body):
    return "<script>" + "{'x'}" + '{"__typename": "GpuType", ' + body + "}</script>"


def test_a_null_price_is_no_price(read):
    raw = record('"displayName":"H100 SXM","id":"H100","memoryInGb":80,"securePrice":null,"communityPrice":2.5,"lowestPrice":{"securePrice":9.99}')
    assert read(C.embedded_records, raw=raw) == [("H100 SXM", 1, 2.5, "community", "sxm")]


def test_the_last_record_ends(read):
    raw = record('"displayName":"H100 SXM","communityPrice":2.5') + "z" * 3000 + '"securePrice": 9.99'
    assert read(C.embedded_records, raw=raw) == [("H100 SXM", 1, 2.5, "community", "sxm")]


PRODUCT = '{"@type":"Product","name":"%s GPU on Runpod","offers":%s}'
OFFER = '{"name":"%s","price":"%s","priceCurrency":"USD"}'


@pytest.mark.parametrize("wrap", ["%s", "[%s]", '{"@graph":[%s]}', '{"itemListElement":[{"item":%s}]}', '{"a":{"b":[[%s]]}}'])
@pytest.mark.parametrize("offers", ['{"offers":[%s]}', "[%s]"])
def test_offers_are_found_wherever_they_stand(read, wrap, offers):
    both = ",".join([OFFER % ("Secure Cloud", "2.99"), OFFER % ("Community Cloud", "2.49"), OFFER % ("Other", "1.0")])
    raw = '<script type="application/ld+json">' + wrap % (PRODUCT % ("H100 SXM", offers % both)) + "</script><script type='x'>{</script>"
    assert read(C.structured_offers, raw=raw) == [("H100 SXM", 1, 2.49, "community", "sxm"), ("H100 SXM", 1, 2.99, "on_demand", "sxm")]


def test_short_cells_name_the_form(read):
    assert read(C.counted_rows, "8x NVIDIA H100", "H100 SXM", "80 GB", "$23.92 / hr") == [("H100 SXM", 8, 23.92, "on_demand", "sxm")]


def test_market_cards(read):
    cells = ("Starting from $2.00/hr", "H100 SXM", "80GB VRAM", "$2.99/hr", "Secure Cloud", "$2.69/hr", "Community Cloud", "$9.0/hr", "Elsewhere",
             "H200 SXM", "141GB VRAM", "$3.99/hr", "Secure Cloud", "Starting from", "$1.0/hr", "Community Cloud")
    assert read(C.market_cards, *cells) == [
        ("H100 SXM", 1, 2.69, "community", "sxm"), ("H100 SXM", 1, 2.99, "on_demand", "sxm"), ("H200 SXM", 1, 3.99, "on_demand", "sxm")
    ]


def test_footnotes_state_on_demand_prices(spark):
    raw = page("H100", "$", "2.24*", "/ hour", "NVIDIA HGX H100 GPU", "* $2.24/hour pricing is for a 3-year commitment.",
               "On-demand pricing for H100 is $5.95 per hour.")
    pages = spark.createDataFrame([("s", "20250101000000", raw)], "source string, captured string, html string")
    cards = C.starred_cards(C.page_cells(pages), C.footnoted_terms(pages))
    rows = cards.unionByName(C.on_demand_notes(pages, cards)).collect()
    assert sorted((r.commitment, r.price_per_instance_hour, r.form_factor) for r in rows) == [("on_demand", 5.95, "sxm"), ("reserved", 2.24, "sxm")]


def test_repeated_tables_count_once(spark):
    cells = ("On-demand", "H100 SXM", "$2.40", "H100 SXM", "$2.40", "H100 SXM", "$2.50")
    pages = spark.createDataFrame([("s", "20250101000000", page(*cells))], "source string, captured string, html string")
    rows = C.stated_once(C.sectioned_list(C.page_cells(pages))).collect()
    assert sorted(r.price_per_instance_hour for r in rows) == [2.4, 2.5]


LABELS = [
    None, "", "H100", "NVIDIA H100 SXM5 80GB", "8 x nvidia h100 pcie", "GB200 NVL72", "GH-200", "G H200", "gb_200 H100", "GB 200 and H100", "H800 H100", "B100 H100",
    "A100-40GB", "A100 /40 GB", "xH100", "H1000", "H100NVL", "H100\tNVL", "h200 nvl", "B200 HGX", "B300 B200", "H 100", "NVLINK A100", "PCI E A100", "L40S", "100200", "ẖ100",
]


def test_a_product_is_named_where_a_label_has_a_reading(spark):
    """The short question has the answer of the whole reading, for labels however they are spaced."""
    rows = spark.createDataFrame([(x,) for x in LABELS], "cell string")
    got = rows.select("cell", C.names_product("cell").alias("named"), C.label_reading("cell").isNotNull().alias("read")).collect()
    assert [r.cell for r in got if r.named != r.read] == [] and {r.named for r in got} == {True, False}


def test_the_first_amount_is_the_first_of_all_and_spaces_fold_once(spark):
    texts = [None, "", "$", "$1,234.50 $2", "from $ 3", "$1234", "a $0.5/hr", "no 4"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", markup.first_amount("t").alias("one"), F.get(markup.amounts("t"), F.lit(0)).alias("all"))
    assert [r.t for r in rows.collect() if r.one != r["all"]] == []
    spaced = ["a b", " a", "a  b ", "a\tb", "a\n  b", " ", "a \u0001 b", "\u0085x", "café x", None]
    rows = spark.createDataFrame([(x,) for x in spaced], "t string").select("t", markup.folded(F.col("t")).alias("now"), F.regexp_replace("t", r"(?U)\s+", " ").alias("then"))
    assert [r.t for r in rows.collect() if r.now != r.then] == []


def test_cells_of_a_page_with_odd_spaces_and_references(spark):
    html = "<body>\n<P>a&nbsp;&#32; b</p><Strong>x</STRONG\n>y<strongly>z</strongly><td class='>'>1\t 2</td><br/>&amp;&#10;<small>q</small></body>"
    assert spark.createDataFrame([(html,)], "html string").select(markup.cells("html").alias("c")).first().c == ["a b", "x", "yz", "1 2", "&", "q"]
