"""Queries over landed payloads, archived pages and the back-series."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import markup
from ..operators import backseries as B
from ..operators import ratecards as C
from ..operators import tape as T
from ..sources import feeds, listings
from .registry import day, r6, register
from .sql import piece, query
from .workspace import KEYS

# --- landed payloads ----------------------------------------------------------


def _documents(ws, element, name: str, where: str = "true"):
    """Line items as landed documents, one per order: a bounded list of at most a few items."""
    li = ws.table("lineitem").join(ws.table("part"), F.col("p_partkey") == F.col("l_partkey")).where(where)
    items = li.groupBy("l_orderkey").agg(F.collect_list(element).alias("items"), F.min("l_shipdate").alias("captured_at"))
    return items.select(
        F.col("l_orderkey").alias("doc"), "captured_at", F.to_json(F.struct(F.col("items").alias(name))).alias("payload")
    )


PART_LABEL = """CASE p.p_type WHEN 'ECONOMY' THEN 'H100 SXM' WHEN 'STANDARD' THEN 'H200' WHEN 'MEDIUM' THEN 'A100 PCIE'
  WHEN 'PROMO' THEN 'B200' WHEN 'LARGE' THEN 'H100 NVL' ELSE 'RTX 4090' END"""


def _part_label():
    t = F.col("p_type")
    return (
        F.when(t == "ECONOMY", "H100 SXM").when(t == "STANDARD", "H200").when(t == "MEDIUM", "A100 PCIE")
        .when(t == "PROMO", "B200").when(t == "LARGE", "H100 NVL").otherwise("RTX 4090")
    )


FORM_OF = "CASE WHEN contains({b}, 'sxm') THEN 'sxm' WHEN contains({b}, 'pcie') OR contains({b}, 'nvl') THEN 'pcie' ELSE 'unknown' END"
FABRIC_OF = "CASE WHEN contains({b}, 'nvl') OR contains({b}, 'sxm') THEN 'nvlink' WHEN contains({b}, 'infiniband') THEN 'infiniband' WHEN contains({b}, 'ethernet') THEN 'ethernet' WHEN contains({b}, 'pcie') THEN 'none' ELSE 'unknown' END"


@register(
    "feed_offers",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS doc, gpu_name || ':' || id AS source_sku, gpu_name AS gpu_model, gpus AS gpu_count, round(dph, 6) AS usd_per_hour_total,
        {FORM_OF.format(b='lower(gpu_name)')} AS form_factor, {FABRIC_OF.format(b='lower(gpu_name)')} AS interconnect, region,
        CASE WHEN rentable AND rel >= 0.95e0 THEN 1 ELSE 2 END AS tier, machine_id
        FROM (SELECT l.*, {PART_LABEL} AS gpu_name, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_linenumber % 4 * 2 AS gpus,
          l_extendedprice / 10000e0 AS dph, l_returnflag <> 'R' AS rentable, CASE WHEN l_linenumber <> 5 THEN 1 - l_discount END AS rel,
          CASE WHEN l_linestatus = 'F' THEN 'Texas, US' END AS region, l_partkey AS machine_id
          FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey) WHERE gpus > 0""",
)
def _(ws):
    """Orders as marketplace book documents."""
    offer = F.struct(
        F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
        _part_label().alias("gpu_name"),
        (F.col("l_linenumber") % 4 * 2).alias("num_gpus"), (F.col("l_extendedprice") / 10000.0).alias("dph_total"),
        (F.col("l_returnflag") != "R").alias("rentable"),
        F.when(F.col("l_linenumber") != 5, 1 - F.col("l_discount")).alias("reliability2"),
        F.when(F.col("l_linestatus") == "F", "Texas, US").alias("geolocation"), F.col("l_partkey").alias("machine_id"),
    )
    rows = feeds.marketplace_offers(_documents(ws, offer, "offers"), "payload", ["doc"])
    return rows.select(
        F.col("doc").cast("string").alias("doc"), "source_sku", "gpu_model", "gpu_count", r6("usd_per_hour_total"), "form_factor", "interconnect", "region", "tier",
        "machine_id",
    )


@register(
    "feed_catalogue",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS doc, 'shadeform:cloud' || l_suppkey AS source, l_partkey || 'x' || l_linenumber AS source_sku, model AS gpu_model, l_linenumber AS gpu_count,
        round(l_extendedprice / 100e0, 6) AS usd_per_hour_total, {FORM_OF.format(b="lower(concat_ws(' ', fabric, model))")} AS form_factor,
        CASE WHEN l_returnflag = 'A' THEN 'nvlink' ELSE {FABRIC_OF.format(b='fabric')} END AS interconnect,
        CASE WHEN l_linestatus = 'F' THEN 'two' ELSE 'One' END AS region, CASE WHEN l_linestatus = 'F' OR l_returnflag = 'N' THEN 1 ELSE 2 END AS tier
        FROM (SELECT l.*, {PART_LABEL} AS model, CASE l_linenumber % 3 WHEN 0 THEN 'infiniband' WHEN 1 THEN 'ethernet' ELSE 'sxm5' END AS fabric
          FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)""",
)
def _(ws):
    """Orders as aggregator catalogue documents; regions are live or not by the line's flags."""
    one_live = (F.col("l_linestatus") != "F") & (F.col("l_returnflag") == "N")
    place = lambda region, shown, live: F.struct(
        F.lit(region).alias("region"), F.lit(shown).alias("display_name"), live.alias("available")
    )
    item = F.struct(
        F.concat(F.lit("cloud"), F.col("l_suppkey").cast("string")).alias("cloud"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("x"), F.col("l_linenumber").cast("string")).alias("cloud_instance_type"),
        F.col("l_linenumber").alias("num_gpus"), F.col("l_extendedprice").alias("hourly_price"),
        F.when(F.col("l_linenumber") % 3 == 0, "infiniband").when(F.col("l_linenumber") % 3 == 1, "ethernet").otherwise("sxm5").alias("interconnect"),
        F.struct(_part_label().alias("gpu_type"), (F.col("l_returnflag") == "A").alias("nvlink")).alias("configuration"),
        F.array(place("one", "One", one_live), place("two", "", F.col("l_linestatus") == "F")).alias("availability"),
    )
    rows = feeds.aggregator_catalogue(_documents(ws, item, "instance_types"), "payload", ["doc"])
    return rows.select(
        F.col("doc").cast("string").alias("doc"), "source", "source_sku", "gpu_model", "gpu_count", r6("usd_per_hour_total"), "form_factor", "interconnect",
        "region", "tier",
    )


@register(
    "feed_two_price",
    f"""SELECT p_partkey AS doc, 'runpod' AS source, label || ':' || m.market AS source_sku, m.commitment, round(m.price, 6) AS usd_per_hour_total,
        {FORM_OF.format(b='lower(label)')} AS form_factor FROM (SELECT p_partkey, {PART_LABEL} AS label, unnest(list_filter([
          {{'market': 'secure', 'commitment': 'on_demand', 'price': p_retailprice / 300e0}},
          {{'market': 'community', 'commitment': 'community', 'price': CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 0e0 ELSE p_retailprice / 400e0 END}}],
          lambda x: x.price > 0)) AS m FROM part p)
        UNION ALL SELECT p_partkey, 'datacrunch', p_partkey || 'V:' || m.market, m.commitment, round(m.price, 6), {FORM_OF.format(b='lower(label)')}
        FROM (SELECT p_partkey, {PART_LABEL} AS label, unnest(list_filter([
          {{'market': 'ondemand', 'commitment': 'on_demand', 'price': p_retailprice / 100e0}},
          {{'market': 'spot', 'commitment': 'spot', 'price': CASE WHEN p_size % 2 = 0 THEN p_retailprice / 200e0 END}}], lambda x: x.price > 0)) AS m FROM part p)""",
)
def _(ws):
    """Parts as two-price catalogue documents in both shapes."""
    part = ws.table("part")
    third = F.when(F.col("p_size") % 3 == 1, 0.0).when(F.col("p_size") % 3 == 2, F.col("p_retailprice") / 400.0)
    secure = F.to_json(
        F.struct(F.struct(F.array(F.struct(
            _part_label().alias("id"), (F.col("p_retailprice") / 300.0).alias("securePrice"), third.alias("communityPrice"),
        )).alias("gpuTypes")).alias("data"))
    )
    instance = F.to_json(
        F.array(F.struct(
            F.concat(F.col("p_partkey").cast("string"), F.lit("V")).alias("instance_type"),
            F.struct(F.concat(F.lit("8x "), _part_label()).alias("description"), F.lit(8).alias("number_of_gpus")).alias("gpu"),
            (F.col("p_retailprice") / 100.0).cast("string").alias("price_per_hour"),
            F.when(F.col("p_size") % 2 == 0, (F.col("p_retailprice") / 200.0).cast("string")).otherwise("0.000").alias("spot_price"),
        ))
    )
    docs = part.select(
        F.col("p_partkey").alias("doc"), F.lit("2026-01-01").cast("timestamp").alias("captured_at"),
        secure.alias("secure"), instance.alias("instance"),
    )
    rows = feeds.secure_and_community(docs, "secure", ["doc"]).unionByName(feeds.on_demand_and_spot(docs, "instance", ["doc"]))
    return rows.select("doc", "source", "source_sku", "commitment", r6("usd_per_hour_total"), "form_factor")


def _curated_docs(ws):
    card = F.struct(
        F.col("p_brand").alias("vendor"), F.col("p_partkey").cast("string").alias("sku"), _part_label().alias("gpu_model"),
        F.lit(8).alias("gpu_count"), (F.col("p_retailprice") / 20.0).alias("usd_per_hour_total"),
        F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd").alias("as_of"),
    )
    return ws.table("part").select(
        F.col("p_partkey").alias("doc"), F.lit("2026-02-20").cast("timestamp").alias("captured_at"),
        F.to_json(F.array(card)).alias("payload"),
    )


@register(
    "feed_curated",
    f"""SELECT 'curated:' || p_brand AS source, CAST(p_partkey AS VARCHAR) AS source_sku, {PART_LABEL} AS gpu_model, round(p_retailprice / 20e0, 6) AS usd_per_hour_total,
        3 AS tier, CAST(DATE '2026-01-01' + p_size AS VARCHAR) AS observed_on FROM part p WHERE DATE '2026-02-20' - (DATE '2026-01-01' + p_size) <= 45""",
)
def _(ws):
    fresh, _ = feeds.curated_cards(_curated_docs(ws), "payload", "2026-02-20")
    return fresh.select("source", "source_sku", "gpu_model", r6("usd_per_hour_total"), "tier", day("observed_at", "observed_on"))


@register(
    "curated_stale",
    """SELECT p_brand AS vendor, CAST(p_partkey AS VARCHAR) AS sku, CAST(DATE '2026-02-20' - (DATE '2026-01-01' + p_size) AS BIGINT) AS age_days
       FROM part WHERE DATE '2026-02-20' - (DATE '2026-01-01' + p_size) > 45""",
)
def _(ws):
    _, stale = feeds.curated_cards(_curated_docs(ws), "payload", "2026-02-20")
    return stale.select("vendor", "sku", F.col("age_days").cast("long").alias("age_days"))


@register(
    "collection_summary",
    query("""SELECT r.snapshot, f.feed, coalesce(c.n, 0) AS "rows",
        CASE WHEN f.feed IN ('runpod') THEN 'provider_unreachable' WHEN coalesce(c.n, 0) = 0 THEN 'provider_empty' END AS code
        FROM (SELECT DISTINCT snapshot FROM obs) r CROSS JOIN (SELECT unnest(['desk', 'vastai', 'feed1', 'feed2', 'feed4', 'runpod', 'curated']) AS feed) f
        LEFT JOIN (SELECT snapshot, string_split(source, ':')[1] AS feed, count(*) AS n FROM obs GROUP BY ALL) c ON c.snapshot = r.snapshot AND c.feed = f.feed""", "obs"),
)
def _(ws):
    """Seven expected feeds; one never lands a payload and one lands an empty one."""
    names = ["desk", "vastai", "feed1", "feed2", "feed4", "runpod", "curated"]
    runs = ws.observations().select("snapshot").distinct()
    landed = runs.select("snapshot", F.explode(F.array(*[F.lit(n) for n in names if n != "runpod"])).alias("feed"))
    return feeds.collection_summary(ws.observations(), ["snapshot"], landed, names).select("snapshot", "feed", "rows", "code")


# --- archived pages -----------------------------------------------------------
@register(
    "page_manifest",
    "SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS bytes FROM pages",
)
def _(ws):
    return C.manifest(ws.table("pages"), ["page_id"])


SKIP_SQL = "html"
for _tag in markup.SKIPPED:
    SKIP_SQL = f"regexp_replace({SKIP_SQL}, '(?is)<{_tag}[\\s>].*?</{_tag}\\s*>', '', 'g')"
SKIP_SQL = f"regexp_replace({SKIP_SQL}, '(?s)<!--.*?-->', '', 'g')"
_BLOCK_SQL = f"regexp_replace({SKIP_SQL}, '(?i)</?({'|'.join(markup.BLOCKS)})([\\s/][^>]*)?>', chr(1), 'g')"
_TEXT_SQL = f"regexp_replace({_BLOCK_SQL}, '<[!?/a-zA-Z][^>]*>', '', 'g')"
CELLS_SQL = f"""SELECT page_id, generate_subscripts(cs, 1) - 1 AS pos, unnest(cs) AS cell FROM (SELECT page_id,
  list_filter(list_transform(string_split({_TEXT_SQL}, chr(1)), lambda c: trim(regexp_replace(replace(replace(replace(replace(c,
    '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g'))), lambda c: c <> '') AS cs FROM pages)"""


@register("page_cells", CELLS_SQL)
def _(ws):
    rows = C.page_cells(ws.table("pages"), ["page_id"])
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "cell")


# --- price pages generated from parts, one page per part ------------------------
MODEL_ON_PAGE = """CASE p_type WHEN 'ECONOMY' THEN 'NVIDIA H100 SXM' WHEN 'STANDARD' THEN 'H200-PCIe' WHEN 'MEDIUM' THEN 'A100 40GB'
  WHEN 'PROMO' THEN 'HGX B200' WHEN 'LARGE' THEN 'H100 NVL' ELSE 'GH200' END"""
READING = """CASE p_type WHEN 'ECONOMY' THEN 'H100 SXM' WHEN 'STANDARD' THEN 'H200' WHEN 'MEDIUM' THEN 'A100 40GB' WHEN 'PROMO' THEN 'B200 SXM'
  WHEN 'LARGE' THEN 'H100 NVL' END"""
READ_FORM = "CASE p_type WHEN 'ECONOMY' THEN 'sxm' WHEN 'STANDARD' THEN 'pcie' WHEN 'MEDIUM' THEN 'unknown' WHEN 'PROMO' THEN 'sxm' WHEN 'LARGE' THEN 'pcie' END"
READ_FABRIC = "CASE p_type WHEN 'ECONOMY' THEN 'nvlink' WHEN 'STANDARD' THEN 'none' WHEN 'MEDIUM' THEN 'unknown' WHEN 'PROMO' THEN 'nvlink' WHEN 'LARGE' THEN 'nvlink' END"


def _shown():
    t = F.col("p_type")
    return (
        F.when(t == "ECONOMY", "NVIDIA H100 SXM").when(t == "STANDARD", "H200-PCIe").when(t == "MEDIUM", "A100 40GB")
        .when(t == "PROMO", "HGX B200").when(t == "LARGE", "H100 NVL").otherwise("GH200")
    )


def _money(divisor: float):
    return F.concat(F.lit("$"), F.format_string("%.2f", F.floor(F.col("p_retailprice") / divisor * 100) / 100))


def _page(ws, html):
    captured = F.concat(F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), F.col("p_size")), "yyyyMMdd"), F.lit("000000"))
    return ws.table("part").select(
        F.concat(F.lit("page"), F.col("p_partkey").cast("string")).alias("source"), captured.alias("captured"), html.alias("html")
    )


AMOUNT = "floor(p_retailprice / {0} * 100) / 100"
CAPTURED = "strftime(DATE '2025-01-01' + p_size, '%Y%m%d') || '000000' AS captured"


@register(
    "label_reading",
    f"SELECT p_partkey, {READING} AS gpu_model, {READ_FORM} AS form_factor, {READ_FABRIC} AS interconnect, CASE p_type WHEN 'MEDIUM' THEN '40' END AS memory FROM part",
)
def _(ws):
    read = C.label_reading("shown")
    rows = ws.table("part").withColumn("shown", _shown()).select("p_partkey", read.alias("gpu"))
    return rows.select(
        "p_partkey", "gpu.gpu_model", "gpu.form_factor", "gpu.interconnect", F.col("gpu.vram_gb").cast("string").alias("memory")
    )


def _table_page(ws):
    """A strip of price headers, then rows; sizes decide placeholders and small print."""
    slot = F.when(F.col("p_size") % 4 == 0, F.lit("contact sales")).otherwise(F.concat(_money(300.0), F.lit("/hr")))
    html = F.concat(
        F.lit("<html><head><title>$9.99/hr price</title></head><body><h2>On-Demand Cloud Pricing</h2><table><tr><th>GPU</th><th>VRAM</th>"
              "<th>On-Demand Price (/hr)</th><th>6 Month Price (/hr)</th><th>Spot price</th></tr><tr><td>"),
        _shown(), F.lit("</td><td>80</td><td>"), slot, F.lit("</td><td>"), _money(400.0), F.lit("</td><td>"), _money(500.0),
        F.lit("</td>"), F.when(F.col("p_size") % 5 == 0, "<td>annual contract</td>").otherwise(""),
        F.lit("</tr><tr><td>L40S</td><td>$1.00</td></tr></table>"),
        F.when(F.col("p_size") % 7 == 0, "<p>Max vCPUs per GPU ($0.01/hr)</p>").otherwise("<p>that is all</p>"), F.lit("</body></html>"),
    )
    return _page(ws, html)


@register(
    "priced_table",
    f"""SELECT 'page' || p_partkey AS source, {CAPTURED}, s.header AS header, s.commitment, round(s.price, 6) AS price, {READING} AS gpu_model,
        {READ_FORM} AS form_factor, CASE p_type WHEN 'MEDIUM' THEN 40 ELSE 80 END AS vram_gb, CASE WHEN p_size % 7 = 0 THEN 'gpu_component' ELSE 'instance' END AS basis
        FROM (SELECT *, unnest(list_filter([
          CASE WHEN p_size % 4 <> 0 AND p_size % 5 <> 0 THEN {{'header': 'On-Demand Price (/hr)', 'commitment': 'on_demand', 'price': {AMOUNT.format('300e0')}}} END,
          {{'header': '6 Month Price (/hr)', 'commitment': 'reserved', 'price': {AMOUNT.format('400e0')}}},
          {{'header': 'Spot price', 'commitment': 'spot', 'price': {AMOUNT.format('500e0')}}}], lambda x: x IS NOT NULL)) AS s
        FROM part WHERE p_type <> 'SMALL')""",
)
def _(ws):
    cells = C.page_cells(_table_page(ws))
    rows = C.component_priced(C.priced_table(cells), cells)
    header = F.regexp_extract("sku", r"\[(.*)\]$", 1)
    return rows.select(
        "source", "captured", header.alias("header"), "commitment", r6("price_per_instance_hour", "price"), "gpu_model",
        "form_factor", "vram_gb", "basis",
    )


@register(
    "instance_table",
    f"""SELECT 'page' || p_partkey AS source, {CAPTURED}, s.commitment, round(s.price, 6) AS price, {READING} AS gpu_model, n AS gpu_count
        FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 8 ELSE 1 END AS n, unnest([{{'commitment': 'on_demand', 'price': {AMOUNT.format('40e0')}}},
          {{'commitment': 'reserved', 'price': {AMOUNT.format('60e0')}}}]) AS s FROM part WHERE p_type <> 'SMALL' AND p_size % 3 <> 0)""",
)
def _(ws):
    """Instance names carry the count; a third of the pages state another one and are not read."""
    n = F.when(F.col("p_size") % 2 == 0, "8").otherwise("1")
    stated = F.when(F.col("p_size") % 3 == 0, "4").otherwise(n)
    html = F.concat(
        F.lit("<body><table><tr><th>Instance name</th><th>On demand price</th><th>2-year price</th></tr><tr><td>"), n,
        F.lit("H100.80S.176V</td><td>"), _shown(), F.lit("</td><td>"), stated, F.lit("</td><td>176</td><td>"), _money(40.0),
        F.lit("/h</td><td>"), _money(60.0), F.lit("/h</td></tr></table></body>"),
    )
    rows = C.instance_table(C.page_cells(_page(ws, html)))
    return rows.select("source", "captured", "commitment", r6("price_per_instance_hour", "price"), "gpu_model", "gpu_count")


@register(
    "sectioned_list",
    f"""SELECT 'page' || p_partkey AS source, {CAPTURED}, s.commitment, s.kind AS price_kind, round(s.price, 6) AS price, {READING} AS gpu_model
        FROM (SELECT *, unnest([{{'commitment': 'on_demand', 'kind': 'quoted', 'price': {AMOUNT.format('300e0')}}},
          {{'commitment': 'reserved', 'kind': 'from_floor', 'price': {AMOUNT.format('450e0')}}}]) AS s FROM part WHERE p_type <> 'SMALL')""",
)
def _(ws):
    html = F.concat(
        F.lit("<body><h2>On-Demand GPU Pricing</h2><ul><li>"), _shown(), F.lit("</li><li>80 GB</li><li>"), _money(300.0),
        F.lit(" per hour</li><li>"), _money(100.0), F.lit("</li></ul><h2>Reservation Pricing</h2><p>"), _shown(),
        F.lit("</p><p>Starts from</p><p>"), _money(450.0), F.lit("/hour</p></body>"),
    )
    rows = C.sectioned_list(C.page_cells(_page(ws, html)))
    return rows.select("source", "captured", "commitment", "price_kind", r6("price_per_instance_hour", "price"), "gpu_model")


@register(
    "split_price_table",
    f"""SELECT 'page' || p_partkey AS source, {CAPTURED}, s.commitment, round(s.price, 6) AS price, 'H100 SXM' AS gpu_model, 80 AS vram_gb
        FROM (SELECT *, unnest(list_filter([{{'commitment': 'on_demand', 'price': {AMOUNT.format('300e0')}}},
          CASE WHEN p_size % 3 <> 0 THEN {{'commitment': 'spot', 'price': {AMOUNT.format('600e0')}}} END,
          {{'commitment': 'reserved', 'price': {AMOUNT.format('400e0')}}}], lambda x: x IS NOT NULL)) AS s FROM part)""",
)
def _(ws):
    """Bare commitments as headers, prices over three cells, and a spot price that is sometimes missing."""
    split = lambda divisor: F.concat(
        F.lit("<td><b>$</b><b>"), F.substring(_money(divisor), 2, 20), F.lit("</b><b>/hr</b></td>")
    )
    spot = F.when(F.col("p_size") % 3 == 0, F.lit("<td>Contact Sales</td>")).otherwise(split(600.0))
    html = F.concat(
        F.lit("<body><div>On-Demand</div><div>Current Spot</div><div>6-month reserved</div><table><tr><td>NVIDIA H100</td>"
              "<td>80GB</td><td>SXM</td>"), split(300.0), spot, split(400.0), F.lit("</tr></table></body>"),
    )
    cells = C.joined_prices(C.page_cells(_page(ws, html)))
    rows = C.priced_table(cells, strips="commitment", max_label=30)
    return rows.select("source", "captured", "commitment", r6("price_per_instance_hour", "price"), "gpu_model", "vram_gb")


@register(
    "counted_rows",
    f"""SELECT 'page' || p_partkey AS source, {CAPTURED}, s.commitment, s.n AS gpu_count, round(s.price, 6) AS price
        FROM (SELECT *, unnest([{{'commitment': 'on_demand', 'n': 8, 'price': {AMOUNT.format('300e0')} * 8}},
          {{'commitment': CASE WHEN p_size % 2 = 0 THEN 'reserved' ELSE 'on_demand' END, 'n': 1, 'price': {AMOUNT.format('400e0')}}},
          {{'commitment': 'reserved', 'n': 2, 'price': {AMOUNT.format('100e0')}}}]) AS s FROM part)""",
)
def _(ws):
    """Per-GPU and per-instance prices, a stated term, and a reserved section."""
    term = F.when(F.col("p_size") % 2 == 0, "<td>1 year</td>").otherwise("<td>no term</td>")
    html = F.concat(
        F.lit("<body><h2>On-demand instances</h2><table><tr><td>8x NVIDIA H100 SXM</td><td>80 GB</td><td>208</td><td>"), _money(300.0),
        F.lit(" / GPU / hr</td></tr><tr><td>1x NVIDIA H100</td><td>80 GB</td><td>"), _money(400.0), F.lit(" / hr</td>"), term,
        F.lit("</tr></table><h2>Reserved clusters</h2><p>2x NVIDIA A100</p><p>"), _money(100.0), F.lit(" / hr</p></body>"),
    )
    rows = C.counted_rows(C.page_cells(_page(ws, html)))
    return rows.select("source", "captured", "commitment", "gpu_count", r6("price_per_instance_hour", "price"))


@register(
    "tabbed_rows",
    f"""SELECT 'page' || p_partkey AS source, {CAPTURED}, s.n AS gpu_count, round(s.price, 6) AS price, {READING} AS gpu_model
        FROM (SELECT *, unnest([{{'n': 8, 'price': {AMOUNT.format('300e0')} * 8}}, {{'n': 1, 'price': {AMOUNT.format('250e0')}}}]) AS s FROM part WHERE p_type IN ('ECONOMY', 'LARGE'))""",
)
def _(ws):
    """Two tabs, two tables; a third table has no tab and is not read."""
    label = F.when(F.col("p_type").isin("ECONOMY", "LARGE"), F.concat(F.lit("NVIDIA "), F.replace(_shown(), F.lit("NVIDIA "), F.lit("")))).otherwise("NVIDIA L4")
    table = lambda divisor: F.concat(
        F.lit("<p>PRICE/GPU/HR*</p><p>"), label, F.lit("</p><p>80 GB</p><p>26</p><p>"), _money(divisor), F.lit("</p>")
    )
    html = F.concat(F.lit("<body><p>8x</p><p>1x</p>"), table(300.0), table(250.0), table(100.0), F.lit("</body>"))
    rows = C.tabbed_rows(C.page_cells(_page(ws, html)))
    return rows.select("source", "captured", "gpu_count", r6("price_per_instance_hour", "price"), "gpu_model")


@register(
    "two_column_list",
    f"""SELECT 'page' || p_partkey AS source, {CAPTURED}, s.commitment, s.kind AS price_kind, round(s.price, 6) AS price
        FROM (SELECT *, unnest(list_filter([{{'commitment': 'on_demand', 'kind': 'quoted', 'price': {AMOUNT.format('300e0')}}},
          CASE WHEN p_size % 2 = 0 THEN {{'commitment': 'reserved', 'kind': 'from_floor', 'price': {AMOUNT.format('450e0')}}} END,
          {{'commitment': 'spot', 'kind': 'quoted', 'price': {AMOUNT.format('600e0')}}}], lambda x: x IS NOT NULL)) AS s FROM part WHERE p_type <> 'SMALL')""",
)
def _(ws):
    floor = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<p>Starts from</p><p>"), _money(450.0), F.lit("/hour</p>"))).otherwise("")
    html = F.concat(
        F.lit("<body><p>Pricing Per</p><p>Hour</p><p>Reservation</p><p>Pricing</p><p>"), _shown(), F.lit("</p><p>"), _money(300.0),
        F.lit(" per Hour</p>"), floor, F.lit("<h2>Spot VM Pricing</h2><p>"), _shown(), F.lit("</p><p>"), _money(600.0), F.lit("/hour</p><p>"),
        _money(90.0), F.lit("/hour</p></body>"),
    )
    rows = C.sectioned_list(C.page_cells(_page(ws, html)))
    return rows.select("source", "captured", "commitment", "price_kind", r6("price_per_instance_hour", "price"))


@register(
    "offer_cards",
    f"""SELECT 'page' || p_partkey AS source, {CAPTURED}, CASE WHEN p_size % 2 = 0 THEN 'on_demand' ELSE 'reserved' END AS commitment, 8 AS gpu_count,
        round({AMOUNT.format('400e0')} * 8, 6) AS price, CASE WHEN p_size % 3 = 0 THEN 'infiniband' WHEN p_size % 3 = 1 THEN 'ethernet' ELSE 'nvlink' END AS interconnect
        FROM part""",
)
def _(ws):
    fabric = F.when(F.col("p_size") % 3 == 0, ", 3200 Gbps Infiniband").when(F.col("p_size") % 3 == 1, ", Ethernet").otherwise("")
    html = F.concat(
        F.lit("<body><h3>"), F.when(F.col("p_size") % 2 == 0, "On-demand").otherwise("Long-Term"), fabric, F.lit("</h3><p>"), _money(400.0),
        F.lit("/hr</p><p>Pay only for what you need.</p><p>8-1016 HGX H100 GPUs</p><h3>Reserve</h3><p>Contact for pricing</p></body>"),
    )
    rows = C.offer_cards(C.page_cells(_page(ws, html)))
    return rows.select("source", "captured", "commitment", "gpu_count", r6("price_per_instance_hour", "price"), "interconnect")


@register(
    "price_cards",
    f"""SELECT 'page' || p_partkey AS source, {CAPTURED}, CASE WHEN p_size % 3 = 0 THEN 'reserved' ELSE 'on_demand' END AS commitment,
        CASE WHEN p_size % 2 = 0 THEN 8 ELSE 1 END AS gpu_count,
        round({AMOUNT.format('400e0')} * CASE WHEN p_size % 2 = 0 THEN 8 ELSE 1 END, 6) AS price, {READING} AS gpu_model FROM part WHERE p_type <> 'SMALL'""",
)
def _(ws):
    """Two prices on a card: the first is struck through, the second is charged."""
    kind = F.when(F.col("p_size") % 3 == 0, "Reserved Price").otherwise("On-Demand Price*")
    count = F.when(F.col("p_size") % 2 == 0, "<li>GPUs per Droplet</li><li>8</li>").otherwise("<li>other</li>")
    html = F.concat(
        F.lit("<body><div>NVIDIA "), F.replace(_shown(), F.lit("NVIDIA "), F.lit("")), F.lit("</div><div>"), _money(300.0), F.lit("</div><div>/GPU/hour</div><div>"), _money(400.0),
        F.lit("</div><div>/GPU/hour*</div><div>"), kind, F.lit("</div><ul>"), count, F.lit("</ul></body>"),
    )
    rows = C.price_cards(C.page_cells(_page(ws, html)))
    return rows.select("source", "captured", "commitment", "gpu_count", r6("price_per_instance_hour", "price"), "gpu_model")


@register(
    "footnoted_cards",
    f"""SELECT 'page' || p_partkey AS source, {CAPTURED}, CASE WHEN p_size % 2 = 0 THEN 'reserved' ELSE 'on_demand' END AS commitment,
        round({AMOUNT.format('300e0')}, 6) AS price, CASE WHEN p_size % 2 = 0 THEN '3-year commitment' ELSE 'hourly card' END AS note
        FROM part WHERE p_type IN ('ECONOMY', 'LARGE') AND p_size % 6 <> 4""",
)
def _(ws):
    """Starred prices mean what their footnote says; a sixth of the pages lost the footnote."""
    starred = F.col("p_size") % 2 == 0
    amount = F.replace(_money(300.0), F.lit("$"), F.lit(""))
    spec = F.when(F.col("p_type").isin("ECONOMY", "LARGE"), "NVIDIA HGX H100 GPU").otherwise("NVIDIA A100 GPU")
    foot = F.when(
        starred & (F.col("p_size") % 6 != 4), F.concat(F.lit("<p>*"), _money(300.0), F.lit("/hour pricing is for a 3-year commitment.</p>"))
    ).otherwise("")
    html = F.concat(
        F.lit("<body><h3>H100</h3><span>$</span><span>"), amount, F.when(starred, "*").otherwise(""),
        F.lit("</span><span>/ hour</span><p>"), spec, F.lit("</p>"), foot, F.lit("</body>"),
    )
    pages = _page(ws, html)
    rows = C.starred_cards(C.page_cells(pages), C.footnoted_terms(pages))
    return rows.select("source", "captured", "commitment", r6("price_per_instance_hour", "price"), "note")


def _record_pages(ws):
    """Three ways to embed prices, by size: typed records, row attributes, schema.org offers."""
    name = F.concat(_shown(), F.lit(""))
    record = F.concat(
        F.lit('<script>x={\\"__typename\\": \\"GpuType\\", \\"displayName\\": \\"'), name, F.lit('\\", \\"memoryInGb\\": 80, \\"securePrice\\": '),
        F.substring(_money(300.0), 2, 20), F.lit(', \\"communityPrice\\": null, \\"secureSpotPrice\\": '), F.substring(_money(600.0), 2, 20), F.lit("}</script>"),
    )
    attribute = F.concat(
        F.lit('<div class="gpu_table-row" data-secure="'), F.substring(_money(300.0), 2, 20), F.lit('" data-community-cloud-price="'),
        F.substring(_money(600.0), 2, 20), F.lit('"><div class="gpu_name big">'), name, F.lit("</div><div>80 GB VRAM</div></div>"),
    )
    offer = lambda label, amount: F.concat(
        F.lit('{"name": "'), F.lit(label), F.lit('", "priceCurrency": "USD", "price": "'), F.substring(amount, 2, 20), F.lit('"}')
    )
    ld = F.concat(
        F.lit('<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "'), name,
        F.lit(' GPU on Runpod", "offers": {"offers": ['), offer("Secure Cloud", _money(300.0)), F.lit(", "),
        offer("Community Cloud", _money(600.0)), F.lit("]}}]}</script>"),
    )
    body = F.when(F.col("p_size") % 3 == 0, record).when(F.col("p_size") % 3 == 1, attribute).otherwise(ld)
    return _page(ws, F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")))


@register(
    "embedded_prices",
    f"""SELECT 'page' || p_partkey AS source, {CAPTURED}, s.commitment, round(s.price, 6) AS price,
        CASE WHEN p_type = 'MEDIUM' AND p_size % 3 < 2 THEN 'A100' ELSE {READING} END AS gpu_model
        FROM (SELECT *, unnest([{{'commitment': 'on_demand', 'price': {AMOUNT.format('300e0')}}},
          {{'commitment': CASE WHEN p_size % 3 = 0 THEN 'spot' ELSE 'community' END, 'price': {AMOUNT.format('600e0')}}}]) AS s FROM part WHERE p_type <> 'SMALL')""",
)
def _(ws):
    pages = _record_pages(ws)
    rows = C.first_layout(pages, C.embedded_records(pages), C.row_attributes(pages), C.structured_offers(pages))
    return rows.select("source", "captured", "commitment", r6("price_per_instance_hour", "price"), "gpu_model")


@register(
    "page_amounts",
    f"""SELECT 'page' || p_partkey AS source, count(*) AS amounts, round(sum(a), 6) AS total FROM (SELECT p_partkey, unnest(list_filter([
          CASE WHEN p_size % 4 <> 0 THEN {AMOUNT.format('300e0')} END, {AMOUNT.format('400e0')}, {AMOUNT.format('500e0')}, 1e0,
          CASE WHEN p_size % 7 = 0 THEN 0.01e0 END], lambda x: x IS NOT NULL)) AS a FROM part) GROUP BY p_partkey""",
)
def _(ws):
    cells = C.page_cells(_table_page(ws))
    return cells.select("source", F.explode(markup.amounts("cell")).alias("a")).groupBy("source").agg(
        F.count(F.lit(1)).alias("amounts"), r6(F.sum("a"), "total")
    )


# --- capture listings -----------------------------------------------------------
CAPS = """SELECT event_type AS source, strftime(ts, '%Y%m%d%H%M%S') AS timestamp, 'site/' || user_id AS original,
  CASE WHEN value < 5 THEN '301' ELSE '200' END AS statuscode, 'd' || event_id AS digest,
  CASE WHEN event_id % 11 = 0 THEN 'warc/revisit' ELSE 'text/html; charset=utf-8' END AS mimetype, event_id FROM events"""


def _listing_documents(ws):
    """Each event as a one-capture listing document: a header row, then the row."""
    e = ws.table("events")
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    head = F.array(*[F.lit(c) for c in ("original", "timestamp", "mimetype", "statuscode", "digest")])
    row = F.array(
        F.concat(F.lit("site/"), F.col("user_id").cast("string")), stamp,
        F.when(F.col("event_id") % 11 == 0, "warc/revisit").otherwise("text/html; charset=utf-8"),
        F.when(F.col("value") < 5, "301").otherwise("200"), F.concat(F.lit("d"), F.col("event_id").cast("string")),
    )
    return e.select(F.col("event_type").alias("source"), F.create_map(F.lit("site"), F.array(head, row)).alias("listings"))


@register(
    "capture_listing",
    f"SELECT source, timestamp, original, digest FROM ({CAPS}) WHERE statuscode = '200' AND starts_with(mimetype, 'text/html')",
)
def _(ws):
    return listings.usable(listings.from_documents(_listing_documents(ws))).select("source", "timestamp", "original", "digest")


@register(
    "capture_selection",
    f"""WITH c AS (SELECT *, CASE WHEN source = 'view' THEN substr(timestamp, 1, 4) || '-' || substr(timestamp, 5, 2)
          ELSE CAST(CAST(date_trunc('week', strptime(substr(timestamp, 1, 8), '%Y%m%d')) AS DATE) AS VARCHAR) END AS period
        FROM ({CAPS}) WHERE statuscode = '200' AND starts_with(mimetype, 'text/html') AND NOT contains(original, 'site/13')),
        r AS (SELECT *, row_number() OVER (PARTITION BY source, period ORDER BY timestamp, original, digest) AS rn FROM c)
        SELECT source, period, timestamp, original, digest FROM r WHERE rn <= 3 AND event_id % 3 <> 0
        QUALIFY row_number() OVER (PARTITION BY source, period ORDER BY rn) = 1""",
)
def _(ws):
    """A third of the pages were never fetched; the next candidate of the period stands in."""
    captures = listings.from_documents(_listing_documents(ws))
    on_file = ws.table("events").where("event_id % 3 <> 0").select(
        F.col("event_type").alias("source"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp")
    )
    return listings.selected(captures, on_file, ("site/13",), "202301", "202609", ("view",))


# --- the back-series --------------------------------------------------------------
START, END = "1995-01-01", "2001-12-28"


def _cards(ws):
    """Quotes read as archived rate-card rows, a few sources deep."""
    obs = ws.rows()  # every run is read, so a partition for each would be a shuffle for nothing
    nation = F.regexp_extract("source", r"(\d)$", 1)
    return obs.select(
        F.concat(F.lit("card"), nation, F.when(F.col("source") == "desk", "d").otherwise("")).alias("source"),
        F.date_format("observed_at", "yyyyMMdd000000").alias("captured"), F.col("source_sku").alias("sku"), "gpu_model", "gpu_count",
        F.col("usd_per_hour_total").alias("price_per_instance_hour"), "commitment", "form_factor", "interconnect", "vram_gb",
        "currency", "price_kind", F.when(F.col("machine_id").isNull(), "gpu_component").otherwise("instance").alias("basis"),
        F.lit("").alias("note"),
    )


piece("cards", """SELECT * EXCLUDE (source), 'card' || regexp_extract(source, '(\\d)$', 1) || CASE WHEN source = 'desk' THEN 'd' ELSE '' END AS source,
  CAST(strftime(observed_at, '%Y%m%d') AS VARCHAR) || '000000' AS captured, CASE WHEN machine_id IS NULL THEN 'gpu_component' ELSE 'instance' END AS cbasis,
  strftime(observed_at, '%Y-%m') AS month, CAST(CAST(date_trunc('week', observed_at) AS DATE) AS VARCHAR) AS week FROM idx""", ["idx"])
piece("rest", """SELECT *, p * f1 * f2 * f4 AS np, CASE WHEN code = 'MI300X' THEN 'out_of_scope' WHEN cbasis <> 'instance' THEN 'component_price'
  WHEN commitment <> 'on_demand' THEN 'not_on_demand' WHEN code IS NULL THEN 'unmatched_model' WHEN price_kind = 'from_floor' THEN 'from_floor'
  WHEN upper(currency) <> 'USD' THEN 'currency_unsupported' WHEN by_label OR by_memory THEN 'product_identity' WHEN f1 * f2 * f4 > 1.75e0 THEN 'over_adjusted'
  ELSE 'restated' END AS outcome FROM (SELECT *, CASE form_factor WHEN 'sxm' THEN 1e0 WHEN 'pcie' THEN 1.18e0 ELSE 1.09e0 END AS f1,
  CASE interconnect WHEN 'ethernet' THEN 1.12e0 WHEN 'none' THEN 1.15e0 WHEN 'unknown' THEN 1.06e0 ELSE 1e0 END AS f2,
  CASE WHEN gpu_count >= 8 THEN 1e0 WHEN gpu_count >= 4 THEN 0.98e0 WHEN gpu_count >= 2 THEN 0.95e0 ELSE 0.92e0 END AS f4 FROM cards)""", ["cards"])


def _restated(ws):
    return ws._once("restated-cards", lambda: B.restate(_cards(ws), on_file=True))


@register(
    "card_outcomes",
    query("SELECT source, month, outcome, count(*) AS \"rows\", round(sum(CASE WHEN outcome = 'restated' THEN np END), 4) AS restated_total FROM rest GROUP BY ALL", "rest"),
)
def _(ws):
    rows = _restated(ws).withColumn("month", B.period(B.captured_day(), "month"))
    return rows.groupBy("source", "month", "outcome").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum(F.when(F.col("outcome") == "restated", F.col("normalized_usd_per_gpu_hour"))), 4).alias("restated_total"),
    )


@register(
    "observation_ledger",
    query("""SELECT source, captured, month, week, source_sku AS sku, coalesce(code, '') AS index_code, CASE WHEN outcome = 'restated' THEN 'restated' ELSE 'discarded' END AS outcome,
        round(CASE WHEN outcome = 'restated' THEN np END, 6) AS restated_per_gpu_hour, CASE WHEN outcome <> 'restated' THEN outcome END AS discard_code,
        CASE WHEN outcome = 'restated' THEN concat_ws(';', CASE WHEN f1 <> 1 THEN 'form_factorx' || f1 END, CASE WHEN f2 <> 1 THEN 'interconnectx' || f2 END,
          CASE WHEN f4 <> 1 THEN 'node_sizex' || f4 END) END AS adjustments FROM rest""", "rest"),
)
def _(ws):
    return B.ledger(_restated(ws)).select(
        "source", "captured", "month", "week", "sku", F.coalesce("index_code", F.lit("")).alias("index_code"), "outcome",
        r6("restated_per_gpu_hour"), "discard_code", "adjustments",
    )


def series_sql(unit: str, rest: str = "rest") -> str:
    """The period series over a piece of restated rows."""
    step = "INTERVAL 1 MONTH" if unit == "month" else "INTERVAL 7 DAY"
    name = "strftime(t, '%Y-%m')" if unit == "month" else "CAST(CAST(t AS DATE) AS VARCHAR)"
    back = f"t - {step}"
    prev = f"strftime({back}, '%Y-%m')" if unit == "month" else f"CAST(CAST({back} AS DATE) AS VARCHAR)"
    return query("SELECT 1", rest).replace(
        "\nSELECT 1",
        f""", spine AS (SELECT {name} AS period, {prev} AS prev, unnest(['H100', 'H200', 'B200', 'A100']) AS code
          FROM (SELECT unnest(generate_series(date_trunc('{unit}', TIMESTAMP '{START}'), TIMESTAMP '{END}', {step})) AS t)),
        v AS MATERIALIZED (SELECT {unit} AS period, code, source, median(np) AS vote, count(*) AS n FROM {rest} WHERE outcome = 'restated' GROUP BY ALL),
        a AS (SELECT period, code, median(vote) AS med, mad(vote) AS mad, count(*) AS k, sum(n) AS n, min(vote) AS lo, max(vote) AS hi FROM v GROUP BY ALL),
        raw AS (SELECT {unit} AS period, code, median(p) AS raw, count(DISTINCT (source, captured)) AS snaps FROM {rest} WHERE outcome = 'restated' GROUP BY ALL),
        side AS (SELECT {unit} AS period, code, CASE WHEN commitment IN ('spot', 'community') THEN 'spot' ELSE 'reserved' END AS side, source, median(p) AS m
          FROM {rest} WHERE outcome = 'not_on_demand' AND code IN ('H100', 'H200', 'B200', 'A100') GROUP BY ALL),
        sides AS (SELECT period, code, median(m) FILTER (WHERE side = 'reserved') AS rm, count(*) FILTER (WHERE side = 'reserved') AS rk,
          median(m) FILTER (WHERE side = 'spot') AS sm, count(*) FILTER (WHERE side = 'spot') AS sk FROM side GROUP BY ALL),
        mt AS (SELECT s.period, s.code, count(*) AS k, median(ln(x.vote / y.vote)) AS c FROM spine s JOIN v x ON x.period = s.period AND x.code = s.code
          JOIN v y ON y.period = s.prev AND y.code = s.code AND y.source = x.source GROUP BY ALL)
        SELECT s.period, s.code AS index_code, CASE WHEN a.k >= 3 THEN 'published' ELSE 'withheld' END AS status, round(CASE WHEN a.k >= 3 THEN a.med END, 6) AS value,
          coalesce(a.k, 0) AS provider_count, CAST(coalesce(a.n, 0) AS BIGINT) AS observation_count, coalesce(raw.snaps, 0) AS snapshot_count,
          round(CASE WHEN a.k >= 3 THEN a.mad * 1.4826e0 / a.med END, 6) AS dispersion, round(a.lo, 6) AS min_provider_value, round(a.hi, 6) AS max_provider_value,
          coalesce(CASE WHEN a.k >= 3 THEN a.mad * 1.4826e0 / a.med END, 0) > 0.45e0 AS dispersion_flag, round(raw.raw, 6) AS raw_on_demand_median,
          round(sides.rm, 6) AS reserved_raw_median, coalesce(sides.rk, 0) AS reserved_providers, round(sides.sm, 6) AS spot_raw_median,
          coalesce(sides.sk, 0) AS spot_providers, coalesce(mt.k, 0) AS matched_providers, round(CASE WHEN mt.k >= 3 THEN mt.c END, 6) AS matched_log_change
        FROM spine s LEFT JOIN a USING (period, code) LEFT JOIN raw USING (period, code) LEFT JOIN sides USING (period, code) LEFT JOIN mt USING (period, code)""",
    )


def _series(ws, unit: str):
    return ws._once(
        f"{unit}-series", lambda: B.period_series(_restated(ws), B.spine(ws.spark, START, END, unit), unit)
    )


def series_out(rows):
    return rows.select(
        "period", "index_code", "status", r6("value"), "provider_count", "observation_count", "snapshot_count", r6("dispersion"),
        r6("min_provider_value"), r6("max_provider_value"), "dispersion_flag", r6("raw_on_demand_median"), r6("reserved_raw_median"),
        "reserved_providers", r6("spot_raw_median"), "spot_providers", "matched_providers", r6("matched_log_change"),
    )


@register("period_series_month", series_sql("month"))
def _(ws):
    return series_out(_series(ws, "month"))


@register("period_series_week", series_sql("week"))
def _(ws):
    return series_out(_series(ws, "week"))


MONTH_VOTES = query("SELECT month AS period, code AS index_code, source, round(median(np), 6) AS vote, count(*) AS \"rows\" FROM rest WHERE outcome = 'restated' GROUP BY ALL", "rest")


@register("period_votes", MONTH_VOTES)
def _(ws):
    return B.provider_list(B.period_votes(_restated(ws), "month")).select("period", "index_code", "source", r6("vote"), "rows")


@register(
    "calendar_spine",
    f"""SELECT 'month' AS granularity, strftime(t, '%Y-%m') AS period, (SELECT count(*) FROM orders WHERE date_trunc('month', o_orderdate) = t) AS orders
        FROM (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 MONTH)) AS t)
        UNION ALL SELECT 'week', CAST(CAST(t AS DATE) AS VARCHAR), (SELECT count(*) FROM orders WHERE date_trunc('week', o_orderdate) = t)
        FROM (SELECT unnest(generate_series(date_trunc('week', TIMESTAMP '{START}'), TIMESTAMP '{END}', INTERVAL 7 DAY)) AS t)""",
)
def _(ws):
    """Orders counted onto both calendars, empty periods included."""
    out = None
    for unit in ("month", "week"):
        counts = ws.table("orders").groupBy(B.period(F.col("o_orderdate"), unit).alias("period")).agg(F.count(F.lit(1)).alias("orders"))
        rows = B.spine(ws.spark, START, END, unit).join(counts, "period", "left").select(
            F.lit(unit).alias("granularity"), "period", F.coalesce("orders", F.lit(0)).alias("orders")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "coverage_matrix",
    query(f"""SELECT s.source, m.period, (SELECT count(*) FROM (SELECT DISTINCT source, captured FROM rest) x WHERE x.source = s.source
          AND substr(x.captured, 1, 4) || '-' || substr(x.captured, 5, 2) = m.period) AS snapshots, """
          + ", ".join(f"count(r.code) FILTER (WHERE r.code = '{c}') AS \"{c}\"" for c in rules.BACK_SERIES_CODES)
          + f""" FROM (SELECT DISTINCT source FROM rest) s CROSS JOIN (SELECT strftime(unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 MONTH)), '%Y-%m') AS period) m
          LEFT JOIN rest r ON r.source = s.source AND r.month = m.period AND r.outcome = 'restated' GROUP BY s.source, m.period""", "rest"),
)
def _(ws):
    restated = _restated(ws)
    return B.coverage(restated.select("source", "captured").distinct(), restated, START, END, restated)


@register(
    "period_counts",
    series_sql("month").replace("SELECT s.period, s.code AS index_code, CASE", "SELECT index_code, count(*) FILTER (WHERE status = 'published') AS published, count(*) FILTER (WHERE status <> 'published') AS withheld, min(period) FILTER (WHERE status = 'published') AS first, max(period) FILTER (WHERE status = 'published') AS last FROM (SELECT s.period, s.code AS index_code, CASE", 1)
    + ") GROUP BY index_code",
)
def _(ws):
    return B.period_counts(_series(ws, "month"))


SINCE = "1999-01-01"


@register(
    "overlap_level",
    query("SELECT 1", "rest", "live").replace(
        "\nSELECT 1",
        f""", v AS MATERIALIZED (SELECT 'month' AS g, month AS period, code, median(np) AS vote FROM rest WHERE outcome = 'restated' GROUP BY month, code, source
          UNION ALL SELECT 'week', week, code, median(np) FROM rest WHERE outcome = 'restated' GROUP BY week, code, source),
        b AS (SELECT g, period, code, median(vote) AS med, count(*) AS k FROM v GROUP BY ALL),
        l AS (SELECT 'month' AS g, strftime(index_date, '%Y-%m') AS period, index_code AS code, avg(value) AS m, count(*) AS n FROM live
            WHERE status = 'published' AND index_date >= DATE '{SINCE}' GROUP BY ALL
          UNION ALL SELECT 'week', CAST(CAST(date_trunc('week', index_date) AS DATE) AS VARCHAR), index_code, avg(value), count(*) FROM live
            WHERE status = 'published' AND index_date >= DATE '{SINCE}' GROUP BY ALL)
        SELECT l.g AS granularity, l.period, l.code AS index_code, round(CASE WHEN b.k >= 3 THEN b.med END, 6) AS back_value, coalesce(b.k, 0) AS back_providers,
          round(l.m, 6) AS live_mean, l.n AS live_days, round(l.m / CASE WHEN b.k >= 3 THEN b.med END, 6) AS ratio
        FROM l LEFT JOIN b USING (g, period, code) WHERE l.code <> 'MI300X'""",
    ),
)
def _(ws):
    live = T.live(ws.tape())
    out = None
    for unit in ("month", "week"):
        rows = B.overlap_level(_series(ws, unit), live, unit, SINCE)
        out = rows if out is None else out.unionByName(rows)
    return out.select(
        "granularity", "period", "index_code", r6("back_value"), "back_providers", r6("live_mean"), "live_days", r6("ratio")
    )


NAMES = {"cardd": ("desk",), "card5": ("feed1:Supplier#000000005", "feed2:Supplier#000000015", "feed1:Supplier#000000025"), "card": ("vastai",)}


@register(
    "overlap_providers",
    query(f"""SELECT c.period, c.code AS index_code, c.source AS back_source, n.live AS live_provider, round(c.vote, 6) AS back_vote, round(median(s.price), 6) AS live_median,
        count(*) AS live_days, round(median(s.price) / c.vote, 6) AS ratio
        FROM (SELECT month AS period, code, source, median(np) AS vote FROM rest WHERE outcome = 'restated' AND observed_at >= DATE '{SINCE}' GROUP BY ALL) c
        JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, vs in NAMES.items() for v in vs)}) n(source, live) ON n.source = c.source
        JOIN scr s ON s.code = c.code AND s.provider = n.live AND strftime(s.d, '%Y-%m') = c.period AND s.ver = '1.2.0' AND s.d >= DATE '{SINCE}'
        GROUP BY c.period, c.code, c.source, n.live, c.vote""", "rest", "scr"),
)
def _(ws):
    votes = ws.screened().where("methodology_version = '1.2.0'").select(*KEYS, "provider", "price")
    rows = B.overlap_providers(_restated(ws), votes, NAMES, SINCE)
    return rows.select(
        "period", "index_code", "back_source", "live_provider", r6("back_vote"), r6("live_median"), "live_days", r6("ratio")
    )
