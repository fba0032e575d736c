"""Archived price pages to priced rows, for whole tables of pages at once.

A page is read as numbered text cells. Only the cells that can matter (headers,
labels, amounts, headings) are kept, and the page's structure is recovered with
windows over (page, position). A window partition is one page, never a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup

PAGE = ["source", "captured"]

# --- fixed values -----------------------------------------------------------
FAMILIES = ("H100", "H200", "B200", "A100")
NEIGHBOURS = r"\bG[HB]\s?200\b|\bH800\b|\bA800\b|\bB100\b|\bB300\b|\bGB300\b"
NEARLY = "G[HB]|[HA]800|B[13]00"  # what any of them has in it, however it is spaced
DOLLAR = (
    r"(?i)^\$\s?\d{1,3}(?:,\d{3})*(?:\.\d+)?\s?"
    r"(?:/\s?(?:hr|h|hour)|/\s?gpu\s?/\s?h(?:ou)?r|/\s?gpu|per\s+gpu(?:\s*/\s*hour)?|per\s+hour|/\s?gpu-hr)?"
    r"\s?\*{0,2}$"
)
PLACEHOLDER = "(?i)^(n/?a|-|–|on request|contact (?:sales|us)|coming soon|sold out|unavailable)$"
COMMITMENT_TALK = r"(?i)commit|reserv|contract|prepaid"
STATED_TERM = r"\b\d+\s*-?\s*(month|year|yr|mo)\b|reserved|commit|term"
CARD_MEMORY = (40, 80, 94, 96, 141, 180, 192)
HOST_PRICED = r"(?i)(vcpu|ram).*\(\s*\$\s?\d"
PER_GPU = r"/gpu|pergpu|/h100|/h200|/b200|/a100|gpu/hr|gpu/hour|gpu-hr|gpuhr"
INSTANCE_NAME = r"^(\d{1,2})[A-Z]\d{2,3}[A-Z]?\.\S+$"
CARD_LABEL = "(?i)^NVIDIA\\s+(.+?)(?:\\s?[x×]\\s?(\\d))?$"
CARD_PRICE = r"^\$\s?\d+(?:\.\d+)?$"
FOOTNOTE = r"(\*+)\s*\$(\d+(?:\.\d+)?)\s*/\s*hour pricing is for an? ([\w -]+?commitment)"
SPLIT_NUMBER = r"^\d+(?:\.\d+)?$"
FORM_CELLS = ("SXM", "PCIE", "OAM", "NVL", "HGX", "NVL72")
COUNTED_ROW = r"(?i)^(?:(on[- ]demand|reserved)\s+)?(\d{1,2})\s?x\s+(?:NVIDIA\s+)?(.+)$"
MEMORY_CELL = r"(?i)^(\d{2,3})\s?GB$"
ROW_TERM = r"(?i)\b\d+\s*-?\s*(years?|months?|yrs?|mos?|weeks?)\b"
RESERVED_HEAD = r"(?i)reserved|cluster|1-click|private cloud|sprint"
ON_DEMAND_HEAD = r"(?i)on[- ]demand"
PER_GPU_HEAD = r"(?i)price\s*/\s*gpu"
PRICE_HEAD = r"(?i)^price(?![a-z])"
BARE_PRICE = r"^\$\s?\d+(\.\d+)?\W{0,3}$"
OFFER_HEAD = r"(?i)^(on[- ]demand|reserved?|long[- ]term)\b[ ,]*(.*)$"
OFFER_RATE = r"(?i)^\$\s?\d+(?:\.\d+)?\s?/\s?(?:hr|hour)"
OFFER_UNITS = r"(?i)(\d+)\s*-\s*[\d,]+\+?\s+((?:HGX\s+)?[HB]\d00\w*)"
RECORD = r'"__typename":\s*"GpuType"'
RECORD_PRICES = {
    "securePrice": "on_demand", "communityPrice": "community",
    "secureSpotPrice": "spot", "communitySpotPrice": "spot",
}
ATTRIBUTE_ROW = r'class="gpu-pricing-row[ "]|class="gpu_table-row"'
RECORD_SPAN = 2000
ATTRIBUTE_SPAN = 4000
LABEL_COUNT = r"^(\d)\s*[×x]\s*(.+)$"
SPLIT_RATE = r"(?i)^\d+(?:\.\d+)?\s*per\s+hour$"
SECTION_PRICE = r"(?i)^\$\s?(\d+(?:\.\d+)?)\s*(?:per\s+(?:gpu|hour)|/\s?hour|/\s?hr)?$"
FROM_CELL = r"(?i)^(starts|starting)\s+from$"
SIZED_HEAD = "on-demand gpu instances"
SIZED_COUNTS = (1, 2, 4, 8)
SIZED_MEMORY = (80, 94, 141, 180, 192)
SIZED_PRICE = r"^\$\s?\d{1,3}(?:,\d{3})*(?:\.\d+)?$"
COMPONENT_HEAD = "gpu component"
WHOLE_NUMBER = r"^\d{1,4}(?:,\d{3})?$"
MARKET_MEMORY = r"(?i)^(\d{2,3})\s?GB VRAM$"
MARKET_RATE = r"(?i)^\$\s?\d+(\.\d+)?\s?/\s?hr$"
ON_DEMAND_NOTE = r"on-demand pricing for (H100|H200|B200|A100[-\w]*) is \$(\d+(?:\.\d+)?)\s*(?:/|per)\s*hour"
STATED_MEMORY = r"(\d{2,3})\s?GB"
SXM_WORDS = r"\bSXM\d?\b|\bHGX\b"
PCIE_WORDS = r"\bPCIE\b|\bPCI E\b"
NVLINK_WORD = r"\bNVLINK\b"
SPOT_WORDS = "spot|interruptible|preemptible"
ON_DEMAND_WORDS = "on-demand|on demand|ondemand|pay as you go"
PRICE_WORDS = "price|/hr|per hour"
SECTION_ON_DEMAND, SECTION_RESERVED = "^on[- ]demand", "^(reservation|reserved)"
STARRED_NUMBER = r"^(\d+(?:\.\d+)?)(\**)$"
RECORD_TEXT, RECORD_NUMBER = r'"{key}":\s*"([^"]*)"', r'"{key}":\s*(null|-?\d+(?:\.\d+)?)'
ROW_NAMES = (r'data-line-clamp=""[^>]*>([^<]{2,40})</div>', r'class="gpu_name[^"]*">([^<]{2,40})<')
ROW_MEMORY = (r">(\d{2,3})</div><div[^>]*>GB VRAM<", r">(\d{2,3}) GB VRAM<")
ROW_SECURE = r'data-secure(?:-cloud-price)?="(\d+(?:\.\d+)?)"'
ROW_COMMUNITY = r'data-community(?:-cloud-price)?="(\d+(?:\.\d+)?)"'
STRUCTURED_DATA = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
PRODUCT_TAIL, MARKETS = " GPU on Runpod", ("Secure Cloud", "Community Cloud")
# ---------------------------------------------------------------------------


def spaced(text: Column) -> Column:
    """Upper-case label with separators as single spaces, padded at both ends."""
    return F.regexp_replace(F.concat(F.lit(" "), F.upper(text), F.lit(" ")), r"(?U)[\s\-_/&&[^ ]][\s\-_/]*+| [\s\-_/]++", " ")


def label_reading(label: str | Column, vram: Column | None = None) -> Column:
    """What product a label names: model, form factor, fabric and memory, or null.

    Superchips and export variants are neighbours, not the covered cards, and
    are refused outright. The label is bound once and its family once, so the
    expression stays small however often its parts are used.
    """
    text = F.col(label) if isinstance(label, str) else label
    given = vram if vram is not None else F.lit(None).cast("int")

    def parts(s: Column) -> Column:
        t = s["t"]
        # few labels have each of these words, and finding a word costs less than a pattern
        found = [F.when(t.contains(f) & t.rlike(rf"(?<![A-Z0-9]){f}(?![0-9])"), F.lit(f)) for f in FAMILIES]
        stated = F.when(t.contains("GB"), F.nullif(F.regexp_extract(t, STATED_MEMORY, 1), F.lit("")).cast("int"))
        return F.struct(
            t.alias("t"),
            F.when(~(t.rlike(NEARLY) & t.rlike(NEIGHBOURS)), F.coalesce(*found)).alias("family"),
            F.coalesce(s["vram"], stated).alias("memory"),
            (t.contains("NVL") & t.rlike(rf"({'|'.join(FAMILIES)})\s?NVL\b")).alias("bridged"),
            ((t.contains("SXM") | t.contains("HGX")) & t.rlike(SXM_WORDS)).alias("sxm"),
            (t.contains("PCI") & t.rlike(PCIE_WORDS)).alias("pcie"),
        )

    def reading(s: Column) -> Column:
        bridged, sxm, pcie = s["bridged"], s["sxm"], s["pcie"]
        form = F.when(bridged, "pcie").when(sxm, "sxm").when(pcie, "pcie").otherwise("unknown")
        fabric = (
            F.when(bridged | sxm | (s["t"].contains("NVLINK") & s["t"].rlike(NVLINK_WORD)), "nvlink").when(pcie, "none").otherwise("unknown")
        )
        named_pcie = pcie & s["family"].isin("A100", "H100")
        suffix = F.when(bridged, " NVL").when(sxm, " SXM").when(named_pcie, " PCIe").otherwise("")
        small = F.when((s["family"] == "A100") & ~bridged & (s["memory"] == 40), " 40GB").otherwise("")
        return F.when(
            s["family"].isNotNull(),
            F.struct(
                F.concat(s["family"], suffix, small).alias("gpu_model"),
                form.alias("form_factor"),
                fabric.alias("interconnect"),
                s["memory"].alias("vram_gb"),
            ),
        )

    bound = F.array(F.struct(spaced(text).alias("t"), given.alias("vram")))
    return F.when(_likely(text), F.get(F.transform(F.transform(bound, parts), reading), F.lit(0)))


def _likely(text: Column) -> Column:
    return (text.contains("100") | text.contains("200")) & text.rlike("(?i)[HA]100|[HB]200")


def names_product(label: str | Column) -> Column:
    """Whether ``label_reading`` has a reading of a label: all that most cells of a page are asked, and never null.

    A family's name has no separator in it, so the label need not be spaced to find one.
    """
    text = F.col(label) if isinstance(label, str) else label
    upper = F.upper(text)
    named = upper.rlike(rf"(?<![A-Z0-9])(?:{'|'.join(FAMILIES)})(?![0-9])")
    neighbour = upper.rlike(NEARLY) & spaced(text).rlike(NEIGHBOURS)
    return F.coalesce(_likely(text) & named & ~neighbour, F.lit(False))


def is_dollar(cell: Column) -> Column:
    return cell.startswith("$") & cell.rlike(DOLLAR)


def commitment_of(header: Column) -> Column:
    """The commitment a header names; null when it names none."""
    names = lambda words: header.rlike(f"(?i){words}")
    return F.when(names(SPOT_WORDS), "spot").when(names(STATED_TERM), "reserved").when(names(ON_DEMAND_WORDS), "on_demand")


def is_price_header(cell: Column) -> Column:
    return (F.length(cell) <= 60) & ~cell.contains("$") & cell.rlike(f"(?i){PRICE_WORDS}")


def page_cells(pages: DataFrame, keep: list[str] = PAGE, html: str = "html") -> DataFrame:
    """Pages to numbered cells."""
    return pages.select(*keep, F.posexplode(markup.cells(html)).alias("pos", "cell"))


def manifest(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Content hash and size of every page."""
    return pages.select(
        *keep, F.sha2(html, 256).alias("sha256"), F.octet_length(html).cast("long").alias("bytes")
    )


def joined_prices(cells: DataFrame) -> DataFrame:
    """Prices split over cells ("$ | 3.90 | /hr", "$ | 2.40 per hour") put back into the first of them."""
    place = Window.partitionBy(*PAGE).orderBy("pos")
    near = {n: F.lead("cell", n).over(place) if n > 0 else F.lag("cell", -n).over(place) for n in (1, 2, -1, -2)}
    marked = cells.withColumns({f"c{n}".replace("-", "_"): c for n, c in near.items()})
    cell = F.col("cell")
    number = lambda c: c.rlike(SPLIT_NUMBER) | c.rlike(SPLIT_RATE)
    opens = (cell == "$") & number(F.col("c1"))
    amount = (F.col("c_1") == "$") & number(cell)
    unit = (F.col("c_2") == "$") & F.col("c_1").rlike(SPLIT_NUMBER) & cell.startswith("/")
    whole = F.concat(F.lit("$"), "c1", F.when(F.col("c2").startswith("/"), F.col("c2")).otherwise(""))
    return marked.where(~F.coalesce(amount, F.lit(False)) & ~F.coalesce(unit, F.lit(False))).withColumn(
        "cell", F.when(F.coalesce(opens, F.lit(False)), whole).otherwise(cell)
    ).select(*cells.columns)


def is_strip_header(cell: Column, strips: str) -> Column:
    """A column header: one that speaks of a price, or one that only names a commitment."""
    if strips == "price":
        return is_price_header(cell)
    return F.coalesce((F.length(cell) <= 30) & commitment_of(cell).isNotNull(), F.lit(False))


def price_columns(cells: DataFrame, sections: bool = False, strips: str = "price") -> DataFrame:
    """Header strips: each run of adjacent price headers, as ordered columns.

    Returns one row per column: (page, strip, slot, header, commitment). A strip
    in which no column names a commitment is not a strip. With
    ``strips="commitment"`` the headers are bare commitments, two at least.
    """
    place = Window.partitionBy(*PAGE).orderBy("pos")
    heading = F.when(
        ~F.col("is_header") & (F.length("cell") <= 80) & ~is_dollar(F.col("cell")) & ~names_product("cell"),
        commitment_of(F.col("cell")),
    )
    marked = cells.withColumn("is_header", is_strip_header(F.col("cell"), strips))
    marked = marked.withColumn("section", F.last(heading, ignorenulls=True).over(place))
    heads = marked.where("is_header")
    # positions minus ranks are constant along a run of neighbours
    runs = heads.withColumn("island", F.col("pos") - F.row_number().over(place))
    own = commitment_of(F.col("cell"))
    runs = runs.withColumn("commitment", F.coalesce(own, F.col("section")) if sections else own)
    strip = Window.partitionBy(*PAGE, "island")
    return (
        runs.withColumn("strip", F.min("pos").over(strip))
        .withColumn("named", F.count("commitment").over(strip))
        .where(F.col("named") > (0 if strips == "price" else 1))
        .select(
            *PAGE, "strip",
            F.row_number().over(strip.orderBy("pos")).alias("slot"),
            F.col("cell").alias("header"), "commitment",
        )
    )


def priced_table(
    cells: DataFrame, per_gpu: bool = True, sections: bool = False, max_label: int = 40, span: int = 9,
    strips: str = "price",
) -> DataFrame:
    """Rows of every priced table: a label, then one amount per price column.

    A placeholder keeps its column's place. A row that talks of a commitment is
    never read as on-demand. A label may begin with a count ("8 x ..."); its
    price is then the instance's, unless the header says it is a GPU's. Under bare commitment headers the memory ("80GB")
    and the form factor have cells of their own right after the label and are
    read with it.
    """
    apart = strips == "commitment"
    columns = price_columns(cells, sections, strips)
    cell = F.col("cell")
    dollar, placeholder = is_dollar(cell), (F.length(cell) <= 20) & cell.rlike(PLACEHOLDER)
    kinds = cells.select(
        *PAGE, "pos", "cell",
        ((F.length(cell) <= max_label) & ~dollar & names_product(cell)).alias("breaks"),
        is_strip_header(cell, strips).alias("is_header"),
        dollar.alias("dollar"),
        (dollar | placeholder).alias("is_slot"),
        cell.rlike(COMMITMENT_TALK).alias("talks"),
        (F.nullif(F.regexp_extract(cell, MEMORY_CELL, 1), F.lit("")).cast("int") if apart
         else F.when(cell.rlike(r"^\d{2,3}$"), cell.try_cast("int"))).alias("number"),
        (F.when(F.upper(cell).isin(*FORM_CELLS), cell) if apart else F.lit(None).cast("string")).alias("form_cell"),
    ).where(
        F.col("breaks") | F.col("is_header") | F.col("is_slot") | F.col("talks") | F.col("number").isNotNull()
        | F.col("form_cell").isNotNull()
    )

    place = Window.partitionBy(*PAGE).orderBy("pos")
    ahead = place.rangeBetween(1, 3 if apart else span)
    memory = F.col("number") if apart else F.when(F.col("number").isin(*CARD_MEMORY), F.col("number"))
    starts = columns.select(*PAGE, F.col("strip").alias("pos"), F.lit(True).alias("opens")).distinct()
    placed = (
        kinds.join(starts, [*PAGE, "pos"], "left")
        .withColumn("strip", F.last(F.when(F.col("opens"), F.col("pos")), ignorenulls=True).over(place))
        .withColumn("memory_ahead", F.first(memory, ignorenulls=True).over(ahead))
        .withColumn("form_ahead", F.coalesce(F.first("form_cell", ignorenulls=True).over(place.rangeBetween(1, 3)), F.lit("")))
        .withColumn(
            "label",
            F.last(
                F.when(F.col("breaks"),
                       F.struct("pos", "cell", "is_header", "strip", "memory_ahead", "form_ahead")),
                ignorenulls=True,
            ).over(place),
        )
        .where(
            F.col("label").isNotNull() & ~F.col("label.is_header") & F.col("label.strip").isNotNull()
            & ~F.col("breaks") & (F.col("pos") <= F.col("label.pos") + span)
        )
    )
    row = Window.partitionBy(*PAGE, "label.pos")
    slots = (
        placed.withColumn("row_talks", F.max("talks").over(row))
        .where("is_slot")
        .withColumn("slot", F.row_number().over(row.orderBy("pos")))
        .select(
            *PAGE, F.col("label.pos").alias("pos"), F.col("label.cell").alias("label"), F.col("label.strip").alias("strip"),
            F.col("label.memory_ahead").alias("memory_ahead"), F.col("label.form_ahead").alias("form_ahead"), "slot", "row_talks", "dollar",
            F.col("cell").alias("amount"),
        )
    )
    stated = F.when(F.upper("label").contains("GB"), label_reading("label")["vram_gb"])
    rows = (
        slots.join(columns, [*PAGE, "strip", "slot"])
        .where(F.col("dollar") & F.col("commitment").isNotNull()
               & ~(F.col("row_talks") & (F.col("commitment") == "on_demand")))
        .withColumn("price", markup.first_amount("amount"))
        .where("price > 0")
        .withColumn("vram", F.coalesce(stated, F.col("memory_ahead")))
        .withColumn("gpu", label_reading(F.concat("label", F.lit(" "), "form_ahead"), F.col("vram")))
    )
    unit = "GPU" if per_gpu else "instance"
    count = F.coalesce(F.nullif(F.regexp_extract("label", LABEL_COUNT, 1), F.lit("")).cast("int"), F.lit(1))
    head = F.replace(F.lower("header"), F.lit(" "), F.lit(""))
    each = head.contains("gpu-hour") | head.rlike(PER_GPU)
    return rows.select(
        *PAGE,
        F.concat("label", F.lit(" ["), "header", F.lit("]")).alias("sku"),
        "gpu.gpu_model",
        count.alias("gpu_count"),
        F.round(F.when(each, F.col("price") * count).otherwise(F.col("price")), 6).alias("price_per_instance_hour"),
        "commitment",
        "gpu.form_factor",
        "gpu.interconnect",
        "gpu.vram_gb",
        F.lit("quoted").alias("price_kind"),
        F.concat("amount", F.lit(f" per {unit}-hour under '"), "header", F.lit("'")).alias("note"),
    )


def instance_table(cells: DataFrame) -> DataFrame:
    """Tables keyed by instance names whose leading number is the GPU count.

    The count cell two places on must agree, or the row is not read. Prices are
    for the instance.
    """
    columns = price_columns(cells)
    place = Window.partitionBy(*PAGE).orderBy("pos")
    cell = F.col("cell")
    named = (
        cells.withColumn("name_count", F.nullif(F.regexp_extract("cell", INSTANCE_NAME, 1), F.lit("")).cast("int"))
        .withColumn("product", F.lead("cell", 1).over(place))
        .withColumn("count_cell", F.lead("cell", 2).over(place))
        .withColumn("is_row", (F.col("count_cell").try_cast("int") == F.col("name_count"))
                    & F.col("count_cell").rlike(r"^\d+$") & names_product("product"))
    )
    starts = columns.select(*PAGE, F.col("strip").alias("pos"), F.lit(True).alias("opens")).distinct()
    placed = (
        named.join(starts, [*PAGE, "pos"], "left")
        .withColumn("strip", F.last(F.when(F.col("opens"), F.col("pos")), ignorenulls=True).over(place))
        .withColumn(
            "row",
            F.last(F.when(F.col("is_row"), F.struct("pos", "cell", "product", "name_count", "strip")), ignorenulls=True)
            .over(place),
        )
        .where("row.strip is not null and pos >= row.pos + 3 and pos <= row.pos + 10")
        .where(is_dollar(cell) | cell.rlike(PLACEHOLDER))
        .select(*PAGE, "row.*", F.col("cell").alias("amount"), F.col("pos").alias("at"))
    )
    slot = F.row_number().over(Window.partitionBy(*PAGE, "pos").orderBy("at"))
    rows = (
        placed.withColumn("slot", slot)
        .join(columns, [*PAGE, "strip", "slot"])
        .where(is_dollar(F.col("amount")) & F.col("commitment").isNotNull())
        .withColumn("price", markup.first_amount("amount"))
        .where("price > 0")
        .withColumn("gpu", label_reading("product"))
    )
    return rows.select(
        *PAGE,
        F.concat("cell", F.lit(" "), "product", F.lit(" ["), "header", F.lit("]")).alias("sku"),
        "gpu.gpu_model", F.col("name_count").alias("gpu_count"), F.col("price").alias("price_per_instance_hour"),
        "commitment", "gpu.form_factor", "gpu.interconnect", "gpu.vram_gb", F.lit("quoted").alias("price_kind"),
        F.concat("amount", F.lit(" per instance-hour under '"), "header", F.lit("'")).alias("note"),
    )


def sectioned_list(cells: DataFrame, span: int = 9, max_label: int = 40) -> DataFrame:
    """Pages where a section heading sets the commitment and a label's first price counts.

    The heading carries forward to the next one. A price after "starts from" is
    a floor, not a rate. Under a two-column header ("Pricing Per Hour |
    Reservation Pricing") the first two prices count: the plain one is the
    on-demand rate and the floor is the reservation's.
    """
    place = Window.partitionBy(*PAGE).orderBy("pos")
    cell, low = F.col("cell"), F.lower(F.trim("cell"))
    product = names_product("cell")
    heading = F.when(
        (F.length(low) <= 40) & ~product,
        F.when(low.rlike(SECTION_ON_DEMAND), "on_demand")
        .when(low.rlike(SECTION_RESERVED), "reserved")
        .when(low.startswith("spot"), "spot"),
    )
    before = F.lower(F.concat(F.lag("cell", 1).over(place), F.lag("cell", 2).over(place)))
    two_columns = (F.lower("cell") == "reservation") & before.contains("per")
    marked = cells.select(
        *PAGE, "pos", "cell", F.when(F.coalesce(two_columns, F.lit(False)), "two_columns").otherwise(heading).alias("heading"),
        ((F.length(cell) <= max_label) & ~cell.startswith("$") & product).alias("is_label"),
        cell.rlike(SECTION_PRICE).alias("is_price"),
        cell.rlike(FROM_CELL).alias("is_from"),
    ).where("heading is not null or is_label or is_price or is_from")
    placed = (
        marked.withColumn("section", F.last("heading", ignorenulls=True).over(place))
        .withColumn("label", F.last(F.when(F.col("is_label"), F.struct("pos", "cell", "section")), ignorenulls=True).over(place))
        .where(f"label.section is not null and not is_label and pos <= label.pos + {span}")
    )
    row = Window.partitionBy(*PAGE, "label.pos").orderBy("pos")
    prices = (
        placed.withColumn("floor", F.max("is_from").over(row))
        .where("is_price")
        .withColumn("nth", F.row_number().over(row))
        .where("nth = 1 or (nth = 2 and label.section = 'two_columns')")
        .select(*PAGE, "label.*", "floor", markup.first_amount("cell").alias("price"))
        .where("price > 0")
        .withColumn("gpu", label_reading("cell"))
        .withColumn(
            "section",
            F.when(F.col("section") != "two_columns", F.col("section"))
            .when(F.col("floor"), "reserved").otherwise("on_demand"),
        )
    )
    return prices.select(
        *PAGE, F.concat("cell", F.lit(" ["), "section", F.lit("]")).alias("sku"), "gpu.gpu_model",
        F.lit(1).alias("gpu_count"), F.col("price").alias("price_per_instance_hour"),
        F.col("section").alias("commitment"), "gpu.form_factor", "gpu.interconnect", "gpu.vram_gb",
        F.when(F.col("floor"), "from_floor").otherwise("quoted").alias("price_kind"),
        F.concat(F.lit("$"), F.col("price").cast("string"), F.lit(" per GPU-hour, section "), "section").alias("note"),
    )


def counted_rows(cells: DataFrame, span: int = 9) -> DataFrame:
    """Rows named "8x NVIDIA H100 …": a count, then specs, then the first hourly price.

    The price is per GPU when its own cell or the column's header says so.
    Short cells that name a product ("H100 SXM") are read with the label.
    Reserved rows say so before the count, in the heading above them, or by a
    term in the two cells after the price.
    """
    place = Window.partitionBy(*PAGE).orderBy("pos")
    cell, low = F.col("cell"), F.lower("cell")
    marked = cells.withColumns(
        {
            "is_row": cell.rlike(COUNTED_ROW),
            "after": F.concat_ws(" ", F.lead("cell", 1).over(place), F.lead("cell", 2).over(place)),
            "per_gpu_head": F.when(cell.rlike(PRICE_HEAD), cell.rlike(PER_GPU_HEAD)),
        }
    ).withColumns(
        {
            "row_pos": F.last(F.when(F.col("is_row"), F.col("pos")), ignorenulls=True).over(place),
            "head_per_gpu": F.coalesce(F.last("per_gpu_head", ignorenulls=True).over(place), F.lit(False)),
        }
    )
    hourly = cell.contains("$") & low.rlike("hr|hour") & cell.rlike(markup.MONEY)
    bare = F.col("head_per_gpu") & cell.rlike(BARE_PRICE)
    own = ~F.col("is_row") & (F.col("pos") <= F.col("row_pos") + span)
    row = Window.partitionBy(*PAGE, "row_pos")
    priced = marked.withColumn(
        "price_pos", F.min(F.when(own & (hourly | bare), F.col("pos"))).over(row)
    )
    outside = F.col("row_pos").isNull() | (F.col("pos") > F.coalesce("price_pos", "row_pos"))
    heading = F.when(
        outside & (F.length(cell) <= 80),
        F.when(cell.rlike(ON_DEMAND_HEAD), "on_demand").when(cell.rlike(RESERVED_HEAD), "reserved"),
    )
    placed = priced.withColumn(
        "section", F.coalesce(F.last(heading, ignorenulls=True).over(place), F.lit("on_demand"))
    ).where("price_pos is not null and pos >= row_pos and pos <= price_pos")
    at_row = lambda c: F.max(F.when(F.col("is_row"), F.col(c)))
    at_price = lambda c: F.max(F.when(F.col("pos") == F.col("price_pos"), F.col(c)))
    memory = F.nullif(F.regexp_extract("cell", MEMORY_CELL, 1), F.lit("")).cast("int")
    spec = ~F.col("is_row") & (F.length("cell") <= 12) & (F.col("pos") < F.col("price_pos")) & names_product("cell") & memory.isNull()
    # a row spans a few cells, so its short ones are few
    specs = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(spec, F.struct("pos", "cell")))), lambda x: x["cell"]), " ")
    rows = placed.groupBy(*PAGE, "row_pos").agg(
        specs.alias("specs"), at_row("cell").alias("name"), at_row("section").alias("section"), at_price("cell").alias("amount"),
        at_price("after").alias("after"), at_price("head_per_gpu").alias("head_per_gpu"),
        F.min_by(memory, F.when(memory.isNotNull(), F.col("pos"))).alias("memory"),
    )
    prefix = F.lower(F.regexp_extract("name", COUNTED_ROW, 1))
    squeezed = F.replace(F.lower("amount"), F.lit(" "), F.lit(""))
    rows = rows.withColumns(
        {
            "gpu_count": F.regexp_extract("name", COUNTED_ROW, 2).cast("int"),
            "label": F.rtrim(F.concat_ws(" ", F.regexp_extract("name", COUNTED_ROW, 3), "specs")),
            "price": markup.first_amount("amount"),
            "commitment": F.when(prefix != "", F.when(prefix == "reserved", "reserved").otherwise("on_demand"))
            .when((F.col("section") == "reserved") | F.col("after").rlike(ROW_TERM), "reserved").otherwise("on_demand"),
            "per_gpu": squeezed.rlike(PER_GPU) | (F.col("head_per_gpu") & F.col("amount").rlike(BARE_PRICE)),
        }
    ).where((F.col("price") > 0) & names_product("label")).withColumn("gpu", label_reading("label", F.col("memory")))
    total = F.when(F.col("per_gpu"), F.col("price") * F.col("gpu_count")).otherwise(F.col("price"))
    return rows.select(
        *PAGE, F.concat(F.col("gpu_count").cast("string"), F.lit("x "), "label").alias("sku"), "gpu.gpu_model", "gpu_count",
        F.round(total, 6).alias("price_per_instance_hour"), "commitment", "gpu.form_factor", "gpu.interconnect",
        "gpu.vram_gb", F.lit("quoted").alias("price_kind"), F.col("amount").alias("note"),
    )


def tabbed_rows(cells: DataFrame, span: int = 6) -> DataFrame:
    """A strip of counts ("8x | 4x | 2x | 1x"), then one per-GPU table per count in that order."""
    place = Window.partitionBy(*PAGE).orderBy("pos")
    cell = F.col("cell")
    tabs = cells.where(cell.rlike(r"^\d{1,2}x$")).withColumn("island", F.col("pos") - F.row_number().over(place))
    run = Window.partitionBy(*PAGE, "island")
    tabs = tabs.withColumns({"size": F.count(F.lit(1)).over(run), "opens": F.min("pos").over(run)}).where("size >= 2")
    first = tabs.groupBy(*PAGE).agg(F.min("opens").alias("opens"), F.min_by("size", "opens").alias("size"))
    counts = tabs.join(first.select(*PAGE, "opens"), [*PAGE, "opens"], "left_semi").select(
        *PAGE, (F.col("pos") - F.col("opens") + 1).alias("table_no"), F.regexp_extract("cell", r"^(\d+)", 1).cast("int").alias("gpu_count")
    )
    below = cells.join(first, PAGE).where(F.col("pos") >= F.col("opens") + F.col("size"))
    named = F.upper("cell").startswith("NVIDIA ")
    marked = below.withColumns(
        {
            "table_no": F.sum(F.when(cell.rlike(PER_GPU_HEAD), 1).otherwise(0)).over(place),
            "name_pos": F.last(F.when(named, F.col("pos")), ignorenulls=True).over(place),
        }
    ).where(f"table_no > 0 and pos <= name_pos + {span}")
    row = Window.partitionBy(*PAGE, "name_pos")
    bare = ~named & cell.rlike(BARE_PRICE)
    placed = marked.withColumn("price_pos", F.min(F.when(bare, F.col("pos"))).over(row)).where("pos <= price_pos")
    memory = F.nullif(F.regexp_extract("cell", MEMORY_CELL, 1), F.lit("")).cast("int")
    rows = placed.groupBy(*PAGE, "name_pos").agg(
        F.max(F.when(F.col("pos") == F.col("name_pos"), F.col("cell"))).alias("name"),
        F.max(F.when(F.col("pos") == F.col("name_pos"), F.col("table_no"))).alias("table_no"),
        F.max(F.when(F.col("pos") == F.col("price_pos"), F.col("cell"))).alias("amount"),
        F.min_by(memory, F.when(memory.isNotNull(), F.col("pos"))).alias("memory"),
    )
    read = (
        rows.where(F.length("name") <= 40)
        .join(counts, [*PAGE, "table_no"])
        .withColumn("price", markup.first_amount("amount"))
        .where((F.col("price") > 0) & names_product("name"))
        .withColumn("gpu", label_reading("name", F.col("memory")))
    )
    return read.select(
        *PAGE, F.concat(F.col("gpu_count").cast("string"), F.lit("x "), "name", F.lit(" (tab)")).alias("sku"), "gpu.gpu_model",
        "gpu_count", F.round(F.col("price") * F.col("gpu_count"), 6).alias("price_per_instance_hour"),
        F.lit("on_demand").alias("commitment"), "gpu.form_factor", "gpu.interconnect", "gpu.vram_gb",
        F.lit("quoted").alias("price_kind"), F.col("amount").alias("note"),
    )


def offer_cards(cells: DataFrame) -> DataFrame:
    """Offers headed by a commitment and a fabric, then a rate, then "8-1016 HGX H100 GPUs".

    The smallest rentable count is the configuration; the rate is per GPU.
    """
    place = Window.partitionBy(*PAGE).orderBy("pos")
    ahead = [F.lead("cell", n).over(place) for n in range(1, 6)]
    marked = cells.withColumns({f"c{n}": c for n, c in enumerate(ahead, 1)}).where(
        (F.length("cell") <= 60) & F.col("cell").rlike(OFFER_HEAD) & F.col("c1").rlike(OFFER_RATE)
    )
    units = F.coalesce(*[F.when(F.col(f"c{n}").rlike(OFFER_UNITS), F.col(f"c{n}")) for n in range(2, 6)])
    fabric = F.lower(F.regexp_extract("cell", OFFER_HEAD, 2))
    rows = marked.withColumn("units", units).where("units is not null").withColumns(
        {
            "gpu_count": F.regexp_extract("units", OFFER_UNITS, 1).cast("int"),
            "gpu": label_reading(F.regexp_extract("units", OFFER_UNITS, 2)),
            "price": markup.first_amount("c1"),
            "commitment": F.when(F.lower("cell").startswith("on"), "on_demand").otherwise("reserved"),
            "fabric": F.when(fabric.contains("infiniband"), "infiniband").when(fabric.rlike("ethernet|roce"), "ethernet"),
        }
    ).where("gpu is not null")
    return rows.select(
        *PAGE, F.concat("cell", F.lit(" ("), F.regexp_extract("units", OFFER_UNITS, 0), F.lit(")")).alias("sku"),
        "gpu.gpu_model", "gpu_count", F.round(F.col("price") * F.col("gpu_count"), 6).alias("price_per_instance_hour"),
        "commitment", "gpu.form_factor", F.coalesce("fabric", "gpu.interconnect").alias("interconnect"), "gpu.vram_gb",
        F.lit("quoted").alias("price_kind"), F.concat("c1", F.lit(" per GPU")).alias("note"),
    )


def price_cards(cells: DataFrame, span: int = 8) -> DataFrame:
    """Cards: a product, its prices, then a label saying what kind of price.

    The last price before that label is the one charged; an earlier one is
    struck through. The GPU count is stated after it or in the product's name.
    """
    place = Window.partitionBy(*PAGE).orderBy("pos")
    cell, low = F.col("cell"), F.lower("cell")
    name = F.regexp_extract("cell", CARD_LABEL, 1)
    marked = cells.withColumns(
        {
            "is_card": (F.length(cell) <= 30) & low.startswith("nvidia") & (name != "") & names_product(name),
            "is_price": cell.rlike(CARD_PRICE),
            "is_kind": F.regexp_replace(low, r"\*+$", "").endswith("price") & ~cell.rlike(CARD_PRICE),
            "is_unit": low.startswith("/gpu"),
            "next_cell": F.lead("cell", 1).over(place),
        }
    ).withColumn(
        "stated_count",
        F.when((low == "gpus per droplet") & F.col("next_cell").rlike(r"^\d+$"), F.col("next_cell").try_cast("int")),
    )
    marked = marked.withColumn(
        "count_ahead", F.first("stated_count", ignorenulls=True).over(place.rangeBetween(1, 3))
    )
    placed = marked.withColumn(
        "card", F.last(F.when(F.col("is_card"), F.struct("pos", "cell")), ignorenulls=True).over(place)
    ).where(f"card is not null and pos > card.pos and pos <= card.pos + {span}")
    row = Window.partitionBy(*PAGE, "card.pos").orderBy("pos")
    # a card is read only up to the first cell that is none of price, unit or kind
    reach = (
        placed.withColumn("stray", F.when(~(F.col("is_price") | F.col("is_kind") | F.col("is_unit")), 1).otherwise(0))
        .withColumn("strays", F.sum("stray").over(row))
        .withColumn("kinds_before", F.sum(F.col("is_kind").cast("int")).over(row.rowsBetween(Window.unboundedPreceding, -1)))
        .where("strays = 0 and coalesce(kinds_before, 0) = 0")
    )
    kind = F.lower("kind_cell")
    cards = (
        reach.groupBy(*PAGE, "card")
        .agg(
            F.max_by("cell", F.when(F.col("is_price"), F.col("pos"))).alias("amount"),
            F.min_by("cell", F.when(F.col("is_price"), F.col("pos"))).alias("first_amount"),
            F.max(F.when(F.col("is_kind"), F.col("cell"))).alias("kind_cell"),
            F.max(F.when(F.col("is_kind"), F.col("count_ahead"))).alias("count_ahead"),
        )
        .withColumn(
            "commitment",
            F.when(kind.contains("reserved"), "reserved")
            .when(kind.rlike("on-demand|on demand"), "on_demand")
            .when(kind.contains("spot"), "spot"),
        )
        .withColumn("price", markup.first_amount("amount"))
        .where("price > 0 and commitment is not null")
        .withColumn("gpu", label_reading(F.regexp_extract("card.cell", CARD_LABEL, 1)))
        .withColumn(
            "gpu_count",
            F.coalesce(
                "count_ahead", F.nullif(F.regexp_extract("card.cell", CARD_LABEL, 2), F.lit("")).cast("int"), F.lit(1)
            ),
        )
    )
    return cards.select(
        *PAGE, F.concat("card.cell", F.lit(" ["), "kind_cell", F.lit("]")).alias("sku"), "gpu.gpu_model", "gpu_count",
        F.round(F.col("price") * F.col("gpu_count"), 6).alias("price_per_instance_hour"), "commitment",
        "gpu.form_factor", "gpu.interconnect", "gpu.vram_gb", F.lit("quoted").alias("price_kind"),
        F.concat("amount", F.lit("/GPU/hour, '"), "kind_cell", F.lit("'")).alias("note"),
    )


def footnoted_terms(pages: DataFrame) -> DataFrame:
    """Footnotes that explain an asterisked price: (stars, price) to its commitment."""
    text = F.array_join(markup.cells("html"), " | ")
    notes = pages.select(*PAGE, text.alias("t")).where(F.col("t").contains("pricing is for"))
    return notes.select(
        *PAGE,
        F.explode(
            F.arrays_zip(
                *[
                    F.regexp_extract_all("t", F.lit(f"(?i){FOOTNOTE}"), F.lit(i)).alias(n)
                    for i, n in ((1, "stars"), (2, "price"), (3, "term"))
                ]
            )
        ).alias("n"),
    ).select(*PAGE, "n.stars", F.col("n.price").cast("double").alias("price"), "n.term").distinct()


def starred_cards(cells: DataFrame, notes: DataFrame) -> DataFrame:
    """Cards of "$ | 3.09* | / hour | spec line".

    A price counts only when the spec line names the card's own family. A starred
    price is what its footnote says it is, and nothing without one.
    """
    place = Window.partitionBy(*PAGE).orderBy("pos")
    look = lambda n: F.lead("cell", n).over(place)
    clean = F.regexp_replace(F.replace("cell", F.lit("-"), F.lit(" ")), r"(\d{2,3})G$", "$1GB")
    marked = cells.withColumns({"label": clean, "is_card": (F.length("cell") <= 12) & names_product(clean), "c1": look(1), "c2": look(2), "c3": look(3)})
    placed = marked.withColumn(
        "card",
        F.last(F.when(F.col("is_card"), F.struct("pos", "cell", "label")), ignorenulls=True).over(place),
    ).where("cell = '$' and card is not null and pos <= card.pos + 14")
    number = STARRED_NUMBER
    spec = label_reading("c3")
    priced = (
        placed.where(F.col("c1").rlike(number) & F.lower("c2").startswith("/ hour"))
        .withColumns(
            {
                "price": F.regexp_extract("c1", number, 1).cast("double"),
                "stars": F.regexp_extract("c1", number, 2),
                "family": F.split(label_reading("card.label")["gpu_model"], " ").getItem(0),
                "spec_family": F.split(spec["gpu_model"], " ").getItem(0),
            }
        )
        .where("family = spec_family")
        .join(notes, [*PAGE, "stars", "price"], "left")
        .where("stars = '' or term is not null")
        .withColumn("gpu", label_reading(F.concat("card.label", F.lit(" "), "c3")))
    )
    return priced.select(
        *PAGE, F.concat("card.cell", F.lit(" ("), "c3", F.lit(")")).alias("sku"), "gpu.gpu_model",
        F.lit(1).alias("gpu_count"), F.col("price").alias("price_per_instance_hour"),
        F.when(F.col("stars") == "", "on_demand").otherwise("reserved").alias("commitment"),
        "gpu.form_factor", "gpu.interconnect", "gpu.vram_gb", F.lit("quoted").alias("price_kind"),
        F.coalesce("term", F.lit("hourly card")).alias("note"),
    )


def _pieces(pages: DataFrame, text: Column, marker: str, span: int) -> DataFrame:
    """A page's text cut at every marker; the part before the first one is dropped.

    The last piece ends ``span`` characters after its marker began.
    """
    cut = pages.select(*PAGE, F.split(text, marker).alias("pieces"), F.regexp_extract_all(text, F.lit(f"({marker})"), F.lit(1)).alias("marks"))
    each = cut.select(
        *PAGE, F.posexplode("pieces").alias("pos", "piece"), F.size("pieces").alias("n"), F.length(F.try_element_at("marks", F.lit(-1))).alias("mark")
    ).where("pos > 0")
    last = F.substr("piece", F.lit(1), span - F.col("mark"))
    return each.withColumn("piece", F.when(F.col("pos") == F.col("n") - 1, last).otherwise(F.col("piece"))).drop("n", "mark")


def _offer_rows(rows: DataFrame, note: Column) -> DataFrame:
    return rows.where("price > 0 and gpu is not null").select(
        *PAGE, "sku", "gpu.gpu_model", F.lit(1).alias("gpu_count"), F.col("price").alias("price_per_instance_hour"),
        "commitment", "gpu.form_factor", "gpu.interconnect", "gpu.vram_gb", F.lit("quoted").alias("price_kind"),
        note.alias("note"),
    )


def embedded_records(pages: DataFrame) -> DataFrame:
    """Typed records embedded in a page's scripts, one price field per commitment.

    A record ends where the next begins, the last one after ``RECORD_SPAN`` characters. A
    price given as null is no price, whatever follows it.
    """
    text = F.replace("html", F.lit('\\"'), F.lit('"'))
    field = lambda key: F.nullif(F.regexp_extract("piece", RECORD_TEXT.format(key=key), 1), F.lit(""))
    number = lambda key: F.regexp_extract("piece", RECORD_NUMBER.format(key=key), 1).try_cast("double")
    records = _pieces(pages.where(F.col("html").contains("GpuType")), text, RECORD, RECORD_SPAN).withColumns(
        {"name": field("displayName"), "ident": F.coalesce(field("id"), F.lit("")), "vram": number("memoryInGb").cast("int")}
    ).where("name is not null")
    offers = records.select(
        *PAGE, "name", "ident", "vram",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("key"), F.lit(c).alias("commitment"), number(k).alias("price"))
                      for k, c in RECORD_PRICES.items()])
        ).alias("o"),
    ).select(*PAGE, "name", "ident", "vram", "o.*")
    unique = offers.dropDuplicates([*PAGE, "name", "key", "price"])
    rows = unique.withColumns(
        {
            "gpu": label_reading(F.concat("name", F.lit(" "), "ident"), F.col("vram")),
            "sku": F.concat("name", F.lit(" ("), "key", F.lit(")")),
        }
    )
    return _offer_rows(rows, F.concat(F.lit("embedded GpuType record, "), "key"))


def row_attributes(pages: DataFrame) -> DataFrame:
    """Prices kept in row attributes while the visible price is filled in by script."""
    pick = lambda *patterns: F.coalesce(
        *[F.nullif(F.regexp_extract("piece", p, 1), F.lit("")) for p in patterns]
    )
    rows = _pieces(pages.where(F.col("html").rlike(ATTRIBUTE_ROW)), F.col("html"), ATTRIBUTE_ROW, ATTRIBUTE_SPAN).withColumns(
        {
            "name": F.trim(pick(*ROW_NAMES)),
            "vram": pick(*ROW_MEMORY).cast("int"),
            "secure": pick(ROW_SECURE).cast("double"),
            "community": pick(ROW_COMMUNITY).cast("double"),
        }
    ).where("name is not null")
    long = rows.unpivot(
        [*PAGE, "name", "vram"], ["secure", "community"], "market", "price"
    ).withColumns(
        {
            "gpu": label_reading("name", F.col("vram")),
            "commitment": F.when(F.col("market") == "secure", "on_demand").otherwise("community"),
            "sku": F.concat("name", F.when(F.col("market") == "secure", " (Secure Cloud)").otherwise(" (Community Cloud)")),
        }
    )
    return _offer_rows(long, F.concat(F.lit("row attribute "), "market"))


def json_nodes(blocks: DataFrame, depth: int = 8) -> DataFrame:
    """Every object within JSON texts (column ``block``), down to ``depth`` levels, as variants ``node``."""
    spark = blocks.sparkSession
    keep = [c for c in blocks.columns if c != "block"]
    level = blocks.select(*keep, F.try_parse_json("block").alias("node")).where("node is not null")
    found = level
    for _ in range(depth):
        children = spark.tvf.variant_explode(F.col("node").outer()).select(F.col("value").alias("child"))
        level = level.lateralJoin(children).select(*keep, F.col("child").alias("node")).where("schema_of_variant(node) rlike '^(OBJECT|ARRAY)'")
        found = found.unionByName(level)
    return found.where("schema_of_variant(node) like 'OBJECT%'")


def structured_offers(pages: DataFrame) -> DataFrame:
    """schema.org product records, wherever in a page's structured data they stand: one offer per market."""
    blocks = F.regexp_extract_all("html", F.lit(STRUCTURED_DATA), F.lit(1))
    text = lambda path: F.try_variant_get("node", path, "string")
    offers = "array<struct<name:string, price:string, priceCurrency:string>>"
    listed = lambda path: F.try_variant_get("node", path, offers)
    products = json_nodes(pages.where(F.col("html").contains("ld+json")).select(*PAGE, F.explode(blocks).alias("block"))).where(
        text("$['@type']") == "Product"
    )
    rows = (
        products.select(*PAGE, F.replace(text("$.name"), F.lit(PRODUCT_TAIL), F.lit("")).alias("name"),
                        F.explode(F.coalesce(listed("$.offers.offers"), listed("$.offers"))).alias("o"))
        .where((F.col("o.priceCurrency") == "USD") & F.col("o.name").isin(*MARKETS))
        .withColumns(
            {
                "price": F.col("o.price").try_cast("double"),
                "commitment": F.when(F.col("o.name") == MARKETS[0], "on_demand").otherwise("community"),
                "gpu": label_reading("name"),
                "sku": F.concat("name", F.lit(" ("), "o.name", F.lit(")")),
            }
        )
    )
    return _offer_rows(rows, F.concat(F.lit("schema.org Offer '"), "o.name", F.lit("'")))


def _ahead(cells: DataFrame, n: int) -> DataFrame:
    place = Window.partitionBy(*PAGE).orderBy("pos")
    return cells.withColumns({f"c{i}": F.lead("cell", i).over(place) for i in range(1, n + 1)})


def sized_instances(cells: DataFrame) -> DataFrame:
    """Rows below an on-demand heading: a label, the count, the memory of a card, more sizes, the instance's price.

    The label may stand twice. Counts and memories that no instance has are not read.
    """
    place = Window.partitionBy(*PAGE).orderBy("pos")
    head = F.max(F.lower("cell").startswith(SIZED_HEAD)).over(place)
    near = _ahead(cells, 9).withColumn("below", head)
    shift = F.col("c1") == F.col("cell")
    at = lambda i: F.when(shift, F.col(f"c{i + 1}")).otherwise(F.col(f"c{i}"))
    whole = lambda c: F.when(c.rlike(r"^\d+$"), c.try_cast("int"))
    amounts = [F.when(at(i).rlike(SIZED_PRICE), at(i)) for i in range(3, 9)]
    rows = near.where(F.col("below") & (F.length("cell") <= 30)).select(
        *PAGE, F.col("cell").alias("label"), whole(at(1)).alias("gpu_count"), whole(at(2)).alias("vram"), F.coalesce(*amounts).alias("amount"),
    ).where(F.col("gpu_count").isin(*SIZED_COUNTS) & F.col("vram").isin(*SIZED_MEMORY) & F.col("amount").isNotNull())
    rows = rows.withColumns({"gpu": label_reading("label", F.col("vram")), "price": markup.first_amount("amount")}).where("gpu is not null and price > 0")
    return rows.select(
        *PAGE, F.concat("label", F.lit(" x"), F.col("gpu_count").cast("string")).alias("sku"), "gpu.gpu_model", "gpu_count",
        F.col("price").alias("price_per_instance_hour"), F.lit("on_demand").alias("commitment"), "gpu.form_factor", "gpu.interconnect",
        "gpu.vram_gb", F.lit("quoted").alias("price_kind"), F.concat("amount", F.lit(" per instance-hour")).alias("note"),
    )


def component_table(cells: DataFrame) -> DataFrame:
    """Rows of a table of GPU component prices: a label, three whole numbers, the price of the GPU alone.

    They carry ``basis`` gpu_component: the host is billed beside them.
    """
    page = Window.partitionBy(*PAGE)
    spoken = F.max((F.length("cell") < 60) & F.lower("cell").contains(COMPONENT_HEAD)).over(page)
    near = _ahead(cells, 4).withColumn("spoken", spoken)
    rows = near.where(
        F.col("spoken") & (F.length("cell") <= 30) & F.col("c1").rlike(WHOLE_NUMBER) & F.col("c2").rlike(WHOLE_NUMBER)
        & F.col("c3").rlike(WHOLE_NUMBER) & F.col("c4").rlike(SIZED_PRICE)
    ).withColumns(
        {"gpu": label_reading("cell", F.replace("c1", F.lit(","), F.lit("")).try_cast("int")), "price": markup.first_amount("c4")}
    ).where("gpu is not null")
    return rows.select(
        *PAGE, F.concat("cell", F.lit(" (GPU component)")).alias("sku"), "gpu.gpu_model", F.lit(1).alias("gpu_count"),
        F.col("price").alias("price_per_instance_hour"), F.lit("on_demand").alias("commitment"), "gpu.form_factor", "gpu.interconnect",
        "gpu.vram_gb", F.lit("quoted").alias("price_kind"), F.concat("c4", F.lit(" for the GPU alone")).alias("note"),
        F.lit("gpu_component").alias("basis"),
    )


def market_cards(cells: DataFrame, span: int = 12) -> DataFrame:
    """Cards of a label and its memory, then hourly rates each followed by the name of its market.

    A card ends at the next memory cell or at "starting from", whose figure is no rate.
    """
    place = Window.partitionBy(*PAGE).orderBy("pos")
    near = _ahead(cells, 1).withColumns(
        {
            "memory": F.nullif(F.regexp_extract("c1", MARKET_MEMORY, 1), F.lit("")).cast("int"),
            "stops": F.col("cell").rlike(MARKET_MEMORY) | F.lower("cell").startswith("starting from"),
        }
    )
    opens = (F.length("cell") <= 24) & F.col("memory").isNotNull() & names_product("cell")
    placed = near.withColumn("card", F.last(F.when(opens, F.struct("pos", "cell", "memory")), ignorenulls=True).over(place))
    card = Window.partitionBy(*PAGE, "card.pos").orderBy("pos")
    own = placed.where(f"card is not null and pos >= card.pos + 2 and pos < card.pos + {span}").withColumn("ended", F.max("stops").over(card))
    market = F.lower("c1")
    rows = own.where(~F.col("ended") & F.col("cell").rlike(MARKET_RATE)).withColumns(
        {
            "commitment": F.when(market.contains("secure"), "on_demand").when(market.contains("community"), "community"),
            "gpu": label_reading("card.cell", F.col("card.memory")),
            "price": markup.first_amount("cell"),
            "sku": F.concat("card.cell", F.lit(" ("), "c1", F.lit(")")),
        }
    ).where("commitment is not null")
    return _offer_rows(rows, F.concat(F.lit("card: "), "cell", F.lit(" "), "c1"))


def on_demand_notes(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """Footnotes that state a card's on-demand price; the form comes from the spec line of the family's last card."""
    text = F.array_join(markup.cells("html"), " | ")
    notes = pages.select(*PAGE, text.alias("t")).where(F.lower("t").contains("on-demand pricing for"))
    found = notes.select(
        *PAGE,
        F.explode(
            F.arrays_zip(*[
                F.regexp_extract_all("t", F.lit(f"(?i){ON_DEMAND_NOTE}"), F.lit(i)).alias(n) for i, n in ((0, "whole"), (1, "label"), (2, "price"))
            ])
        ).alias("n"),
    ).select(*PAGE, "n.whole", "n.label", F.col("n.price").cast("double").alias("price"), F.upper(F.split("n.label", "-")[0]).alias("family"))
    specs = cards.select(
        *PAGE, F.split("gpu_model", " ")[0].alias("family"), F.regexp_extract("sku", r"\((.*)\)$", 1).alias("spec")
    ).groupBy(*PAGE, "family").agg(F.max("spec").alias("spec"))
    rows = found.join(specs, [*PAGE, "family"], "left").withColumns(
        {
            "gpu": label_reading(F.concat_ws(" ", "label", "spec")), "commitment": F.lit("on_demand"),
            "sku": F.concat("label", F.lit(" (footnote)")),
        }
    )
    return _offer_rows(rows, F.concat(F.lit("footnote: '"), "whole", F.lit("'")))


def stated_once(rows: DataFrame) -> DataFrame:
    """Rows of a page without their repeats: a desktop and a mobile copy of a table state each price once."""
    return rows.distinct()


def first_layout(pages: DataFrame, *readings: DataFrame) -> DataFrame:
    """Rows of the first reading that yields any for a page."""
    tagged = [r.withColumn("layout_no", F.lit(i)) for i, r in enumerate(readings)]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    best = rows.groupBy(*PAGE).agg(F.min("layout_no").alias("layout_no"))
    return rows.join(best, [*PAGE, "layout_no"], "left_semi").drop("layout_no")


def component_priced(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Mark rows of pages that bill host CPU or memory separately: in brackets, or as an add-on with a price of its own."""
    after = F.lead("cell", 1).over(Window.partitionBy(*PAGE).orderBy("pos"))
    added = (F.lower("cell") == "vcpu") & F.coalesce(after.startswith("$"), F.lit(False))
    bracketed = (F.length("cell") < 80) & F.col("cell").rlike(HOST_PRICED)
    billed = cells.withColumn("billed", added | bracketed).where("billed").select(*PAGE).distinct()
    given = F.col("basis") if "basis" in rows.columns else F.lit("instance")
    return rows.join(billed.withColumn("host_priced", F.lit(True)), PAGE, "left").withColumn(
        "basis", F.when(F.col("host_priced"), "gpu_component").otherwise(given)
    ).drop("host_priced")
