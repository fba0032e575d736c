"""From raw observations to index inputs, for every run and rule version at once.

One table comes out, with an ``outcome`` per row and version. Nothing is
filtered along the way, so the kept quotes, the rejection tallies, the book
hold-outs and the funnel are all projections of the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import labels, regions
from ..sources.staging import written
from .aliases import with_code
from .evidence import administered

KEPT = "kept"


def identity_reason() -> Column:
    """Why a row is a different product: a label token first, then stated memory."""
    w = F.col("label_words")
    by_label = F.lit(None).cast("string")
    for code, (token, reason) in rules.IDENTITY_TOKENS.items():
        hit = (F.col("index_code") == code) & F.array_contains(w, token)
        by_label = F.when(hit, F.lit(reason)).otherwise(by_label)
    vram = rules.contract_of().getField("vram_gb")
    misses = lambda r: F.abs(r - vram) > rules.VRAM_TOLERANCE * vram
    total = F.col("vram_gb").cast("double")
    per_card = F.when(F.col("gpu_count") > 1, total / F.col("gpu_count"))
    by_memory = F.when(
        (F.col("vram_gb") > 0) & misses(total) & F.coalesce(misses(per_card), F.lit(True)),
        F.lit("stated memory is another product's"),
    )
    return F.coalesce(by_label, by_memory)


def node_factor(curve: Column) -> Column:
    reached = F.get(F.filter(curve, lambda s: F.col("gpu_count") >= s["gpus"]), F.lit(0))
    return F.when(F.col("gpu_count") >= rules.NODE_SIZE, F.lit(1.0)).otherwise(
        F.coalesce(reached["factor"], F.try_element_at(curve, F.lit(-1))["factor"], F.lit(1.0))
    )


def with_index(obs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Per-GPU price, the label's words and the contract they name, by the registry's aliases or by a table of them."""
    worded = obs.withColumn("usd_per_gpu_hour", F.col("usd_per_hour_total") / F.col("gpu_count")).withColumn("label_words", labels.words("gpu_model"))
    if aliases is not None:
        return with_code(worded, aliases)
    return worded.withColumn("index_code", labels.contract_code(F.col("label_words")))


def with_facts(obs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``with_index`` and both region screens, each different label and region read once.

    What they say is a function of the text alone, and reading a text costs more than all
    else that is done with a row. The different ones are written tables: the planner
    broadcasts them if they are small, and a common text is no heavier than a rare one.
    """
    seen = written(obs.select("gpu_model", "region").distinct(), "labels-and-regions")
    screens = {"region_exact": regions.passes_exact(), "region_loose": regions.passes_substring()}
    by_region = written(seen.select("region").distinct().withColumns(screens).withColumnRenamed("region", "__region"), "regions")
    out = obs.join(by_region, F.col("region").eqNullSafe(F.col("__region"))).drop("__region")
    if aliases is not None:
        return with_index(out, aliases)
    return with_labels(out, seen)


def with_labels(obs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``with_index`` by the registry's aliases, each different label (of ``seen``, or of the rows themselves) read once."""
    words = (obs if seen is None else seen).select("gpu_model").distinct().withColumn("label_words", labels.words("gpu_model"))
    coded = words.withColumn("index_code", labels.contract_code(F.col("label_words")))
    by_label = written(coded.withColumnRenamed("gpu_model", "__label"), "labels")
    out = obs.withColumn("usd_per_gpu_hour", F.col("usd_per_hour_total") / F.col("gpu_count"))
    return out.join(by_label, F.col("gpu_model").eqNullSafe(F.col("__label"))).drop("__label")


def restate(obs: DataFrame, versions: rules.Registry) -> DataFrame:
    """Screen and restate every row under every version.

    Adds ``reject_code`` (null when the row survives), the four factors, their
    product and the restated price. The first failing rule gives the code. Rows that
    carry ``wanted_versions`` (positions in the registry) are read under those only, and
    rows of ``with_facts`` bring their regions' verdicts along.
    """
    m = rules.ByOrdinal(versions)
    facts = obs.withColumn("identity_reason", identity_reason())
    if "region_exact" not in obs.columns:
        facts = facts.withColumns({"region_exact": regions.passes_exact(), "region_loose": regions.passes_substring()})
    each = F.explode("wanted_versions") if "wanted_versions" in obs.columns else rules.each_version(versions)
    rows = facts.select("*", each.alias("version_no")).drop("wanted_versions")
    fabric_ok = F.col("interconnect").isin("nvlink", "infiniband")
    rows = rows.withColumns(
        {
            "methodology_version": m["version"],
            "book_floor_basis": m["book_floor_basis"],
            "form_factor_x": F.element_at(m["form_factors"], F.col("form_factor")),
            "interconnect_x": F.when(fabric_ok, F.lit(1.0)).otherwise(
                F.element_at(m["interconnects"], F.col("interconnect"))
            ),
            "commitment_x": F.element_at(m["commitments"], F.col("commitment")),
            "node_x": node_factor(m["node_curve"]),
        }
    ).withColumn(
        "total_x",
        F.col("form_factor_x") * F.col("interconnect_x") * F.col("commitment_x") * F.col("node_x"),
    )
    region_ok = F.when(m["exact_region"], F.col("region_exact")).otherwise(F.col("region_loose"))
    code = (
        F.when(F.col("index_code").isNull(), "unmatched_model")
        .when(m["exclude_from_floor"] & (F.col("price_kind") == "from_floor"), "from_floor")
        .when(m["require_quoted_currency"] & (F.upper("currency") != "USD"), "currency_unsupported")
        .when(m["product_identity"] & F.col("identity_reason").isNotNull(), "product_identity")
        .when(~region_ok, "region_mismatch")
        .when(F.col("usd_per_gpu_hour") <= 0, "nonpositive_price")
        .when(F.col("total_x") > m["max_total_adjustment"], "over_adjusted")
    )
    return rows.withColumns(
        {
            "reject_code": code,
            "normalized_usd_per_gpu_hour": F.col("usd_per_gpu_hour") * F.col("total_x"),
        }
    ).drop("region_exact", "region_loose", "label_words", "version_no")


def adjustments() -> Column:
    """The factors applied to a row, in order, as an audit array."""
    c = rules.contract_of()

    def step(name: str, factor: str, why: Column, when: Column) -> Column:
        return F.when(
            when, F.struct(F.lit(name).alias("name"), F.col(factor).alias("factor"), why.alias("rationale"))
        )

    steps = F.array(
        step("form_factor", "form_factor_x",
             F.concat(F.lit("observed "), "form_factor", F.lit(" restated to "), c["form_factor"]),
             F.col("form_factor_x") != 1.0),
        step("interconnect", "interconnect_x",
             F.concat(F.lit("observed "), "interconnect", F.lit(" restated to "), c["interconnect"]),
             F.col("interconnect_x") != 1.0),
        step("commitment", "commitment_x",
             F.concat(F.lit("observed "), "commitment", F.lit(" restated to on-demand")),
             F.col("commitment") != "on_demand"),
        step("node_size", "node_x",
             F.concat(F.col("gpu_count").cast("string"), F.lit("-GPU offer restated to a "),
                      c["node_size"].cast("string"), F.lit("-GPU node")),
             F.col("node_x") != 1.0),
    )
    return F.filter(steps, lambda s: s.isNotNull())


def book_population(rows: DataFrame, run: list[str], versions: rules.Registry) -> DataFrame:
    """Machines and hosts behind each marketplace book, on the version's own basis.

    "book" counts every informative row matched to the index; "priced" counts
    only the rows that survived every screen. The distinct counts are partially
    aggregated on the identifiers, so one large book is spread over tasks.
    """
    m = rules.rules_of(versions)
    counted = F.when(F.col("book_floor_basis") == "priced", F.col("reject_code").isNull()).otherwise(
        F.col("index_code").isNotNull()
    )
    books = rows.where(F.col("source").isin(*rules.BOOK_SOURCES) & ~F.col("administered") & counted)
    keys = [*run, "methodology_version", "source", "index_code"]
    sizes = books.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("book_rows"),
        F.countDistinct("machine_id").alias("machines"),
        F.countDistinct("host_id").alias("hosts"),
    )
    priced = m["book_floor_basis"] == "priced"
    # fixed wording: the tape carries these sentences, and verification compares them
    rows_text = F.concat(F.col("book_rows").cast("string"), F.when(priced, F.lit(" priced rows")).otherwise(F.lit(" rows")))
    enabled = (m["min_book_machines"] > 0) | (m["min_book_hosts"] > 0)
    short = lambda have, need, what: F.concat(
        F.col(have).cast("string"), F.lit(f" distinct {what} of "), need.cast("string"),
        F.lit(" required across "), rows_text,
    )
    reason = (
        F.when(~enabled, F.lit(None))
        .when(
            (F.col("machines") == 0) & (F.col("hosts") == 0),
            F.concat(F.lit("none of its "), rows_text,
                     F.lit(" identify a machine or host, so the population is unproven")),
        )
        .when((m["min_book_machines"] > 0) & (F.col("machines") < m["min_book_machines"]),
              short("machines", m["min_book_machines"], "machines"))
        .when((m["min_book_hosts"] > 0) & (F.col("hosts") < m["min_book_hosts"]),
              short("hosts", m["min_book_hosts"], "hosts"))
    )
    tail = F.when(
        priced,
        F.lit(" after the region screen and restatement; a median over that few "
              "sellers is one seller's rate card wearing a marketplace's name"),
    ).otherwise(F.lit("; a median over that few sellers is one seller's rate card wearing a marketplace's name"))
    return sizes.withColumn("held_reason", reason).withColumn(
        "detail",
        F.when(F.col("held_reason").isNotNull(),
               F.concat("source", F.lit(" held out of "), "index_code", F.lit(": "), "held_reason", tail)),
    )


def prepare(obs: DataFrame, run: list[str], versions: rules.Registry, aliases: DataFrame | None = None) -> DataFrame:
    """Every observation under every version with its ``outcome``.

    ``obs`` carries the run columns, the observation columns and machine_id /
    host_id; ``aliases`` is a table (code, alias, place) in place of the registry's. The order of the stages is the version's: a "book" floor acts
    before the screens, a "priced" floor after them.
    """
    return prepare_with_books(obs, run, versions, aliases)[0]


def prepare_with_books(
    obs: DataFrame, run: list[str], versions: rules.Registry, aliases: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The prepared rows, and the marketplace books behind them as ``book_population`` counts them, written."""
    indexed = with_facts(obs, aliases)
    excluded = administered(obs.withColumn("usd_per_gpu_hour", F.col("usd_per_hour_total") / F.col("gpu_count")), run).select(*run, "source", "commitment", F.lit(True).alias("administered"))
    marked = indexed.join(excluded, [*run, "source", "commitment"], "left").withColumn(
        "administered", F.coalesce("administered", F.lit(False))
    )
    rows = restate(marked, versions)
    # Written first: with its size known from the files, the planner broadcasts it
    # when it is small and never shuffles the observations for it.
    books = written(book_population(rows, run, versions), "books")
    held = books.where(F.col("held_reason").isNotNull()).select(
        *run, "methodology_version", "source", "index_code", F.lit(True).alias("held")
    )
    rows = rows.join(held, [*run, "methodology_version", "source", "index_code"], "left")
    priced = F.col("book_floor_basis") == "priced"
    outcome = (
        F.when(F.col("administered"), "administered")
        .when(F.col("held") & ~priced, "book_population_floor")
        .when(F.col("reject_code").isNotNull(), F.col("reject_code"))
        .when(F.col("held"), "book_population_floor")
        .otherwise(KEPT)
    )
    return rows.withColumn("outcome", outcome).drop("held"), books


def quotes(prepared: DataFrame) -> DataFrame:
    return prepared.where(F.col("outcome") == KEPT)


def rejection_flags(prepared: DataFrame, run: list[str]) -> DataFrame:
    """Rows turned away per run, version and code."""
    stages = ("administered", "book_population_floor", KEPT)
    return (
        prepared.where(~F.col("outcome").isin(*stages))
        .groupBy(*run, "methodology_version", "outcome")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            *run,
            "methodology_version",
            F.when(F.col("outcome").isin(*rules.QUIET_REJECTIONS), "info").otherwise("warn").alias("severity"),
            F.concat(F.lit("rejected_"), "outcome").alias("code"),
            "rows",
        )
    )


def venue_holdouts(population: DataFrame, run: list[str]) -> DataFrame:
    """The tape cell per fixing: every floor hold-out, by venue, joined.

    The list is bounded by the number of registered marketplace feeds.
    """
    return (
        population.where(F.col("held_reason").isNotNull())
        .groupBy(*run, "methodology_version", "index_code")
        .agg(F.array_sort(F.collect_list(F.struct("source", "detail"))).alias("held"))
        .withColumn("venue_holdouts", F.array_join(F.transform("held", lambda h: h["detail"]), " | "))
        .drop("held")
    )


def funnel(prepared: DataFrame, run: list[str]) -> DataFrame:
    """How many rows leave at each stage, per run, version and index."""
    return prepared.groupBy(*run, "methodology_version", "index_code").agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(F.col("outcome") == "administered").alias("administered"),
        *[
            F.count_if(F.col("outcome") == code).alias(code)
            for code in ("unmatched_model", "from_floor", "currency_unsupported", "product_identity",
                         "region_mismatch", "nonpositive_price", "over_adjusted")
        ],
        F.count_if(F.col("outcome") == "book_population_floor").alias("held_out"),
        F.count_if(F.col("outcome") == KEPT).alias("normalised"),
    )


def trace(prepared: DataFrame, keep: list[str]) -> DataFrame:
    """Per-quote restatement, one row per factor, with the running product and headroom.

    Rows that were turned away appear once, with their outcome.
    """
    steps = prepared.select(
        *keep,
        "methodology_version",
        "index_code",
        "outcome",
        "usd_per_gpu_hour",
        "total_x",
        F.posexplode_outer(F.when(F.col("outcome") == KEPT, adjustments())).alias("step", "adj"),
        F.when(F.col("outcome") == KEPT, adjustments()).alias("all_adj"),
    )
    product = F.aggregate(
        F.slice("all_adj", F.lit(1), F.col("step") + 1), F.lit(1.0), lambda acc, a: acc * a["factor"]
    )
    return steps.select(
        *keep,
        "methodology_version",
        "index_code",
        "outcome",
        "usd_per_gpu_hour",
        "step",
        F.col("adj.name").alias("name"),
        F.col("adj.factor").alias("factor"),
        F.when(F.col("step").isNotNull(), product).alias("cumulative"),
        F.when(F.col("outcome") == KEPT, F.lit(rules.MAX_TOTAL_ADJUSTMENT) - F.col("total_x")).alias("headroom"),
    )
