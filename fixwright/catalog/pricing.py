"""Queries over preparation, evidence and the estimator."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import labels, regions
from ..operators import aliases as A
from ..operators import estimate as E
from ..operators import evidence as V
from ..operators import prepare as P
from ..operators import quality as Q
from ..sources import snapshots
from .registry import day, r6, register
from .sql import query
from .workspace import KEYS, RUN

D = "CAST(d AS VARCHAR) AS index_date"
K = f"{D}, code AS index_code, ver AS methodology_version"
VER = "methodology_version"


# --- scans and preparation --------------------------------------------------
@register(
    "snapshot_runs",
    query("SELECT snapshot, count(*) AS observations, strftime(min(observed_at), '%Y-%m-%d') AS captured_at FROM obs GROUP BY 1", "obs"),
)
def _(ws):
    return snapshots.runs(ws.scan()).select("snapshot", "observations", day("captured_at"))


@register(
    "quote_fingerprint",
    query(
        """SELECT source, source_sku, snapshot, substr(sha256('{"commitment": "' || commitment || '", "gpus": ' || gpu_count ||
        ', "price": ' || regexp_replace(regexp_replace(CAST(CAST(round(total, 6) AS DECIMAL(28,6)) AS VARCHAR), '0+$', ''), '\\.$', '.0') ||
        ', "region": ' || coalesce('"' || region || '"', 'null') || ', "sku": "' || source_sku || '", "source": "' || source || '"}'), 1, 16) AS fingerprint
        FROM obs""",
        "obs",
    ),
)
def _(ws):
    return snapshots.with_fingerprint(ws.scan()).select("source", "source_sku", "snapshot", "fingerprint")


@register(
    "provider_summary",
    query("SELECT snapshot, source, count(*) AS \"rows\" FROM obs GROUP BY ALL", "obs"),
)
def _(ws):
    return snapshots.provider_summary(ws.scan(), ["snapshot"])


@register(
    "contract_match",
    query("SELECT gpu_model, code AS index_code, count(*) AS \"rows\" FROM obs JOIN models USING (gpu_model) GROUP BY ALL", "models"),
)
def _(ws):
    return P.with_index(ws.scan()).groupBy("gpu_model", "index_code").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "contract_match_table",
    """WITH alias AS (SELECT tok, arg_min(code, place) AS code FROM (
          SELECT lower(p_name) || ' ' || p_size AS tok, p_brand AS code, p_partkey AS place FROM part WHERE p_size < 25
          UNION ALL SELECT lower(p_name), p_brand, p_partkey + 1000000000 FROM part WHERE p_size % 2 = 0
          UNION ALL SELECT split_part(lower(p_name), ' ', 1), p_type, p_partkey + 2000000000 FROM part) GROUP BY tok),
        shown AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN p_name || '_' || p_size || ' XL' WHEN 1 THEN upper(p_name) || '-' || p_size
            WHEN 2 THEN split_part(p_name, ' ', 1) || '  v' || p_size ELSE split_part(p_name, ' ', 1) || 's' END AS label, count(*) AS n
          FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
        normed AS (SELECT *, trim(regexp_replace(lower(label), '[\\s_-]+', ' ', 'g')) AS norm FROM shown)
        SELECT s.label AS gpu_model, arg_max(a.code, length(a.tok)) AS index_code, any_value(s.n) AS "rows"
        FROM normed s LEFT JOIN alias a ON s.norm = a.tok OR starts_with(s.norm, a.tok || ' ') GROUP BY s.label""",
)
def _(ws):
    """Labels of line items against a table with up to three aliases for each part."""
    part, lines = ws.table("part"), ws.table("lineitem")
    word = F.split("p_name", " ")[0]
    aliases = part.where("p_size < 25").select(F.col("p_brand").alias("code"), F.concat_ws(" ", "p_name", "p_size").alias("alias"), F.col("p_partkey").alias("place"))
    aliases = aliases.union(part.where("p_size % 2 = 0").select("p_brand", "p_name", F.col("p_partkey") + 1_000_000_000))
    aliases = aliases.union(part.select("p_type", word, F.col("p_partkey") + 2_000_000_000))
    kind = F.col("l_linenumber") % 4
    label = (
        F.when(kind == 0, F.concat("p_name", F.lit("_"), "p_size", F.lit(" XL"))).when(kind == 1, F.concat(F.upper("p_name"), F.lit("-"), "p_size"))
        .when(kind == 2, F.concat(word, F.lit("  v"), "p_size")).otherwise(F.concat(word, F.lit("s")))
    )
    rows = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).select(label.alias("gpu_model"))
    return A.with_code(rows, aliases).groupBy("gpu_model", "index_code").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "form_fabric_inference",
    query(
        """SELECT gpu_model, CASE WHEN contains(b, 'sxm') OR contains(b, 'oam') THEN 'sxm'
        WHEN contains(b, 'pcie') OR contains(b, 'pci-e') OR contains(b, 'nvl') THEN 'pcie' ELSE 'unknown' END AS form_factor,
        CASE WHEN contains(b, 'nvl') OR contains(b, 'sxm') THEN 'nvlink' WHEN contains(b, 'infiniband') OR trim(b) = 'ib' THEN 'infiniband'
        WHEN contains(b, 'ethernet') OR contains(b, 'roce') THEN 'ethernet' WHEN contains(b, 'pcie') THEN 'none' ELSE 'unknown' END AS interconnect,
        count(*) AS "rows" FROM (SELECT gpu_model, lower(gpu_model || ' ' || interconnect) AS b FROM obs) GROUP BY ALL""",
        "obs",
    ),
)
def _(ws):
    return (
        ws.scan()
        .select("gpu_model", labels.form_factor("gpu_model", "interconnect").alias("form_factor"),
                labels.interconnect("gpu_model", "interconnect").alias("interconnect"))
        .groupBy("gpu_model", "form_factor", "interconnect").agg(F.count(F.lit(1)).alias("rows"))
    )


@register(
    "region_screen",
    query("SELECT region, loose AS substring_rule, exact AS exact_rule, count(*) AS \"rows\" FROM obs o JOIN regs r ON r.region IS NOT DISTINCT FROM o.region GROUP BY ALL".replace("SELECT region", "SELECT o.region"), "regs"),
)
def _(ws):
    return (
        ws.scan()
        .select("region", regions.passes_substring().alias("substring_rule"), regions.passes_exact().alias("exact_rule"))
        .groupBy("region", "substring_rule", "exact_rule").agg(F.count(F.lit(1)).alias("rows"))
    )


@register(
    "identity_screen",
    query(
        """SELECT code AS index_code, CASE WHEN by_label THEN 'label' ELSE 'memory' END AS found_by, count(*) AS "rows"
        FROM idx WHERE code IS NOT NULL AND (by_label OR by_memory) GROUP BY ALL""",
        "idx",
    ),
)
def _(ws):
    rows = P.with_index(ws.scan()).withColumn("why", P.identity_reason())
    found = F.when(F.col("why").startswith("stated memory"), "memory").otherwise("label")
    return rows.where("why is not null and index_code is not null").groupBy(
        "index_code", found.alias("found_by")
    ).agg(F.count(F.lit(1)).alias("rows"))


@register(
    "reject_counts",
    query(f"""SELECT {D}, ver AS methodology_version,
        CASE WHEN outcome IN ('unmatched_model', 'region_mismatch', 'product_identity') THEN 'info' ELSE 'warn' END AS severity,
        'rejected_' || outcome AS code, count(*) AS "rows" FROM prep
        WHERE outcome NOT IN ('administered', 'book_population_floor', 'kept') GROUP BY ALL""", "prep"),
)
def _(ws):
    return P.rejection_flags(ws.prepared(), ["index_date"]).withColumn("index_date", day())


@register(
    "restated_quotes",
    query(f"""SELECT {K}, source, source_sku, round(p, 6) AS raw, round(np, 6) AS normalized, round(total_x, 6) AS total_adjustment,
        tier, region FROM quotes""", "quotes"),
)
def _(ws):
    return ws.quotes().select(
        day(), "index_code", VER, "source", "source_sku", r6("usd_per_gpu_hour", "raw"),
        r6("normalized_usd_per_gpu_hour", "normalized"), r6("total_x", "total_adjustment"), "tier", "region",
    )


@register(
    "restatement_trace",
    query(f"""SELECT {D}, ver AS methodology_version, source, source_sku, code AS index_code, s.name, round(s.factor, 6) AS factor,
        round(s.cumulative, 6) AS cumulative, round(1.75e0 - total_x, 6) AS headroom
        FROM (SELECT *, unnest(list_filter([
          CASE WHEN f1 <> 1 THEN {{'name': 'form_factor', 'factor': f1, 'cumulative': f1}} END,
          CASE WHEN f2 <> 1 THEN {{'name': 'interconnect', 'factor': f2, 'cumulative': f1 * f2}} END,
          CASE WHEN commitment <> 'on_demand' THEN {{'name': 'commitment', 'factor': f3, 'cumulative': f1 * f2 * f3}} END,
          CASE WHEN f4 <> 1 THEN {{'name': 'node_size', 'factor': f4, 'cumulative': f1 * f2 * f3 * f4}} END], lambda x: x IS NOT NULL)) AS s
          FROM quotes)""", "quotes", only="1.2.0"),
)
def _(ws):
    rows = ws.prepared().where((F.col(VER) == "1.2.0") & (F.col("outcome") == P.KEPT))
    return P.trace(rows, ["index_date", "source", "source_sku"]).where("name is not null").select(
        day(), VER, "source", "source_sku", "index_code", "name", r6("factor"), r6("cumulative"), r6("headroom")
    )


@register(
    "derivation_funnel",
    query(f"""SELECT {K}, count(*) AS raw, """
          + ", ".join(
              f"count(*) FILTER (WHERE outcome = '{c}') AS {n}" for c, n in (
                  ("administered", "administered"), ("unmatched_model", "unmatched_model"), ("from_floor", "from_floor"),
                  ("currency_unsupported", "currency_unsupported"), ("product_identity", "product_identity"),
                  ("region_mismatch", "region_mismatch"), ("nonpositive_price", "nonpositive_price"),
                  ("over_adjusted", "over_adjusted"), ("book_population_floor", "held_out"), ("kept", "normalised")))
          + " FROM prep GROUP BY d, code, ver", "prep"),
)
def _(ws):
    return P.funnel(ws.prepared(), ["index_date"]).withColumn("index_date", day())


@register(
    "book_floor",
    query(f"SELECT {K}, source, book_rows, machines, hosts, held_reason FROM books", "books"),
)
def _(ws):
    rows = P.book_population(ws.prepared(), ["index_date"], rules.registry())
    return rows.select(day(), "index_code", VER, "source", "book_rows", "machines", "hosts", "held_reason")


@register("venue_holdouts", query(f"SELECT {K}, venue_holdouts FROM holds", "holds"))
def _(ws):
    return ws.holdouts().select(day(), "index_code", VER, "venue_holdouts")


# --- evidence ---------------------------------------------------------------
@register(
    "commitment_evidence",
    query(f"""SELECT {D}, source, commitment, pairs, round(median_ratio, 6) AS median_ratio, round(cv, 6) AS cv, administered,
        CASE commitment WHEN 'spot' THEN 1.45e0 WHEN 'community' THEN 1.3e0 ELSE 1.25e0 END AS asserted,
        round((median_ratio - CASE commitment WHEN 'spot' THEN 1.45e0 WHEN 'community' THEN 1.3e0 ELSE 1.25e0 END)
          / CASE commitment WHEN 'spot' THEN 1.45e0 WHEN 'community' THEN 1.3e0 ELSE 1.25e0 END, 6) AS error,
        CASE WHEN administered THEN 'administered' WHEN abs((median_ratio - CASE commitment WHEN 'spot' THEN 1.45e0 WHEN 'community' THEN 1.3e0 ELSE 1.25e0 END)
          / CASE commitment WHEN 'spot' THEN 1.45e0 WHEN 'community' THEN 1.3e0 ELSE 1.25e0 END) <= 0.1e0 THEN 'supports' ELSE 'disagrees' END AS verdict
        FROM evid""", "evid"),
)
def _(ws):
    found = V.commitment_evidence(P.with_index(ws.rows()), ["index_date"])
    return V.against_schedule(found).select(
        day(), "source", "commitment", "pairs", r6("median_ratio"), r6("cv"), "administered", "asserted", r6("error"), "verdict"
    )


@register(
    "administered_excluded",
    query(f"""SELECT {D}, source, commitment, 'info' AS severity, 'administered_pricing_excluded' AS code, pairs,
        round(median_ratio, 6) AS median_ratio, round(cv, 6) AS cv, (SELECT count(*) FROM obs o WHERE o.d = e.d AND o.source = e.source
        AND o.commitment = e.commitment) AS removed FROM evid e WHERE administered""", "evid"),
)
def _(ws):
    flags = V.administered_flags(P.with_index(ws.rows()), ["index_date"])
    return flags.select(day(), "source", "commitment", "severity", "code", "pairs", r6("median_ratio"), r6("cv"), "removed")


FORM = """SELECT d, source, code, commitment, gpu_count, min(p) FILTER (WHERE form_factor = 'pcie') AS pcie,
  min(p) FILTER (WHERE form_factor = 'sxm') AS sxm FROM idx WHERE code IS NOT NULL AND p > 0 GROUP BY d, source, code, commitment, gpu_count"""
FORM_EVID = f"SELECT d, source, code, count(*) AS pairs, median(pcie / sxm) AS mr FROM ({FORM}) WHERE pcie IS NOT NULL AND sxm IS NOT NULL GROUP BY d, source, code"


@register(
    "form_factor_ratio",
    query(f"SELECT {D}, source, code AS index_code, pairs, round(mr, 6) AS median_ratio, round(1 / mr, 6) AS implied_factor FROM ({FORM_EVID})", "idx"),
)
def _(ws):
    rows = V.form_factor_evidence(P.with_index(ws.scan()), ["index_date"])
    return rows.select(day(), "source", "index_code", "pairs", r6("median_ratio"), r6("implied_factor"))


@register(
    "form_factor_pooled",
    query(f"""SELECT {D}, count(*) AS venues, CAST(sum(pairs) AS BIGINT) AS pairs, round(median(vr), 6) AS observed_ratio,
        round(min(vr), 6) AS lowest, round(max(vr), 6) AS highest, round(1 / median(vr), 6) AS implied_factor, 1.18e0 AS asserted,
        round((1 / median(vr) - 1.18e0) / 1.18e0, 6) AS error
        FROM (SELECT d, source, median(mr) AS vr, sum(pairs) AS pairs FROM ({FORM_EVID}) GROUP BY d, source) GROUP BY d""", "idx"),
)
def _(ws):
    rows = V.form_factor_evidence(P.with_index(ws.scan()), ["index_date"])
    return V.form_factor_pooled(rows, ["index_date"]).select(
        day(), "venues", "pairs", r6("observed_ratio"), r6("lowest"), r6("highest"), r6("implied_factor"), "asserted", r6("error")
    )


# --- the estimator ----------------------------------------------------------
@register(
    "provider_votes",
    query(f"SELECT {K}, provider, round(price, 6) AS price, quote_count, best_tier, round(spread, 6) AS spread FROM votes", "votes"),
)
def _(ws):
    return ws.screened().select(day(), "index_code", VER, "provider", r6("price"), "quote_count", "best_tier", r6("spread"))


@register(
    "mad_screen",
    query(f"""SELECT {K}, provider, round(price, 6) AS price, round(pm, 6) AS panel_median, round(pmad, 6) AS panel_mad,
        round(pm - 3 * pmad * 1.4826e0, 6) AS keep_low, round(pm + 3 * pmad * 1.4826e0, 6) AS keep_high,
        round(abs(price - pm), 6) AS gap, round(sigmas, 6) AS sigmas, round(ratio, 6) AS ratio, screened_out FROM scr""", "scr"),
)
def _(ws):
    reach = F.col("panel_mad") * rules.MAD_TO_SIGMA * rules.OUTLIER_SIGMAS
    return ws.screened().select(
        day(), "index_code", VER, "provider", r6("price"), r6("panel_median"), r6("panel_mad"),
        r6(F.col("panel_median") - reach, "keep_low"), r6(F.col("panel_median") + reach, "keep_high"),
        r6(F.abs(F.col("price") - F.col("panel_median")), "gap"), r6("sigmas"), r6("ratio"), "screened_out",
    )


THIN_LOOP = """WITH RECURSIVE cap(d, code, gpu_count, provider, tier, w0, w, rnd, n) AS (
  SELECT d, code, gpu_count, provider, tier, tw, tw, 0, count(*) OVER (PARTITION BY d, code, gpu_count) FROM thin_live
  UNION ALL
  SELECT d, code, gpu_count, provider, tier, w0, CASE WHEN w / tot > 0.35e0 AND 0.35e0 * (tot - w) / (1 - 0.35e0) < w
     THEN 0.35e0 * (tot - w) / (1 - 0.35e0) ELSE w END, rnd + 1, n
  FROM (SELECT *, sum(w) OVER (PARTITION BY d, code, gpu_count) AS tot FROM cap) WHERE rnd < n AND n * 0.35e0 >= 1)"""


@register(
    "weight_cap",
    query("SELECT 1", "quotes", only="1.2.0").replace(
        "\nSELECT 1",
        """, tv AS (SELECT d, code, gpu_count, source AS provider, median(np) AS price, min(tier) AS tier FROM quotes GROUP BY ALL),
        tp AS (SELECT d, code, gpu_count, median(price) AS pm, mad(price) AS pmad, count(*) AS pn FROM tv GROUP BY ALL),
        thin_live AS MATERIALIZED (SELECT tv.*, CASE tier WHEN 1 THEN 1e0 WHEN 2 THEN 0.6e0 ELSE 0.25e0 END AS tw FROM tv JOIN tp USING (d, code, gpu_count)
          WHERE NOT (pn >= 4 AND CASE WHEN pmad > 0 THEN abs(price - pm) / (pmad * 1.4826e0) > 3
            WHEN pm > 0 AND price > 0 THEN greatest(price / pm, pm / price) > 3e0 * (1 + 1e-9) ELSE false END)),"""
        + THIN_LOOP.removeprefix("WITH RECURSIVE")
        + f""" SELECT {D}, code AS index_code, gpu_count, provider, tier AS best_tier, round(w0, 6) AS natural_weight, round(w, 6) AS weight,
        round(w / sum(w) OVER (PARTITION BY d, code, gpu_count), 12) AS share
        FROM (SELECT * FROM cap QUALIFY rnd = max(rnd) OVER (PARTITION BY d, code, gpu_count))""",
    ),
)
def _(ws):
    """Panels split by node size are thin enough for the cap to bind."""
    keys = ["index_date", "index_code", VER, "gpu_count"]
    rows = E.contributions(ws.quotes().where(F.col(VER) == "1.2.0"), keys, rules.registry("1.2.0"))
    return rows.where("not screened_out").select(
        day(), "index_code", "gpu_count", "provider", "best_tier", r6("natural_weight"), r6("weight"),
        F.round("share", 12).alias("share"),
    )


@register(
    "fixings",
    query(f"""SELECT {K}, round(value, 6) AS value, round(dispersion, 6) AS dispersion, round(value * dispersion, 6) AS band,
        provider_count, CAST(observation_count AS BIGINT) AS observation_count, tier1_present, passed FROM fix""", "fix"),
)
def _(ws):
    return ws.fixings().select(
        day(), "index_code", VER, r6("value"), r6("dispersion"), r6("band"), "provider_count", "observation_count",
        "tier1_present", "passed",
    )


@register(
    "publication",
    query(f"""SELECT {K}, CASE WHEN passed THEN 'published' ELSE 'withheld' END AS status, round(published_value, 6) AS value,
        CASE WHEN NOT passed THEN list_aggregate(list_filter([
          CASE WHEN NOT g1 THEN 'min_providers: ' || provider_count || ' of 4 required' END,
          CASE WHEN NOT g2 THEN 'min_observations: ' || CAST(observation_count AS BIGINT) || ' of 8 required' END,
          CASE WHEN NOT g3 THEN 'dispersion: ' || CASE WHEN dispersion IS NULL THEN 'not computable with fewer than 3 providers'
            ELSE printf('%.3f', dispersion) || ' against ceiling 0.45' END END], lambda x: x IS NOT NULL), 'string_agg', '; ') END AS withheld_reason
        FROM fix""", "fix"),
)
def _(ws):
    return ws.fixings().select(day(), "index_code", VER, "status", r6("published_value", "value"), "withheld_reason")


@register(
    "gate_results",
    query(f"""SELECT {K}, g.name, g.passed FROM (SELECT *, unnest([{{'name': 'min_providers', 'passed': g1}},
        {{'name': 'min_observations', 'passed': g2}}, {{'name': 'dispersion', 'passed': g3}}]) AS g FROM fix)""", "fix"),
)
def _(ws):
    return ws.fixings().select(day(), "index_code", VER, F.explode("gates").alias("g")).select(
        "index_date", "index_code", VER, "g.name", "g.passed"
    )


@register(
    "contributions",
    query(f"""SELECT {D}, s.code AS index_code, s.ver AS methodology_version, s.provider, round(s.price, 6) AS price,
        round(coalesce(w.w, 0e0), 6) AS weight, s.quote_count, s.best_tier, s.screened_out,
        round(coalesce(w.w, 0e0) / t.tot, 12) AS share
        FROM scr s LEFT JOIN weights w USING (d, code, ver, provider)
        LEFT JOIN (SELECT d, code, ver, sum(w) AS tot FROM weights GROUP BY ALL) t USING (d, code, ver)""", "weights"),
)
def _(ws):
    return ws.contributions().select(
        day(), "index_code", VER, "provider", r6("price"), r6("weight"), "quote_count", "best_tier", "screened_out",
        F.round("share", 12).alias("share"),
    )


@register(
    "dispersion_worksheet",
    query(f"""SELECT {D}, s.code AS index_code, s.ver AS methodology_version, s.provider, round(price, 6) AS price, round(lm, 6) AS live_median,
        round(abs(price - lm), 6) AS deviation, round(lmad, 6) AS live_mad, round(lmad * 1.4826e0, 6) AS sigma, round(dispersion, 6) AS dispersion
        FROM scr s JOIN disp USING (d, code, ver) WHERE NOT screened_out""", "disp"),
)
def _(ws):
    live = ws.screened().where("not screened_out")
    rows = live.join(E.dispersion(ws.screened(), KEYS), KEYS)
    return rows.select(
        day(), "index_code", VER, "provider", r6("price"), r6("live_median"),
        r6(F.abs(F.col("price") - F.col("live_median")), "deviation"), r6("live_mad"),
        r6(F.col("live_mad") * rules.MAD_TO_SIGMA, "sigma"), r6("dispersion"),
    )


BAND = 0.5


@register(
    "interquantile_value",
    query("SELECT 1", "weights", only="1.2.0").replace(
        "\nSELECT 1",
        f""", cast3 AS (SELECT d, code, ver, w / 3e0 AS m, unnest([price * (1e0 - sp), price, price * (1e0 + sp)]) AS vote
          FROM (SELECT *, least(greatest(spread, 0.03e0), 0.5e0) AS sp FROM weights) WHERE w > 0),
        walked AS (SELECT d, code, vote, m, sum(m) OVER (PARTITION BY d, code ORDER BY vote, m ROWS UNBOUNDED PRECEDING) - m AS start,
          sum(m) OVER (PARTITION BY d, code) AS tot FROM cast3),
        part AS (SELECT d, code, vote, greatest(0e0, least(start + m, (1e0 + {BAND}e0) / 2 * tot) - greatest(start, (1e0 - {BAND}e0) / 2 * tot)) AS inside FROM walked)
        SELECT {D}, code AS index_code, round(sum(inside * vote) / sum(inside), 6) AS banded_value FROM part GROUP BY d, code""",
    ),
)
def _(ws):
    half = {"1.2.0": rules.METHODOLOGIES["1.2.0"].revised("1.2.0", robustness_band=BAND)}
    rows = ws.contributions().where(F.col(VER) == "1.2.0")
    return E.interquantile(E.ballot(rows, KEYS, half), KEYS, half).select(day(), "index_code", r6("banded_value"))


VENUES = """SELECT d, code, ver, string_split(provider, ':')[1] AS venue, count(*) AS providers, sum(w) AS vw, sum(quote_count) AS quotes FROM weights GROUP BY ALL"""
SHARES = f"""SELECT *, providers / sum(providers) OVER k AS count_share, round(vw / sum(vw) OVER k, 9) AS weight_share,
  count(*) OVER k AS venue_count FROM ({VENUES}) WINDOW k AS (PARTITION BY d, code, ver)"""


@register(
    "venue_breakdown",
    query(f"""SELECT {K}, venue, providers, round(count_share, 6) AS count_share, round(weight_share, 6) AS weight_share, venue_count
        FROM ({SHARES})""", "weights"),
)
def _(ws):
    return E.venues(ws.contributions(), KEYS).select(
        day(), "index_code", VER, "venue", "providers", r6("count_share"), r6("weight_share"), "venue_count"
    )


@register(
    "concentration_flag",
    query(f"""SELECT {D}, c.code AS index_code, c.ver AS methodology_version, c.venue_count, c.venue AS count_venue, round(c.count_share, 6) AS count_share,
        w.venue AS weight_venue, round(w.weight_share, 6) AS weight_share,
        CASE WHEN w.weight_share > c.count_share THEN w.venue ELSE c.venue END AS lead_venue,
        c.count_share > 0.5e0 OR w.weight_share > 0.5e0 AS flagged
        FROM (SELECT * FROM ({SHARES}) QUALIFY row_number() OVER (PARTITION BY d, code, ver ORDER BY providers DESC, venue) = 1) c
        JOIN (SELECT * FROM ({SHARES}) QUALIFY row_number() OVER (PARTITION BY d, code, ver ORDER BY weight_share DESC, venue) = 1) w USING (d, code, ver)""",
          "weights"),
)
def _(ws):
    rows = E.concentration(E.venues(ws.contributions(), KEYS), KEYS)
    return rows.select(
        day(), "index_code", VER, "venue_count", "count_venue", r6("count_share"), "weight_venue", r6("weight_share"),
        "lead_venue", "flagged",
    )


@register(
    "weight_worksheet",
    query(f"""SELECT {K}, coalesce(CAST(best_tier AS VARCHAR), 'all') AS tier, count(*) AS providers, round(sum(w0), 6) AS natural_weight,
        round(sum(w), 6) AS weight, round(max(w) / 0.35e0, 6) AS binds_below
        FROM (SELECT *, CASE best_tier WHEN 1 THEN 1e0 WHEN 2 THEN 0.6e0 ELSE 0.25e0 END AS w0 FROM weights)
        GROUP BY GROUPING SETS ((d, code, ver, best_tier), (d, code, ver))""", "weights"),
)
def _(ws):
    live = ws.contributions().where("not screened_out")
    rows = live.groupingSets(
        [[*map(F.col, KEYS), F.col("best_tier")], [*map(F.col, KEYS)]], *KEYS, "best_tier"
    ).agg(
        F.count(F.lit(1)).alias("providers"), F.sum("natural_weight").alias("natural_weight"),
        F.sum("weight").alias("weight"), (F.max("weight") / 0.35).alias("binds_below"),
    )
    return rows.select(
        day(), "index_code", VER, F.coalesce(F.col("best_tier").cast("string"), F.lit("all")).alias("tier"), "providers",
        r6("natural_weight"), r6("weight"), r6("binds_below"),
    )


@register(
    "loss_of_top_venue",
    query(f"""SELECT {D}, a.code AS index_code, a.ver AS methodology_version, c.venue AS lost_venue, a.n - c.providers AS providers_left,
        CAST(a.q - c.quotes AS BIGINT) AS observations_left, a.n - c.providers >= 4 AND a.q - c.quotes >= 8 AS counts_still_pass
        FROM (SELECT d, code, ver, count(*) AS n, sum(quote_count) AS q FROM weights GROUP BY ALL) a
        JOIN (SELECT * FROM ({VENUES}) QUALIFY row_number() OVER (PARTITION BY d, code, ver ORDER BY providers DESC, venue) = 1) c USING (d, code, ver)""",
          "weights"),
)
def _(ws):
    by_venue = E.venues(ws.contributions(), KEYS)
    top = by_venue.groupBy(*KEYS).agg(
        F.min(F.struct((-F.col("providers")).alias("k"), F.col("venue"), F.col("quotes"))).alias("top"),
        F.max("all_providers").alias("n"), F.max("all_quotes").alias("q"),
    )
    left, obs = F.col("n") + F.col("top.k"), F.col("q") - F.col("top.quotes")
    m = rules.rules_of(rules.registry())
    return top.select(
        day(), "index_code", VER, F.col("top.venue").alias("lost_venue"), left.alias("providers_left"),
        obs.alias("observations_left"),
        ((left >= m["min_providers"]) & (obs >= m["min_observations"])).alias("counts_still_pass"),
    )


@register(
    "estimate_flags",
    query(f"""SELECT {K}, CASE WHEN pmad = 0 THEN 'warn' ELSE 'info' END AS severity,
        CASE WHEN pmad = 0 THEN 'outlier_screened_degenerate' ELSE 'outlier_screened' END AS flag, provider AS subject FROM scr WHERE screened_out
        UNION ALL SELECT {K}, 'warn', 'provider_weight_capped', provider FROM weights
          WHERE w < CASE best_tier WHEN 1 THEN 1e0 WHEN 2 THEN 0.6e0 ELSE 0.25e0 END - 1e-9
        UNION ALL SELECT {K}, 'warn', 'no_executable_input', NULL FROM fix WHERE provider_count > 0 AND NOT tier1_present
        UNION ALL SELECT {D}, c.code, c.ver, 'warn', 'venue_concentration', CASE WHEN w.weight_share > c.count_share THEN w.venue ELSE c.venue END
        FROM (SELECT * FROM ({SHARES}) QUALIFY row_number() OVER (PARTITION BY d, code, ver ORDER BY providers DESC, venue) = 1) c
        JOIN (SELECT * FROM ({SHARES}) QUALIFY row_number() OVER (PARTITION BY d, code, ver ORDER BY weight_share DESC, venue) = 1) w USING (d, code, ver)
        WHERE c.count_share > 0.5e0 OR w.weight_share > 0.5e0""", "fix"),
)
def _(ws):
    weighted = ws.contributions()
    conc = E.concentration(E.venues(weighted, KEYS), KEYS)
    rows = E.flags(weighted, ws.fixings(), conc, KEYS)
    return rows.select(day(), "index_code", VER, "severity", F.col("code").alias("flag"), "subject")


@register(
    "adjustment_load",
    query(f"""SELECT {K}, round(avg(CASE WHEN np / p >= 1.25e0 THEN 1e0 ELSE 0e0 END), 6) AS heavy_share, count(*) AS quotes,
        avg(CASE WHEN np / p >= 1.25e0 THEN 1e0 ELSE 0e0 END) >= 0.5e0 AS flagged FROM quotes GROUP BY d, code, ver""", "quotes"),
)
def _(ws):
    rows = Q.adjustment_load(ws.quotes(), ["index_date", "index_code", VER])
    return rows.select(day(), "index_code", VER, r6("heavy_share"), "quotes", "flagged")


@register(
    "distinct_sources",
    query("""SELECT coalesce(string_split(source, ':')[1], 'all') AS venue, count(DISTINCT source) AS sources, count(DISTINCT gpu_model) AS models
        FROM obs GROUP BY ROLLUP (string_split(source, ':')[1])""", "obs"),
)
def _(ws):
    rows = ws.scan().withColumn("venue", labels.venue("source"))
    return rows.rollup("venue").agg(
        F.countDistinct("source").alias("sources"), F.countDistinct("gpu_model").alias("models")
    ).withColumn("venue", F.coalesce("venue", F.lit("all")))
