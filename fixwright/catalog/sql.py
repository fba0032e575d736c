"""Named pieces of the reference SQL, put together by need."""

from __future__ import annotations

from .. import rules
from ..functions import regions
from ..rules import sql_literal


def _text(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


ALIASES = ", ".join(
    f"('{code}', {i}, lower('{alias}'))" for i, (code, c) in enumerate(rules.CONTRACTS.items()) for alias in c["aliases"]
)

PIECES: dict[str, str] = {
    "obs": """
SELECT source, source_sku, gpu_model, gpu_count, price * gpu_count AS total, price * gpu_count / gpu_count AS p,
       currency, price_kind, commitment, form_factor, interconnect,
       CAST(CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 9 = 1 THEN 40
            WHEN p_size % 9 = 2 THEN card * gpu_count ELSE card END AS INTEGER) AS vram_gb,
       region, tier, machine_id, host_id, observed_at, d, 'run-' || CAST(d AS VARCHAR) AS snapshot, l_linenumber
FROM (
 SELECT *, CASE WHEN source = 'desk' THEN (0.0000693147180559945e0 + (4.0e0 + p_size % 8) / 3.0e0) * CASE WHEN commitment = 'spot' THEN 0.5e0 ELSE 1e0 END
        ELSE (1.2e0 + 0.0000693147180559945e0 + l_extendedprice / 35000.0e0) * CASE WHEN s_acctbal > 9000 THEN 5e0 ELSE 1e0 END END AS price
 FROM (
  SELECT CASE WHEN n.n_nationkey = 9 THEN 'vastai' WHEN n.n_regionkey = 3 THEN 'desk' WHEN n.n_regionkey = 0 THEN s.s_name
              ELSE 'feed' || n.n_regionkey || ':' || s.s_name END AS source,
   'L' || l.l_orderkey || '-' || l.l_linenumber || '-' || l.l_partkey AS source_sku,
   CASE WHEN p.p_size > 40 THEN 'NVIDIA ' ELSE '' END ||
   CASE p.p_type WHEN 'ECONOMY' THEN 'H100' WHEN 'STANDARD' THEN 'H200' WHEN 'MEDIUM' THEN 'A100' WHEN 'PROMO' THEN 'B200'
     WHEN 'LARGE' THEN 'MI300X' ELSE 'L40S' END ||
   CASE p.p_size % 8 WHEN 0 THEN '' WHEN 1 THEN ' SXM' WHEN 2 THEN ' PCIE' WHEN 3 THEN ' NVL' WHEN 4 THEN ' 40GB'
     WHEN 5 THEN '-SXM5_80GB' WHEN 6 THEN '0' ELSE '  80GB HBM3' END AS gpu_model,
   CASE WHEN l.l_linenumber <= 2 THEN l.l_linenumber WHEN l.l_linenumber = 3 THEN 4 ELSE 8 END AS gpu_count,
   CASE p.p_type WHEN 'STANDARD' THEN 141 WHEN 'PROMO' THEN 192 WHEN 'LARGE' THEN 192 ELSE 80 END AS card,
   CASE WHEN l.l_tax > 0.075 THEN 'EUR' WHEN l.l_tax > 0.065 THEN 'usd' ELSE 'USD' END AS currency,
   CASE WHEN l.l_discount > 0.095 THEN 'from_floor' ELSE 'quoted' END AS price_kind,
   CASE o.o_orderpriority WHEN '1-URGENT' THEN 'spot' WHEN '2-HIGH' THEN 'community' WHEN '3-MEDIUM' THEN 'reserved'
     ELSE 'on_demand' END AS commitment,
   CASE l.l_returnflag WHEN 'A' THEN 'sxm' WHEN 'N' THEN 'pcie' ELSE 'unknown' END AS form_factor,
   CASE l.l_partkey % 5 WHEN 0 THEN 'nvlink' WHEN 1 THEN 'infiniband' WHEN 2 THEN 'ethernet' WHEN 3 THEN 'none'
     ELSE 'unknown' END AS interconnect,
   CASE (l.l_suppkey + l.l_partkey) % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'us-east-1' WHEN 3 THEN 'Texas, US'
     WHEN 4 THEN 'Australia, AU' WHEN 5 THEN 'eastus2' WHEN 6 THEN 'Germany, DE' WHEN 7 THEN 'Georgia, US'
     WHEN 8 THEN 'Salt Lake City' ELSE 'Russia, RU' END AS region,
   CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS tier,
   CASE WHEN l.l_linenumber < 7 THEN l.l_partkey END AS machine_id, CASE WHEN l.l_linenumber < 7 THEN l.l_suppkey END AS host_id,
   l.l_shipdate AS observed_at, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS d,
   p.p_size, l.l_extendedprice, s.s_acctbal, l.l_linenumber
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN orders o ON o.o_orderkey = l.l_orderkey))""",
    "alias": f"""
SELECT code, place, trim(regexp_replace(name, '[\\s_-]+', ' ', 'g')) AS tok FROM (VALUES {ALIASES}) v(code, place, name)""",
    "models": """
SELECT gpu_model, norm, arg_max(code, len(tok) * 100 - place) AS code FROM (
  SELECT m.gpu_model, m.norm, a.code, a.tok, a.place
  FROM (SELECT DISTINCT gpu_model, trim(regexp_replace(lower(gpu_model), '[\\s_-]+', ' ', 'g')) AS norm FROM obs) m
  LEFT JOIN alias a ON m.norm = a.tok OR starts_with(m.norm, a.tok || ' ')) GROUP BY gpu_model, norm""",
    "regs": f"""
SELECT region,
  region IS NULL OR len(list_filter([{_text(regions.US_TOKENS)}],
     lambda t: contains(lower(replace(replace(replace(region, '_', ' '), '-', ' '), '/', ' ')), t))) > 0 AS loose,
  region IS NULL OR trim(region) = '' OR len(list_filter(string_split(lower(region), ','), lambda c:
     list_contains([{_text(regions.US_COUNTRY_NAMES)}], trim(c))
     OR regexp_matches(trim(regexp_replace(c, '[\\s_/.-]+', ' ', 'g')), '^(us|usa)( |$)')
     OR regexp_matches(trim(regexp_replace(c, '[\\s_/.-]+', ' ', 'g')), '(^| ){regions.US_CLOUD_REGION}( |$)')
     OR list_contains([{_text(regions.US_PLACES)}], trim(regexp_replace(c, '[\\s_/.-]+', ' ', 'g'))))) > 0 AS exact
FROM (SELECT DISTINCT region FROM obs)""",
    "idx": """
SELECT o.*, m.code, m.norm, r.loose, r.exact,
  coalesce((m.code = 'H100' AND list_contains(string_split(m.norm, ' '), 'nvl'))
    OR (m.code = 'A100' AND list_contains(string_split(m.norm, ' '), '40gb')), false) AS by_label,
  coalesce(o.vram_gb > 0 AND abs(o.vram_gb - c.card) > 0.1e0 * c.card
    AND (o.gpu_count = 1 OR abs(o.vram_gb / CAST(o.gpu_count AS DOUBLE) - c.card) > 0.1e0 * c.card), false) AS by_memory
FROM obs o JOIN models m ON m.gpu_model = o.gpu_model JOIN regs r ON r.region IS NOT DISTINCT FROM o.region
LEFT JOIN (VALUES ('H100', 80e0), ('H200', 141e0), ('A100', 80e0), ('B200', 180e0), ('MI300X', 192e0)) c(code, card)
  ON c.code = m.code""",
    "cheap": """
SELECT d, source, lower(trim(gpu_model)) AS model, gpu_count, commitment, min(p) AS p FROM obs GROUP BY ALL""",
    "pairs": """
SELECT o.d, o.source, o.commitment, b.p / o.p AS ratio FROM cheap b
JOIN cheap o ON o.d = b.d AND o.source = b.source AND o.model = b.model AND o.gpu_count = b.gpu_count
WHERE b.commitment = 'on_demand' AND o.commitment <> 'on_demand' AND b.p > 0 AND o.p > 0""",
    "evid": """
SELECT d, source, commitment, count(*) AS pairs, median(ratio) AS median_ratio,
  CASE WHEN count(*) > 1 THEN stddev_pop(ratio) / median(ratio) ELSE 0e0 END AS cv,
  count(*) >= 5 AND CASE WHEN count(*) > 1 THEN stddev_pop(ratio) / median(ratio) ELSE 0e0 END < 0.01e0 AS administered
FROM pairs GROUP BY d, source, commitment""",
    "vers": """
SELECT * FROM (VALUES ('1.0.0', false, false, 'book', 0, 0), ('1.1.0', true, false, 'book', 4, 3),
  ('1.2.0', true, true, 'priced', 4, 3)) v(ver, strict, exact_region, basis, machines_min, hosts_min)""",
    "fac": """
SELECT *, f1 * f2 * f3 * f4 AS total_x, CASE WHEN code IS NULL THEN 'unmatched_model'
  WHEN strict AND price_kind = 'from_floor' THEN 'from_floor'
  WHEN strict AND upper(currency) <> 'USD' THEN 'currency_unsupported'
  WHEN strict AND (by_label OR by_memory) THEN 'product_identity'
  WHEN NOT CASE WHEN exact_region THEN exact ELSE loose END THEN 'region_mismatch'
  WHEN p <= 0 THEN 'nonpositive_price' WHEN f1 * f2 * f3 * f4 > 1.75e0 THEN 'over_adjusted' END AS reject
FROM (SELECT i.*, v.*, coalesce(e.administered, false) AS administered,
  CASE form_factor WHEN 'sxm' THEN 1e0 WHEN 'pcie' THEN 1.18e0 ELSE 1.09e0 END AS f1,
  CASE interconnect WHEN 'ethernet' THEN 1.12e0 WHEN 'none' THEN 1.15e0 WHEN 'unknown' THEN 1.06e0 ELSE 1e0 END AS f2,
  CASE i.commitment WHEN 'spot' THEN 1.45e0 WHEN 'community' THEN 1.3e0 WHEN 'reserved' THEN 1.25e0 ELSE 1e0 END AS f3,
  CASE WHEN gpu_count >= 8 THEN 1e0 WHEN gpu_count >= 4 THEN 0.98e0 WHEN gpu_count >= 2 THEN 0.95e0 ELSE 0.92e0 END AS f4
  FROM idx i CROSS JOIN vers v
  LEFT JOIN evid e ON e.d = i.d AND e.source = i.source AND e.commitment = i.commitment AND e.administered)""",
    "books": """
SELECT d, snapshot, ver, source, code, basis, count(*) AS book_rows, count(DISTINCT machine_id) AS machines,
  count(DISTINCT host_id) AS hosts,
  CASE WHEN machines_min = 0 AND hosts_min = 0 THEN NULL
    WHEN count(DISTINCT machine_id) = 0 AND count(DISTINCT host_id) = 0 THEN 'none of its ' || count(*) ||
      CASE basis WHEN 'priced' THEN ' priced rows' ELSE ' rows' END || ' identify a machine or host, so the population is unproven'
    WHEN count(DISTINCT machine_id) < machines_min THEN count(DISTINCT machine_id) || ' distinct machines of ' || machines_min ||
      ' required across ' || count(*) || CASE basis WHEN 'priced' THEN ' priced rows' ELSE ' rows' END
    WHEN count(DISTINCT host_id) < hosts_min THEN count(DISTINCT host_id) || ' distinct hosts of ' || hosts_min ||
      ' required across ' || count(*) || CASE basis WHEN 'priced' THEN ' priced rows' ELSE ' rows' END END AS held_reason
FROM fac WHERE source = 'vastai' AND NOT administered
  AND CASE basis WHEN 'priced' THEN reject IS NULL ELSE code IS NOT NULL END
GROUP BY d, snapshot, ver, source, code, basis, machines_min, hosts_min""",
    "prep": """
SELECT f.*, CASE WHEN f.administered THEN 'administered' WHEN b.held_reason IS NOT NULL AND f.basis = 'book' THEN 'book_population_floor'
  WHEN f.reject IS NOT NULL THEN f.reject WHEN b.held_reason IS NOT NULL THEN 'book_population_floor' ELSE 'kept' END AS outcome,
  f.p * f.total_x AS np
FROM fac f LEFT JOIN books b ON b.d = f.d AND b.ver = f.ver AND b.source = f.source AND b.code = f.code""",
    "quotes": "SELECT * FROM prep WHERE outcome = 'kept'",
    "votes": """
SELECT d, code, ver, source AS provider, median(np) AS price, count(*) AS quote_count, min(tier) AS best_tier,
  CASE WHEN median(np) > 0 THEN mad(np) * 1.4826e0 / median(np) ELSE 0e0 END AS spread
FROM quotes GROUP BY d, code, ver, source""",
    "panel": """
SELECT d, code, ver, median(price) AS pm, mad(price) AS pmad, count(*) AS pn FROM votes GROUP BY d, code, ver""",
    "scr": """
SELECT v.*, pm, pmad, pn, CASE WHEN pmad > 0 THEN abs(price - pm) / (pmad * 1.4826e0) END AS sigmas,
  CASE WHEN pmad = 0 AND pm > 0 AND price > 0 THEN greatest(price / pm, pm / price) END AS ratio,
  pn >= 4 AND CASE WHEN pmad > 0 THEN abs(price - pm) / (pmad * 1.4826e0) > 3
    WHEN pm > 0 AND price > 0 THEN greatest(price / pm, pm / price) > 3e0 * (1 + 1e-9) ELSE false END AS screened_out
FROM votes v JOIN panel USING (d, code, ver)""",
    "caploop": """
SELECT d, code, ver, provider, price, quote_count, best_tier, spread,
  CASE best_tier WHEN 1 THEN 1e0 WHEN 2 THEN 0.6e0 ELSE 0.25e0 END AS w, 0 AS rnd, count(*) OVER (PARTITION BY d, code, ver) AS n
FROM scr WHERE NOT screened_out
UNION ALL
SELECT d, code, ver, provider, price, quote_count, best_tier, spread,
  CASE WHEN w / tot > 0.35e0 AND 0.35e0 * (tot - w) / (1 - 0.35e0) < w THEN 0.35e0 * (tot - w) / (1 - 0.35e0) ELSE w END,
  rnd + 1, n
FROM (SELECT *, max(w / tot) OVER (PARTITION BY d, code, ver) AS top FROM
  (SELECT *, sum(w) OVER (PARTITION BY d, code, ver) AS tot FROM caploop))
WHERE rnd < n AND n * 0.35e0 >= 1 AND top > 0.35e0""",
    "weights": """
SELECT * FROM caploop QUALIFY rnd = max(rnd) OVER (PARTITION BY d, code, ver)""",
    "disp": """
SELECT d, code, ver, median(price) AS lm, mad(price) AS lmad,
  CASE WHEN count(*) >= 3 AND median(price) > 0 THEN mad(price) * 1.4826e0 / median(price) END AS dispersion
FROM scr WHERE NOT screened_out GROUP BY d, code, ver""",
    "fixraw": """
SELECT s.d, s.code, s.ver, w.value, dispersion, coalesce(w.n, 0) AS provider_count, coalesce(w.q, 0) AS observation_count,
  coalesce(w.t1, 0) > 0 AS tier1_present
FROM (SELECT DISTINCT d, code, ver FROM votes) s
LEFT JOIN (SELECT d, code, ver, sum(price * w) / sum(w) AS value, count(*) AS n, sum(quote_count) AS q,
  count(*) FILTER (WHERE best_tier = 1) AS t1 FROM weights GROUP BY d, code, ver) w USING (d, code, ver)
LEFT JOIN disp USING (d, code, ver)""",
    "fix": """
SELECT *, provider_count >= 4 AS g1, observation_count >= 8 AS g2, coalesce(dispersion <= 0.45e0, false) AS g3,
  provider_count >= 4 AND observation_count >= 8 AND coalesce(dispersion <= 0.45e0, false) AND value IS NOT NULL AS passed,
  CASE WHEN provider_count >= 4 AND observation_count >= 8 AND coalesce(dispersion <= 0.45e0, false) THEN value END AS published_value,
  'run-' || CAST(d AS VARCHAR) AS snapshot
FROM fixraw""",
    "holds": """
SELECT d, snapshot, ver, code, string_agg(source || ' held out of ' || code || ': ' || held_reason ||
  CASE basis WHEN 'priced' THEN ' after the region screen and restatement; a median over that few sellers is one seller''s rate card wearing a marketplace''s name'
  ELSE '; a median over that few sellers is one seller''s rate card wearing a marketplace''s name' END, ' | ' ORDER BY source) AS venue_holdouts
FROM books WHERE held_reason IS NOT NULL GROUP BY d, snapshot, ver, code""",
    "tape0": """
SELECT f.code AS index_code, f.d AS index_date, CASE WHEN month(f.d) = 2 THEN 1 ELSE 0 END AS revision,
  CASE WHEN month(f.d) = 3 THEN f.published_value * 1.01e0 WHEN month(f.d) = 4 THEN NULL
    WHEN month(f.d) = 5 AND f.published_value IS NULL THEN 9.99e0 ELSE f.published_value END AS value,
  f.tver AS ver, CAST(f.d AS TIMESTAMP) + INTERVAL 20 HOUR AS published_at, f.dispersion, f.provider_count,
  CASE WHEN month(f.d) = 6 THEN NULL WHEN month(f.d) = 7 THEN 'gone-' || f.snapshot ELSE f.snapshot END AS snapshot,
  CASE WHEN month(f.d) = 8 THEN 'another reason' ELSE h.venue_holdouts END AS venue_holdouts
FROM (SELECT *, CASE WHEN year(d) < 1997 THEN '1.0.0' WHEN year(d) < 1999 THEN '1.1.0' WHEN year(d) < 2001 THEN '1.2.0'
  ELSE '0.9.0' END AS tver FROM fix) f
LEFT JOIN holds h ON h.d = f.d AND h.ver = f.ver AND h.code = f.code
WHERE f.ver = CASE WHEN f.tver = '0.9.0' THEN '1.2.0' ELSE f.tver END""",
    "tape": """
SELECT *, CASE WHEN value IS NULL THEN 'withheld' ELSE 'published' END AS status FROM tape0
UNION ALL BY NAME
SELECT * REPLACE (0 AS revision, 1.11e0 AS value, published_at - INTERVAL 1 DAY AS published_at, 'gone-first' AS snapshot),
  'published' AS status FROM tape0 WHERE revision = 1""",
    "live": "SELECT * FROM tape QUALIFY revision = max(revision) OVER (PARTITION BY index_code, index_date)",
    "otape": """
SELECT index_code, index_date, revision, status, value,
  CAST(index_date AS TIMESTAMP) + INTERVAL 20 HOUR + to_days(CAST(revision AS INTEGER)) AS published_at
FROM (SELECT o_orderpriority AS index_code, CAST(date_trunc('week', o_orderdate) AS DATE) AS index_date,
  row_number() OVER (PARTITION BY o_orderpriority, date_trunc('week', o_orderdate) ORDER BY o_orderkey) - 1 AS revision,
  CASE WHEN o_orderstatus = 'P' THEN 'withheld' ELSE 'published' END AS status,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000.0e0 END AS value FROM orders)""",
    "olive": "SELECT * FROM otape QUALIFY revision = max(revision) OVER (PARTITION BY index_code, index_date)",
}

NEEDS: dict[str, list[str]] = {
    "models": ["obs", "alias"], "regs": ["obs"], "idx": ["models", "regs"], "cheap": ["obs"], "pairs": ["cheap"],
    "evid": ["pairs"], "fac": ["idx", "vers", "evid"], "books": ["fac"], "prep": ["books"], "quotes": ["prep"],
    "votes": ["quotes"], "panel": ["votes"], "scr": ["panel"], "caploop": ["scr"], "weights": ["caploop"], "disp": ["scr"],
    "fixraw": ["weights", "disp"], "fix": ["fixraw"], "holds": ["books"], "tape0": ["fix", "holds"], "tape": ["tape0"],
    "live": ["tape"], "olive": ["otape"],
}


def piece(name: str, sql: str, needs: list[str] = ()) -> None:
    PIECES[name], NEEDS[name] = sql, list(needs)


def query(final: str, *needs: str, only: str | None = None) -> str:
    """A statement over the named pieces. ``only`` limits the versions computed."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS.get(name, []):
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    parts = []
    for n in order:
        text = PIECES[n]
        if n == "vers" and only:
            text = f"{text} WHERE ver = {sql_literal(only)}"
        head = "caploop(d, code, ver, provider, price, quote_count, best_tier, spread, w, rnd, n)" if n == "caploop" else n
        parts.append(f"{head} AS {'' if n == 'caploop' else 'MATERIALIZED '}({text})")
    return f"WITH RECURSIVE {', '.join(parts)}\n{final}"
