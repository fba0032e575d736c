"""Queries over term structures and bracket ladders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves
from ..operators import ladder as L
from ..operators import term as T
from ..sources import terms
from ..sources.staging import new_path, written
from .registry import r6, register

# --- term points: parts as committed-use quotes ------------------------------
# vendor = brand, tenor = 1..5 years by size, ratio of the committed to the list price
POINTS = """SELECT p_partkey AS point_id, p_brand AS vendor, 1e0 + p_size % 5 AS tenor_years,
  0.15e0 + (p_retailprice - 900) / 100e0 * 0.9e0 AS price_ratio FROM part"""
FACTOR = "CASE WHEN abs({x}) < 1e-9 THEN 1 - ({x}) / 2 ELSE (1 - exp(-({x}))) / ({x}) END"
BISECT = """RECURSIVE p AS MATERIALIZED ({points}), grid AS MATERIALIZED (
  SELECT p.*, k.premium, price_ratio / (1 - k.premium) AS target FROM p CROSS JOIN (SELECT unnest([{premiums}]) AS premium) k),
steps(point_id, premium, tenor, target, lo, hi, i) AS (
  SELECT point_id, premium, tenor_years, target, 0e0, 5e0, 0 FROM grid WHERE target < 1 AND price_ratio <= 1
  UNION ALL
  SELECT point_id, premium, tenor, target,
    CASE WHEN (1 - exp(-((lo + hi) / 2 * tenor))) / ((lo + hi) / 2 * tenor) > target THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN (1 - exp(-((lo + hi) / 2 * tenor))) / ((lo + hi) / 2 * tenor) > target THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM steps WHERE i < 36),
rated AS MATERIALIZED (SELECT g.*, CASE WHEN price_ratio > 1 THEN NULL WHEN g.target >= 1 THEN 0e0
    WHEN (1 - exp(-(5e0 * tenor_years))) / (5e0 * tenor_years) > g.target THEN 'inf'::DOUBLE ELSE (s.lo + s.hi) / 2 END AS rate
  FROM grid g LEFT JOIN (SELECT * FROM steps WHERE i = 36) s ON s.point_id = g.point_id AND s.premium = g.premium)"""


def _bisect(premiums, final: str) -> str:
    return f"WITH {BISECT.format(points=POINTS, premiums=', '.join(f'{p}e0' for p in premiums))} {final}"


def _points(ws):
    return ws.table("part").select(
        F.col("p_partkey").alias("point_id"), F.col("p_brand").alias("vendor"),
        (F.col("p_size") % 5 + 1.0).alias("tenor_years"),
        (0.15 + (F.col("p_retailprice") - 900) / 100.0 * 0.9).alias("price_ratio"),
    )


# an infinite rate is written as -1 so that every engine hashes it alike
_RATE = "round(CASE WHEN isinf(rate) THEN -1e0 ELSE rate END, 6)"


def _rate(col="decline_rate"):
    return F.when(F.col(col) == float("inf"), F.lit(-1.0)).otherwise(F.col(col))


@register(
    "average_price_factor",
    f"""SELECT point_id, round({FACTOR.format(x='(p_size / 50e0 * tenor_years)')}, 6) AS factor
        FROM ({POINTS}) JOIN part ON p_partkey = point_id""",
)
def _(ws):
    rows = _points(ws).join(ws.table("part"), F.col("p_partkey") == F.col("point_id"))
    return rows.select("point_id", r6(curves.average_price_factor(F.col("p_size") / 50.0, F.col("tenor_years")), "factor"))


@register(
    "implied_decline",
    _bisect((0.0,), f"""SELECT point_id, vendor, {_RATE} AS decline_rate,
        round(CASE WHEN isinf(rate) THEN 1e0 ELSE 1 - exp(-rate) END, 6) AS annual_decline FROM rated"""),
)
def _(ws):
    return T.implied_declines(_points(ws)).select("point_id", "vendor", r6(_rate(), "decline_rate"), r6("annual_decline"))


@register(
    "premium_sensitivity",
    _bisect(T.PREMIUMS, f"""SELECT point_id, premium AS risk_premium, {_RATE} AS decline_rate,
        round(CASE WHEN isinf(rate) THEN 1e0 ELSE 1 - exp(-rate) END, 6) AS annual_decline FROM rated"""),
)
def _(ws):
    return T.premium_sensitivity(_points(ws)).select("point_id", "risk_premium", r6(_rate(), "decline_rate"), r6("annual_decline"))


@register(
    "forward_level",
    _bisect((0.0,), """SELECT point_id, round(2.5e0 * exp(-rate * tenor_years), 6) AS level FROM rated WHERE NOT isinf(rate)"""),
)
def _(ws):
    rows = T.implied_declines(_points(ws)).where(F.col("decline_rate") != float("inf"))
    return rows.select("point_id", r6(curves.forward_level(F.lit(2.5), F.col("decline_rate"), F.col("tenor_years")), "level"))


@register(
    "term_consistency",
    _bisect((0.1,), """SELECT vendor, count(*) AS tenors, count(*) FILTER (WHERE NOT isinf(rate)) AS finite_tenors,
        round(coalesce(max(rate) FILTER (WHERE NOT isinf(rate)) - min(rate) FILTER (WHERE NOT isinf(rate)), 0e0), 6) AS spread,
        coalesce(max(rate) FILTER (WHERE NOT isinf(rate)) - min(rate) FILTER (WHERE NOT isinf(rate)), 0e0) < 0.1e0 AS consistent
        FROM rated GROUP BY vendor HAVING count(*) >= 2"""),
)
def _(ws):
    return T.consistency(_points(ws)).select("vendor", "tenors", "finite_tenors", r6("spread"), "consistent")


# --- term curves: one per brand, a tenor per size; supplier balances add refusals ---
CURVES = """SELECT p_brand AS curve, CAST(p_size AS DOUBLE) AS tenor, 2.6e0 - 0.02e0 * p_size + avg(p_retailprice) / 10000e0 AS rate
  FROM part GROUP BY p_brand, p_size
  UNION ALL SELECT 'desk' || s_nationkey, CAST(1 + s_suppkey % 24 AS DOUBLE), 1e0 + s_acctbal / 5000e0 FROM supplier"""


def _curves(ws):
    brands = ws.table("part").groupBy(F.col("p_brand").alias("curve"), "p_size").agg(
        (2.6 - 0.02 * F.max("p_size") + F.avg("p_retailprice") / 10000.0).alias("rate")
    ).select("curve", F.col("p_size").cast("double").alias("tenor"), "rate")
    desks = ws.table("supplier").select(
        F.concat(F.lit("desk"), F.col("s_nationkey").cast("string")).alias("curve"),
        (1 + F.col("s_suppkey") % 24).cast("double").alias("tenor"), (1.0 + F.col("s_acctbal") / 5000.0).alias("rate"),
    )
    return brands.unionByName(desks)


@register(
    "strip_forwards",
    f"""WITH c AS ({CURVES}), sound AS (SELECT * FROM c WHERE curve NOT IN
        (SELECT curve FROM c GROUP BY curve, tenor HAVING count(*) > 1) AND curve NOT IN (SELECT curve FROM c WHERE tenor <= 0 OR rate <= 0))
        SELECT curve, row_number() OVER w AS period, tenor, tenor - coalesce(lag(tenor) OVER w, 0e0) AS months,
        round((tenor * rate - coalesce(lag(tenor * rate) OVER w, 0e0)) / (tenor - coalesce(lag(tenor) OVER w, 0e0)), 6) AS forward,
        round(rate, 6) AS term_quote FROM sound WINDOW w AS (PARTITION BY curve ORDER BY tenor)""",
)
def _(ws):
    rows = T.strip_forwards(_curves(ws))
    return rows.select("curve", F.col("period").cast("long").alias("period"), "tenor", "months", r6("forward"), r6("term_quote"))


@register(
    "refused_curves",
    f"""WITH c AS ({CURVES}) SELECT curve, CASE WHEN min(tenor) <= 0 THEN 'tenors must be positive'
        WHEN max(n) > 1 THEN 'duplicate tenor' ELSE 'rates must be positive' END AS refusal
        FROM (SELECT curve, tenor, count(*) AS n, min(rate) AS lowest FROM c GROUP BY ALL)
        GROUP BY curve HAVING min(tenor) <= 0 OR max(n) > 1 OR min(lowest) <= 0""",
)
def _(ws):
    return T.refused_curves(_curves(ws))


# --- ladders: events as bracket trades ---------------------------------------
BRACKETS = """SELECT ladder_id, label, 80e0 * n AS volume,
  v / sum(v) OVER (PARTITION BY ladder_id) * (0.845e0 + 0.05e0 * (ladder_id % 7)) AS quoted,
  CASE label WHEN '<$2.00' THEN NULL WHEN '$2.00-$2.50' THEN 2e0 WHEN '$2.50-$3.00' THEN 2.5e0 WHEN '$3.00-$3.50' THEN 3e0 ELSE 3.5e0 END AS low,
  CASE label WHEN '<$2.00' THEN 2e0 WHEN '$2.00-$2.50' THEN 2.5e0 WHEN '$2.50-$3.00' THEN 3e0 WHEN '$3.00-$3.50' THEN 3.5e0 END AS high
  FROM (SELECT user_id AS ladder_id, CASE event_type WHEN 'error' THEN '<$2.00' WHEN 'click' THEN '$2.00-$2.50' WHEN 'signup' THEN '$2.50-$3.00'
      WHEN 'purchase' THEN '$3.00-$3.50' ELSE '$3.50+' END AS label, count(*) AS n,
    sum(value) * CASE WHEN event_type IN ('error', 'view') THEN 0.125e0 + 0.0625e0 * (user_id % 8) ELSE 1e0 END AS v
    FROM events GROUP BY user_id, event_type)"""
MIDS = "CASE WHEN low IS NULL THEN high - {s} / 2 WHEN high IS NULL THEN low + {s} / 2 ELSE (low + high) / 2 END"


def _brackets(ws):
    """One ladder per user, one bracket per kind of event."""
    kind = F.col("event_type")
    label = (
        F.when(kind == "error", "<$2.00").when(kind == "click", "$2.00-$2.50").when(kind == "signup", "$2.50-$3.00")
        .when(kind == "purchase", "$3.00-$3.50").otherwise("$3.50+")
    )
    tails = F.when(kind.isin("error", "view"), 0.125 + 0.0625 * (F.col("user_id") % 8)).otherwise(1.0)
    sums = ws.table("events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")
    ).select(F.col("user_id").alias("ladder_id"), label.alias("label"), "n", (F.col("v") * tails).alias("v"))
    whole = sums.groupBy("ladder_id").agg(F.sum("v").alias("whole"))
    return sums.join(whole, "ladder_id").select(
        "ladder_id", "label", (F.col("n") * 80.0).alias("volume"),
        (F.col("v") / F.col("whole") * (0.845 + 0.05 * (F.col("ladder_id") % 7))).alias("quoted"),
    ).transform(L.with_bounds)


@register("bracket_bounds", f"SELECT ladder_id, label, low, high, round(quoted, 6) AS quoted, volume FROM ({BRACKETS})")
def _(ws):
    return _brackets(ws).select("ladder_id", "label", "low", "high", r6("quoted"), "volume")


@register(
    "bracket_probabilities",
    f"SELECT ladder_id, label, round(quoted / sum(quoted) OVER (PARTITION BY ladder_id), 6) AS probability FROM ({BRACKETS})",
)
def _(ws):
    return L.probabilities(_brackets(ws), ["ladder_id"]).select("ladder_id", "label", r6("probability"))


EXPECT = f"""SELECT ladder_id, open_span, sum(quoted * mid) / sum(quoted) AS expected,
  sqrt(greatest(sum(quoted * mid * mid) / sum(quoted) - (sum(quoted * mid) / sum(quoted)) * (sum(quoted * mid) / sum(quoted)), 0e0)) AS dispersion,
  sum(quoted) AS book_sum, sum(volume) AS volume, sum(CASE WHEN low IS NULL OR high IS NULL THEN quoted ELSE 0e0 END) / sum(quoted) AS tail_mass
  FROM (SELECT *, {MIDS.format(s='open_span')} AS mid FROM ({BRACKETS}) CROSS JOIN (SELECT unnest([0.25e0, 0.5e0, 1e0]) AS open_span))
  GROUP BY ladder_id, open_span"""


@register(
    "ladder_expectation",
    f"""SELECT ladder_id, round(expected, 6) AS expected, round(dispersion, 6) AS dispersion, round(book_sum, 6) AS book_sum,
        round(tail_mass, 6) AS tail_mass, volume FROM ({EXPECT}) WHERE open_span = 0.25e0""",
)
def _(ws):
    rows = L.assess(_brackets(ws), ["ladder_id"])
    return rows.select("ladder_id", r6("expected"), r6("dispersion"), r6("book_sum"), r6("tail_mass"), "volume")


@register(
    "ladder_span_sensitivity",
    f"SELECT ladder_id, open_span, round(expected, 6) AS expected, round(dispersion, 6) AS dispersion FROM ({EXPECT})",
)
def _(ws):
    return L.expectations(_brackets(ws), ["ladder_id"], L.SPANS).select("ladder_id", "open_span", r6("expected"), r6("dispersion"))


@register(
    "ladder_refusals",
    f"""SELECT ladder_id, abs(book_sum - 1) > 0.1e0 AS book_refused, tail_mass > 0.25e0 AS tails_refused, volume < 5000 AS volume_refused,
        abs(book_sum - 1) > 0.1e0 OR tail_mass > 0.25e0 OR volume < 5000 AS withheld FROM ({EXPECT}) WHERE open_span = 0.25e0""",
)
def _(ws):
    rows = L.assess(_brackets(ws), ["ladder_id"])
    said = lambda text: F.exists("refusals", lambda r: r.contains(text))
    return rows.select(
        "ladder_id", said("book sums to").alias("book_refused"), said("open-ended tails").alias("tails_refused"),
        said("of volume").alias("volume_refused"), "withheld",
    )


# Curves of ladders need books that are good enough, so events are pooled by day of month first.
POOLED = """SELECT 'curve' || d % 3 AS curve, d AS tenor, sum(q * mid) / sum(q) AS expected, sum(q) AS book, sum(n) * 20e0 AS volume,
  sum(CASE WHEN event_type IN ('error', 'view') THEN q ELSE 0e0 END) / sum(q) AS tails
  FROM (SELECT day(ts) AS d, event_type, count(*) AS n,
    sum(value) * CASE WHEN event_type IN ('error', 'view') THEN 0.25e0 ELSE 1e0 END AS v,
    sum(value) * CASE WHEN event_type IN ('error', 'view') THEN 0.25e0 ELSE 1e0 END
      / sum(sum(value) * CASE WHEN event_type IN ('error', 'view') THEN 0.25e0 ELSE 1e0 END) OVER (PARTITION BY day(ts)) AS q,
    CASE event_type WHEN 'error' THEN 1.875e0 WHEN 'click' THEN 2.25e0 WHEN 'signup' THEN 2.75e0 WHEN 'purchase' THEN 3.25e0 ELSE 3.625e0 END AS mid
    FROM events GROUP BY day(ts), event_type) GROUP BY d"""


@register(
    "ladder_curve",
    f"""SELECT curve, count(*) AS usable, round(arg_min(expected, tenor), 6) AS first_level, round(arg_max(expected, tenor), 6) AS last_level,
        round(CASE WHEN count(*) >= 2 THEN arg_max(expected, tenor) / arg_min(expected, tenor) - 1 END, 6) AS change
        FROM ({POOLED}) WHERE abs(book - 1) <= 0.1e0 AND tails <= 0.25e0 AND volume >= 5000 GROUP BY curve""",
)
def _(ws):
    kind = F.col("event_type")
    label = (
        F.when(kind == "error", "<$2.00").when(kind == "click", "$2.00-$2.50").when(kind == "signup", "$2.50-$3.00")
        .when(kind == "purchase", "$3.00-$3.50").otherwise("$3.50+")
    )
    sums = ws.table("events").groupBy(F.dayofmonth("ts").alias("tenor"), "event_type").agg(
        F.sum("value").alias("v"), (F.count(F.lit(1)) * 20.0).alias("volume")
    ).withColumn("v", F.col("v") * F.when(kind.isin("error", "view"), 0.25).otherwise(1.0))
    whole = sums.groupBy("tenor").agg(F.sum("v").alias("whole"))
    brackets = sums.join(whole, "tenor").select(
        "tenor", label.alias("label"), (F.col("v") / F.col("whole")).alias("quoted"), "volume"
    ).transform(L.with_bounds)
    verdicts = L.assess(brackets, ["tenor"]).withColumn(
        "curve", F.concat(F.lit("curve"), (F.col("tenor") % 3).cast("string"))
    )
    return L.curve_change(verdicts, ["curve"], "tenor").select(
        "curve", "usable", r6("first_level"), r6("last_level"), r6("change")
    )


# --- landed ladder events ------------------------------------------------------
@register(
    "ladder_events",
    """SELECT user_id, CAST(event_id AS VARCHAR) AS event, strftime(ts, '%Y-%m-%d') AS settles,
        CASE event_type WHEN 'click' THEN '$2.00-$2.50' WHEN 'error' THEN 'under $2' WHEN 'signup' THEN '$3.25+' ELSE '$2.75' END AS label,
        CASE event_type WHEN 'click' THEN 2e0 WHEN 'signup' THEN 3.25e0 END AS low,
        CASE event_type WHEN 'click' THEN 2.5e0 WHEN 'error' THEN 2e0 WHEN 'signup' THEN NULL ELSE 2.75e0 END AS high,
        round(value / 500e0, 6) AS quoted, value AS volume,
        CASE WHEN event_type = 'click' THEN 'Silicon Data H100 Index' WHEN event_type = 'signup' THEN 'Ornn Compute Index' END AS source_index
        FROM events WHERE event_type <> 'view'""",
)
def _(ws):
    """Each event becomes a landed market document; views are closed markets and are skipped."""
    kind = F.col("event_type")
    title = F.when(kind == "click", "$2.00-$2.50").when(kind == "error", "under $2").when(kind == "signup", "$3.25+").otherwise("$2.75")
    price = (F.col("value") / 500.0).cast("string")
    prices = F.concat(F.lit('["'), price, F.lit('","0"]'))
    # half of the venues send the price list as a JSON array, half as a string holding one
    field = F.when(F.col("event_id") % 2 == 0, prices).otherwise(
        F.concat(F.lit('"'), F.replace(prices, F.lit('"'), F.lit('\\"')), F.lit('"'))
    )
    question = F.when(kind == "click", "Where will the Silicon Data H100 Index settle?").when(
        kind == "signup", "Will Ornn Compute Index close above?"
    ).otherwise("no index")
    doc = F.concat(
        F.lit('{"endDate": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('", "markets": [{"groupItemTitle": " '),
        title, F.lit('", "outcomePrices": '), field, F.lit(', "question": "'), question, F.lit('", "volumeNum": '),
        F.col("value").cast("string"), F.lit(', "closed": '), (kind == "view").cast("string"),
        F.lit('}, {"groupItemTitle": "", "outcomePrices": ["0.5"]}, {"groupItemTitle": "no number", "outcomePrices": ["0.5"]}]}'),
    )
    docs = ws.table("events").select("user_id", F.col("event_id").cast("string").alias("event"), doc.alias("doc"))
    rows = L.from_events(docs, "doc", ["user_id", "event"])
    return rows.select(
        "user_id", "event", F.date_format("settles", "yyyy-MM-dd").alias("settles"), "label", "low", "high", r6("quoted"), "volume", "source_index"
    )


@register(
    "ladder_latest",
    """SELECT user_id AS ladder_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS read_at, round(arg_max(value, ts), 6) AS expected,
        arg_max(event_type, ts) = 'error' AS withheld FROM events GROUP BY user_id""",
)
def _(ws):
    """Every event is a dated reading of its user's ladder; errors are withheld ones."""
    readings = written(
        ws.table("events").select(
            F.col("user_id").alias("ladder_id"), F.col("ts").alias("read_at"), F.col("value").alias("expected"),
            (F.col("event_type") == "error").alias("withheld"), F.to_date("ts").alias("read_date"),
        ),
        "ladder-readings", ["read_date"],
    )
    rows = L.newest_reading(readings, ["ladder_id"])
    return rows.select("ladder_id", F.date_format("read_at", "yyyy-MM-dd HH:mm:ss").alias("read_at"), r6("expected"), "withheld")


@register(
    "ladder_dated",
    """SELECT day || 'T20:00:00' AS read_at, event_type AS tenor, round(avg(value), 6) AS expected, CAST(10 * count(*) AS DOUBLE) AS volume, event_type = 'error' AS withheld,
        CASE WHEN event_type = 'error' THEN 'not usable' END AS refusal, CAST(day AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) AS newest
        FROM (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) GROUP BY day, event_type""",
)
def _(ws):
    """Events as a ladder for each type, read every day: all days put on file at once and read back."""
    events = ws.table("events").withColumn("read_at", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T20:00:00")))
    bad = F.col("tenor") == "error"
    curves = events.groupBy("read_at", F.col("event_type").alias("tenor")).agg(F.avg("value").alias("expected"), (10.0 * F.count(F.lit(1))).alias("volume"))
    curves = curves.withColumns({
        "open_span": F.lit(0.25), "withheld": bad, "refusals": F.when(bad, F.array(F.lit("not usable"))).otherwise(F.array().cast("array<string>"))})
    root = new_path(ws.spark, "dated-readings")
    terms.write_readings(curves, root)
    readings = terms.read_readings(ws.spark, root)
    newest = written(terms.newest_ladders(readings).select("read_at", "tenor", F.lit(True).alias("newest")), "newest-ladders")
    rows = readings.select("read_at", F.explode("ladders").alias("l")).select("read_at", "l.*")
    return rows.join(newest, ["read_at", "tenor"], "left").select(
        "read_at", "tenor", r6("expected"), "volume", "withheld", F.get("refusals", F.lit(0)).alias("refusal"), F.coalesce("newest", F.lit(False)).alias("newest"))
