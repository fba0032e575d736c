"""Queries over the tape, run history and recomputed history."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.fingerprint import fingerprint
from ..operators import estimate as E
from ..operators import prepare as P
from ..operators import quality as Q
from ..operators import reproduce as R
from ..operators import tape as T
from ..plans import verification
from ..schemas import TAPE_COLUMNS
from ..sources import snapshots
from ..sources.staging import new_path
from ..sources.tape_io import write_bucketed
from .registry import day, r6, register
from .sql import piece, query
from .workspace import KEYS

ID = "index_code, CAST(index_date AS VARCHAR) AS index_date"
VER = "methodology_version"


def stamp(col: str, name: str | None = None):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(name or col)


# --- the tape ---------------------------------------------------------------
@register("tape_next_revision", query(f"SELECT {ID}, max(revision) + 1 AS next_revision FROM otape GROUP BY ALL", "otape"))
def _(ws):
    return T.next_revision(ws.order_tape()).select("index_code", day(), F.col("next_revision").cast("long").alias("next_revision"))


@register("tape_live", query(f"SELECT {ID}, CAST(revision AS BIGINT) AS revision, status, round(value, 6) AS value FROM olive", "olive"))
def _(ws):
    return T.live(ws.order_tape()).select("index_code", day(), F.col("revision").cast("long").alias("revision"), "status", r6("value"))


@register(
    "tape_revisions",
    query(f"""SELECT {ID}, CAST(revision AS BIGINT) AS revision, status, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM otape
        WHERE index_code = '1-URGENT' AND index_date = (SELECT max(index_date) FROM otape WHERE index_code = '1-URGENT')""", "otape"),
)
def _(ws):
    tape = ws.order_tape()
    newest = tape.where("index_code = '1-URGENT'").groupBy("index_code").agg(F.max("index_date").alias("index_date"))
    rows = tape.join(newest, T.KEY, "left_semi").orderBy("revision")
    return rows.select("index_code", day(), F.col("revision").cast("long").alias("revision"), "status", stamp("published_at"))


@register(
    "tape_asof",
    query(f"""SELECT {ID}, CAST(revision AS BIGINT) AS revision, status, round(value, 6) AS value FROM otape
        WHERE published_at <= TIMESTAMP '1998-06-15 12:00:00'
        QUALIFY revision = max(revision) OVER (PARTITION BY index_code, index_date)""", "otape"),
)
def _(ws):
    rows = T.as_of(ws.order_tape(), "1998-06-15 12:00:00")
    return rows.select("index_code", day(), F.col("revision").cast("long").alias("revision"), "status", r6("value"))


@register(
    "tape_asof_each",
    query("""SELECT CAST(o.o_orderkey AS VARCHAR) AS question_id, q.index_code, CAST(t.revision AS VARCHAR) AS revision, t.status, round(t.value, 6) AS value
        FROM orders o JOIN (SELECT o_orderkey, o_orderpriority AS index_code, CAST(date_trunc('week', o_orderdate) AS DATE) AS index_date,
           o_orderdate + to_days(CAST(o_custkey % 9 AS INTEGER)) AS kt FROM orders) q USING (o_orderkey)
        LEFT JOIN LATERAL (SELECT * FROM otape t WHERE t.index_code = q.index_code AND t.index_date = q.index_date AND t.published_at <= q.kt
           ORDER BY revision DESC LIMIT 1) t ON true""", "otape"),
)
def _(ws):
    """One question per order: what did its week's tape say a few days after the order?"""
    asked = ws.table("orders").select(
        F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("index_code"),
        F.date_trunc("week", "o_orderdate").cast("date").alias("index_date"),
        F.timestamp_add("DAY", (F.col("o_custkey") % 9).cast("int"), F.col("o_orderdate")).alias("knowledge_time"),
    )
    rows = T.as_of_each(ws.order_tape(), asked)
    return rows.select("question_id", "index_code", F.col("revision").cast("string").alias("revision"), "status", r6("value"))


@register(
    "tape_superseded",
    query(f"""SELECT {ID}, CAST(revision AS BIGINT) AS revision, strftime(lead(published_at) OVER (PARTITION BY index_code, index_date ORDER BY revision),
        '%Y-%m-%d %H:%M:%S') AS superseded_at FROM otape""", "otape"),
)
def _(ws):
    rows = T.superseded(ws.order_tape())
    return rows.select("index_code", day(), F.col("revision").cast("long").alias("revision"), stamp("superseded_at"))


@register(
    "tape_newest",
    query(f"""SELECT {ID}, status, round(value, 6) AS value, age FROM
        (SELECT *, row_number() OVER (PARTITION BY index_code ORDER BY index_date DESC) AS age FROM olive) WHERE age <= 30""", "olive"),
)
def _(ws):
    rows = T.newest(ws.order_tape(), 30)
    return rows.select("index_code", day(), "status", r6("value"), F.col("age").cast("long").alias("age"))


PREV = """SELECT *, last_value(CASE WHEN status = 'published' THEN {'d': index_date, 'v': value} END IGNORE NULLS)
  OVER (PARTITION BY index_code ORDER BY index_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM olive"""


@register(
    "prev_published",
    query(f"SELECT {ID}, CAST(prev.d AS VARCHAR) AS previous_date, round(prev.v, 6) AS previous_value FROM ({PREV})", "olive"),
)
def _(ws):
    rows = T.previous_published(ws.order_tape())
    return rows.select("index_code", day(), day("previous.index_date", "previous_date"), r6("previous.value", "previous_value"))


@register(
    "level_shift",
    query(f"""SELECT {ID}, round(value, 6) AS value, round(prev.v, 6) AS previous_value, round(value / prev.v - 1, 6) AS move FROM ({PREV})
        WHERE value IS NOT NULL AND prev.v <> 0 AND abs((value - prev.v) / prev.v) > 0.15e0""", "olive"),
)
def _(ws):
    rows = Q.level_shift(T.previous_published(ws.order_tape()), F.lit(rules.METHODOLOGIES["1.2.0"].review_move))
    return rows.select("index_code", day(), r6("value"), r6("previous.value", "previous_value"), r6("move"))


@register(
    "tape_bucketed",
    query(f"""SELECT o.index_code, CAST(o.index_date AS VARCHAR) AS index_date, CAST(o.revision AS BIGINT) AS revision, o.status, round(o.value, 6) AS value,
        strftime(s.published_at, '%Y-%m-%d %H:%M:%S') AS superseded_at, o.revision = p.revision AS live, round(CASE WHEN o.revision = p.revision THEN p.prev.v END, 6) AS previous_value
        FROM otape o LEFT JOIN otape s ON s.index_code = o.index_code AND s.index_date = o.index_date AND s.revision = o.revision + 1
        JOIN ({PREV}) p ON p.index_code = o.index_code AND p.index_date = o.index_date""", "otape", "olive"),
)
def _(ws):
    """Superseded, live and previous values of a tape that is kept by index: after it is written nothing is shuffled."""
    name = f"tape_{uuid.uuid4().hex}"
    tape = write_bucketed(ws.order_tape(), name, new_path(ws.spark, "tape-buckets"))
    now = T.previous_published(tape).select(*T.KEY, F.col("revision").alias("live_revision"), "previous")
    last = Window.partitionBy(*T.KEY)
    rows = T.superseded_in_order(tape).withColumn("live", F.col("revision") == F.max("revision").over(last))
    rows = rows.join(now.hint("merge"), T.KEY)
    return rows.select(
        "index_code", day(), F.col("revision").cast("long").alias("revision"), "status", r6("value"), stamp("superseded_at"), "live",
        F.round(F.when(F.col("live"), F.col("previous.value")), 6).alias("previous_value"))


@register(
    "tape_summary",
    query("""SELECT index_code, count(*) FILTER (WHERE status = 'published') AS published_count, count(*) FILTER (WHERE status <> 'published') AS withheld_count,
        round(arg_max(value, index_date) FILTER (WHERE status = 'published'), 6) AS latest_value, CAST(max(index_date) AS VARCHAR) AS latest_date
        FROM olive GROUP BY 1""", "olive"),
)
def _(ws):
    return T.series_summary(ws.order_tape()).select(
        "index_code", "published_count", "withheld_count", r6("latest_value"), day("latest_date")
    )


@register(
    "tape_widened",
    query("""SELECT index_code, count(*) AS "rows", count(*) FILTER (WHERE value IS NOT NULL) AS valued, CAST(0 AS BIGINT) AS with_holdouts,
        15 AS columns FROM otape GROUP BY 1""", "otape"),
)
def _(ws):
    """A tape written before the hold-out column existed, read with today's columns."""
    old = [c for c in TAPE_COLUMNS if c != "venue_holdouts"]
    tape = ws.order_tape()
    have = set(tape.columns)
    narrow = tape.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in old])
    wide = T.widened(narrow, TAPE_COLUMNS)
    return wide.groupBy("index_code").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("valued"), F.count("venue_holdouts").alias("with_holdouts"),
    ).withColumn("columns", F.lit(len(wide.columns)))


@register(
    "archive_coverage",
    query("""SELECT (SELECT count(DISTINCT snapshot) FROM obs) AS snapshots, (SELECT count(*) FROM obs) AS observations, count(*) AS tape_rows,
        count(DISTINCT index_date) AS index_dates, count(DISTINCT index_code) AS indices FROM otape""", "obs", "otape"),
)
def _(ws):
    return snapshots.coverage(ws.scan(), ws.order_tape())


# --- run history ------------------------------------------------------------
@register(
    "recent_runs",
    query("""SELECT snapshot, source, count(*) AS "rows" FROM obs WHERE d IN (SELECT DISTINCT d FROM obs ORDER BY d DESC LIMIT 4) GROUP BY ALL""", "obs"),
)
def _(ws):
    return Q.recent_runs(ws.observations(), "index_date", 4).groupBy("snapshot", "source").agg(F.count(F.lit(1)).alias("rows"))


piece("runs", "SELECT d, dense_rank() OVER (ORDER BY d) AS no FROM (SELECT DISTINCT d FROM obs)", ["obs"])


DESKS = """SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, 'desk' || c_nationkey AS source, o_orderpriority AS sku
  FROM orders JOIN customer ON c_custkey = o_custkey"""


@register(
    "feed_stall",
    f"""WITH q AS MATERIALIZED ({DESKS}), runs AS (SELECT d, dense_rank() OVER (ORDER BY d) AS no FROM (SELECT DISTINCT d FROM q)),
    sigs AS MATERIALIZED (SELECT q.d, r.no, source, string_agg(sku, ';' ORDER BY sku) AS sig FROM q JOIN runs r ON r.d = q.d GROUP BY ALL)
    SELECT CAST(c.d AS VARCHAR) AS run, c.source, 'feed_possibly_stalled' AS code FROM sigs c
    WHERE c.no >= 4 AND (SELECT count(DISTINCT p.sig) FROM sigs p WHERE p.source = c.source AND p.no BETWEEN c.no - 3 AND c.no) = 1""",
)
def _(ws):
    """Each nation's order desk as a feed: the priorities it quoted in a month are its rate card."""
    desk = ws.table("orders").join(ws.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
    feed = desk.select(
        F.date_trunc("month", "o_orderdate").cast("date").alias("run"),
        F.concat(F.lit("desk"), F.col("c_nationkey").cast("string")).alias("source"),
        F.col("o_orderpriority").alias("source_sku"), F.lit(1).alias("gpu_count"),
        (F.col("c_nationkey") + 1.5).alias("usd_per_hour_total"), F.lit("on_demand").alias("commitment"),
        F.lit(None).cast("string").alias("region"),
    ).withColumn("fingerprint", fingerprint())
    return Q.feed_stall(feed, "run").select(day("run"), "source", "code")


@register(
    "feed_dropout",
    query("""SELECT CAST(c.d AS VARCHAR) AS index_date, b.source, coalesce(n.n, 0) AS "rows", round(b.avg_rows, 6) AS recent_rows,
        CASE WHEN coalesce(n.n, 0) = 0 THEN 'error' ELSE 'warn' END AS severity
        FROM runs c JOIN (SELECT cur.no, x.source, avg(x.n) AS avg_rows FROM runs cur
            JOIN (SELECT r.no, o.source, count(*) AS n FROM obs o JOIN runs r ON r.d = o.d GROUP BY ALL) x ON x.no BETWEEN cur.no - 5 AND cur.no - 1
            GROUP BY cur.no, x.source) b ON b.no = c.no
        LEFT JOIN (SELECT d, source, count(*) AS n FROM obs GROUP BY ALL) n ON n.d = c.d AND n.source = b.source
        WHERE c.no >= 3 AND b.avg_rows >= 4 AND coalesce(n.n, 0) < b.avg_rows * 0.5e0""", "runs"),
)
def _(ws):
    rows = Q.feed_dropout(ws.observations(), "index_date")
    return rows.select(day(), "source", "rows", r6("recent_rows"), "severity")


@register(
    "stale_capture",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, event_type AS source, count(*) AS stale_rows FROM events
       WHERE ts < date_trunc('day', ts) + INTERVAL 24 HOUR - INTERVAL 6 HOUR GROUP BY ALL""",
)
def _(ws):
    """Events as a daily feed, read at the end of each day."""
    feed = ws.table("events").select(
        F.col("event_type").alias("source"), F.col("ts").alias("observed_at"), F.to_date("ts").alias("day")
    ).withColumn("closes", F.timestamp_add("DAY", F.lit(1), F.col("day").cast("timestamp")))
    rows = Q.stale_capture(feed, ["day"], F.col("closes"))
    return rows.select(day("day", "run"), "source", "stale_rows")


@register(
    "flag_log",
    query("""SELECT row_number() OVER (ORDER BY code) AS flag_id, code, "rows" FROM (SELECT 'rejected_' || outcome AS code, count(*) AS "rows" FROM prep
        WHERE snapshot = 'run-1998-03-01' AND ver = '1.2.0' AND outcome NOT IN ('administered', 'book_population_floor', 'kept') GROUP BY 1)""", "prep"),
)
def _(ws):
    """Flags of one run, numbered within the run (a run raises a few dozen at most)."""
    flags = P.rejection_flags(ws.prepared(), ["snapshot"]).where(f"{VER} = '1.2.0'").select(
        F.col("snapshot").alias("run_id"), "code", "rows",
        F.row_number().over(Window.partitionBy("snapshot").orderBy("code")).alias("flag_id"),
    )
    return Q.flag_log(flags, "run-1998-03-01").select(F.col("flag_id").cast("long").alias("flag_id"), "code", "rows")


# --- recomputed history -----------------------------------------------------
MOVES = """SELECT n.d, n.code, n.ver, n.provider, b.price AS before, n.price, p.prev.d AS pd, (n.price - b.price) / b.price AS move
  FROM (SELECT *, last_value(CASE WHEN status = 'published' THEN {'d': index_date} END IGNORE NULLS)
    OVER (PARTITION BY index_code ORDER BY index_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM live) p
  JOIN scr n ON n.d = p.index_date AND n.code = p.index_code AND n.ver = p.ver AND NOT n.screened_out
  JOIN live q ON q.index_code = p.index_code AND q.index_date = p.prev.d
  JOIN scr b ON b.d = q.index_date AND b.code = q.index_code AND b.ver = q.ver AND b.provider = n.provider AND NOT b.screened_out
  WHERE b.price > 0"""

piece("moves", MOVES, ["live", "scr"])


@register(
    "provider_level_shift",
    query(f"""SELECT m.code AS index_code, CAST(m.d AS VARCHAR) AS index_date, m.ver AS methodology_version, m.provider, CAST(m.pd AS VARCHAR) AS previous_date,
        round(m.before, 6) AS before, round(m.price, 6) AS price, round(m.move, 6) AS move, count(o.provider) AS peers,
        count(o.provider) FILTER (WHERE abs(o.move) >= 0.1e0 AND (o.move > 0) = (m.move > 0)) AS same_way,
        CASE WHEN m.ver = '1.0.0' OR count(o.provider) < 3 THEN 'provider_level_shift'
          WHEN count(o.provider) FILTER (WHERE abs(o.move) >= 0.1e0 AND (o.move > 0) = (m.move > 0)) >= 2 THEN 'provider_level_shift_corroborated'
          ELSE 'provider_level_shift_uncorroborated' END AS code
        FROM moves m LEFT JOIN moves o ON o.d = m.d AND o.code = m.code AND o.provider <> m.provider
        WHERE abs(m.move) > 0.25e0 GROUP BY m.code, m.d, m.ver, m.provider, m.pd, m.before, m.price, m.move""", "moves"),
)
def _(ws):
    rows = Q.provider_level_shift(ws.screened(), ws.tape(), rules.registry())
    return rows.select(
        "index_code", day(), VER, "provider", day("previous_date"), r6("before"), r6("price"), r6("move"), "peers", "same_way", "code"
    )


VERDICT = """SELECT l.*, f.published_value AS recomputed, CASE WHEN l.ver = '0.9.0' THEN 'methodology_drift'
  WHEN l.snapshot IS NULL THEN 'unverifiable: no snapshot named'
  WHEN l.snapshot NOT IN (SELECT snapshot FROM obs) THEN 'unverifiable: snapshot missing'
  WHEN l.ver = '1.2.0' AND coalesce(l.venue_holdouts, '') <> coalesce(h.venue_holdouts, '') THEN 'mismatch: venue hold-outs differ'
  WHEN l.value IS NULL AND f.published_value IS NULL THEN 'matched'
  WHEN l.value IS NULL OR f.published_value IS NULL THEN 'mismatch: publishes on one side only'
  WHEN abs(l.value - f.published_value) <= 0.005e0 THEN 'matched' ELSE 'mismatch: value differs' END AS verdict
  FROM live l LEFT JOIN fix f ON f.snapshot = l.snapshot AND f.code = l.index_code AND f.ver = l.ver
  LEFT JOIN holds h ON h.snapshot = l.snapshot AND h.code = l.index_code AND h.ver = l.ver"""


@register(
    "verify",
    query(f"""SELECT {ID}, CAST(revision AS BIGINT) AS revision, ver AS methodology_version, round(value, 6) AS value, round(recomputed, 6) AS recomputed, verdict
        FROM ({VERDICT})""", "live", "obs"),
)
def _(ws):
    """The whole archive is prepared and estimated again from its snapshots."""
    rows = R.verify(ws.tape(), ws.observations(), rules.registry())
    return rows.select("index_code", day(), F.col("revision").cast("long").alias("revision"), VER, r6("value"), r6("recomputed"), "verdict")


@register(
    "verify_again",
    query(f"""SELECT {ID}, CAST(revision AS BIGINT) AS revision, ver AS methodology_version, round(recomputed, 6) AS recomputed, verdict, CAST(0 AS BIGINT) AS computed_again
        FROM ({VERDICT})""", "live", "obs"),
)
def _(ws):
    """The same verdicts from what the verification before has recorded: no run is computed a second time."""
    store = new_path(ws.spark, "verified")
    verification.verify(ws.tape(), ws.observations(), store)
    found = verification.verify(ws.tape(), ws.observations(), store)
    again = F.lit(found.computed.count()).cast("long").alias("computed_again")
    return found.verdicts.select("index_code", day(), F.col("revision").cast("long").alias("revision"), VER, r6("recomputed"), "verdict", again)


@register("verify_summary", query(f"SELECT verdict, count(*) AS \"rows\" FROM ({VERDICT}) GROUP BY 1", "live", "obs"))
def _(ws):
    values, holdouts = ws.fixings(), ws.holdouts()  # before the tape, which then takes its values from them
    rows = T.live(ws.tape())
    return R.verify_summary(R.judge(rows, R.on_file(rows, ws.rows()), values, holdouts, rules.registry()))


@register(
    "dangling_snapshots",
    query(f"SELECT {ID}, CAST(revision AS BIGINT) AS revision, snapshot FROM tape WHERE snapshot IS NOT NULL AND snapshot NOT IN (SELECT snapshot FROM obs)",
          "tape", "obs"),
)
def _(ws):
    rows = R.dangling(ws.tape(), R.on_file(ws.tape(), ws.rows()))
    return rows.select("index_code", day(), F.col("revision").cast("long").alias("revision"), "snapshot")


IMPACT = """SELECT l.index_code, l.index_date, l.ver AS published_version, {base} AS baseline, t.published_value AS recomputed,
  CASE WHEN {base} IS NULL OR t.published_value IS NULL THEN ({base} IS NULL) <> (t.published_value IS NULL)
    ELSE abs(t.published_value - {base}) > 0.005e0 END AS differs,
  CASE WHEN {base} <> 0 THEN t.published_value / {base} - 1 END AS change
  FROM live l LEFT JOIN fix t ON t.snapshot = l.snapshot AND t.code = l.index_code AND t.ver = '1.2.0'
  LEFT JOIN fix a ON a.snapshot = l.snapshot AND a.code = l.index_code AND a.ver = '1.1.0'
  WHERE l.snapshot IN (SELECT snapshot FROM obs)"""


def _on_file(ws):
    rows = T.live(ws.tape())
    return rows.join(R.on_file(rows, ws.rows()), "snapshot", "left_semi")


IMPACT_COLS = f"{ID}, published_version, round(baseline, 6) AS baseline, round(recomputed, 6) AS recomputed, differs, round(change, 6) AS change"


def _impact_rows(rows):
    return rows.select("index_code", day(), "published_version", r6("baseline"), r6("recomputed"), "differs", r6("change"))


@register("version_impact", query(f"SELECT {IMPACT_COLS} FROM ({IMPACT.format(base='l.value')})", "live", "obs"))
def _(ws):
    values = ws.fixings()
    return _impact_rows(R.version_impact(_on_file(ws), values, "1.2.0"))


@register("version_impact_against", query(f"SELECT {IMPACT_COLS} FROM ({IMPACT.format(base='a.published_value')})", "live", "obs"))
def _(ws):
    values = ws.fixings()
    return _impact_rows(R.version_impact(_on_file(ws), values, "1.2.0", "1.1.0"))


@register(
    "impact_summary",
    query(f"""SELECT index_code, count(*) AS fixings, count(*) FILTER (WHERE differs) AS differ, count(*) FILTER (WHERE differs AND change IS NULL) AS flips,
        round(median(abs(change)) FILTER (WHERE differs AND change IS NOT NULL), 6) AS median_move,
        round(arg_max(change, abs(change)) FILTER (WHERE differs AND change IS NOT NULL), 6) AS largest_move
        FROM ({IMPACT.format(base='l.value')}) GROUP BY 1""", "live", "obs"),
)
def _(ws):
    values = ws.fixings()
    rows = R.impact_summary(R.version_impact(_on_file(ws), values, "1.2.0"))
    return rows.select("index_code", "fixings", "differ", "flips", r6("median_move"), r6("largest_move"))


BANDS = [1.0, 0.8, 0.667, 0.5, 0.333, 0.2, 0.05]


@register(
    "robustness",
    query("SELECT 1", "live", "obs", "weights").replace(
        "\nSELECT 1",
        f""", bands AS (SELECT unnest([{', '.join(f'{b}e0' for b in BANDS)}]) AS band),
        owned AS MATERIALIZED (SELECT l.index_code, l.index_date, l.ver, w.price, w.w, least(greatest(w.spread, 0.03e0), 0.5e0) AS sp
          FROM live l JOIN fix f ON f.snapshot = l.snapshot AND f.code = l.index_code AND f.ver = l.ver AND f.passed
          JOIN weights w ON w.d = f.d AND w.code = f.code AND w.ver = f.ver),
        walked AS MATERIALIZED (SELECT index_code, index_date, vote, m, sum(m) OVER (PARTITION BY index_code, index_date ORDER BY vote, m ROWS UNBOUNDED PRECEDING) - m AS s0,
          sum(m) OVER (PARTITION BY index_code, index_date) AS tot
          FROM (SELECT index_code, index_date, w / 3 AS m, unnest([price * (1 - sp), price, price * (1 + sp)]) AS vote FROM owned)),
        series AS MATERIALIZED (SELECT index_code, index_date, band, CASE WHEN band >= 1 THEN any_value(mean) ELSE sum(ins * vote) / sum(ins) END AS v
          FROM (SELECT w.*, band, greatest(0e0, least(s0 + m, (1 + band) / 2 * tot) - greatest(s0, (1 - band) / 2 * tot)) AS ins FROM walked w CROSS JOIN bands)
          JOIN (SELECT index_code, index_date, sum(price * w) / sum(w) AS mean FROM owned GROUP BY ALL) USING (index_code, index_date)
          GROUP BY index_code, index_date, band),
        moved AS (SELECT *, abs(v / lag(v) OVER (PARTITION BY index_code, band ORDER BY index_date) - 1) AS mv FROM series)
        SELECT index_code, band, round(avg(v), 6) AS level, count(*) AS fixings, round(median(mv), 6) AS median_move, round(max(mv), 6) AS worst_move,
          round(avg(v) / (SELECT avg(v) FROM series s WHERE s.index_code = moved.index_code AND s.band = 1) - 1, 6) AS versus_reference
        FROM moved GROUP BY index_code, band""",
    ),
)
def _(ws):
    rows = _on_file(ws).where(F.col(VER).isin(*rules.METHODOLOGIES))
    pairs = rows.select("snapshot", VER).distinct()
    screened = ws.owned_screened().join(pairs, ["snapshot", VER], "left_semi")
    passed = ws.owned_fixings().where("passed").select(*R.FIXING)
    out = R.robustness_of(rows, screened, passed, rules.registry(), BANDS)
    return out.select("index_code", "band", r6("level"), "fixings", r6("median_move"), r6("worst_move"), r6("versus_reference"))


@register(
    "gate_override",
    query("""SELECT code AS index_code, count(*) AS fixings, count(*) FILTER (WHERE passed) AS published,
        count(*) FILTER (WHERE provider_count >= 25 AND observation_count >= 8 AND dispersion <= 0.3e0 AND tier1_present) AS published_under_override
        FROM fix GROUP BY 1""", "fix", only="1.2.0"),
)
def _(ws):
    """What stricter gates would have withheld: a version that exists only in this query."""
    strict = {
        "1.2.0": rules.METHODOLOGIES["1.2.0"].revised("1.2.0", min_providers=25, max_dispersion=0.3, require_tier1=True)
    }
    current = ws.fixings().where(f"{VER} = '1.2.0'")
    under = E.fixings_of(ws.screened().where(f"{VER} = '1.2.0'"), KEYS, strict)
    both = current.select(*KEYS, "passed").join(under.select(*KEYS, F.col("passed").alias("strict")), KEYS)
    return both.groupBy("index_code").agg(
        F.count(F.lit(1)).alias("fixings"), F.count_if("passed").alias("published"), F.count_if("strict").alias("published_under_override")
    )


piece("twobasis", """SELECT * EXCLUDE (basis), 'all' AS basis FROM quotes UNION ALL SELECT * EXCLUDE (basis), 'conforming' FROM quotes WHERE abs(np / p - 1) <= 1e-9""", ["quotes"])
piece("ev", """SELECT d, code, basis, source AS provider, median(np) AS price, count(*) AS quote_count, min(tier) AS best_tier FROM twobasis GROUP BY ALL""", ["twobasis"])
piece("es", """SELECT ev.*, pn >= 4 AND CASE WHEN pmad > 0 THEN abs(price - pm) / (pmad * 1.4826e0) > 3
    WHEN pm > 0 AND price > 0 THEN greatest(price / pm, pm / price) > 3e0 * (1 + 1e-9) ELSE false END AS screened_out
  FROM ev JOIN (SELECT d, code, basis, median(price) AS pm, mad(price) AS pmad, count(*) AS pn FROM ev GROUP BY ALL) USING (d, code, basis)""", ["ev"])
EXPOSURE = """, el(d, code, basis, provider, price, quote_count, best_tier, w, rnd, n) AS (
  SELECT d, code, basis, provider, price, quote_count, best_tier, CASE best_tier WHEN 1 THEN 1e0 WHEN 2 THEN 0.6e0 ELSE 0.25e0 END, 0,
    count(*) OVER (PARTITION BY d, code, basis) FROM es WHERE NOT screened_out
  UNION ALL SELECT d, code, basis, provider, price, quote_count, best_tier,
    CASE WHEN w / tot > 0.35e0 AND 0.35e0 * (tot - w) / (1 - 0.35e0) < w THEN 0.35e0 * (tot - w) / (1 - 0.35e0) ELSE w END, rnd + 1, n
  FROM (SELECT *, max(w / tot) OVER (PARTITION BY d, code, basis) AS top FROM (SELECT *, sum(w) OVER (PARTITION BY d, code, basis) AS tot FROM el))
  WHERE rnd < n AND n * 0.35e0 >= 1 AND top > 0.35e0),
ew AS MATERIALIZED (SELECT * FROM el QUALIFY rnd = max(rnd) OVER (PARTITION BY d, code, basis)),
efix AS MATERIALIZED (SELECT *, n >= 4 AND q >= 8 AND coalesce(disp <= 0.45e0, false) AS passed FROM (SELECT d, code, basis, sum(price * w) / sum(w) AS value, count(*) AS n, sum(quote_count) AS q,
  CASE WHEN count(*) >= 3 THEN mad(price) * 1.4826e0 / median(price) END AS disp FROM ew GROUP BY ALL))
SELECT CAST(s.d AS VARCHAR) AS index_date, s.code AS index_code, round(CASE WHEN a.passed THEN a.value END, 6) AS published,
  round(CASE WHEN c.passed THEN c.value END, 6) AS conforming_only,
  round((CASE WHEN a.passed THEN a.value END - CASE WHEN c.passed THEN c.value END) / CASE WHEN c.passed THEN c.value END, 6) AS shift,
  s.total_quotes, s.conforming_quotes, coalesce(c.n, 0) AS conforming_providers, round(t.share, 6) AS weight_share_adjusted,
  round(s1, 6) AS share_form_factor, round(s2, 6) AS share_interconnect, round(s3, 6) AS share_commitment, round(s4, 6) AS share_node_size,
  coalesce(c.passed, false) AS publishable_without_adjustment
FROM (SELECT d, code, count(*) AS total_quotes, count(*) FILTER (WHERE abs(np / p - 1) <= 1e-9) AS conforming_quotes,
   avg(CASE WHEN f1 <> 1 THEN 1e0 ELSE 0e0 END) AS s1, avg(CASE WHEN f2 <> 1 THEN 1e0 ELSE 0e0 END) AS s2,
   avg(CASE WHEN commitment <> 'on_demand' THEN 1e0 ELSE 0e0 END) AS s3, avg(CASE WHEN f4 <> 1 THEN 1e0 ELSE 0e0 END) AS s4 FROM quotes GROUP BY ALL) s
LEFT JOIN efix a ON a.d = s.d AND a.code = s.code AND a.basis = 'all' LEFT JOIN efix c ON c.d = s.d AND c.code = s.code AND c.basis = 'conforming'
LEFT JOIN (SELECT ew.d, ew.code, sum(CASE WHEN q.source IS NOT NULL THEN w ELSE 0e0 END) / sum(w) AS share FROM ew
  LEFT JOIN (SELECT DISTINCT d, code, source FROM quotes WHERE abs(np / p - 1) > 1e-9) q ON q.d = ew.d AND q.code = ew.code AND q.source = ew.provider
  WHERE basis = 'all' GROUP BY ew.d, ew.code) t ON t.d = s.d AND t.code = s.code"""


@register("exposure", query("SELECT 1", "es", only="1.2.0").replace("\nSELECT 1", EXPOSURE))
def _(ws):
    keys = ["index_date", "index_code", VER]
    rows = R.exposure(ws.quotes().where(f"{VER} = '1.2.0'"), keys, rules.registry("1.2.0"))
    return rows.select(
        day(), "index_code", r6("published"), r6("conforming_only"), r6("shift"), "total_quotes", "conforming_quotes",
        "conforming_providers", r6("weight_share_adjusted"), r6("share_form_factor"), r6("share_interconnect"),
        r6("share_commitment"), r6("share_node_size"), "publishable_without_adjustment",
    )


@register(
    "audit",
    query(f"""SELECT {ID}, l.ver AS methodology_version, l.status, round(l.value, 6) AS value, s.provider, round(s.price, 6) AS price,
        round(coalesce(w.w, 0e0), 6) AS weight, s.screened_out
        FROM live l JOIN scr s ON s.d = l.index_date AND s.code = l.index_code AND s.ver = l.ver
        LEFT JOIN weights w ON w.d = s.d AND w.code = s.code AND w.ver = s.ver AND w.provider = s.provider
        WHERE l.snapshot IN (SELECT snapshot FROM obs)""", "live", "obs", "weights"),
)
def _(ws):
    """Every live value beside the contributions its own snapshot still supports."""
    made_of = ws.contributions()  # before the tape, whose values then come from the same votes
    rows = _on_file(ws).select("snapshot", "index_code", VER, "status", "value").join(
        made_of, ["snapshot", "index_code", VER]
    )
    return rows.select("index_code", day(), VER, "status", r6("value"), "provider", r6("price"), r6("weight"), "screened_out")
