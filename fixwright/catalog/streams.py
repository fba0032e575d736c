"""Queries that run as streams and must end where the batch jobs do, and the whole daily jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import tape as T
from ..plans import bundle
from ..sources.staging import new_path
from ..streaming import intake
from .registry import day, r6, register
from .sql import query


@register(
    "stream_feed_totals",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS "rows", round(avg(value), 6) AS mean_value FROM events
       WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY ALL""",
)
def _(ws):
    """Events streamed from file; a day is final once the watermark has passed it."""
    events = ws.table("events")
    stream = ws.spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(ws.sf_dir)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = new_path(ws.spark, "feed-totals")
    totals = intake.feed_totals(stream, "ts", "event_type", "value")
    intake.land(totals, out, f"{out}-checkpoint").awaitTermination()
    rows = ws.spark.read.schema("day timestamp, event_type string, rows long, mean_value double").parquet(out)
    return rows.select(day("day"), "event_type", "rows", r6("mean_value"))


@register("stream_intake", query('SELECT snapshot, count(*) AS "rows", count(DISTINCT source) AS sources FROM obs GROUP BY 1', "obs"))
def _(ws):
    """The archive taken in file by file; nothing twice, nothing lost."""
    archive = ws.observations()
    path = archive.inputFiles()[0].rsplit("/snapshot=", 1)[0]
    out = new_path(ws.spark, "intake")
    stream = ws.spark.readStream.schema(archive.schema).option("maxFilesPerTrigger", 64).parquet(path)
    intake.land(stream, out, f"{out}-checkpoint").awaitTermination()
    return ws.spark.read.schema(archive.schema).parquet(out).groupBy("snapshot").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("source").alias("sources")
    )


@register(
    "stream_fixings",
    query("""SELECT CAST(d AS VARCHAR) AS index_date, code AS index_code, CASE WHEN passed THEN 'published' ELSE 'withheld' END AS status,
        round(published_value, 6) AS value, provider_count FROM fix
        WHERE CAST(d AS TIMESTAMP) + INTERVAL 1 MONTH <= (SELECT max(observed_at) FROM obs) - INTERVAL 6 HOUR""", "fix", only="1.2.0"),
)
def _(ws):
    """The archive streamed through the publisher in batches: the live tape must equal the batch fixings."""
    archive = ws.observations()
    files = archive.inputFiles()
    path = files[0].rsplit("/snapshot=", 1)[0]
    job = intake.run_once(
        ws.spark, archive, path, max(1, -(-len(files) // 2)), period_end="index_date + INTERVAL 1 MONTH"
    )
    return T.live(job.tape()).select(day(), "index_code", "status", r6("value"), "provider_count")


# --- the published bundle -------------------------------------------------------
@register(
    "bundle_series",
    query("""SELECT index_code, CAST(index_date AS VARCHAR) AS index_date, CAST(revision AS BIGINT) AS revision, status, round(value, 6) AS value,
        round(value * dispersion, 6) AS band, revision = max(revision) OVER (PARTITION BY index_code, index_date) AS live FROM tape""", "tape"),
)
def _(ws):
    rows = bundle.series(ws.tape())
    return rows.select("index_code", day(), F.col("revision").cast("long").alias("revision"), "status", r6("value"), r6("band"), "live")


@register(
    "bundle_latest",
    query("""SELECT l.index_code, CAST(l.index_date AS VARCHAR) AS index_date, l.status, round(l.value, 6) AS value, l.provider_count FROM live l
        WHERE l.index_date = (SELECT max(index_date) FROM live x WHERE x.index_code = l.index_code)""", "live"),
)
def _(ws):
    return bundle.latest_fixing(ws.tape()).select("index_code", day(), "status", r6("value"), "provider_count")


@register(
    "bundle_latest_quotes",
    query("""SELECT q.code AS index_code, q.source, q.source_sku, round(q.p, 6) AS raw, round(q.np, 6) AS normalized, CAST((q.f1 <> 1)::INT + (q.f2 <> 1)::INT
          + (q.commitment <> 'on_demand')::INT + (q.f4 <> 1)::INT AS BIGINT) AS steps
        FROM quotes q JOIN live l ON l.snapshot = q.snapshot AND l.index_code = q.code AND l.ver = q.ver
        WHERE l.index_date = (SELECT max(index_date) FROM live x WHERE x.index_code = l.index_code AND x.ver = '1.2.0') AND l.ver = '1.2.0'""", "live", "quotes"),
)
def _(ws):
    """Quotes behind the newest fixing whose version is still registered."""
    known = ws.tape().where("methodology_version = '1.2.0'")
    rows = bundle.latest_quotes(bundle.latest_fixing(known), ws.quotes())
    return rows.select(
        "index_code", "source", "source_sku", r6("usd_per_gpu_hour", "raw"), r6("normalized_usd_per_gpu_hour", "normalized"),
        F.size("adjustments").cast("long").alias("steps"),
    )


@register(
    "bundle_coverage",
    query("""SELECT count(*) AS tape_rows, CAST(min(index_date) AS VARCHAR) AS first_date, CAST(max(index_date) AS VARCHAR) AS last_date,
        (SELECT count(DISTINCT snapshot) FROM obs) AS snapshots FROM tape""", "tape", "obs"),
)
def _(ws):
    return bundle.coverage(ws.tape(), ws.observations()).select("tape_rows", day("first_date"), day("last_date"), "snapshots")


# --- daily run totals -----------------------------------------------------------
@register(
    "run_report",
    query("""SELECT o.snapshot, o.n AS observations, coalesce(q.n, 0) AS quotes, coalesce(f.published, 0) AS published, coalesce(f.withheld, 0) AS withheld
        FROM (SELECT snapshot, count(*) AS n FROM obs GROUP BY 1) o LEFT JOIN (SELECT snapshot, count(*) AS n FROM quotes GROUP BY 1) q USING (snapshot)
        LEFT JOIN (SELECT snapshot, count(*) FILTER (WHERE passed) AS published, count(*) FILTER (WHERE NOT passed) AS withheld FROM fix GROUP BY 1) f USING (snapshot)""",
          "fix", only="1.2.0"),
)
def _(ws):
    """What each run collected, kept, published and withheld under the current rules."""
    current = f"methodology_version = '{rules.CURRENT}'"
    count = F.count(F.lit(1))
    runs = ws.observations().groupBy("snapshot").agg(count.alias("observations"))
    kept = ws.quotes().where(current).groupBy("snapshot").agg(count.alias("quotes"))
    fixed = ws.fixings().where(current).groupBy("snapshot").agg(
        F.count_if("passed").alias("published"), F.count_if(~F.col("passed")).alias("withheld")
    )
    out = runs.join(kept, "snapshot", "left").join(fixed, "snapshot", "left")
    return out.select("snapshot", "observations", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quotes", "published", "withheld")])
