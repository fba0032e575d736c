"""Tables derived once per data set: the archive, prepared rows, votes, fixings, tape.

The same stages a daily installation stores. Each is written to the shared
folder the first time a query needs it and read back by the queries after it.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..operators import estimate as E
from ..operators import prepare as P
from ..operators import tape as T
from ..sources import star
from ..sources.staging import written

RUN = ["snapshot", "index_date"]
KEYS = [*RUN, "index_code", "methodology_version"]


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}
        self._plans: dict[str, tuple[DataFrame, DataFrame]] = {}

    def _once(self, name: str, build, partition_by: list[str] | None = None) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = written(build(), name, partition_by)
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return star.table(self.spark, self.sf_dir, name)

    def scan(self) -> DataFrame:
        """The archive's rows, one run per month: those on file if a query has written them, else planned, so that one pass reads only its columns."""
        for name in ("observations", "rows"):
            if name in self._kept:
                return self._kept[name]
        obs = star.observations(self.spark, self.sf_dir)
        return obs.withColumn("snapshot", F.concat(F.lit("run-"), F.col("index_date").cast("string")))

    def rows(self) -> DataFrame:
        """The archive's rows written as they come, for queries that read every run more than once."""
        return self._kept["observations"] if "observations" in self._kept else self._once("rows", self.scan)

    def observations(self) -> DataFrame:
        """The archive of collection runs, a partition for each run, for queries that read some of them."""
        return self._once("observations", self.scan, ["snapshot"])

    def prepared(self) -> DataFrame:
        """Every row under every version with its outcome, planned: whoever needs it reads it once."""
        return self._planned("every")[0].drop(
            "gpu_model", "usd_per_hour_total", "currency", "price_kind", "vram_gb", "observed_at", "identity_reason")

    def quotes(self) -> DataFrame:
        return P.quotes(self.prepared())

    def _planned(self, name: str, versions_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Prepared rows, not written, and their books; planned once, for what is counted before that is written."""
        if name not in self._plans:
            obs = self.rows()  # every run is read, so a partition for each would be a shuffle for nothing
            if versions_of is not None:
                number = F.element_at(rules.literal({v: i for i, v in enumerate(rules.registry())}), versions_of).cast("int")
                obs = obs.withColumn("wanted_versions", F.array(number))
            self._plans[name] = P.prepare_with_books(obs, RUN, rules.registry())
        return self._plans[name]

    def screened(self) -> DataFrame:
        """Provider votes of every fixing with the screen's verdict."""
        if "screened" not in self._kept:
            votes = E.provider_votes(P.quotes(self._planned("every")[0]), KEYS)
            self._kept["screened"] = E.screen(votes, KEYS)
        return self._kept["screened"]

    def contributions(self) -> DataFrame:
        def build():
            totals = E.tier_totals(self.screened(), KEYS, rules.registry())
            return E.with_weights(self.screened(), totals, KEYS, rules.registry())

        return self._once("contributions", build)

    def fixings(self) -> DataFrame:
        return self._once(
            "fixings",
            lambda: E.publish_or_withhold(E.fixings_of(self.screened(), KEYS, rules.registry())),
        )

    def holdouts(self) -> DataFrame:
        return self._once("holdouts", lambda: P.venue_holdouts(self._planned("every")[1], RUN))

    def _version(self):
        """The version by which a date was published; the last one is not registered."""
        year = F.year("index_date")
        return F.when(year < 1997, "1.0.0").when(year < 1999, "1.1.0").when(year < 2001, "1.2.0").otherwise("0.9.0")

    def _registered(self):
        return F.when(self._version() == "0.9.0", "1.2.0").otherwise(self._version())

    def owned_screened(self) -> DataFrame:
        """Screened votes of every date under the version that published it."""
        if "owned-screened" not in self._kept:
            if "screened" in self._kept:
                return self.screened().where(F.col("methodology_version") == self._registered())
            self._kept["owned-screened"] = E.screen(E.provider_votes(P.quotes(self._planned("owned", self._registered())[0]), KEYS), KEYS)
        return self._kept["owned-screened"]

    def owned_fixings(self) -> DataFrame:
        """Fixings of every date under the version that published it."""
        if "fixings" in self._kept:
            return self.fixings().where(F.col("methodology_version") == self._registered())
        return self._once("owned-fixings", lambda: E.publish_or_withhold(E.fixings_of(self.owned_screened(), KEYS, rules.registry())))

    def _owned_holdouts(self) -> DataFrame:
        if "holdouts" in self._kept or "every" in self._plans:
            return self.holdouts()
        return P.venue_holdouts(self._planned("owned", self._registered())[1], RUN)

    def tape(self) -> DataFrame:
        """A publication record with every kind of fault a verify run must tell apart.

        Versions change over the years; a few calendar months carry a changed
        value, a withheld one, no snapshot name, a lost snapshot or a changed
        hold-out cell; February was published twice.
        """
        def build():
            month = F.month("index_date")
            rows = self.owned_fixings().withColumn("version", self._version()).join(self._owned_holdouts(), KEYS, "left")
            value = F.col("published_value")
            value = (
                F.when(month == 3, value * 1.01).when(month == 4, F.lit(None))
                .when((month == 5) & value.isNull(), F.lit(9.99)).otherwise(value)
            )
            rows = rows.select(
                "index_code", "index_date", F.when(month == 2, 1).otherwise(0).alias("revision"),
                F.when(value.isNull(), "withheld").otherwise("published").alias("status"),
                value.alias("value"), "provider_count", "observation_count", "dispersion", "withheld_reason",
                F.col("version").alias("methodology_version"),
                F.timestamp_add("HOUR", F.lit(20), F.col("index_date").cast("timestamp")).alias("published_at"),
                F.when(month == 6, F.lit(None)).when(month == 7, F.concat(F.lit("gone-"), "snapshot"))
                .otherwise(F.col("snapshot")).alias("snapshot"),
                F.when(month == 8, F.lit("another reason")).otherwise(F.col("venue_holdouts")).alias("venue_holdouts"),
            )
            first = rows.where("revision = 1").select(
                *[
                    F.lit(0).alias(c) if c == "revision"
                    else F.lit(1.11).alias(c) if c == "value"
                    else F.lit("published").alias(c) if c == "status"
                    else F.timestamp_add("DAY", F.lit(-1), F.col(c)).alias(c) if c == "published_at"
                    else F.lit("gone-first").alias(c) if c == "snapshot"
                    else F.col(c)
                    for c in rows.columns
                ]
            )
            return rows.unionByName(first)

        return self._once("tape", build)

    def order_tape(self) -> DataFrame:
        """Orders as a tape with many revisions per date."""
        def build():
            orders = self.table("orders")
            day = F.date_trunc("week", "o_orderdate").cast("date")
            status = F.when(F.col("o_orderstatus") == "P", "withheld").otherwise("published")
            rows = orders.select(
                F.col("o_orderpriority").alias("index_code"), day.alias("index_date"), "o_orderkey",
                status.alias("status"),
                F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000.0).alias("value"),
            )
            numbered = T.numbered(rows, "o_orderkey")
            at = F.timestamp_add("HOUR", F.lit(20), F.col("index_date").cast("timestamp"))
            return numbered.select(
                "index_code", "index_date", F.col("revision").cast("int").alias("revision"), "status", "value",
                F.timestamp_add("DAY", F.col("revision").cast("int"), at).alias("published_at"),
            )

        return self._once("order_tape", build)


@cache
def _workspace(application: str, sf_dir: str) -> Workspace:
    return Workspace(SparkSession.getActiveSession(), sf_dir)


#: The JVM only interprets a method of more bytes of code; rules under every version make such methods when Spark fuses them.
COMPILED_BYTES = 8_000


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The data set's workspace; Spark fuses a stage's expressions only as far as the JVM compiles the result."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)
    return _workspace(spark.sparkContext.applicationId, sf_dir)


def forget() -> None:
    """Start the next query from the given tables again."""
    _workspace.cache_clear()
