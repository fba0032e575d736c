"""The bitemporal publication record: append-only, read as of any two times.

Grouping by (index, date) uses ``max_by`` and equi-joins on the revision number,
both of which spread a key with very many revisions. The windows here run over
one live row per index and calendar date, so a partition is as long as the
calendar and no longer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order_stats import HOT_ROWS, running
from ..sources.staging import written

KEY = ["index_code", "index_date"]


def next_revision(tape: DataFrame) -> DataFrame:
    return tape.groupBy(*KEY).agg((F.max("revision") + 1).alias("next_revision"))


def appended(tape: DataFrame, values: DataFrame) -> DataFrame:
    """Number new values after whatever the tape already holds for their date."""
    return values.join(next_revision(tape), KEY, "left").withColumn(
        "revision", F.coalesce("next_revision", F.lit(0)).cast("int")
    ).drop("next_revision")


def numbered(values: DataFrame, order: str, limit: int = HOT_ROWS) -> DataFrame:
    """Revision numbers 0, 1, 2 … per index and date, for a whole history at once."""
    table = written(values.withColumn("one", F.lit(1)), "unnumbered")
    return running(table, KEY, [order], order, {"revision": ("sum", "one")}, limit=limit).drop("one")


def live(tape: DataFrame) -> DataFrame:
    """The highest revision of every index and date."""
    rest = [c for c in tape.columns if c not in KEY]
    return tape.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "revision").alias("row")).select(*KEY, "row.*")


def as_of(tape: DataFrame, knowledge_time) -> DataFrame:
    """What the tape said for every date, as known at one moment."""
    return live(tape.where(F.col("published_at") <= F.lit(knowledge_time).cast("timestamp")))


def as_of_each(tape: DataFrame, questions: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Answer many (index, date, knowledge_time) questions together.

    Tape rows and questions are laid on one time line per key and the highest
    revision so far is carried forward, so no question meets every revision.
    """
    said = F.struct("revision", "status", "value", "published_at")
    none = F.lit(None).cast("struct<revision:int,status:string,value:double,published_at:timestamp>")
    facts = tape.withColumn("revision", F.col("revision").cast("int")).select(
        *KEY, F.col("published_at").alias("at"), F.lit(0).alias("asks"), said.alias("said"),
        F.lit(None).cast("string").alias("question_id"),
    )
    asked = questions.select(
        *KEY, F.col("knowledge_time").alias("at"), F.lit(1).alias("asks"), none.alias("said"),
        F.col("question_id").cast("string").alias("question_id"),
    )
    line = written(facts.unionByName(asked), "time-line")
    order = ["at", "asks"]
    carried = running(line, KEY, order, "at", {"answer": ("max", "said")}, inclusive=True, limit=limit)
    return carried.where("asks = 1").select(
        "question_id", *KEY, F.col("at").alias("knowledge_time"), "answer.revision", "answer.status", "answer.value"
    )


def superseded(tape: DataFrame) -> DataFrame:
    """Each revision with the moment the next one replaced it."""
    after = tape.select(
        *KEY, (F.col("revision") - 1).alias("revision"), F.col("published_at").alias("superseded_at")
    )
    return tape.drop("superseded_at").join(after, [*KEY, "revision"], "left")


def superseded_in_order(tape: DataFrame) -> DataFrame:
    """The same from a tape that is kept in order of its dates and revisions: the next row of a date replaced the one before.

    A date's revisions meet in one task, which a date with very many would not spread.
    """
    nxt = F.lead(F.struct("revision", "published_at")).over(Window.partitionBy(*KEY).orderBy("revision"))
    follows = nxt["revision"] == F.col("revision") + 1
    return tape.drop("superseded_at").withColumn("superseded_at", F.when(follows, nxt["published_at"]))


def newest(tape: DataFrame, n: int) -> DataFrame:
    """The newest n dates of every index, live revisions only."""
    back = Window.partitionBy("index_code").orderBy(F.desc("index_date"))
    return live(tape).withColumn("age", F.row_number().over(back)).where(F.col("age") <= n)


def revisions(tape: DataFrame, index_code: str, index_date) -> DataFrame:
    """Every revision of one date, oldest first."""
    return tape.where(
        (F.col("index_code") == index_code) & (F.col("index_date") == F.lit(index_date).cast("date"))
    ).orderBy("revision")


def previous_published(tape: DataFrame) -> DataFrame:
    """The latest earlier date whose live revision is published, beside every live row."""
    earlier = (
        Window.partitionBy("index_code").orderBy("index_date").rowsBetween(Window.unboundedPreceding, -1)
    )
    published = F.when(F.col("status") == "published", F.struct("index_date", "revision", "value"))
    return live(tape).withColumn("previous", F.last(published, ignorenulls=True).over(earlier))


def series_summary(tape: DataFrame) -> DataFrame:
    """Published and withheld live dates per index, with the newest value and date."""
    rows = live(tape)
    out = rows.groupBy("index_code").agg(
        F.count_if(F.col("status") == "published").alias("published_count"),
        F.count_if(F.col("status") != "published").alias("withheld_count"),
        F.max_by(
            "value", F.when(F.col("status") == "published", F.col("index_date"))
        ).alias("latest_value"),
        F.max("index_date").alias("latest_date"),
    )
    return out


def widened(tape: DataFrame, columns: list[str]) -> DataFrame:
    """Add columns appended since a tape was written; refuse one that is not a prefix."""
    if tape.columns != columns[: len(tape.columns)]:
        raise ValueError(f"tape columns {tape.columns} are not a prefix of {columns}")
    return tape.select("*", *[F.lit(None).cast("string").alias(c) for c in columns[len(tape.columns):]])
