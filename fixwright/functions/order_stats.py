"""Exact grouped medians and running totals that survive a hot group.

A window keeps one group in one task, which is right for ordinary groups. A
group with more than
``limit`` rows is cut into value ranges instead: each range is totalled on its
own, the totals (a bounded number per group) locate the wanted ranks, and only
the range holding them is put in order. No row is dropped and nothing is
approximate: the approximate quantiles only choose where to cut.

What is joined to a hot group is a small table that was written before, a row for each
group or range, so the join broadcasts it or splits the group.

The inputs are written tables (see ``sources.staging``), so asking whether any
group is hot costs a footer count, and a grouped count only beyond ``limit``
rows in the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import written

HOT_ROWS = 1_000_000
PARTS = 256


def value_counts(df: DataFrame, keys: list[str], value: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values per group with their multiplicity ``n``.

    Partial aggregation runs before the shuffle, and the shuffle is on
    (keys, value), so a hot group is spread over all tasks.
    """
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, value)])
    return df.where(present).groupBy(*keys, value, *carry).agg(F.count(F.lit(1)).alias("n"))


def hot_groups(table: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys of the groups above ``limit`` rows, or None when there are none."""
    if table.count() <= limit:
        return None
    hot = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > limit).select(*keys)
    return None if hot.isEmpty() else hot


def _cut_points(df: DataFrame, keys: list[str], value: str, parts: int) -> DataFrame:
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return written(df.groupBy(*keys).agg(F.percentile_approx(value, at, F.lit(10_000)).alias("cuts")), "cuts")


def _part_of(value: str) -> Column:
    return F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col(value))), F.lit(0))


def _median_of_hot(rows: DataFrame, keys: list[str], value: str, out: str, parts: int) -> DataFrame:
    total = rows.groupBy(*keys).agg(F.sum("n").alias("total"))
    placed = (
        rows.join(_cut_points(rows, keys, value, parts), keys)
        .withColumn("part", _part_of(value))
        .drop("cuts")
    )
    by_part = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        placed.groupBy(*keys, "part")
        .agg(F.sum("n").alias("mass"))
        .withColumn("before", F.coalesce(F.sum("mass").over(by_part), F.lit(0)))
        .join(total, keys)
        .withColumn("lo", F.floor((F.col("total") - 1) / 2))
        .withColumn("hi", F.floor(F.col("total") / 2))
        .where((F.col("before") <= F.col("hi")) & (F.col("before") + F.col("mass") > F.col("lo")))
        .select(*keys, "part", "before", "lo", "hi")
    )
    inside = (
        Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    ranked = placed.join(written(wanted, "wanted-ranges"), [*keys, "part"]).withColumn("start", start)

    def at(rank: str) -> Column:
        holds = (F.col("start") <= F.col(rank)) & (F.col("start") + F.col("n") > F.col(rank))
        return F.max(F.when(holds, F.col(value)))

    return written(ranked.groupBy(*keys).agg(((at("lo") + at("hi")) / 2.0).alias(out)), "hot-medians")


def _placed(df: DataFrame, keys: list[str], value: str, total: bool = True) -> DataFrame:
    """Every row with the mass before it in its group, ``__start``, and the group's, ``__total``: one shuffle, one sort, no join."""
    ordered = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__start", F.coalesce(F.sum("n").over(ordered), F.lit(0)))
    return rows.withColumn("__total", F.sum("n").over(Window.partitionBy(*keys))) if total else rows


def _median(value: str, over=lambda c: c) -> Column:
    """The weighted median of a group of ``_placed`` rows, as an aggregate or ``over`` a window."""
    start, total = F.col("__start"), F.col("__total")

    def at(rank: Column) -> Column:
        holds = (start <= rank) & (start + F.col("n") > rank)
        return over(F.max(F.when(holds, F.col(value))))

    return (at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2.0


def _centred(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``_placed`` rows in order of their distance ``__away`` from the group's ``median``; the group's total is found once."""
    whole = Window.partitionBy(*keys)
    rows = _placed(df, keys, value).withColumn("median", _median(value, lambda c: c.over(whole)))
    away = rows.drop("__start").withColumn("__away", F.abs(F.col(value) - F.col("median")))
    return _placed(away, keys, "__away", total=False)


def with_median_and_mad(
    counts: DataFrame, keys: list[str], value: str, limit: int = HOT_ROWS, parts: int = PARTS
) -> DataFrame:
    """Every row with its group's ``median``, ``mad`` and ``total``, rows weighted by ``n``."""
    hot = hot_groups(counts, keys, limit)

    def plain(df: DataFrame) -> DataFrame:
        whole = Window.partitionBy(*keys)
        rows = _centred(df, keys, value).withColumn("mad", _median("__away", lambda c: c.over(whole)))
        return rows.withColumn("total", F.col("__total")).drop("__away", "__start", "__total")

    if hot is None:
        return plain(counts)
    hot_rows = counts.join(hot, keys, "left_semi")
    med = _median_of_hot(hot_rows, keys, value, "median", parts)
    centred = hot_rows.join(med, keys)
    away = centred.withColumn("__away", F.abs(F.col(value) - F.col("median")))
    mad = _median_of_hot(away, keys, "__away", "mad", parts)
    size = written(hot_rows.groupBy(*keys).agg(F.sum("n").alias("total")), "hot-sizes")
    return plain(counts.join(hot, keys, "left_anti")).unionByName(centred.join(mad, keys).join(size, keys))


def grouped_median(
    counts: DataFrame,
    keys: list[str],
    value: str,
    out: str = "median",
    limit: int = HOT_ROWS,
    parts: int = PARTS,
) -> DataFrame:
    """Exact median of ``value`` per group, each value weighted by its count ``n``."""
    hot = hot_groups(counts, keys, limit)
    plain = lambda df: _placed(df, keys, value).groupBy(*keys).agg(_median(value).alias(out))
    if hot is None:
        return plain(counts)
    split = _median_of_hot(counts.join(hot, keys, "left_semi"), keys, value, out, parts)
    return plain(counts.join(hot, keys, "left_anti")).unionByName(split)


def median_and_mad(
    counts: DataFrame, keys: list[str], value: str, limit: int = HOT_ROWS, parts: int = PARTS,
    also: tuple[Column, ...] = (),
) -> DataFrame:
    """Median and median absolute deviation per group: (keys, median, mad, …)."""
    def plain(df: DataFrame) -> DataFrame:
        return _centred(df, keys, value).groupBy(*keys).agg(F.max("median").alias("median"), _median("__away").alias("mad"), *also)

    hot = hot_groups(counts, keys, limit)
    if hot is None:
        return plain(counts)
    split = with_median_and_mad(counts.join(hot, keys, "left_semi"), keys, value, limit, parts)
    split = split.groupBy(*keys).agg(F.max("median").alias("median"), F.max("mad").alias("mad"), *also)
    return plain(counts.join(hot, keys, "left_anti")).unionByName(split)


def running(
    table: DataFrame,
    keys: list[str],
    order: list[str | Column],
    cut_on: str,
    out: dict[str, tuple[str, str]],
    inclusive: bool = False,
    limit: int = HOT_ROWS,
    parts: int = PARTS,
) -> DataFrame:
    """Running ``sum`` or ``max`` per group, in ``order``, without one task per hot group.

    ``cut_on`` is the leading order column (numeric, date or timestamp). Ties on
    it always share a part, so the later order columns still decide among them.
    Each entry of ``out`` is ``name -> ("sum" | "max", column)``.
    """
    fold = {"sum": F.sum, "max": F.max}
    last = 0 if inclusive else -1

    def inside(name: str, groups: list[str]) -> Column:
        fn, col = out[name]
        window = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        here = fold[fn](F.col(col)).over(window)
        return F.coalesce(here, F.lit(0)) if fn == "sum" else here

    hot = hot_groups(table, keys, limit)
    if hot is None:
        return table.select("*", *[inside(name, keys).alias(name) for name in out])

    cuts = _cut_points(table.join(hot, keys, "left_semi"), keys, cut_on, parts)
    placed = table.join(cuts, keys, "left").withColumn("part", _part_of(cut_on)).drop("cuts")
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = placed.groupBy(*keys, "part").agg(
        *[fold[fn](col).alias(f"{name}__part") for name, (fn, col) in out.items()]
    )
    per_part = per_part.select(
        *keys, "part", *[fold[fn](f"{name}__part").over(earlier).alias(f"{name}__prior") for name, (fn, _) in out.items()]
    )
    joined = placed.join(written(per_part, "range-totals"), [*keys, "part"])
    for name, (fn, _) in out.items():
        prior, here = F.col(f"{name}__prior"), inside(name, [*keys, "part"])
        both = F.coalesce(prior, F.lit(0)) + here if fn == "sum" else F.greatest(prior, here)
        joined = joined.withColumn(name, both)
    return joined.drop("part", *[f"{name}__prior" for name in out])
