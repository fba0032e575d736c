"""The TPC-H-like test tables read as the engine's own record shapes.

Only a mapping: each function is one projection over joins on table keys, so
every engine operator can run over data of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ODD = 0.0000693147180559945


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as venue quotes, one collection run per calendar month."""
    li, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    seller = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")
    )
    joined = (  # the names come last: at any size they are the widest, and the rows that are shuffled before stay narrow
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(part, li.l_partkey == part.p_partkey)
        .join(seller, li.l_suppkey == F.col("s_suppkey"))
    )
    source = (
        F.when(F.col("n_nationkey") == 9, "vastai")
        .when(F.col("n_regionkey") == 3, "desk")
        .when(F.col("n_regionkey") == 0, F.col("s_name"))
        .otherwise(F.concat(F.lit("feed"), F.col("n_regionkey").cast("string"), F.lit(":"), F.col("s_name")))
    )
    family = (
        F.when(F.col("p_type") == "ECONOMY", "H100")
        .when(F.col("p_type") == "STANDARD", "H200")
        .when(F.col("p_type") == "MEDIUM", "A100")
        .when(F.col("p_type") == "PROMO", "B200")
        .when(F.col("p_type") == "LARGE", "MI300X")
        .otherwise("L40S")
    )
    card = (
        F.when(F.col("p_type") == "STANDARD", 141)
        .when(F.col("p_type") == "PROMO", 192)
        .when(F.col("p_type") == "LARGE", 192)
        .otherwise(80)
    )
    suffixes = ["", " SXM", " PCIE", " NVL", " 40GB", "-SXM5_80GB", "0", "  80GB HBM3"]
    suffix = F.get(F.array(*[F.lit(s) for s in suffixes]), F.col("p_size") % 8)
    count = (
        F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber")).when(F.col("l_linenumber") == 3, 4).otherwise(8)
    ).cast("int")
    commitment = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "spot")
        .when(F.col("o_orderpriority") == "2-HIGH", "community")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "reserved")
        .otherwise("on_demand")
    )
    # The odd fraction keeps every price off the decimal grid, so no rounding falls on a tie.
    open_price = (1.2 + ODD + F.col("l_extendedprice") / 35000.0) * F.when(F.col("s_acctbal") > 9000, 5.0).otherwise(1.0)
    # The desk prices by card alone, and sells spot at half of that: a policy, not a price.
    desk_price = (ODD + (4.0 + F.col("p_size") % 8) / 3.0) * F.when(commitment == "spot", 0.5).otherwise(1.0)
    price = F.when(source == "desk", desk_price).otherwise(open_price)
    regions = [None, "", "us-east-1", "Texas, US", "Australia, AU", "eastus2", "Germany, DE", "Georgia, US",
               "Salt Lake City", "Russia, RU"]
    return joined.select(
        source.alias("source"),
        F.concat(F.lit("L"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
                 F.lit("-"), F.col("l_partkey").cast("string")).alias("source_sku"),
        F.concat(F.when(F.col("p_size") > 40, "NVIDIA ").otherwise(""), family, suffix).alias("gpu_model"),
        count.alias("gpu_count"),
        (price * count).alias("usd_per_hour_total"),
        F.when(F.col("l_tax") > 0.075, "EUR").when(F.col("l_tax") > 0.065, "usd").otherwise("USD").alias("currency"),
        F.when(F.col("l_discount") > 0.095, "from_floor").otherwise("quoted").alias("price_kind"),
        commitment.alias("commitment"),
        F.when(F.col("l_returnflag") == "A", "sxm").when(F.col("l_returnflag") == "N", "pcie")
        .otherwise("unknown").alias("form_factor"),
        F.get(F.array(*[F.lit(x) for x in ("nvlink", "infiniband", "ethernet", "none", "unknown")]),
              (F.col("l_partkey") % 5).cast("int")).alias("interconnect"),
        F.when(F.col("p_size") % 9 == 0, F.lit(None)).when(F.col("p_size") % 9 == 1, 40)
        .when(F.col("p_size") % 9 == 2, card * count).otherwise(card).cast("int").alias("vram_gb"),
        F.get(F.array(*[F.lit(r) for r in regions]), ((F.col("l_suppkey") + F.col("l_partkey")) % 10).cast("int"))
        .alias("region"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("tier"),
        F.when(F.col("l_linenumber") < 7, F.col("l_partkey")).alias("machine_id"),
        F.when(F.col("l_linenumber") < 7, F.col("l_suppkey")).alias("host_id"),
        F.col("l_shipdate").alias("observed_at"),
        F.date_trunc("month", "l_shipdate").cast("date").alias("index_date"),
    )
