"""The stand-in book over the star schema: a loan is an order, its months are the months its lines ship in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica.functions.columns import month_ordinal, weibull_hazard
from cohortica.operators.book import truncate
from cohortica.operators.cells import CellSpec, cells

EDGES = {"price": (0.0, 50_000.0, 100_000.0, 150_000.0, 200_000.0, 300_000.0), "acctbal": (-1_000.0, 0.0, 2_500.0, 5_000.0, 7_500.0, 10_000.0)}
FINE = {"price": tuple(float(x) for x in range(0, 400_001, 25_000)), "acctbal": EDGES["acctbal"]}
SPEC = CellSpec(EDGES, ("segment", "priority"))
AGE_EDGES = (0.0, 12.0, 24.0, 36.0, 60.0, 120.0)
LOG_SHAPE = 0.26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("loan"), "o_custkey", month_ordinal("o_orderdate").alias("origination_month"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("vintage"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return o.join(c, o.o_custkey == c.c_custkey).drop("o_custkey", "c_custkey")


def months(spark: SparkSession, sf_dir: str, policy: str = "exclude") -> DataFrame:
    """One row per loan and month with age 0 or more. policy: what a moratorium month (open line, quantity under 3) does."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("loan"), month_ordinal("l_shipdate").alias("month"), "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    any_ = lambda c: F.bool_or(c)
    q = F.col("l_quantity")
    m = li.groupBy("loan", "month").agg(
        any_((F.col("l_returnflag") == "R") & (q > 45)).alias("bad"),
        any_((F.col("l_returnflag") == "A") & (F.col("l_discount") >= 0.09)).alias("prepaid"),
        any_((F.col("l_returnflag") == "N") & (F.col("l_tax") >= 0.08)).alias("stops"),
        any_((F.col("l_linestatus") == "O") & (q < 3)).alias("relief"),
        F.max("l_tax").alias("rate"),
        F.max("l_quantity").cast("int").alias("remaining"),
    )
    relief = F.col("relief")
    return m.select("loan", "month", (F.col("bad") & ~relief if policy == "exclude" else F.col("bad")).alias("defaulted"), "prepaid", F.lit(False).alias("left"), (F.col("stops") | relief if policy == "censor" else F.col("stops")).alias("ends"), F.col("stops").alias("modified"), F.col("rate"), "remaining")


def book(spark: SparkSession, sf_dir: str, policy: str = "exclude", crr: bool = False) -> DataFrame:
    m, o = months(spark, sf_dir, policy), loans(spark, sf_dir)
    j = m.join(o, "loan").withColumn("age", F.col("month") - F.col("origination_month")).where("age >= 0")
    if crr:
        j = j.withColumns({"rate": F.col("rate") * 100, "note_rate": F.lit(5.0)})
    return truncate(j, period="month", crr=crr)


def cell_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(book(spark, sf_dir), SPEC, "vintage")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the hazard of a fixed formula."""
    eta = F.lit(4.6) - F.lit(0.002) * F.col("price") / 1000 + F.lit(0.00002) * F.col("acctbal") + F.when(F.col("segment") == "BUILDING", 0.2).otherwise(0.0)
    return cell_table(spark, sf_dir).withColumn("hazard", weibull_hazard("age", eta, LOG_SHAPE)).withColumn("month", F.col("origination_month") + F.col("age"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month, price (mean order), volume (orders), discount (mean line)."""
    o = table(spark, sf_dir, "orders").groupBy(month_ordinal("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("price_index"), F.count("*").cast("double").alias("volume"))
    li = table(spark, sf_dir, "lineitem").groupBy(month_ordinal("l_shipdate").alias("month")).agg(F.avg("l_discount").alias("discount_rate"))
    return o.join(li, "month")


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.groupBy(F.col("user_id").alias("loan"), day.alias("age")).agg(F.count_if(F.col("event_type") == "error").cast("int").alias("errors"), F.count("*").alias("events"))
