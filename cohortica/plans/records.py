"""Raw text records over the star schema, in the layout of the record files: what the cleaning operators read. An order is a loan, its lines make its months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica.functions.columns import month_ordinal, yyyymm
from cohortica.operators import book as B
from cohortica.operators.cells import CellSpec, cells
from cohortica.plans.standin import table

#: The thirteen categorical covariates.
CATEGORICAL = ("purpose", "occupancy", "channel", "region", "harp", "delinquency_state", "buyer_type", "property_type", "units", "term_years", "mortgage_insurance", "loan_size", "borrower_count")


def _pick(n: Column, *texts: str) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (n % len(texts) + 1).cast("int"))


def raw_origination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origination records, all text, with sentinels, blanks and codes that have no level."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ltv = (k * 13) % 78
    columns = {
        "loan_identifier": k,
        "classic_fico": F.when(k % 23 == 0, "9999").when(k % 31 == 0, "").otherwise((300 + (c * 7 + k) % 551).cast("string")),
        "original_ltv": F.when(k % 29 == 0, "999").otherwise((20 + ltv).cast("string")),
        "original_cltv": F.when(k % 29 == 0, "999").otherwise((22 + ltv).cast("string")),
        "original_dti": F.when(k % 7 == 0, "999").when(k % 13 == 0, "x").otherwise((5 + (k * 3) % 50).cast("string")),
        "original_upb": F.floor("o_totalprice"),
        "original_interest_rate": F.concat((3 + k % 4).cast("string"), F.lit("."), (k % 10).cast("string")),
        "original_loan_term": F.when(k % 3 == 0, "180").otherwise("360"),
        "mortgage_insurance_percentage": _pick(k, "0", "25", "30", "999", ""),
        "loan_purpose": _pick(k, "P", "C", "N", "R", "9"),
        "occupancy_status": _pick(k, "P", "S", "I", "9"),
        "channel": _pick(k, "R", "B", "C", "T", "9"),
        "harp_indicator": _pick(k, "N", "N", "N", "Y"),
        "first_time_homebuyer_indicator": _pick(k, "N", "Y", "9"),
        "property_type": _pick(k, "SF", "PU", "CO", "MH", "CP", "99"),
        "super_conforming_flag": _pick(k, "N", "Y", ""),
        "number_of_units": _pick(k, "1", "2", "4", "5", "x"),
        "number_of_borrowers": _pick(k, "1", "2", "5", "6", ""),
        "property_state": _pick(k, "CA", "NY", "TX", "OH", "PR", "FL", "WA", "MA"),
    }
    return table(spark, sf_dir, "orders").select(*[v.cast("string").alias(n) for n, v in columns.items()])


def raw_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance records, all text; months before origination have a negative age, as raw files may."""
    li, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    any_ = lambda c: F.bool_or(c)
    m = li.groupBy(F.col("l_orderkey").alias("k"), month_ordinal("l_shipdate").alias("month")).agg(
        F.max("l_quantity").alias("q"),
        any_((F.col("l_returnflag") == "A") & (F.col("l_discount") >= 0.09)).alias("paid"),
        any_((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.1)).alias("loss"),
        any_((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.08)).alias("sold"),
        any_((F.col("l_returnflag") == "N") & (F.col("l_tax") >= 0.08)).alias("modified"),
        any_((F.col("l_linestatus") == "O") & (q < 3)).alias("disaster"),
        any_((F.col("l_linestatus") == "O") & (q == 4)).alias("plan"),
        any_((F.col("l_linestatus") == "F") & (q == 1) & (F.col("l_tax") >= 0.07)).alias("deferral"),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", month_ordinal("o_orderdate").alias("start"))
    j = m.join(o, F.col("k") == F.col("o_orderkey"))
    age = F.col("month") - F.col("start")
    flag = lambda c, text: F.when(F.col(c), text).otherwise("")
    w = F.col("q")
    return j.select(
        F.col("k").cast("string").alias("loan_identifier"),
        yyyymm("month").cast("string").alias("period"),
        age.cast("string").alias("loan_age"),
        F.when(w > 49, "XX").when(w > 47, "RA").when(w > 45, "4").when(w > 43, "3").when(w > 38, "2").when(w > 30, "1").otherwise("0").alias("current_loan_delinquency_status"),
        F.when(F.col("paid"), "01").when(F.col("loss"), "03").when(F.col("sold"), "16").otherwise("").alias("zero_balance_code"),
        flag("modified", "Y").alias("modification_flag"),
        flag("disaster", "Y").alias("delinquency_due_to_disaster"),
        flag("plan", "F").alias("borrower_assistance_plan"),
        flag("deferral", "P").alias("payment_deferral_flag"),
        F.concat((2 + F.col("month") % 4).cast("string"), F.lit(".5")).alias("current_interest_rate"),
        (300 - age).cast("string").alias("remaining_months_to_legal_maturity"),
    )


def record_book(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return B.state_of_the_book(raw_performance(spark, sf_dir), raw_origination(spark, sf_dir), **options)


def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan-months of every level of the thirteen covariates; a code without a level is null."""
    b = record_book(spark, sf_dir, complete_only=False).withColumns({f"level_{n}": B.categorical(n).cast("string") for n in CATEGORICAL})
    pairs = [F.struct(F.lit(n).alias("covariate"), F.col(f"level_{n}").alias("level")) for n in CATEGORICAL]
    return b.select(F.inline(F.array(*pairs))).groupBy("covariate", "level").agg(F.count("*").alias("loan_months"))


def record_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production key's cells from raw records: unmapped codes go, missing bands stay, months count from the record's period and age."""
    spec = CellSpec()
    month = (F.floor(F.col("period") / 100) * 12 + F.col("period") % 100 - 1 - F.col("age")).cast("int")
    b = record_book(spark, sf_dir).withColumns({n: B.categorical(n) for n in spec.categorical} | {"origination_month": month})
    return cells(b, spec)
