"""The state of the book: raw origination and performance records to cleaned, truncated loan-months.

All per-loan facts come from window aggregates over one partitioning by loan, so the performance records are shuffled once, and origination joins on
the same key. Truncation is by calendar month: a modification restarts a loan's age.
"""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortica.functions.columns import diminished_obligation, flag, mapped, to_double, to_int, without_sentinel

DEFAULT, PREPAYMENT, NONE = "default", "prepayment", "none"
#: Fixed values of the public record layout.
DEFAULT_MONTHS = 3
LOSS_CODES, PAYOFF_CODES, EXIT_CODES, MODIFIED = ("02", "03", "09", "15"), ("01",), ("16", "96"), ("Y", "P")
NPV_THRESHOLD = 0.01
REGIONS = {
    "Northeast": ("CT", "ME", "MA", "NH", "NJ", "NY", "PA", "RI", "VT"),
    "Midwest": ("IL", "IN", "IA", "KS", "MI", "MN", "MO", "NE", "ND", "OH", "SD", "WI"),
    "South": ("AL", "AR", "DE", "DC", "FL", "GA", "KY", "LA", "MD", "MS", "NC", "OK", "SC", "TN", "TX", "VA", "WV"),
    "West": ("AK", "AZ", "CA", "CO", "HI", "ID", "MT", "NV", "NM", "OR", "UT", "WA", "WY"),
}
LEVELS = {
    "purpose": ("loan_purpose", {"P": "purchase", "C": "cash_out_refinance", "N": "rate_term_refinance", "R": "rate_term_refinance"}),
    "occupancy": ("occupancy_status", {"P": "owner_occupied", "S": "second_home", "I": "investment_property"}),
    "channel": ("channel", {"R": "retail", "B": "broker_or_correspondent", "C": "broker_or_correspondent", "T": "broker_or_correspondent"}),
    "harp": ("harp_indicator", {"Y": "harp", "N": "standard"}),
    "buyer_type": ("first_time_homebuyer_indicator", {"Y": "first_time", "N": "repeat"}),
    "property_type": ("property_type", {"SF": "single_family", "PU": "planned_unit_development", "CO": "condominium", "MH": "manufactured_or_coop", "CP": "manufactured_or_coop"}),
    "loan_size": ("super_conforming_flag", {"Y": "super_conforming", "N": "conforming"}),
}


class Moratorium(StrEnum):
    EXCLUDE = "exclude"  # a delinquency in a moratorium month is no default
    CENSOR = "censor"  # a moratorium month ends observation before it
    IGNORE = "ignore"


class Definition(StrEnum):
    DELINQUENCY = "delinquency"
    CRR = "crr"  # a restructuring that gives up value is a default too


def region(state: Column) -> Column:
    return F.coalesce(mapped(state, {s: r for r, states in REGIONS.items() for s in states}), F.lit("Other"))


def categorical(name: str) -> Column:
    """A categorical covariate of the book; codes without a level are null."""
    if name in LEVELS:
        code, levels = LEVELS[name]
        return mapped(code, levels)
    n = to_int("previous_status")
    return {
        "region": lambda: F.col("region"),
        "delinquency_state": lambda: F.when(F.col("previous_status").isNull() | (n == 0), "current").when(n == 1, "one_month").when(n == 2, "two_months").when(n >= DEFAULT_MONTHS, "three_or_more"),
        "units": lambda: F.when(to_int("number_of_units") == 1, "one_unit").when(to_int("number_of_units").between(2, 4), "two_to_four_units"),
        "term_years": lambda: F.when(F.col("orig_term") <= 190, 15).when(F.col("orig_term") > 190, 30),
        "mortgage_insurance": lambda: F.when(F.col("insurance_coverage") > 0, "insured").when(F.col("insurance_coverage") == 0, "uninsured"),
        "borrower_count": lambda: F.when(to_int("number_of_borrowers") == 1, "one").when(to_int("number_of_borrowers").between(2, 5), "two_or_more"),
    }[name]()


def truncate(months: DataFrame, loan: str = "loan", period: str = "period", crr: bool = False) -> DataFrame:
    """Cut each loan at its end and name the outcome of each month kept.

    Wants boolean defaulted, prepaid, left, ends. The first defaulted, prepaid or left month is kept; the first ends month and all after go.
    crr: also wants modified, rate, remaining, note_rate; the last month kept before a restructuring that gives up value is a default.
    """
    by = Window.partitionBy(loan)
    first = lambda c: F.min(F.when(c, F.col(period))).over(by)
    m = months.withColumns({"terminal": first(F.col("defaulted") | F.col("prepaid") | F.col("left")), "ended": first(F.col("ends"))})
    if crr:
        mod = F.col("modified")
        m = m.withColumns({"modified_at": first(mod), "default_at": first(F.col("defaulted")), **{f"modified_{c}": F.min_by(F.when(mod, F.col(c)), F.when(mod & F.col(c).isNotNull(), F.col(period))).over(by) for c in ("rate", "remaining")}})
    m = m.where((F.col("terminal").isNull() | (F.col(period) <= F.col("terminal"))) & (F.col("ended").isNull() | (F.col(period) < F.col("ended"))))
    here = F.col(period) == F.col("terminal")
    restructured = F.lit(False)
    if crr:
        last = F.max(period).over(by)
        m = m.withColumn("last_kept", last)
        cut_here = (F.col(period) == F.col("last_kept")) & (F.col("modified_at") == F.col("ended")) & (F.col("terminal").isNull() | (F.col("terminal") >= F.col("modified_at")))
        fall = diminished_obligation(F.col("note_rate"), F.col("modified_rate"), F.col("modified_remaining"))
        restructured = flag(cut_here & (flag(fall > NPV_THRESHOLD) | flag(F.col("default_at") == F.col("modified_at"))))
    outcome = F.when(flag(F.col("defaulted") & here), DEFAULT).when(restructured, DEFAULT).when(flag(F.col("prepaid") & here), PREPAYMENT).otherwise(NONE)
    helpers = ["terminal", "ended", "modified_at", "default_at", "modified_rate", "modified_remaining", "last_kept"]
    return m.withColumn("outcome", outcome).withColumn("left_the_book", flag(F.col("left") & here)).drop(*helpers)


def performance(raw: DataFrame, policy: Moratorium = Moratorium.EXCLUDE) -> DataFrame:
    """Typed loan-months of raw performance records (all text); rows without an age of 0 or more go before anything else."""
    relief = flag(F.col("delinquency_due_to_disaster") == "Y") | flag(F.col("borrower_assistance_plan") == "F") | flag(F.col("payment_deferral_flag").isin("P", "C"))
    never = F.lit(False)
    bad = flag(to_int("current_loan_delinquency_status") >= DEFAULT_MONTHS) | flag(F.col("zero_balance_code").isin(*LOSS_CODES))
    modified = flag(F.col("modification_flag").isin(*MODIFIED))
    d = raw.where(to_int("loan_age") >= 0)
    d = d.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("zero_balance_code", "modification_flag", "delinquency_due_to_disaster", "borrower_assistance_plan", "payment_deferral_flag", "current_loan_delinquency_status") if c in raw.columns})
    return d.select(
        F.col("loan_identifier").alias("loan"),
        to_int("loan_age").alias("age"),
        to_int("period").alias("period"),
        # the month before, as written: RA is a state of its own
        F.lag("current_loan_delinquency_status").over(Window.partitionBy("loan_identifier").orderBy(to_int("period"))).alias("previous_status"),
        without_sentinel(to_double("estimated_loan_to_value"), 999).alias("eltv") if "estimated_loan_to_value" in raw.columns else F.lit(None).cast("double").alias("eltv"),
        (bad & ~(relief if policy is Moratorium.EXCLUDE else never)).alias("defaulted"),
        flag(F.col("zero_balance_code").isin(*PAYOFF_CODES)).alias("prepaid"),
        flag(F.col("zero_balance_code").isin(*EXIT_CODES)).alias("left"),
        (modified | (relief if policy is Moratorium.CENSOR else never)).alias("ends"),
        modified.alias("modified"),
        to_double("current_interest_rate").alias("rate"),
        to_int("remaining_months_to_legal_maturity").alias("remaining"),
        "zero_balance_code",
    )


def origination(raw: DataFrame) -> DataFrame:
    """Typed loans of raw origination records (all text), sentinels null, codes as written."""
    codes = [c for c, _ in LEVELS.values()] + ["number_of_units", "number_of_borrowers"]
    return raw.select(
        F.col("loan_identifier").alias("loan"),
        without_sentinel(to_double("classic_fico"), 9999).alias("credit_score"),
        without_sentinel(to_double("original_ltv"), 999).alias("original_ltv"),
        without_sentinel(to_double("original_cltv"), 999).alias("original_cltv"),
        without_sentinel(to_double("original_dti"), 999).alias("debt_to_income"),
        to_double("original_upb").alias("original_balance"),
        to_double("original_interest_rate").alias("note_rate"),
        to_int("original_loan_term").alias("orig_term"),
        without_sentinel(to_double("mortgage_insurance_percentage"), 999).alias("insurance_coverage"),
        *[c for c in codes if c in raw.columns],
        region(F.col("property_state")).alias("region"),
    )


def state_of_the_book(perf: DataFrame, orig: DataFrame, policy: Moratorium = Moratorium.EXCLUDE, definition: Definition = Definition.DELINQUENCY, complete_only: bool = True, harp_level: bool = True) -> DataFrame:
    """Cleaned, truncated loan-months with their loan's covariates."""
    o = origination(orig)
    if complete_only:
        ratio = F.col("debt_to_income").isNotNull() | (flag(F.col("harp_indicator") == "Y") if harp_level else F.lit(False))
        o = o.where(F.col("credit_score").isNotNull() & F.col("original_ltv").isNotNull() & ratio)
    months = performance(perf, policy)
    if definition is Definition.CRR:
        return truncate(months.join(o, "loan"), crr=True)
    return truncate(months).join(o, "loan")
