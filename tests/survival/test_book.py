"""Truncation and outcomes on hand-made records."""

import pytest
from pyspark.sql import functions as F

from cohortica.operators import book as B
from cohortica.operators import cells as C

PERF = ["loan_identifier", "period", "loan_age", "current_loan_delinquency_status", "zero_balance_code", "modification_flag", "delinquency_due_to_disaster", "borrower_assistance_plan", "payment_deferral_flag", "current_interest_rate", "remaining_months_to_legal_maturity", "estimated_loan_to_value"]
ORIG = {"loan_identifier": "A", "classic_fico": "740", "original_ltv": "78", "original_cltv": "78", "original_dti": "32", "original_upb": "210000", "original_interest_rate": "4.25", "original_loan_term": "360", "mortgage_insurance_percentage": "0", "loan_purpose": "P", "occupancy_status": "P", "channel": "R", "property_state": "CA", "first_time_homebuyer_indicator": "N", "harp_indicator": "N", "super_conforming_flag": "N", "property_type": "SF", "number_of_units": "1", "number_of_borrowers": "2"}


def run(spark, months, orig=None, **options):
    rows = [{**dict.fromkeys(PERF), "loan_identifier": "A", "current_loan_delinquency_status": "0", **m} for m in months]
    perf = spark.createDataFrame([[r[c] for c in PERF] for r in rows], ",".join(f"{c} string" for c in PERF))
    loans = [{**ORIG, **o} for o in (orig or [{}])]
    o = spark.createDataFrame([[r[c] for c in ORIG] for r in loans], ",".join(f"{c} string" for c in ORIG))
    return B.state_of_the_book(perf, o, **options)


def months(n, start=201501, **at):
    return [{"period": str(start + k), "loan_age": str(k), **at.get(f"m{k}", {})} for k in range(n)]


def outcomes(df, *more):
    return [tuple(r) for r in df.orderBy("period").select("age", "outcome", *more).collect()]


def test_default_cuts_at_first_terminating_month(spark):
    got = outcomes(run(spark, months(6, m2={"current_loan_delinquency_status": "3"}, m3={"current_loan_delinquency_status": "4"}, m5={"zero_balance_code": "09"})))
    assert got == [(0, "none"), (1, "none"), (2, "default")]


@pytest.mark.parametrize(("last", "outcome"), [({"current_loan_delinquency_status": "RA", "zero_balance_code": "09"}, "default"), ({"zero_balance_code": "01"}, "prepayment"), ({"zero_balance_code": "16"}, "none"), ({"zero_balance_code": "96"}, "none"), ({"zero_balance_code": ""}, "none"), ({"current_loan_delinquency_status": "3", "zero_balance_code": "01"}, "default")])
def test_outcome_of_the_last_month(spark, last, outcome):
    assert outcomes(run(spark, months(3, m2=last)))[-1] == (2, outcome)


def test_modification_ends_observation_before_it_by_calendar(spark):
    m = months(4) + [{"period": "201505", "loan_age": "0", "modification_flag": "Y", "current_interest_rate": "2.0", "remaining_months_to_legal_maturity": "480"}, {"period": "201506", "loan_age": "1", "modification_flag": "P"}]
    assert outcomes(run(spark, m)) == [(k, "none") for k in range(4)]
    assert outcomes(run(spark, m, definition=B.Definition.CRR))[-1] == (3, "default")
    m[4]["current_interest_rate"] = "4.25"
    assert outcomes(run(spark, m, definition=B.Definition.CRR))[-1] == (3, "none")


def test_moratorium_policies(spark):
    m = months(4, m2={"current_loan_delinquency_status": "3", "borrower_assistance_plan": "F"})
    assert [o for _, o in outcomes(run(spark, m))] == ["none"] * 4
    assert outcomes(run(spark, m, policy=B.Moratorium.CENSOR)) == [(0, "none"), (1, "none")]
    assert outcomes(run(spark, m, policy=B.Moratorium.IGNORE))[-1] == (2, "default")


def test_missing_values_and_ages(spark):
    assert run(spark, months(2), [{"classic_fico": "9999"}]).count() == 0
    assert run(spark, months(2), [{"original_dti": "999"}]).count() == 0
    assert run(spark, months(2), [{"original_dti": "999", "harp_indicator": "Y"}]).count() == 2
    assert run(spark, [{"period": "201501", "loan_age": "-1"}, {"period": "201502", "loan_age": "0"}]).count() == 1
    assert run(spark, months(1), [{"property_state": "PR"}]).first().region == "Other"


def test_payment_state_is_the_month_before(spark):
    d = run(spark, months(4, m1={"current_loan_delinquency_status": "1"}, m2={"current_loan_delinquency_status": "RA"}))
    got = [r.s for r in d.withColumn("s", B.categorical("delinquency_state")).orderBy("period").collect()]
    assert got == ["current", "current", "one_month", None]


def test_cells_are_lossless_and_drop_unmapped_codes(spark):
    two = run(spark, months(3) + [{**m, "loan_identifier": "B"} for m in months(3)], [{}, {"loan_identifier": "B"}])
    b = two.withColumns({c: B.categorical(c) for c in C.CellSpec().categorical} | {"origination_month": F.lit(1)})
    c = C.cells(b, C.CellSpec())
    assert c.count() == 3 and {r.loan_months for r in c.collect()} == {2}
    assert C.cells(b.withColumn("purpose", F.lit(None).cast("string")), C.CellSpec()).count() == 0
    harp = C.cells(b.withColumn("debt_to_income", F.lit(None).cast("double")), C.CellSpec())
    assert harp.where("debt_to_income is null").count() == 3
    with pytest.raises(ValueError):
        C.CellSpec(continuous={"x": (3.0, 2.0, 1.0)}).validate()
