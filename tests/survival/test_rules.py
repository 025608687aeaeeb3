"""Rules of the metrics on small tables whose answers are known."""

import math

import pytest
from pyspark.sql import functions as F

from cohortica.functions import columns as K
from cohortica.functions import special
from cohortica.operators import cells as C
from cohortica.operators import macro as X
from cohortica.operators import metrics as Q
from cohortica.operators import model as M
from cohortica.operators import panel as P
from cohortica.operators import selection as L
from cohortica.operators import survival as S
from cohortica.sources import archives, shared

CELLS = "hazard double, outcome string, loan_months long"


def scored(spark, rows):
    """(hazard, defaults, loan-months) as cells."""
    return spark.createDataFrame([(h, o, n) for h, d, w in rows for o, n in (("default", d), ("none", w - d)) if n], CELLS)


def test_gini(spark):
    good = Q.gini(scored(spark, [(0.04, 40, 1000), (0.02, 20, 1000), (0.01, 10, 1000), (0.005, 5, 1000)])).first().gini
    # trapezoids by hand: shares of events 40, 60, 70, 75 of 75 at even steps
    assert good == pytest.approx(2 * (0.25 / 75) * (20 + 50 + 65 + 72.5) - 1, abs=1e-8) and good > 0.3
    assert Q.gini(scored(spark, [(0.005, 40, 1000), (0.01, 20, 1000), (0.02, 10, 1000), (0.04, 5, 1000)])).first().gini < 0
    assert Q.gini(scored(spark, [(h / 100, 20, 1000) for h in range(1, 5)])).first().gini == pytest.approx(0, abs=1e-9)
    assert Q.gini(scored(spark, [(0.01, 0, 1000), (0.02, 0, 1000)])).first().gini is None


def test_buckets_hold_equal_exposure(spark):
    rows = [(k / 10_000, 1) for k in range(1, 1001)]
    b = Q.equal_exposure_buckets(spark.createDataFrame(rows, "hazard double, loan_months long")).groupBy("bucket").agg(F.count("*").alias("n"), F.min("hz").alias("lo")).orderBy("bucket").collect()
    # the running sum includes the row itself, so the first bucket is one short and the last one over
    assert [r.n for r in b] == [99, *[100] * 8, 101] and [r.lo for r in b] == sorted(r.lo for r in b)
    # expected rates are weighted by loan-months: 9 + 9 of 10,000
    one = Q.calibration(scored(spark, [(0.001, 9, 9000), (0.009, 9, 1000)]), 1).first()
    assert one.expected == pytest.approx(18) and one.actual_over_expected == pytest.approx(1)


def test_master_scale(spark):
    pds = [0.0, 0.0005, 0.0005 * 1.001, 0.001, 0.032, 0.0321, 1.0]
    got = [r.g for r in spark.createDataFrame([(i, p) for i, p in enumerate(pds)], "i int, p double").select("i", Q.grade(F.col("p")).alias("g")).orderBy("i").collect()]
    assert got == [1, 1, 2, 2, 7, 8, 8] and all(b == 2 * a for a, b in zip(Q.GRADES, Q.GRADES[1:], strict=False))
    hazards, months = (0.00005, 0.0005, 0.005), 120_000_000
    frame = lambda times: scored(spark, [(h, round(times * (1 - (1 - h) ** 12) * months / 12), months) for h in hazards]).withColumn("pd_12m", K.annualised(F.col("hazard")))
    rows = Q.grade_backtest(frame(1))
    assert [r["passed"] for r in rows] == [True] * 3 and Q.master_scale_passed(rows)
    assert rows[0]["obligor_years"] == months / 12 and [r["predicted_pd"] for r in rows] == sorted(r["predicted_pd"] for r in rows)
    broken = Q.grade_backtest(frame(10))
    assert not any(r["passed"] for r in broken) and not Q.master_scale_passed(broken)
    # one failing grade is allowed, two are not
    assert Q.master_scale_passed([{"passed": False}, {"passed": True}]) and not Q.master_scale_passed([{"passed": False}] * 2)


def test_jeffreys_interval():
    low, high = special.jeffreys_interval(0, 20_000)
    assert low == pytest.approx(2.5e-8, rel=0.05) and high == pytest.approx(1.26e-4, rel=0.01)
    wide, narrow = special.jeffreys_interval(5, 10_000), special.jeffreys_interval(500, 1_000_000)
    assert wide[0] < 5 / 10_000 < wide[1] and wide[1] - wide[0] > narrow[1] - narrow[0]


def test_anchor_reads_its_window_and_refuses_wide_gaps(spark):
    rows = [(0.001, 400 if m < 12 else 200, 100_000, m) for m in range(60)]
    d = spark.createDataFrame([(h, o, n, m) for h, d, w, m in rows for o, n in (("default", d), ("none", w - d))], CELLS + ", month int")
    a = Q.anchor(d, 12, 47).first()
    assert a.multiplier == pytest.approx(2) and a.loan_months == 36 * 100_000
    for wrong in (lambda: Q.anchor(d.withColumn("hazard", F.col("hazard") / 10), 12, 47), lambda: Q.anchor(d, 900, 901), lambda: Q.anchor(d.withColumn("hazard", F.lit(0.0)), 12, 47)):
        with pytest.raises(Exception, match="level is out|no exposure|nothing is expected"):
            wrong().collect()


def test_thin_months_concentration_and_verdicts(spark):
    m = spark.createDataFrame([(k, n) for k, n in enumerate([100, 100, 100, 11, 9])], "month int, loan_months long")
    assert [r.thin for r in Q.covered_months(m).orderBy("month").collect()] == [False, False, False, False, True]
    c = spark.createDataFrame([("a", "x", 870), ("b", None, 130), ("a", None, 8950)], "p string, q string, loan_months long")
    got = {r.covariate: r for r in C.concentration(c, ["p", "q"], "loan_months").collect()}
    assert got["p"].largest == "a" and not got["p"].dominated and got["q"].largest == "x" and got["q"].levels == 1 and got["q"].share == pytest.approx(870 / 9950)
    none = C.concentration(c.withColumn("q", F.lit(None).cast("string")), ["q"], "loan_months").first()
    assert none.largest is None and none.share == 1 and none.dominated and none.levels == 0
    v = spark.createDataFrame([("a", "none", 96), ("b", "default", 4)], "p string, outcome string, loan_months long")
    assert {r.level: r.verdict for r in C.screen_categoricals(v, ["p"], "loan_months").collect()} == {"a": "keep", "b": "merge: below minimum share"}


def test_net_entries_and_crossing(spark):
    r = spark.createDataFrame([(0, 100, 5, 20), (1, 90, 0, 0), (3, 95, 1, 0)], "age int, at_risk long, defaults long, prepayments long")
    # 90 - (100 - 5) is below zero; age 2 has nothing; 95 - 0 arrive at age 3
    assert [tuple(x) for x in S.net_entries(r).collect()] == [(3, 95)]
    assert S.late_entry_share(r).first().warned
    k = [("a", 0, 50, 0.9), ("b", 0, 50, 0.8), ("a", 1, 50, 0.7), ("b", 1, 50, 0.75), ("a", 2, 50, 0.1), ("b", 2, 5, 0.6)]
    d = spark.createDataFrame(k, "g string, age int, at_risk long, survival double")
    one = S.curves_cross(d, "g", 10).first()
    assert one.ages == 2 and one.crosses and not S.curves_cross(d.where("age <> 1"), "g", 10).first().crosses
    # a third stratum that is thin at an age takes it out for all
    assert S.curves_cross(d.unionByName(spark.createDataFrame([("c", 0, 50, 0.9), ("c", 1, 1, 0.1)], d.schema)), "g", 10).where("first_group = 'a' and second_group = 'b'").first().ages == 1


def test_calendar_lies_on_every_month(spark):
    a = spark.createDataFrame([(k, float(k % 5)) for k in range(40) if k % 7], "month int, x double")
    b = a.select((F.col("month") - 2).alias("month"), F.col("x").alias("y"))
    got = X.lag_correlation(a, b, "month", "x", "y")
    assert {r.shift: r.months for r in got.collect()}[0] == 41
    v = X.calendar_verdict(got).first()
    assert v.best_shift == 2 and not v.calendar_is_right


def test_helpers(spark):
    assert K.binned_formula("ltv + ltv_change * dti", ["ltv", "dti"]) == "ltv_binned + ltv_change * dti_binned" and K.binned_formula("a + b", []) == "a + b"
    v, w = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "id string, x double"), spark.createDataFrame([("b", 3), ("a", 1), ("z", 9)], "id string, w int")
    assert P.weighted_mean_by_id(v, w, "id", "x", "w").first().mean == 2.5
    with pytest.raises(Exception, match="do not cover"):
        P.weighted_mean_by_id(v, w.where("id = 'a'"), "id", "x", "w").collect()
    shape = {r.covariate: r.levels for r in C.cell_shape(spark.createDataFrame([(0, "b"), (12, "a"), (36, "a")], "age int, p string"), ["p"]).collect()}
    assert shape == {"p": "a|b", "age": "12"}


def test_a_rewritten_table_has_another_identity(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.range(5).write.parquet(path)
    first = archives.table_identity(spark, path)
    assert first == archives.table_identity(spark, path)
    spark.range(5, 10).write.mode("overwrite").parquet(path)
    assert first != archives.table_identity(spark, path)
    assert math.isfinite(shared.written(spark.range(3), "t").count()) and shared.session("x").version == spark.version


def test_series_are_kept_and_fits_start_warm(spark, tmp_path):
    calls = []
    fetch = lambda: calls.append(1) or spark.createDataFrame([(k, float(k)) for k in range(10, 30)], "month int, value double")
    for _ in range(2):
        s = archives.cached_series(spark, str(tmp_path), "rate", fetch, 12, 20)
        assert s.agg(F.min("month"), F.max("month"), F.count("*")).first()[:] == (12, 20, 9)
    assert len(calls) == 1
    with pytest.raises(ValueError, match="begins in month 10"):
        archives.cached_series(spark, str(tmp_path), "rate", fetch, 5)
    d = spark.createDataFrame([(float(x), a, "default" if (x + a) % 9 == 0 else "none", 50) for x in range(6) for a in range(20)], "x double, age int, outcome string, loan_months long")
    cold = M.fit_aft(d, ["x"])
    fits, starts = str(tmp_path / "fits"), []
    for table in ("one", "two"):
        warm = archives.fit_once(spark, fits, {"table": table, "covariates": ["x"], "family": "weibull"}, lambda start: starts.append(start) or M.fit_aft(d, ["x"], start=start), warm=True)
    assert starts[0] is None and starts[1]["x"] == pytest.approx(cold.params[1], abs=1e-3)
    assert warm.rounds < cold.rounds and warm.params == pytest.approx(cold.params, abs=1e-2)
    assert [r["table"] for r in archives.find_fits(spark, fits, family="weibull")] and not archives.find_fits(spark, fits, family="other")


def test_views_have_a_manifest(spark, tmp_path):
    archives.write_views({"b": spark.range(3).toDF("x"), "a": spark.range(2).toDF("y")}, str(tmp_path), {"a": {"about": "two"}})
    m = archives.read_manifest(spark, str(tmp_path))
    assert [e["view"] for e in m] == ["a", "b"] and m[0]["about"] == "two" and m[0]["columns"] == ["y"]


def made_up(names, params, p):
    """A fit with given coefficients and p-values (by their z)."""
    import numpy as np

    z = [abs(special.normal_ppf(x / 2)) for x in p]
    errors = [abs(b) / max(x, 1e-9) if b else 1.0 for b, x in zip(params, z, strict=True)]
    return M.Fit("weibull", ["intercept", *names, "log_shape"], np.array([4.0, *params, 0.2]), np.diag([0.01, *(e * e for e in errors), 0.01]), -10.0, 1, 5, 100)


def test_selection_rules():
    f = made_up(["a", "b", "c"], [0.5, -0.2, 0.1], [1e-9, 1e-3, 0.5])
    assert L.worst(f, {}, {"b": 1}) == ("b", "sign against its prior")
    assert L.worst(f, {"a": -1.0, "c": 0.3}, {}) == ("a", "sign turned from the one alone")
    assert L.worst(f, {}, {}) == ("c", "not significant") and L.worst(f, {}, {}, skip=["c"]) is None
    g = made_up(["a", "b", "c"], [0.5, 0.2, 0.1], [1e-9, 1e-3, 0.5])
    t = L.stability_table(f, {"x": g}, {"a": 1.0, "b": 1.0, "c": 2.0}, {"a": "one", "b": "one"})
    assert [r["stable"] for r in t] == [True, False, True] and L.not_identified(t) == ("b", "a")
    assert L.not_identified(t, ["b"]) is None and L.not_identified(L.stability_table(f, {"x": g}, {"a": 1.0, "b": 1.0, "c": 2.0}, {})) is None
    assert L.immaterial(f, {"a": 1.0, "b": 0.05, "c": 0.1}, ["b", "c"]) == ("b", pytest.approx(-0.01)) and L.immaterial(f, {"a": 0.001, "b": 1.0, "c": 1.0}, ["b", "c"]) is None
    assert L.screened("a", f, made_up([], [], []), 2.0, -1)["sign_agrees"] is False


def test_selection_keeps_what_matters(spark):
    import numpy as np

    rng, rows = np.random.default_rng(3), []
    for x in range(-2, 3):
        for z in range(-2, 3):
            for y in (1998 * 12, 1999 * 12):
                for a in range(24):
                    h = -math.expm1(-(((a + 1) / math.exp(4 + 0.4 * x)) ** 1.3 - (a / math.exp(4 + 0.4 * x)) ** 1.3))
                    bad = int(rng.binomial(400, h))
                    rows += [(float(x), float(z), float(x) + 0.01 * float(rng.normal()), a, y, o, n) for o, n in (("default", bad), ("none", 400 - bad)) if n]
    d = spark.createDataFrame(rows, "x double, z double, twin double, age int, origination_month int, outcome string, loan_months long")
    r = L.run_selection(d, ["x"], ["z", "twin"], splits=L.origination_halves())
    assert r.covariates == ["x"] and r.collinear[0][:2] == ("x", "twin") and set(r.eliminated) == {"z", "twin"}
    assert r.fit.params[1] == pytest.approx(0.4, abs=0.05) and [s["stable"] for s in r.stability] == [True]
