"""Curves, metrics, fits: identities, recovery, and the queries against their SQL."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cohortica.functions import columns as K
from cohortica.functions import special
from cohortica.operators import macro as X
from cohortica.operators import metrics as Q
from cohortica.operators import model as M
from cohortica.operators import survival as S
from cohortica.operators.cells import CellSpec
from cohortica.plans import backtest, catalogue, oracle
from cohortica.sources import archives
from cohortica.streaming import cells as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def test_special_functions():
    assert abs(special.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(special.beta_cdf(0.3, 2, 5) - 0.579825) < 1e-6
    assert abs(special.beta_ppf(special.beta_cdf(0.2, 3.5, 9), 3.5, 9) - 0.2) < 1e-10
    assert 0 < special.jeffreys_interval(0, 10_000)[0] < 1e-6 and special.jeffreys_interval(100, 100)[1] < 1


def test_classing_is_right_closed_and_labels_left_closed(spark):
    d = spark.createDataFrame([(None,), (0.0,), (10.0,), (10.5,), (99.0,)], "x double")
    got = d.select(K.midpoint("x", [0, 10, 20]).alias("m"), K.band_label("x", [0, 10, 20], "none").alias("l"), K.band_index("x", [0, 10, 20]).alias("i")).collect()
    assert [r.m for r in got] == [None, 5, 5, 15, 15]
    assert [r.l for r in got] == ["none", "under 10", "10 and over", "10 and over", "10 and over"]
    assert [r.i for r in got] == [-1, 0, 0, 1, 1]


def test_survival_and_incidences_add_up(spark):
    rows = [(a, o, n) for a in range(20) for o, n in (("none", 100 - 4 * a), ("default", a % 3), ("prepayment", 2))]
    r = S.risk_sets(spark.createDataFrame(rows, "age int, outcome string, loan_months long"))
    for x in S.incidence(r).collect():
        assert abs(x.survival + x.incidence_default + x.incidence_prepayment - 1) < 1e-8
    end = spark.createDataFrame([(0, 10, 5, 0), (1, 5, 5, 0), (2, 1, 0, 0)], "age int, at_risk long, defaults long, prepayments long")
    assert [x.survival for x in S.kaplan_meier(end).orderBy("age").collect()] == [0.5, 0.0, 0.0]


def test_panel_faults_are_counted(spark):
    p = spark.createDataFrame([("a", 0, False), ("a", 2, True), ("a", 3, True), ("b", -1, False), ("b", -1, False)], "loan string, age int, event boolean")
    r = S.validate_panel(p).first()
    assert (r.repeated, r.gaps, r.negative, r.second_events, r.after_event) == (1, 1, 2, 1, 1)


def test_gini_does_not_depend_on_order_of_ties(spark):
    rows = [(0.1, "default", 2), (0.1, "none", 8), (0.2, "default", 5), (0.2, "none", 5), (0.05, "none", 20)]
    a = Q.gini(spark.createDataFrame(rows, "hazard double, outcome string, loan_months long")).first().gini
    b = Q.gini(spark.createDataFrame(rows[::-1], "hazard double, outcome string, loan_months long")).first().gini
    assert a == b and 0 < a < 1


def test_grade_without_defaults_is_judged_on_the_interval(spark):
    d = spark.createDataFrame([(0.00001, "none", 100, 0.0001)], "hazard double, outcome string, loan_months long, pd_12m double")
    (r,) = Q.grade_backtest(d)
    assert r["passed"] and 0 < r["low"] < 0.0001 and r["judged_on"] == "interval"


def test_gradient_is_the_slope_of_the_value():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(50), rng.normal(size=50)])
    age, event, w, theta = rng.integers(0, 60, 50).astype(float), rng.random(50) < 0.3, rng.integers(1, 5, 50).astype(float), np.array([4.0, 0.2, 0.3])
    for family in ("weibull", "log_logistic"):
        s = M.sums(family, x, age, event, w, theta)
        for i in range(3):
            e = np.zeros(3)
            e[i] = 1e-5
            up, down = M.sums(family, x, age, event, w, theta + e), M.sums(family, x, age, event, w, theta - e)
            assert abs((up[0] - down[0]) / 2e-5 - s[1 + i]) < 1e-4 * max(1, abs(s[1 + i]))
            assert np.allclose((up[1:4] - down[1:4]) / 2e-5, s[4:].reshape(3, 3)[i], rtol=1e-3, atol=1e-3)


def simulated(spark, loans=3000):
    rng = np.random.default_rng(17)
    x = rng.normal(size=loans)
    rows = []
    for v in np.round(x, 1):
        rho, scale = math.exp(0.26), math.exp(4.0 + 0.5 * v)
        for a in range(60):
            h = -math.expm1(-(((a + 1) / scale) ** rho - (a / scale) ** rho))
            bad = rng.random() < h
            rows.append((float(v), a, "default" if bad else "none"))
            if bad:
                break
    d = spark.createDataFrame(rows, "x double, age int, outcome string")
    return d.groupBy("x", "age", "outcome").agg(F.count("*").alias("loan_months")).withColumn("month", F.col("age") + 100).persist()


def test_parameters_are_recovered_and_scored(spark):
    d = simulated(spark)
    fit = M.fit_aft(d, ["x"])
    se = np.sqrt(np.diag(fit.covariance))
    assert (np.abs(fit.params - [4.0, 0.5, 0.26]) < 3 * se).all()
    anchor = Q.anchor(backtest.score(d, fit)).first()
    assert abs(anchor.multiplier - 1) < 0.02
    r = backtest.backtest(d, ["x"], cut=130, months=30, anchor_months=12)
    assert 0.7 < r.actual_over_expected < 1.4
    effects = {e.shock: e.ratio for e in backtest.marginal_effects(d, fit, {"x": 1.0}).collect()}
    assert effects["x"] < 1
    families = backtest.compare_families(d, ["x"])
    assert families[0]["family"] == "weibull"
    paths = backtest.project(d.where("age = 0").select("x", "age").distinct(), fit, 12, ["x"])
    assert backtest.conditional_pd(paths, ["x"], 12).count() == d.select("x").where("age = 0").distinct().count()
    with pytest.raises(ValueError):
        M.fit_aft(d.where("outcome = 'none'"), ["x"])


def test_age_basis_is_orthonormal():
    b = M.age_basis()
    assert b.shape == (400, 3) and np.allclose(b.T @ b, np.eye(3), atol=1e-9)


def test_stepwise_vif_keeps_what_is_protected():
    r = np.array([[1, 0.99, 0.1], [0.99, 1, 0.1], [0.1, 0.1, 1]])
    assert M.stepwise_vif(["a", "b", "c"], r, protected=["a"])[0] == ["a", "c"]


def test_lag_is_a_key_shift(spark):
    m = spark.createDataFrame([(k, float(k)) for k in range(40)], "month int, x double")
    c = spark.createDataFrame([(20, 18)], "month int, origination_month int")
    r = X.add_family(c, m, ["x"]).first()
    assert (r.obs_x, r.orig_x, r.obs12_x, r.orig12_x) == (17, 15, 5, 3)


def test_archives_round_trip(spark, tmp_path):
    import io
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("orig_2001Q1.txt", "a|1|\nb|2|y\n")
        z.writestr("perf_2001Q1.txt", "a|9|\n")
    with zipfile.ZipFile(tmp_path / "historical_data_2001.zip", "w") as z:
        z.writestr("historical_data_2001Q1.zip", inner.getvalue())
    d = archives.read_archives(spark, str(tmp_path / "*.zip"), ["id", "n", "flag"], "orig", ["id", "flag"])
    assert sorted(map(tuple, d.collect()), key=str) == [("a", None, "2001Q1"), ("b", "y", "2001Q1")]
    archives.ingest(d, str(tmp_path / "out"))
    archives.ingest(d, str(tmp_path / "out"))
    got = archives.manifest(spark, str(tmp_path / "out"))
    assert got.first().rows == 2 and archives.audit(got, got).first().safe_to_delete
    assert archives.discover_years(["historical_data_2001.zip", "x_1999.zip"]) == [1999, 2001]


def test_cells_sink_prunes_and_views_refuse_loans(spark, tmp_path):
    c = catalogue.QUERIES["cells"](spark, SF)
    archives.write_cells(c, str(tmp_path / "cells"))
    last = c.agg(F.max(F.col("origination_month") + F.col("age"))).first()[0]
    window = archives.read_cells(spark, str(tmp_path / "cells"), last - 5, last)
    assert window.count() == c.where(F.col("origination_month") + F.col("age") >= last - 5).count()
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(observation_month)" in plan and "PartitionFilters: [" in plan
    with pytest.raises(ValueError):
        archives.write_view(c.withColumnRenamed("price", "loan"), str(tmp_path / "v"), {})
    archives.write_view(c.groupBy("segment").count(), str(tmp_path / "v"), {"name": "x"})
    assert archives.read_view(spark, str(tmp_path / "v"))[1]["name"] == "x"
    fit = M.fit_aft(c, [])
    calls = []
    for _ in range(2):
        archives.fit_once(spark, str(tmp_path / "fits"), {"a": 1}, lambda: calls.append(1) or fit)
    assert len(calls) == 1


def test_streamed_cells_equal_batch_cells(spark, tmp_path):
    spec = CellSpec({}, ("segment",))
    b = spark.createDataFrame([("a", 0, 1, "none"), ("a", 0, 1, "none"), ("b", 1, 1, "default")], "segment string, age int, origination_month int, outcome string")
    b.write.parquet(str(tmp_path / "in"))
    q = stream.running_cells(spark.readStream.schema(b.schema).parquet(str(tmp_path / "in")), spec).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.loan_months for r in spark.table("running").collect()) == [1, 2]


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["book_policy_censor", "book_crr_restructuring", "incomplete_cases", "book_by_segment_grouping_sets", "macro_yoy_gap", "aalen_johansen_se", "calibration_deciles", "psi_numeric"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a = catalogue.QUERIES[name](spark, SF).toPandas()
    b = con.execute(oracle.SQL[name]).df()
    c = sorted(a.columns)
    assert c == sorted(b.columns)
    text = lambda d: sorted(str([None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) else str(v) for v in r]) for r in d[c].astype(object).itertuples(index=False))
    assert text(a) == text(b)
