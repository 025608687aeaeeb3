"""Views, panel helpers and the command line on the stand-in book."""

import math

import pytest
from pyspark.sql import functions as F

from cohortica import cli
from cohortica.functions.columns import annualised, band_label
from cohortica.operators import metrics as Q
from cohortica.operators import panel as P
from cohortica.plans import catalogue, standin, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    s = standin.scored(spark, SF).withColumn("pd_12m", annualised(F.col("hazard")))
    return s.withColumn("grade", Q.grade(F.col("pd_12m"))).persist()


def test_segments_add_up_to_the_book(scored):
    v = views.backtest_views(scored, {"segment": F.col("segment"), "priority": F.col("priority")})["by_grade"]
    n = {r.segment: r.n for r in v.groupBy("segment").agg(F.sum("loan_months").alias("n")).collect()}
    assert n["all"] == n["segment"] == n["priority"]


def test_calibration_views_are_consistent(scored):
    v = views.calibration_views(scored, {"segment": F.col("segment")})
    total = v["calibration_by_decile"].groupBy("segment", "group").agg(F.sum("actual").alias("a")).where("segment = 'all'").first().a
    assert total == scored.agg(F.sum(Q.hits())).first()[0]
    assert v["survival_observed"].where("survival < 0 or survival > 1").count() == 0
    assert v["survival_predicted"].where("segment = 'all'").count() == scored.select("age").distinct().count()


def test_cube_rollup_and_competing(scored, spark):
    c = views.window_criteria(scored, band_label("age", standin.AGE_EDGES))
    whole = c.where("level = 3").first()
    assert whole.loan_months == c.where("level = 0").agg(F.sum("loan_months")).first()[0]
    assert views.scored_book(scored).where("grade = 'all'").first().loan_months == whole.loan_months
    assert views.competing_views(scored).count() == scored.select("age").distinct().count()
    assert views.covariates_over_time(scored, ["price"]).count() > 0
    assert views.anchoring_view(scored, {"w": (0, 10**6)}).first().actual == whole.actual


def test_as_of_takes_the_latest_before(spark):
    a = spark.createDataFrame([(1,), (5,), (9,)], "t int")
    b = spark.createDataFrame([(2, "x"), (5, "y"), (20, "z")], "t int, v string")
    assert [(r.t, r.v) for r in P.as_of(a, b, "t", ["v"]).orderBy("t").collect()] == [(1, None), (5, "y"), (9, "y")]


def test_turnbull_on_a_grid_is_the_product_limit():
    rows = [(0, 1, 2.0), (1, 2, 3.0), (2, math.inf, 5.0)]
    got = dict(P.turnbull(rows))
    assert abs(got[1] - 0.8) < 1e-9 and abs(got[2] - 0.5) < 1e-9


def test_families_are_ranked_by_aic(spark):
    r = catalogue.QUERIES["marginal_families"](spark, SF).collect()
    assert [x.aic for x in r] == sorted(x.aic for x in r) and len(r) == 4


def test_age_basis_lookup(spark):
    d = P.with_age_basis(spark.createDataFrame([(0,), (399,), (400,)], "age int")).orderBy("age").collect()
    assert d[0].age_basis_1 is not None and d[2].age_basis_1 is None


def test_command_line(spark, tmp_path, capsys):
    standin.cell_table(spark, SF).write.parquet(str(tmp_path / "cells"))
    common = ["--input", str(tmp_path / "cells"), "--fits", str(tmp_path / "fits"), "--covariates", "acctbal"]
    assert cli.main(["fit", *common], spark).count() == 3
    assert cli.main(["score", *common], spark).count() >= 1
    assert cli.main(["check-calendar", *common], spark).count() == 13
    assert cli.main(["profile", "--input", str(tmp_path / "cells"), "--covariates", "segment"], spark).count() == 5
    assert "segment" in capsys.readouterr().out


def test_macro_as_of_reads_every_month(spark, monkeypatch):
    from cohortica.operators import panel
    from cohortica.plans import catalogue, standin

    d, seen, whole = "/root/testdata/sf0.001", [], panel.as_of
    monkeypatch.setattr(panel, "as_of", lambda left, right, *a: seen.append((left, right)) or whole(left, right, *a))
    got = sorted(map(tuple, catalogue.macro_as_of(spark, d).collect()), key=str)
    left, right = seen[0]
    assert right.count() == standin.macro(spark, d).count()
    # months without a value are passed over as if they were not there
    few = whole(left, right.where("price_index is not null"), "month", ["price_index"]).selectExpr("month", "loan_months", "round(price_index, 6)")
    assert got == sorted(map(tuple, few.collect()), key=str)
