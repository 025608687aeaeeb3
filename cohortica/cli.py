"""Command line: python -m cohortica.cli COMMAND. Each command reads and writes Parquet folders and prints a short table."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica.operators import book as B
from cohortica.operators import cells as C
from cohortica.operators import macro as X
from cohortica.operators import metrics as Q
from cohortica.operators import panel as P
from cohortica.operators import survival as S
from cohortica.operators.model import backward_selection
from cohortica.plans import backtest
from cohortica.plans import views as V
from cohortica.sources import archives, shared


def _cells(spark: SparkSession, args) -> DataFrame:
    c = spark.read.parquet(args.input)
    return c.withColumn("month", F.col("origination_month") + F.col("age"))


def ingest(spark, args):
    columns, keep = args.columns.split(","), (args.keep or args.columns).split(",")
    archives.ingest(archives.read_archives(spark, args.input, columns, args.kind, keep), args.output)
    return archives.manifest(spark, args.output)


def audit(spark, args):
    return archives.audit(archives.manifest(spark, args.input), spark.read.parquet(args.expected))


def aggregate(spark, args):
    b = B.state_of_the_book(spark.read.parquet(args.input), spark.read.parquet(args.origination), B.Moratorium(args.policy), B.Definition(args.definition))
    spec = C.CellSpec().extended("harp", "delinquency_state")
    month = (F.floor(F.col("period") / 100) * 12 + F.col("period") % 100 - 1 - F.col("age")).cast("int")
    b = b.withColumns({n: B.categorical(n) for n in spec.categorical} | {"origination_month": month, "vintage": F.floor(month / 12).cast("int")})
    archives.write_cells(C.cells(b, spec, "vintage"), args.output)
    return C.compression(b, spec)


def portfolio(spark, args):
    return C.outcome_rate(_cells(spark, args), ["vintage"], F.col("loan_months"))


def profile(spark, args):
    return C.screen_categoricals(_cells(spark, args), args.covariates.split(","), "loan_months")


def _fit(spark, args, family: str = "weibull"):
    names = args.covariates.split(",") if args.covariates else []
    c = _cells(spark, args)
    return c, archives.fit_once(spark, args.fits, {"table": archives.table_identity(spark, args.input), "covariates": names, "family": family}, lambda start: backtest.fit_aft(c, names, family=family, start=start), warm=True)


def fit(spark, args):
    _, f = _fit(spark, args)
    return spark.createDataFrame([(n, b, s, p, r) for n, b, s, _, p, r in f.table()], "parameter string, coefficient double, standard_error double, p_value double, time_ratio double")


def compare(spark, args):
    rows = backtest.compare_families(_cells(spark, args), args.covariates.split(","))
    return spark.createDataFrame([(r["family"], r["aic"], r["incidence_gap"]) for r in rows], "family string, aic double, incidence_gap double")


def score(spark, args):
    c, f = _fit(spark, args)
    s = backtest.score(c, f)
    if args.output:
        s.write.mode("overwrite").parquet(args.output)
    return Q.grade_table(s)


def windows(spark, args):
    rows = backtest.campaign(_cells(spark, args), args.covariates.split(","), [int(x) for x in args.cuts.split(",")])
    return spark.createDataFrame([(r.cut, r.multiplier, r.actual_over_expected, r.gini, r.passed) for r in rows], "cut int, multiplier double, actual_over_expected double, gini double, passed boolean")


def select(spark, args):
    _, trace = backward_selection(_cells(spark, args), args.covariates.split(","))
    return spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(trace)], "step int, record string")


def backtest_(spark, args):
    r = backtest.backtest(_cells(spark, args), args.covariates.split(","), int(args.cuts))
    return spark.createDataFrame([(r.cut, r.multiplier, r.actual_over_expected, r.gini, r.passed)], "cut int, multiplier double, actual_over_expected double, gini double, passed boolean")


def family(spark, args):
    """Marginal families on the durations of the cells."""
    rows = [(r.duration, r.event, r.loans) for r in P.durations(S.risk_sets(_cells(spark, args))).collect()]  # a row per duration and event
    return spark.createDataFrame([(r["family"], r["aic"], r["log_scale"], r["log_shape"]) for r in P.marginal_families(rows)], "family string, aic double, log_scale double, log_shape double")


def views(spark, args):
    """Calibration and back-test views of a fit, with their manifest."""
    c, f = _fit(spark, args)
    scored, segments = backtest.score(c, f), {n: F.col(n) for n in (args.columns or "").split(",") if n}
    tables = V.calibration_views(scored, segments) | V.backtest_views(scored, segments)
    entries = archives.write_views(tables, args.output, {n: {"input": args.input, "covariates": args.covariates} for n in tables})
    return spark.createDataFrame([(e["view"], ",".join(e["columns"]), e["fingerprint"]) for e in entries], "view string, columns string, fingerprint string")


def report(spark, args):
    """Coefficients and grades of a fit as Markdown, in one file."""
    c, f = _fit(spark, args)
    grades = Q.grade_backtest(backtest.score(c, f))
    text = "\n\n".join(["# Fit", archives.markdown_table([{"parameter": n, "coefficient": round(b, 6), "standard error": round(s, 6)} for n, b, s, *_ in f.table()]), "# Grades", archives.markdown_table(grades)])
    spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(args.output)
    return spark.createDataFrame([(r["grade"], r["passed"]) for r in grades], "grade int, passed boolean")


def fetch_macro(spark, args):
    """A series of a delimited file (month, value) into the cache."""
    read = lambda: spark.read.schema("month int, value double").option("header", True).csv(args.input)
    return archives.cached_series(spark, args.output, args.kind, read).agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count("*").alias("months"))


def moratorium(spark, args):
    """Outcomes under the three policies."""
    perf, orig, out = spark.read.parquet(args.input), spark.read.parquet(args.origination), None
    for policy in B.Moratorium:
        one = B.state_of_the_book(perf, orig, policy).groupBy("outcome").agg(F.count("*").alias("loan_months")).withColumn("policy", F.lit(policy.value))
        out = one if out is None else out.unionByName(one)
    return out


def check_calendar(spark, args):
    m = _cells(spark, args).groupBy("month").agg(F.sum("loan_months").alias("loan_months"), F.sum(Q.hits()).alias("defaults"))
    lags = X.lag_correlation(m, m, "month", "defaults", "loan_months")
    return lags.join(F.broadcast(X.calendar_verdict(lags).select("best_shift", "calendar_is_right"))).orderBy("shift")  # one row


COMMANDS = {f.__name__.replace("_", "-"): f for f in (ingest, audit, aggregate, portfolio, profile, fit, compare, score, windows, select, moratorium, check_calendar, family, views, report, fetch_macro)} | {"backtest": backtest_}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    p = argparse.ArgumentParser(prog="cohortica", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    for name in ("input", "output", "origination", "expected", "columns", "keep", "covariates", "cuts"):
        p.add_argument(f"--{name}")
    p.add_argument("--kind", default="perf")
    p.add_argument("--fits", default="fits")
    p.add_argument("--policy", default="exclude", choices=[x.value for x in B.Moratorium])
    p.add_argument("--definition", default="delinquency", choices=[x.value for x in B.Definition])
    args = p.parse_args(argv)
    out = COMMANDS[args.command](spark or shared.session(), args)
    out.show(200, truncate=False)
    return out


if __name__ == "__main__":
    main()
