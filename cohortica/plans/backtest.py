"""Back-tests: split by observation month, fit, score, anchor, judge; campaigns over cuts; projections under scenarios; marginal effects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortica.functions.columns import annualised, log_logistic_hazard, weibull_hazard
from cohortica.operators import metrics as Q
from cohortica.operators import survival as S
from cohortica.operators.model import Fit, fit_aft

TARGETS = {"actual_over_expected": (0.80, 1.25), "gini": 0.45}


def predictor(fit: Fit) -> Column:
    """Log scale as a column of the covariates."""
    b = dict(zip(fit.names, fit.params.tolist(), strict=True))
    out = F.lit(b.pop("intercept"))
    b.pop("log_shape")
    for name, value in b.items():
        out = out + F.lit(value) * F.col(name)
    return out


def score(cells: DataFrame, fit: Fit, multiplier: float = 1.0) -> DataFrame:
    """hazard, pd_12m (floored) and grade, as column expressions."""
    hazard = {"weibull": weibull_hazard, "log_logistic": log_logistic_hazard}[fit.family]("age", predictor(fit), float(fit.params[-1]))
    s = cells.withColumn("hazard", F.least(hazard * multiplier, F.lit(1.0)))
    s = s.withColumn("pd_12m", F.greatest(annualised(F.col("hazard")), F.lit(Q.FLOOR)))
    return s.withColumn("grade", Q.grade(F.col("pd_12m")))


def split(cells: DataFrame, cut: int, months: int = 24, embargo: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train: observed up to the cut; test: the months after it. Wants month."""
    return cells.where(F.col("month") <= cut), cells.where((F.col("month") > cut + embargo) & (F.col("month") <= cut + embargo + months))


def assert_no_lookahead(train: DataFrame, test: DataFrame) -> None:
    a, b = train.agg(F.max("month")).first()[0], test.agg(F.min("month")).first()[0]
    if a is not None and b is not None and a >= b:
        raise ValueError(f"training sees month {a}, testing begins in {b}")


@dataclass
class Result:
    cut: int
    fit: Fit
    multiplier: float
    actual_over_expected: float | None
    gini: float | None
    passed: bool


def backtest(cells: DataFrame, covariates: Sequence[str], cut: int, months: int = 24, anchor_months: int = 0, **options) -> Result:
    train, test = split(cells, cut, months)
    assert_no_lookahead(train, test)
    fit = fit_aft(train, covariates, **options)
    multiplier = 1.0
    if anchor_months:
        multiplier = Q.anchor(score(train, fit), cut - anchor_months + 1, cut).first().multiplier
    scored = score(test, fit, multiplier).persist()
    try:
        r = Q.acceptance(scored.withColumn("all", F.lit("all")), ["all"], *TARGETS["actual_over_expected"], TARGETS["gini"]).first()
    finally:
        scored.unpersist()
    return Result(cut, fit, multiplier, r and r.actual_over_expected, r and r.gini, bool(r and r.passed))


def campaign(cells: DataFrame, covariates: Sequence[str], cuts: Sequence[int], **options) -> list[Result]:
    return [backtest(cells, covariates, cut, **options) for cut in cuts]


def project(book: DataFrame, fit: Fit, horizon: int, by: Sequence[str], macro: DataFrame | None = None) -> DataFrame:
    """Paths of a book from its ages on: step, hazard, survival, cumulative_pd. macro: covariates by month (and scenario), joined on the projected month."""
    p = book.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).withColumn("age", F.col("age") + F.col("step"))
    if macro is not None:
        p = p.withColumn("month", F.col("month") + F.col("step")).join(macro, "month")
        by = [*by, *(["scenario"] if "scenario" in macro.columns else [])]
    return S.survival_path(score(p, fit), by)


def conditional_pd(paths: DataFrame, by: Sequence[str], months: int) -> DataFrame:
    """PD within so many months of the book's date."""
    return paths.where(F.col("step") == months - 1).select(*by, F.col("cumulative_pd").alias(f"pd_{months}m"))


def marginal_effects(cells: DataFrame, fit: Fit, steps: Mapping[str, float]) -> DataFrame:
    """Mean hazard with each covariate moved by its step, against the hazard as it is: all moves in one pass."""
    shocks = [F.lit("base"), *[F.lit(c) for c in steps]]
    d = cells.withColumn("shock", F.explode(F.array(*shocks)))
    d = d.withColumns({c: F.col(c) + F.when(F.col("shock") == c, F.lit(float(v))).otherwise(0.0) for c, v in steps.items()})
    m = score(d, fit).groupBy("shock").agg((F.sum(F.col("hazard") * F.col("loan_months")) / F.sum("loan_months")).alias("hazard"))
    base = m.where("shock = 'base'").select(F.col("hazard").alias("base"))
    return m.crossJoin(F.broadcast(base)).where("shock <> 'base'").select("shock", F.round("hazard", 9).alias("hazard"), F.round(F.col("hazard") / F.col("base"), 6).alias("ratio"))  # base: one row


def compare_families(cells: DataFrame, covariates: Sequence[str], **options) -> list[dict]:
    """Both families by AIC and by the largest gap between observed and predicted incidence over ages."""
    rows = []
    for family in ("weibull", "log_logistic"):
        fit = fit_aft(cells, covariates, family=family, **options)
        m = score(cells, fit).groupBy("age").agg((F.sum(Q.hits()) / F.sum("loan_months")).alias("o"), (F.sum(F.col("hazard") * F.col("loan_months")) / F.sum("loan_months")).alias("p")).withColumn("one", F.lit(1))
        both = S.survival_path(S.survival_path(m, ["one"], "age", "o").withColumnRenamed("cumulative_pd", "x"), ["one"], "age", "p")
        gap = both.agg(F.max(F.abs(F.col("x") - F.col("cumulative_pd")))).first()[0]
        rows.append({"family": family, "aic": fit.aic, "log_likelihood": fit.log_likelihood, "incidence_gap": gap})
    return sorted(rows, key=lambda r: r["aic"])


def coefficient_shift(a: Fit, b: Fit) -> list[dict]:
    """Parameters of two fits side by side, and the change in standard errors of the first."""
    other = dict(zip(b.names, b.params.tolist(), strict=True))
    return [{"parameter": n, "first": x, "second": other.get(n), "shift_in_se": (other[n] - x) / s if n in other else None} for n, x, s, *_ in a.table()]
