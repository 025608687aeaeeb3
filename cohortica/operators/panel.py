"""Loan-level panels: first and last rows, durations, as-of lookups, samples and views of them; small estimators on a row per age."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortica.operators.metrics import psi_levels, psi_numeric
from cohortica.operators.model import age_basis


def at_origination(panel: DataFrame, loan: str = "loan") -> DataFrame:
    """Each loan's row of the smallest age."""
    rest = [c for c in panel.columns if c != loan]
    return panel.groupBy(loan).agg(F.min_by(F.struct(*rest), "age").alias("r")).select(loan, *[F.col("r")[c].alias(c) for c in rest])


def to_loan_level(panel: DataFrame, covariates: Sequence[str], loan: str = "loan") -> DataFrame:
    """duration, event and the covariates at origination (the first that is known) of each loan."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("age"))).alias(c) for c in covariates]
    return panel.groupBy(loan).agg((F.max("age") + 1).alias("duration"), F.bool_or("event").alias("event"), *first)


def durations(risk: DataFrame) -> DataFrame:
    """Weighted durations rebuilt from risk sets: how many loans end at each age, by event or censored. Late entries are absorbed."""
    w = Window.orderBy("age")  # a row per age
    after = F.coalesce(F.lead("at_risk").over(w), F.lit(0))
    left = F.col("at_risk") - F.col("defaults")
    r = risk.withColumn("censored", F.greatest(left - after, F.lit(0)))
    return r.select("age", F.inline(F.array(F.struct(F.lit(True).alias("event"), F.col("defaults").alias("loans")), F.struct(F.lit(False).alias("event"), F.col("censored").alias("loans"))))).where("loans > 0").select((F.col("age") + 1).alias("duration"), "event", "loans")


def as_of(left: DataFrame, right: DataFrame, on: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Latest values of right at or before each left row: one union and one window, no range join."""
    carried = [c for c in left.columns if c not in (on, *by)]
    a = left.select(*by, on, F.lit(1).alias("side"), *carried, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    b = right.select(*by, on, F.lit(0).alias("side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in carried], *values)
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(on, "side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
    return both.where("side = 1").drop("side")


def with_age_basis(frame: DataFrame, age: str = "age", ages: int = 400) -> DataFrame:
    """age_basis_1..3 by a lookup of `ages` rows, a fixed number, so it is broadcast."""
    rows = [(k, *map(float, r)) for k, r in enumerate(age_basis(ages))]
    table = frame.sparkSession.createDataFrame(rows, "b_age int, age_basis_1 double, age_basis_2 double, age_basis_3 double")
    return frame.join(F.broadcast(table), F.col(age) == F.col("b_age"), "left").drop("b_age")


def complete_family(frame: DataFrame, built: Sequence[str]) -> DataFrame:
    """Rows whose macro covariates are all known."""
    return frame.na.drop(subset=list(built))


def parity(frame: DataFrame, half: int) -> DataFrame:
    """Cells of even or odd origination years."""
    return frame.where(F.floor(F.col("origination_month") / 12) % 2 == half)


def turnbull(intervals: Sequence[tuple[float, float, float]], rounds: int = 500) -> list[tuple[float, float]]:
    """Interval-censored NPMLE by EM over (lower, upper, weight), upper may be inf; a few hundred bins on the driver. Returns (time, survival after it)."""
    cuts = sorted({b for _, b, _ in intervals if math.isfinite(b)}) + [math.inf]
    lo, hi, w = (np.array(x, float) for x in zip(*intervals, strict=True))
    ends = np.array(cuts)
    inside = (ends[None, :] > lo[:, None]) & (ends[None, :] <= hi[:, None])
    p = np.full(len(ends), 1 / len(ends))
    for _ in range(rounds):
        share = inside * p
        new = (w[:, None] * share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0) / w.sum()
        if np.abs(new - p).max() < 1e-12:
            break
        p = new
    return list(zip(ends[:-1].tolist(), (1 - np.cumsum(p))[:-1].tolist(), strict=True))


def marginal_families(rows: Sequence[tuple[float, bool, float]]) -> list[dict]:
    """Exponential, Weibull, log-normal and log-logistic by AIC on weighted durations (duration, event, weight), a row per duration and event, on the driver."""
    t, e, w = (np.array(x, float) for x in zip(*rows, strict=True))
    t = np.maximum(t, 1e-9)

    def value(family: str, a: float, b: float) -> float:
        z = math.exp(b) * (np.log(t) - a)
        if family in ("exponential", "weibull"):
            log_s, log_h = -np.exp(np.minimum(z, 500)), b + z - np.log(t)
        elif family == "log_logistic":
            log_s = -np.logaddexp(0, z)
            log_h = b + z - np.log(t) + log_s
        else:
            sf = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z])
            log_s = np.log(np.maximum(sf, 1e-300))
            log_h = b - z * z / 2 - 0.5 * math.log(2 * math.pi) - np.log(t) - log_s
        return float((w * (e * log_h + log_s)).sum())

    out = []
    for family in ("exponential", "weibull", "log_normal", "log_logistic"):
        a, b, step = math.log((w * t).sum() / max((w * e).sum(), 1e-9)), 0.0, 0.5
        best = value(family, a, b)
        while step > 1e-7:  # a pattern search in two coordinates
            moves = [(a + step, b), (a - step, b)] + ([] if family == "exponential" else [(a, b + step), (a, b - step), (a + step, b + step), (a - step, b - step), (a + step, b - step), (a - step, b + step)])
            v, x, y = max((value(family, x, y), x, y) for x, y in moves)
            if v > best + 1e-12 * abs(best):
                best, a, b = v, x, y
            else:
                step /= 2
        out.append({"family": family, "log_scale": a, "log_shape": b, "log_likelihood": best, "aic": 2 * (1 if family == "exponential" else 2) - 2 * best})
    return sorted(out, key=lambda r: r["aic"])


def unpivoted(frame: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "series", value: str = "value") -> DataFrame:
    """Long form without missing values."""
    return frame.unpivot(list(keys), list(columns), name, value).na.drop(subset=[value])


def outcomes_by_age(cells: DataFrame) -> DataFrame:
    return cells.groupBy("age", "outcome").agg(F.sum("loan_months").cast("long").alias("loan_months"))


def stability(reference: DataFrame, current: DataFrame, levels: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """PSI of many covariates and the usual verdict."""
    out = None
    for c, f in [*((c, psi_levels) for c in levels), *((c, psi_numeric) for c in numbers)]:
        one = f(reference, current, c).select(F.lit(c).alias("covariate"), "psi")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("verdict", F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.25, "shifted").otherwise("unstable"))


def weighted_mean_by_id(values: DataFrame, weights: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Mean of a value, weighted by rows of the same id, never by place. An id without a weight is an error."""
    w = weights.select(F.col(by).alias("w_id"), F.col(weight).alias("w"))
    j = values.join(w, F.col(by) == F.col("w_id"), "left")
    checked = F.when(F.col("w").isNull(), F.raise_error(F.lit("weights do not cover every row")).cast("double")).otherwise(F.col("w").cast("double"))
    return j.select(F.col(value).alias("x"), checked.alias("w")).agg(F.count("*").alias("rows"), F.round(F.sum(F.col("x") * F.col("w")) / F.sum("w"), 6).alias("mean"))
