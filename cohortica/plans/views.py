"""Published tables: calibration, back-test, competing risks, portfolio and selection views, each segment by segment from one scored table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortica.operators import metrics as Q
from cohortica.operators import survival as S
from cohortica.operators.cells import by_segments, quartiles
from cohortica.operators.model import Fit, correlations, vif
from cohortica.operators.panel import unpivoted


KEY = ["segment", "group"]


def _long(df: DataFrame, segments: Mapping[str, Column], missing: str = "not mapped") -> DataFrame:
    """Each row once for the whole and once per segment: segment, group beside the columns."""
    pairs = [F.struct(F.lit("all").alias("segment"), F.lit("all").alias("group"))]
    pairs += [F.struct(F.lit(n).alias("segment"), F.coalesce(c.cast("string"), F.lit(missing)).alias("group")) for n, c in segments.items()]
    return df.select(*[c for c in df.columns if c not in KEY], F.inline(F.array(*pairs)))


def calibration_views(scored: DataFrame, segments: Mapping[str, Column], month: str = "month") -> dict[str, DataFrame]:
    """Curves observed and predicted, A/E by year and by decile, per segment."""
    long = _long(scored, segments)
    risk = S.risk_sets(long, KEY)
    predicted = long.groupBy(*KEY, "age").agg((F.sum(F.col("hazard") * F.col("loan_months")) / F.sum("loan_months")).alias("hazard"))
    return {
        "survival_observed": S.kaplan_meier(risk, KEY),
        "incidence_observed": S.incidence(risk, KEY),
        "survival_predicted": S.survival_path(predicted, KEY, "age"),
        "actual_expected_by_year": Q.actual_expected(long.withColumn("year", F.floor(F.col(month) / 12).cast("int")), [*KEY, "year"]),
        "calibration_by_decile": Q.calibration(long, 10, KEY),
    }


def backtest_views(scored: DataFrame, segments: Mapping[str, Column], month: str = "month") -> dict[str, DataFrame]:
    long = _long(scored, segments)
    return {
        "acceptance": Q.acceptance(long, KEY),
        "by_month": Q.actual_expected(long, [*KEY, month]),
        "by_grade": Q.actual_expected(long, [*KEY, "grade"]),
        "prepayment": Q.prepayment_by_month(scored, month),
    }


def window_criteria(scored: DataFrame, age_bands: Column) -> DataFrame:
    """A/E over the cross of vintage and age band, its margins and the whole: one cube."""
    c = scored.withColumn("age_band", age_bands).cube("vintage", "age_band")
    a = c.agg(F.sum("loan_months").cast("long").alias("loan_months"), F.sum(Q.hits()).cast("long").alias("actual"), F.sum(F.col("loan_months") * F.col("hazard")).alias("e"), F.grouping_id().alias("level"))
    return a.select("vintage", "age_band", "level", "loan_months", "actual", F.round("e", 6).alias("expected"), F.round(F.try_divide("actual", "e"), 6).alias("actual_over_expected"))


def projection_views(paths: DataFrame, segments: Mapping[str, Column], step: str = "step") -> DataFrame:
    """Mean cumulative PD, marginal PD and hazard by scenario and step, for the whole and every segment. Wants scenario, cumulative_pd and weight."""
    return S.term_structure(_long(paths, segments), [*KEY, "scenario"], step)


def scored_book(scored: DataFrame) -> DataFrame:
    """Exposure and PD by grade, and of the whole book, by rollup."""
    w = F.col("loan_months")
    r = scored.rollup("grade").agg(F.sum(w).cast("long").alias("loan_months"), F.round(F.sum(F.col("pd_12m") * w) / F.sum(w), 8).alias("pd_12m"), F.grouping("grade").alias("whole"))
    return r.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("grade").cast("string")).alias("grade"), "loan_months", "pd_12m")


def competing_views(cells: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """Observed incidences by age, with predicted ones where there are any."""
    observed = S.incidence(S.risk_sets(cells))
    return observed if predicted is None else observed.join(predicted, "age", "left")


def anchoring_view(scored: DataFrame, windows: Mapping[str, tuple[int, int]], month: str = "month") -> DataFrame:
    out = None
    for name, (first, last) in windows.items():
        one = Q.anchor(scored, first, last, month=month).withColumn("window", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def portfolio_views(book: DataFrame, loans: DataFrame, macro: DataFrame, segments: Mapping[str, Column], numbers: Sequence[str], balance: str) -> dict[str, DataFrame]:
    measures = {"loan_months": F.count("*"), "balance": F.sum(balance)}
    series = [c for c in macro.columns if c != "month"]
    return {
        "book_by_segment": by_segments(book, "month", segments, measures),
        "lending_by_segment": by_segments(loans, "vintage", segments, {"loans": F.count("*"), "volume": F.sum(balance)}),
        "underwriting_by_vintage": quartiles(loans, "vintage", *numbers),
        "macro_series": unpivoted(macro, ["month"], series),
    }


def covariates_over_time(cells: DataFrame, columns: Sequence[str], month: str = "month") -> DataFrame:
    """Weighted mean and spread of each covariate by month."""
    w = F.col("loan_months")
    mean = lambda x: F.sum(w * x) / F.sum(w)
    long = cells.select(month, "loan_months", F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))).alias("covariate", "x")).where("x is not null")
    g = long.groupBy("covariate", month).agg(mean(F.col("x")).alias("mean"), mean(F.col("x") * F.col("x")).alias("q"))
    return g.select("covariate", month, F.round("mean", 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("q") - F.col("mean") * F.col("mean"), F.lit(0.0))), 6).alias("sd"))


def coefficient_view(fit: Fit, steps: Mapping[str, float] | None = None) -> list[dict]:
    """Coefficients, time ratios per unit and, where a step is given, per step."""
    return [{"parameter": n, "coefficient": b, "standard_error": s, "p_value": p, "time_ratio": r, "per_step": r ** (steps or {}).get(n, 1.0)} for n, b, s, _, p, r in fit.table()]


def selection_views(cells: DataFrame, columns: Sequence[str]) -> dict[str, list[dict]]:
    """Correlations, long, and variance inflation."""
    r = correlations(cells, list(columns))
    pairs = [{"first": a, "second": b, "correlation": float(r[i, j])} for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return {"correlation": pairs, "inflation": [{"covariate": c, "vif": float(v)} for c, v in zip(columns, vif(r), strict=True)]}
