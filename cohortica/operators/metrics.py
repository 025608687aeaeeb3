"""Exposure-weighted metrics of a scored table: hazard, outcome, loan_months. Running sums are over groups of equal hazard, or bins, never over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortica.functions.columns import share
from cohortica.functions.special import jeffreys_interval
from cohortica.operators.book import DEFAULT, PREPAYMENT

#: Inner edges of the master scale, five basis points and doubling; the floor of a PD; how many of the eight grades must hold; widths of the rules.
GRADES = [0.0005 * 2**k for k in range(7)]
FLOOR = 0.0005
GRADES_TO_PASS = 7
GRADE_TOLERANCE = 0.25
THIN_MONTH = 0.10
MOST_MULTIPLIER = 4.0


def hits(cause: str = DEFAULT, weight: str = "loan_months") -> Column:
    return F.when(F.col("outcome") == cause, F.col(weight)).otherwise(0)


def actual_expected(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exposure, actual and expected events and their ratio."""
    a = scored.groupBy(*by).agg(F.sum("loan_months").cast("long").alias("loan_months"), F.sum(hits()).cast("long").alias("actual"), F.sum(F.col("loan_months") * F.col("hazard")).alias("e"))
    return a.select(*by, "loan_months", "actual", F.round("e", 6).alias("expected"), F.round(share(F.col("actual"), F.col("e")), 6).alias("actual_over_expected"))


def _ranked(scored: DataFrame, by: Sequence[str], sums: dict[str, Column], descending: bool) -> DataFrame:
    """hz, the sums per distinct hazard, and for each sum its total and its running total up to and with the hazard, per group.

    In two levels, ranges of the hazard's logarithm and values within a range, so no task gets all distinct hazards.
    """
    h = scored.groupBy(*by, F.round("hazard", 12).alias("hz")).agg(*[c.alias(n) for n, c in sums.items()])
    h = h.withColumn("bin", F.floor(F.log(F.greatest(F.col("hz"), F.lit(1e-300))) * 64))
    bins = h.groupBy(*by, "bin").agg(*[F.sum(n).alias(f"{n}_bin") for n in sums])
    outer = Window.partitionBy(*by) if by else Window.partitionBy()  # a row per range
    order = F.desc if descending else F.asc
    before = outer.orderBy(order("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns({f"{n}_before": F.coalesce(F.sum(f"{n}_bin").over(before), F.lit(0)) for n in sums} | {f"{n}_total": F.sum(f"{n}_bin").over(outer) for n in sums})
    keys = [*by, "bin"]
    bins = bins.withColumnsRenamed({k: f"of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    h = h.join(bins, on).drop(*[f"of_{k}" for k in keys], *[f"{n}_bin" for n in sums])
    inside = Window.partitionBy(*keys).orderBy(order("hz")).rowsBetween(Window.unboundedPreceding, 0)
    return h.withColumns({f"{n}_run": F.col(f"{n}_before") + F.sum(n).over(inside) for n in sums})


def equal_exposure_buckets(scored: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """bucket of each hazard, so that buckets hold even exposure: n times the running share of exposure, the hazard's own included. Cells of one hazard share a bucket. by: buckets within groups."""
    h = _ranked(scored, by, {"w": F.sum("loan_months")}, False)
    return h.select(*by, "hz", F.least(F.floor(F.col("w_run") * n / F.col("w_total")), F.lit(n - 1)).cast("int").alias("bucket"))


def calibration(scored: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Actual against expected in buckets of equal exposure, by predicted risk."""
    b = equal_exposure_buckets(scored, n, by)
    return actual_expected(scored.withColumn("hz", F.round("hazard", 12)).join(b, [*by, "hz"]), [*by, "bucket"])


def gini(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Twice the area between the Lorenz curve and the diagonal; null without defaults. Cells of equal hazard are one point of the curve, so row order does not matter."""
    t = _ranked(scored, by, {"d": F.sum(hits()), "w": F.sum("loan_months")}, True)
    area = F.sum(F.col("w") * (2 * F.col("d_run") - F.col("d"))) / (2 * F.max("w_total").cast("double") * F.nullif(F.max("d_total"), F.lit(0)))
    g = t.groupBy(*by).agg(area.alias("area"), F.max("d_total").cast("long").alias("defaults"))
    return g.select(*by, "defaults", F.round(2 * F.col("area") - 1, 8).alias("gini"))


def psi_levels(reference: DataFrame, current: DataFrame, column: str, weight: str = "loan_months", floor: float = 1e-6) -> DataFrame:
    """Population stability index over the levels of a column."""
    both = reference.select(F.col(column).cast("string").alias("level"), F.col(weight).alias("r"), F.lit(0).alias("c")).unionByName(current.select(F.col(column).cast("string").alias("level"), F.lit(0).alias("r"), F.col(weight).alias("c")))
    n = both.groupBy("level").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    all_ = Window.partitionBy()  # a row per level
    p = F.greatest(F.col("r") / F.sum("r").over(all_), F.lit(floor))
    q = F.greatest(F.col("c") / F.sum("c").over(all_), F.lit(floor))
    return n.select(((q - p) * F.log(q / p)).alias("x")).agg(F.round(F.sum("x"), 8).alias("psi"))


def psi_numeric(reference: DataFrame, current: DataFrame, column: str, bins: int = 10, weight: str = "loan_months", floor: float = 1e-6) -> DataFrame:
    """PSI over quantile bins: edges from the reference's rows, unweighted; shares weighted; under three edges 0."""
    q = reference.agg(F.percentile(column, F.array(*[F.lit(k / bins) for k in range(bins + 1)])).alias("q")).select(F.array_sort(F.array_distinct("q")).alias("edges"))
    place = F.when(F.col(column).isNull(), -1).otherwise(F.size(F.filter(F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0))), lambda e: F.col(column) >= e)))
    put = lambda d: d.crossJoin(F.broadcast(q)).withColumn("bin", F.when(F.size("edges") < 3, 0).otherwise(place))  # noqa: E731  one row of edges
    return psi_levels(put(reference), put(current), "bin", weight, floor)


def grade(pd: Column) -> Column:
    """Number of the master scale's grade, from 1; a PD on an edge belongs to the grade below it."""
    out = F.when(pd <= GRADES[0], 1)
    for k, edge in enumerate(GRADES[1:], start=2):
        out = out.when(pd <= edge, k)
    return out.otherwise(len(GRADES) + 1)


def grade_table(scored: DataFrame, pd: str = "pd_12m") -> DataFrame:
    """Per grade: exposure, defaults, expected and observed monthly rates."""
    return actual_expected(scored.withColumn("grade", grade(F.col(pd))), ["grade"])


def grade_rates(scored: DataFrame, pd: str = "pd_12m", tolerance: float = GRADE_TOLERANCE) -> DataFrame:
    """Per grade: obligor-years, 12-month PD predicted and realised, the relative miss, and whether it is within the tolerance (null without defaults: there is nothing to be relative to)."""
    w = F.col("loan_months")
    g = scored.withColumn("grade", grade(F.col(pd))).groupBy("grade").agg(F.sum(w).cast("long").alias("loan_months"), F.sum(hits()).cast("long").alias("defaults"), (F.sum(F.col(pd) * w) / F.sum(w)).alias("p"))
    years = F.col("loan_months") / 12
    actual = F.col("defaults") / years
    miss = F.try_divide(F.col("p"), actual) - 1
    return g.select("grade", "loan_months", "defaults", F.round(years, 6).alias("obligor_years"), F.round("p", 9).alias("predicted_pd"), F.round(actual, 9).alias("actual_pd"), F.round(miss, 6).alias("relative_miss"), (F.abs(miss) <= tolerance).alias("within_tolerance"))


def grade_backtest(scored: DataFrame, pd: str = "pd_12m", level: float = 0.95, tolerance: float = GRADE_TOLERANCE) -> list[dict]:
    """Eight rows or fewer on the driver: a grade passes by the tolerance on its 12-month PD, one without defaults by the Jeffreys interval of its obligor-years."""
    rows = []
    for r in grade_rates(scored, pd, tolerance).orderBy("grade").collect():
        low, high = jeffreys_interval(r.defaults, r.obligor_years, level)
        inside = low <= r.predicted_pd <= high
        rows.append({**r.asDict(), "low": low, "high": high, "inside_jeffreys": inside, "passed": inside if not r.defaults else r.within_tolerance, "judged_on": "tolerance" if r.defaults else "interval"})
    return rows


def master_scale_passed(rows: list[dict], required: int = GRADES_TO_PASS) -> bool:
    """At most one failing grade; a grade that nobody is in neither passes nor fails."""
    return sum(not r["passed"] for r in rows) <= len(GRADES) + 1 - required


def prepayment_by_month(scored: DataFrame, month: str, predicted: str | None = None) -> DataFrame:
    """Single monthly mortality and the yearly rate it compounds to, realised and, where there is a hazard of prepayment, predicted, with their ratio."""
    a = scored.groupBy(month).agg(F.sum("loan_months").cast("long").alias("loan_months"), F.sum(hits(PREPAYMENT)).cast("long").alias("prepayments"), F.sum(F.col(predicted) * F.col("loan_months") if predicted else F.lit(None).cast("double")).alias("e"))
    yearly = lambda x: 1 - F.pow(1 - x, F.lit(12.0))
    smm, model = F.col("prepayments") / F.col("loan_months"), F.col("e") / F.col("loan_months")
    more = [F.round(model, 9).alias("predicted_smm"), F.round(yearly(model), 8).alias("predicted_cpr"), F.round(F.when(model > 0, smm / model), 6).alias("ratio")] if predicted else []
    return a.select(month, "loan_months", "prepayments", F.round(smm, 9).alias("smm"), F.round(yearly(smm), 8).alias("cpr"), *more)


def cycle_in_band(by_year: DataFrame, low: float = 0.8, high: float = 1.25, threshold: float = 0.70) -> DataFrame:
    """Share of years whose actual over expected is in the band, the lowest and highest, and whether enough are."""
    r = F.col("actual_over_expected")
    a = by_year.where(r.isNotNull()).agg(F.count("*").alias("years"), F.count_if(r.between(low, high)).alias("years_in_band"), F.min(r).alias("lowest"), F.max(r).alias("highest"))
    part = share(F.col("years_in_band"), F.col("years"))
    return a.withColumns({"share_in_band": F.round(part, 6), "threshold": F.lit(threshold), "passed": F.coalesce(part >= threshold, F.lit(False))})


def covered_months(by_month: DataFrame, exposure: str = "loan_months", part: float = THIN_MONTH) -> DataFrame:
    """Months, thin if they hold less than a part of the median month's exposure."""
    median = by_month.agg(F.percentile(exposure, F.lit(0.5)).alias("median"))
    return by_month.crossJoin(F.broadcast(median)).withColumn("thin", F.col(exposure) < part * F.col("median")).drop("median")  # one row


def acceptance(scored: DataFrame, by: Sequence[str], low: float = 0.8, high: float = 1.25, least_gini: float = 0.45) -> DataFrame:
    """A/E overall and worst and best bucket, Gini, and whether all pass, per group."""
    whole = actual_expected(scored, by)
    buckets = calibration(scored, 10, by).groupBy(*by).agg(F.min("actual_over_expected").alias("worst"), F.max("actual_over_expected").alias("best"))
    a = whole.join(buckets, list(by)).join(gini(scored, by).drop("defaults"), list(by))
    ok = F.col("actual_over_expected").between(low, high) & (F.col("worst") >= low) & (F.col("best") <= high) & (F.col("gini") > least_gini)
    return a.withColumn("passed", F.coalesce(ok, F.lit(False)))


def histogram_deciles(scored: DataFrame, bins: int = 10_000, n: int = 10) -> DataFrame:
    """Boundaries of equal exposure from a histogram of log hazards."""
    spot = F.floor((F.log("hazard") + 20) / 20 * bins).cast("int")
    h = scored.groupBy(spot.alias("bin")).agg(F.sum("loan_months").alias("w"))
    w = Window.orderBy("bin")  # a row per bin, a fixed number of them
    h = h.withColumns({"run": F.sum("w").over(w), "total": F.sum("w").over(Window.partitionBy())})
    cut = h.withColumn("decile", F.floor((F.col("run") - 1) * n / F.col("total")).cast("int"))
    return cut.groupBy("decile").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.sum("w").cast("long").alias("loan_months"))


def weighted_moments(df: DataFrame, columns: Sequence[str], weight: str = "loan_months") -> DataFrame:
    """Means, covariances and correlations of columns in one aggregate; a row per pair."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    w = F.col(weight)
    a = df.agg(F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(f"s_{c}") for c in columns], *[F.sum(w * F.col(x) * F.col(y)).alias(f"p_{x}_{y}") for x, y in pairs])
    cov = lambda x, y: F.col(f"p_{x}_{y}") / F.col("w") - F.col(f"s_{x}") / F.col("w") * F.col(f"s_{y}") / F.col("w")
    rows = [F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), F.round(cov(x, y), 4).alias("covariance"), F.round(cov(x, y) / F.sqrt(cov(x, x) * cov(y, y)), 6).alias("correlation")) for x, y in pairs]
    return a.select(F.inline(F.array(*rows)))


def anchor(scored: DataFrame, first: int | None = None, last: int | None = None, most: float = MOST_MULTIPLIER, month: str = "month") -> DataFrame:
    """Multiplier that brings expected to actual events in a window of months (none: all). An error where nothing is exposed or expected there, or where the level is out by more
    than a multiplier may carry: such a gap is a specification to look at, not a level to scale."""
    inside = F.lit(True)
    if first is not None:
        inside = inside & (F.col(month) >= first)
    if last is not None:
        inside = inside & (F.col(month) <= last)
    a = scored.where(inside).agg(F.sum(hits()).alias("d"), F.sum(F.col("loan_months") * F.col("hazard")).alias("e"), F.sum("loan_months").cast("long").alias("loan_months"))
    m = share(F.col("d"), F.col("e"))
    wrong = lambda text: F.raise_error(F.lit(text)).cast("double")
    checked = F.when(F.col("loan_months").isNull(), wrong("no exposure in the anchoring window")).when(F.col("e") <= 0, wrong("nothing is expected in the anchoring window"))
    checked = checked.when((m > most) | (m < 1 / most), wrong(f"the level is out by more than {most:g} times")).otherwise(m)
    return a.select("loan_months", F.col("d").cast("long").alias("actual"), F.round("e", 6).alias("expected"), F.round(checked, 8).alias("multiplier"))
