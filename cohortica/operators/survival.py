"""Risk sets, product-limit curves and competing incidence. Curves are windows over a few hundred ages per group; risk sets are one GROUP BY."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortica.functions.columns import share
from cohortica.operators.book import DEFAULT, PREPAYMENT

CAUSES = (DEFAULT, PREPAYMENT)


def risk_sets(cells: DataFrame, by: Sequence[str] = (), weight: str = "loan_months") -> DataFrame:
    """At risk and events of each cause by group and age."""
    sums = {f"{c}s": F.sum(F.when(F.col("outcome") == c, F.col(weight)).otherwise(0)).cast("long") for c in CAUSES}
    return cells.groupBy(*by, "age").agg(F.sum(weight).cast("long").alias("at_risk"), *[s.alias(n) for n, s in sums.items()])


def _over(by: Sequence[str]) -> Window:
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return w.orderBy("age")


def _product(h: Column, w) -> Column:
    """Cumulative product of 1 - h; once h is 1 it stays 0."""
    logs = F.sum(F.when(h < 1, F.log1p(-h)).otherwise(0.0)).over(w)
    return F.when(F.max(F.when(h >= 1, 1).otherwise(0)).over(w) == 1, F.lit(0.0)).otherwise(F.exp(logs))


def kaplan_meier(risk: DataFrame, by: Sequence[str] = (), events: str = "defaults", z: float = 1.959963984540054) -> DataFrame:
    """Survival with Greenwood's band."""
    w = _over(by).rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col(events), F.col("at_risk")
    r = risk.withColumn("hazard", share(d, n))
    r = r.withColumns({"s": _product(F.col("hazard"), w), "v": F.sum(F.coalesce(F.try_divide(d, n * (n - d)), F.lit(0.0))).over(w)})
    se = F.col("s") * F.sqrt("v")
    return r.select(*by, "age", "at_risk", events, F.round("hazard", 9).alias("hazard"), F.round("s", 9).alias("survival"), F.round(se, 9).alias("se"), F.round(F.greatest(F.lit(0.0), F.col("s") - z * se), 9).alias("low"), F.round(F.least(F.lit(1.0), F.col("s") + z * se), 9).alias("high"))


def aalen_johansen(risk: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative incidence of both causes and survival; the three add up to one."""
    w = _over(by)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("at_risk")
    r = risk.withColumn("h", share(F.col("defaults") + F.col("prepayments"), n)).withColumn("s", _product(F.col("h"), upto))
    r = r.withColumn("entering", F.coalesce(F.lag("s").over(w), F.lit(1.0)))
    for c in CAUSES:
        r = r.withColumn(f"f_{c}", F.sum(F.col("entering") * F.col(f"{c}s") / n).over(upto))
    return r


def incidence(risk: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    r = aalen_johansen(risk, by)
    return r.select(*by, "age", F.round("s", 9).alias("survival"), *[F.round(f"f_{c}", 9).alias(f"incidence_{c}") for c in CAUSES])


def incidence_error(risk: DataFrame, by: Sequence[str] = (), cause: str = DEFAULT) -> DataFrame:
    """Delta-method standard error of a cumulative incidence: five running sums."""
    upto = _over(by).rowsBetween(Window.unboundedPreceding, 0)
    r = aalen_johansen(risk, by)
    n, d, k = F.col("at_risk"), F.col("defaults") + F.col("prepayments"), F.col(f"{cause}s")
    f, s = F.col(f"f_{cause}"), F.col("entering")
    a = F.coalesce(F.try_divide(d, n * (n - d)), F.lit(0.0))
    b = s * F.coalesce(F.try_divide(k, n * n), F.lit(0.0))
    c = s * s * k * (n - k) / F.pow(n, F.lit(3.0))
    run = lambda x: F.sum(x).over(upto)
    r = r.withColumns({"a0": run(a), "a1": run(f * a), "a2": run(f * f * a), "c0": run(c), "b0": run(b), "b1": run(f * b)})
    v = f * f * F.col("a0") - 2 * f * F.col("a1") + F.col("a2") + F.col("c0") - 2 * (f * F.col("b0") - F.col("b1"))
    return r.select(*by, "age", F.round(f, 9).alias("incidence"), F.round(F.sqrt(F.greatest(v, F.lit(0.0))), 8).alias("se"))


def net_entries(risk: DataFrame) -> DataFrame:
    """Loan-months at risk at an age that were not at risk the age before: R(a + 1) - [R(a) - d(a)] where it is positive, by the age of arrival. An age without a row has nothing at risk. Only the net flow shows."""
    spine = risk.agg(F.explode(F.sequence(F.lit(0), F.max("age"))).alias("age"))
    w = Window.orderBy("age")  # a row per age
    r = spine.join(risk.select("age", "at_risk", "defaults"), "age", "left").na.fill(0)
    r = r.withColumn("net", F.col("at_risk") - F.lag(F.col("at_risk") - F.col("defaults")).over(w))
    return r.where("net > 0").select("age", F.col("net").alias("net_entries"))


def late_entry_share(risk: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """All net entries against what was at risk at the first age, and whether that is more than is tolerated."""
    first = risk.agg(F.max("at_risk").alias("peak"), F.min_by("at_risk", "age").alias("start"))
    late = net_entries(risk).agg(F.coalesce(F.sum("net_entries"), F.lit(0)).alias("net_entries"))
    both = late.crossJoin(F.broadcast(first))  # one row each
    part = share(F.col("net_entries"), F.col("net_entries") + F.col("start"))
    return both.select("net_entries", F.round(part, 9).alias("share"), (part > tolerance).alias("warned"))


def curves_cross(curves: DataFrame, group: str, exposure: int = 10_000, tolerance: float = 0.001) -> DataFrame:
    """Pairs of groups whose survival curves change order, where they differ by more than the tolerance. An age at which any group has less than the exposure, or no row, counts for none."""
    groups = curves.select(group).distinct().agg(F.count("*").alias("groups"))
    known = curves.groupBy("age").agg(F.min("at_risk").alias("least"), F.count("*").alias("n")).crossJoin(F.broadcast(groups)).where((F.col("least") >= exposure) & (F.col("n") == F.col("groups"))).select("age")  # one row
    a = curves.join(known, "age").select("age", F.col(group).alias("a"), F.col("survival").alias("x"))
    b = a.select("age", F.col("a").alias("b"), F.col("x").alias("y"))
    d = a.join(b, "age").where("a < b").withColumn("d", F.col("x") - F.col("y"))
    over = lambda c: F.bool_or(c)
    g = d.groupBy("a", "b").agg(over(F.col("d") > tolerance).alias("above"), over(F.col("d") < -tolerance).alias("below"), F.count("*").alias("ages"))
    return g.select(F.col("a").alias("first_group"), F.col("b").alias("second_group"), "ages", (F.col("above") & F.col("below")).alias("crosses"))


def validate_panel(panel: DataFrame, step: int = 1) -> DataFrame:
    """Counts of what a loan-level panel must not have: repeated ages, gaps, negative ages, several events, rows after an event. Wants loan, age, event."""
    w = Window.partitionBy("loan").orderBy("age")
    p = panel.withColumns({"before": F.lag("age").over(w), "gone": F.coalesce(F.max(F.col("event").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return p.agg(
        F.count("*").alias("rows_checked"),
        F.count_if(F.col("age") == F.col("before")).alias("repeated"),
        F.count_if(F.col("age") - F.col("before") > step).alias("gaps"),
        F.count_if(F.col("age") < 0).alias("negative"),
        F.count_if(F.col("event") & (F.col("gone") == 1)).alias("second_events"),
        F.count_if(F.col("gone") == 1).alias("after_event"),
    )


def episodes(cells: DataFrame, cause: str = DEFAULT, step: int = 1) -> DataFrame:
    """Counting-process interval and interval-censored bounds (inf: right-censored)."""
    event = F.col("outcome") == cause
    stop = F.col("age") + step
    return cells.withColumns({"event": event, "age_start": F.col("age"), "age_stop": stop, "lower_bound": F.when(event, F.col("age")).otherwise(stop).cast("double"), "upper_bound": F.when(event, stop.cast("double")).otherwise(F.lit(float("inf"))), "exact_observation": F.lit(False)})


def survival_path(paths: DataFrame, by: Sequence[str], step: str = "step", hazard: str = "hazard") -> DataFrame:
    """Chains hazards along a path: survival and cumulative PD."""
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    s = _product(F.col(hazard), w)
    return paths.withColumn("survival", s).withColumn("cumulative_pd", 1 - F.col("survival"))


def competing_paths(paths: DataFrame, by: Sequence[str], step: str = "step") -> DataFrame:
    """Survival and incidence of two causes along paths with h_default and h_prepayment (each given no other exit before it in the month)."""
    w = Window.partitionBy(*by).orderBy(step)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    both = F.least(F.col("h_default") + F.col("h_prepayment"), F.lit(1.0))
    p = paths.withColumn("h", both).withColumn("survival", _product(F.col("h"), upto)).withColumn("entering", F.coalesce(F.lag("survival").over(w), F.lit(1.0)))
    return p.withColumns({f"incidence_{c}": F.sum(F.col("entering") * F.col(f"h_{c}")).over(upto) for c in CAUSES}).drop("h", "entering")


def predicted_incidence(scored: DataFrame, by: Sequence[str] = (), weight: str = "loan_months") -> DataFrame:
    """The model's own incidences: hazards of both causes (h_default, h_prepayment), averaged over the exposure at each age, then chained. Comparable with incidence() of the same rows."""
    mean = lambda c: (F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c)
    m = scored.groupBy(*by, "age").agg(F.sum(weight).cast("long").alias("at_risk"), mean("h_default"), mean("h_prepayment"))
    p = competing_paths(m.withColumn("one", F.lit(1)), [*by, "one"], "age")
    return p.select(*by, "age", "at_risk", F.round("survival", 9).alias("survival"), *[F.round(f"incidence_{c}", 9).alias(f"incidence_{c}") for c in CAUSES])


def projected_against_observed(paths: DataFrame, observed: DataFrame, by: Sequence[str], step: str = "step") -> DataFrame:
    """Weighted mean incidences of projected paths beside the observed ones of the same month of age (step 0 is age 0). Wants incidence_ columns and weight on the paths."""
    mean = lambda c: (F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(f"projected_{c}")
    p = paths.groupBy(*by, F.col(step).alias("age")).agg(*[mean(f"incidence_{c}") for c in CAUSES])
    o = observed.select(*by, "age", *[F.col(f"incidence_{c}").alias(f"observed_incidence_{c}") for c in CAUSES])
    return p.join(o, [*by, "age"], "left").select(*by, "age", *[F.round(f"projected_incidence_{c}", 6).alias(f"projected_{c}") for c in CAUSES], *[F.round(f"observed_incidence_{c}", 6).alias(f"observed_{c}") for c in CAUSES])


def term_structure(paths: DataFrame, by: Sequence[str], step: str = "step") -> DataFrame:
    """Weighted mean cumulative PD per step, the marginal PD and the hazard it implies. Wants cumulative_pd and weight."""
    mean = paths.groupBy(*by, step).agg((F.sum(F.col("cumulative_pd") * F.col("weight")) / F.sum("weight")).alias("cumulative"))
    w = Window.partitionBy(*by).orderBy(step)
    before = F.coalesce(F.lag("cumulative").over(w), F.lit(0.0))
    m = mean.withColumn("marginal", F.col("cumulative") - before).withColumn("hz", share(F.col("marginal"), 1 - before))
    return m.select(*by, step, F.round("cumulative", 8).alias("cumulative_pd"), F.round("marginal", 8).alias("marginal_pd"), F.round("hz", 8).alias("hazard"))
