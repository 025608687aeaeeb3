"""Named queries over the stand-in book; plans/oracle.py has the same as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortica.functions.columns import annualised, band_label, binned, midpoint, weibull_hazard
from cohortica.operators import book as K
from cohortica.operators import cells as C
from cohortica.operators import macro as X
from cohortica.operators import metrics as Q
from cohortica.operators import model as M
from cohortica.operators import panel as P
from cohortica.operators import selection as L
from cohortica.operators import survival as S
from cohortica.plans import records as R
from cohortica.plans import standin as B
from cohortica.plans import views as V
from cohortica.sources import archives
from cohortica.sources.shared import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CUT = 1996 * 12


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _risk(s, d):
    return S.risk_sets(B.cell_table(s, d))


def _halves(s, d):
    # read two times and more by those that ask: written once
    t = written(B.scored(s, d), "scored")
    mid = t.agg(F.floor((F.min("month") + F.max("month")) / 2).cast("int")).first()[0]
    return t.where(F.col("month") <= mid), t.where(F.col("month") > mid), mid


def _add(name: str, f: Query) -> None:
    QUERIES[name] = f


def _outcomes(policy: str, crr: bool = False) -> Query:
    return lambda s, d: B.book(s, d, policy, crr).groupBy("vintage", "outcome").agg(F.count("*").alias("loan_months"))


_add("default_rate_by_segment", lambda s, d: C.outcome_rate(B.book(s, d).withColumn("price", midpoint("price", B.EDGES["price"])), ["segment", "price"]))
_add("book_outcomes", _outcomes("exclude"))
_add("book_policy_censor", _outcomes("censor"))
_add("book_policy_ignore", _outcomes("ignore"))
_add("book_crr_restructuring", _outcomes("exclude", True))
_add("cells", B.cell_table)
_add("cells_quarterly", lambda s, d: C.cells(B.book(s, d), C.CellSpec({}, ("segment",), 3)).groupBy("age", "segment", "outcome").agg(F.sum("loan_months").alias("loan_months")))
_add("cell_compression", lambda s, d: C.compression(B.book(s, d), B.SPEC))
_add("key_extension_cost", lambda s, d: C.extension_cost(B.book(s, d), B.SPEC, {"with_status": B.SPEC.extended("status")}))
_add("outstanding_by_month", lambda s, d: B.book(s, d).groupBy("month").agg(F.count("*").alias("contracts"), F.round(F.sum("price"), 2).alias("balance")))
_add("originations_by_month", lambda s, d: B.loans(s, d).groupBy("origination_month").agg(F.count("*").alias("loans"), F.round(F.sum("price"), 2).alias("volume"), F.round(F.avg("price"), 4).alias("price"), F.round(F.avg("acctbal"), 4).alias("acctbal")))
_add("origination_mix", lambda s, d: C.mix(B.loans(s, d), "vintage", "segment"))
_add("underwriting_quartiles", lambda s, d: C.quartiles(B.loans(s, d), "vintage", "price", "acctbal"))
_add("profile_categorical", lambda s, d: C.screen_categoricals(B.cell_table(s, d), ["segment", "priority"], "loan_months"))
_add("cut_points", lambda s, d: C.cut_points(B.book(s, d), "price"))
_add("frequency_table", lambda s, d: C.frequency_table(B.cell_table(s, d), "segment", "loan_months"))
_add("concentration", lambda s, d: C.concentration(B.cell_table(s, d), ["segment", "outcome"], "loan_months"))
_add("hazard_by_level", lambda s, d: C.exposure_by_level(B.cell_table(s, d), ["segment"]))
_add("macro_monthly", lambda s, d: B.macro(s, d).select("month", F.round("price_index", 6).alias("price_index"), "volume", F.round("discount_rate", 9).alias("discount_rate")))
_add("risk_sets", _risk)
_add("kaplan_meier_greenwood", lambda s, d: S.kaplan_meier(_risk(s, d)).drop("prepayments"))
_add("km_by_segment", lambda s, d: S.kaplan_meier(S.risk_sets(B.cell_table(s, d), ["segment"]), ["segment"]).select("segment", "age", "at_risk", "defaults", "survival"))
_add("vintage_curves", lambda s, d: S.kaplan_meier(S.risk_sets(B.cell_table(s, d), ["vintage"]), ["vintage"]).select("vintage", "age", "at_risk", "defaults", "survival"))
_add("net_entries", lambda s, d: S.net_entries(_risk(s, d)))
_add("aalen_johansen", lambda s, d: S.incidence(_risk(s, d)))
_add("aalen_johansen_se", lambda s, d: S.incidence_error(_risk(s, d)))
_add("curves_cross", lambda s, d: S.curves_cross(S.kaplan_meier(S.risk_sets(B.cell_table(s, d), ["segment"]), ["segment"]), "segment", 20))
_add("late_entry_share", lambda s, d: S.late_entry_share(_risk(s, d)))
_add("actual_vs_expected", lambda s, d: Q.actual_expected(B.scored(s, d), ["vintage"]))
_add("calibration_deciles", lambda s, d: Q.calibration(B.scored(s, d)))
_add("weighted_gini", lambda s, d: Q.gini(B.scored(s, d)))
_add("pd_12m_grade", lambda s, d: Q.grade_table(B.scored(s, d).withColumn("pd_12m", annualised(F.col("hazard")))))
_add("decile_histogram", lambda s, d: Q.histogram_deciles(B.scored(s, d)))
_add("prepayment_cpr", lambda s, d: Q.prepayment_by_month(_both(s, d), "month", "h_prepayment"))
_add("model_incidence", lambda s, d: S.predicted_incidence(_both(s, d)))
_add("grade_rates", lambda s, d: Q.grade_rates(_graded(s, d)))
_add("scored_book", lambda s, d: V.scored_book(_graded(s, d)))
_add("window_criteria", lambda s, d: V.window_criteria(B.scored(s, d), band_label("age", B.AGE_EDGES)))
_add("cycle_in_band", lambda s, d: Q.cycle_in_band(Q.actual_expected(B.scored(s, d).withColumn("year", F.floor(F.col("month") / 12).cast("int")), ["year"])))
_add("thin_months", lambda s, d: Q.covered_months(B.scored(s, d).groupBy("month").agg(F.sum("loan_months").alias("loan_months"))))
_add("age_band_by_vintage", lambda s, d: Q.actual_expected(B.scored(s, d).withColumn("age_band", band_label("age", B.AGE_EDGES)), ["vintage", "age_band"]))
_add("weighted_covariance", lambda s, d: Q.weighted_moments(B.scored(s, d), ["price", "acctbal"]))
_add("anchor_multiplier", lambda s, d: Q.anchor(B.scored(s, d), CUT, CUT + 23))
_add("screen_categoricals", lambda s, d: C.screen_categoricals(B.book(s, d).withColumn("one", F.lit(1)), ["segment", "priority", "status", "nation"], "one"))
_add("covariates_over_time", lambda s, d: V.covariates_over_time(B.scored(s, d), ["price", "acctbal"]))
_add("cell_shape", lambda s, d: C.cell_shape(B.cell_table(s, d), ["segment", "priority", "outcome"]))
_add("levels_of_records", lambda s, d: R.level_counts(s, d))
_add("cells_of_records", lambda s, d: R.record_cells(s, d))


def _both(s, d):
    """Scored cells with hazards of both causes."""
    return B.scored(s, d).withColumns({"h_default": F.col("hazard"), "h_prepayment": weibull_hazard("age", F.lit(5.0) + F.lit(0.00001) * F.col("acctbal"), 0.1)})


def _graded(s, d):
    p = B.scored(s, d).withColumn("pd_12m", F.greatest(annualised(F.col("hazard")), F.lit(Q.FLOOR)))
    return p.withColumn("grade", Q.grade(F.col("pd_12m")))


def _segments():
    return {"segment": F.col("segment"), "priority": F.col("priority")}


@query
def origination_of_records(s, d):
    """Casts, sentinels and regions of raw text records."""
    o = K.origination(R.raw_origination(s, d))
    return o.select("loan", "credit_score", "original_ltv", "original_cltv", "debt_to_income", "original_balance", "note_rate", "orig_term", "insurance_coverage", "region")


def _outcomes_of_records(**options) -> Query:
    return lambda s, d: R.record_book(s, d, **options).groupBy("region", "outcome").agg(F.count("*").alias("loan_months"), F.countDistinct("loan").alias("loans"), F.count_if("left_the_book").alias("left_the_book"), F.min("age").alias("youngest"))


_add("book_of_records", _outcomes_of_records())
_add("book_of_records_censored", _outcomes_of_records(policy=K.Moratorium.CENSOR, complete_only=False))


@query
def calibration_by_year_and_segment(s, d):
    return V.calibration_views(B.scored(s, d), _segments())["actual_expected_by_year"]


@query
def calibration_deciles_by_segment(s, d):
    return V.calibration_views(B.scored(s, d), _segments())["calibration_by_decile"]


@query
def backtest_by_month_and_segment(s, d):
    return V.backtest_views(_graded(s, d), _segments())["by_month"]


@query
def grades_by_segment(s, d):
    return V.backtest_views(_graded(s, d), _segments())["by_grade"]


@query
def to_monthly(s, d):
    """Mean and last value of a daily series."""
    daily = B.table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("price"))
    m, last = X.to_monthly(daily, "date", "price"), X.to_monthly(daily, "date", "price", last=True).withColumnRenamed("price", "last_price")
    return m.join(last, "month").select("month", F.round("price", 4).alias("price"), F.round("last_price", 4).alias("last_price"))


@query
def absorb_not_reported(s, d):
    b = B.book(s, d).withColumn("acctbal", F.when((F.col("segment") == "BUILDING") & (F.col("loan") % 5 == 0), None).otherwise(F.col("acctbal")))
    f = X.absorb_not_reported(b, "acctbal", -1.0, F.col("segment") == "BUILDING")
    return f.groupBy("segment").agg(F.count("acctbal").alias("known"), F.count_if(F.col("acctbal") == -1).alias("absorbed"), F.round(F.sum("acctbal"), 2).alias("acctbal"))


@query
def collinear_pairs(s, d):
    cols = ["price", "acctbal", "age", "month", "origination_month"]
    rows = M.collinear_pairs(cols, M.correlations(B.scored(s, d), cols), 0.5)
    return s.createDataFrame([(a, b, round(r, 6)) for a, b, r in rows], "first string, second string, correlation double")


@query
def cells_in_window(s, d):
    """Cells written by vintage and read again in a window of observation months; files and row groups outside it are not read."""
    path = f"{shared_dir(s)}/cells-{uuid.uuid4().hex}"
    archives.write_cells(B.cell_table(s, d), path)
    w = archives.read_cells(s, path, CUT, CUT + 11, ["segment", "outcome", "observation_month", "loan_months"])
    return w.groupBy("observation_month", "segment", "outcome").agg(F.sum("loan_months").alias("loan_months"))


@query
def book_summary(s, d):
    o = QUERIES["outstanding_by_month"](s, d)
    return C.book_summary(B.loans(s, d), o, B.table(s, d, "lineitem").count(), B.cell_table(s, d))


@query
def calendar_verdict(s, d):
    return X.calendar_verdict(calendar_lag_correlation(s, d))


@query
def weighted_mean_by_id(s, d):
    """Hazards of loans weighted by balances that are listed in another order."""
    v = B.loans(s, d).groupBy("segment", "priority").agg(F.avg("acctbal").alias("x")).withColumn("id", F.concat_ws("/", "segment", "priority"))
    w = B.loans(s, d).groupBy(F.concat_ws("/", "segment", "priority").alias("id")).agg(F.count("*").alias("w"))
    return P.weighted_mean_by_id(v, w, "id", "x", "w")


@query
def classed_with_labels(s, d):
    b = B.book(s, d).withColumns(binned(B.EDGES))
    return b.groupBy("price_binned", "price_band", "acctbal_binned", "acctbal_band").agg(F.count("*").alias("loan_months"))


@query
def loan_family(s, d):
    """Indexed loan-to-value and the refinancing incentive on the panel of loans."""
    b = B.book(s, d).select("loan", "month", "origination_month", (60 + F.col("loan") % 40).cast("double").alias("original_ltv"), (F.col("acctbal") / 1000).alias("note_rate"))
    f = X.add_loan_family(b, B.macro(s, d), ["price_index", "discount_rate"], {"gap_discount": X.gap("discount_rate")}, "price_index", "discount_rate")
    return f.groupBy("month").agg(F.count("*").alias("loan_months"), F.round(F.avg("indexed_cltv"), 6).alias("indexed_cltv"), F.round(F.avg("refinance_incentive"), 6).alias("refinance_incentive"), F.round(F.avg("gap_discount"), 9).alias("gap_discount"))


@query
def projected_vintages(s, d):
    """Each vintage's loans at age 0 projected along both causes, beside what was observed of it."""
    start = _both(s, d).where("age = 0").groupBy("vintage", "price", "acctbal", "segment", "priority").agg(F.sum("loan_months").alias("weight"))
    eta = F.lit(4.6) - F.lit(0.002) * F.col("price") / 1000 + F.lit(0.00002) * F.col("acctbal") + F.when(F.col("segment") == "BUILDING", 0.2).otherwise(0.0)
    x = start.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(23))))
    x = x.withColumns({"h_default": weibull_hazard("step", eta, B.LOG_SHAPE), "h_prepayment": weibull_hazard("step", F.lit(5.0) + F.lit(0.00001) * F.col("acctbal"), 0.1)})
    paths = S.competing_paths(x, ["vintage", "price", "acctbal", "segment", "priority"])
    return S.projected_against_observed(paths, S.incidence(S.risk_sets(B.cell_table(s, d), ["vintage"]), ["vintage"]), ["vintage"])


@query
def projection_by_segment(s, d):
    """Term structure and scenarios by segment: PD paths of the book's loans at age 0 under two levels of the hazard, for the whole and every segment."""
    p = B.cell_table(s, d).where("age = 0").groupBy("segment", "price", "priority").agg(F.sum("loan_months").alias("weight"))
    eta = F.lit(4.6) - F.lit(0.002) * F.col("price") / 1000 + F.when(F.col("segment") == "BUILDING", 0.2).otherwise(0.0)
    x = p.withColumn("scenario", F.explode(F.array(F.lit("base"), F.lit("adverse")))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(11))))
    x = x.withColumn("hazard", F.least(weibull_hazard("step", eta, B.LOG_SHAPE) * F.when(F.col("scenario") == "adverse", 1.5).otherwise(1.0), F.lit(1.0)))
    paths = S.survival_path(x, ["scenario", "segment", "price", "priority"])
    return V.projection_views(paths, _segments())


@query
def incomplete_cases(s, d):
    return C.incomplete_cases(B.book(s, d), "vintage", {"nation": (F.col("nation") % 7 == 3) & (F.col("segment") != "BUILDING"), "acctbal": F.col("acctbal") < 0})


@query
def exits_by_code(s, d):
    m = B.months(s, d).join(B.loans(s, d), "loan").where(F.col("month") >= F.col("origination_month"))
    return C.exits_by_code(m.withColumns({"period": F.col("month"), "code": F.when(F.col("prepaid"), F.col("status"))}), "code")


def _by_month(s, d):
    return B.book(s, d).groupBy("month").agg(F.count("*").alias("loan_months"), F.count_if(F.col("outcome") == "default").alias("defaults"))


@query
def defaults_by_month(s, d):
    return C.dense_months(_by_month(s, d), "month", "loan_months", "defaults")


@query
def calendar_lag_correlation(s, d):
    m = _by_month(s, d)
    return X.lag_correlation(m, m, "month", "defaults", "loan_months")


@query
def payment_state(s, d):
    before = F.lag("errors").over(Window.partitionBy("loan").orderBy("age"))
    u = B.user_days(s, d).withColumn("before", before)
    state = F.when(F.col("before").isNull() | (F.col("before") == 0), "current").when(F.col("before") == 1, "one_month").when(F.col("before") == 2, "two_months").otherwise("three_or_more")
    return u.groupBy(state.alias("state")).agg(F.count("*").alias("days"), F.sum("errors").alias("errors"))


@query
def profile_continuous(s, d):
    return C.profile_continuous(B.book(s, d).withColumn("one", F.lit(1)), "price", B.EDGES["price"], "one")


@query
def monotone_bands(s, d):
    return C.is_monotonic(profile_continuous(s, d))


@query
def fill_rate(s, d):
    return C.fill_rate(B.book(s, d).withColumn("nation", F.when(F.col("nation") % 7 == 3, None).otherwise(F.col("nation"))), ["price", "nation"])


@query
def book_by_segment_grouping_sets(s, d):
    n, r = B.table(s, d, "nation"), B.table(s, d, "region")
    b = B.book(s, d).join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")), F.col("nation") == F.col("n_nationkey"))  # 25 rows
    measures = {"loan_months": F.count("*"), "defaults": F.count_if(F.col("outcome") == "default"), "balance": F.round(F.sum("price"), 2)}
    return C.by_segments(b, "month", {"segment": F.col("segment"), "region": F.col("r_name"), "status": F.col("status")}, measures)


@query
def lending_by_segment(s, d):
    first = C.first_month(B.book(s, d), ["vintage", "price", "segment", "priority"])
    t = C.by_segments(first, "vintage", {"segment": F.col("segment"), "priority": F.col("priority")}, {"loans": F.count("*"), "volume": F.round(F.sum("price"), 2)})
    return C.segment_shares(t, "vintage", ["loans", "volume"])


@query
def macro_ffill_trim(s, d):
    m = B.macro(s, d)
    first = m.agg(F.min("month")).first()[0]
    g = m.select("month", F.when(F.col("month") % 5 != 2, F.col("price_index")).alias("price_index"), F.when(F.col("month") >= first + 4, F.col("volume")).alias("volume"))
    return X.fill_and_trim(g, ["price_index", "volume"]).select("month", F.round("price_index", 6).alias("price_index"), "volume")


def _family(value: Callable[[], Column]) -> Query:
    def run(s, d):
        c = B.cell_table(s, d).withColumn("month", F.col("origination_month") + F.col("age"))
        f = X.add_family(c, B.macro(s, d), ["price_index", "volume", "discount_rate"]).withColumn("v", value())
        w = F.col("loan_months")
        known = F.sum(F.when(F.col("v").isNotNull(), w))
        return f.groupBy("origination_month", "age").agg(F.sum(w).alias("loan_months"), known.alias("covered"), F.round(F.try_divide(F.sum(w * F.col("v")), known), 6).alias("value"))

    return run


_add("macro_level", _family(lambda: X.level("discount_rate")))
_add("macro_gap", _family(lambda: X.gap("discount_rate")))
_add("macro_yoy", _family(lambda: X.year_on_year("price_index")))
_add("macro_yoy_gap", _family(lambda: X.year_on_year_gap("price_index")))
_add("macro_term_switch", _family(lambda: X.term_switched_fall(F.col("price"), "discount_rate", "volume", 125_000)))
_add("macro_mark_to_market", _family(lambda: X.mark_to_market(F.lit(80.0), "price_index")))
_add("macro_note_spread", _family(lambda: X.note_rate_spread(F.col("acctbal"), "price_index")))


@query
def regime_flag(s, d):
    c = B.cell_table(s, d).withColumn("month", F.col("origination_month") + F.col("age"))
    return c.groupBy(X.regime("month", CUT, CUT + 18).alias("regime")).agg(F.sum("loan_months").alias("loan_months"))


@query
def episodes_bounds(s, d):
    e = S.episodes(B.cell_table(s, d))
    return e.groupBy("event", "age_start", "age_stop", "lower_bound").agg(F.sum("loan_months").alias("loan_months"), F.count_if(F.col("upper_bound") == float("inf")).alias("right_censored"))


@query
def split_train_test(s, d):
    a, b, mid = _halves(s, d)
    side = F.when(F.col("month") <= mid, "train").otherwise("test")
    return a.unionByName(b).groupBy(side.alias("side")).agg(F.count("*").alias("cells"), F.sum("loan_months").alias("loan_months"), F.sum(Q.hits()).alias("defaults"), F.max("month").alias("last_month"))


@query
def parity_halves(s, d):
    return B.cell_table(s, d).groupBy((F.floor(F.col("origination_month") / 12) % 2).cast("int").alias("half")).agg(F.sum("loan_months").alias("loan_months"))


@query
def panel_validation_report(s, d):
    return S.validate_panel(B.user_days(s, d).select("loan", "age", (F.col("errors") >= 3).alias("event")))


@query
def incidence_gap(s, d):
    m = B.scored(s, d).groupBy("age").agg(F.sum("loan_months").alias("n"), F.sum(Q.hits()).alias("k"), (F.sum(F.col("loan_months") * F.col("hazard")) / F.sum("loan_months")).alias("hz"))
    m = m.withColumn("one", F.lit(1)).withColumn("oh", F.col("k") / F.col("n"))
    p = S.survival_path(S.survival_path(m, ["one"], "age", "oh").withColumn("o", F.col("cumulative_pd")), ["one"], "age", "hz")
    return p.select("age", F.round("o", 8).alias("observed"), F.round("cumulative_pd", 8).alias("predicted"))


@query
def hazard_closed_form(s, d):
    return B.scored(s, d).groupBy("age", "segment").agg(F.round(F.sum(F.col("loan_months") * F.col("hazard")), 6).alias("expected"), F.round(F.max("hazard"), 9).alias("highest"))


@query
def score_month(s, d):
    a, _, mid = _halves(s, d)
    p = a.where(F.col("month") == mid).withColumn("pd", F.greatest(annualised(F.col("hazard")), F.lit(Q.FLOOR))).withColumn("grade", Q.grade(F.col("pd")))
    return p.groupBy("segment", "priority", "grade").agg(F.sum("loan_months").alias("loan_months"), F.round(F.sum(F.col("pd") * F.col("loan_months")) / F.sum("loan_months"), 8).alias("pd_12m"))


@query
def psi_categorical(s, d):
    a, b, _ = _halves(s, d)
    return Q.psi_levels(a, b, "segment")


@query
def psi_numeric(s, d):
    a, b, _ = _halves(s, d)
    return Q.psi_numeric(a, b, "acctbal")


@query
def top_cells(s, d):
    c = B.cell_table(s, d).where("age = 6").select("price", "acctbal", "segment", "priority", "origination_month", "outcome", "vintage", "loan_months")
    return c.orderBy(F.desc("loan_months"), "origination_month", "segment", "priority", "price", "acctbal", "outcome").limit(20)


@query
def observation_window(s, d):
    m = F.col("origination_month") + F.col("age")
    return B.cell_table(s, d).agg(F.min(m).alias("first_month"), F.max(m).alias("last_month"), F.sum("loan_months").alias("loan_months"))


@query
def projection_term_structure(s, d):
    p = B.cell_table(s, d).where("age = 0").groupBy("segment", "price", "priority").agg(F.sum("loan_months").alias("weight"))
    eta = F.lit(4.6) - F.lit(0.002) * F.col("price") / 1000 + F.when(F.col("segment") == "BUILDING", 0.2).otherwise(0.0)
    x = p.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("hazard", weibull_hazard("step", eta, B.LOG_SHAPE))
    return S.term_structure(S.survival_path(x, ["segment", "price", "priority"]), ["segment"])


@query
def competing_paths(s, d):
    """Both causes chained along the ages of each segment, with the hazards the book shows."""
    r = S.risk_sets(B.cell_table(s, d), ["segment"])
    x = r.select("segment", F.col("age").alias("step"), (F.col("defaults") / F.col("at_risk")).alias("h_default"), (F.col("prepayments") / F.col("at_risk")).alias("h_prepayment"))
    return S.competing_paths(x, ["segment"]).select("segment", "step", *[F.round(c, 9).alias(c) for c in ("survival", "incidence_default", "incidence_prepayment")])


@query
def scenario_pd(s, d):
    f = X.extend(B.macro(s, d), ["price_index"], 12, {"base": {}, "adverse": {"price_index": ([-0.1, -0.2, -0.15], True)}}).where("step > 0")
    f = f.withColumn("hazard", 1 - F.exp(-F.exp(-4 - F.col("price_index") / 100_000)))
    return S.survival_path(f, ["scenario"]).select("scenario", "step", F.round("cumulative_pd", 8).alias("cumulative_pd"))


@query
def acceptance_by_segment(s, d):
    return Q.acceptance(B.scored(s, d), ["segment"])


@query
def aft_fit_coefficients(s, d):
    f = M.fit_aft(B.cell_table(s, d).withColumn("price", F.col("price") / 100_000), ["price"])
    return s.createDataFrame([(n, round(b, 6), round(e, 6), round(p, 6)) for n, b, e, _, p, _ in f.table()], "parameter string, coefficient double, standard_error double, p_value double")


@query
def selection_trace(s, d):
    c = B.cell_table(s, d).withColumns({"price": F.col("price") / 100_000, "acctbal": F.col("acctbal") / 1_000})
    _, trace = M.backward_selection(c, ["price", "acctbal"])
    return s.createDataFrame([(k, ",".join(t["covariates"]), t["log_likelihood"], t["aic"], t["dropped"], t["reason"]) for k, t in enumerate(trace)], "step int, covariates string, log_likelihood double, aic double, dropped string, reason string")


@query
def selection_procedure(s, d):
    """The whole procedure over the stand-in cells: what became of every candidate."""
    c = B.cell_table(s, d).withColumn("month", F.col("origination_month") + F.col("age"))
    m = B.macro(s, d).withColumns({"price_index": F.col("price_index") / 100_000, "volume": F.col("volume") / 100})
    c = X.add_family(c, m, ["price_index", "volume", "discount_rate"]).withColumns({"price": F.col("price") / 100_000, "acctbal": F.col("acctbal") / 1_000, "index_level": X.level("price_index"), "volume_level": X.level("volume"), "rate_gap": X.gap("discount_rate")})
    c = c.na.drop(subset=["index_level", "volume_level", "rate_gap"])
    r = L.run_selection(c, ["price", "acctbal"], ["index_level", "volume_level", "rate_gap"], {"index_level": 1}, {"index_level": "activity", "volume_level": "activity"}, L.origination_halves())
    kept = L.terms(r.fit)
    rows = [(n, n in kept, round(kept[n]["coefficient"], 6) if n in kept else None, r.eliminated.get(n)) for n in ("price", "acctbal", "index_level", "volume_level", "rate_gap")]
    return s.createDataFrame(rows, "covariate string, kept boolean, coefficient double, reason string")


@query
def vif(s, d):
    cols = ["price", "acctbal", "age"]
    v = M.vif(M.correlations(B.cell_table(s, d), cols))
    return s.createDataFrame([(c, round(float(x), 6)) for c, x in zip(cols, v, strict=True)], "covariate string, vif double")


@query
def baseline_probe(s, d):
    p = M.baseline_probe([(r.age, r.at_risk, r.defaults) for r in _risk(s, d).orderBy("age").collect()])  # a row per age
    return s.createDataFrame([(f, round(p[f]["aic"], 4), f == p["best"]) for f in ("constant", "weibull", "spline")], "baseline string, aic double, best boolean")


_add("cells_fine", lambda s, d: C.cells(B.book(s, d), C.CellSpec(B.FINE, ("segment", "priority"))))
_add("cells_narrow", lambda s, d: C.cells(B.book(s, d), C.CellSpec({}, ("segment",))))
_add("defaults_by_month_from_cells", lambda s, d: C.dense_months(B.scored(s, d).groupBy("month").agg(F.sum("loan_months").alias("loan_months"), F.sum(Q.hits()).alias("defaults")), "month", "loan_months", "defaults"))
_add("durations_reconstructed", lambda s, d: P.durations(_risk(s, d)))
_add("survival_by_stratum", lambda s, d: S.kaplan_meier(S.risk_sets(B.cell_table(s, d), ["price"]), ["price"]).select("price", "age", "at_risk", "defaults", "survival"))
_add("outcomes_by_age", lambda s, d: P.outcomes_by_age(B.cell_table(s, d)))
_add("macro_long", lambda s, d: P.unpivoted(B.macro(s, d), ["month"], ["price_index", "volume", "discount_rate"]).withColumn("value", F.round("value", 6)))
_add("at_origination", lambda s, d: P.at_origination(B.user_days(s, d)))


@query
def to_loan_level(s, d):
    u = B.user_days(s, d).select("loan", "age", (F.col("errors") >= 3).alias("event"), F.when(F.col("events") > 1, F.col("events")).alias("events"))
    return P.to_loan_level(u, ["events"])


@query
def stability_report(s, d):
    a, b, _ = _halves(s, d)
    return P.stability(a, b, ["segment", "priority"], ["acctbal", "price"])


@query
def macro_as_of(s, d):
    m = B.macro(s, d).select("month", F.when(F.col("month") % 4 == 1, F.col("price_index")).alias("price_index"))
    c = B.cell_table(s, d).groupBy((F.col("origination_month") + F.col("age")).alias("month")).agg(F.sum("loan_months").alias("loan_months"))
    return P.as_of(c, m, "month", ["price_index"]).withColumn("price_index", F.round("price_index", 6))


@query
def conditional_pd(s, d):
    p = B.cell_table(s, d).where("age = 0").groupBy("segment", "price").agg(F.sum("loan_months").alias("weight"))
    eta = F.lit(4.6) - F.lit(0.002) * F.col("price") / 1000 + F.when(F.col("segment") == "BUILDING", 0.2).otherwise(0.0)
    x = p.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("hazard", weibull_hazard(F.col("step") + 6, eta, B.LOG_SHAPE))
    return S.survival_path(x, ["segment", "price"]).where("step = 11").select("segment", "price", F.round("cumulative_pd", 8).alias("pd_12m"))


@query
def marginal_families(s, d):
    rows = [(r.duration, r.event, r.loans) for r in P.durations(_risk(s, d)).collect()]  # a row per duration and event
    return s.createDataFrame([(r["family"], round(r["aic"], 4), round(r["log_scale"], 5)) for r in P.marginal_families(rows)], "family string, aic double, log_scale double")
