"""Monthly series and the covariates made of them. A lag is a shift of the join key; series are a few hundred rows and broadcast after a size check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAG = 3
#: Rows up to which a macro table is broadcast (a hundred thousand months of 50 doubles are 40 MB).
BROADCAST_ROWS = 100_000


def to_monthly(series: DataFrame, date: str, value: str, last: bool = False) -> DataFrame:
    """Mean of the month, or its last value."""
    m = (F.year(date) * 12 + F.month(date) - 1).cast("int").alias("month")
    return series.groupBy(m).agg((F.max_by(value, date) if last else F.avg(value)).alias(value))


def fill_and_trim(series: DataFrame, columns: Sequence[str], month: str = "month") -> DataFrame:
    """Every month where all series have begun and none has ended, inner gaps filled forward."""
    spine = series.agg(F.explode(F.sequence(F.min(month), F.max(month))).alias(month))
    w = Window.orderBy(month)  # a row per month
    s = spine.join(series, month, "left")
    s = s.withColumns({c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns} | {f"has_{c}": F.col(c).isNotNull() for c in columns})
    bounds = s.agg(*[F.min(F.when(F.col(f"has_{c}"), F.col(month))).alias(f"lo_{c}") for c in columns], *[F.max(F.when(F.col(f"has_{c}"), F.col(month))).alias(f"hi_{c}") for c in columns])
    b = bounds.select(F.greatest(*[f"lo_{c}" for c in columns], F.lit(-(2**31))).alias("lo"), F.least(*[f"hi_{c}" for c in columns], F.lit(2**31 - 1)).alias("hi"))
    return s.crossJoin(F.broadcast(b)).where(F.col(month).between(F.col("lo"), F.col("hi"))).select(month, *columns)


def at(frame: DataFrame, macro: DataFrame, when: Column, prefix: str, columns: Sequence[str], offset: int = 0, small: bool = False) -> DataFrame:
    """Adds the series' values of another month: when - offset. small: the table's size was checked, it may be broadcast."""
    m = macro.select((F.col("month") + offset).alias(f"{prefix}_month"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    m = F.broadcast(m) if small else m
    return frame.join(m, when == F.col(f"{prefix}_month"), "left").drop(f"{prefix}_month")


def add_family(frame: DataFrame, macro: DataFrame, columns: Sequence[str], observed: str = "month", origin: str = "origination_month", lag: int = LAG) -> DataFrame:
    """obs_, orig_, obs12_, orig12_ columns of every series, lagged.

    The series are read once: a table of months that the check allows is taken to the driver (some hundred rows) and joined from there; a larger one is joined as it is.
    """
    rows = macro.select("month", *columns).limit(BROADCAST_ROWS + 1).toArrow()
    small = rows.num_rows <= BROADCAST_ROWS
    macro = frame.sparkSession.createDataFrame(rows) if small else macro
    for prefix, when, more in (("obs", observed, 0), ("orig", origin, 0), ("obs12", observed, 12), ("orig12", origin, 12)):
        frame = at(frame, macro, F.col(when), prefix, columns, lag + more, small)
    return frame


def level(x: str) -> Column:
    return F.col(f"obs_{x}")


def gap(x: str) -> Column:
    return F.col(f"obs_{x}") - F.col(f"orig_{x}")


def year_on_year(x: str, at: str = "obs") -> Column:
    return F.try_divide(F.col(f"{at}_{x}"), F.col(f"{at}12_{x}")) - 1


def year_on_year_gap(x: str) -> Column:
    return year_on_year(x) - year_on_year(x, "orig")


def term_switched_fall(term: Column, short: str, long: str, years: int = 20) -> Column:
    return -F.when(term <= years, gap(short)).otherwise(gap(long))


def mark_to_market(ltv: Column, index: str) -> Column:
    return ltv * F.try_divide(F.col(f"orig_{index}"), F.col(f"obs_{index}")) - ltv


def note_rate_spread(note: Column, market: str, at: str = "orig") -> Column:
    return note - F.col(f"{at}_{market}")


def regime(month: str, first: int, last: int) -> Column:
    return F.col(month).between(first, last).cast("int")


def absorb_not_reported(frame: DataFrame, column: str, value: float, only_if: Column) -> DataFrame:
    """Fills a missing covariate where it may be missing; anywhere else a missing value is an error in that row."""
    wrong = F.col(column).isNull() & ~F.coalesce(only_if, F.lit(False))
    return frame.withColumn(column, F.when(wrong, F.raise_error(F.lit(f"{column} is missing where it must not be")).cast("double")).otherwise(F.coalesce(F.col(column), F.lit(float(value)))))


def extend(macro: DataFrame, columns: Sequence[str], months: int, shocks: Mapping[str, Mapping[str, tuple[list[float], bool]]]) -> DataFrame:
    """The last month held for `months` months, once per scenario. shocks: scenario -> series -> (deviations by step, whether they are proportional); the last one stays."""
    last = macro.orderBy(F.desc("month")).limit(1)
    future = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(months)))).withColumn("month", (F.col("month") + F.col("step")).cast("int"))
    out = None
    for scenario, legs in shocks.items():
        f = macro.withColumn("step", F.lit(0)).unionByName(future).withColumn("scenario", F.lit(scenario))
        for series, (path, proportional) in legs.items():
            a = F.array(*[F.lit(float(x)) for x in path])
            dev = F.when(F.col("step") > 0, F.get(a, F.least(F.col("step"), F.lit(len(path))) - 1)).otherwise(0.0)
            f = f.withColumn(series, F.col(series) * (1 + dev) if proportional else F.col(series) + dev)
        out = f if out is None else out.unionByName(f)
    return out


def add_loan_family(frame: DataFrame, macro: DataFrame, columns: Sequence[str], built: Mapping[str, Column], index: str, market: str, ltv: str = "original_ltv", note: str = "note_rate", observed: str = "month", lag: int = LAG) -> DataFrame:
    """The family on a panel of loans: `built` columns, and, where the loan has what they read, indexed_cltv (value at origination moved with the index, lagged as the family is) and
    refinance_incentive (note rate against the market of the month itself, not lagged). Rows that lack any of `built` go."""
    f = add_family(frame, macro, columns, observed, lag=lag).withColumns(dict(built))
    if ltv in frame.columns:
        f = f.withColumn("indexed_cltv", F.col(ltv) + mark_to_market(F.col(ltv), index))
    if note in frame.columns:
        f = at(f, macro, F.col(observed), "now", [market]).withColumn("refinance_incentive", note_rate_spread(F.col(note), market, "now"))
    return f.na.drop(subset=list(built))


def calendar_verdict(correlations: DataFrame) -> DataFrame:
    """The shift at which two series fit best (ties: the smaller, then the earlier), and whether that is none."""
    best = F.max_by("shift", F.struct("correlation", -F.abs("shift"), -F.col("shift")))
    return correlations.where("correlation is not null").agg(best.alias("best_shift"), F.max("correlation").alias("correlation")).withColumn("calendar_is_right", F.col("best_shift") == 0)


def lag_correlation(a: DataFrame, b: DataFrame, month: str, x: str, y: str, reach: int = 6) -> DataFrame:
    """Correlation of two monthly series at shifts of -reach to reach; with a calendar that is right it peaks where it should. Both lie on every month from the first to the last of
    either, a month that one lacks counts as zero, and a shifted month beyond either end is left out."""
    ends = a.select(F.col(month).alias("m")).unionByName(b.select(F.col(month).alias("m"))).agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    spine = ends.select(F.explode(F.sequence("lo", "hi")).alias(month))
    left = spine.join(a.select(month, x), month, "left").select(month, F.coalesce(F.col(x), F.lit(0)).alias("still"))
    right = spine.join(b.select(month, F.col(y).alias("y")), month, "left").select(month, F.coalesce("y", F.lit(0)).alias("moved"))
    shifts = a.sparkSession.range(-reach, reach + 1).select(F.col("id").cast("int").alias("shift"))
    moved = right.crossJoin(F.broadcast(shifts)).select((F.col(month) + F.col("shift")).alias(month), "shift", "moved")  # months x shifts, both bounded by the calendar
    return moved.join(left, month).groupBy("shift").agg(F.round(F.corr("still", "moved"), 6).alias("correlation"), F.count("*").alias("months"))
