"""Cells and descriptive aggregates. One GROUP BY each; weights are loan-months."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortica.functions.columns import age_floor, band_index, midpoint, share
from cohortica.operators.book import DEFAULT, PREPAYMENT

#: The bands of the production key, what the cell table is capped at and the margin a projection is read with, quantiles that propose cut points, least share of a level, share that dominates.
PRODUCTION_EDGES = {"credit_score": (580.0, 660.0, 700.0, 740.0, 760.0, 820.0), "original_ltv": (30.0, 70.0, 80.0, 90.0, 100.0), "debt_to_income": (10.0, 28.0, 36.0, 43.0, 55.0)}
CELL_CEILING, PROJECTION_MARGIN = 250_000_000, 1.14
QUANTILES = (0.05, 0.20, 0.40, 0.60, 0.80, 0.95)
LEAST_SHARE, DOMINANT = 0.05, 0.99


@dataclass(frozen=True)
class CellSpec:
    """The key of the cells: banded covariates, categorical columns (all not null), age step."""

    continuous: Mapping[str, Sequence[float]] = field(default_factory=lambda: PRODUCTION_EDGES)
    categorical: tuple[str, ...] = ("purpose", "occupancy", "term_years", "mortgage_insurance", "buyer_type")
    step: int = 1
    nullable: tuple[str, ...] = ("debt_to_income",)

    def validate(self) -> None:
        for name, edges in self.continuous.items():
            if len(edges) < 3 or list(edges) != sorted(set(edges)):
                raise ValueError(f"edges of {name} must increase")
        if set(self.continuous) & set(self.categorical) or self.step < 1:
            raise ValueError("a covariate is in the key once, and the step is positive")

    def extended(self, *categorical: str, continuous: Mapping[str, Sequence[float]] | None = None) -> CellSpec:
        return replace(self, categorical=(*self.categorical, *categorical), continuous={**self.continuous, **(continuous or {})})

    @property
    def key(self) -> list[str]:
        return [*self.continuous, *self.categorical, "age", "origination_month", "outcome"]


def keyed(book: DataFrame, spec: CellSpec) -> DataFrame:
    """Loan-months with the key's columns: categorical nulls go, null bands stay. Wants age, origination_month, outcome."""
    spec.validate()
    b = book.na.drop(subset=list(spec.categorical)) if spec.categorical else book
    return b.withColumns({n: midpoint(n, e) for n, e in spec.continuous.items()} | {"age": age_floor("age", spec.step)})


def cells(book: DataFrame, spec: CellSpec, *more: str) -> DataFrame:
    """The lossless collapse. more: further key columns, like the vintage."""
    return keyed(book, spec).groupBy(*spec.key, *more).agg(F.count("*").alias("loan_months"))


def compression(book: DataFrame, spec: CellSpec) -> DataFrame:
    c = cells(book, spec).agg(F.count("*").alias("cells"), F.sum("loan_months").alias("loan_months"))
    return c.withColumn("compression", F.round(F.col("loan_months") / F.col("cells"), 6))


def extension_cost(book: DataFrame, base: CellSpec, extensions: Mapping[str, CellSpec], ceiling: int = CELL_CEILING, margin: float = PROJECTION_MARGIN) -> DataFrame:
    """Cells of each specification against the base's, in one pass: a distinct count of the key's struct per specification."""
    named = {"base": base, **extensions}

    def key(name: str, s: CellSpec) -> Column:
        parts = [F.coalesce(midpoint(c, e).cast("string"), F.lit("-")) for c, e in s.continuous.items()] + [F.col(c).cast("string") for c in s.categorical]
        parts += [age_floor("age", s.step).cast("string"), F.col("origination_month").cast("string"), F.col("outcome")]
        whole = F.concat_ws("|", *parts)
        for c in s.categorical:
            whole = F.when(F.col(c).isNotNull(), whole)
        return F.when(whole.isNotNull(), F.struct(F.lit(name).alias("specification"), whole.alias("key")))

    kept = [key(n, s) for n, s in named.items()]
    d = book.select(F.explode(F.array(*kept)).alias("k")).where("k is not null").select("k.specification", "k.key").distinct()
    n = d.groupBy("specification").agg(F.count("*").alias("cells"))
    first = F.max(F.when(F.col("specification") == "base", F.col("cells"))).over(Window.partitionBy())
    return n.withColumns({"ratio": F.round(F.col("cells") / first, 6), "fits": F.col("cells") * margin <= ceiling})


def outcome_rate(df: DataFrame, by: Sequence[str | Column], weight: Column | None = None, cause: str = DEFAULT) -> DataFrame:
    """loan_months, events, rate by any columns."""
    w = weight if weight is not None else F.lit(1)
    hit = F.sum(F.when(F.col("outcome") == cause, w).otherwise(0))
    return df.groupBy(*by).agg(F.sum(w).cast("long").alias("loan_months"), hit.cast("long").alias("events")).withColumn("rate", F.round(share(F.col("events"), F.col("loan_months")), 9))


def exposure_by_level(df: DataFrame, by: Sequence[str], weight: str = "loan_months") -> DataFrame:
    """Exposure, its share, default and prepayment rates of each level."""
    w = F.sum(weight)
    part = lambda c: F.round(share(F.sum(F.when(F.col("outcome") == c, F.col(weight)).otherwise(0)), w), 9)
    return df.groupBy(*by).agg(w.cast("long").alias("loan_months"), part(DEFAULT).alias("default_rate"), part(PREPAYMENT).alias("prepayment_rate")).withColumn("share", F.round(share(F.col("loan_months"), F.sum("loan_months").over(Window.partitionBy())), 9))  # a row per level


def dense_months(counts: DataFrame, month: str, *values: str) -> DataFrame:
    """All months between the first and the last, 0 where there is none."""
    spine = counts.agg(F.explode(F.sequence(F.min(month), F.max(month))).alias(month))
    return spine.join(counts, month, "left").na.fill(0, subset=list(values))


def incomplete_cases(loans: DataFrame, by: str, missing: Mapping[str, Column]) -> DataFrame:
    """Loans per group, those that would be dropped, how many lack each field (a loan can lack several), default rates of the loans kept and dropped, and their ratio. Wants one row per loan and month; a loan lacks a field if any of its months does."""
    one = loans.groupBy(by, "loan").agg(*[F.bool_or(c).alias(f"no_{n}") for n, c in missing.items()], F.bool_or(F.col("outcome") == DEFAULT).alias("bad"))
    dropped = F.lit(False)
    for n in missing:
        dropped = dropped | F.col(f"no_{n}")
    one = one.withColumn("dropped", dropped)
    bad = F.col("bad").cast("int")
    g = one.groupBy(by).agg(F.count("*").alias("loans"), F.count_if("dropped").alias("dropped"), *[F.count_if(f"no_{n}").alias(f"no_{n}") for n in missing], F.avg(F.when(~F.col("dropped"), bad)).alias("k"), F.avg(F.when(F.col("dropped"), bad)).alias("d"))
    return g.select(by, "loans", "dropped", *[f"no_{n}" for n in missing], F.round("k", 9).alias("default_rate_kept"), F.round("d", 9).alias("default_rate_dropped"), F.round(F.col("dropped") / F.col("loans"), 9).alias("dropped_share"), F.round(share(F.col("d"), F.col("k")), 6).alias("relative_risk"))


def first_month(book: DataFrame, columns: Sequence[str], loan: str = "loan", month: str = "month") -> DataFrame:
    """Each loan once, with the attributes of its first month in the book."""
    return book.groupBy(loan).agg(F.min_by(F.struct(*columns), month).alias("first")).select(loan, *[F.col("first")[c].alias(c) for c in columns])


def segment_shares(table: DataFrame, dimension: str, measures: Sequence[str]) -> DataFrame:
    """Share of each measure in the whole of its dimension's value. Wants the rows of by_segments."""
    w = Window.partitionBy(dimension)
    whole = lambda c: F.max(F.when(F.col("segment") == "all", F.col(c))).over(w)
    return table.withColumns({f"{c}_share": F.round(share(F.col(c), whole(c)), 9) for c in measures})


def book_summary(loans: DataFrame, outstanding: DataFrame, records: int, cells: DataFrame) -> DataFrame:
    """One row of counts, each of something else: loans and amount written (vintage, price), rows of the records, loan-months outstanding and their peaks (contracts, balance), loan-months and defaults in the cells."""
    a = loans.agg(F.concat_ws(" - ", F.min("vintage"), F.max("vintage")).alias("vintages"), F.count("*").alias("loans_originated"), F.round(F.sum("price"), 2).alias("amount_originated"))
    b = outstanding.agg(F.sum("contracts").alias("loan_months_outstanding"), F.max("contracts").alias("peak_contracts"), F.max("balance").alias("peak_balance"))
    c = cells.agg(F.sum("loan_months").alias("loan_months_modelled"), F.sum(F.when(F.col("outcome") == DEFAULT, F.col("loan_months")).otherwise(0)).alias("defaults_modelled"))
    # a row each
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).withColumn("records", F.lit(records).cast("long"))


def cell_shape(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """covariate, levels (sorted) of the categorical columns, and as covariate `age` the episode's width: the least gap between distinct ages, 1 if there is but one."""
    gap = F.col("age") - F.lag("age").over(Window.orderBy("age"))  # a row per age
    width = cells.select("age").distinct().select(gap.alias("gap")).agg(F.coalesce(F.min("gap"), F.lit(1)).alias("w"))
    levels = cells.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns])
    long = levels.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("covariate", "l")).select("covariate", F.array_join("l", "|").alias("levels"))
    return long.unionByName(width.select(F.lit("age").alias("covariate"), F.col("w").cast("string").alias("levels")))


def exits_by_code(months: DataFrame, code: str) -> DataFrame:
    """Loans that end with each code: in all, those that had defaulted before, those censored before."""
    w = Window.partitionBy("loan")
    first = lambda c: F.min(F.when(F.col(c), F.col("period"))).over(w)
    m = months.withColumns({"d": first("defaulted"), "e": first("ends")}).where(F.col(code).isNotNull())
    last = m.groupBy("loan", code).agg(F.min("period").alias("at"), F.first("d").alias("d"), F.first("e").alias("e"))
    return last.groupBy(code).agg(F.count("*").alias("loans"), F.count_if(F.col("d") < F.col("at")).alias("defaulted_before"), F.count_if(F.col("e") < F.col("at")).alias("censored_before"), F.count_if(F.col("d") == F.col("at")).alias("defaulted_at_exit"))


def by_segments(df: DataFrame, dimension: str, segments: Mapping[str, Column], measures: Mapping[str, Column], missing: str = "not mapped") -> DataFrame:
    """segment, group, dimension, measures for the whole and for every segment: GROUPING SETS over one scan."""
    names = list(segments)
    d = df.withColumns({f"g_{n}": F.coalesce(c.cast("string"), F.lit(missing)) for n, c in segments.items()})
    cols = [F.col(f"g_{n}") for n in names]
    g = d.groupingSets([[F.col(dimension)], *[[F.col(dimension), c] for c in cols]], F.col(dimension), *cols)
    g = g.agg(*[m.alias(k) for k, m in measures.items()], F.grouping_id().alias("g"))
    n = len(names)
    code = lambda k: sum(1 << (n - 1 - j) for j in range(n) if j != k)
    whole = (1 << n) - 1
    segment, group = F.when(F.col("g") == whole, "all"), F.when(F.col("g") == whole, "all")
    for k, name in enumerate(names):
        segment, group = segment.when(F.col("g") == code(k), name), group.when(F.col("g") == code(k), F.col(f"g_{name}"))
    return g.select(segment.alias("segment"), group.alias("group"), dimension, *measures)


def mix(df: DataFrame, year: str, column: str) -> DataFrame:
    """Share of each level in its year."""
    n = df.groupBy(year, column).agg(F.count("*").alias("loans"))
    return n.withColumn("share", F.round(F.col("loans") / F.sum("loans").over(Window.partitionBy(year)), 9))


def quartiles(df: DataFrame, year: str, *columns: str) -> DataFrame:
    """Exact quartiles by year, long: year, covariate, q25, q50, q75."""
    a = df.groupBy(year).agg(*[F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(c) for c in columns])
    long = a.select(year, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("covariate", "q"))
    return long.select(year, "covariate", *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("q25", "q50", "q75"))])


def frequency_table(df: DataFrame, column: str, weight: str) -> DataFrame:
    """Exposure and share of every level, with a row for missing even where nothing is."""
    n = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<missing>")).alias("level")).agg(F.sum(weight).cast("long").alias("exposure"))
    none = df.sparkSession.createDataFrame([("<missing>", 0)], "level string, exposure long")
    n = n.unionByName(none).groupBy("level").agg(F.sum("exposure").alias("exposure"))
    return n.withColumn("share", F.round(share(F.col("exposure"), F.sum("exposure").over(Window.partitionBy())), 9))


def concentration(df: DataFrame, columns: Sequence[str], weight: str, dominant: float = DOMINANT) -> DataFrame:
    """Largest level of each column that is not missing, its share of all exposure, the number of such levels, and whether it dominates. Ties: the greater level. A column that is always missing has largest null, share 1, and dominates."""
    long = df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("<missing>")) for c in columns]))).alias("covariate", "level"), F.col(weight).alias("w"))
    n = long.groupBy("covariate", "level").agg(F.sum("w").alias("w"))
    there = F.col("level") != "<missing>"
    g = n.groupBy("covariate").agg(F.max_by(F.when(there, F.col("level")), F.when(there, F.struct("w", "level"))).alias("level"), F.coalesce(F.max(F.when(there, F.col("w"))) / F.sum("w"), F.lit(1.0)).alias("s"), F.count_if(there).alias("levels"))
    return g.select("covariate", F.col("level").alias("largest"), F.round("s", 9).alias("share"), "levels", (F.col("s") >= dominant).alias("dominated"))


def screen_categoricals(df: DataFrame, columns: Sequence[str], weight: str, least: float = LEAST_SHARE) -> DataFrame:
    """Exposure, default rate and verdict of every level of many covariates in one pass: a level below the least share is to be merged."""
    long = df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("<missing>")) for c in columns]))).alias("covariate", "level"), "outcome", F.col(weight).alias("w"))
    n = long.groupBy("covariate", "level").agg(F.sum("w").cast("long").alias("loan_months"), F.sum(F.when(F.col("outcome") == DEFAULT, F.col("w")).otherwise(0)).cast("long").alias("defaults"))
    part = F.col("loan_months") / F.sum("loan_months").over(Window.partitionBy("covariate"))
    verdict = F.when(part < least, "merge: below minimum share").otherwise("keep")
    return n.withColumns({"share": F.round(part, 9), "default_rate": F.round(F.col("defaults") / F.col("loan_months"), 9), "verdict": verdict})


def profile_continuous(df: DataFrame, column: str, edges: Sequence[float], weight: str) -> DataFrame:
    """Exposure and default rate of every band (missing: -1)."""
    d = df.withColumn("band", band_index(column, edges))
    return outcome_rate(d, ["band"], F.col(weight)).withColumnRenamed("events", "defaults").withColumnRenamed("rate", "default_rate")


def is_monotonic(profile: DataFrame) -> DataFrame:
    """Whether the default rate of the bands that are not missing only rises or only falls."""
    step = F.col("default_rate") - F.lag("default_rate").over(Window.orderBy("band"))  # a row per band
    s = profile.where("band >= 0").select(step.alias("s"))
    return s.agg(F.count("s").alias("steps"), (F.coalesce(F.min("s"), F.lit(0)) >= 0).alias("rises"), (F.coalesce(F.max("s"), F.lit(0)) <= 0).alias("falls"))


def cut_points(df: DataFrame, column: str, at: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact quantiles of a covariate, as candidate band edges."""
    q = df.agg(F.percentile(column, F.array(*map(F.lit, at))).alias("q"))
    return q.select(F.posexplode("q").alias("k", "cut")).select((F.col("k") + 1).alias("k"), F.round("cut", 3).alias("cut"))


def fill_rate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    a = df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns])
    return a.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("covariate", "r")).select("covariate", F.round("r", 9).alias("fill_rate"))
