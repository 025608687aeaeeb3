"""Column builders: classing, labels, calendar, annuities, hazards. No UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: C) -> Column:
    return _c(c).try_cast("double")


def to_int(c: C) -> Column:
    """Whole number of a text; '3.0' is 3, 'RA' is null."""
    return _c(c).try_cast("double").try_cast("int")


def without_sentinel(c: Column, sentinel: float) -> Column:
    return F.nullif(c, F.lit(float(sentinel)))


def flag(c: Column) -> Column:
    """A predicate that is never null."""
    return F.coalesce(c, F.lit(False))


def midpoint(c: C, edges: Sequence[float]) -> Column:
    """Coarse classing: the midpoint of the right-closed band, outer bands clamped, null kept."""
    c = _c(c)
    out = F.when(c.isNull(), F.lit(None).cast("double")).when(c <= edges[0], F.lit((edges[0] + edges[1]) / 2))
    for lo, hi in pairwise(edges):
        out = out.when(c <= hi, F.lit((lo + hi) / 2))
    return out.otherwise(F.lit((edges[-2] + edges[-1]) / 2))


def band_label(c: C, edges: Sequence[float], missing: str | None = None) -> Column:
    """Label of the left-closed band; outer bands are open."""
    c = _c(c)
    number = lambda x: f"{x:g}"
    out = F.when(c.isNull(), F.lit(missing)).when(c < edges[1], F.lit(f"under {number(edges[1])}"))
    for lo, hi in pairwise(edges[1:-1]):
        out = out.when(c < hi, F.lit(f"{number(lo)} to {number(hi)}"))
    return out.otherwise(F.lit(f"{number(edges[-2])} and over"))


def band_index(c: C, edges: Sequence[float]) -> Column:
    """Number of the right-closed band from 0; missing is -1."""
    c = _c(c)
    out = F.when(c.isNull(), F.lit(-1))
    for k, hi in enumerate(edges[1:-1]):
        out = out.when(c <= hi, F.lit(k))
    return out.otherwise(F.lit(len(edges) - 2))


def binned(columns: Mapping[str, Sequence[float]], missing: str | None = None) -> dict[str, Column]:
    """For each covariate its class's midpoint (name_binned) and the label of its band (name_band), for withColumns."""
    return {f"{n}_binned": midpoint(n, e) for n, e in columns.items()} | {f"{n}_band": band_label(n, e, missing) for n, e in columns.items()}


def binned_formula(formula: str, columns: Iterable[str]) -> str:
    """A formula whose terms read the classed form of the given columns."""
    names = "|".join(re.escape(c) for c in sorted(columns, key=len, reverse=True))
    return re.sub(rf"(?<![\w.])({names})(?![\w.])", r"\1_binned", formula) if names else formula


def mapped(c: C, levels: Mapping[str, str]) -> Column:
    """Level of a code; a code without a level is null."""
    c, out = _c(c), None
    for code, level in levels.items():
        out = F.when(c == code, F.lit(level)) if out is None else out.when(c == code, F.lit(level))
    return out


def month_ordinal(date: C) -> Column:
    """Months since year 0 of a date or timestamp."""
    return (F.year(_c(date)) * 12 + F.month(_c(date)) - 1).cast("int")


def ordinal_of_yyyymm(c: C) -> Column:
    c = _c(c).cast("int")
    return (F.floor(c / 100) * 12 + c % 100 - 1).cast("int")


def yyyymm(ordinal: C) -> Column:
    o = _c(ordinal)
    return (F.floor(o / 12) * 100 + o % 12 + 1).cast("int")


def age_floor(age: C, step: int) -> Column:
    return (F.floor(_c(age) / step) * step).cast("int")


def annuity(rate: Column, months: Column) -> Column:
    """Present value of one a month at a yearly rate in percent."""
    monthly = rate / 1200.0
    return F.when(rate > 0, (1 - F.pow(1 + monthly, -months)) / F.when(rate > 0, monthly)).otherwise(months.cast("double"))


def diminished_obligation(note_rate: Column, new_rate: Column, new_term: Column) -> Column:
    """Share of net present value that a restructuring gives up, at the original rate."""
    return 1 - annuity(note_rate, new_term) / F.nullif(annuity(new_rate, new_term), F.lit(0.0))


def weibull_hazard(age: C, log_scale: Column, log_shape: Column | float) -> Column:
    """Probability to end in (age, age + 1], given survival to age."""
    shape = F.exp(log_shape if isinstance(log_shape, Column) else F.lit(float(log_shape)))
    scale = F.exp(log_scale)
    rise = F.pow((_c(age) + 1) / scale, shape) - F.pow(_c(age) / scale, shape)
    return -F.expm1(-rise)


def log_logistic_hazard(age: C, log_scale: Column, log_shape: Column | float) -> Column:
    shape = F.exp(log_shape if isinstance(log_shape, Column) else F.lit(float(log_shape)))
    scale = F.exp(log_scale)
    total = lambda t: F.log1p(F.pow(t / scale, shape))
    return -F.expm1(-(total(_c(age) + 1) - total(_c(age))))


def annualised(hazard: Column, months: int = 12) -> Column:
    return 1 - F.pow(1 - hazard, F.lit(float(months)))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)
