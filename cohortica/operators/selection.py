"""Variable selection: correlations, variance inflation, screening, backward elimination, stability, materiality. Each fit is one distributed Newton run, started warm."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortica.operators.metrics import weighted_moments
from cohortica.operators.model import Fit, collinear_pairs, fit_aft, stepwise_vif

#: Pairs that say the same thing, inflation, significance, and the least effect of a macro covariate per standard deviation.
CORRELATED, INFLATED, SIGNIFICANT, MATERIAL = 0.8, 10.0, 0.05, 0.02


@dataclass
class Record:
    """What each step found, in order."""

    collinear: list[tuple[str, str, float]] = field(default_factory=list)
    inflation: list[tuple[str, float]] = field(default_factory=list)
    screening: list[dict] = field(default_factory=list)
    elimination: list[dict] = field(default_factory=list)
    stability: list[dict] = field(default_factory=list)
    eliminated: dict[str, str] = field(default_factory=dict)
    covariates: list[str] = field(default_factory=list)
    fit: Fit | None = None


def terms(fit: Fit) -> dict[str, dict]:
    return {n: {"coefficient": b, "error": e, "z": z, "p": p} for n, b, e, z, p, _ in fit.table()}


def start_of(fit: Fit | None) -> dict[str, float] | None:
    return fit and dict(zip(fit.names, fit.params.tolist(), strict=True))


def screened(name: str, fit: Fit, base: Fit, deviation: float, sign: int = 0) -> dict:
    """A candidate beside the base: its coefficient, its effect per standard deviation, whether the sign is the declared one (0: none), and twice the gain in log-likelihood."""
    t = terms(fit)[name]
    return {"covariate": name, **t, "effect": t["coefficient"] * deviation, "expected_sign": sign, "sign_agrees": sign == 0 or t["coefficient"] * sign > 0, "statistic": 2 * (fit.log_likelihood - base.log_likelihood)}


def worst(fit: Fit, alone: Mapping[str, float], signs: Mapping[str, int], protected: Sequence[str] = (), skip: Sequence[str] = ()) -> tuple[str, str] | None:
    """The covariate to remove next and why: one against its declared sign; else one without such a sign that has turned from its sign alone; else one that is not significant. Of several, that with the smallest |z|."""
    rows = {n: t for n, t in terms(fit).items() if n not in ("intercept", "log_shape", *protected, *skip)}
    tests: list[tuple[str, Callable[[str, dict], bool]]] = [
        ("sign against its prior", lambda n, t: signs.get(n, 0) * t["coefficient"] < 0),
        ("sign turned from the one alone", lambda n, t: not signs.get(n, 0) and alone.get(n, 0.0) * t["coefficient"] < 0),
        ("not significant", lambda n, t: t["p"] > SIGNIFICANT),
    ]
    for reason, fails in tests:
        found = [n for n, t in rows.items() if fails(n, t)]
        if found:
            return min(found, key=lambda n: abs(rows[n]["z"])), reason
    return None


def stability_table(whole: Fit, splits: Mapping[str, Fit], deviations: Mapping[str, float], dimensions: Mapping[str, str]) -> list[dict]:
    """Each covariate's effect per standard deviation on the whole and on every split; stable if all have one sign."""
    rows = []
    for n in whole.names[1:-1]:
        effect = lambda f: terms(f)[n]["coefficient"] * deviations[n]  # noqa: B023, E731
        effects = {label: effect(f) for label, f in splits.items()}
        rows.append({"covariate": n, "dimension": dimensions.get(n, n), "effect_all": effect(whole), **{f"effect_{k}": v for k, v in effects.items()}, "stable": len({x > 0 for x in (effect(whole), *effects.values())}) == 1})
    return rows


def not_identified(table: Sequence[dict], protected: Sequence[str] = ()) -> tuple[str, str] | None:
    """The smallest unstable covariate beside a larger one of its dimension, and that one. Without such a partner an unstable covariate stays, and shows in the table."""
    for r in sorted(table, key=lambda r: abs(r["effect_all"])):
        partners = [x for x in table if x["dimension"] == r["dimension"] and abs(x["effect_all"]) > abs(r["effect_all"])]
        if not r["stable"] and r["covariate"] not in protected and partners:
            return r["covariate"], max(partners, key=lambda x: abs(x["effect_all"]))["covariate"]
    return None


def immaterial(fit: Fit, deviations: Mapping[str, float], macro: Sequence[str]) -> tuple[str, float] | None:
    """The macro covariate with the smallest effect per standard deviation, if that is under the threshold."""
    effects = {n: t["coefficient"] * deviations[n] for n, t in terms(fit).items() if n in macro}
    below = {n: x for n, x in effects.items() if abs(x) < MATERIAL}
    return min(below.items(), key=lambda z: abs(z[1])) if below else None


def run_selection(cells: DataFrame, static: Sequence[str], macro: Sequence[str], signs: Mapping[str, int] | None = None, dimensions: Mapping[str, str] | None = None, splits: Mapping[str, Column] | None = None, protected: Sequence[str] = (), **options) -> Record:
    """All steps over cells with the candidates as columns. static: the block that screening and elimination start from, protected from inflation and materiality; macro: candidates, in the order in which inflated ones
    go last. splits: conditions that name parts of the cells, fitted apart for stability."""
    signs, dimensions, record = signs or {}, dimensions or {}, Record()
    names = [*static, *macro]
    cells = cells.persist()
    try:
        # one pass: correlations and standard deviations
        r, deviations = np.eye(len(names)), {}
        for row in weighted_moments(cells, names).collect():
            i, j = names.index(row["first"]), names.index(row["second"])
            r[i, j] = r[j, i] = row.correlation if i != j else 1.0
            if i == j:
                deviations[names[i]] = float(np.sqrt(max(row.covariance, 0.0)))
        record.collinear = collinear_pairs(names, r, CORRELATED)
        surviving, record.inflation = stepwise_vif(names, r, INFLATED, [*static, *protected])
        record.eliminated |= {n: f"variance inflation {v:.1f}" for n, v in record.inflation}
        fit = lambda columns, start=None: fit_aft(cells, columns, start=start_of(start), **options)
        base, alone, kept = fit(list(static)), {}, []
        for n in (x for x in macro if x in surviving):
            row = screened(n, fit([*static, n], base), base, deviations[n], signs.get(n, 0))
            record.screening.append(row)
            alone[n] = row["coefficient"]
            if row["p"] > SIGNIFICANT and n not in protected:
                record.eliminated[n] = f"p = {row['p']:.3g} beside the base"
            else:
                kept.append(n)
        current = [*static, *kept]
        found, skip = fit(current, base), []
        while (out := worst(found, alone, signs, [*protected], skip)) is not None and len(current) > 1:
            try:
                without = fit([c for c in current if c != out[0]], found)
            except ValueError as error:  # a model without it cannot be fitted: it stays
                skip.append(out[0])
                record.elimination.append({"covariate": out[0], "reason": f"{out[1]}, kept: {error}"})
                continue
            record.elimination.append({"covariate": out[0], "reason": out[1]})
            record.eliminated[out[0]] = out[1]
            current, found = [c for c in current if c != out[0]], without

        def drop(name: str, reason: str) -> None:
            nonlocal current, found
            record.elimination.append({"covariate": name, "reason": reason})
            record.eliminated[name] = reason
            current = [c for c in current if c != name]
            found = fit(current, found)

        while splits:
            record.stability = stability_table(found, {k: fit_aft(cells.where(c), current, start=start_of(found), **options) for k, c in splits.items()}, deviations, dimensions)
            pair = not_identified(record.stability, [*protected])
            if pair is None:
                break
            drop(pair[0], f"not identified beside {pair[1]}")
        while len(current) > 1 and (small := immaterial(found, deviations, [m for m in macro if m not in protected])) is not None:
            drop(small[0], f"effect {small[1]:+.4f} is immaterial")
        record.covariates, record.fit = current, found
        return record
    finally:
        cells.unpersist()


def origination_halves(month: str = "origination_month") -> dict[str, Column]:
    """Loans of even and of odd origination years."""
    year = F.floor(F.col(month) / 12)
    return {"even_years": year % 2 == 0, "odd_years": year % 2 == 1}
