"""Parametric survival models of monthly hazards: distributed Newton, tests, selection helpers.

The likelihood of a row is that of its month, given survival to its start: survive with exp(-D), fail with 1 - exp(-D), D the rise of the cumulative hazard. D depends on
eta (log scale, linear in the covariates) and on the log shape. Value, gradient and Hessian are sums over rows: each partition gives one small row of sums, which are
added up in a shuffle, and the driver takes the step. Rows are collapsed by covariates, age and event beforehand, once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.functions.special import chi2_sf, normal_sf
from cohortica.operators.book import DEFAULT
from cohortica.operators.metrics import weighted_moments

#: Knots of the age basis in log(age + 1/2).
AGE_KNOTS = (1.3547, 3.2203, 3.7825, 4.2677, 5.1383)


@dataclass
class Fit:
    family: str
    names: list[str]
    params: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    rounds: int
    events: int
    exposure: int

    @property
    def aic(self) -> float:
        return 2 * len(self.params) - 2 * self.log_likelihood

    def table(self) -> list[tuple]:
        """name, coefficient, standard error, z, p, time ratio."""
        se = np.sqrt(np.diag(self.covariance))
        return [(n, float(b), float(s), float(b / s), 2 * normal_sf(abs(b / s)), math.exp(b)) for n, b, s in zip(self.names, self.params, se, strict=True)]


def terms(family: str, age: np.ndarray, eta: np.ndarray, kappa: float):
    """D and its derivatives by eta and kappa (log shape)."""
    rho = math.exp(kappa)

    def side(t):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            s = rho * (np.log(t) - eta)
            if family == "weibull":
                level = first = second = np.exp(s)
            else:
                level, first = np.logaddexp(0, s), 1 / (1 + np.exp(-s))
                second = first * (1 - first)
            s = np.where(np.isfinite(s), s, 0.0)
        return level, first, second, s

    l1, f1, g1, s1 = side(age + 1.0)
    l0, f0, g0, s0 = side(age * 1.0)
    d = np.maximum(l1 - l0, 1e-300)
    return d, -rho * (f1 - f0), s1 * f1 - s0 * f0, rho**2 * (g1 - g0), -rho * (f1 - f0) - rho * (s1 * g1 - s0 * g0), s1 * f1 + s1**2 * g1 - s0 * f0 - s0**2 * g0


def sums(family: str, x: np.ndarray, age: np.ndarray, event: np.ndarray, w: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Value, gradient and Hessian of the log likelihood, in one vector."""
    k = x.shape[1]
    d, de, dk, dee, dek, dkk = terms(family, age, x @ theta[:k], float(theta[k]))
    em = np.expm1(d)
    l1 = np.where(event, 1 / np.maximum(em, 1e-300), -1.0)
    l2 = np.where(event, -np.exp(np.minimum(d, 700)) / np.maximum(em, 1e-300) ** 2, 0.0)
    value = np.where(event, np.log(-np.expm1(-d)), -d)
    h = np.zeros((k + 1, k + 1))
    h[:k, :k] = (x * (w * (l2 * de * de + l1 * dee))[:, None]).T @ x
    h[:k, k] = h[k, :k] = x.T @ (w * (l2 * de * dk + l1 * dek))
    h[k, k] = (w * (l2 * dk * dk + l1 * dkk)).sum()
    g = np.append(x.T @ (w * l1 * de), (w * l1 * dk).sum())
    return np.concatenate([[(w * value).sum()], g, h.ravel()])


def fit_aft(cells: DataFrame, covariates: Sequence[str], cause: str = DEFAULT, family: str = "weibull", weight: str = "loan_months", rounds: int = 60, start: Mapping[str, float] | None = None) -> Fit:
    """Damped Newton until a step is under a thousandth of a standard error. Weights are whole and positive. start: parameters by name, as a fit gives them; those it lacks start at 0."""
    if family not in ("weibull", "log_logistic"):
        raise ValueError(f"no such family: {family}")
    rows = cells.select(*[F.col(c).cast("double").alias(c) for c in covariates], F.col("age").cast("double").alias("age"), (F.col("outcome") == cause).alias("event"), F.col(weight).alias("w")).na.drop()
    rows = rows.groupBy(*covariates, "age", "event").agg(F.sum("w").alias("w")).persist()
    try:
        stats = rows.agg(F.sum(F.when(F.col("event"), F.col("w")).otherwise(0)).alias("d"), F.sum("w").alias("n"), F.min("w").alias("low"), *[F.sum(F.col("w") * F.col(c)).alias(f"m{i}") for i, c in enumerate(covariates)], *[F.sum(F.col("w") * F.col(c) * F.col(c)).alias(f"q{i}") for i, c in enumerate(covariates)]).first()
        if not stats.d:
            raise ValueError("no events")
        if stats.low <= 0 or stats.low != int(stats.low):
            raise ValueError("weights must be positive whole numbers")
        k = len(covariates) + 1
        # covariates are centred and scaled for the steps, and scaled back at the end
        mean = np.array([stats[f"m{i}"] / stats.n for i in range(k - 1)])
        sd = np.sqrt(np.maximum(np.array([stats[f"q{i}"] / stats.n for i in range(k - 1)]) - mean**2, 0))
        sd[sd == 0] = 1.0

        def total(theta: np.ndarray) -> np.ndarray:
            def part(batches):
                out = np.zeros(1 + (k + 1) + (k + 1) ** 2)
                for b in batches:
                    x = np.column_stack([np.ones(b.num_rows), *[(b.column(c).to_numpy() - mean[i]) / sd[i] for i, c in enumerate(covariates)]])
                    out += sums(family, x, b.column("age").to_numpy(), b.column("event").to_numpy(zero_copy_only=False), b.column("w").to_numpy().astype(float), theta)
                yield pa.RecordBatch.from_pydict({"s": [out.tolist()]})

            # one row of sums per partition, added up place by place: the driver gets a row for each place
            sums_ = rows.mapInArrow(part, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
            return np.array([r.v for r in sorted(sums_.collect(), key=lambda r: r.i)])

        theta = np.zeros(k + 1)
        if start is None:
            theta[0] = math.log(stats.n / stats.d)
        else:
            slopes = np.array([start.get(c, 0.0) for c in covariates])
            theta[:] = [start.get("intercept", 0.0) + slopes @ mean, *(slopes * sd), start.get("log_shape", 0.0)]
        s = total(theta)
        for n in range(1, rounds + 1):  # noqa: B007
            g, h = s[1 : k + 2], s[k + 2 :].reshape(k + 1, k + 1)
            values, vectors = np.linalg.eigh(-h)
            step = vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-8 * np.abs(values).max()))
            size = 1.0
            while size > 1e-6 and not (new := total(theta + size * step))[0] >= s[0] - 1e-10 * abs(s[0]):
                size /= 2
            theta, s = theta + size * step, new
            spread = np.sqrt(np.maximum(np.diag(np.linalg.pinv(-s[k + 2 :].reshape(k + 1, k + 1))), 1e-300))
            if (np.abs(size * step) <= 1e-3 * spread).all():
                break
        h = s[k + 2 :].reshape(k + 1, k + 1)
        if np.linalg.eigvalsh(-h).min() <= 0:
            raise ValueError("the likelihood has no strict maximum here: covariates are collinear or a cause has too few events")
        back = np.eye(k + 1)
        back[1:k, 1:k] = np.diag(1 / sd)
        back[0, 1:k] = -mean / sd
        return Fit(family, ["intercept", *covariates, "log_shape"], back @ theta, back @ np.linalg.inv(-h) @ back.T, float(s[0]), n, int(stats.d), int(stats.n))
    finally:
        rows.unpersist()


def wald(fit: Fit, names: Sequence[str], against: Sequence[float] | None = None) -> tuple[float, float]:
    """Joint test that parameters have given values."""
    i = [fit.names.index(n) for n in names]
    b = fit.params[i] - np.array(against if against is not None else [0.0] * len(i))
    x = float(b @ np.linalg.solve(fit.covariance[np.ix_(i, i)], b))
    return x, chi2_sf(x, len(i))


def exponential_is_rejected(fit: Fit, level: float = 0.05) -> bool:
    return wald(fit, ["log_shape"])[1] < level


def correlations(cells: DataFrame, columns: Sequence[str], weight: str = "loan_months") -> np.ndarray:
    r = np.eye(len(columns))
    for row in weighted_moments(cells, columns, weight).collect():
        i, j = columns.index(row["first"]), columns.index(row["second"])
        r[i, j] = r[j, i] = row.correlation
    return r


def vif(correlation: np.ndarray) -> np.ndarray:
    return np.diag(np.linalg.pinv(correlation))


def stepwise_vif(columns: Sequence[str], correlation: np.ndarray, most: float = 10.0, protected: Sequence[str] = ()) -> tuple[list[str], list[tuple[str, float]]]:
    """Drops the most inflated unprotected column until none is above the limit."""
    kept, dropped = list(columns), []
    while len(kept) > 1:
        i = [list(columns).index(c) for c in kept]
        v = vif(correlation[np.ix_(i, i)])
        worst = max(((x, c) for x, c in zip(v, kept, strict=True) if c not in protected), default=(0.0, ""))
        if worst[0] <= most:
            break
        kept.remove(worst[1])
        dropped.append((worst[1], float(worst[0])))
    return kept, dropped


def collinear_pairs(columns: Sequence[str], correlation: np.ndarray, least: float = 0.8) -> list[tuple[str, str, float]]:
    n = len(columns)
    return [(columns[i], columns[j], float(correlation[i, j])) for i in range(n) for j in range(i + 1, n) if abs(correlation[i, j]) >= least]


def backward_selection(cells: DataFrame, covariates: Sequence[str], priors: dict[str, int] | None = None, level: float = 0.05, **options) -> tuple[Fit, list[dict]]:
    """Drops, one at a time, the covariate against its prior sign, else the least significant above the level."""
    kept, trace = list(covariates), []
    while True:
        fit = fit_aft(cells, kept, **options)
        rows = {n: (b, p) for n, b, _, _, p, _ in fit.table()}
        wrong = [c for c in kept if (priors or {}).get(c) and rows[c][0] * priors[c] < 0]
        weak = sorted(((rows[c][1], c) for c in kept if rows[c][1] > level), reverse=True)
        drop = max(wrong, key=lambda c: rows[c][1]) if wrong else weak[0][1] if weak else None
        trace.append({"covariates": list(kept), "log_likelihood": fit.log_likelihood, "aic": fit.aic, "dropped": drop, "reason": "sign" if wrong else "significance" if weak else None})
        if drop is None or len(kept) == 1:
            return fit, trace
        kept.remove(drop)


def age_basis(ages: int = 400, knots: Sequence[float] = AGE_KNOTS) -> np.ndarray:
    """Restricted cubic basis in log(age + 1/2), linear beyond the outer knots, columns orthonormal over the ages and free of a constant and a linear part."""
    u, k = np.log(np.arange(ages) + 0.5), np.asarray(knots)
    cube = lambda z: np.maximum(z, 0) ** 3
    last, before = k[-1], k[-2]
    raw = [cube(u - a) - cube(u - before) * (last - a) / (last - before) + cube(u - last) * (before - a) / (last - before) for a in k[:-2]]
    q, r = np.linalg.qr(np.column_stack([np.ones(ages), u, *raw]))
    return (q * np.sign(np.diag(r)))[:, 2:]


def baseline_probe(risk: Sequence[tuple[int, int, int]]) -> dict:
    """Poisson fits of events by age (age, at risk, events): constant, log-linear and spline baselines, by AIC. A row per age, on the driver."""
    age, n, d = (np.array(x, float) for x in zip(*risk, strict=True))
    u, basis = np.log(age + 0.5), age_basis(int(age.max()) + 1 if age.max() >= 400 else 400)[age.astype(int)]
    forms = {"constant": np.ones((len(age), 1)), "weibull": np.column_stack([np.ones(len(age)), u]), "spline": np.column_stack([np.ones(len(age)), u, basis])}
    out = {}
    for name, x in forms.items():
        b = np.zeros(x.shape[1])
        b[0] = math.log(max(d.sum(), 0.5) / n.sum())
        for _ in range(100):
            mu = n * np.exp(np.clip(x @ b, -50, 5))
            step = np.linalg.lstsq(x.T @ (x * mu[:, None]) + 1e-9 * np.eye(x.shape[1]), x.T @ (d - mu), rcond=None)[0]
            b += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        mu = n * np.exp(np.clip(x @ b, -50, 5))
        out[name] = {"coefficients": b, "aic": float(2 * len(b) - 2 * (d * np.log(mu) - mu).sum())}
    return out | {"best": min(forms, key=lambda f: out[f]["aic"])}
