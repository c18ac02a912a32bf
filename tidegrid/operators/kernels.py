"""Statistics that need linear algebra, one Arrow group a series: stationarity, vector autoregression, Granger causality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# MacKinnon's (1994, 2010) surface for the one-variable Dickey-Fuller statistic with a constant: bounds of
# the statistic, coefficients of the normal quantile for small and for large values; and KPSS (1992) critical values.
ADF_MAX, ADF_MIN, ADF_STAR = 2.74, -18.83, -1.61
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
KPSS_STAT = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)
LEAST = 30


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def f_tail(f: float, d1: int, d2: int) -> float:
    return 1.0 if f <= 0 else beta_fraction(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares, and the inverse of x'x."""
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ (x.T @ y)
    return beta, float(((y - x @ beta) ** 2).sum()), inv


def adf(x: np.ndarray) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller with a constant, lags by AIC up to 12 (n/100)^(1/4): statistic, p, lags."""
    n = len(x)
    top = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3)
    dx = np.diff(x)

    def design(k: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(start, len(dx))
        return dx[rows], np.column_stack([x[rows], *(dx[rows - j] for j in range(1, k + 1)), np.ones(len(rows))])

    best, pick = math.inf, 0
    for k in range(top + 1):  # on the same rows, to compare
        y, z = design(k, top)
        rss = ols(y, z)[1]
        aic = len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * z.shape[1]
        if aic < best:
            best, pick = aic, k
    y, z = design(pick, pick)
    beta, rss, inv = ols(y, z)
    se = math.sqrt(max(rss / max(len(y) - z.shape[1], 1) * inv[0, 0], 1e-300))
    stat = float(beta[0] / se)
    if stat > ADF_MAX:
        p = 1.0
    elif stat < ADF_MIN:
        p = 0.0
    else:
        p = normal_cdf(sum(c * stat**i for i, c in enumerate(ADF_SMALL if stat <= ADF_STAR else ADF_LARGE)))
    return stat, p, pick


def kpss(x: np.ndarray) -> tuple[float, float, int]:
    """KPSS around a constant, bandwidth by Hobijn and others (1998): statistic, p between 0.01 and 0.10, lags."""
    n = len(x)
    e = x - x.mean()
    gamma = lambda k: float(e[k:] @ e[: n - k]) / n
    m = int(n ** (2 / 9))
    s0 = gamma(0) + 2 * sum(gamma(i) for i in range(1, m + 1))
    s1 = 2 * sum(i * gamma(i) for i in range(1, m + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    var = gamma(0) + 2 * sum((1 - i / (lags + 1)) * gamma(i) for i in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / max(var, 1e-300))
    return stat, float(np.interp(stat, KPSS_STAT, KPSS_P)), lags


def verdict(x: np.ndarray, alpha: float = 0.05) -> dict:
    x = x[np.isfinite(x)]
    if len(x) < LEAST:
        return {"n": len(x), "verdict": "too_short"}
    if np.ptp(x) == 0:
        return {"n": len(x), "verdict": "constant"}
    a, ap, _ = adf(x)
    k, kp, _ = kpss(x)
    no_root, level = ap < alpha, kp > alpha
    name = "inconclusive" if no_root != level else "stationary" if level else "non-stationary"
    return {"n": len(x), "adf": a, "adf_p": ap, "kpss": k, "kpss_p": kp, "verdict": name}


def var_orders(data: np.ndarray, top: int) -> dict[str, int]:
    """Order of least AIC, BIC, HQ and FPE of a vector autoregression with a constant, all on the same rows."""
    n, k = len(data) - top, data.shape[1]
    best: dict[str, tuple[float, int]] = {}
    for p in range(top + 1):
        x = np.column_stack([np.ones(n), *(data[top - j : len(data) - j] for j in range(1, p + 1))])
        e = data[top:] - x @ np.linalg.lstsq(x, data[top:], rcond=None)[0]
        _, ld = np.linalg.slogdet(e.T @ e / n)
        free = p * k * k + k
        m = p * k + 1
        scores = {"aic": ld + 2 * free / n, "bic": ld + math.log(n) * free / n, "hqic": ld + 2 * math.log(math.log(n)) * free / n, "fpe": k * math.log((n + m) / max(n - m, 1)) + ld}
        for c, v in scores.items():
            if c not in best or v < best[c][0]:
                best[c] = (v, p)
    return {c: p for c, (_, p) in best.items()}


def granger_f(cause: np.ndarray, effect: np.ndarray, lag: int) -> tuple[float, float]:
    """F and p of the cause's lags 1 to `lag` in the effect's equation of a vector autoregression of that order with a constant.

    The test is one of the whole system of two equations, so its denominator has the residual degrees of both (Luetkepohl 2005, 3.6).
    """
    n = len(effect) - lag
    own = [effect[lag - j : len(effect) - j] for j in range(1, lag + 1)]
    other = [cause[lag - j : len(cause) - j] for j in range(1, lag + 1)]
    y, one = effect[lag:], np.ones(n)
    small = ols(y, np.column_stack([one, *own]))[1]
    large = ols(y, np.column_stack([one, *own, *other]))[1]
    free = n - 2 * lag - 1
    if free <= 0 or large <= 0:
        return 0.0, 1.0
    f = (small - large) / lag / (large / free)
    return f, f_tail(f, lag, 2 * free)


def fdr(p: np.ndarray) -> np.ndarray:
    order = np.argsort(p)
    q = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty_like(q)
    out[order] = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1)
    return out


def longest_whole(rows: np.ndarray) -> np.ndarray:
    """The longest run of rows without a missing value, of several the first."""
    ok = np.isfinite(rows).all(axis=1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(int), [0]])))
    if not len(edge):
        return rows[:0]
    lengths = edge[1::2] - edge[::2]
    k = int(lengths.argmax())
    return rows[edge[2 * k] : edge[2 * k + 1]]


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def stationarity(df: DataFrame, keys: list[str], order: str, column: str, alpha: float = 0.05) -> DataFrame:
    """One row a key: n, ADF and KPSS statistics and p-values, verdict. A group is one series."""
    names = ["n", "adf", "adf_p", "kpss", "kpss_p", "verdict"]
    schema = T.StructType([*_key_fields(df, keys), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names[1:5]), T.StructField("verdict", T.StringType())])

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        v = verdict(g.sort_values(order)[column].to_numpy(float), alpha)
        return pd.DataFrame([(*key, *(v.get(c) for c in names))], columns=[*keys, *names])

    return df.select(*keys, order, column).groupBy(*keys).applyInPandas(run, schema)


def make_stationary(df: DataFrame, keys: list[str], order: str, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """df with each column replaced by its first difference where its ADF test doesn't reject a unit root, and differenced
    (names of those columns). All rows stay; the first difference is null."""
    schema = T.StructType([*df.schema.fields, T.StructField("differenced", T.StringType())])

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order).copy()
        done = []
        for c in columns:
            x = g[c].to_numpy(float)
            x = x[np.isfinite(x)]
            if len(x) >= LEAST and np.ptp(x) > 0 and adf(x)[1] >= alpha:
                g[c] = g[c].astype(float).diff()
                done.append(c)
        g["differenced"] = ",".join(done)
        return g

    return df.groupBy(*keys).applyInPandas(run, schema)


def granger(df: DataFrame, keys: list[str], order: str, cause: str, effect: str, max_lag: int, alpha: float = 0.05) -> DataFrame:
    """One row a key and lag: F, p, p_fdr over the lags, whether it is the order that BIC chooses (at least 1), and the orders
    by each criterion; on the longest run without missing values. Lags stop at a tenth of the rows."""
    schema = T.StructType([*_key_fields(df, keys), T.StructField("lag", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("f", "p", "p_fdr")), T.StructField("chosen", T.BooleanType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("aic", "bic", "hqic", "fpe"))])
    names = [f.name for f in schema]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = longest_whole(g.sort_values(order)[[cause, effect]].to_numpy(float))
        top = min(max_lag, len(x) // 10)
        if top < 1 or np.ptp(x[:, 0]) == 0 or np.ptp(x[:, 1]) == 0:
            return pd.DataFrame(columns=names)
        orders = var_orders(x, top)
        chosen = max(1, orders["bic"])
        tests = [granger_f(x[:, 0], x[:, 1], k) for k in range(1, top + 1)]
        q = fdr(np.array([p for _, p in tests]))
        return pd.DataFrame([(*key, k, f, p, float(q[k - 1]), k == chosen, len(x), orders["aic"], orders["bic"], orders["hqic"], orders["fpe"]) for k, (f, p) in enumerate(tests, 1)], columns=names)

    return df.select(*keys, order, cause, effect).groupBy(*keys).applyInPandas(run, schema)
