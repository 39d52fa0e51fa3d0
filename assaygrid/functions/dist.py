"""Distribution tails as vectorised pandas UDFs.

They run on reduced rows only (one per feature, pair or set).  scipy is not a dependency: the tails are
evaluated by continued fractions, series and Gauss-Legendre quadrature in numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)  # Bernoulli coefficients


def lgamma(x):
    """log gamma for positive x: recurrence up to 10, then Stirling's series; NaN elsewhere."""
    z = np.array(x, float, copy=True)
    bad = ~(z > 0)
    z[bad] = 1.0
    out = np.zeros_like(z)
    for _ in range(10):
        low = z < 10
        out -= np.where(low, np.log(np.where(low, z, 1.0)), 0.0)
        z = z + low
    series = sum(c / z ** (2 * i + 1) for i, c in enumerate(STIRLING))
    out += (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    return np.where(bad, np.nan, out)


def norm_tail(z):
    """Upper tail of the standard normal."""
    z = np.asarray(z, float)
    return 0.5 * np.array([math.erfc(v) for v in (z / math.sqrt(2.0)).ravel()]).reshape(z.shape)


ROUNDS = 6000  # terms of a continued fraction or series; NaN when it has not converged by then


def beta_inc(a, b, x):
    """Regularised incomplete beta I_x(a, b), modified Lentz continued fraction."""
    a, b, x = (np.atleast_1d(v) for v in np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x))))
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    aa, bb, xx = np.where(ok, a, 1.0), np.where(ok, b, 1.0), np.where(ok, x, 0.5)
    swap = xx > (aa + 1) / (aa + bb + 2)
    p, q, y = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - xx, xx)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p
        c = np.ones_like(y)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        step = np.zeros_like(y)
        for m in range(1, ROUNDS):
            for num in (
                m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = c * d
                h = h * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        core = np.where(y <= 0, 0.0, front * h)
        met = (np.abs(step - 1) < 1e-9) | (y <= 0)
    return np.where(ok & met, np.where(swap, 1 - core, core), np.nan)


def gamma_upper(a, x):
    """Regularised upper incomplete gamma Q(a, x): series below the mean, continued fraction above."""
    a, x = (np.atleast_1d(v) for v in np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float)))
    ok = (a > 0) & (x >= 0)
    aa, xx = np.where(ok, a, 1.0), np.where(ok, x, 1.0)
    below = xx <= aa + 1
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(aa * np.log(xx) - xx - lgamma(aa))
        term = 1 / aa
        total = term.copy()
        for n in range(1, ROUNDS):
            term = np.where(below, term * xx / (aa + n), 0.0)
            total = total + term
            if np.all(term < 1e-16 * total):
                break
        met = term < 1e-9 * total
        frac = xx + 1 - aa
        c, d = np.full_like(xx, 1 / tiny), 1 / np.where(frac == 0, tiny, frac)
        h, step = d.copy(), np.zeros_like(xx)
        for i in range(1, ROUNDS):
            an, frac = -i * (i - aa), frac + 2
            d = an * d + frac
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = frac + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = np.where(below, h, h * step)
            if np.all(below | (np.abs(step - 1) < 1e-15)):
                break
        met = np.where(below, met, np.abs(step - 1) < 1e-9)
        out = np.where(xx == 0, 1.0, np.where(below, 1 - front * total, front * h))
        # far beyond the reach of either: the cube root of a gamma variable is close to normal (Wilson and Hilferty)
        normal = norm_tail(((xx / aa) ** (1 / 3) - 1 + 1 / (9 * aa)) * 3 * np.sqrt(aa))
        out = np.where((aa > 1e6) & ~met, normal, np.where(met | (xx == 0), out, np.nan))
    return np.where(ok, out, np.nan)


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        out = np.where(np.isinf(t), 0.0, beta_inc(df / 2, 0.5, df / (df + t * t)))
        # t with very many degrees of freedom: first term of the expansion about the normal
        z = np.abs(t) * (1 - 1 / (4 * df)) / np.sqrt(1 + t * t / (2 * df))
        return np.where(df > 1e7, 2 * norm_tail(z), out)


def norm_quantile(p):
    """Inverse normal by bisection on the tail."""
    p = np.asarray(p, float)
    inside = (p > 0) & (p < 1)
    q = np.where(inside, np.minimum(p, 1 - p), 0.25)
    lo, hi = np.zeros_like(q), np.full_like(q, 39.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        above = norm_tail(mid) > q
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    z = np.where(p < 0.5, -(lo + hi) / 2, (lo + hi) / 2)
    return np.where(inside, z, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan)))


def t_quantile(p, df):
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    q = np.minimum(p, 1 - p)
    lo, hi = np.zeros_like(q), np.full_like(q, 1e8)
    for _ in range(120):
        mid = np.where(hi > 1e3, np.sqrt((lo + 1) * hi), (lo + hi) / 2)
        above = t_two_sided(mid, df) / 2 > q
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where((p > 0) & (p < 1) & (df > 0), np.where(p < 0.5, -(lo + hi) / 2, (lo + hi) / 2), np.nan)


_NODES: dict = {}


def _nodes(n):
    if n not in _NODES:
        _NODES[n] = np.polynomial.legendre.leggauss(n)
    return _NODES[n]


def _range_grid(k, df):
    """Studentised-range CDF tabulated for one (k, df): integration nodes for s and z."""
    u, w = _nodes(96)
    if math.isinf(df) or df > 1e5:  # s is then 1 to within 1e-2 standard deviations
        s, ws = np.array([1.0]), np.array([1.0])
    else:
        half = 9 / math.sqrt(2 * df)
        a, b = max(0.0, 1 - half), 1 + half + 4 / df
        s = (b - a) / 2 * u + (a + b) / 2
        logf = (df / 2) * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
        ws = w * (b - a) / 2 * np.exp(logf)
    z = 8.5 * u
    wz = 8.5 * w * k * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return s, ws, z, wz


def range_tail(q, k, df):
    out = np.full(len(q), np.nan)
    for i, (qq, kk, dd) in enumerate(zip(q, k, df)):
        if qq is None or not (qq == qq and kk >= 2 and dd > 0):
            continue
        s, ws, z, wz = _range_grid(int(kk), float(dd))
        span = norm_tail(-z)[None, :] - norm_tail(-(z[None, :] - qq * s[:, None]))
        cdf = (ws * (np.clip(span, 0, 1) ** (int(kk) - 1) @ wz)).sum()
        out[i] = min(1.0, max(0.0, 1 - cdf))
    return out


def _log_erfc_part(u):
    """log(erfc(z) exp(z z) / t) at u = 2 t - 1, t = 2 / (2 + z), for z >= 0: smooth on all of [-1, 1]."""
    out = []
    for t in (np.asarray(u, float) + 1) / 2:
        z = 2 / t - 2
        if z < 2:
            scaled = math.erfc(z) * math.exp(z * z)
        else:  # continued fraction
            tail = z
            for k in range(300, 0, -1):
                tail = z + k / 2 / tail
            scaled = 1 / (tail * math.sqrt(math.pi))
        out.append(math.log(scaled / t))
    return np.array(out)


_ERFC = np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebinterpolate(_log_erfc_part, 28))[::-1]


def erfc_array(x):
    """erfc of a whole array, to some 1e-13 of its value; NaN stays."""
    z = np.abs(x)
    t = 2.0 / (2.0 + z)
    u = 2.0 * t - 1.0
    out = np.full(z.shape, _ERFC[0])
    for c in _ERFC[1:]:
        out *= u
        out += c
    with np.errstate(over="ignore"):
        out -= z * z
    np.exp(out, out=out)
    out *= t
    return np.where(x < 0, 2.0 - out, out)


def product_tail(c, rho):
    """P(|XY| >= c) for standard normals with correlation rho, conditioning on X; all nodes of 64 rows at once."""
    u, w = _nodes(400)
    x, wx = 6 * u + 6, 6 * w
    phi = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    c, r = np.abs(np.asarray(c, float)), np.asarray(rho, float)
    r = np.clip(np.where(np.isnan(r), 0.0, r), -1, 1)
    out = np.full(len(c), np.nan)
    square = (np.abs(r) == 1) & ~np.isnan(c)  # |XY| is then a square
    out[square] = 2 * norm_tail(np.sqrt(c[square]))
    rows = np.flatnonzero((np.abs(r) != 1) & ~np.isnan(c))
    for at in range(0, len(rows), 64):
        i = rows[at : at + 64]
        a, ri = c[i, None] / x, r[i, None] * x
        s = np.sqrt(2 * (1 - r[i, None] * r[i, None]))
        both = erfc_array((a - ri) / s)
        both += erfc_array((a + ri) / s)
        out[i] = np.minimum(1.0, (wx * phi * both).sum(axis=1))
    return out


def hyper_tail(k, big_n, big_k, n):
    """P(X >= k) of the hypergeometric law with population N, K marked, n drawn: terms from k up by their ratio."""
    out = np.full(len(k), np.nan)
    for i, (kk, nn, kb, ns) in enumerate(zip(k, big_n, big_k, n)):
        if any(v is None or v != v for v in (kk, nn, kb, ns)):
            continue
        lo, hi = max(0, ns + kb - nn), min(kb, ns)
        if kk <= lo:
            out[i] = 1.0
            continue
        if kk > hi:
            out[i] = 0.0
            continue
        lc = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        term = math.exp(lc(kb, kk) + lc(nn - kb, ns - kk) - lc(nn, ns))
        total, j = term, kk
        while j < hi:
            ratio = (kb - j) * (ns - j) / ((j + 1) * (nn - kb - ns + j + 1))
            term *= ratio
            total += term
            j += 1
            if ratio < 1 and term < 1e-17 * total:
                break
        out[i] = min(1.0, total)
    return out


_COUNTS: dict = {}


def _u_counts(n1, n2):
    """Number of arrangements for every value of U, exact integers (product of (1 - q^(n2+i)) / (1 - q^i))."""
    if (n1, n2) not in _COUNTS:
        size = n1 * n2 + 1
        poly = [1] + [0] * (size - 1)
        for i in range(1, n1 + 1):
            for j in range(size - 1, n2 + i - 1, -1):
                poly[j] -= poly[j - n2 - i]
            for j in range(i, size):
                poly[j] += poly[j - i]
        _COUNTS[n1, n2] = poly
    return _COUNTS[n1, n2]


def mwu_tail(u, n1, n2):
    """Exact two-sided Mann-Whitney p without ties; the caller decides where it is asked for."""
    out = np.full(len(u), np.nan)
    for i, (uu, a, b) in enumerate(zip(u, n1, n2)):
        if uu is None or uu != uu or not (a >= 1 and b >= 1):
            continue
        counts = _u_counts(int(min(a, b)), int(max(a, b)))
        top = max(uu, a * b - uu)
        out[i] = min(1.0, 2 * (sum(counts[int(math.ceil(top - 1e-9)):]) / sum(counts)))
    return out


def _series(values, like):
    return pd.Series(np.asarray(values, float), index=like.index)


@pandas_udf(DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student t tail."""
    return _series(t_two_sided(t, df), t)


@pandas_udf(DoubleType())
def t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_quantile(p, df), p)


@pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(f), 0.0, d2 / (d2 + d1 * f))
    return _series(beta_inc(d2 / 2, d1 / 2, x), pd.Series(f))


@pandas_udf(DoubleType())
def beta_cdf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return _series(beta_inc(a, b, x), x)


@pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _series(gamma_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2), x)


@pandas_udf(DoubleType())
def norm_sf(z: pd.Series) -> pd.Series:
    """Two-sided normal tail."""
    return _series(2 * norm_tail(np.abs(np.asarray(z, float))), z)


@pandas_udf(DoubleType())
def norm_upper(z: pd.Series) -> pd.Series:
    """One-sided upper normal tail."""
    return _series(norm_tail(z), z)


@pandas_udf(DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return _series(norm_quantile(p), p)


@pandas_udf(DoubleType())
def hyper_sf(k: pd.Series, big_n: pd.Series, big_k: pd.Series, n: pd.Series) -> pd.Series:
    return _series(hyper_tail(k, big_n, big_k, n), k)


@pandas_udf(DoubleType())
def srange_sf(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _series(range_tail(q, k, df), q)


@pandas_udf(DoubleType())
def product_normal_sf(c: pd.Series, rho: pd.Series) -> pd.Series:
    return _series(product_tail(c, rho), c)


@pandas_udf(DoubleType())
def mwu_exact_sf(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return _series(mwu_tail(u, n1, n2), u)


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def polygamma_series(x: float, order: int) -> float:
    """Trigamma (order 1) and tetragamma (order 2) by recurrence and asymptotic series."""
    out = 0.0
    while x < 15:
        out += 1 / x**2 if order == 1 else -2 / x**3
        x += 1
    i = 1 / x
    if order == 1:
        return out + i + i**2 / 2 + i**3 / 6 - i**5 / 30 + i**7 / 42 - i**9 / 30
    return out - i**2 - i**3 - i**4 / 2 + i**6 / 6 - i**8 / 6 + 3 * i**10 / 10


def trigamma_inverse(y: float) -> float:
    """Solve trigamma(x) = y for x by bisection on log x (trigamma is decreasing)."""
    lo, hi = -20.0, 20.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if polygamma_series(math.exp(mid), 1) > y:
            lo = mid
        else:
            hi = mid
    return math.exp((lo + hi) / 2)
