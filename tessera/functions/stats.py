"""Special functions and smoothers in numpy (there is no scipy here)."""

from __future__ import annotations

import math

import numpy as np


def gammaln(x: np.ndarray | float) -> np.ndarray:
    """log Gamma for x > 0: the argument is raised to 8 at least, then Stirling's series."""
    x = np.asarray(x, float)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    i = 1 / (y * y)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_erfc(x: np.ndarray | float) -> np.ndarray:
    """log erfc(x), also where erfc underflows (asymptotic series from 20 on)."""
    x = np.asarray(x, float)
    small = np.vectorize(lambda v: math.log(math.erfc(v)) if v < 20 else 0.0, otypes=[float])(x)
    big = np.maximum(x, 20.0)
    t = 1 / (2 * big * big)
    return np.where(x < 20, small, -big * big - np.log(big * math.sqrt(math.pi)) + np.log1p(-t * (1 - 3 * t * (1 - 5 * t))))


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta by Lentz's continued fraction."""
    return np.exp(log_betainc(a, b, x))


def log_betainc(a, b, x) -> np.ndarray:
    """log of the regularized incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = p * np.log(z) + q * np.log1p(-z) - np.log(p) - (gammaln(p) + gammaln(q) - gammaln(p + q))
        tiny = 1e-300
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        log_side = front + np.log(h)
        other = np.log(-np.expm1(np.minimum(log_side, -1e-300)))
    out = np.where(swap, other, log_side)
    return np.where(x <= 0, -np.inf, np.where(x >= 1, 0.0, out))


def binom_log_sf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log P(X > k) for X ~ Binomial(n, p)."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    inside = (k >= 0) & (k < n)
    got = log_betainc(np.where(inside, k + 1, 1.0), np.where(inside, n - k, 1.0), p)
    return np.where(k < 0, 0.0, np.where(k >= n, -np.inf, got))


def t_sf2(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t; df may be infinite."""
    t, df = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(df, float))
    finite = np.where(np.isinf(df), 1e12, df)
    small = betainc(finite / 2, 0.5, finite / (finite + t * t))
    normal = np.exp(log_erfc(t / math.sqrt(2)))
    return np.where(df > 1e10, normal, small)


def t_quantile(q: float, df: np.ndarray) -> np.ndarray:
    """Upper quantile (q > 0.5) of Student's t by bisection of its tail."""
    df = np.asarray(df, float)
    low, high = np.zeros_like(df), np.full_like(df, 1e9)
    for _ in range(200):
        mid = np.where(high > 1e3, np.sqrt(np.maximum(low, 1e-3) * high), (low + high) / 2)
        over = t_sf2(mid, df) / 2 > 1 - q
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    return (low + high) / 2


def digamma(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out = np.where(low, out - 1 / np.where(low, x, 1.0), out)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def trigamma(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(12):
        low = x < 12
        out = np.where(low, out + 1 / np.where(low, x * x, 1.0), out)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def trigamma_inverse(y: float) -> float:
    """x with trigamma(x) = y, by bisection on a log scale."""
    low, high = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(low * high)
        if float(trigamma(mid)) > y:
            low = mid
        else:
            high = mid
    return math.sqrt(low * high)


def local_fit(x: np.ndarray, y: np.ndarray, span: float, degree: int, robust: int = 0) -> np.ndarray:
    """Local polynomial regression with tricube weights of the nearest span * n points, at every x."""
    n = len(x)
    k = min(n, max(degree + 1, math.ceil(span * n)))
    order = np.argsort(x, kind="stable")
    xs, ys, out, weight = x[order], y[order], np.empty(n), np.ones(n)
    for turn in range(robust + 1):
        left = 0
        for i in range(n):
            while left + k < n and xs[left + k] - xs[i] < xs[i] - xs[left]:
                left += 1
            part = slice(left, left + k)
            d = np.abs(xs[part] - xs[i])
            reach = d.max()
            w = (1 - (d / reach) ** 3) ** 3 if reach > 0 else np.ones(k)
            w = np.maximum(w, 0) * weight[part]
            z = xs[part] - xs[i]
            m = np.vander(z, degree + 1, increasing=True) * np.sqrt(w)[:, None]
            out[i] = np.linalg.lstsq(m, ys[part] * np.sqrt(w), rcond=None)[0][0] if w.any() else ys[i]
        if turn < robust:
            r = np.abs(ys - out)
            six = 6 * np.median(r)
            weight = np.where(r < six, (1 - np.minimum(r / six, 1) ** 2) ** 2, 0.0) if six > 0 else np.ones(n)
    back = np.empty(n)
    back[order] = out
    return back


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.3, degree: int = 2) -> np.ndarray:
    return local_fit(x, y, span, degree)


def lowess(x: np.ndarray, y: np.ndarray, span: float = 0.5) -> np.ndarray:
    return local_fit(x, y, span, 1, robust=3)
