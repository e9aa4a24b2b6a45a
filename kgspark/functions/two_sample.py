"""Distribution functions and two-sample tests in numpy (no statistics library is at hand)."""

from __future__ import annotations

import math

import numpy as np


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution by bisection on the error function: 60 halvings."""
    p = np.asarray(p, dtype=float)
    lo, hi = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
    for _ in range(60):
        mid = (lo + hi) / 2
        low = cdf(mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def f_sf(f: float, a: float, b: float) -> float:
    return beta_inc(b / 2, a / 2, b / (b + a * f))


def kolmogorov_sf(x: float) -> float:
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[inverse]


def mann_whitney(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(U of a, two-sided p by the normal approximation with ties and continuity corrected)."""
    n, m = len(a), len(b)
    u = float(average_ranks(np.r_[a, b])[:n].sum() - n * (n + 1) / 2)
    _, ties = np.unique(np.r_[a, b], return_counts=True)
    s = n + m
    var = n * m / 12 * ((s + 1) - (ties**3 - ties).sum() / (s * (s - 1))) if s > 1 else 0.0
    if var <= 0:
        return u, 1.0
    return u, min(1.0, 2 * normal_sf((abs(u - n * m / 2) - 0.5) / math.sqrt(var)))


def ks_two_sample(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    at = np.sort(np.r_[a, b])
    d = float(np.abs(np.searchsorted(np.sort(a), at, side="right") / len(a) - np.searchsorted(np.sort(b), at, side="right") / len(b)).max())
    return d, kolmogorov_sf(math.sqrt(len(a) * len(b) / (len(a) + len(b))) * d)


def levene(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Levene's test about medians."""
    z = [np.abs(x - np.median(x)) for x in (a, b)]
    n = len(a) + len(b)
    mean = np.concatenate(z).mean()
    between = sum(len(x) * (x.mean() - mean) ** 2 for x in z)
    within = sum(((x - x.mean()) ** 2).sum() for x in z)
    if within == 0 or n <= 2:
        return float("nan"), float("nan")
    w = (n - 2) * between / within
    return float(w), f_sf(w, 1, n - 2)


def t_test(a: np.ndarray, b: np.ndarray, equal: bool) -> tuple[float, float]:
    va, vb, n, m = a.var(ddof=1), b.var(ddof=1), len(a), len(b)
    if equal:
        df = n + m - 2
        se = math.sqrt(((n - 1) * va + (m - 1) * vb) / df * (1 / n + 1 / m))
    else:
        se = math.sqrt(va / n + vb / m)
        df = se**4 / ((va / n) ** 2 / (n - 1) + (vb / m) ** 2 / (m - 1)) if se else 1.0
    if not se:
        return float("nan"), float("nan")
    t = (a.mean() - b.mean()) / se
    return float(t), t_two_sided(t, df)


def shapiro_francia(x: np.ndarray) -> tuple[float, float]:
    """Normality by the squared correlation with normal scores (Shapiro and Francia), p by Royston's 1993
    approximation."""
    n = len(x)
    if n < 5 or np.ptp(x) == 0:
        return float("nan"), float("nan")
    m = normal_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    w = float(np.corrcoef(np.sort(x), m)[0, 1] ** 2)
    u = math.log(n)
    v = math.log(u)
    mu, sigma = -1.2725 + 1.0521 * (v - u), 1.0308 - 0.26758 * (v + 2 / u)
    return w, normal_sf((math.log(max(1 - w, 1e-300)) - mu) / sigma)


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """Normality by Shapiro and Wilk's W, weights and p by Royston's 1995 approximation (AS R94)."""
    n = len(x)
    if n < 3 or np.ptp(x) == 0:
        return float("nan"), float("nan")

    def poly(c: list[float], at: float) -> float:
        return sum(k * at**i for i, k in enumerate(c))

    m = normal_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    total, r = float((m * m).sum()), 1 / math.sqrt(n)
    a = m.copy()
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        last = [m[-1] / math.sqrt(total) + poly([0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056], r)]
        if n > 5:
            last.append(m[-2] / math.sqrt(total) + poly([0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], r))
        k = len(last)
        a /= math.sqrt((total - 2 * float((m[-k:] ** 2).sum())) / (1 - 2 * sum(v * v for v in last)))
        for i, v in enumerate(last):
            a[-1 - i], a[i] = v, -v
    x = np.sort(np.asarray(x, dtype=float))
    d = x - x.mean()
    w = min(1.0, float((a @ d) ** 2 / (d @ d)))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = poly([-2.273, 0.459], n)
        if y >= gamma:
            return w, 1e-99
        y, mu, sigma = -math.log(gamma - y), poly([0.544, -0.39978, 0.025054, -6.714e-4], n), math.exp(poly([1.3822, -0.77857, 0.062767, -0.0020322], n))
    else:
        u = math.log(n)
        mu, sigma = poly([-1.5861, -0.31082, -0.083751, 0.0038915], u), math.exp(poly([-0.4803, -0.082676, 0.0030302], u))
    return w, normal_sf((y - mu) / sigma)


def dip(x: np.ndarray) -> float:
    """Hartigan's dip: half the least greatest distance between the empirical distribution and a unimodal one, found
    by trying each mode interval between the greatest convex minorant and the least concave majorant."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 2 or x[0] == x[-1]:
        return 0.5 / max(n, 1)

    def hull(points: np.ndarray, values: np.ndarray, lower: bool) -> np.ndarray:
        kept: list[int] = []
        for i in range(len(points)):
            while len(kept) >= 2:
                a, b = kept[-2], kept[-1]
                cross = (points[b] - points[a]) * (values[i] - values[a]) - (values[b] - values[a]) * (points[i] - points[a])
                if (cross <= 0) if lower else (cross >= 0):
                    kept.pop()
                else:
                    break
            kept.append(i)
        return np.interp(points, points[kept], values[kept])

    points, first = np.unique(x, return_index=True)
    last = np.r_[first[1:], n]
    above, below = last / n, first / n
    lo, hi, best = 0, len(points) - 1, 1 / (2 * n)
    while True:
        p = points[lo : hi + 1]
        g, l_ = hull(p, below[lo : hi + 1], True), hull(p, above[lo : hi + 1], False)
        gap = l_ - g
        at = int(np.argmax(gap))
        if gap[at] <= 2 * best or len(p) <= 2:
            break
        # the modal interval narrows to the hull points about the widest gap
        on_g = np.flatnonzero(np.isclose(g, below[lo : hi + 1]))
        on_l = np.flatnonzero(np.isclose(l_, above[lo : hi + 1]))
        left = int(max([i for i in on_g if i <= at], default=0))
        right = int(min([i for i in on_l if i >= at], default=len(p) - 1))
        d = max(float((above[lo : lo + left + 1] - hull(points[lo : lo + left + 1], below[lo : lo + left + 1], True)).max()), float((hull(points[lo + right : hi + 1], above[lo + right : hi + 1], False) - below[lo + right : hi + 1]).max()))
        best = max(best, d / 2)
        if left == 0 and right == len(p) - 1:
            break
        lo, hi = lo + left, lo + right
    return float(best)


def effect_label(d: float) -> str:
    """Cohen's words for the size of an effect."""
    size = abs(d)
    return "negligible" if size < 0.2 else "small" if size < 0.5 else "medium" if size < 0.8 else "large"


def shuffled(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudo-random permutation of 0 ... n - 1, chosen by the key, moves these places.  Four rounds of a Feistel
    network on the smallest rectangle with room for n; what falls outside goes round again."""
    rows = max(1, math.isqrt(n))
    columns = -(-n // rows)
    rounds = [np.uint64(((key * 4 + r + 1) * 0x9E3779B97F4A7C15) % 2**64) for r in range(4)]

    def word(x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))

    out = np.asarray(places, dtype=np.uint64).copy()
    open_ = np.arange(len(out))
    while len(open_):
        a, b = out[open_] % np.uint64(rows), out[open_] // np.uint64(rows)
        for r in (0, 2):
            a = (a + word(b, rounds[r]) % np.uint64(rows)) % np.uint64(rows)
            b = (b + word(a, rounds[r + 1]) % np.uint64(columns)) % np.uint64(columns)
        moved = b * np.uint64(rows) + a
        out[open_] = moved
        open_ = open_[moved >= n]
    return out.astype(np.int64)
