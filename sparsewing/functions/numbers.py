"""Driver-side scalars: storage budgets, quantiles and intervals that need no data."""

from __future__ import annotations

from math import ceil, comb, exp, lgamma, log, log2, sqrt
from statistics import NormalDist


def storage_bits(m: int, k: int) -> int:
    """Bits that number all choices of k out of m."""
    return (comb(m, k) - 1).bit_length()


def index_bits(m: int) -> int:
    return max(0, ceil(log2(m))) if m > 0 else 0


def fixed_bits(m: int, k: int) -> int:
    return k * index_bits(m)


def value_winners(bits: int, m: int, level_bits: int = 4) -> int:
    """How many winners with a level each fit a budget of bits."""
    return bits // (index_bits(m) + level_bits)


def operations(nnz: int, d: int) -> int:
    """Dense projections that cost as much as a sparse matrix with nnz entries (half to even, at least 1)."""
    return max(1, round(nnz / (2 * d)))


def upper_normal(p: float) -> float:
    return NormalDist().inv_cdf(1 - p)


def primary_k(m: int, share: float = 0.05) -> int:
    return round(share * m)


def sizes(m: int) -> list[int]:
    return sorted({8, 16, 32, 64, primary_k(m)})


def pq_layout(bits: int, d: int, most: int = 8) -> list[int]:
    """Bits of each subspace: as few subspaces as hold the bits with at most ``most`` each, within the dimensions, evened out."""
    parts = min(d, max(1, ceil(bits / most)))
    return [bits // parts + (i < bits % parts) for i in range(parts)]


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def bisect(f, lo: float, hi: float, rounds: int = 200) -> float:
    """Root of an increasing function."""
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def beta_quantile(p: float, a: float, b: float) -> float:
    return bisect(lambda x: beta_cdf(x, a, b) - p, 0.0, 1.0)


def t_quantile(p: float, df: int) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, df)
    cdf = lambda t: 1 - beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    hi = 1.0
    while cdf(hi) < p:
        hi *= 2
    return bisect(lambda t: cdf(t) - p, 0.0, hi)


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    a = (1 - level) / 2
    return (beta_quantile(a, k, n - k + 1) if k else 0.0), (beta_quantile(1 - a, k + 1, n - k) if k < n else 1.0)


def wilson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    z = upper_normal((1 - level) / 2)
    p, d = k / n, 1 + z * z / n
    half = z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    mid = (p + z * z / (2 * n)) / d
    return mid - half, mid + half


def gale_ryser(fan_out: list[int], fan_in: list[int]) -> bool:
    """Whether a 0/1 matrix with these row sums and column sums exists."""
    f = sorted(fan_out, reverse=True)
    if sum(f) != sum(fan_in) or min([*f, *fan_in], default=0) < 0:
        return False
    return all(sum(f[:r]) <= sum(min(c, r) for c in fan_in) for r in range(1, len(f) + 1))
