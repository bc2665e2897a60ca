"""Column builders shared by the operators. All stay inside generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the keyed 31-bit hash: multipliers, increment, salt stride, modulus, fold and shifts.
HASH_MULTIPLIERS = [1103515245, 1274126177]
HASH_INCREMENT = 12345
HASH_SALT_STRIDE = 2654435761
HASH_MODULUS = 2147483648
HASH_FOLD = 40503
HASH_SHIFTS = [15, 13]


def to_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num/den, or ``default`` when the denominator is zero."""
    return F.when(den != 0, num / F.nullif(den, F.lit(0))).otherwise(F.lit(default)).cast("double")


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL; everything else is kept."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def sanitized(c: Column) -> Column:
    """Finite value or 0."""
    return F.coalesce(finite(c), F.lit(0.0))


def hash_bits(key: Column, salt: int = 0) -> Column:
    """31-bit multiply and xor-shift hash of an integer key: equal on every engine, stable under repartitioning."""
    low = F.lit(HASH_MODULUS - 1)
    k = key.cast("long")
    folded = k.bitwiseAND(low) + F.shiftright(k, 31).bitwiseAND(low) * HASH_FOLD
    x = (folded.bitwiseAND(low) * HASH_MULTIPLIERS[0] + F.lit(HASH_INCREMENT + salt * HASH_SALT_STRIDE)).bitwiseAND(low)
    x = (x.bitwiseXOR(F.shiftright(x, HASH_SHIFTS[0])) * HASH_MULTIPLIERS[1]).bitwiseAND(low)
    return x.bitwiseXOR(F.shiftright(x, HASH_SHIFTS[1]))


def hash_uniform(key: Column, salt: int = 0) -> Column:
    """Deterministic uniform in (0, 1]."""
    return (hash_bits(key, salt) + 1) / F.lit(float(HASH_MODULUS))


def hash_pick(key: Column, n: Column, salt: int = 0) -> Column:
    """Deterministic index in [0, n), from the high bits of the hash."""
    return F.floor(hash_bits(key, salt) / F.lit(float(HASH_MODULUS)) * n)


def hash_place(key: Column, n: Column, salt: int = 0) -> Column:
    """Deterministic index in [0, n) from two hashes of the key, fine enough for any ``n`` below 2^53."""
    m = F.lit(float(HASH_MODULUS))
    u = (hash_bits(key, salt) + hash_bits(key, salt + 3) / m) / m
    return F.least(F.floor(u * n), n - 1)


def hash_normal(key: Column, salt: int = 0) -> Column:
    """Deterministic standard normal (Box-Muller on two keyed uniforms)."""
    u, v = hash_uniform(key, salt), hash_uniform(key, salt + 2)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def phase_of(index: Column, total: Column, first: float = 0.40, second: float = 0.25) -> Column:
    """Contiguous phase of a position: first 40 %, next 25 %, rest. Non-positive totals are phase 1."""
    if first + second > 1.0:
        raise ValueError("phase fractions must sum to at most 1")
    end1 = F.floor(total * F.lit(float(first)))
    end2 = F.floor(total * F.lit(float(first + second)))
    return (
        F.when((total <= 0) | (index < end1), F.lit("phase1"))
        .when(index < end2, F.lit("phase2"))
        .otherwise(F.lit("phase3"))
    )


def ladder(score: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the first edge above the score; the last label catches the rest."""
    out = None
    for edge, label in zip(edges, labels):
        cond = score < F.lit(edge)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def right_closed_bins(value: Column, edges: list[float], labels: list[str], other: str = "unknown") -> Column:
    """(a, b] bins with the lowest edge included; outside or NULL goes to ``other``."""
    out = F.when(value.isNull(), F.lit(other))
    for i, label in enumerate(labels):
        low = (value >= edges[i]) if i == 0 else (value > edges[i])
        out = out.when(low & (value <= edges[i + 1]), F.lit(label))
    return out.otherwise(F.lit(other))


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided two-sample p-value: 2 sum (-1)^(k-1) exp(-2 k^2 lambda^2), 100 terms."""
    lam2 = d * d * (n * m).cast("double") / F.nullif((n + m).cast("double"), F.lit(0.0))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * lam2),
    )
    # the series does not converge near zero, where the p-value is 1 to many digits
    return F.when(lam2.isNull() | (lam2 < 0.04), F.lit(1.0)).otherwise(clip(series, 0.0, 1.0))


# Coefficients of the rational erfc approximation (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def normal_two_sided_p(z: Column) -> Column:
    """2(1 - Phi(|z|)) by the rational approximation, absolute error below 1.5e-7."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return clip(poly * F.exp(-x * x), 0.0, 1.0)
