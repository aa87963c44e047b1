"""Normal distribution, deterministic assignment and small numeric helpers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_N = NormalDist()


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _scaled_tail(t: float) -> float:
    """log(erfc(x) exp(x^2) / t) at x = 2 / t - 2; smooth on (0, 1]."""
    x = 2 / t - 2
    if x < 2:
        return math.log(math.erfc(x) * math.exp(x * x) / t)
    f = x  # the continued fraction, from its far end
    for k in range(300, 0, -1):
        f = x + k / 2 / f
    return -math.log(math.sqrt(math.pi) * f * t)


@lru_cache
def _tail_polynomial(degree: int = 24) -> tuple[float, ...]:
    """Coefficients, highest first, of the polynomial in u = 2 t - 1 through Chebyshev points of ``_scaled_tail``."""
    cheb = np.polynomial.chebyshev.chebinterpolate(lambda u: np.array([_scaled_tail((v + 1) / 2) for v in u]), degree)
    return tuple(np.polynomial.chebyshev.cheb2poly(cheb)[::-1].tolist())


def norm_cdf_column(z: str | Column) -> Column:
    """Normal CDF of a column by built-in functions: the tail is t exp(polynomial - x^2) / 2, x = |z| / sqrt 2, t = 2 / (2 + x)."""
    z = (F.col(z) if isinstance(z, str) else z).cast("double")
    x = F.abs(z) / math.sqrt(2)
    t = F.lit(2.0) / (x + 2.0)
    log_tail = F.lit(0.0)
    for c in _tail_polynomial():
        log_tail = log_tail * (t * 2.0 - 1.0) + F.lit(c)
    tail = t * F.exp(log_tail - x * x) / 2
    return F.when(z > 0, 1 - tail).otherwise(tail)


def assign_arm(experiment: str, unit: Column, n_arms: int = 2) -> Column:
    """First 8 bytes of SHA-256 of ``experiment:unit``, big-endian, modulo the arms; built-in functions only."""
    if n_arms < 2:
        raise ValueError("an experiment has two arms at least")
    head = F.substring(F.sha2(F.concat_ws(":", F.lit(experiment), unit.cast("string")).cast("binary"), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % F.lit(n_arms)).cast("int")


def assign_arm_value(experiment: str, unit: object, n_arms: int = 2) -> int:
    if n_arms < 2:
        raise ValueError("an experiment has two arms at least")
    return int.from_bytes(hashlib.sha256(f"{experiment}:{unit}".encode()).digest()[:8], "big") % n_arms


def one_row(df: DataFrame, aggregates: Sequence[Column]) -> dict:
    """A single global aggregate, as a dictionary."""
    return df.agg(*aggregates).first().asDict()
