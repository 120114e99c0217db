"""Feature weights from contingency counts, as Column expressions.

``tp`` and ``fp`` are the positive and negative documents with a feature, ``pos``
and ``neg`` the sizes of the classes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("bns", "idf", "log-odds", "none")
_A = 8 * (math.pi - 3) / (3 * math.pi * (4 - math.pi))


def inv_erf(x: Column) -> Column:
    """Winitzki's approximation."""
    log = F.log(F.lit(1.0) - x * x)
    t = F.lit(2 / (math.pi * _A)) + log / 2
    return F.signum(x) * F.sqrt(F.sqrt(t * t - log / F.lit(_A)) - t)


def inv_normal_cdf(p: Column) -> Column:
    return F.lit(math.sqrt(2)) * inv_erf(2 * p - 1)


def bns(tp: Column, fp: Column, pos: Column, neg: Column) -> Column:
    """Signed bi-normal separation; rates are kept off 0 and 1."""
    least = F.least(F.lit(0.0005), F.lit(1.0) / (pos + neg))
    rate = lambda k, n: F.greatest(least, F.least(F.lit(1.0) - least, k.cast("double") / n))
    return inv_normal_cdf(rate(tp, pos)) - inv_normal_cdf(rate(fp, neg))


def idf(tp: Column, fp: Column, pos: Column, neg: Column) -> Column:
    return F.log((pos + neg).cast("double") / (tp + fp))


def log_odds(tp: Column, fp: Column, pos: Column, neg: Column, min_count: float = 0.1) -> Column:
    k = lambda c: F.greatest(c.cast("double"), F.lit(min_count))
    return F.log(k(tp) * k(neg - fp) / (k(fp) * k(pos - tp)))


def weight(kind: str, tp: Column, fp: Column, pos: Column, neg: Column, threshold: int = 2, min_count: float = 0.1) -> Column:
    """The weight of a kind; 0 below the minimum support."""
    if kind not in KINDS:
        raise ValueError(f"no such weight: {kind}")
    value = bns(tp, fp, pos, neg) if kind == "bns" else idf(tp, fp, pos, neg) if kind == "idf" else log_odds(tp, fp, pos, neg, min_count) if kind == "log-odds" else F.lit(1.0)
    return F.when(tp + fp < threshold, F.lit(0.0)).otherwise(value)
