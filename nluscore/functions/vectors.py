"""Column expressions on array<float> vectors (JVM higher-order functions, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# smallest norm used when normalising, so a zero vector stays zero
EPS_NORM = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """V1: v / max(|v|, 1e-12) as array<double>."""
    n = F.greatest(norm(v), F.lit(EPS_NORM))
    return F.transform(_c(v), lambda x: x.cast("double") / n)


def dot(a, b) -> Column:
    """V2 (dot): sum of products in double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """V2 (cos_sim) on raw vectors; 0 for a zero vector."""
    return dot(l2_normalize(a), l2_normalize(b))


def nan_to(score, value: float = -1.0) -> Column:
    """V3: NaN score becomes ``value`` (Spark orders NaN above every number)."""
    s = _c(score)
    return F.when(F.isnan(s), F.lit(value)).otherwise(s)


def cutoffs(k: int) -> list[int]:
    """V7: report cut-offs: the standard list below k, plus k itself."""
    # fixed values: standard retrieval cut-offs 1, 3, 5, 10, 100, 1000
    return [c for c in (1, 3, 5, 10, 100, 1000) if c < k] + [k]
