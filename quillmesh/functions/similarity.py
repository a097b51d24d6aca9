"""Similarity of float vectors as Spark SQL expressions, normalised to 0..1.

Vectors are arrays; sums run in double. Empty, null and zero vectors, and scores that are no number, give 0.5.
"""

from __future__ import annotations

METRICS = ("cosine", "euclidean", "dot")
#: Score from which a result counts as of a tier.
TIERS = (("high", 0.8), ("moderate", 0.5), ("weak", 0.3))


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)"


def norm(a: str) -> str:
    return f"sqrt(aggregate({a}, 0D, (s, x) -> s + cast(x as double) * cast(x as double)))"


def distance(a: str, b: str) -> str:
    """Euclidean distance."""
    return f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) - cast(y as double)), 0D, (s, x) -> s + x * x))"


def similarity(metric: str, a: str, b: str) -> str:
    """The score of two vectors of one dimension; vectors of unlike dimensions, neither empty, are an error."""
    if metric == "cosine":
        raw = f"(greatest(-1D, least(1D, try_divide({dot(a, b)}, {norm(a)} * {norm(b)}))) + 1D) / 2D"
        raw = f"case when isnan({dot(a, b)}) or {norm(a)} * {norm(b)} = 0D then 0.5D else {raw} end"
    elif metric == "euclidean":
        raw = f"1D / (1D + {distance(a, b)})"
    elif metric == "dot":
        raw = f"1D / (1D + exp(-({dot(a, b)})))"
    else:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}: {metric}")
    unlike = f"size({a}) <> size({b}) then raise_error(concat('vectors of ', size({a}), ' and ', size({b}), ' elements'))"
    return f"case when {a} is null or {b} is null or size({a}) = 0 or size({b}) = 0 then 0.5D when {unlike} when isnan({raw}) then 0.5D else {raw} end"


def tier(score: str) -> str:
    return "case " + " ".join(f"when {score} >= {least}D then '{name}'" for name, least in TIERS) + " else 'low' end"
