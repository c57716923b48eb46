"""Scalar activations, vector arithmetic on ARRAY<DOUBLE>, binning and display text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_column(x)))


def softplus(x) -> Column:
    x = _column(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def relu(x) -> Column:
    return F.greatest(_column(x), F.lit(0.0))


def clamp(x, low: float, high: float) -> Column:
    return F.least(F.greatest(_column(x), F.lit(float(low))), F.lit(float(high)))


def log_intensity(x, floor: float = 1e-12) -> Column:
    return F.ln(F.greatest(_column(x), F.lit(float(floor))))


def is_finite(x) -> Column:
    x = _column(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def saturating_exp(x, limit: float = 709.0) -> Column:
    """``exp`` that is infinite from ``limit`` upward."""
    x = _column(x)
    return F.when(x < limit, F.exp(x)).otherwise(F.lit(float("inf")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also when the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a, b) -> Column:
    return total(F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(total(F.transform(_column(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b, eps: float = 1e-8) -> Column:
    low = F.lit(float(eps))
    return dot(a, b) / (F.greatest(norm(a), low) * F.greatest(norm(b), low))


def l2_normalize(a, eps: float = 1e-12) -> Column:
    a = _column(a)
    return bind(
        F.greatest(norm(a), F.lit(float(eps))), lambda length: F.transform(a, lambda x: x.cast("double") / length)
    )


def layer_norm(a, eps: float = 1e-5) -> Column:
    a = F.transform(_column(a), lambda x: x.cast("double"))

    def centered(mean):
        return F.transform(a, lambda x: x - mean)

    def scaled(c):
        spread = F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c) + F.lit(eps))
        return bind(spread, lambda sd: F.transform(c, lambda x: x / sd))

    return bind(bind(total(a) / F.size(a), centered), scaled)


def affine(a, weights: Sequence[float], bias: float = 0.0) -> Column:
    """Scalar head with supplied weights."""
    return dot(_column(a), F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias))


def project(a, matrix: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """Vector times a small supplied matrix given as output rows."""
    bias = bias or [0.0] * len(matrix)
    return F.array(*[affine(a, row, b) for row, b in zip(matrix, bias)])


def fuse(long, short, mode: str = "vector", gate=None) -> Column:
    """Combine two vectors: ``vector`` / ``scalar`` gate logits, ``average`` or ``concat``."""
    long, short = _column(long), _column(short)
    if mode == "average":
        return F.zip_with(long, short, lambda x, y: (x + y) / 2)
    if mode == "concat":
        return F.concat(long, short)
    if mode == "scalar":
        g = sigmoid(gate)
        return F.zip_with(long, short, lambda x, y: g * x + (1 - g) * y)
    if mode == "vector":
        gated = F.transform(_column(gate), sigmoid)
        both = F.arrays_zip(long.alias("l"), short.alias("s"), gated.alias("g"))
        return F.transform(both, lambda r: r["g"] * r["l"] + (1 - r["g"]) * r["s"])
    raise ValueError(f"unknown fusion mode {mode!r}")


def one_hot(index, width: int) -> Column:
    index = _column(index)
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0)
    )


def age_stratum(age) -> Column:
    """Fixed bins of the newest context age in days."""
    age = _column(age)
    return (
        F.when(age.isNull(), "none")
        .when(age <= 7, "1-7")
        .when(age <= 14, "8-14")
        .when(age <= 30, "15-30")
        .otherwise(">30")
    )


def confidence_stratum(confidence, anchors: Sequence[float] = (0.55, 0.8, 0.9), tol: float = 1e-6) -> Column:
    confidence = _column(confidence)
    out = F.when(confidence.isNull(), "none")
    for anchor in anchors:
        out = out.when(F.abs(confidence - F.lit(anchor)) <= tol, f"{anchor:g}")
    return out.otherwise("other")


def degree_stratum(degree) -> Column:
    degree = _column(degree)
    return F.when(degree == 0, "0").when(degree <= 2, "1-2").when(degree <= 5, "3-5").otherwise(">5")


def display_mean_sd(mean, std) -> Column:
    """``m.mmmm ± s.ssss``; a single run shows ``(n=1)``; no value shows ``NA``."""
    mean, std = _column(mean), _column(std)
    return (
        F.when(mean.isNull(), "NA")
        .when(std.isNull(), F.format_string("%.4f (n=1)", mean))
        .otherwise(F.format_string("%.4f ± %.4f", mean, std))
    )
