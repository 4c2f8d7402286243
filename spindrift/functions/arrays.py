"""Expressions over ARRAY<DOUBLE> columns: products, similarities, kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_with_max(a: Column, b: Column) -> Column:
    """Product of a and b over the square of the elementwise larger magnitude (A07); null where both are zero."""
    top = F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x), F.abs(y)))
    return F.try_divide(dot(a, b), dot(top, top))


def kernel(name: str, a: Column, b: Column, size: int) -> Column:
    """Pairwise kernels with gamma = 1 / size, degree 3 and offset 1."""
    gamma = F.lit(1.0 / size)
    gap = F.zip_with(a, b, lambda x, y: x - y)
    forms = {
        "cosine": lambda: F.try_divide(dot(a, b), norm(a) * norm(b)),
        "linear": lambda: dot(a, b),
        "polynomial": lambda: F.pow(gamma * dot(a, b) + 1, F.lit(3)),
        "sigmoid": lambda: F.tanh(gamma * dot(a, b) + 1),
        "rbf": lambda: F.exp(-gamma * dot(gap, gap)),
        "laplacian": lambda: F.exp(-gamma * total(F.transform(gap, F.abs))),
    }
    if name not in forms:
        raise ValueError(f"unknown kernel {name}; known: {', '.join(forms)}")
    return forms[name]()


def project(values: Column, vector: list[float]) -> Column:
    """The component of an array along a vector."""
    return dot(values, F.array(*[F.lit(float(x)) for x in vector]))


def pick_channels(frame: Column, channels: list[int]) -> Column:
    """The chosen channels of a frame, in the order given."""
    return F.transform(F.array(*[F.lit(c) for c in channels]), lambda c: F.get(frame, c))


def centred_on_median(frame: Column) -> Column:
    """Common reference removal: a frame less its median over channels."""
    ordered, n = F.array_sort(frame), F.size(frame)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return F.transform(frame, lambda x: x - middle)
