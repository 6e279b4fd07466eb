"""Vector arithmetic as Column expressions; all of it stays in the JVM.

Vectors are arrays of numbers; sums run in double. A null argument gives null.
Vectors of different lengths give null (the missing side of a pair is null).
Zero vectors are treated as each kernel says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SubspaceSpec:
    """``parts`` consecutive subspaces of ``width`` numbers each."""

    parts: int = 8
    width: int = 8

    @property
    def dim(self) -> int:
        return self.parts * self.width


@dataclass(frozen=True)
class Kernel:
    """How the cosine distance of two sub-vectors treats small norms and rounding.

    ``by_norm``: a norm below ``zero`` (else the product of norms below it) gives
    distance 1; ``eps`` is added to the product; ``floor`` clamps below at 0;
    ``clip`` clips the cosine to [-1, 1].
    """

    zero: float
    by_norm: bool
    eps: float
    floor: bool
    clip: bool


#: The four conventions of the subspace distance.
PLAIN = Kernel(1e-16, False, 1e-8, False, False)
CLAMPED = Kernel(1e-9, True, 0.0, True, False)
SCAN = Kernel(1e-12, True, 0.0, False, True)
LOOKUP = Kernel(1e-16, False, 1e-8, True, False)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either norm is below 1e-9."""
    na, nb = norm(a), norm(b)
    return F.when((na < 1e-9) | (nb < 1e-9), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine, within [0, 2]; 1 if either norm is below 1e-9."""
    na, nb = norm(a), norm(b)
    d = F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - dot(a, b) / (na * nb)))
    return F.when((na < 1e-9) | (nb < 1e-9), F.lit(1.0)).otherwise(d)


def cosine_eps(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine with ``eps`` added to the product of the norms."""
    return dot(a, b) / (norm(a) * norm(b) + eps)


def sub_vector(v: Column, s: Column | int, spec: SubspaceSpec) -> Column:
    start = (s if isinstance(s, Column) else F.lit(s)) * spec.width + 1
    return F.slice(v, start, spec.width)


def sub_vectors(v: Column, spec: SubspaceSpec) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(spec.parts - 1)), lambda s: sub_vector(v, s, spec))


def sub_norms(v: Column, spec: SubspaceSpec) -> Column:
    return F.transform(sub_vectors(v, spec), norm)


def kernel_distance(a: Column, b: Column, kernel: Kernel) -> Column:
    """Distance of two sub-vectors under a kernel."""
    na, nb = norm(a), norm(b)
    cos = dot(a, b) / (na * nb + kernel.eps)
    if kernel.clip:
        cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))
    d = 1.0 - cos
    if kernel.floor:
        d = F.greatest(F.lit(0.0), d)
    small = ((na < kernel.zero) | (nb < kernel.zero)) if kernel.by_norm else (na * nb < kernel.zero)
    return F.when(small, F.lit(1.0)).otherwise(d)


def subspace_distance(a: Column, b: Column, spec: SubspaceSpec, kernel: Kernel = CLAMPED) -> Column:
    """Mean over the subspaces of the kernel's distance."""
    each = F.zip_with(sub_vectors(a, spec), sub_vectors(b, spec), lambda x, y: kernel_distance(x, y, kernel))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / spec.parts


def normalised(v: Column) -> Column:
    """Unit length; a zero vector is left as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def is_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def similarity_of_distance(d: Column) -> Column:
    return F.exp(-2.0 * d)


def snap(value: Column, grid: list[float]) -> Column:
    """The nearest number of the grid; of two equally near the one that comes first."""
    options = F.array(*[F.struct(F.abs(value - F.lit(g)).alias("d"), F.lit(k).alias("k"), F.lit(g).alias("g")) for k, g in enumerate(grid)])
    return F.array_min(options)["g"]


def uniform_indices(n: Column, k: int) -> Column:
    """``floor(i * n / k)`` for i below k (all indices if n <= k)."""
    some = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.least(F.floor(i * n / k), n - 1).cast("int"))
    every = F.sequence(F.lit(0), n - 1).cast("array<int>")
    return F.when(n > k, some).otherwise(F.when(n > 0, every).otherwise(F.array().cast("array<int>")))


def min_max(value: Column, low: Column, high: Column, flat: float | None = None, flat_below: float = 1e-8) -> Column:
    """(value - low) / range; a range below ``flat_below`` gives ``flat``, or is
    replaced by it where ``flat`` is None and the range is 0."""
    span = high - low
    if flat is None:
        return (value - low) / F.when(span == 0, F.lit(flat_below)).otherwise(span)
    return F.when(span < flat_below, F.lit(flat)).otherwise((value - low) / span)
