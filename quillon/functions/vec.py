"""Vectors in ARRAY<DOUBLE> cells, as column expressions. Indices are 0-based; a null vector gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(c: Column | str) -> Column:
    """Any numeric array as ARRAY<DOUBLE>."""
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def let(value: Column, f) -> Column:
    """f of a value that is computed once a row, not again for every element of a lambda that uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def filled(n: int, value: float) -> Column:
    """n times the same value."""
    return F.array_repeat(F.lit(float(value)), n)


def copied(v: Column, alpha: float = 1.0) -> Column:
    """A copy, times alpha."""
    return scale(vector(v), alpha)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def sum_squared(v: Column, alpha: float = 0.0) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + (x + alpha) * (x + alpha))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(sum_squared(v))


def normalize(v: Column) -> Column:
    """v divided by its norm; a zero vector stays."""
    return let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def scale(v: Column, alpha) -> Column:
    return F.transform(v, lambda x: x * alpha)


def shift(v: Column, alpha) -> Column:
    return F.transform(v, lambda x: x + alpha)


def axpby(a: Column, b: Column, alpha=1.0, beta=1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x * alpha + y * beta)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divided(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def squared(v: Column) -> Column:
    return F.transform(v, lambda x: x * x)


def reciprocal(v: Column, alpha: float = 1.0) -> Column:
    """alpha / x, and 0 for 0."""
    return F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(alpha), x)))


def maximum(v: Column) -> Column:
    return F.array_max(v)


def minimum(v: Column) -> Column:
    return F.array_min(v)


def argmax(v: Column) -> Column:
    """First place of the largest."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def argmin(v: Column) -> Column:
    return (F.array_position(v, F.array_min(v)) - 1).cast("int")


def one_hot_argmax(v: Column) -> Column:
    return let(argmax(v), lambda best: F.transform(v, lambda x, i: F.when(i == best, 1.0).otherwise(0.0)))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    powers = lambda u, top: F.transform(u, lambda x: F.exp((x - top) / temperature))
    shares = lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s))
    return let(v, lambda u: let(let(F.array_max(u), lambda top: powers(u, top)), shares))


def count_close(v: Column, value: float, tol: float = 1e-8) -> Column:
    return F.size(F.filter(v, lambda x: F.abs(x - value) <= tol)).cast("long")


def equals(a: Column, b: Column, tol: float = 1e-8) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tol), lambda t: t)


def count_equal(a: Column, b: Column, novalue: float | None = None) -> Column:
    """Places where a and b are the same, but for those where a is `novalue`."""
    same = lambda x, y: F.when((x == y) & (F.lit(True) if novalue is None else x != novalue), 1).otherwise(0)
    return F.aggregate(F.zip_with(a, b, same), F.lit(0), lambda s, x: s + x).cast("long")


def outer(a: Column, b: Column) -> Column:
    """Rows of the products of a's elements with b, one after another."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def variance(v: Column, population: bool = True) -> Column:
    """Null for no elements (and for one, of a sample)."""
    n = lambda u: F.size(u) if population else F.size(u) - 1
    squares = lambda u, mean: F.aggregate(u, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return let(v, lambda u: let(F.try_divide(total(u), F.size(u)), lambda mean: F.try_divide(squares(u, mean), n(u))))


def element(v: Column, i) -> Column:
    """Of a negative index from the end."""
    return F.element_at(v, i + 1 if i >= 0 else i)


def drop_elements(v: Column, indices: list[int], width: int | None = None) -> Column:
    if width is not None and any(not -width <= i < width for i in indices):
        raise ValueError(f"index out of range for width {width}: {indices}")
    return let(F.size(v), lambda n: F.filter(v, lambda _, i: ~_is_in(i, n, indices)))


def _is_in(i: Column, n: Column, indices: list[int]) -> Column:
    out = F.lit(False)
    for k in indices:
        out = out | (i == (F.lit(k) if k >= 0 else n + k))
    return out


def copy_range(v: Column, start: int, n: int) -> Column:
    return F.slice(v, start + 1 if start >= 0 else start, n)


def padded(v: Column, left: int, right: int, value: float = 0.0) -> Column:
    return F.concat(F.array_repeat(F.lit(value), left), v, F.array_repeat(F.lit(value), right))


def pad_matrix(v: Column, height: int, width: int, border: int) -> Column:
    """A flat height x width matrix with `border` zeros on each side."""
    w = width + 2 * border
    row = lambda y: F.concat(F.array_repeat(F.lit(0.0), border), F.slice(v, y * width + 1, width), F.array_repeat(F.lit(0.0), border))
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), row))
    edge = F.array_repeat(F.lit(0.0), w * border)
    return F.concat(edge, rows, edge)


def transpose_flat(v: Column, height: int, width: int) -> Column:
    """A flat height x width matrix as width x height."""
    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda k: F.element_at(v, ((k % height) * width + F.floor(k / height) + 1).cast("int")))


def rot180(v: Column) -> Column:
    return F.reverse(v)


def swap_elements(v: Column, i: int, j: int) -> Column:
    return F.transform(v, lambda x, k: F.when(k == i, element(v, j)).when(k == j, element(v, i)).otherwise(x))


def find_first(v: Column, value, start: int = 0) -> Column:
    """Place of the first match at or after start; -1 if none."""
    at = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (F.element_at(v, i + 1) == value) & (i >= start))
    return F.coalesce(F.array_min(at), F.lit(-1))


def find_last(v: Column, value) -> Column:
    at = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.element_at(v, i + 1) == value)
    return F.coalesce(F.array_max(at), F.lit(-1))
