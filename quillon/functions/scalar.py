"""Scalar functions: activations with derivatives, optimisation test functions, sizes, bits and text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def safe_log(x: Column) -> Column:
    """ln(x); 0 for 0 and NaN below."""
    return F.when(x == 0, F.lit(0.0)).when(x < 0, F.lit(NAN)).otherwise(F.ln(x))


#: name: (function of x, derivative). Those of logistic, tanh and relu take the function's value.
ACTIVATIONS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "linear": (lambda x: x, lambda x: F.lit(1.0)),
    "log": (safe_log, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), x))),
    "step": (lambda x: F.when(x < 0, 0.0).otherwise(1.0), lambda x: F.when(x != 0, 1.0).otherwise(0.0)),
    "softplus": (lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))), lambda x: 1 / (1 + F.exp(-x))),
    "logistic": (lambda x: 1 / (1 + F.exp(-x)), lambda a: a * (1 - a)),
    "tanh": (F.tanh, lambda a: 1 - a * a),
    "relu": (lambda x: F.greatest(x, F.lit(0.0)), lambda a: F.when(a > 0, 1.0).otherwise(0.0)),
    "exp": (F.exp, F.exp),
}

#: Test functions of (x, y), with their published constants.
SURFACES: dict[str, Callable[[Column, Column], Column]] = {
    "unimodal_bowl": lambda x, y: x * x + y * y,
    "unimodal_matyas": lambda x, y: 0.26 * (x * x + y * y) - 0.48 * x * y,
    "easom": lambda x, y: -F.cos(x) * F.cos(y) * F.exp(-(F.pow(x - F.pi(), F.lit(2)) + F.pow(y - F.pi(), F.lit(2)))),
    "ackley": lambda x, y: -20 * F.exp(-0.2 * F.sqrt(0.5 * (x * x + y * y))) - F.exp(0.5 * (F.cos(2 * F.pi() * x) + F.cos(2 * F.pi() * y))) + F.e() + 20,
    "himmelblau": lambda x, y: (F.pow(x * x + y - 11, F.lit(2)) + F.pow(x + y * y - 7, F.lit(2))) / 100,
    "peaks": lambda x, y: 3 * F.pow(1 - x, F.lit(2)) * F.exp(-x * x - F.pow(y + 1, F.lit(2))) - 10 * (x / 5 - x * x * x - F.pow(y, F.lit(5))) * F.exp(-x * x - y * y) - F.exp(-F.pow(x + 1, F.lit(2)) - y * y) / 3,
    "eggholder": lambda x, y: -(y + 47) * F.sin(F.sqrt(F.abs(x / 2 + y + 47))) - x * F.sin(F.sqrt(F.abs(x - (y + 47)))),
}


def powi(base: Column, n: int) -> Column:
    return F.pow(base, F.lit(n))


def similar(a: Column, b: Column, tol: float = 1e-8) -> Column:
    return F.abs(a - b) <= tol


def close_to_zero(a: Column, tol: float = 1e-8) -> Column:
    return F.abs(a) <= tol


def left_trim(s: Column) -> Column:
    return F.regexp_replace(s, "^[ \\t\\r\\n]+", "")


def right_trim(s: Column) -> Column:
    return F.regexp_replace(s, "[ \\t\\r\\n]+$", "")


def values(s: Column, sep: str = ",") -> Column:
    """Separated text as numbers; blank or other text is null."""
    return F.transform(F.split(s, f"\\Q{sep}\\E", -1), lambda x: F.trim(x).try_cast("double"))


def memory_text(n: Column, largest: str = "GB") -> Column:
    """Bytes as text in the largest unit, up to `largest` (KB, MB or GB), that gives one or more."""
    units = ("KB", "MB", "GB")[: ("KB", "MB", "GB").index(largest) + 1]
    text = F.when(n < 1024, F.format_string("%d bytes", n.cast("long")))
    for i, unit in enumerate(units[:-1], 1):
        text = text.when(n < 1024 ** (i + 1), F.format_string(f"%.1f {unit}", n / float(1024**i)))
    return text.otherwise(F.format_string(f"%.1f {largest}", n / float(1024 ** len(units))))


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds)
    return (
        F.when(s < 60, F.format_string("%.2f secs", seconds))
        .when(s < 3600, F.format_string("%d mins and %d secs", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%d hours and %d mins", F.floor(s / 3600), F.floor((s % 3600) / 60)))
    )


def conv_size(n: Column | int, kernel: int, stride: int = 1, pad: int = 0):
    """Outputs of a sliding kernel."""
    if isinstance(n, int):
        return (n + 2 * pad - kernel) // stride + 1
    return F.floor((n + 2 * pad - kernel) / stride).cast("long") + 1


def same_padding(kernel: int) -> int:
    return (kernel - 1) // 2


def bits_to_real(bits: Column, integer_bits: int) -> Column:
    """Sign bit, integer bits from the least, then halves, quarters, ..."""
    part = lambda b, i: F.when(i == 0, F.lit(0.0)).when(i <= integer_bits, b * F.pow(F.lit(2.0), i - 1)).otherwise(b * F.pow(F.lit(0.5), i - integer_bits))
    value = F.aggregate(F.transform(bits.cast("array<double>"), part), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.element_at(bits, 1).cast("int") == 1, -value).otherwise(value)


def real_to_bits(x: Column, integer_bits: int, fraction_bits: int) -> Column:
    """The inverse, truncated to the bits there are."""
    whole = F.floor(F.abs(x)).cast("long")
    fraction = F.floor((F.abs(x) - whole) * float(1 << fraction_bits)).cast("long")
    sign = F.array(F.when(x < 0, 1).otherwise(0))
    upper = [F.shiftright(whole, i).bitwiseAND(F.lit(1)).cast("int") for i in range(integer_bits)]
    lower = [F.shiftright(fraction, fraction_bits - 1 - i).bitwiseAND(F.lit(1)).cast("int") for i in range(fraction_bits)]
    return F.concat(sign, F.array(*upper, *lower))


def popcount(bits: Column) -> Column:
    return F.aggregate(bits.cast("array<int>"), F.lit(0), lambda s, x: s + x)


def bit_zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0), n)


def bit_ones(n: int) -> Column:
    return F.array_repeat(F.lit(1), n)


def set_bit(bits: Column, i: int, value: int = 1) -> Column:
    return F.transform(bits.cast("array<int>"), lambda x, k: F.when(k == i, value).otherwise(x))


def bit_text(bits: Column) -> Column:
    return F.array_join(bits.cast("array<int>").cast("array<string>"), "")


def flip(bits: Column, i: int) -> Column:
    return F.transform(bits.cast("array<int>"), lambda x, k: F.when(k == i, 1 - x).otherwise(x))


def fitness_shape(acc: Column, kind: str) -> Column:
    return {
        "accuracy": lambda a: a,
        "power": lambda a: F.pow((1 + a) / 2, F.lit(5)),
        "exponential": lambda a: F.exp(6 * a - 6),
        "tanh": lambda a: F.tanh(2.5 * a),
    }[kind](acc)
