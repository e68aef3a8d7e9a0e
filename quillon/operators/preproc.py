"""Scalers and encoders: fit() gives a small frozen object, transform() and inverse() are column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vec


@dataclass(frozen=True)
class Scaler:
    """x -> (x - shift) / spread * size + low, by column; a spread of 0 gives null."""

    columns: tuple[str, ...]
    shift: tuple[float, ...]
    spread: tuple[float, ...]
    size: float = 1.0
    low: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.try_divide(F.col(c) - m, F.lit(s)) * self.size + self.low for c, m, s in zip(self.columns, self.shift, self.spread, strict=True)})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.low) / self.size * s + m for c, m, s in zip(self.columns, self.shift, self.spread, strict=True)})


def min_max(df: DataFrame, columns: list[str], symmetric: bool = False) -> Scaler:
    """To [0, 1], or to [-1, 1]."""
    r = df.agg(*(f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max)))).first()
    low, high = [r[f"a{i}"] or 0.0 for i in range(len(columns))], [r[f"b{i}"] or 0.0 for i in range(len(columns))]
    return Scaler(tuple(columns), tuple(low), tuple(b - a for a, b in zip(low, high, strict=True)), *((2.0, -1.0) if symmetric else (1.0, 0.0)))


def standard(df: DataFrame, columns: list[str]) -> Scaler:
    """To mean 0 and population deviation 1."""
    r = df.agg(*(f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return Scaler(tuple(columns), tuple(r[f"m{i}"] or 0.0 for i in range(len(columns))), tuple(r[f"s{i}"] or 0.0 for i in range(len(columns))))


def binary(label: Column, positive) -> Column:
    return F.when(label == positive, 1).otherwise(-1)


@dataclass(frozen=True)
class StringEncoder:
    """Codes in order of first appearance. The dictionary stays a DataFrame (value, code)."""

    codes: DataFrame

    @staticmethod
    def fit(df: DataFrame, column: str, row_id: str, start: int = 0) -> StringEncoder:
        from .frame import number_rows

        first = df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.min(row_id).alias("_first"))
        return StringEncoder(number_rows(first, F.col("_first"), F.col("value"), name="code").select("value", (F.col("code") + start).alias("code")))

    def encode(self, df: DataFrame, column: str, out: str = "code") -> DataFrame:
        """Unknown and empty values are null."""
        return df.join(self.codes.select(F.col("value").alias("_v"), F.col("code").alias(out)), F.col(column) == F.col("_v"), "left").drop("_v")

    def decode(self, df: DataFrame, code: str, out: str = "value") -> DataFrame:
        return df.join(self.codes.select(F.col("code").alias("_c"), F.col("value").alias(out)), F.col(code) == F.col("_c"), "left").drop("_c")

    def first_unknown(self, df: DataFrame, column: str, row_id: str) -> DataFrame:
        """err_idx: the first row whose value has no code, -1 if none."""
        coded = self.encode(df, column, "_code")
        return coded.agg(F.coalesce(F.min(F.when(F.col("_code").isNull() & F.col(column).isNotNull() & (F.col(column) != ""), F.col(row_id))), F.lit(-1)).alias("err_idx"))


@dataclass(frozen=True)
class OneHot:
    """Sorted categories; with drop_first the first is all zeros."""

    categories: tuple
    drop_first: bool = False

    @staticmethod
    def fit(df: DataFrame, column: str, drop_first: bool = False) -> OneHot:
        found = sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().collect())  # one row a category
        return OneHot(tuple(found), drop_first)

    def encode(self, c: Column) -> Column:
        """Null for unknown values."""
        known = c.isin(*self.categories) if self.categories else F.lit(False)
        return F.when(known, F.array(*(F.when(c == k, 1).otherwise(0) for k in self.categories[self.drop_first :])))

    def decode(self, v: Column) -> Column:
        names = F.array(*map(F.lit, self.categories[self.drop_first :]))
        zero = F.forall(v, lambda x: x == 0)
        return F.when(zero, F.lit(self.categories[0]) if self.drop_first else F.lit(None)).otherwise(F.element_at(names, vec.argmax(v) + 1))


def pixels(v: Column) -> Column:
    """x / 255 - 0.5."""
    return F.transform(v.cast("array<double>"), lambda x: x / 255 - 0.5)


def distillation_target(one_hot: Column, logits: Column) -> Column:
    return F.concat(one_hot.cast("array<double>"), logits.cast("array<double>"))
