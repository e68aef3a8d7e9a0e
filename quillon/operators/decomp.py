"""Principal components: covariance by tasks, a d x d eigenproblem on the driver, projection as an expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vec

from .stats import moments


def eigen(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors in columns, each with its largest component positive."""
    w, v = np.linalg.eigh(s)
    w, v = w[::-1], v[:, ::-1]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return w, v * np.where(sign == 0, 1, sign)


@dataclass
class Pca:
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def fit(df: DataFrame, components: int, dim: int, features: str = "features") -> Pca:
        if not 1 <= components <= dim:
            raise ValueError(f"{components} components of {dim}")
        mean, s = moments(df, dim, features)
        w, v = eigen(np.nan_to_num(s))
        return Pca(mean, w[:components], v[:, :components])

    def transform(self, v: Column) -> Column:
        centred = vec.axpby(v, F.lit(self.mean.tolist()), 1.0, -1.0)
        return vec.let(centred, lambda x: F.array(*(vec.dot(x, F.lit(c.tolist())) for c in self.vectors.T)))

    def inverse(self, z: Column) -> Column:
        rows = F.array(*(F.lit(r.tolist()) for r in self.vectors))
        return vec.axpby(F.transform(rows, lambda r: vec.dot(r, z)), F.lit(self.mean.tolist()))
