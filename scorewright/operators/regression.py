"""Correlation and least squares from one distributed aggregation.

Only means and pairwise covariances reach the driver: p + 1 means and a
(p + 1) x (p + 1) block for p predictors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, combinations_with_replacement
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorewright.functions.distributions import t_quantile, t_two_sided, with_normal_quantile
from scorewright.operators.ranking import global_rank


def correlation(df: DataFrame, x: str, y: str, places: int = 4) -> DataFrame:
    """Pearson correlation of two columns."""
    return df.agg(F.round(F.corr(x, y), places).alias("correlation"))


def correlations_with(
    df: DataFrame, columns: Sequence[str], target: str, places: int = 4
) -> DataFrame:
    """Pearson correlation of several columns with one target."""
    row = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    entries = [
        F.struct(F.lit(c).alias("variable"), F.round(F.col(c), places).alias("correlation"))
        for c in columns
    ]
    return row.select(F.inline(F.array(*entries)))


def correlation_matrix(df: DataFrame, columns: Sequence[str], places: int = 4) -> DataFrame:
    """All pairwise Pearson correlations, one row per variable."""
    pairs = list(combinations(range(len(columns)), 2))
    row = df.agg(*[F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i, j in pairs])

    def entry(i: int, j: int) -> Column:
        if i == j:
            return F.lit(1.0)
        return F.round(F.col(f"r{min(i, j)}_{max(i, j)}"), places)

    lines = [
        F.struct(
            F.lit(name).alias("variable"),
            *[entry(i, j).alias(other) for j, other in enumerate(columns)],
        )
        for i, name in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*lines)))


# Shares of the variance below this are rounding of the covariances.
_ROUNDING = 1e-13


@dataclass(frozen=True)
class LinearFit:
    """A least-squares fit with constant; the constant comes first in every list."""

    terms: list[str]
    coefficients: list[float]
    std_errors: list[float]
    df_residual: int

    @property
    def t_values(self) -> list[float]:
        """Infinite for a coefficient without error, undefined for 0 without error."""
        return [
            c / s if s else math.copysign(math.inf, c) if c else math.nan
            for c, s in zip(self.coefficients, self.std_errors)
        ]

    @property
    def p_values(self) -> list[float]:
        return [t_two_sided(t, self.df_residual) for t in self.t_values]

    def intervals(self, level: float = 0.95) -> list[tuple[float, float]]:
        reach = t_quantile((1.0 + level) / 2.0, self.df_residual)
        return [
            (c - reach * s, c + reach * s) for c, s in zip(self.coefficients, self.std_errors)
        ]

    def table(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        rows = [
            (term, c, s, t, p, low, high)
            for term, c, s, t, p, (low, high) in zip(
                self.terms,
                self.coefficients,
                self.std_errors,
                self.t_values,
                self.p_values,
                self.intervals(level),
            )
        ]
        return spark.createDataFrame(
            rows,
            "term string, coef double, std_err double, t double, p_value double,"
            " ci_lower double, ci_upper double",
        )

    def prediction(self) -> Column:
        """The fitted value as a column over the predictor columns."""
        parts = [F.col(x) * F.lit(c) for x, c in zip(self.terms[1:], self.coefficients[1:])]
        return reduce(add, parts, F.lit(self.coefficients[0]))

    def predict(self, df: DataFrame, y: str) -> DataFrame:
        """Add the fitted value and the residual of each row."""
        return df.withColumn("predicted", self.prediction()).withColumn(
            "residual", F.col(y) - F.col("predicted")
        )


def fit_linear(df: DataFrame, y: str, xs: Sequence[str]) -> LinearFit:
    """Ordinary least squares of ``y`` on a constant and the columns ``xs``."""
    columns = [*xs, y]
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    complete = df.select(*columns).dropna()
    sums = complete.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    n, size = sums["n"], len(columns)
    means = np.array([sums[f"m{i}"] or 0.0 for i in range(size)])
    block = np.zeros((size, size))
    for i, j in pairs:
        block[i, j] = block[j, i] = n * (sums[f"c{i}_{j}"] or 0.0)
    return solve(xs, n, means, block)


def solve(xs: Sequence[str], n: int, means: np.ndarray, block: np.ndarray) -> LinearFit:
    """The fit from the number of rows, the means and the centred co-moments of ``xs`` and y."""
    p = len(xs)
    df_residual = n - p - 1
    if df_residual < 1:
        raise ValueError(f"{n} rows are too few to fit {p} predictors and a constant")
    # The block is scaled to correlations, so that the units of the columns do not matter.
    scale = np.sqrt(np.diag(block))
    correlations = block / np.outer(np.where(scale > 0, scale, 1), np.where(scale > 0, scale, 1))
    inner = correlations[:p, :p]
    if not scale[:p].all() or np.linalg.matrix_rank(inner, hermitian=True) < p:
        raise ValueError(f"the predictors {', '.join(xs)} depend on each other or are constant")
    inverse = np.linalg.inv(inner) / np.outer(scale[:p], scale[:p])
    weights = np.linalg.solve(inner, correlations[:p, p])
    slopes = weights * scale[p] / scale[:p]
    unexplained = 1.0 - weights @ correlations[:p, p]
    exact = not scale[p] or unexplained <= p * _ROUNDING
    variance = 0.0 if exact else unexplained * block[p, p] / df_residual
    x_means = means[:p]
    constant = means[p] - slopes @ x_means
    constant_error = np.sqrt(variance * (1.0 / n + x_means @ inverse @ x_means))
    errors = np.sqrt(variance * np.diag(inverse))
    return LinearFit(
        ["const", *xs],
        [float(constant), *map(float, slopes)],
        [float(constant_error), *map(float, errors)],
        df_residual,
    )


# Shift and stretch of the inner ranks in Filliben's estimate.
RANK_SHIFT, RANK_STRETCH = 0.3175, 0.365


def _order_statistic_median(rank: Column, n: Column) -> Column:
    """Median of the uniform order statistics (Filliben's estimate)."""
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    return (
        F.when(rank == n, last)
        .when(rank == 1, F.lit(1.0) - last)
        .otherwise((rank - RANK_SHIFT) / (n + RANK_STRETCH))
    )


def probability_plot(df: DataFrame, value: str, key: str) -> DataFrame:
    """Theoretical normal quantile next to each ordered value; ``key`` makes the order unique."""
    ranked = global_rank(df.select(value, key), (value, key))
    ordered = ranked.select("rank", F.col(value).alias("ordered"), "n")
    median = _order_statistic_median(F.col("rank"), F.col("n"))
    return with_normal_quantile(ordered, median, "theoretical").select(
        "rank", "theoretical", "ordered"
    )


def probability_plot_line(plot: DataFrame, places: int = 4) -> DataFrame:
    """The line through a probability plot and its correlation."""
    x, y = "theoretical", "ordered"
    return plot.agg(
        F.round(F.regr_slope(y, x), places).alias("slope"),
        F.round(F.regr_intercept(y, x), places).alias("intercept"),
        F.round(F.corr(x, y), places).alias("r"),
    )
