"""Tail probabilities of the test statistics, and the normal quantile as a column.

The scalar tails run on the driver on one number per test; the normal quantile
is plain column arithmetic so that it stays inside generated code.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

_TINY = 1e-300
_EPS = 1e-15
# Degrees of freedom from which the t tail is the normal one and its first correction: the
# rest is below their inverse square, while the beta function loses digits in proportion.
_NEARLY_NORMAL = 1e6


def _continued_fraction(terms, limit: int = 1_000_000) -> float:
    """Evaluate ``1 / (1 + a1 / (1 + a2 / ...))`` for an endless iterator of a's."""
    value, c, d = 1.0, 1.0, 0.0
    for _, a in zip(range(limit), terms):
        d = 1.0 / ((1.0 + a * d) or _TINY)
        c = (1.0 + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _EPS:
            return 1.0 / value
    raise ArithmeticError("a tail probability did not converge")


def _log_gamma_rest(x: float) -> float:
    """What Stirling's formula leaves out of the logarithm of the gamma function, x >= 10."""
    y = 1.0 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def _log_gamma_quotient(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)), without the difference of two large numbers."""
    if a < 100.0:
        return math.lgamma(a + b) - math.lgamma(a)
    stirling = (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b
    return stirling + _log_gamma_rest(a + b) - _log_gamma_rest(a)


def beta_cdf(x: float, a: float, b: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function; ``rest`` is 1 - x where it is known better."""
    rest = 1.0 - x if rest is None else rest
    if math.isnan(x) or math.isnan(rest):
        return math.nan
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(rest, b, a, x)

    def terms():
        m = 0
        while True:
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            m += 1
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    log_x = math.log(x) if x < 0.5 else math.log1p(-rest)
    log_rest = math.log(rest) if rest < 0.5 else math.log1p(-x)
    large, small = max(a, b), min(a, b)
    log_front = (
        _log_gamma_quotient(large, small) - math.lgamma(small) + a * log_x + b * log_rest
    )
    return math.exp(log_front) / a * _continued_fraction(terms())


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if math.isinf(t):
        return 0.0
    if df > _NEARLY_NORMAL:
        density = math.exp(-t * t / 2.0) / math.sqrt(2.0 * math.pi)
        return math.erfc(abs(t) / math.sqrt(2.0)) + density * (abs(t) ** 3 + abs(t)) / (2.0 * df)
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5, t * t / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Value that a T variable stays below with probability ``p`` >= 0.5."""
    low, high = 0.0, max(2.0, 2.0 * NormalDist().inv_cdf(p))
    while 1.0 - t_two_sided(high, df) / 2.0 < p:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if mid in (low, high):
            break
        if 1.0 - t_two_sided(mid, df) / 2.0 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def f_upper(f: float, df_between: float, df_within: float) -> float:
    """P(F > f)."""
    if math.isinf(f):
        return 0.0
    if df_within > _NEARLY_NORMAL**1.5:
        return chi2_upper(f * df_between, df_between)
    whole = df_within + df_between * f
    return beta_cdf(df_within / whole, df_within / 2.0, df_between / 2.0, df_between * f / whole)


def chi2_upper(x: float, df: float) -> float:
    """P(X > x) of a chi-square variable, by the series of the incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    a, half = df / 2.0, x / 2.0
    log_front = a * math.log(half) - half - math.lgamma(a)
    if half < a + 1.0:
        term = total = 1.0 / a
        n = a
        while term > total * _EPS:
            n += 1.0
            term *= half / n
            total += term
        return max(0.0, 1.0 - math.exp(log_front) * total)
    # Far tail: 1 / (b0 - 1(1-a)/(b1 - 2(2-a)/(b2 - ...))), as a quotient 1 / (1 + a1 / (1 + ...)).
    def terms():
        k = 1
        while True:
            above, below = half + 2 * k - 1 - a, half + 2 * k + 1 - a
            yield -k * (k - a) / (above * below)
            k += 1

    return math.exp(log_front) / (half + 1.0 - a) * _continued_fraction(terms())


# Rational approximation of the normal quantile by Wichura (1988), algorithm AS 241,
# numerator and denominator by ascending power, for the centre, the near tail and the far tail.
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3),
)
_NEAR_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9),
)
_FAR_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15),
)


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    return reduce(lambda acc, c: f"({acc} * {x} + {c!r}D)", reversed(coefficients[:-1]), f"{coefficients[-1]!r}D")


def _rational(pair, x: str) -> str:
    return f"{_polynomial(pair[0], x)} / {_polynomial(pair[1], x)}"


def with_normal_quantile(df: DataFrame, p: Column, name: str) -> DataFrame:
    """Add the inverse of the standard normal distribution function of ``p``, 0 < p < 1.

    Shared terms are columns of their own, so that each is computed once per row.
    """
    terms = (
        df.withColumn("_p", p)
        .selectExpr("*", "_p - 0.5D as _q", "sqrt(-ln(least(_p, 1D - _p))) as _r")
        .selectExpr("*", "0.180625D - _q * _q as _centre", "_r - 1.6D as _near", "_r - 5D as _far")
    )
    value = (
        f"case when abs(_q) <= 0.425D then _q * {_rational(_CENTRE, '_centre')}"
        f" when _r <= 5D then signum(_q) * {_rational(_NEAR_TAIL, '_near')}"
        f" else signum(_q) * {_rational(_FAR_TAIL, '_far')} end"
    )
    return terms.select(*df.columns, F.expr(value).alias(name))
