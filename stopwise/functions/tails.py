"""Tails of the normal and chi-squared distributions as column expressions.

Both are the upper incomplete gamma function: by its series below the bulk of the distribution, by
its continued fraction above. The number of terms follows the degrees of freedom.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stirling's series, 1 / (12 x), -1 / (360 x^3), ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
SHIFT = 8
HALF_LOG_TWO_PI = 0.9189385332046727


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function of a positive number, by Stirling's series for a + 8."""
    x = a + SHIFT
    out = (x - 0.5) * F.log(x) - x + HALF_LOG_TWO_PI
    for k, c in enumerate(STIRLING):
        out = out + c / F.pow(x, F.lit(2 * k + 1))
    for k in range(SHIFT):
        out = out - F.log(a + k)
    return out


def gamma_tail(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function Q(a, x) for a > 0; 1 for x <= 0, null for nulls."""
    a, x = a.cast("double"), x.cast("double")
    terms = F.sequence(F.lit(1), F.ceil(F.sqrt(a) * 12).cast("int") + 80)
    front = F.exp(a * F.log(x) - x - log_gamma(a))

    def term(s: Column, n: Column) -> Column:
        t = s["t"] * x / (a + n)
        return F.struct(t.alias("t"), (s["sum"] + t).alias("sum"))

    first = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum"))
    below = 1.0 - front / a * F.aggregate(terms, first, term, lambda s: s["sum"])
    # from the innermost fraction outwards
    fraction = F.aggregate(
        F.reverse(terms), F.lit(0.0), lambda s, n: n * (a - n) / (x + n * 2.0 + 1.0 - a + s)
    )
    above = front / (x + 1.0 - a + fraction)
    return F.when(x <= 0, 1.0).when(x < a + 1, below).when(x >= a + 1, F.greatest(above, F.lit(0.0)))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal; null for null."""
    return gamma_tail(F.lit(0.5), z * z / 2)


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared; null for null and for no degrees of freedom."""
    return F.when(df > 0, gamma_tail(df / 2.0, x / 2.0))
