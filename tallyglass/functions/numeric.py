"""Scalar column functions of the detectors: number parsing, digit strings, tail probabilities, severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the normal upper tail passes 1e-10 and 1e-5.
Z_CRITICAL, Z_HIGH = 6.3613409024, 4.2648907939
#: Rational approximation 7.1.26 of erf (Abramowitz and Stegun), |error| < 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(text: Column) -> Column:
    """Double of a cell's text, with % and , deleted; null where it isn't a finite decimal number. "50%" is 50."""
    clean = F.regexp_replace(F.trim(text), "[%,]", "")
    value = clean.try_cast("double")
    return F.when(clean.rlike(_NUMBER) & (F.abs(value) < float("inf")), value)


def general10(value: Column, signed: bool = False) -> Column:
    """The value with up to 10 significant digits, without trailing zeros (C's %.10g); of the absolute value unless signed.

    Where the shortest exact text has 10 digits or fewer it is that text, at a fraction of a formatter's cost.
    """
    x = value if signed else F.abs(value)
    short = x.cast("string")
    plain = F.abs(value).between(1e-3, 9_999_999) & (F.length(F.replace(short, F.lit("-"), F.lit(""))) <= 11)
    text = F.format_string("%.10g", x)
    long = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(value == 0, F.lit("0")).when(plain, F.regexp_replace(short, r"\.0$", "")).otherwise(long)


def last_digit(value: Column) -> Column:
    """Last character of general10 less trailing zeros, as a number; 0 where nothing is left, null for what isn't finite."""
    found = F.regexp_extract(general10(value), "([1-9])0*$", 1)
    return F.when(F.abs(value) < float("inf"), F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(0)))


def fraction_digits(value: Column) -> Column:
    """Digits after the point of general10's mantissa; empty without a point."""
    return F.regexp_extract(F.regexp_replace(general10(value), "e.*$", ""), r"\.(\d+)$", 1)


def erfc_positive(x: Column) -> Column:
    """erfc for x >= 0."""
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def norm_sf(z: Column) -> Column:
    """Upper tail of the standard normal distribution."""
    tail = 0.5 * erfc_positive(F.abs(z) / F.sqrt(F.lit(2.0)))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def norm_cdf(z: Column) -> Column:
    return 1 - norm_sf(z)


def binomial_z(k: Column, n: Column, p: float) -> Column:
    """Standardised count, without continuity correction; null where the deviation is 0."""
    return F.when(n > 0, (k - n * p) / F.sqrt(n * (p * (1 - p))))


def binomial_p(k: Column, n: Column, p: float) -> Column:
    """Chance of k or more of n by the normal tail: 1 for nothing counted or less than expected, 0 beyond 20 deviations."""
    z = binomial_z(k, n, p)
    return F.when((k == 0) | (n == 0), 1.0).when(z > 20, 0.0).when(z < 0, 1.0).otherwise(norm_sf(z))


def severity(z: Column) -> Column:
    """CRITICAL below a tail of 1e-10, HIGH below 1e-5, else MEDIUM."""
    return F.when(z > Z_CRITICAL, "CRITICAL").when(z > Z_HIGH, "HIGH").otherwise("MEDIUM")


def p_text(p: Column) -> Column:
    """How a report prints a probability."""
    return (
        F.when(p <= 1e-300, "≈ 0")
        .when(p < 1e-18, "p < 10^-18")
        .when(p < 1e-3, F.format_string("%.2e", p))
        .otherwise(F.format_string("%.4f", p))
    )


def t4_two_sided(t: Column) -> Column:
    """Two-sided tail of Student's t with 4 degrees of freedom, in closed form."""
    x = F.abs(t)
    q = 1 + x * x / 4
    cdf = 0.5 + 0.375 * x / F.sqrt(q) * (1 - x * x / (12 * q))
    return 2 * (1 - cdf)


def p_from_t(t: Column, df: Column) -> Column:
    """Two-sided, by a normal approximation."""
    return 2 * norm_sf(F.abs(t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))))


def p_from_f(f: Column, d1: Column, d2: Column) -> Column:
    """Two-sided, by Paulson's cube-root transformation; 1 for f <= 0."""
    a, b = 2 / (9 * d1), 2 / (9 * d2)
    cube = F.cbrt(f)
    z = ((1 - b) * cube - (1 - a)) / F.sqrt(b * cube * cube + a)
    return F.when(f <= 0, 1.0).otherwise(2 * norm_sf(F.abs(z)))


def p_from_chi2(x: Column, df: Column) -> Column:
    """Upper tail, by the Wilson-Hilferty transformation; 1 for x <= 0."""
    a = 2 / (9 * df)
    return F.when(x <= 0, 1.0).otherwise(norm_sf((F.cbrt(x / df) - (1 - a)) / F.sqrt(a)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two whole numbers."""
    return F.bit_count(a.bitwiseXOR(b))
