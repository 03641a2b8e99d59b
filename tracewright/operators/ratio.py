"""Ratios, interferences and mass fractions, with first-order uncertainties.

A value is a pair of columns, nominal and standard deviation, named x and x_sd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def divided(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def quotient_sd(a: Column, sa: Column, b: Column, sb: Column, cov: Column | float = 0.0) -> Column:
    """Of a / b, with the covariance of a and b."""
    cov = F.lit(cov) if isinstance(cov, (int, float)) else cov
    var = F.try_divide(sa * sa, b * b) + F.try_divide(a * a * sb * sb, b * b * b * b) - F.try_divide(2 * a * cov, b * b * b)
    return F.sqrt(F.greatest(var, F.lit(0.0)))


def product_sd(a: Column, sa: Column, b: Column, sb: Column) -> Column:
    return F.sqrt(b * b * sa * sa + a * a * sb * sb)


def sum_sd(*sds: Column) -> Column:
    """Of a sum or difference of independent values."""
    return F.sqrt(sum((s * s for s in sds), F.lit(0.0)))


def with_ratios(df: DataFrame, values: list[str], standard: str) -> DataFrame:
    """Adds value_standard for each value; null where the standard is null or 0. Parts of a standard that is a ratio itself divide part by part."""
    return df.withColumns({f"{v}_{standard}": divided(F.col(v), F.col(standard)) for v in values if v != standard})


def interference_corrected(df: DataFrame, target: str, source: str, factor: float) -> DataFrame:
    """target - factor * source, its deviation, and the covariance that it then has with source, as target_cov_source."""
    t, s = F.col(f"{target}_sd"), F.col(f"{source}_sd")
    cov = F.lit(-factor) * s * s
    sd = F.sqrt(t * t + factor * factor * s * s)
    return df.withColumn(f"{target}_cov_{source}", cov).withColumn(target, F.col(target) - factor * F.col(source)).withColumn(f"{target}_sd", sd)


def with_mass_fractions(df: DataFrame, ratios: dict[str, tuple[float, float]], concentrations: DataFrame, sample: str = "sample", concentration: str = "int_stand_massfrac") -> DataFrame:
    """Adds <numerator>_massfrac for each ratio of (mass of numerator, mass of denominator); null for samples without a concentration.

    Concentrations, one for each sample, are joined on it; Spark broadcasts
    them if it knows them to be small.
    """
    out = df.join(concentrations.select(sample, concentration), sample, "left")
    return out.withColumns({f"{r.split('_')[0]}_massfrac": F.col(r) * F.col(concentration) * F.lit(n / d) for r, (n, d) in ratios.items()})
