"""Names of measured channels: element letters and mass number, in either order, or two of them as a ratio."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def element(name: Column) -> Column:
    return F.regexp_extract(name, "[A-Za-z]{1,3}", 0)


def mass(name: Column) -> Column:
    return F.regexp_extract(name, "[0-9]{1,3}", 0)


def _each(name: Column, part) -> Column:
    return F.array_join(F.transform(F.split(name, "_"), part), "_")


def name_mass(name: Column) -> Column:
    """27Al to Al27, in each part of a ratio."""
    return _each(name, lambda p: F.concat(element(p), mass(p)))


def mass_name(name: Column) -> Column:
    """Al27 to 27Al, in each part of a ratio."""
    return _each(name, lambda p: F.concat(mass(p), element(p)))


def pretty(name: Column) -> Column:
    """With the mass as a superscript for TeX, parts of a ratio over each other by "/"."""
    return F.array_join(F.transform(F.split(name, "_"), lambda p: F.concat(F.lit("$^{"), mass(p), F.lit("}$"), element(p))), "/")


def parts(names: Column) -> Column:
    """The distinct parts of an array of names and ratios."""
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.split(n, "_"))))


def sort_key(name: str) -> tuple:
    m = re.search("[0-9]{1,3}", name)
    return (0, int(m[0]), name) if m else (1, 0, name)


def in_order(names) -> list[str]:
    """By mass, then by name; names without a mass last."""
    return sorted(names, key=sort_key)


def resolve(wanted: str | list[str] | None, present: list[str], single: bool = False) -> list[str]:
    """Names that are present: as they are, or ratios of which they are the numerator."""
    if wanted is None:
        wanted = present
    wanted = [wanted] if isinstance(wanted, str) else list(wanted)
    out = [p for p in present if p in wanted or p.split("_")[0] in wanted]
    if not out:
        raise ValueError(f"none of {wanted} is among {present}")
    out = in_order(out)
    return out[:1] if single else out


def unit_factor(quantile: Column) -> Column:
    """The power of 1000 that brings a value to 1 or over."""
    return F.pow(F.lit(10.0), F.ceil(-F.log10(F.abs(quantile)) / 3) * 3)
