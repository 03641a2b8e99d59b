"""Molecules, molar masses and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard atomic weights (fixed values, conventional where an interval is given; the mass number of the longest-lived isotope where none is stable).
WEIGHTS = {
    "H": 1.008, "He": 4.0026, "Li": 6.94, "Be": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Ne": 20.180,
    "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Ar": 39.95, "K": 39.098, "Ca": 40.078,
    "Sc": 44.956, "Ti": 47.867, "V": 50.942, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38,
    "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904, "Kr": 83.798, "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224,
    "Nb": 92.906, "Mo": 95.95, "Tc": 97.0, "Ru": 101.07, "Rh": 102.906, "Pd": 106.42, "Ag": 107.868, "Cd": 112.414, "In": 114.818, "Sn": 118.710,
    "Sb": 121.760, "Te": 127.60, "I": 126.904, "Xe": 131.293, "Cs": 132.905, "Ba": 137.327, "La": 138.905, "Ce": 140.116, "Pr": 140.908, "Nd": 144.242,
    "Pm": 145.0, "Sm": 150.36, "Eu": 151.964, "Gd": 157.25, "Tb": 158.925, "Dy": 162.500, "Ho": 164.930, "Er": 167.259, "Tm": 168.934, "Yb": 173.045,
    "Lu": 174.967, "Hf": 178.486, "Ta": 180.948, "W": 183.84, "Re": 186.207, "Os": 190.23, "Ir": 192.217, "Pt": 195.084, "Au": 196.967, "Hg": 200.592,
    "Tl": 204.38, "Pb": 207.2, "Bi": 208.980, "Po": 209.0, "At": 210.0, "Rn": 222.0, "Fr": 223.0, "Ra": 226.0, "Ac": 227.0, "Th": 232.038,
    "Pa": 231.036, "U": 238.029,
}
#: An element with its count, or a bracket; a closing one has the number of times.
TOKEN = r"[A-Z][a-z]?[0-9]*|\(|\)[0-9]*"


def decomposed(formula: Column) -> Column:
    """map(element, count) of a formula; repeated elements add up, and what is in brackets, within others too, counts as often as the number behind them says.

    Null for what isn't wholly made of elements, counts and closed brackets.
    """
    tokens = F.regexp_extract_all(formula, F.lit(TOKEN), F.lit(0))
    number = lambda t: F.coalesce(F.try_to_number(F.regexp_extract(t, "([0-9]+)$", 1), F.lit("999999999")).cast("int"), F.lit(1))
    state = lambda stack, found, ok: F.struct(stack.alias("stack"), found.alias("found"), ok.alias("ok"))
    start = state(F.array(F.lit(1)), F.array().cast("array<struct<e: string, n: int>>"), F.lit(True))

    def step(s: Column, t: Column) -> Column:
        """From the right: a closing bracket begins a factor, the opening one ends it."""
        factor, deep = F.element_at(s["stack"], -1), F.size(s["stack"]) > 1
        atom = F.struct(F.regexp_extract(t, "^[A-Z][a-z]?", 0).alias("e"), (number(t) * factor).alias("n"))
        closed = state(F.concat(s["stack"], F.array(number(t) * factor)), s["found"], s["ok"])
        opened = state(F.when(deep, F.slice(s["stack"], 1, F.size(s["stack"]) - 1)).otherwise(s["stack"]), s["found"], s["ok"] & deep)
        return F.when(F.startswith(t, F.lit(")")), closed).when(t == "(", opened).otherwise(state(s["stack"], F.concat(s["found"], F.array(atom)), s["ok"]))

    def counted(s: Column) -> Column:
        keys = F.array_distinct(F.transform(s["found"], lambda x: x["e"]))
        total = lambda e: F.aggregate(F.filter(s["found"], lambda x: x["e"] == e), F.lit(0), lambda n, x: n + x["n"])
        return F.when(s["ok"] & (F.size(s["stack"]) == 1), F.map_from_arrays(keys, F.transform(keys, total)))

    read = F.array_join(tokens, "") == formula
    return F.when(read, F.get(F.transform(F.array(F.aggregate(F.reverse(tokens), start, step)), counted), 0))


def molar_mass(formula: Column, weights: dict[str, float] | None = None) -> Column:
    """Sum over the elements; null if one isn't in the table."""
    table = F.create_map(*[F.lit(x) for kv in (weights or WEIGHTS).items() for x in kv])
    return F.aggregate(F.map_entries(decomposed(formula)), F.lit(0.0), lambda a, e: a + F.try_element_at(table, e["key"]) * e["value"])


def mean_masses(isotopes: DataFrame) -> DataFrame:
    """(element, mass): isotopes' weights by their abundance in percent."""
    return isotopes.groupBy("element").agg((F.sum(F.col("atomic_weight") * F.col("percent")) / 100).alias("mass"))


def molar_ratio(fraction_n, fraction_d, mass_n, mass_d) -> Column:
    return F.try_divide(F.try_divide(fraction_n, mass_n), F.try_divide(fraction_d, mass_d))


def mass_fraction(ratio, fraction_d, mass_n, mass_d) -> Column:
    return F.try_divide(ratio * fraction_d * mass_n, mass_d)


def per_gram(value: Column, unit: Column) -> Column:
    """Percent by mass and micrograms per gram as grams per gram; null for other units."""
    return F.when(unit == "%m/m", value / 100).when(unit == "ug/g", value / 1e6)
