"""Values with errors that may share their sources, to first order.

An error is kept by its sources: what one deviation of each source adds to the
value. Sources are independent of each other and have names; a value's variance
is the sum of its parts' squares. Two values that go back to one source have
parts of the same name, which add or cancel when the values are combined: no
covariance is written down, and none is lost. All is expressions of columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Uncertain:
    value: Column
    parts: dict[str, Column] = field(default_factory=dict)

    def _with(self, other: Uncertain, value: Column, own: Column, theirs: Column) -> Uncertain:
        """A value that moves by `own` with this one and by `theirs` with the other."""
        parts = {s: own * p for s, p in self.parts.items()}
        for s, p in other.parts.items():
            parts[s] = parts[s] + theirs * p if s in parts else theirs * p
        return Uncertain(value, parts)

    def __add__(self, other: Uncertain | float) -> Uncertain:
        other = uncertain(other)
        return self._with(other, self.value + other.value, F.lit(1.0), F.lit(1.0))

    def __sub__(self, other: Uncertain | float) -> Uncertain:
        other = uncertain(other)
        return self._with(other, self.value - other.value, F.lit(1.0), F.lit(-1.0))

    def __mul__(self, other: Uncertain | float) -> Uncertain:
        other = uncertain(other)
        return self._with(other, self.value * other.value, other.value, self.value)

    __radd__, __rmul__ = __add__, __mul__

    def __truediv__(self, other: Uncertain | float) -> Uncertain:
        """Null where the other is 0."""
        other = uncertain(other)
        value = F.try_divide(self.value, other.value)
        return self._with(other, value, F.try_divide(F.lit(1.0), other.value), -F.try_divide(value, other.value))

    def sd(self) -> Column:
        """Null where a part is."""
        return F.sqrt(sum((p * p for p in self.parts.values()), F.lit(0.0)))


def uncertain(x: Uncertain | Column | float) -> Uncertain:
    return x if isinstance(x, Uncertain) else Uncertain(x if isinstance(x, Column) else F.lit(float(x)))


def pair(a: Column, a_sd: Column, b: Column, b_sd: Column, cov: Column, sources: tuple[str, str]) -> tuple[Uncertain, Uncertain]:
    """Two values with a covariance: all of a's error is the first source's, and of b's what goes with it; the rest is the second's."""
    along = F.coalesce(F.try_divide(cov, a_sd), F.lit(0.0))
    own = F.sqrt(F.greatest(b_sd * b_sd - along * along, F.lit(0.0)))
    return Uncertain(a, {sources[0]: a_sd}), Uncertain(b, {sources[0]: along, sources[1]: own})
