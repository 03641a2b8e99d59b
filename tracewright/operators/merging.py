"""Statistics of the caller's own that merge: states of parts of a group are made where the rows are, and only states are shuffled.

A statistic has four functions. init() is the state of no values, add(state,
array) takes values in, merge(a, b) makes one state of two, finish(state) is the
result. Registered ones have names, so that a log can say them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.frames import SAMPLE

#: Groups whose states a task holds before it hands them on.
HELD = 10_000


@dataclass(frozen=True)
class Statistic:
    init: Callable[[], Any]
    add: Callable[[Any, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float]


STATISTICS: dict[str, Statistic] = {}


def register(name: str, statistic: Statistic) -> None:
    STATISTICS[name] = statistic


def merged(df: DataFrame, values: list[str], statistics: dict[str, Statistic], masks: dict[str, Column] | None = None, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """<value>_<name> for each group, of the values that aren't null or NaN; masks as in stats.sample_stats. A result that isn't a number is null."""
    masks, chosen = masks or {}, list(statistics.values())
    taken = [(F.when(F.coalesce(masks[v], F.lit(False)), F.col(v)) if v in masks else F.col(v)).cast("double").alias(f"__v{i}") for i, v in enumerate(values)]
    narrow = df.select(*by, *taken)
    keys = [f for f in narrow.schema.fields if f.name in by]
    columns = [f.name for f in keys]
    named = T.StructType([*keys, *[T.StructField(f"{v}_{n}", T.DoubleType()) for v in values for n in statistics]])

    def rows(states: dict, back: dict) -> pd.DataFrame:
        out = pd.DataFrame([(*back[k], pickle.dumps(s)) for k, s in states.items()], columns=[*columns, "state"])
        return out.astype(object).where(out.notna(), None)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states, back = {}, {}
        for pdf in batches:
            for key, part in pdf.groupby(columns, dropna=False, sort=False):
                k = tuple("null" if pd.isna(x) else (x,) for x in key)
                back.setdefault(k, tuple(None if pd.isna(x) else x for x in key))
                own = states.setdefault(k, [s.init() for _ in values for s in chosen])
                for i in range(len(values)):
                    x = part[f"__v{i}"].to_numpy(float)
                    x = x[~np.isnan(x)]
                    for j, s in enumerate(chosen):
                        own[i * len(chosen) + j] = s.add(own[i * len(chosen) + j], x)
            if len(states) >= HELD:
                yield rows(states, back)
                states, back = {}, {}
        yield rows(states, back)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        """A row for each task that had rows of the group."""
        total = None
        for s in pdf["state"]:
            found = pickle.loads(s)
            total = found if total is None else [chosen[j % len(chosen)].merge(a, b) for j, (a, b) in enumerate(zip(total, found, strict=True))]
        done = [float(chosen[j % len(chosen)].finish(x)) for j, x in enumerate(total)]
        return pd.DataFrame([(*[pdf[c].iloc[0] for c in columns], *done)], columns=[f.name for f in named])

    states = narrow.mapInPandas(partial, T.StructType([*keys, T.StructField("state", T.BinaryType())]))
    return states.groupBy(*by).applyInPandas(finish, named)
