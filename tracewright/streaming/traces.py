"""Despiking and runs of signal in a stream, with the rows that the table gives.

A sample's readings are traces, parted where nothing comes for longer than a
gap. A reading waits until the watermark has passed it, so readings enter their
trace in order of time, however they came. A pass of despiking looks at a frame
around a row, so a row is done when passes * half a frame of later ones have
entered, or when the trace has ended; as many earlier ones are kept. A trace's
state is these rows, those that wait, and a few numbers, however long it is,
and it goes when the watermark says that the trace has ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tracewright.operators import despike
from tracewright.operators.frames import IDX, ROWS, SAMPLE, odd

START = "start"
ROW = "us long, v array<double>"


def passes(x: np.ndarray, before: int, ended: bool, half: int, nlim: float, maxiter: int) -> np.ndarray:
    """despike.noise for rows x of one trace, with `before` rows ahead of them. Rows within maxiter * half of an end that isn't the trace's are not done."""
    x, n = x.copy(), len(x)
    if n <= 2 * half:
        return x
    at = np.arange(half, n - half)
    whole = at + before >= half
    for _ in range(maxiter):
        frames = np.stack([x[half + k : n - half + k] for k in range(-half, half + 1)])
        known = ~np.isnan(frames)
        total = np.zeros(len(at))
        for f, k in zip(frames, known, strict=True):  # summed in order, as a window sums
            total = total + np.where(k, f, 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = total / known.sum(axis=0)
            over = whole & (mean >= 0) & (x[at] > mean + nlim * np.sqrt(np.maximum(mean, 0.0)))
        x[at] = np.where(over, mean, x[at])
    return x


class Despiker(StatefulProcessor):
    def __init__(self, sample: str, values: list[str], limit: float, gap_us: int, half: int, nlim: float, maxiter: int):
        self.sample, self.values, self.limit, self.gap = sample, values, limit, gap_us
        self.half, self.nlim, self.maxiter, self.reach = half, nlim, maxiter, half * maxiter

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.near = handle.getListState("near", ROW)
        # First and last time, rows that entered, rows that are done, whether the last of these is signal, and its run.
        self.trace = handle.getValueState("trace", "start long, last long, entered long, done long, on boolean, run int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            numbers = part[[f"v{i}" for i in range(len(self.values))]].to_numpy(float, na_value=np.nan)
            self.waiting.appendList([(int(t), [None if np.isnan(x) else float(x) for x in v]) for t, v in zip(part["us"].to_list(), numbers, strict=True)])
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def advance(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """Takes up what the watermark has passed, and sets the timer for what comes next."""
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in held if r[0] <= watermark), key=lambda r: (r[0], [(x is not None, x or 0.0) for x in r[1]]))
        late = [r for r in held if r[0] > watermark]
        state = list(self.trace.get()) if self.trace.exists() else None
        near = [tuple(r) for r in self.near.get()] if self.near.exists() else []
        at = 0
        while at < len(ready):
            if state is not None and ready[at][0] - state[1] > self.gap:
                yield from self.extend(key, state, near, [], True)
                state, near = None, []
            if state is None:
                state = [ready[at][0], ready[at][0], 0, 0, False, 0]
            last, stop = state[1], at
            while stop < len(ready) and ready[stop][0] - last <= self.gap:
                last, stop = ready[stop][0], stop + 1
            state[1] = last
            yield from self.extend(key, state, near, ready[at:stop], False)
            at = stop
        if state is not None and state[1] + self.gap <= watermark:
            yield from self.extend(key, state, near, [], True)
            state, near = None, []

        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        next_at = ([min(r[0] for r in late)] if late else []) + ([state[1] + self.gap] if state is not None else [])
        if next_at:
            self.handle.registerTimer(-(-min(next_at) // 1000))
        for held_state, now in ((self.waiting, late), (self.near, near)):
            held_state.put(now) if now else held_state.clear()
        self.trace.update(tuple(state)) if state is not None else self.trace.clear()

    def extend(self, key, state: list, near: list, rows: list, ended: bool) -> Iterator[pd.DataFrame]:
        """Adds rows to the trace, and gives those that are done; state and near are changed in place."""
        start, _, entered, done, on, run = state
        base = entered - len(near)
        near += rows
        entered += len(rows)
        until = entered if ended else max(done, entered - self.reach)
        if until > done:
            raw = np.array([[np.nan if x is None else x for x in v] for _, v in near], float).reshape(len(near), len(self.values))
            clean = np.stack([passes(raw[:, c], base, ended, self.half, self.nlim, self.maxiter) for c in range(len(self.values))], axis=1)[done - base : until - base]
            signal = clean[:, 0] > self.limit
            begins = signal & ~np.concatenate([[on], signal[:-1]])
            runs = run + np.cumsum(begins)
            out = pd.DataFrame({self.sample: [key[0]] * (until - done), "__start": start, IDX: np.arange(done, until, dtype=np.int32), "__us": [t for t, _ in near[done - base : until - base]]})
            for c, v in enumerate(self.values):
                out[v] = pd.array(clean[:, c], "Float64")
                out.loc[np.isnan(clean[:, c]), v] = pd.NA
            out["run"] = np.where(signal, runs, 0).astype(np.int32)
            on, run = bool(signal[-1]), int(runs[-1])
            yield out
        del near[: max(0, until - self.reach) - base]
        state[2:] = [entered, until, on, run]


def despiked_traces(df: DataFrame, values: list[str], limit: float, *, gap: float = 1800.0, late: str = "1 hour", win: int = 3, nlim: float = 12.0, maxiter: int = 4, sample: str = SAMPLE, time: str = "ts") -> DataFrame:
    """(sample, start, idx, time, <values>, run): readings without noise spikes, and the run of signal that each is in.

    A trace is a sample's readings with gaps of at most `gap` seconds; start is
    its first time and idx a row's place in it. run numbers a trace's stretches
    of despiked first values over limit from 1, and is 0 outside. Readings of
    one time go in order of value. NaN counts as null: it has no part in means
    and is no signal. Rows without sample or time take no part.

    df may be a table or a stream. A stream gives the table's rows once the
    watermark has passed them, without those that come later than `late`; it
    needs RocksDB as its state store (spark.sql.streaming.stateStore.providerClass).
    """
    if not values or win < 1 or maxiter < 1:
        raise ValueError("despiked_traces needs values, a window and a pass at least")
    rows = df.where(F.col(sample).isNotNull() & F.col(time).isNotNull())
    number = [F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")).alias(v) for v in values]
    us, gap_us = F.unix_micros(F.col(time).cast("timestamp")).alias("__us"), round(gap * 1e6)
    if df.isStreaming:
        kind = df.schema[sample].dataType
        fields = [T.StructField(sample, kind), T.StructField("__start", T.LongType()), T.StructField(IDX, T.IntegerType()), T.StructField("__us", T.LongType()), *[T.StructField(v, T.DoubleType()) for v in values], T.StructField("run", T.IntegerType())]
        # Names of its own: a worker's rows keep only those that are Python's.
        seen = rows.withWatermark(time, late).select(F.col(sample).alias("key"), F.col(time).alias("at"), us.alias("us"), *[x.alias(f"v{i}") for i, x in enumerate(number)])
        out = seen.groupBy("key").transformWithStateInPandas(Despiker(sample, list(values), limit, gap_us, odd(win) // 2, nlim, maxiter), T.StructType(fields), "Append", "EventTime")
    else:
        in_time = Window.partitionBy(sample).orderBy("__us", *values)
        begins = F.coalesce(F.col("__us") - F.lag("__us").over(in_time) > gap_us, F.lit(True))
        marked = rows.select(sample, us, *number).withColumn("__begin", F.when(begins, F.col("__us")))
        # A start is later than the one before it, so the latest so far is the row's own.
        traces = marked.withColumn("__start", F.max("__begin").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
        of = (sample, "__start")
        own = Window.partitionBy(*of)
        traces = traces.withColumn(IDX, (F.row_number().over(own.orderBy("__us", *values)) - 1)).withColumn(ROWS, F.count(F.lit(1)).over(own))
        signal = F.coalesce(F.col(values[0]) > limit, F.lit(False))
        clean = despike.noise(traces, list(values), win, nlim, maxiter, of).withColumn("__on", signal)
        first = F.col("__on") & ~F.coalesce(F.lag("__on").over(own.orderBy(IDX)), F.lit(False))
        clean = clean.withColumn("__first", first.cast("int"))
        run = F.sum("__first").over(own.orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)).cast("int")
        out = clean.withColumn("run", F.when(F.col("__on"), run).otherwise(0))
    return out.select(sample, F.timestamp_micros("__start").alias(START), IDX, F.timestamp_micros("__us").alias(time), *values, "run")
