"""Long traces in blocks with borders.

A window over a trace is one task, however long the trace is. Here its rows, in
order of idx from 0 on without gaps, are dealt out in blocks of SIZE rows, and
each block has copies of the rows on both sides of it that its own rows' frames
reach. Every block then goes through the same window expressions as a whole
trace does (operators/frames, despike), its copies are dropped, and all its own
rows have what the whole trace's window would give them. What needs more than
neighbours is told for each block and stitched: runs are numbered within blocks,
and a prefix sum over a trace's blocks says where each block's numbers start; a
stretch that goes on over borders is counted piece by piece, and its pieces are
added up.

A block is one key of a shuffle, with SIZE rows. What a whole trace says (the
number of its rows, its leading values) is an aggregate that is joined to its
blocks, a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import despike, frames
from tracewright.operators.frames import BLOCKS, IDX, ROWS, SAMPLE, TIME, order
from tracewright.operators.runs import true

SIZE = 100_000
BLOCK, OWN = BLOCKS[1], "__own"


def blocked(df: DataFrame, halo: int, whole: dict[str, Column] | None = None, size: int | None = None) -> DataFrame:
    """Rows in blocks, with copies of the `halo` rows on both sides: adds __block, __own (false for copies), __rows (the trace's) and the aggregates in `whole`."""
    size = size or SIZE
    if halo > size:
        raise ValueError(f"a block of {size} rows can't have borders of {halo}")
    of = df.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias(ROWS), *[x.alias(name) for name, x in (whole or {}).items()])
    blocks = of.withColumn(BLOCK, F.explode(F.sequence(F.lit(0), F.floor((F.col(ROWS) - 1) / size).cast("int"))))
    own, at = F.floor(F.col(IDX) / size).cast("int"), F.col(IDX)
    near = F.filter(F.array(own - 1, own, own + 1), lambda b: (at >= b.cast("long") * size - halo) & (at < (b.cast("long") + 1) * size + halo))
    rows = df.withColumn(BLOCK, F.explode(near)).withColumn(OWN, F.col(BLOCK) == own)
    return rows.join(blocks, [*BLOCKS])  # copies for blocks that aren't there go


def owned(df: DataFrame, *also: str) -> DataFrame:
    """Blocks' own rows, as the trace had them."""
    return df.where(OWN).drop(BLOCK, OWN, ROWS, *also)


def smoothed(df: DataFrame, value: str, win: int, name: str = "smooth", size: int | None = None) -> DataFrame:
    return owned(blocked(df, win + 2, size=size).withColumn(name, frames.smoothed(value, win, BLOCKS)))


def gradient_by_row(df: DataFrame, value: str, win: int, name: str = "gradient", size: int | None = None) -> DataFrame:
    return owned(blocked(df, win, size=size).withColumn(name, frames.gradient_by_row(value, win, BLOCKS)))


def with_gradient(df: DataFrame, value: str, win: int, mode: str = "mid", name: str = "gradient", time: str = TIME, size: int | None = None) -> DataFrame:
    """The ends repeat the nearest full frame, which may be the neighbouring block's: borders are two frames wide."""
    return owned(frames.with_gradient(blocked(df, 2 * win, size=size), value, win, mode, name, time, BLOCKS))


def correlation(df: DataFrame, x: str, y: str, win: int, size: int | None = None) -> DataFrame:
    """Adds r and pairs."""
    r, pairs = frames.correlation(x, y, win, BLOCKS)
    return owned(blocked(df, win + 1, size=size).withColumn("r", r).withColumn("pairs", pairs))


def despiked(df: DataFrame, values: list[str], exponent: float | None = None, step: float = 1.0, win: int = 3, nlim: float = 12.0, maxiter: int = 4, total: str = "total_counts", size: int | None = None) -> DataFrame:
    """Each pass looks at what the last one made of the neighbours, so borders are as wide as all passes together."""
    halo = maxiter * (frames.odd(win) // 2 + (exponent is not None))
    whole = {name: x for v in values for name, x in despike.start(v).items()} if exponent is not None else None
    return owned(despike.despiked(blocked(df, halo, whole, size), values, exponent, step, win, nlim, maxiter, total, BLOCKS))


def _starts(counts: DataFrame, value: str, name: str) -> DataFrame:
    """(sample, __block, name): the sum of value over the blocks before; counts has a row for each block."""
    before = Window.partitionBy(SAMPLE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*BLOCKS, F.coalesce(F.sum(value).over(before), F.lit(0)).alias(name))


def _counted(df: DataFrame, step: Column, name: str, size: int | None) -> DataFrame:
    """Blocks with one row on either side, and the number of rows up to each, from the trace's first on, for which step holds; step may look one row back."""
    # Of the row before a block nothing is counted: it is its own block's.
    first = F.col(BLOCK).cast("long") * (size or SIZE)
    rows = blocked(df, 1, size=size).withColumn("__step", F.when(F.col(IDX) >= first, step.cast("int")).otherwise(0))
    starts = _starts(rows.where(OWN).groupBy(*BLOCKS).agg(F.sum("__step").alias("__steps")), "__steps", "__start")
    upto = F.sum("__step").over(order(BLOCKS).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(starts, [*BLOCKS]).withColumn(name, F.col("__start") + upto).drop("__start", "__step")


def _runs(df: DataFrame, mask: str, name: str, start: int, size: int | None) -> DataFrame:
    begins = true(mask) & ~F.coalesce(F.lag(true(mask)).over(order(BLOCKS)), F.lit(False))
    rows = _counted(df, begins, name, size)
    return rows.withColumn(name, F.when(true(mask), (F.col(name) + (start - 1)).cast("int")).otherwise(0))


def number(df: DataFrame, mask: str, name: str = "run", start: int = 1, size: int | None = None) -> DataFrame:
    """runs.number."""
    return owned(_runs(df, mask, name, start, size))


def enumerated(df: DataFrame, mask: str, name: str = "ns", size: int | None = None) -> DataFrame:
    """runs.enumerated."""
    ahead = F.coalesce(F.lead("__run").over(order(BLOCKS)), F.lit(0))
    own = F.when(F.col("__run") > 0, F.col("__run")).otherwise(ahead)
    rows = _runs(df, mask, "__run", 1, size).withColumn(name, F.when(F.col(IDX) == F.col(ROWS) - 1, 0).otherwise(own))
    return owned(rows, "__run")


def _lengths(df: DataFrame, mask: str, size: int | None) -> DataFrame:
    """Blocks' own rows with the number of each stretch of equal values, and its length: one that starts at row 0 counts one less."""
    change = F.coalesce(true(mask) != F.lag(true(mask)).over(order(BLOCKS)), F.lit(False))
    rows = _counted(df, change & (F.col(IDX) > 0), "__stretch", size).where(OWN)
    pieces = rows.groupBy(*BLOCKS, "__stretch").agg(F.count(F.lit(1)).alias("__piece"))
    total = F.sum("__piece").over(Window.partitionBy(SAMPLE, "__stretch"))  # a row for each block that the stretch has
    sized = pieces.select(*BLOCKS, "__stretch", (total - (F.col("__stretch") == 0).cast("int")).alias("__length"))
    return rows.join(sized, [*BLOCKS, "__stretch"])


def _told(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Own rows of blocks with what is told of their trace (sample, ...), joined by block."""
    blocks = rows.select(*BLOCKS).distinct().join(whole, SAMPLE, "left")
    return rows.join(blocks, [*BLOCKS], "left")


def defragmented(df: DataFrame, mask: str, threshold: int = 3, mode: str = "include", name: str = "defrag", size: int | None = None) -> DataFrame:
    """runs.defragmented."""
    if mode not in ("include", "exclude"):
        raise ValueError(f"mode is include or exclude, not {mode!r}")
    other = mode == "include"
    any_ = df.groupBy(SAMPLE).agg(F.max(true(mask).cast("int")).alias("__has"))
    rows = _told(_lengths(df, mask, size), any_)
    turn = (true(mask) != F.lit(other)) & (F.col("__length") <= threshold) & (F.col(IDX) > 0) & (F.col("__has") == 1)
    return owned(rows.withColumn(name, F.when(turn, F.lit(other)).otherwise(true(mask))), "__stretch", "__length", "__has")


def without_downhole(df: DataFrame, mask: str, threshold: int = 2, name: str = "kept", size: int | None = None) -> DataFrame:
    """runs.without_downhole."""
    rows = _lengths(df, mask, size)
    out = rows.where(~true(mask) & (F.col("__length") >= threshold)).groupBy(SAMPLE, "__stretch").agg(F.min(IDX).alias("__first"))
    nth = F.row_number().over(Window.partitionBy(SAMPLE).orderBy("__stretch"))  # a row for each stretch that is out
    limit = out.withColumn("__nth", nth).where("__nth = 2").select(SAMPLE, F.greatest(F.col("__first") - 1, F.lit(0)).alias("__limit"))
    kept = true(mask) & ~F.coalesce(F.col(IDX) >= F.col("__limit"), F.lit(False))
    return owned(_told(rows, limit).withColumn(name, kept), "__stretch", "__length", "__limit")
