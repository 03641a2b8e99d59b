"""Reference materials: their ratios, which one a measured standard is, and calibration lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.ranked import RANGE, ranged, running


def reference_ratios(items: DataFrame, pairs: list[tuple[str, str, float]], srm: str = "srm", item: str = "item", value: str = "mol_g", error: str = "mol_g_err") -> DataFrame:
    """(srm, ratio, srm_mean, srm_err) for each (numerator, denominator, stoichiometry) within each material; a missing error counts as 0."""
    wanted = items.sparkSession.createDataFrame([(f"{n}_{d}", n, d, float(k)) for n, d, k in pairs], "ratio string, n string, d string, k double")
    side = lambda p: items.select(F.col(srm).alias("srm"), F.col(item).alias(p), F.col(value).alias(f"{p}v"), F.coalesce(F.col(error), F.lit(0.0)).alias(f"{p}e"))
    both = F.broadcast(wanted).join(side("n"), "n").join(side("d"), ["srm", "d"])  # wanted: a row for each pair that the caller names
    mean = F.try_divide(F.col("nv") * F.col("k"), F.col("dv"))
    rel = lambda p: F.try_divide(F.col(f"{p}e"), F.col(f"{p}v"))
    return both.select("srm", "ratio", mean.alias("srm_mean"), (mean * F.sqrt(rel("n") * rel("n") + rel("d") * rel("d"))).alias("srm_err"))


def first_match(wanted: DataFrame, items: DataFrame, how: list[Column], key: str, name: str = "item") -> DataFrame:
    """Adds, to each wanted row, the item that the first condition of `how` alone finds; a condition that finds several items takes the first by name."""
    found = [wanted.join(items, c).groupBy(key).agg(F.min(name).alias(f"__m{i}")) for i, c in enumerate(how)]
    out = reduce(lambda a, b: a.join(b, key, "left"), found, wanted)
    return out.withColumn(name, F.coalesce(*[F.col(f"__m{i}") for i in range(len(how))])).drop(*[f"__m{i}" for i in range(len(how))])


def standardised_log(df: DataFrame, ratio: str, value: str) -> DataFrame:
    """Adds z: log10 of the value, standardised among all rows of its ratio; -12 where there is none."""
    log = F.when(F.col(value) > 0, F.log10(value))
    of = Window.partitionBy(ratio)
    return df.withColumn("__l", log).withColumn("z", F.coalesce(F.try_divide(F.col("__l") - F.avg("__l").over(of), F.stddev_pop("__l").over(of)), F.lit(-12.0))).drop("__l")


def nearest_reference(measured: DataFrame, references: DataFrame, key: str = "std") -> DataFrame:
    """(key, srm, distance2) from (key, ratio, meas_mean) and (srm, ratio, srm_mean): the nearest in standardised logs over all ratios.

    They meet by ratio; a measured standard has a row for each material then,
    and materials are a table of a few rows each ratio.
    """
    m = standardised_log(measured, "ratio", "meas_mean").select(key, "ratio", F.col("z").alias("zm"))
    r = standardised_log(references, "ratio", "srm_mean").select("srm", "ratio", F.col("z").alias("zr"))
    d = m.join(r, "ratio").groupBy(key, "srm").agg(F.sum((F.col("zm") - F.col("zr")) * (F.col("zm") - F.col("zr"))).alias("d2"))
    return d.groupBy(key).agg(F.min(F.struct("d2", "srm")).alias("m")).select(key, F.col("m.srm").alias("srm"), F.col("m.d2").alias("distance2"))


def points(measured: DataFrame, references: DataFrame, key: str = "std") -> DataFrame:
    """measured with srm, srm_mean and srm_err of each standard's nearest reference: what calibration fits.

    The means that the search needs are carried through it, so that neither
    side is made twice: each standard meets every material once, and its rows
    of the nearest one remain.
    """
    m = standardised_log(measured, "ratio", "meas_mean").withColumnRenamed("z", "__zm")
    r = standardised_log(references, "ratio", "srm_mean").select("srm", "ratio", "srm_mean", "srm_err", F.col("z").alias("__zr"))
    both = m.join(r, "ratio", "left")
    distance = F.sum((F.col("__zm") - F.col("__zr")) * (F.col("__zm") - F.col("__zr"))).over(Window.partitionBy(key, "srm"))
    both = both.withColumn("__d", F.when(F.col("srm").isNotNull(), F.struct(distance.alias("d"), F.col("srm").alias("srm"))))
    return both.withColumn("__least", F.min("__d").over(Window.partitionBy(key))).where("__d = __least").drop("__zm", "__zr", "__d", "__least")


def consecutive_groups(runs: DataFrame, is_standard: str, time: str) -> DataFrame:
    """(rows of standards, grp, g_time): a new group begins when more than one other run started since the standard before; g_time is the group's mean time.

    runs has one row for each analysis. Their order in time is one sequence,
    taken in ranges of distinct times: analyses of one time start together.
    """
    std = F.col(is_standard)
    times = ranged(runs.groupBy(F.col(time).alias("__t")).agg(F.count_if(~std).alias("__n"), F.count_if(std).alias("__s"), F.sum(F.when(std, F.col(time))).alias("__sum"), F.count(F.when(std, F.col(time))).alias("__k")), "__t")
    times = running(times, "__t", {"__others": "__n"}).where("__s > 0")
    # Counts of others never fall, so that of the standard before is the largest before.
    of = Window.partitionBy(RANGE).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    most = times.groupBy(RANGE).agg(F.max("__others").alias("__m")).select(RANGE, F.max("__m").over(earlier).alias("__m"))  # a row for each range
    last = F.greatest(F.max("__others").over(of), F.col("__m"))
    times = times.join(F.broadcast(most), RANGE).withColumn("__jump", F.coalesce((F.col("__others") - last > 1).cast("int"), F.lit(0)))
    times = running(times, "__t", {"grp": "__jump"}).withColumn("grp", F.col("grp").cast("int"))
    means = times.groupBy("grp").agg(F.try_divide(F.sum("__sum"), F.sum("__k")).alias("g_time"))
    found = times.select("__t", "grp").join(means, "grp")
    return runs.where(std).join(found, F.col(time).eqNullSafe(F.col("__t"))).drop("__t")


def calibration(points: DataFrame, by: list[str], intercept: bool = False) -> DataFrame:
    """Weighted least squares of srm_mean on meas_mean, in one grouped pass: m, m_sd, c, c_sd, n and the covariance mc_cov for each group.

    Weights are 1 / (meas_err ** 2 + srm_err ** 2); points without error weigh
    as errors of 1e-12 of their value would. Deviations are scaled by the
    residuals' chi square, null without degrees of freedom. A single point
    gives the quotient of its means, with its own deviation.
    """
    x, y = F.col("meas_mean"), F.col("srm_mean")
    var = F.col("meas_err") * F.col("meas_err") + F.col("srm_err") * F.col("srm_err")
    w = 1 / F.greatest(var, 1e-24 * (x * x + y * y), F.lit(1e-300))
    s = points.where(x.isNotNull() & y.isNotNull()).withColumn("__w", w).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__w").alias("w"), F.sum(F.col("__w") * x).alias("wx"), F.sum(F.col("__w") * y).alias("wy"),
        F.sum(F.col("__w") * x * x).alias("wxx"), F.sum(F.col("__w") * x * y).alias("wxy"), F.sum(F.col("__w") * y * y).alias("wyy"),
        F.first("meas_mean").alias("x1"), F.first("meas_err").alias("ex"), F.first("srm_mean").alias("y1"), F.first("srm_err").alias("ey"),
    )
    n, W, wx, wy, wxx, wxy, wyy = (F.col(c) for c in ("n", "w", "wx", "wy", "wxx", "wxy", "wyy"))
    if intercept:
        det = W * wxx - wx * wx
        m, c = F.try_divide(W * wxy - wx * wy, det), F.try_divide(wxx * wy - wx * wxy, det)
        rest = wyy - 2 * m * wxy - 2 * c * wy + m * m * wxx + 2 * m * c * wx + c * c * W
        chi = F.when(n > 2, F.greatest(rest, F.lit(0.0)) / (n - 2))
        m_sd, c_sd, cov = F.sqrt(F.try_divide(chi * W, det)), F.sqrt(F.try_divide(chi * wxx, det)), -F.try_divide(chi * wx, det)
    else:
        m, c, c_sd, cov = F.try_divide(wxy, wxx), F.lit(0.0), F.lit(0.0), F.lit(0.0)
        rest = wyy - 2 * m * wxy + m * m * wxx
        m_sd = F.when(n > 1, F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)) / (n - 1), wxx)))
    one = F.try_divide(F.col("y1"), F.col("x1"))
    one_sd = F.abs(one) * F.sqrt(F.pow(F.try_divide(F.col("ex"), F.col("x1")), 2) + F.pow(F.try_divide(F.col("ey"), F.col("y1")), 2))
    single = n == 1
    return s.select(*by, F.when(single, one).otherwise(m).alias("m"), F.when(single, one_sd).otherwise(m_sd).alias("m_sd"), F.when(single, 0.0).otherwise(c).alias("c"), F.when(single, 0.0).otherwise(c_sd).alias("c_sd"), "n", F.when(single, 0.0).otherwise(cov).alias("mc_cov"))


def calibrated(ratio: Column, ratio_sd: Column, m: Column, m_sd: Column, c: Column, c_sd: Column) -> tuple[Column, Column]:
    """ratio * m + c and its deviation."""
    return ratio * m + c, F.sqrt(F.pow(m * ratio_sd, 2) + F.pow(ratio * m_sd, 2) + F.pow(c_sd, 2))
