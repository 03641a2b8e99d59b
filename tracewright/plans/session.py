"""A session over traces: steps in order, each only adding columns, and a log that replays them.

The session holds DataFrames and a small catalog on the driver (channel names,
subsets, switches, the log). A stage, and what a step needs more than once, is
written to the shared checkpoint folder; the rest is lazy. Every step is one of LOGGED; a log is JSON
and is replayed by name through that list, never evaluated. What the traces
were after each stage can still be read: a stage is a DataFrame, not a copy.
Values that have an uncertainty have its deviation beside them, as <value>_sd,
and what each source of error adds to them in columns that are the session's
own (functions/errors), so that an error which two values share cancels, or
adds up, where they meet.
"""

from __future__ import annotations

import functools
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.durable import durable
from tracewright.functions import names
from tracewright.functions.errors import Uncertain, pair
from tracewright.operators import background, blocks, calibrate, cluster, despike, frames, masks, optimise, ratio, runs, segment, stats, washout
from tracewright.sources import tables

LOGGED: dict[str, object] = {}
#: What operators/blocks has a twin of.
WHOLE = {f.__name__: f for f in (despike.despiked, frames.with_gradient, runs.number, runs.enumerated, runs.defragmented, runs.without_downhole)}


def logged(f):
    @functools.wraps(f)
    def step(self, **how):
        out = f(self, **how)
        self.log.append({"step": f.__name__, "args": how})
        return out

    LOGGED[f.__name__] = step
    return step


class Session:
    """traces has sample, idx, time, u_time and a column for each channel; its rows are in order of idx within a sample.

    With block, steps look at traces in blocks of so many rows (operators/blocks),
    for traces that one task shouldn't hold; idx goes from 0 on without gaps
    then. Results are the same. autorange, trimming and interpolation still
    look at a sample's rows together.
    """

    def __init__(self, traces: DataFrame, channels: list[str], standard_marker: str = "STD", concentrations: DataFrame | None = None, references: DataFrame | None = None, block: int | None = None):
        self.block = block
        self.df, self.channels, self.marker = traces, names.in_order(channels), standard_marker
        self.concentrations, self.references = concentrations, references
        self.switches = masks.Switches(self.channels)
        self.subsets: dict[str, set[str]] = {}
        #: For each value that has an error, the column of what each source adds to it.
        self.errors: dict[str, dict[str, str]] = {}
        self.ratios: list[str] = []
        self.fractions: list[str] = []
        self.stages: dict[str, DataFrame] = {"rawdata": traces}
        self._settled: DataFrame = traces
        self.exponent: float | None = None
        self.classifiers: dict[str, cluster.Classifier] = {}
        self.lines: DataFrame | None = None
        self.background: DataFrame | None = None
        self._course: tuple[DataFrame, str] | None = None
        self.stats: DataFrame | None = None
        self.stats_of: tuple[list[str], list[str]] = ([], [])
        self.optimisation: DataFrame | None = None
        self.log: list[dict] = []

    # -- samples

    @logged
    def make_subset(self, *, samples: list[str], name: str | None = None, force: bool = False) -> str:
        """Names a set of samples; an equal set keeps its name unless forced."""
        same = next((n for n, s in self.subsets.items() if s == set(samples)), None)
        if same and not force:
            return same
        self.subsets[name := name or f"set{len(self.subsets)}"] = set(samples)
        return name

    def of(self, subset: str | list[str] | None = None) -> DataFrame:
        """The rows of a subset: a name of one, All_Analyses, All_Samples, STD, not_in_set, or a list of samples."""
        return self._within(self.df, subset)

    def _within(self, df: DataFrame, subset: str | list[str] | None) -> DataFrame:
        standard = F.contains(F.col("sample").cast("string"), F.lit(self.marker))
        if subset is None or subset == "All_Analyses":
            return df
        if subset in ("All_Samples", self.marker):
            return df.where(~standard if subset == "All_Samples" else standard)
        if subset == "not_in_set":
            return df.where(~F.col("sample").isin(sorted({s for x in self.subsets.values() for s in x})))
        return df.where(F.col("sample").isin(sorted(self.subsets[subset]) if isinstance(subset, str) else subset))

    def stage(self, name: str | None = None, subset: str | list[str] | None = None) -> DataFrame:
        """The rows as they were after a stage (rawdata, despiked, bkgsub, ratios, calibrated, mass_fraction), with the filters there are now; by default as they are."""
        if name is not None and name not in self.stages:
            raise ValueError(f"no stage is named {name!r}; there are {list(self.stages)}")
        now = self._plain(self.of(subset))
        if name is None:
            return now
        found = [masks.column_of(f) for f in self.switches.names]
        keys = now.select("sample", "idx", *found)
        return self._plain(self.stages[name]).drop(*found).join(keys, ["sample", "idx"])

    def _settle(self) -> DataFrame:
        """The rows, written if a step has changed them: what joins them to what is told from them doesn't make them twice."""
        if self.df is not self._settled:
            self.df = self._settled = durable(self.df)
        return self.df

    def _after(self, stage: str) -> Session:
        self.stages[stage] = self._settle()
        return self

    def _windows(self, name: str, df: DataFrame, *args, **how) -> DataFrame:
        """A function of whole traces, or its twin in blocks, which reads its rows more than once: they are written before."""
        return getattr(blocks, name)(durable(df), *args, **how, size=self.block) if self.block else WHOLE[name](df, *args, **how)

    def _known(self, name: str) -> Uncertain:
        return Uncertain(F.col(name), {source: F.col(c) for source, c in self.errors.get(name, {}).items()})

    def _hold(self, values: dict[str, Uncertain]) -> None:
        """Adds, or replaces, values with their deviations and the parts of these."""
        columns: dict[str, Column] = {}
        for name, x in values.items():
            columns[name] = x.value
            if x.parts:
                columns[f"{name}_sd"] = x.sd()
                self.errors[name] = {source: f"__err_{name}__{i}" for i, source in enumerate(x.parts)}
                columns |= {self.errors[name][source]: part for source, part in x.parts.items()}
        self.df = self.df.withColumns(columns)

    def _plain(self, df: DataFrame) -> DataFrame:
        """df without the session's own columns."""
        return df.drop(*[c for c in df.columns if c.startswith("__err_")])

    def _total(self, channel: str) -> DataFrame:
        """The rows, with the sum of the channels where a step looks at it and it isn't there."""
        if channel == "total_counts" and channel not in self.df.columns:
            self.df = self.df.withColumn(channel, sum((F.coalesce(F.col(c), F.lit(0.0)) for c in self.channels), F.lit(0.0)))
        return self._settle()

    # -- steps

    @logged
    def find_expcoef(self, *, below: float = 0.0, limit: float | None = None, channel: str = "total_counts", **how) -> float:
        """The exponent of the standards' washouts, which despiking takes where it is given none."""
        self._total(channel)
        rows = self.of(self.marker)
        if "trn" not in rows.columns:
            rows = segment.segmented(rows, channel, **how)
        self.exponent = washout.exponent(washout.tails(rows, channel, limit=limit), below)["used"]
        return self.exponent

    @logged
    def despike(self, *, exponent: float | None = None, decay: bool = False, step: float = 1.0, win: int = 3, nlim: float = 12.0, maxiter: int = 4) -> Session:
        """Noise despiking; decay despiking before it where an exponent is given, or asked for after find_expcoef."""
        if decay and exponent is None:
            exponent = self.exponent if self.exponent is not None else self.find_expcoef.__wrapped__(self)
        self.df = self._windows("despiked", self.df, self.channels, exponent, step, win, nlim, maxiter)
        return self._after("despiked")

    @logged
    def autorange(self, *, channel: str = "total_counts", **how) -> Session:
        self.df = self._windows("enumerated", segment.segmented(self._total(channel), channel, **how), "sig", "ns")
        return self

    @logged
    def filter_background(self, *, win: int = 3, n_lim: float = 3.0, n_min: int = 20, n_max: int | None = None) -> Session:
        """Takes stretches of background out whose rolling mean leaps over the one before."""
        rows = self._windows("number", self._settle(), "bkg", "bkg_ns")
        means = background.summaries(rows, self.channels, "bkg_ns", n_min=n_min, n_max=n_max)
        out = background.rolling_outliers(means, [f"{c}_mean" for c in self.channels], win, n_lim).where("dropped").select("sample", "bkg_ns", F.lit(True).alias("__out"))
        self.df = rows.join(out, ["sample", "bkg_ns"], "left").withColumn("bkg", F.col("bkg") & F.col("__out").isNull()).drop("__out", "bkg_ns")
        return self

    def _subtract(self, knots: DataFrame, kind: str = "linear") -> Session:
        """knots: knot_time, and for each channel its background and that one's error, <channel>_sd."""
        values = [*self.channels, *[f"{c}_sd" for c in self.channels]]
        if kind in ("quadratic", "cubic"):
            knots = background.curved(knots.withColumn("all", F.lit("session")), values, kind, by="all").drop("all")
        self._course = durable(knots), kind
        rows = self.df.withColumns({f"{c}_sd": F.lit(None).cast("double") for c in self.channels})
        out = background.interpolated(rows, background.near_knots(self.df, self._course[0]), values, kind=kind)
        inside = F.coalesce(F.col("sig"), F.lit(False))
        out = background.subtracted(out.withColumns({f"{c}_sd_at": F.when(inside, F.col(f"{c}_sd_at")) for c in self.channels}), self.channels)
        self.df = out
        self.errors = {}
        self._hold({c: Uncertain(F.col(c), {f"background {c}": -F.col(f"{c}_sd_at")}) for c in self.channels})
        self.df = self.df.drop(*[f"{v}_at" for v in values])
        return self._after("bkgsub")

    @logged
    def subtract_background(self, *, fwhm: float, step: float | None = None, reach: float | None = 8.0, error: str = "se") -> Session:
        """Weighted background of all samples' background rows, on one time line, at a grid and between its times; its error (se, or std) is that of the values then."""
        rows = self._settle().where("bkg").select(F.lit("session").alias("all"), "u_time", *self.channels)
        at = background.grid(self.df.withColumn("all", F.lit("session")), step or fwhm / 20, by="all")
        self.background = durable(background.weighted(rows, at, self.channels, fwhm, by="all", reach=reach))
        return self._subtract(self.background.select(F.col("grid_time").alias("knot_time"), *[F.col(f"{c}_{x}").alias(n) for c in self.channels for x, n in (("mean", c), (error, f"{c}_sd"))]))

    @logged
    def subtract_background_between(self, *, n_min: int = 20, n_max: int | None = None, error: str = "se", kind: str = "linear") -> Session:
        """Background between the mean times of its stretches, and its error: of one of background.KINDS there, constant beyond."""
        if kind not in background.KINDS:
            raise ValueError(f"kind is one of {list(background.KINDS)}, not {kind!r}")
        rows = self._windows("number", self._settle(), "bkg", "bkg_ns")
        self.background = durable(background.summaries(rows, self.channels, "bkg_ns", n_min=n_min, n_max=n_max))
        return self._subtract(self.background.select(F.col("u_time").alias("knot_time"), *[F.col(f"{c}_{x}").alias(n) for c in self.channels for x, n in (("mean", c), (error, f"{c}_sd"))]), kind)

    def background_course(self, *, step: float) -> DataFrame:
        """(u_time, <channel>, <channel>_sd ...): the background that was subtracted, at times from 0 on, a step apart."""
        if self._course is None:
            raise ValueError("no background has been subtracted")
        knots, kind = self._course
        values = [*self.channels, *[f"{c}_sd" for c in self.channels]]
        last = self.df.agg(F.max("u_time")).first()[0] or 0.0
        times = self.df.sparkSession.range(int(last // step) + 1).select((F.col("id") * F.lit(float(step))).alias("u_time"), F.floor(F.col("id") / 1000).alias("sample"))
        out = background.interpolated(times, background.near_knots(times, knots), values, kind=kind)
        return out.select("u_time", *[F.col(f"{v}_at").alias(v) for v in values])

    @logged
    def correct_interference(self, *, target: str, source: str, factor: float) -> Session:
        self._hold({target: self._known(target) - self._known(source) * factor})
        return self

    @logged
    def ratio(self, *, standard: str) -> Session:
        self._hold({f"{c}_{standard}": self._known(c) / self._known(standard) for c in self.channels if c != standard})
        self.ratios = [f"{c}_{standard}" for c in self.channels if c != standard]
        self.switches.values = [*self.channels, *self.ratios]
        return self._after("ratios")

    @logged
    def combine(self, *, name: str, top: str, below: str) -> Session:
        """Adds the quotient of any two values as one more ratio; errors that they share, those of a common standard above all, cancel."""
        self._hold({name: self._known(top) / self._known(below)})
        self.ratios.append(name)
        self.switches.values = [*self.channels, *self.ratios, *self.fractions]
        return self

    def _standards(self, n_min: int) -> DataFrame:
        """(std, u_time, ratio, meas_mean, meas_err) of each ablation of a standard with n_min rows at least."""
        std = self.of(self.marker).where("ns > 0").groupBy("sample", "ns")
        wide = std.agg(F.count(F.lit(1)).alias("n"), F.avg("u_time").alias("u_time"), *[x for r in self.ratios for x in (F.avg(r).alias(f"m_{r}"), (F.stddev_pop(r) / F.sqrt(F.count(r))).alias(f"e_{r}"))]).where(F.col("n") >= n_min)
        each = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(f"m_{r}").alias("meas_mean"), F.col(f"e_{r}").alias("meas_err")) for r in self.ratios]))
        return wide.select("sample", F.concat_ws("#", "sample", "ns").alias("std"), "u_time", each.alias("x")).select("sample", "std", "u_time", "x.*")

    @logged
    def calibrate(self, *, intercept: bool = False, n_min: int = 10, drift: bool = False, correlated: bool = False) -> Session:
        """Each ratio on a line through the standards' means, each standard against the nearest reference.

        With drift there is a line for each group of standards that no more
        than one other sample parts, and between the groups' mean times what
        they say is interpolated. The line's errors and the ratio's own make
        the deviation. A ratio that no standard has is null; no row is lost.
        A line's slope and intercept count as independent, unless correlated:
        then their covariance is kept.
        """
        self._settle()
        points = calibrate.points(self._standards(n_min), self.references)
        by = ["ratio"]
        if drift:
            marked = self.df.groupBy("sample").agg(F.min("u_time").alias("u_time")).withColumn("__std", F.contains(F.col("sample").cast("string"), F.lit(self.marker)))
            groups = calibrate.consecutive_groups(marked, "__std", "u_time").select("sample", "grp", F.col("g_time").alias("knot_time"))
            points, by = points.drop("u_time").join(groups, "sample"), ["ratio", "grp", "knot_time"]
        self.lines = durable(calibrate.calibration(points, by, intercept))
        part = lambda r, c: F.max(F.when(F.col("ratio") == r, F.col(c)))
        cells = [part(r, c).alias(f"{r}__{c}") for r in self.ratios for c in ("m", "m_sd", "c", "c_sd", "mc_cov")]
        names = [f"{r}__{c}" for r in self.ratios for c in ("m", "m_sd", "c", "c_sd", "mc_cov")]
        if drift:
            knots = self.lines.groupBy("knot_time").agg(*cells)
            rows = self.df.drop(*names)
            out = background.interpolated(rows, background.near_knots(rows, knots), names).withColumnsRenamed({f"{n}_at": n for n in names})
        else:
            out = self.df.join(F.broadcast(self.lines.agg(*cells)))  # one row, whatever there is to aggregate
        self.df, new = out, {}
        for r in self.ratios:
            m, m_sd, c, c_sd, cov = (F.col(f"{r}__{x}") for x in ("m", "m_sd", "c", "c_sd", "mc_cov"))
            known = lambda x: F.coalesce(x, F.lit(0.0))
            slope, offset = pair(m, known(m_sd), c, known(c_sd), known(cov) if correlated else F.lit(0.0), (f"slope {r}", f"offset {r}"))
            new[r] = self._known(r) * slope + offset
        self._hold(new)
        self.df = self.df.drop(*names)
        return self._after("calibrated")

    @logged
    def mass_fraction(self, *, masses: dict[str, list[float]]) -> Session:
        self.df = ratio.with_mass_fractions(self.df, {r: tuple(m) for r, m in masses.items()}, self.concentrations)
        self._hold({f"{r.split('_')[0]}_massfrac": self._known(r) * Uncertain(F.col("int_stand_massfrac") * F.lit(masses[r][0] / masses[r][1])) for r in masses})
        self.fractions = [f"{r.split('_')[0]}_massfrac" for r in masses]
        self.switches.values = [*self.channels, *self.ratios, *self.fractions]
        return self._after("mass_fraction")

    # -- filters

    def _add(self, parts: dict[str, object]) -> list[str]:
        n = self.switches.next_set()
        full = [self.switches.add(name, n) for name in parts]
        self.df = self.df.withColumns({masks.column_of(f): m for f, m in zip(full, parts.values(), strict=True)})
        return full

    @logged
    def filter_threshold(self, *, channel: str, limit: float) -> list[str]:
        below, above = masks.threshold(channel, limit)
        return self._add({f"{channel}_thresh_below": below, f"{channel}_thresh_above": above})

    @logged
    def filter_percentile(self, *, channel: str, percentiles: list[float], level: str = "population") -> list[str]:
        self.df = masks.percentile_masks(self.df, channel, percentiles, level)
        pair = ("below", "above") if len(percentiles) == 1 else ("inside", "outside")
        out = self._add({f"{channel}_pcnt_{p}": F.col(p) for p in pair})
        self.df = self.df.drop(*pair)
        return out

    @logged
    def filter_gradient(self, *, channel: str, win: int, limit: float, mode: str = "mid", absolute: bool = True) -> list[str]:
        self.df = masks.gradient_masks(self._settle() if self.block else self.df, channel, win, limit, mode, absolute, block=self.block)
        out = self._add({f"{channel}_gthresh_{p}": F.col(p) for p in ("below", "above")})
        self.df = self.df.drop("below", "above", "gradient")
        return out

    @logged
    def filter_gradient_percentile(self, *, channel: str, percentiles: list[float], win: int = 15, mode: str = "mid", level: str = "population") -> list[str]:
        self.df = self._windows("with_gradient", self.df, channel, win, mode, "__gradient")
        self.df = masks.percentile_masks(self.df, "__gradient", percentiles, level)
        pair = ("below", "above") if len(percentiles) == 1 else ("inside", "outside")
        out = self._add({f"{channel}_grd_pcnt_{p}": F.col(p) for p in pair})
        self.df = self.df.drop("__gradient", *pair)
        return out

    @logged
    def filter_clustering(self, *, channels: list[str], method: str = "meanshift", level: str = "sample", clusters: int = 2, filt: bool | str = False, normalise: bool = True, include_time: bool = False, min_data: int = 10, **how) -> list[str]:
        """A filter for each cluster, numbered from the lowest: of each sample by itself, or of the population. Rows that filt leaves out are in none.

        method is kmeans, meanshift or, by sample, dbscan; how are its own
        arguments (bandwidth; eps and least).
        """
        values = [*channels, *(["time"] if include_time else [])]
        kept = self.switches.mask(filt)
        rows = self._settle().select("sample", "idx", *[F.when(kept, F.col(v)).alias(v) for v in values])
        if level not in ("sample", "population"):
            raise ValueError(f"level is sample or population, not {level!r}")
        if method == "kmeans":
            how = {"k": clusters, **how}
        if level == "population":
            found = cluster.Classifier(values, method=method, normalise=normalise, min_data=min_data + 1, **how).fit(rows).predict(rows)
        else:
            found = cluster.clustered_by_sample(rows, values, method, min_data, normalise, **how)
        return self._clusters(found, "-".join(channels) + f"_{method}")

    def _clusters(self, found: DataFrame, name: str) -> list[str]:
        """Filters of the labels from -1 on that occur: as many as the sample with most clusters has."""
        found = durable(found.select("sample", "idx", "cluster"))
        labels = sorted(r[0] for r in found.where("cluster >= -1").select("cluster").distinct().collect())
        self.df = self._settle().join(found.select("sample", "idx", F.col("cluster").alias("__cluster")), ["sample", "idx"])
        out = self._add({f"{name}_{k if k >= 0 else 'noise'}": F.coalesce(F.col("__cluster") == k, F.lit(False)) for k in labels})
        self.df = self.df.drop("__cluster")
        return out

    @logged
    def fit_classifier(self, *, name: str, channels: list[str], clusters: int = 2, method: str = "kmeans", bandwidth: float | None = None, subset: str | None = None, filt: bool | str = True, sort_by: int = 0) -> Session:
        """Clusters of the pooled rows of a subset, to be applied to any sample."""
        kept = self.switches.mask(filt)
        self._settle()
        rows = self.of(subset).where("ns > 0").select(*[F.when(kept, F.col(c)).alias(c) for c in channels])
        self.classifiers[name] = cluster.Classifier(channels, clusters, sort_by, method=method, bandwidth=bandwidth).fit(rows)
        return self

    @logged
    def apply_classifier(self, *, name: str) -> list[str]:
        return self._clusters(self.classifiers[name].predict(self._settle()), name)

    @logged
    def filter_optimise_signal(self, *, channels: list[str], least: int = 5, mode: str | list[float] = "kde_first_max", mult: float | list[float] = 1.0, bias: float = 0.0, weights: list[float] | None = None, maximise: bool = False, scaler: str = "median", filt: bool | str = True) -> list[str]:
        """The best window of each ablation; rows that filt leaves out are as if they weren't there. What was found for each is self.optimisation."""
        kept = self.switches.mask(filt)
        rows = self._settle().select("sample", "idx", "ns", *[F.when(kept, F.col(c)).alias(c) for c in channels])
        self.optimisation = durable(optimise.optimisation(rows, channels, "ns", least=least, mode=mode, mult=mult, bias=bias, weights=weights, maximise=maximise, scaler=scaler))
        found = self.optimisation.select("sample", "ns", F.col("first").alias("__first"), F.col("last").alias("__last"))
        took = kept & F.forall(F.array(*channels), lambda x: x.isNotNull() & ~F.isnan(x))
        self.df = self.df.join(found, ["sample", "ns"], "left")
        out = self._add({"optimise_" + "-".join(channels): F.coalesce(F.col("idx").between(F.col("__first"), F.col("__last")) & took, F.lit(False))})
        self.df = self.df.drop("__first", "__last")
        return out

    @logged
    def filter_correlation(self, *, x: str, y: str, window: int, r_threshold: float = 0.9, p_threshold: float = 0.05) -> list[str]:
        self.df = masks.correlation_mask(self._settle() if self.block else self.df, x, y, window, r_threshold, p_threshold, self.block)
        out = self._add({f"{x}_{y}_corr": F.col("kept")})
        self.df = self.df.drop("kept", "r", "p")
        return out

    @logged
    def filter_defragment(self, *, threshold: int = 3, mode: str = "include") -> list[str]:
        self.df = self._windows("defragmented", self.df.withColumn("__on", self.switches.mask(True)), "__on", threshold, mode)
        out = self._add({"defrag": F.col("defrag")})
        self.df = self.df.drop("defrag", "__on")
        return out

    @logged
    def filter_trim(self, *, start: int = 1, end: int = 1) -> list[str]:
        self.df = runs.trimmed(self.df.withColumn("__on", self.switches.mask(True)), "__on", start, end)
        out = self._add({"trimmed": F.col("trimmed")})
        self.df = self.df.drop("trimmed", "__on")
        return out

    @logged
    def filter_exclude_downhole(self, *, threshold: int = 2) -> list[str]:
        self.df = self._windows("without_downhole", self.df.withColumn("__on", self.switches.mask(True)), "__on", threshold)
        out = self._add({"downhole": F.col("kept")})
        self.df = self.df.drop("kept", "__on")
        return out

    @logged
    def filter_new(self, *, name: str, expression: str) -> list[str]:
        return self._add({name: masks.combined(expression, self.switches.names)})

    @logged
    def filter_on(self, *, filt=None, channels: list[str] | None = None) -> Session:
        self.switches.turn(True, filt, channels)
        return self

    @logged
    def filter_off(self, *, filt=None, channels: list[str] | None = None) -> Session:
        self.switches.turn(False, filt, channels)
        return self

    @logged
    def filter_clear(self) -> Session:
        self.df = self.df.drop(*map(masks.column_of, self.switches.names))
        self.switches.clear()
        return self

    # -- results

    @logged
    def sample_stats(self, *, stats_: list[str] = ("mean", "std"), channels: list[str] | None = None, filt: bool | str | dict = True, each_trace: bool = True, subset: str | None = None) -> Session:
        values = channels or self.ratios or self.channels
        rows = self.of(subset).where("ns > 0") if each_trace else self.of(subset)
        by = ("sample", "ns") if each_trace else ("sample",)
        self.stats = stats.sample_stats(rows, values, list(stats_), {v: self.switches.mask(filt, v) for v in values}, by)
        self.stats_of = (values, [x if isinstance(x, str) else x.__name__ for x in stats_])
        return self

    def statistics(self, *, subset: str | list[str] | None = None, ablation_time: bool = False, path: str | None = None) -> DataFrame:
        """(statistic, sample, rep, values ...) of the last sample_stats, of a subset's samples; written as CSV where a path is given.

        rep counts a sample's ablations from 0, and is left out where whole
        samples were summarised. ablation_time adds seconds: how long the
        ablation took, or all of the sample's, however rows were filtered.
        """
        if self.stats is None:
            raise ValueError("there are no statistics before sample_stats")
        wide, keys = self._within(self.stats, subset), ["sample"]
        if "ns" in wide.columns:
            wide, keys = wide.withColumn("rep", F.col("ns") - 1), ["sample", "rep"]
        out = stats.long_stats(wide, *self.stats_of, tuple(keys))
        if ablation_time:
            times = stats.ablation_times(self.of(subset))
            times = times if "rep" in keys else times.groupBy("sample").agg(F.sum("seconds").alias("seconds"))
            out = out.join(times, keys, "left").select(*out.columns, "seconds")
        if path is not None:
            tables.write_stats(out, path)
        return out

    def filter_effect(self, *, channels: list[str] | None = None, filt: bool | str = True, subset: str | None = None) -> DataFrame:
        """Means and deviations with the filters, without them, and their ratios, for each sample."""
        return stats.filter_effect(self.of(subset).where("ns > 0"), channels or self.ratios or self.channels, self.switches.mask(filt))

    def gradients(self, *, channels: list[str] | None = None, win: int = 15, mode: str = "mid", subset: str | None = None) -> DataFrame:
        """(sample, idx, <channel>_gradient ...) of all samples."""
        values, rows = channels or self.ratios or self.channels, self.of(subset)
        for v in values:
            rows = self._windows("with_gradient", rows, v, win, mode, f"{v}_gradient")
        return rows.select("sample", "idx", *[f"{v}_gradient" for v in values])

    def export_traces(self, path: str, *, stage: str | None = None, channels: list[str] | None = None, subset: str | None = None, filt: bool | str | dict = False, form: str = "csv") -> None:
        """The values of a stage, each with its own filters, in a folder for each sample."""
        rows = self.stage(stage, subset)
        stages = {"rawdata": self.channels, "despiked": self.channels, "bkgsub": self.channels, "ratios": self.ratios, "calibrated": self.ratios, "mass_fraction": self.fractions}
        values = channels or stages.get(stage or list(self.stages)[-1], self.channels)
        own: dict[str, Column] = {v: self.switches.mask(filt, v) for v in values} if filt else {}
        tables.write_traces(rows.withColumns({f"__{v}": m for v, m in own.items()}), path, values, {v: F.col(f"__{v}") for v in own}, form)

    def minimal_export(self, path: str, *, channels: list[str] | None = None) -> None:
        """What another user needs to do the same: raw traces of the channels that the log's steps name, or of all that are asked for, references, concentrations and the log."""
        said = json.dumps([x["args"] for x in self.log])
        wanted = [c for c in self.channels if channels is None or c in channels or c in said]
        raw = self.stages["rawdata"]
        summed = any(x["step"] in ("autorange", "find_expcoef") and x["args"].get("channel", "total_counts") == "total_counts" for x in self.log)
        if summed and "total_counts" not in raw.columns:  # of all channels, those that aren't exported too
            raw = raw.withColumn("total_counts", sum((F.coalesce(F.col(c), F.lit(0.0)) for c in self.channels), F.lit(0.0)))
        keys = [c for c in ("sample", "idx", "time", "u_time", *(["total_counts"] if summed else [])) if c in raw.columns]
        raw.select(*keys, *wanted).write.mode("overwrite").parquet(f"{path}/traces")
        for name, df in (("references", self.references), ("concentrations", self.concentrations)):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        self.save_log(f"{path}/log")

    def export(self, path: str) -> None:
        """Traces, statistics and the log under path."""
        self._plain(self.df).write.mode("overwrite").parquet(f"{path}/traces")
        if self.stats is not None:
            tables.write_stats(self.stats, f"{path}/stats")
        self.save_log(f"{path}/log")

    def save_log(self, path: str) -> None:
        rows = [(i, json.dumps(x)) for i, x in enumerate(self.log)]
        self.df.sparkSession.createDataFrame(rows, "i int, entry string").coalesce(1).write.mode("overwrite").json(path)

    def replay(self, log: list[dict]) -> Session:
        for entry in log:
            if entry["step"] not in LOGGED:
                raise ValueError(f"no step is named {entry['step']!r}")
            LOGGED[entry["step"]](self, **entry["args"])
        return self


def reproduced(spark: SparkSession, path: str, marker: str = "STD") -> Session:
    """A session from a minimal export, with its log replayed."""

    def there(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/{name}")
        except AnalysisException:  # it had none
            return None

    traces = spark.read.parquet(f"{path}/traces")
    channels = [c for c in traces.columns if c not in ("sample", "idx", "time", "u_time", "total_counts")]
    return Session(traces, channels, marker, there("concentrations"), there("references")).replay(read_log(spark, f"{path}/log"))


def read_log(spark: SparkSession, path: str) -> list[dict]:
    """A log as it was saved: one small row for each step."""
    return [json.loads(r.entry) for r in spark.read.schema("i int, entry string").json(path).orderBy("i").collect()]
