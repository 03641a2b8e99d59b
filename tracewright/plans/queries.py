"""Registered queries: each operator on the driver tables, with SQL beside it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.durable import durable, shared_dir
from tracewright.functions import chem, names
from tracewright.functions.errors import Uncertain
from tracewright.operators import background, blocks, calibrate, cluster, despike, frames, masks, merging, optimise, ranked, ratio, runs, segment, stats
from tracewright.plans.bind import CHANNELS, E_SQL, EPOCH_US, L_SQL, events, lines, r6, table
from tracewright.plans.session import Session
from tracewright.sources import dataformat, parsers, reader, split
from tracewright.sources import tables as sources
from tracewright.streaming import sessions
from tracewright.streaming import traces as streamed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def huber_sql(values: str, source: str) -> str:
    """CTEs that draw the values of each sample in, round by round, and hub (sample, n, mean, sd) of the last round; source has rows (sample, v)."""
    drawn = "least(greatest(v, low), high)"
    return f"""{values}, hv AS ({source}),
hr AS (SELECT sample, 0 AS k, min(v) AS low, max(v) AS high, avg(v) AS mean, 1.134::DOUBLE * stddev_pop(v) AS sd FROM hv GROUP BY sample
  UNION ALL
  SELECT sample, k + 1, low, high, avg({drawn}), 1.134::DOUBLE * stddev_pop({drawn})
  FROM (SELECT sample, k, least(greatest(low, mean - 1.5 * sd), mean + 1.5 * sd) AS low, least(greatest(high, mean - 1.5 * sd), mean + 1.5 * sd) AS high FROM hr WHERE k < 1000 AND (low < mean - 1.5 * sd OR high > mean + 1.5 * sd)) JOIN hv USING (sample)
  GROUP BY sample, k, low, high),
hub AS (SELECT sample, n, arg_max(mean, k) AS mean, arg_max(sd, k) AS sd FROM hr JOIN (SELECT sample, count(*) AS n FROM hv GROUP BY sample) USING (sample) GROUP BY sample, n)"""


MASK = "value > 30"
#: Runs of value > 30 in SQL: m, the number of the stretch of equal m, its length, and whether it is the first.
RUNS = f"""{E_SQL}, m AS (SELECT *, value > 30 AS m, CASE WHEN (value > 30) <> lag(value > 30) OVER w THEN 1 ELSE 0 END AS ch FROM e WINDOW w AS (PARTITION BY sample ORDER BY idx)),
s AS (SELECT *, sum(ch) OVER (PARTITION BY sample ORDER BY idx) AS st, count(*) OVER (PARTITION BY sample) AS n FROM m),
r AS (SELECT *, count(*) OVER (PARTITION BY sample, st) - CASE WHEN st = 0 THEN 1 ELSE 0 END AS len,
  sum(CASE WHEN m AND (idx = 0 OR ch = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY sample ORDER BY idx) AS rn FROM s)"""


# --- masks -------------------------------------------------------------------


@query(f"WITH {E_SQL} SELECT sample, idx, value < 50 AS below, value >= 50 AS above FROM e")
def threshold(spark, d):
    below, above = masks.threshold("value", 50.0)
    return events(spark, d).select("sample", "idx", below.alias("below"), above.alias("above"))


@query(f"WITH {E_SQL}, p AS (SELECT quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM e) SELECT sample, idx, value BETWEEN lo AND hi AS inside, value < lo OR value > hi AS outside FROM e, p")
def percentile_population(spark, d):
    return masks.percentile_masks(events(spark, d), "value", [25, 75]).select("sample", "idx", "inside", "outside")


@query(f"WITH {E_SQL}, p AS (SELECT sample, quantile_cont(value, 0.6) AS lo FROM e GROUP BY sample) SELECT sample, idx, value < lo AS below, value >= lo AS above FROM e JOIN p USING (sample)")
def percentile_individual(spark, d):
    return masks.percentile_masks(events(spark, d), "value", [60], "individual").select("sample", "idx", "below", "above")


@query(f"WITH {E_SQL}, p AS (SELECT quantile_cont(value, 0.9) AS lo FROM e WHERE event_type = 'view') SELECT sample, idx, value < lo AS below, value >= lo AS above FROM e, p")
def percentile_filtered(spark, d):
    return masks.percentile_masks(events(spark, d), "value", [90], mask=F.col("event_type") == "view").select("sample", "idx", "below", "above")


@query(f"WITH {L_SQL} SELECT sample, idx, CASE WHEN qty > 0 AND price > 0 AND disc > 0 AND tax > 0 THEN qty END AS qty, CASE WHEN qty > 0 AND price > 0 AND disc > 0 AND tax > 0 THEN tax END AS tax FROM l")
def zero_screen(spark, d):
    return masks.zero_screened(lines(spark, d), ["qty", "price", "disc", "tax"]).select("sample", "idx", "qty", "tax")


@query(f"WITH {RUNS} SELECT sample, count(*) FILTER (m) AS n_signal, count(*) FILTER (m AND value < 60) AS n_kept, round(100.0 * (count(*) FILTER (m) - count(*) FILTER (m AND value < 60)) / nullif(count(*) FILTER (m), 0)::DOUBLE, 6) AS removed_percent FROM r GROUP BY sample")
def filter_accounting(spark, d):
    e = events(spark, d).withColumn("sig", F.expr(MASK)).withColumn("keep", F.col("value") < 60)
    return masks.accounting(e, "sig", "keep").withColumn("removed_percent", r6("removed_percent"))


@query(f"WITH {E_SQL} SELECT sample, idx, (value < 50 AND value < 80) OR value >= 80 AS kept, value < 50 AND value >= 80 AS none FROM e")
def filter_language(spark, d):
    e = events(spark, d)
    low, high = masks.threshold("value", 50.0), masks.threshold("value", 80.0)
    switches = masks.Switches(["value"])
    n = [switches.add("val_thresh_below", 0), switches.add("val_thresh_above", 0), switches.add("val_high_below", 1), switches.add("val_high_above", 1)]
    e = e.withColumns(dict(zip(map(masks.column_of, n), (*low, *high), strict=True)))
    kept = switches.mask("0:val_thresh_below & 1:val_high_below | 1:val_high_above", "value")
    switches.turn(True, "0:val_thresh_below")
    switches.turn(True, "1:val_high_above")
    return e.select("sample", "idx", kept.alias("kept"), switches.mask(True, "value").alias("none"))


# --- rolling -----------------------------------------------------------------


def _despiked_sql(passes: int, nlim: float, source: str) -> str:
    """CTEs of source and of each pass; the last is b<passes - 1>."""
    sql, last = source, "e"
    for k in range(passes):
        sql += f", a{k} AS (SELECT *, avg(value) OVER (PARTITION BY sample ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mu, count(*) OVER (PARTITION BY sample) AS n FROM {last}), b{k} AS (SELECT sample, idx, time, event_type, CASE WHEN idx >= 1 AND idx < n - 1 AND mu >= 0 AND value > mu + {nlim} * sqrt(greatest(mu, 0)) THEN mu ELSE value END AS value FROM a{k})"
        last = f"b{k}"
    return sql


@query(f"WITH {_despiked_sql(4, 6.0, E_SQL)} SELECT sample, idx, round(value, 6) AS value FROM b3")
def noise_despike(spark, d):
    return despike.noise(events(spark, d), ["value"], nlim=6.0).select("sample", "idx", r6("value"))


def _decay_sql(passes: int, up: str, down: str) -> str:
    sql = f"{E_SQL}, z AS (SELECT sample, idx, value AS v, count(*) OVER (PARTITION BY sample) AS n, " + ", ".join(f"stddev_pop(value) FILTER (idx < {k}) OVER (PARTITION BY sample) AS s{k}" for k in (5, 10, 20, 30, 50)) + " FROM e)"
    last, noise = "z", "s5"
    for k in (10, 20, 30, 50):
        sql += f", z{k} AS (SELECT *, CASE WHEN s{k} < 1.5 * {noise} THEN s{k} ELSE {noise} END AS no{k} FROM {last})"
        last, noise = f"z{k}", f"no{k}"
    sql += f", y AS (SELECT sample, idx, v, n, 3 * {noise} AS lim FROM {last})"
    last = "y"
    for k in range(passes):
        sql += f", y{k} AS (SELECT *, coalesce(lag(v) OVER w, max(v) FILTER (idx = n - 1) OVER (PARTITION BY sample)) AS p, coalesce(lead(v) OVER w, max(v) FILTER (idx = 0) OVER (PARTITION BY sample)) AS x FROM {last} WINDOW w AS (PARTITION BY sample ORDER BY idx)), x{k} AS (SELECT sample, idx, n, lim, CASE WHEN idx > 0 AND ((v < p * {down} - lim AND v < x - lim) OR (v > x * {up} + lim AND v > p + lim)) THEN p ELSE v END AS v FROM y{k})"
        last = f"x{k}"
    return f"WITH {sql} SELECT sample, idx, round(v, 6) AS value FROM {last}"


@query(_decay_sql(3, "exp(0.4::DOUBLE)", "exp(-0.4::DOUBLE)"))
def decay_despike(spark, d):
    return despike.decay(events(spark, d), "value", -0.4, 1.0).select("sample", "idx", r6("value"))


@query(f"""WITH {E_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n FROM e)
SELECT sample, idx, round(CASE WHEN idx <= 2 THEN avg(value) FILTER (idx <= 2) OVER (PARTITION BY sample) WHEN idx >= n - 1 THEN avg(value) FILTER (idx >= n - 1) OVER (PARTITION BY sample)
ELSE avg(value) OVER (PARTITION BY sample ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) END, 6) AS smooth FROM n""")
def lagged_smooth(spark, d):
    return events(spark, d).select("sample", "idx", r6(frames.smoothed("value", 5), "smooth"))


@query(f"""WITH {E_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n FROM e)
SELECT sample, idx, round(CASE WHEN idx >= 3 AND idx < n - 3 THEN regr_slope(value, idx) OVER (PARTITION BY sample ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) ELSE 0.0 END, 6) AS slope FROM n""")
def row_gradient(spark, d):
    return events(spark, d).select("sample", "idx", r6(frames.gradient_by_row("value", 6), "slope"))


def _gradient_sql(before: int, after: int, select: str) -> str:
    return f"""WITH {E_SQL}, h AS (SELECT *, time / 3600 AS t, count(*) OVER (PARTITION BY sample) AS n FROM e), g AS (SELECT *, CASE WHEN idx >= {before} AND idx < n - {after} THEN regr_slope(value, t) OVER (PARTITION BY sample ORDER BY idx ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) END AS g0 FROM h),
f AS (SELECT *, CASE WHEN idx < {before} THEN max(g0) FILTER (idx = {before}) OVER (PARTITION BY sample) WHEN idx >= n - {after} THEN max(g0) FILTER (idx = n - 1 - {after}) OVER (PARTITION BY sample) ELSE g0 END AS gradient FROM g) {select}"""


def _hours(e):
    return e.withColumn("time", F.col("time") / 3600)


def _gradients(mode: str):
    return lambda spark, d: frames.with_gradient(_hours(events(spark, d)), "value", 8, mode).select("sample", "idx", r6("gradient"))


for _mode, _reach in (("mid", (3, 4)), ("left", (0, 7)), ("right", (7, 0))):
    QUERIES[f"gradient_{_mode}"] = _gradients(_mode)
    SQL[f"gradient_{_mode}"] = _gradient_sql(*_reach, "SELECT sample, idx, round(gradient, 6) AS gradient FROM f")


@query(_gradient_sql(4, 4, "SELECT sample, idx, coalesce(abs(gradient) < 2, false) AS below, coalesce(abs(gradient) >= 2, false) AS above FROM f"))
def gradient_threshold(spark, d):
    return masks.gradient_masks(_hours(events(spark, d)), "value", 9, 2.0).select("sample", "idx", "below", "above")


@query(_gradient_sql(4, 4, ", p AS (SELECT quantile_cont(gradient, 0.8) AS lo FROM f) SELECT sample, idx, coalesce(gradient < lo, false) AS below, coalesce(gradient >= lo, false) AS above FROM f, p"))
def gradient_percentile(spark, d):
    g = frames.with_gradient(_hours(events(spark, d)), "value", 9)
    return masks.percentile_masks(g, "gradient", [80]).select("sample", "idx", "below", "above")


@query(f"""WITH {L_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n FROM l)
SELECT sample, idx, round(CASE WHEN idx >= 5 AND idx < n - 5 THEN corr(qty, price) OVER (PARTITION BY sample ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END, 6) AS r FROM n""")
def rolling_correlation(spark, d):
    r, _ = frames.correlation("qty", "price", 10)
    return lines(spark, d).select("sample", "idx", r6(r, "r"))


#: Two-sided p of Student's t with 9 degrees of freedom, those of a full frame of 11 pairs: a finite sum in the angle.
T9 = "1 - 2 / pi() * (th + sin(th) * (cos(th) + 2.0::DOUBLE / 3 * pow(cos(th), 3) + 8.0::DOUBLE / 15 * pow(cos(th), 5) + 48.0::DOUBLE / 105 * pow(cos(th), 7)))"


@query(f"""WITH {L_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n FROM l),
r AS (SELECT sample, idx, CASE WHEN idx >= 5 AND idx < n - 5 THEN corr(qty, price) OVER (PARTITION BY sample ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END AS r FROM n),
t AS (SELECT *, CASE WHEN abs(r) < 1 THEN atan(abs(r) / sqrt(1 - r * r)) WHEN r IS NOT NULL THEN pi() / 2 END AS th FROM r), p AS (SELECT *, {T9} AS p FROM t)
SELECT sample, idx, round(r, 6) AS r, abs(round(p, 6)) AS p, NOT coalesce(abs(r) > 0.7 AND p < 0.05, false) AS kept FROM p""")
def correlation_filter(spark, d):
    return masks.correlation_mask(lines(spark, d), "qty", "price", 11, 0.7, 0.05).select("sample", "idx", r6("r"), r6("p"), "kept")


@query(f"WITH {E_SQL} SELECT sample, idx, coalesce(value < lag(value) OVER w AND value < lead(value) OVER w, false) AS minimum FROM e WINDOW w AS (PARTITION BY sample ORDER BY idx)")
def local_minima(spark, d):
    return events(spark, d).select("sample", "idx", frames.local_minima("value").alias("minimum"))


@query(f"""WITH {E_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n FROM e), w AS (SELECT unnest(range(5, max(n))) AS w FROM n)
SELECT a.sample, CAST(w AS INT) AS w, CAST(a.idx + CASE WHEN w % 2 = 1 THEN w // 2 ELSE w // 2 - 1 END AS INT) AS centre, round(avg(b.value), 10) AS mean, round(stddev_samp(b.value), 6) AS sd
FROM n a, w, n b WHERE a.sample = b.sample AND b.idx >= a.idx AND b.idx < a.idx + w AND a.idx + w <= a.n AND w < a.n GROUP BY ALL""")
def window_grid(spark, d):
    return frames.window_statistics(events(spark, d), "value", 5).select("sample", "w", "centre", F.round("mean", 10).alias("mean"), r6("sd"))


# --- runs --------------------------------------------------------------------


def masked(spark, d):
    return events(spark, d).withColumn("m", F.expr(MASK))


@query(f"WITH {RUNS} SELECT sample, idx, coalesce(lead(m) OVER (PARTITION BY sample ORDER BY idx) <> m, false) AS changes FROM r")
def transitions(spark, d):
    return masked(spark, d).select("sample", "idx", runs.transitions("m").alias("changes"))


@query(f"WITH {RUNS} SELECT sample, CAST(rn AS INT) AS run, greatest(min(idx) - 1, 0) AS start, max(idx) AS stop FROM r WHERE m GROUP BY sample, rn")
def run_bounds(spark, d):
    return runs.bounds(masked(spark, d), "m").withColumn("run", F.col("run").cast("int"))


@query(f"""WITH {RUNS}, q AS (SELECT *, CASE WHEN m THEN rn ELSE 0 END AS own FROM r)
SELECT sample, idx, CAST(CASE WHEN idx = n - 1 THEN 0 WHEN own > 0 THEN own ELSE coalesce(lead(own) OVER (PARTITION BY sample ORDER BY idx), 0) END AS INT) AS ns FROM q""")
def enumerate_runs(spark, d):
    return runs.enumerated(masked(spark, d), "m").select("sample", "idx", F.col("ns").cast("int").alias("ns"))


@query(f"WITH {RUNS}, q AS (SELECT *, coalesce(lag(time) OVER (PARTITION BY sample ORDER BY idx), time) AS bt FROM r) SELECT sample, CAST(rn AS INT) AS run, arg_min(bt, idx) AS t_lo, arg_max(time, idx) AS t_hi FROM q WHERE m GROUP BY sample, rn")
def run_ranges(spark, d):
    return runs.ranges(masked(spark, d), "m").withColumn("run", F.col("run").cast("int"))


@query(f"""WITH {RUNS}, q AS (SELECT *, coalesce(lag(time) OVER (PARTITION BY sample ORDER BY idx), time) AS bt FROM r), g AS (SELECT sample, rn, arg_min(bt, idx) AS t_lo, arg_max(time, idx) AS t_hi FROM q WHERE m GROUP BY sample, rn)
SELECT sample, idx, EXISTS (SELECT 1 FROM g WHERE g.sample = r.sample AND r.time > g.t_lo AND r.time < g.t_hi) AS inside FROM r""")
def inside_ranges(spark, d):
    e = masked(spark, d)
    return runs.inside(e, runs.ranges(e, "m")).select("sample", "idx", "inside")


@query(f"WITH {RUNS} SELECT sample, idx, CASE WHEN NOT m AND len <= 3 AND idx > 0 AND bool_or(m) OVER (PARTITION BY sample) THEN true ELSE m END AS defrag FROM r")
def defragment_include(spark, d):
    return runs.defragmented(masked(spark, d), "m", 3, "include").select("sample", "idx", "defrag")


@query(f"WITH {RUNS} SELECT sample, idx, CASE WHEN m AND len <= 3 AND idx > 0 THEN false ELSE m END AS defrag FROM r")
def defragment_exclude(spark, d):
    return runs.defragmented(masked(spark, d), "m", 3, "exclude").select("sample", "idx", "defrag")


@query(f"""WITH {RUNS}, o AS (SELECT sample, st, greatest(min(idx) - 1, 0) AS lim, row_number() OVER (PARTITION BY sample ORDER BY st) AS k FROM r WHERE NOT m AND len >= 2 GROUP BY sample, st)
SELECT r.sample, r.idx, r.m AND NOT coalesce(r.idx >= o.lim, false) AS kept FROM r LEFT JOIN o ON r.sample = o.sample AND o.k = 2""")
def exclude_downhole(spark, d):
    return runs.without_downhole(masked(spark, d), "m", 2).select("sample", "idx", "kept")


@query(f"""WITH {RUNS} SELECT a.sample, a.idx, b.m AND c.m AS trimmed FROM r a JOIN r b ON a.sample = b.sample AND b.idx = (a.idx - 2 + a.n) % a.n JOIN r c ON a.sample = c.sample AND c.idx = (a.idx + 1) % a.n""")
def trim(spark, d):
    return runs.trimmed(masked(spark, d), "m", 2, 1).select("sample", "idx", "trimmed")


# --- ratios and backgrounds --------------------------------------------------


@query(f"WITH {L_SQL} SELECT sample, idx, round(price / nullif(qty, 0), 8) AS price_qty, round(tax / nullif(disc, 0), 6) AS tax_disc FROM l")
def ratios(spark, d):
    x = ratio.with_ratios(ratio.with_ratios(lines(spark, d), ["price"], "qty"), ["tax"], "disc")
    return x.select("sample", "idx", F.round("price_qty", 8).alias("price_qty"), r6("tax_disc"))


@query(f"""WITH {L_SQL}, c AS (SELECT sample, idx, price - 3 * qty AS t, sqrt(4.0::DOUBLE * price + 9 * qty) AS tsd, qty, -3 * qty AS cov FROM l)
SELECT sample, idx, round(t, 6) AS price, round(tsd, 6) AS price_sd, round(t / qty, 8) AS price_qty, round(sqrt(greatest(tsd * tsd / (qty * qty) + t * t * qty / (qty * qty * qty * qty) - 2 * t * cov / (qty * qty * qty), 0)), 6) AS price_qty_sd FROM c""")
def interference(spark, d):
    x = lines(spark, d).withColumn("price_sd", 2 * F.sqrt("price")).withColumn("qty_sd", F.sqrt("qty"))
    x = ratio.interference_corrected(x, "price", "qty", 3.0)
    sd = ratio.quotient_sd(*(F.col(c) for c in ("price", "price_sd", "qty", "qty_sd", "price_cov_qty")))
    return x.select("sample", "idx", r6("price"), r6("price_sd"), F.round(ratio.divided(F.col("price"), F.col("qty")), 8).alias("price_qty"), r6(sd, "price_qty_sd"))


@query(f"""WITH {L_SQL}, c AS (SELECT s_suppkey AS sample, s_acctbal / 10000 AS k FROM supplier)
SELECT l.sample, l.idx, round(price / qty * k * (24.305::DOUBLE / 40.078::DOUBLE), 6) AS price_massfrac FROM l LEFT JOIN c USING (sample)""")
def mass_fractions(spark, d):
    conc = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_acctbal") / 10000).alias("int_stand_massfrac"))
    x = ratio.with_ratios(lines(spark, d), ["price"], "qty")
    return ratio.with_mass_fractions(x, {"price_qty": (24.305, 40.078)}, conc).select("sample", "idx", r6("price_massfrac"))


BKG = f"""{RUNS}, q AS (SELECT *, CASE WHEN m THEN rn ELSE 0 END AS ns FROM r),
b AS (SELECT sample, ns, count(*) AS n, avg(time / 3600) AS time, avg(value) AS mu, stddev_samp(value) AS sd, stddev_pop(value) / sqrt(count(value)) AS se FROM q WHERE ns > 0 GROUP BY sample, ns HAVING count(*) > 1)"""


def _backgrounds(spark, d):
    e = runs.number(masked(spark, d), "m", "ns").withColumn("time", F.col("time") / 3600)
    return background.summaries(e, ["value"], "ns", "time", n_min=1)


@query(f"WITH {BKG} SELECT sample, CAST(ns AS INT) AS ns, n, round(time, 6) AS time, round(mu, 6) AS value_mean, round(sd, 6) AS value_std, round(se, 6) AS value_se FROM b")
def background_summary(spark, d):
    return _backgrounds(spark, d).select("sample", F.col("ns").cast("int").alias("ns"), "n", r6("time"), r6("value_mean"), r6("value_std"), r6("value_se"))


@query(f"""WITH {BKG}, f AS (SELECT *, count(*) OVER w = 3 AS ok, avg(mu) OVER w AS rm, stddev_samp(mu) OVER w AS rs, row_number() OVER (PARTITION BY sample ORDER BY time) AS k, count(*) OVER (PARTITION BY sample) AS c FROM b WINDOW w AS (PARTITION BY sample ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, CASE WHEN ok THEN rm END AS m3, CASE WHEN ok THEN rm + 1.0 * rs END AS lim FROM f)
SELECT sample, CAST(ns AS INT) AS ns, coalesce(m3 > CASE WHEN k = 1 THEN last_value(lim) OVER (PARTITION BY sample ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lag(lim) OVER (PARTITION BY sample ORDER BY time) END, false) AS dropped FROM h""")
def background_outliers(spark, d):
    return background.rolling_outliers(_backgrounds(spark, d), ["value_mean"], 3, 1.0, time="time").select("sample", F.col("ns").cast("int").alias("ns"), "dropped")


@query(f"""WITH {E_SQL}, p AS (SELECT sample, time / 86400 AS u, value FROM e WHERE value <= 30), t AS (SELECT sample, max(time / 86400) AS en, greatest(CAST(floor(max(time / 86400) / 0.5) AS INT), 2) AS n FROM e GROUP BY sample),
g AS (SELECT sample, en * i / (n - 1) AS gt FROM t, unnest(range(0, n)) AS x(i)), w AS (SELECT g.sample, gt, value, exp(-0.5 * pow((gt - u) / (4.0::DOUBLE / (2 * sqrt(2 * ln(2.0::DOUBLE)))), 2)) AS w FROM g JOIN p ON g.sample = p.sample),
s AS (SELECT sample, gt, sum(w * value) / sum(w) AS mu, sum(w * value * value) / sum(w) AS q, sum(w) AS w FROM w GROUP BY sample, gt)
SELECT sample, round(gt, 6) AS grid_time, round(mu, 6) AS value_mean, round(sqrt(greatest(q - mu * mu, 0)), 6) AS value_std, round(sqrt(greatest(q - mu * mu, 0)) / sqrt(w), 6) AS value_se FROM s""")
def background_weighted(spark, d):
    e = events(spark, d).withColumn("u_time", F.col("time") / 86400)
    out = background.weighted(e.where("value <= 30").select("sample", "u_time", "value"), background.grid(e, 0.5), ["value"], 4.0)
    return out.select("sample", r6("grid_time"), r6("value_mean"), r6("value_std"), r6("value_se"))


@query(f"""WITH {E_SQL}, h AS (SELECT *, time / 3600 AS t FROM e), k AS (SELECT sample, t AS kt, value AS kv, lead(t) OVER w AS kt1, lead(value) OVER w AS kv1, row_number() OVER w AS i FROM h WHERE event_type = 'view' WINDOW w AS (PARTITION BY sample ORDER BY t)),
a AS (SELECT h.sample, h.idx, h.value, h.t, k.kt, k.kv, k.kt1, k.kv1 FROM h ASOF LEFT JOIN k ON h.sample = k.sample AND h.t >= k.kt), f AS (SELECT sample, kv AS fv FROM k WHERE i = 1)
SELECT a.sample, a.idx, round(a.value - CASE WHEN kt IS NULL THEN fv WHEN kt1 IS NULL OR t = kt THEN kv ELSE kv + (kv1 - kv) * ((t - kt) / (kt1 - kt)) END, 6) AS value FROM a LEFT JOIN f USING (sample)""")
def background_interpolated(spark, d):
    e = events(spark, d).withColumn("u_time", F.col("time") / 3600).select("sample", "idx", "u_time", "value", "event_type")
    knots = e.where("event_type = 'view'").select("sample", F.col("u_time").alias("knot_time"), "value")
    x = background.interpolated(e.drop("event_type"), knots, ["value"])
    return background.subtracted(x.withColumn("sig", F.lit(True)), ["value"]).select("sample", "idx", r6("value"))

@query(f"""WITH {E_SQL}, h AS (SELECT *, time / 3600 AS t FROM e), k AS (SELECT sample, t AS kt, value AS kv, lead(t) OVER w AS kt1, lead(value) OVER w AS kv1, row_number() OVER w AS i FROM h WHERE event_type = 'view' WINDOW w AS (PARTITION BY sample ORDER BY t)),
a AS (SELECT h.sample, h.idx, h.t, k.kt, k.kv, k.kt1, k.kv1 FROM h ASOF LEFT JOIN k ON h.sample = k.sample AND h.t >= k.kt), f AS (SELECT sample, kv AS fv FROM k WHERE i = 1)
SELECT a.sample, a.idx, round(CASE WHEN kt IS NULL THEN fv WHEN kt1 IS NULL OR t - kt <= kt1 - t THEN kv ELSE kv1 END, 6) AS value FROM a LEFT JOIN f USING (sample)""")
def background_nearest(spark, d):
    e = events(spark, d).withColumn("u_time", F.col("time") / 3600).select("sample", "idx", "u_time", "value", "event_type")
    knots = e.where("event_type = 'view'").select("sample", F.col("u_time").alias("knot_time"), "value")
    return background.interpolated(e.drop("event_type", "value"), knots, ["value"], kind="nearest").select("sample", "idx", r6("value_at", "value"))


def _thomas(kind: str) -> str:
    """The whole table's hourly means as knots of one curve, its tridiagonal system solved forth and back row by row."""
    cubic = f"""s AS (SELECT i, CASE WHEN i = 1 THEN 0 WHEN i = n - 2 THEN h0 - h1 * h1 / h0 ELSE h0 END AS lo, 2 * (h0 + h1) + CASE WHEN i = 1 THEN h0 + h0 * h0 / h1 ELSE 0 END + CASE WHEN i = n - 2 THEN h1 + h1 * h1 / h0 ELSE 0 END AS mi,
  CASE WHEN i = n - 2 THEN 0 WHEN i = 1 THEN h1 - h0 * h0 / h1 ELSE h1 END AS hi, 6 * (r1 - r0) AS ri FROM k WHERE i BETWEEN 1 AND n - 2)"""
    quadratic = """s AS (SELECT i, CASE WHEN i = 0 THEN 0 ELSE 1 - h0 / (h0 + h1) END - CASE WHEN i = n - 2 THEN h1 / (h0 + h1) ELSE 0 END AS lo, 2 + CASE WHEN i = 0 THEN 1 + h1 / (h1 + h2) ELSE h0 / (h0 + h1) END + CASE WHEN i = n - 2 THEN 1 + h1 / (h0 + h1) ELSE 1 - h1 / (h1 + h2) END AS mi,
  CASE WHEN i = n - 2 THEN 0 ELSE h1 / (h1 + h2) END - CASE WHEN i = 0 THEN h1 / (h1 + h2) ELSE 0 END AS hi, 4 * r1 AS ri FROM k WHERE i <= n - 2)"""
    first = 1 if kind == "cubic" else 0
    return f"""fo(i, c, x) AS (SELECT i, hi / mi, ri / mi FROM s WHERE i = {first} UNION ALL SELECT s.i, s.hi / (s.mi - s.lo * c), (s.ri - s.lo * x) / (s.mi - s.lo * c) FROM fo JOIN s ON s.i = fo.i + 1),
ba(i, x) AS (SELECT i, x FROM fo WHERE i = (SELECT max(i) FROM s) UNION ALL SELECT fo.i, fo.x - fo.c * ba.x FROM ba JOIN fo ON fo.i = ba.i - 1)""".replace("fo(i", f"{cubic if kind == 'cubic' else quadratic}, fo(i", 1)


HOURLY = f"""{E_SQL}, u AS (SELECT time / 86400 AS t, value FROM e), k0 AS (SELECT avg(t) AS t, avg(value) AS y FROM u GROUP BY floor(t * 4)),
k AS (SELECT row_number() OVER w - 1 AS i, count(*) OVER () AS n, t, y, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1, lead(t, 2) OVER w - lead(t) OVER w AS h2, (y - lag(y) OVER w) / (t - lag(t) OVER w) AS r0, (lead(y) OVER w - y) / (lead(t) OVER w - t) AS r1 FROM k0 WINDOW w AS (ORDER BY t))"""
CURVES = {
    "cubic": """m AS (SELECT i, x AS a FROM ba UNION ALL SELECT 0, b1.x - k.h0 / k.h1 * (b2.x - b1.x) FROM ba b1, ba b2, k WHERE b1.i = 1 AND b2.i = 2 AND k.i = 1
  UNION ALL SELECT k.n - 1, b1.x + k.h1 / k.h0 * (b1.x - b2.x) FROM k, ba b1, ba b2 WHERE k.i = k.n - 2 AND b1.i = k.n - 2 AND b2.i = k.n - 3),
p AS (SELECT k.t, k.y, k.h1, m.a, lead(m.a) OVER w AS a1, lead(k.y) OVER w AS y1 FROM k JOIN m USING (i) WINDOW w AS (ORDER BY k.i)),
g AS (SELECT e.sample, e.idx, e.time / 86400 AS x, p.* FROM e ASOF LEFT JOIN p ON e.time / 86400 >= p.t)
SELECT sample, idx, round(CASE WHEN t IS NULL THEN (SELECT y FROM k WHERE i = 0) WHEN h1 IS NULL THEN y ELSE (a * pow(t + h1 - x, 3) + a1 * pow(x - t, 3)) / (6 * h1) + (y / h1 - a * h1 / 6) * (t + h1 - x) + (y1 / h1 - a1 * h1 / 6) * (x - t) END, 5) AS value FROM g""",
    "quadratic": """d AS (SELECT k.i, k.n, k.t, k.y, k.h0, k.h1, ba.x AS d1, lag(ba.x) OVER (ORDER BY k.i) AS d0 FROM k LEFT JOIN ba USING (i)),
q AS (SELECT *, CASE WHEN i BETWEEN 1 AND n - 2 THEN (d1 - d0) / (h0 + h1) END AS a0 FROM d),
a AS (SELECT *, CASE WHEN i = 0 THEN lead(a0) OVER w WHEN i = n - 1 THEN lag(a0) OVER w ELSE a0 END AS a FROM q WINDOW w AS (ORDER BY i)),
p AS (SELECT t, y, h1, a, b, lead(y) OVER w AS y1, lead(a) OVER w AS a1, lead(b) OVER w AS b1 FROM (SELECT *, CASE WHEN i = 0 THEN d1 - a * h1 WHEN i = n - 1 THEN d0 + a * h0 ELSE d0 + (d1 - d0) * h0 / (h0 + h1) END AS b FROM a) WINDOW w AS (ORDER BY i)),
g AS (SELECT e.sample, e.idx, e.time / 86400 AS x, p.* FROM e ASOF LEFT JOIN p ON e.time / 86400 >= p.t)
SELECT sample, idx, round(CASE WHEN t IS NULL THEN (SELECT y FROM k WHERE i = 0) WHEN h1 IS NULL THEN y WHEN x - t <= h1 / 2 THEN y + b * (x - t) + a * pow(x - t, 2) ELSE y1 + b1 * (x - t - h1) + a1 * pow(x - t - h1, 2) END, 5) AS value FROM g""",
}


def _curve(kind: str):
    def run(spark, d):
        """The means of every six hours, over all samples, as knots of one curve."""
        e = events(spark, d).withColumn("u_time", F.col("time") / 86400)
        means = e.groupBy(F.floor(F.col("u_time") * 4)).agg(F.avg("u_time").alias("knot_time"), F.avg("value").alias("value")).select(F.lit(0).alias("all"), "knot_time", "value")
        knots = background.curved(means, ["value"], kind, by="all", size=100).drop("all")
        rows = e.select("sample", "idx", "u_time")
        out = background.interpolated(rows, background.near_knots(rows, knots), ["value"], kind=kind)
        return out.select("sample", "idx", F.round("value_at", 5).alias("value"))

    return run


for _kind in ("quadratic", "cubic"):
    QUERIES[f"background_{_kind}"] = _curve(_kind)
    SQL[f"background_{_kind}"] = f"WITH RECURSIVE {HOURLY}, {_thomas(_kind)}, {CURVES[_kind]}"


# --- errors that share a source ------------------------------------------------


@query(f"WITH {L_SQL} SELECT sample, idx, round((price - 3 * qty) / nullif(price + qty, 0), 6) AS r, round(sqrt(pow(4 * qty, 2) * price + pow(4 * price, 2) * qty) / nullif(pow(price + qty, 2), 0), 6) AS r_sd FROM l")
def shared_errors(spark, d):
    """((price - 3 qty) / qty) / ((price + qty) / qty), counts with the errors of counts: what qty adds to all four cancels in part."""
    price, qty = (Uncertain(F.col(c), {c: F.sqrt(c)}) for c in ("price", "qty"))
    r = ((price - qty * 3.0) / qty) / ((price + qty) / qty)
    return lines(spark, d).select("sample", "idx", r6(r.value, "r"), r6(r.sd(), "r_sd"))


# --- reference materials and calibration -------------------------------------

ITEMS = "i AS (SELECT p_brand AS srm, p_type AS item, avg(p_retailprice) AS v, stddev_pop(p_retailprice) / 10 AS er FROM part GROUP BY 1, 2)"


def _items(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("srm"), F.col("p_type").alias("item")).agg(F.avg("p_retailprice").alias("mol_g"), (F.stddev_pop("p_retailprice") / 10).alias("mol_g_err"))


PAIRS = [("ECONOMY", "STANDARD", 1.0), ("PROMO", "STANDARD", 2.0)]
PAIRS_SQL = "w(ratio, n, d, k) AS (VALUES ('ECONOMY_STANDARD', 'ECONOMY', 'STANDARD', 1.0::DOUBLE), ('PROMO_STANDARD', 'PROMO', 'STANDARD', 2.0::DOUBLE))"
SRM = f"{ITEMS}, {PAIRS_SQL}, s AS (SELECT a.srm, ratio, a.v * k / b.v AS mu, a.v * k / b.v * sqrt(coalesce(a.er, 0) / a.v * coalesce(a.er, 0) / a.v + coalesce(b.er, 0) / b.v * coalesce(b.er, 0) / b.v) AS er FROM w JOIN i a ON a.item = n JOIN i b ON b.item = d AND a.srm = b.srm)"


@query(f"WITH {SRM} SELECT srm, ratio, round(mu, 6) AS srm_mean, round(er, 6) AS srm_err FROM s")
def reference_ratios(spark, d):
    return calibrate.reference_ratios(_items(spark, d), PAIRS).select("srm", "ratio", r6("srm_mean"), r6("srm_err"))


MEASURED = "me AS (SELECT l_suppkey AS std, CASE WHEN l_returnflag = 'A' THEN 'ECONOMY_STANDARD' ELSE 'PROMO_STANDARD' END AS ratio, avg(l_extendedprice) / 30000 AS mu, stddev_pop(l_extendedprice) / 30000 / sqrt(count(*)) AS er FROM lineitem GROUP BY 1, 2)"
NEAREST = f"""{SRM}, {MEASURED}, zm AS (SELECT *, (log10(mu) - avg(log10(mu)) OVER (PARTITION BY ratio)) / nullif(stddev_pop(log10(mu)) OVER (PARTITION BY ratio), 0) AS z FROM me),
zr AS (SELECT *, (log10(mu) - avg(log10(mu)) OVER (PARTITION BY ratio)) / nullif(stddev_pop(log10(mu)) OVER (PARTITION BY ratio), 0) AS z FROM s),
dd AS (SELECT std, srm, sum((coalesce(zm.z, -12) - coalesce(zr.z, -12)) * (coalesce(zm.z, -12) - coalesce(zr.z, -12))) AS d2 FROM zm JOIN zr USING (ratio) GROUP BY std, srm),
nr AS (SELECT std, arg_min(srm, (d2, srm)) AS srm, min(d2) AS d2 FROM dd GROUP BY std)"""


def _measured(spark, d):
    name = F.when(F.col("l_returnflag") == "A", "ECONOMY_STANDARD").otherwise("PROMO_STANDARD")
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("std"), name.alias("ratio")).agg((F.avg(x) / 30000).alias("meas_mean"), (F.stddev_pop(x) / 30000 / F.sqrt(F.count(F.lit(1)))).alias("meas_err"))


def _nearest(spark, d):
    return calibrate.nearest_reference(_measured(spark, d), calibrate.reference_ratios(_items(spark, d), PAIRS))


@query(f"WITH {NEAREST} SELECT std, srm, round(d2, 6) AS distance2 FROM nr")
def nearest_reference(spark, d):
    return _nearest(spark, d).select("std", "srm", r6("distance2"))


@query("""WITH o AS (SELECT o_custkey AS id, min(epoch_us(o_orderdate)) / 8.64e10 AS t FROM orders GROUP BY 1), q AS (SELECT *, id % 5 = 0 AS st, sum(CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END) OVER (ORDER BY t * 1000000 + id) AS oth FROM o),
f AS (SELECT id, t, CASE WHEN oth - coalesce(lag(oth) OVER (ORDER BY t * 1000000 + id), oth) > 1 THEN 1 ELSE 0 END AS j FROM q WHERE st), g AS (SELECT *, CAST(sum(j) OVER (ORDER BY t * 1000000 + id) AS INT) AS grp FROM f)
SELECT id, grp, round(avg(t * 1000000 + id) OVER (PARTITION BY grp), 3) AS g_time FROM g""")
def consecutive_standards(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.min(F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 8.64e10).alias("t"))
    o = o.withColumn("t", F.col("t") * 1000000 + F.col("id")).withColumn("st", F.col("id") % 5 == 0)
    return calibrate.consecutive_groups(o, "st", "t").select("id", "grp", F.round("g_time", 3).alias("g_time"))


POINTS = f"{NEAREST}, pt AS (SELECT me.std, me.ratio, me.mu AS x, me.er AS ex, s.mu AS y, s.er AS ey, me.std % 3 AS grp, 1 / greatest(me.er * me.er + s.er * s.er, 1e-24 * (me.mu * me.mu + s.mu * s.mu), 1e-300) AS w FROM me JOIN nr USING (std) JOIN s ON s.srm = nr.srm AND s.ratio = me.ratio)"


def _points(spark, d):
    return calibrate.points(_measured(spark, d), calibrate.reference_ratios(_items(spark, d), PAIRS)).withColumn("grp", F.col("std") % 3)


def _zero_sql(by: str) -> str:
    return f"""WITH {POINTS}, f AS (SELECT {by}, count(*) AS n, sum(w * x * x) AS xx, sum(w * x * y) AS xy, sum(w * y * y) AS yy, max(y) / max(x) AS q, max(y) / max(x) * sqrt(pow(max(ex) / max(x), 2) + pow(max(ey) / max(y), 2)) AS q_sd FROM pt GROUP BY {by})
SELECT {by}, n, round(CASE WHEN n = 1 THEN q ELSE xy / xx END, 6) AS m, round(CASE WHEN n = 1 THEN q_sd ELSE sqrt(greatest(yy - 2 * (xy / xx) * xy + (xy / xx) * (xy / xx) * xx, 0) / nullif(n - 1, 0) / xx) END, 6) AS m_sd FROM f"""


@query(_zero_sql("ratio"))
def calibration_zero(spark, d):
    return calibrate.calibration(_points(spark, d), ["ratio"]).select("ratio", "n", r6("m"), r6("m_sd"))


@query(_zero_sql("ratio, grp"))
def calibration_drift(spark, d):
    return calibrate.calibration(_points(spark, d), ["ratio", "grp"]).select("ratio", "grp", "n", r6("m"), r6("m_sd"))


@query(f"""WITH {POINTS}, f AS (SELECT ratio, count(*) AS n, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM pt GROUP BY ratio), h AS (SELECT *, (w * xy - wx * wy) / (w * xx - wx * wx) AS m, (xx * wy - wx * xy) / (w * xx - wx * wx) AS c FROM f),
k AS (SELECT pt.ratio, sum(pt.w * pow(y - m * x - c, 2)) AS chi FROM pt JOIN h USING (ratio) GROUP BY pt.ratio)
SELECT ratio, n, round(m, 6) AS m, round(c, 6) AS c, round(sqrt(chi / (n - 2) * w / (w * xx - wx * wx)), 6) AS m_sd, round(sqrt(chi / (n - 2) * xx / (w * xx - wx * wx)), 6) AS c_sd FROM h JOIN k USING (ratio)""")
def calibration_intercept(spark, d):
    return calibrate.calibration(_points(spark, d), ["ratio"], intercept=True).select("ratio", "n", r6("m"), r6("c"), r6("m_sd"), r6("c_sd"))


# --- statistics --------------------------------------------------------------


@query(f"WITH {L_SQL} SELECT sample, " + ", ".join(f"round(avg({v}), 6) AS {v}_mean, round(stddev_pop({v}), 6) AS {v}_std, round(stddev_pop({v}) / sqrt(count({v})), 6) AS {v}_se" for v in ("qty", "price")) + " FROM l GROUP BY sample")
def sample_statistics(spark, d):
    out = stats.sample_stats(lines(spark, d), ["qty", "price"], ["mean", "std", "se"])
    return out.select("sample", *[r6(f"{v}_{s}") for v in ("qty", "price") for s in ("mean", "std", "se")])


@query(f"WITH {L_SQL} SELECT sample, round(avg(qty) FILTER (price < 40000), 6) AS qty_mean, round(avg(tax) FILTER (disc > 0), 6) AS tax_mean FROM l GROUP BY sample")
def masked_statistics(spark, d):
    out = stats.sample_stats(lines(spark, d), ["qty", "tax"], ["mean"], {"qty": F.col("price") < 40000, "tax": F.col("disc") > 0})
    return out.select("sample", r6("qty_mean"), r6("tax_mean"))


@query(f"WITH {L_SQL} SELECT sample, round(avg(qty) FILTER (price < 40000), 6) AS qty_mean_filtered, round(avg(qty), 6) AS qty_mean_all, round(avg(qty) FILTER (price < 40000) / avg(qty), 6) AS qty_mean_ratio, round(stddev_pop(qty) FILTER (price < 40000) / nullif(stddev_pop(qty), 0), 6) AS qty_std_ratio FROM l GROUP BY sample")
def filter_effect(spark, d):
    return stats.filter_effect(lines(spark, d), ["qty"], F.col("price") < 40000).select("sample", r6("qty_mean_filtered"), r6("qty_mean_all"), r6("qty_mean_ratio"), r6("qty_std_ratio"))


@query(f"WITH {RUNS} SELECT sample, CAST(rn - 1 AS INT) AS rep, round(max(time) - min(time), 6) AS seconds FROM r WHERE m GROUP BY sample, rn")
def ablation_times(spark, d):
    e = runs.number(masked(spark, d), "m", "ns")
    return stats.ablation_times(e).select("sample", F.col("rep").cast("int").alias("rep"), r6("seconds"))


@query(f"""WITH {RUNS}, a AS (SELECT sample, CAST(rn - 1 AS INT) AS rep, avg(value) AS mean, stddev_pop(value) AS std, max(time) - min(time) AS sec FROM r WHERE m GROUP BY sample, rn)
SELECT 'mean' AS statistic, sample, rep, round(mean, 6) AS value, round(sec, 6) AS seconds FROM a UNION ALL SELECT 'std', sample, rep, round(std, 6), round(sec, 6) FROM a""")
def long_statistics(spark, d):
    e = runs.number(masked(spark, d), "m", "ns").withColumn("rep", (F.col("ns") - 1).cast("int")).where("ns > 0")
    wide = stats.sample_stats(e, ["value"], ["mean", "std"], by=("sample", "rep"))
    long = stats.long_stats(wide, ["value"], ["mean", "std"], ("sample", "rep"))
    times = stats.ablation_times(e).withColumn("rep", F.col("rep").cast("int"))
    return long.join(times, ["sample", "rep"], "left").select("statistic", "sample", "rep", r6("value"), r6("seconds"))


@query(f"WITH RECURSIVE {huber_sql(E_SQL, 'SELECT sample, value AS v FROM e WHERE value IS NOT NULL')} SELECT sample, round(mean, 6) AS value_H15_mean, round(sd, 6) AS value_H15_std, round(sd / sqrt(n), 6) AS value_H15_se FROM hub")
def robust_statistics(spark, d):
    out = stats.sample_stats(events(spark, d), ["value"], ["H15_mean", "H15_std", "H15_se"])
    return out.select("sample", r6("value_H15_mean"), r6("value_H15_std"), r6("value_H15_se"))


@query(f"""WITH {E_SQL}, b AS (SELECT sample, min(value) AS lo, max(value) AS hi FROM e GROUP BY sample), h AS (SELECT e.sample, lo, hi, CAST(coalesce(least(floor((value - lo) / nullif((hi - lo) / 10, 0)), 9), 0) AS INT) AS bin FROM e JOIN b USING (sample))
SELECT sample, bin, round(lo + bin * ((hi - lo) / 10), 6) AS lo, count(*) AS n FROM h GROUP BY sample, bin, lo, hi""")
def histogram(spark, d):
    return stats.bins(events(spark, d), "value", 10, ("sample",)).select("sample", "bin", r6("lo"), "n")


@query(f"WITH {L_SQL}, b AS (SELECT min(qty) AS lx, max(qty) AS hx, min(price) AS ly, max(price) AS hy FROM l) SELECT CAST(least(floor((qty - lx) / ((hx - lx) / 20)), 19) AS INT) AS bin_x, CAST(least(floor((price - ly) / ((hy - ly) / 20)), 19) AS INT) AS bin_y, count(*) AS n FROM l, b GROUP BY 1, 2")
def histogram_2d(spark, d):
    x = lines(spark, d)
    lim = x.agg(*[f(c).alias(f"{n}{a}") for c, a in (("qty", "x"), ("price", "y")) for n, f in (("l", F.min), ("h", F.max))])
    at = lambda c, a: F.least(F.floor(F.try_divide(F.col(c) - F.col(f"l{a}"), (F.col(f"h{a}") - F.col(f"l{a}")) / 20)), F.lit(19)).cast("int")
    return x.join(F.broadcast(lim)).groupBy(at("qty", "x").alias("bin_x"), at("price", "y").alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))  # lim: one row


@query(f"WITH {RUNS}, a AS (SELECT sample, CAST(rn AS INT) AS rep, avg(value) AS v FROM r WHERE m GROUP BY sample, rn HAVING count(*) > 4) SELECT a.sample, a.rep AS rep_a, b.rep AS rep_b, round(abs(a.v - b.v), 6) AS difference FROM a JOIN a b ON a.sample = b.sample AND a.rep < b.rep")
def pair_differences(spark, d):
    return _pairs(spark, d).select("sample", "rep_a", "rep_b", r6("difference"))


def _pairs(spark, d):
    e = runs.number(masked(spark, d), "m", "rep").withColumn("rep", F.col("rep").cast("int")).where("rep > 0")
    a = e.groupBy("sample", "rep").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 4")
    return stats.pair_differences(a, "sample", "rep", "v")


@query(f"""WITH RECURSIVE {RUNS}, a AS (SELECT sample, CAST(rn AS INT) AS rep, avg(value) AS v FROM r WHERE m GROUP BY sample, rn HAVING count(*) > 4),
x AS (SELECT abs(a.v - b.v) AS x FROM a JOIN a b ON a.sample = b.sample AND a.rep < b.rep WHERE abs(a.v - b.v) > 0),
h AS (SELECT 0 AS k, ln(min(x)) - 1 AS lo, ln(max(x)) + 1 AS hi FROM x
  UNION ALL
  SELECT k + 1, CASE WHEN s > n THEN mid ELSE lo END, CASE WHEN s > n THEN hi ELSE mid END FROM (SELECT k, lo, hi, mid, sum(2 * x * x / (x * x + exp(2 * mid))) AS s, count(*) AS n FROM (SELECT *, (lo + hi) / 2 AS mid FROM h WHERE k < 100), x GROUP BY k, lo, hi, mid)),
c AS (SELECT exp((arg_max(lo, k) + arg_max(hi, k)) / 2) AS scale FROM h)
SELECT round(scale, 6) AS scale, round(scale * tan(pi() * 0.5 / 2), 6) AS q50, round(scale * tan(pi() * 0.95 / 2), 6) AS q95 FROM c""")
def reproducibility(spark, d):
    return stats.reproducibility(_pairs(spark, d)).select(r6("scale"), r6("q50"), r6("q95"))


@query("""WITH p AS (SELECT l_extendedprice AS x, p_retailprice * l_quantity AS y FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT x, y - x AS r FROM p)
SELECT count(*) AS n, round(quantile_cont(r, 0.5), 4) AS median, round(quantile_cont(r, 0.25), 4) AS lq, round(quantile_cont(r, 0.75), 4) AS uq, round(regr_slope(r, x), 6) AS slope, round(regr_r2(r, x), 6) AS r2 FROM r""")
def residual_summary(spark, d):
    out = stats.residual_summary(_compared(spark, d), "x", "y")
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("median", "lq", "uq")], r6("slope"), r6("r2"))


def _compared(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return table(spark, d, "lineitem").join(p, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("x"), (F.col("p_retailprice") * F.col("l_quantity")).alias("y"))


@query("""WITH c AS (SELECT value AS v, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type <> 'view') AS b FROM events GROUP BY 1)
, m AS (SELECT max(d) AS ks, max(na) AS na, max(nb) AS nb FROM (SELECT abs(sum(a) OVER (ORDER BY v) / sum(a) OVER ()::DOUBLE - sum(b) OVER (ORDER BY v) / sum(b) OVER ()::DOUBLE) AS d, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c))
SELECT round(ks, 6) AS ks, round(CASE WHEN ks * ks * na * nb / (na + nb) < 0.04 THEN 1.0 ELSE least(greatest(list_sum([CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * k * k * ks * ks * na * nb / (na + nb)) FOR k IN range(1, 101)]), 0), 1) END, 6) AS ks_p FROM m""")
def ks_distance(spark, d):
    return stats.ks_statistic(events(spark, d), "value", "event_type", "view").select(r6("ks"), r6("ks_p"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS x, p_retailprice * l_quantity AS y FROM lineitem JOIN part ON l_partkey = p_partkey), q AS (SELECT quantile_cont(y - x, 0.025) AS low, quantile_cont(y - x, 0.5) AS middle, quantile_cont(y - x, 0.975) AS high FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, round((x + y) / 2, 4) AS pair_mean, round(y - x, 4) AS residual, round(low, 4) AS low, round(middle, 4) AS middle, round(high, 4) AS high FROM p, q""")
def bland_altman(spark, d):
    out = stats.bland_altman(_compared(spark, d), "x", "y")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 4).alias(c) for c in ("pair_mean", "residual", "low", "middle", "high")])


# --- groups of samples, names, units -----------------------------------------


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def subset_intersect(spark, d):
    s = table(spark, d, "supplier")
    used = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return s.join(used, "s_suppkey", "left_semi").select("s_suppkey").intersect(s.where("s_acctbal > 0").select("s_suppkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0")
def subset_anti_union(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").union(c.where("c_custkey % 10 = 0")).distinct()


@query("SELECT p_type FROM part WHERE p_size < 10 EXCEPT SELECT p_type FROM part WHERE p_size > 100 OR p_brand = 'none'")
def subset_except(spark, d):
    p = table(spark, d, "part")
    return p.where("p_size < 10").select("p_type").subtract(p.where("p_size > 100 OR p_brand = 'none'").select("p_type"))


@query("""WITH n AS (SELECT p_partkey, (p_partkey % 200 + 1)::VARCHAR || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2, 1)) AS a FROM part)
SELECT p_partkey, regexp_extract(a, '[A-Za-z]{1,3}') || regexp_extract(a, '[0-9]{1,3}') || '_Ca43' AS name_mass, a || '_43Ca' AS mass_name, regexp_extract(a, '[A-Za-z]{1,3}') AS element, '$^{' || regexp_extract(a, '[0-9]{1,3}') || '}$' || regexp_extract(a, '[A-Za-z]{1,3}') || '/$^{43}$Ca' AS pretty FROM n""")
def channel_names(spark, d):
    a = F.concat((F.col("p_partkey") % 200 + 1).cast("string"), F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring("p_type", 2, 1)))
    both = F.concat(a, F.lit("_Ca43"))
    return table(spark, d, "part").select("p_partkey", names.name_mass(both).alias("name_mass"), names.mass_name(both).alias("mass_name"), names.element(a).alias("element"), names.pretty(both).alias("pretty"))


@query("""WITH f AS (SELECT p_partkey, p_size % 4 + 1 AS n, p_size % 3 AS k FROM part)
SELECT p_partkey, CAST(CASE k WHEN 0 THEN n WHEN 1 THEN 3 * n WHEN 2 THEN 2 * (1 + n) END AS INT) AS oxygen,
  round(CASE k WHEN 0 THEN 40.078 + 12.011 + n * 15.999::DOUBLE WHEN 1 THEN 40.078 + n * (12.011 + 3 * 15.999::DOUBLE) WHEN 2 THEN 3 * 24.305::DOUBLE + 2 * (28.085 + 15.999 + n * (15.999 + 1.008)) END, 6) AS mass FROM f""")
def molecules(spark, d):
    n = (F.col("p_size") % 4 + 1).cast("string")
    written = F.when(n == "1", "").otherwise(n)
    kinds = [F.concat(F.lit("CaCO"), written), F.concat(F.lit("Ca(CO3)"), written), F.concat(F.lit("Mg3(SiO(OH)"), written, F.lit(")2"))]
    formula = F.element_at(F.array(*kinds), F.col("p_size") % 3 + 1)
    return table(spark, d, "part").select("p_partkey", chem.decomposed(formula)["O"].alias("oxygen"), r6(chem.molar_mass(formula), "mass"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_retailprice / 100 WHEN 1 THEN p_retailprice / 1e6 END AS g_g, round(p_retailprice / 24.305 / (p_size / 40.078), 6) AS molar FROM part")
def units(spark, d):
    unit = F.when(F.col("p_size") % 3 == 0, "%m/m").when(F.col("p_size") % 3 == 1, "ug/g")
    return table(spark, d, "part").select("p_partkey", chem.per_gram(F.col("p_retailprice"), unit).alias("g_g"), r6(chem.molar_ratio(F.col("p_retailprice"), F.col("p_size"), F.lit(24.305), F.lit(40.078)), "molar"))


# --- clusters and segments ---------------------------------------------------


@query()
def kmeans_population(spark, d):
    x = lines(spark, d)
    return cluster.Classifier(["qty", "price"], 3).fit(x).predict(x).select("sample", "idx", "cluster")


@query()
def meanshift_by_sample(spark, d):
    return cluster.clustered_by_sample(events(spark, d), ["value"], "meanshift").select("sample", "idx", "cluster")


#: All pairs of a sample; clusters are stretches of core values without a gap over 2, and a border row goes to the one whose first core row comes first.
@query(f"""WITH {E_SQL}, v AS (SELECT sample, idx, value FROM e WHERE value IS NOT NULL AND NOT isnan(value)), k AS (SELECT sample FROM v GROUP BY sample HAVING count(*) > 10), r AS (SELECT v.* FROM v JOIN k USING (sample)),
p AS (SELECT a.sample, a.idx, b.idx AS j FROM r a JOIN r b ON a.sample = b.sample AND (a.value - b.value) * (a.value - b.value) <= 4.0::DOUBLE),
c AS (SELECT sample, idx FROM p GROUP BY sample, idx HAVING count(*) >= 5),
o AS (SELECT *, lag(value) OVER (PARTITION BY sample ORDER BY value, idx) AS before FROM r JOIN c USING (sample, idx)),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR (value - before) * (value - before) > 4.0::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY sample ORDER BY value, idx) AS isl FROM o),
f AS (SELECT *, min(idx) OVER (PARTITION BY sample, isl) AS first FROM i),
t AS (SELECT p.sample, p.idx, arg_min(f.isl, f.first) AS isl FROM p JOIN f ON f.sample = p.sample AND f.idx = p.j ANTI JOIN c ON c.sample = p.sample AND c.idx = p.idx GROUP BY p.sample, p.idx),
l AS (SELECT sample, idx, isl FROM f UNION ALL SELECT sample, idx, isl FROM t)
SELECT e.sample, e.idx, CAST(CASE WHEN r.idx IS NULL THEN -2 WHEN l.isl IS NULL THEN -1 ELSE l.isl - 1 END AS INT) AS cluster FROM e LEFT JOIN r ON r.sample = e.sample AND r.idx = e.idx LEFT JOIN l ON l.sample = e.sample AND l.idx = e.idx""")
def dbscan_by_sample(spark, d):
    return cluster.clustered_by_sample(events(spark, d), ["value"], "dbscan", eps=2.0, normalise=False).select("sample", "idx", "cluster")


@query()
def principal_components(spark, d):
    out, _ = cluster.principal_components(lines(spark, d), ["qty", "price", "disc", "tax"])
    return out.select("sample", "idx", r6("pc1"), r6("pc2"))


@query()
def autorange(spark, d):
    return segment.segmented(_hours(events(spark, d)), "value").select("sample", "idx", "sig", "bkg", "trn")


KDE = """k{v} AS (SELECT sample, ns, k, lo{v} + k * (hi{v} - lo{v}) / 99 AS p, sum(exp(-0.5 * ((lo{v} + k * (hi{v} - lo{v}) / 99 - {v}) / b{v}) ** 2)) AS y FROM f JOIN q USING (sample, ns), (SELECT unnest(range(100)) AS k) WHERE b{v} > 0 GROUP BY sample, ns, k, lo{v}, hi{v}),
l{v} AS (SELECT *, lag(y) OVER w AS y0, lead(y) OVER w AS y1, max(y) OVER (PARTITION BY sample, ns) AS top FROM k{v} WINDOW w AS (PARTITION BY sample, ns ORDER BY k)),
t{v} AS (SELECT sample, ns, arg_max(p, y) AS highest, min(p) FILTER (y > y0 AND y > y1 AND y > 0.25 * top) AS first_top FROM l{v} GROUP BY sample, ns)"""


@query(f"""WITH {RUNS}, o AS (SELECT sample, rn AS ns, idx, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY sample, rn) AS n FROM r WHERE m WINDOW w AS (PARTITION BY sample, rn ORDER BY idx)),
g AS (SELECT a.sample, a.ns, a.idx AS first, b.idx AS last, b.i - a.i + 1 AS w, avg(c.value) AS mean, stddev_samp(c.value) / abs(avg(c.value)) AS r
  FROM o a JOIN o b ON a.sample = b.sample AND a.ns = b.ns AND b.i - a.i + 1 BETWEEN 3 AND a.n - 1 JOIN o c ON a.sample = c.sample AND a.ns = c.ns AND c.i BETWEEN a.i AND b.i GROUP BY a.sample, a.ns, a.idx, b.idx, a.i, b.i),
sc AS (SELECT *, (mean - quantile_cont(mean, 0.5) OVER p) / nullif(quantile_cont(mean, 0.75) OVER p - quantile_cont(mean, 0.25) OVER p, 0) AS z, count(*) OVER p AS k FROM g WINDOW p AS (PARTITION BY sample, ns, w)),
f AS (SELECT sample, ns, first, last, w, z, r FROM sc WHERE k > 2 AND z IS NOT NULL),
q AS (SELECT sample, ns, {", ".join(f"avg({v}) AS m{v}, stddev_samp({v}) * count(*) ** -0.2::DOUBLE AS b{v}, quantile_cont({v}, 0.5) AS d{v}, quantile_cont({v}, 0.01) AS lo{v}, quantile_cont({v}, 0.99) AS hi{v}" for v in "zr")} FROM f GROUP BY sample, ns),
{KDE.format(v="z")}, {KDE.format(v="r")},
x AS (SELECT q.*, tz.highest AS hz, tr.highest AS hr, tz.first_top AS fz, tr.first_top AS fr FROM q LEFT JOIN tz USING (sample, ns) LEFT JOIN tr USING (sample, ns)),
v AS (SELECT sample, ns, 1 AS turn, coalesce(fz, hz, dz) AS lz, coalesce(fr, hr, dr) AS lr FROM x UNION ALL SELECT sample, ns, 2, coalesce(hz, dz), coalesce(hr, dr) FROM x UNION ALL SELECT sample, ns, 3, dz, dr FROM x UNION ALL SELECT sample, ns, 4, mz, mr FROM x),
b AS (SELECT sample, ns, min({{'turn': turn, 'w': -w, 'first': first, 'last': last}}) AS best FROM f JOIN v USING (sample, ns) WHERE z < lz AND r < lr GROUP BY sample, ns)
SELECT r.sample, r.idx, coalesce(m AND r.idx BETWEEN best.first AND best.last, false) AS optimal FROM r LEFT JOIN b ON r.sample = b.sample AND r.rn = b.ns""")
def optimise_signal(spark, d):
    e = runs.number(masked(spark, d), "m", "ns")
    return optimise.optimised(e, ["value"], least=3).select("sample", "idx", "optimal")


#: All events as one trace, despiked, and in stretches of value > 30.
ONE_SQL = _despiked_sql(2, 6.0, E_SQL.replace("user_id AS sample", "0 AS sample").replace("PARTITION BY user_id ORDER BY", "ORDER BY"))


@query(f"""WITH {ONE_SQL}, n AS (SELECT idx, value, value > 30 AS m, count(*) OVER () AS n FROM b1),
c AS (SELECT *, CASE WHEN m <> lag(m) OVER (ORDER BY idx) THEN 1 ELSE 0 END AS ch FROM n), t AS (SELECT *, sum(ch) OVER (ORDER BY idx) AS st FROM c)
SELECT idx, round(value, 6) AS value,
  round(CASE WHEN idx <= 2 THEN avg(value) FILTER (idx <= 2) OVER () WHEN idx >= n - 1 THEN avg(value) FILTER (idx >= n - 1) OVER () ELSE avg(value) OVER (ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) END, 6) AS smooth,
  CASE WHEN m THEN sum(CASE WHEN m AND (idx = 0 OR ch = 1) THEN 1 ELSE 0 END) OVER (ORDER BY idx) ELSE 0 END::INT AS run,
  m OR (idx > 0 AND count(*) OVER (PARTITION BY st) - CASE WHEN st = 0 THEN 1 ELSE 0 END <= 3) AS defrag FROM t""")
def one_long_trace(spark, d):
    """All events as one trace, in blocks; their size is a parameter, here so that small tables have several."""
    rows = table(spark, d, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US).alias("us"), "event_id", "value")
    trace = ranked.numbered(rows, ["us", "event_id"]).select(F.lit(0).alias("sample"), "idx", (F.col("us") / 1e6).alias("time"), "value")
    clean = durable(blocks.despiked(trace, ["value"], nlim=6.0, maxiter=2, size=2000))
    marked = blocks.smoothed(clean, "value", 5, size=2000).withColumn("m", F.expr(MASK))
    out = blocks.defragmented(blocks.number(marked, "m", size=2000), "m", 3, size=2000)
    return out.select(F.col("idx").cast("int").alias("idx"), r6("value"), r6("smooth"), "run", "defrag")


# --- statistics that merge -----------------------------------------------------


@query(f"WITH {E_SQL} SELECT sample, round(exp(avg(ln(value)) FILTER (value > 0)), 6) AS value_geometric, round(max(value) - min(value), 6) AS value_spread FROM e GROUP BY sample")
def merged_statistics(spark, d):
    """Two statistics by their states: the geometric mean of what is over 0, and the range."""
    logs = lambda x: np.array([np.log(x[x > 0]).sum(), (x > 0).sum()])
    geometric = merging.Statistic(lambda: np.zeros(2), lambda s, x: s + logs(x), np.add, lambda s: float(np.exp(s[0] / s[1])) if s[1] else float("nan"))
    ends = lambda s, x: (min(s[0], x.min(initial=np.inf)), max(s[1], x.max(initial=-np.inf)))
    spread = merging.Statistic(lambda: (np.inf, -np.inf), ends, lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: s[1] - s[0])
    out = merging.merged(events(spark, d), ["value"], {"geometric": geometric, "spread": spread})
    return out.select("sample", r6("value_geometric"), r6("value_spread"))


# --- text sources ------------------------------------------------------------


@query("""SELECT p_partkey, 'Part' AS category, 'brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'Part', 'type', p_type FROM part UNION ALL SELECT p_partkey, 'Size', 'mm', p_size::VARCHAR FROM part""")
def parsed_metadata(spark, d):
    """Each part's block of lines, read by a parser that is called laterally."""
    block = F.concat(F.lit("Part:brand="), "p_brand", F.lit(";type="), "p_type", F.lit("\nno category\nSize: mm = "), F.col("p_size").cast("string"))
    return parsers.parsed(table(spark, d, "part").select("p_partkey", block.alias("block")), "categories")



@query(r"""WITH x AS (SELECT doc_id::VARCHAR AS file, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS p FROM documents), l AS (SELECT file, len(p) AS n_lines, unnest(p) AS line, unnest(range(0, len(p))) AS line_no FROM x)
SELECT file, CAST(line_no AS INT) AS line_no, CAST(n_lines AS INT) AS n_lines, md5(line) AS line FROM l""")
def text_lines(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return dataformat.lines_of(docs, "file", "text").select("file", "line_no", "n_lines", F.md5("line").alias("line"))


@query(r"""WITH x AS (SELECT doc_id::VARCHAR AS file, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS p FROM documents), l AS (SELECT file, unnest(p) AS line, unnest(range(0, len(p))) AS line_no FROM x),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(The|Is|Of)\b') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) - 1 AS section FROM l)
SELECT file, CAST(section AS BIGINT) AS section, arg_min(regexp_extract(line, '^(The|Is|Of)\b', 1), line_no) AS name, count(*) AS n FROM s WHERE section >= 0 GROUP BY file, section""")
def split_sections(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return split.by_regex(dataformat.lines_of(docs, "file", "text"), r"^(The|Is|Of)\b").groupBy("file", "section", "name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RUNS}, b AS (SELECT sample, rn, greatest(min(idx) - 1, 0) AS start, max(idx) AS stop FROM r WHERE m GROUP BY sample, rn), c AS (SELECT *, (stop + lead(start) OVER w) // 2 AS hi, count(*) OVER (PARTITION BY sample) AS k FROM b WINDOW w AS (PARTITION BY sample ORDER BY rn)),
g AS (SELECT sample, rn, k, coalesce(lag(hi) OVER (PARTITION BY sample ORDER BY rn) + 1, 0) AS lo, coalesce(hi, 1000000000) AS hi FROM c), h AS (SELECT *, CASE WHEN rn = 1 THEN 'std_a' WHEN rn < k THEN 'smp_' || CAST(rn - 2 AS BIGINT) ELSE 'std_b' END AS nm FROM g)
SELECT r.sample AS file, nm AS sample, count(*) AS n, round(max(r.time) - min(r.time), 6) AS seconds FROM r JOIN h ON r.sample = h.sample AND r.idx BETWEEN lo AND hi GROUP BY r.sample, nm""")
def split_ablations(spark, d):
    out = split.by_ablation(masked(spark, d), "m", ["std_a", "smp_+", "std_b"])
    return out.groupBy("file", "sample").agg(F.count(F.lit(1)).alias("n"), r6(F.max("time"), "seconds"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderkey % 100 AS a, o_custkey % 100 AS b FROM orders)
SELECT o_orderkey, round(100 * 2.5 / 5, 6) AS d, round(a + b * 50.0 / nullif(sqrt(b * b * 2)::DOUBLE, 0), 6) AS x, CAST(round(o_totalprice, 2) AS DOUBLE) AS speed FROM o""")
def map_positions(spark, d):
    o = table(spark, d, "orders").withColumn("a", F.col("o_orderkey") % 100).withColumn("b", F.col("o_custkey") % 100)
    o = o.withColumn("v", sources.vertices(F.concat_ws(";", F.concat_ws(",", "a", "a", F.lit("0")), F.concat_ws(",", F.col("a") + F.col("b"), F.col("a") + F.col("b"), F.lit("0")))))
    o = o.withColumn("s", sources.settings(F.concat(F.lit("ScanSpeed=5;Price="), F.col("o_totalprice")))).withColumn("t", F.lit(2.5)).withColumn("speed", F.col("s")["ScanSpeed"].cast("double"))
    return sources.on_scan(o, "t", "v", "speed").select("o_orderkey", r6("d"), r6("x"), F.round(F.col("s")["Price"].cast("double"), 2).alias("speed"))


FILES_SQL = r"""WITH o AS (SELECT c_custkey::VARCHAR AS file, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS idx, count(*) OVER (PARTITION BY c_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 's' || file AS sample, CAST(idx AS INT) AS idx, idx * 0.5::DOUBLE AS time, round(o_totalprice, 2) AS Ca43, CAST(o_orderkey % 1000 AS DOUBLE) AS Mg24, round(o_totalprice + o_orderkey % 1000, 2) AS total_counts FROM o"""
FILES_FORMAT = {"header": 1, "footer": 1}


def _instrument_texts(spark, d):
    """(file, text): each customer's orders written as an instrument would."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.round("o_totalprice", 2).alias("p"))
    idx = F.row_number().over(Window.partitionBy("k").orderBy("o_orderkey")) - 1
    line = F.concat_ws(",", (idx * 0.5).cast("string"), F.format_string("%.2f", "p"), (F.col("o_orderkey") % 1000).cast("string"))
    rows = o.select("k", idx.alias("i"), line.alias("line")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x"))  # a file is one row
    head = F.concat(F.lit("Acquired : 2024-01-02 03:04:05 using batch\nTime [Sec],Ca43,Mg24\n"))
    text = F.concat(head, F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("\nPrinted\n"))
    return rows.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("file"), text.alias("text"))


def _as_measured(got):
    return got.select("sample", "idx", "time", F.round("Ca43", 2).alias("Ca43"), "Mg24", F.round("total_counts", 2).alias("total_counts"))


@query(FILES_SQL)
def instrument_files(spark, d):
    """Each customer's orders written as an instrument would, and read back by a format."""
    return _as_measured(dataformat.traces(dataformat.lines_of(_instrument_texts(spark, d), "file", "text"), FILES_FORMAT))


@query(FILES_SQL)
def trace_source(spark, d):
    """The same as files that are dealt out to the subfolders of a folder, read back by the data source in one scan of each."""
    folder = f"{shared_dir(spark)}/traces-{uuid.uuid4().hex}"
    reader.write_files(_instrument_texts(spark, d), folder, dealt=True)
    reader.register(spark)
    files = spark.read.format("traces").options(format=json.dumps(FILES_FORMAT), dealt="true")
    return _as_measured(files.schema(reader.schema_of(spark, folder, FILES_FORMAT)).load(folder))


@query(f"""WITH {E_SQL}, t AS (SELECT sample, max(time / 3600) AS last FROM e GROUP BY sample), o AS (SELECT sample, coalesce(sum(last) OVER (ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM t)
SELECT sample, idx, round(time / 3600 + o, 6) AS u_time FROM e JOIN o USING (sample)""")
def universal_time(spark, d):
    return dataformat.with_universal_time(_hours(events(spark, d))).select("sample", "idx", r6("u_time"))


@query("""WITH w AS (SELECT DISTINCT p_type AS key FROM part), i AS (SELECT DISTINCT p_name AS item FROM part)
SELECT key, coalesce((SELECT min(item) FROM i WHERE item = key), (SELECT min(item) FROM i WHERE lower(substr(item, 1, 3)) = lower(substr(key, 1, 3))), (SELECT min(item) FROM i WHERE lower(substr(item, 1, 1)) = lower(substr(key, 1, 1)))) AS item FROM w""")
def first_match(spark, d):
    """Names found by likeness that loosens: the same name, three letters of it, one."""
    p = table(spark, d, "part")
    wanted, items = p.select(F.col("p_type").alias("key")).distinct(), p.select(F.col("p_name").alias("item")).distinct()
    starts = lambda n: F.lower(F.substring("item", 1, n)) == F.lower(F.substring("key", 1, n))
    return calibrate.first_match(wanted, items, [F.col("item") == F.col("key"), starts(3), starts(1)], "key").select("key", "item")


@query("""WITH e AS (SELECT user_id AS sample, ts, value FROM events WHERE value >= 60), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY sample ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY sample ORDER BY ts) AS s FROM g)
SELECT sample, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 6 * 3600000000 AS stop, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS top FROM s GROUP BY sample, s""")
def signal_sessions(spark, d):
    """What the stream of sessions gives, over a table."""
    e = table(spark, d, "events").select(F.col("user_id").alias("sample"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = sessions.signal_sessions(e, 60.0, "6 hours")
    return out.select("sample", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("stop"), "n", r6("mean"), "top")


@query("""WITH e AS (SELECT user_id AS sample, epoch_us(ts) AS t, value FROM events WHERE value < 30), w AS (SELECT sample, value, (t // 900000000 - k) * 900000000 AS start FROM e, unnest(range(0, 4)) AS x(k))
SELECT sample, start, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM w GROUP BY sample, start""")
def sliding_background(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("sample"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = sessions.windowed_background(e, 30.0)
    return out.select("sample", F.unix_micros("start").alias("start"), "n", r6("mean"), r6("sd"))


def _despiked_traces_sql() -> str:
    """Traces parted at gaps of over 6 hours, two passes of despiking, and numbered runs over 60."""
    sql = """WITH t AS (SELECT user_id AS sample, epoch_us(ts) AS us, value FROM events), g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 21600000000 OR lag(us) OVER w IS NULL THEN us END AS b FROM t WINDOW w AS (PARTITION BY sample ORDER BY us, value NULLS FIRST)),
s AS (SELECT sample, us, value, max(b) OVER (PARTITION BY sample ORDER BY us, value NULLS FIRST ROWS UNBOUNDED PRECEDING) AS start FROM g), p0 AS (SELECT *, row_number() OVER (PARTITION BY sample, start ORDER BY us, value NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY sample, start) AS n FROM s)"""
    for k in range(2):
        w = "OVER (PARTITION BY sample, start ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
        sql += f", m{k} AS (SELECT *, avg(value) {w} AS m FROM p{k}), p{k + 1} AS (SELECT sample, us, start, idx, n, CASE WHEN idx >= 1 AND idx < n - 1 AND m >= 0 AND value > m + 2.0::DOUBLE * sqrt(greatest(m, 0)) THEN m ELSE value END AS value FROM m{k})"
    first = "CASE WHEN value > 60 AND NOT coalesce(lag(value) OVER (PARTITION BY sample, start ORDER BY idx) > 60, false) THEN 1 ELSE 0 END"
    return f"""{sql}, f AS (SELECT *, {first} AS first FROM p2)
SELECT sample, start, CAST(idx AS INT) AS idx, us, round(value, 6) AS value, CAST(CASE WHEN value > 60 THEN sum(first) OVER (PARTITION BY sample, start ORDER BY idx) ELSE 0 END AS INT) AS run FROM f"""


@query(_despiked_traces_sql())
def despiked_traces(spark, d):
    """What the stream of despiked traces gives, over a table."""
    e = table(spark, d, "events").select(F.col("user_id").alias("sample"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = streamed.despiked_traces(e, ["value"], 60.0, gap=6 * 3600.0, nlim=2.0, maxiter=2)
    return out.select("sample", F.unix_micros("start").alias("start"), "idx", F.unix_micros("ts").alias("us"), r6("value"), "run")


@query(f"""WITH {L_SQL}, k AS (SELECT sample, 'few' AS subset, count(*) AS n FROM l WHERE sample IN (2, 3, 5) GROUP BY sample UNION ALL SELECT sample, 'not_in_set', count(*) FROM l WHERE sample NOT IN (2, 3, 5, 7) GROUP BY sample
UNION ALL SELECT sample, '1', count(*) FROM l WHERE contains(sample::VARCHAR, '1') GROUP BY sample UNION ALL SELECT sample, 'All_Samples', count(*) FROM l WHERE NOT contains(sample::VARCHAR, '1') GROUP BY sample) SELECT sample, subset, n FROM k""")
def session_subsets(spark, d):
    """Rows of each sample of named subsets, of standards, of the others, and of what is in no subset."""
    s = Session(lines(spark, d), list(CHANNELS), standard_marker="1")
    s.make_subset(samples=[2, 3, 5], name="few")
    s.make_subset(samples=[7, 3], name="odd")
    parts = [s.of(x).groupBy("sample").agg(F.count(F.lit(1)).alias("n")).select("sample", F.lit(x).alias("subset"), "n") for x in ("few", "not_in_set", "1", "All_Samples")]
    return reduce(DataFrame.unionByName, parts)


# --- flagship ----------------------------------------------------------------


def _reduction_sql() -> str:
    """Four passes of despiking over both channels, the ratio above the threshold, and its statistics."""
    sql, last = L_SQL, "l"
    for k in range(4):
        w = "OVER (PARTITION BY sample ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
        sql += f", d{k} AS (SELECT *, avg(qty) {w} AS mq, avg(price) {w} AS mp, count(*) OVER (PARTITION BY sample) AS n FROM {last})"
        cut = lambda v, m: f"CASE WHEN idx >= 1 AND idx < n - 1 AND {m} >= 0 AND {v} > {m} + 12.0::DOUBLE * sqrt(greatest({m}, 0)) THEN {m} ELSE {v} END AS {v}"
        sql += f", c{k} AS (SELECT sample, idx, {cut('qty', 'mq')}, {cut('price', 'mp')} FROM d{k})"
        last = f"c{k}"
    sql += f", z AS (SELECT sample, CASE WHEN price >= 5000 THEN price END / nullif(qty, 0) AS x FROM {last}), g AS (SELECT sample, avg(x) AS mean, stddev_pop(x) AS std, stddev_pop(x) / sqrt(count(x)) AS se FROM z GROUP BY sample)"
    return f"WITH RECURSIVE {huber_sql(sql, 'SELECT sample, x AS v FROM z WHERE x IS NOT NULL')} SELECT sample, round(g.mean, 6) AS price_qty_mean, round(g.std, 6) AS price_qty_std, round(g.se, 6) AS price_qty_se, round(hub.mean, 6) AS price_qty_H15_mean FROM g LEFT JOIN hub USING (sample)"


@query(_reduction_sql())
def reduction(spark, d):
    """Despike, cut, ratio and summarise, robustly."""
    x = despike.despiked(lines(spark, d), ["qty", "price"], nlim=12.0)
    _, above = masks.threshold("price", 5000.0)
    x = ratio.with_ratios(x.withColumn("price", F.when(above, F.col("price"))), ["price"], "qty")
    out = stats.sample_stats(x, ["price_qty"], ["mean", "std", "se", "H15_mean"])
    return out.select("sample", *[r6(f"price_qty_{s}") for s in ("mean", "std", "se", "H15_mean")])
