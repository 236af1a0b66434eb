"""Two linear forecasters refit for every fold from one pass over the series.

A fold's least-squares fit needs only the moment matrix of its training window. Fold cutoffs and
window starts cut each series into segments; one pass sums a moment matrix per segment, and a
fold's matrix is the sum over its segments. Data-sized work is that pass; the solves see
at most two segments per fold and one small system each.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import DEFAULTS, KEYS, Settings
from hourloom.functions import timeline as tl
from hourloom.operators import folds as fo
from hourloom.operators.features import SEQUENCE_INPUTS, window_start, with_halo


def fold_segments(folds: DataFrame, years: float, keys=KEYS) -> DataFrame:
    """Per series: the sorted cut instants (2 per fold at most) and, per fold, its segment range."""
    keys = list(keys)
    start_mark = window_start(F.col("cutoff"), years) - F.expr("INTERVAL '0.000001' SECOND")
    marks = folds.withColumn("start_mark", start_mark)
    cuts = marks.groupBy(*keys).agg(
        F.array_sort(
            F.array_distinct(F.concat(F.collect_set("cutoff"), F.collect_set("start_mark")))
        ).alias("cuts"),
        F.collect_list(F.struct("fold", "cutoff", "start_mark")).alias("members"),
    )
    return cuts.select(
        *keys,
        "cuts",
        F.transform(
            "members",
            lambda m: F.struct(
                m["fold"].alias("fold"),
                F.array_position("cuts", m["start_mark"]).cast("int").alias("lo"),
                F.array_position("cuts", m["cutoff"]).cast("int").alias("hi"),
            ),
        ).alias("ranges"),
    )


def _triangle(z: np.ndarray) -> np.ndarray:
    """Upper triangle of the moment matrix of the complete rows."""
    z = z[np.isfinite(z).all(axis=1)]
    return (z.T @ z)[np.triu_indices(z.shape[1])]


def _square(tri: np.ndarray, size: int) -> np.ndarray:
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = tri
    return full + np.triu(full, 1).T


def segment_moments(rows: DataFrame, z, segments: DataFrame, blocks, keys=KEYS) -> DataFrame:
    """Partial moment matrices per (series, segment) of the column groups `blocks` of vector `z`.

    `rows` holds keys, ts and the columns that `z` (array<double>, NaN where unknown) is made from; it is made after rows
    have met their series' cuts, so that plain columns are shuffled and not vectors. Rows are summed within each
    Arrow batch where they lie, so what moves later is one matrix per segment a batch touches.
    """
    keys = list(keys)
    # Segment k holds the instants after cut k and up to cut k+1 (cuts counted from one).
    seg = F.size(F.filter("cuts", lambda c: c < F.col("ts")))
    if "cuts" not in rows.columns:
        rows = tl.join_series(rows, segments.select(*keys, "cuts"), keys)
    tagged = (
        rows
        .select(*keys, seg.alias("seg"), (seg < F.size("cuts")).alias("used"), z.alias("z"))
        .where("used AND seg > 0")
        .drop("used")
    )

    def partial(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            labels = pa.Table.from_batches([batch]).select([*keys, "seg"])
            group = labels.to_pandas().groupby([*keys, "seg"], sort=False, dropna=False).ngroup()
            group = group.to_numpy()
            _, first = np.unique(group, return_index=True)
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False)
            z = z.reshape(batch.num_rows, -1)[np.argsort(group, kind="stable")]
            ends = np.cumsum(np.bincount(group))
            sums = [
                np.concatenate([_triangle(part[:, b]) for b in blocks])
                for part in np.split(z, ends[:-1])
            ]
            width = len(sums[0])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sums) + 1) * width, pa.int32()),
                pa.array(np.concatenate(sums)),
            )
            head = labels.take(pa.array(first)).combine_chunks()
            columns = [head.column(c).combine_chunks() for c in (*keys, "seg")]
            yield pa.RecordBatch.from_arrays([*columns, lists], [*keys, "seg", "moments"])

    return tagged.mapInArrow(partial, f"{key_ddl(tagged, keys)}, seg int, moments array<double>")


def key_ddl(df: DataFrame, keys) -> str:
    return df.select(*keys).schema.simpleString()[7:-1].replace(":", " ")


def solve_folds(moments: DataFrame, segments: DataFrame, blocks, solve, keys=KEYS) -> DataFrame:
    """Add up each fold's segments and solve; `solve` maps matrices, and the fold's window as a
    (start, cutoff) pair, to a coefficient vector.

    A group holds one series' partial matrices: segments are two per fold at most, so its size
    follows the number of folds and not the length of the series.
    """
    keys = list(keys)
    sizes = [len(b) for b in blocks]
    widths = [n * (n + 1) // 2 for n in sizes]

    def fit(mom, seg):
        if mom.empty or seg.empty:
            return pd.DataFrame(columns=[*keys, "fold", "coef"])
        ranges, cuts = seg.iloc[0]["ranges"], seg.iloc[0]["cuts"]
        top = max(r["hi"] for r in ranges) + 1
        table = np.zeros((top, sum(widths)))
        where = mom["seg"].to_numpy()
        inside = where < top
        np.add.at(table, where[inside], np.stack(mom["moments"].to_numpy())[inside])
        out = []
        for r in ranges:
            flat, at, mats = table[r["lo"] : r["hi"]].sum(axis=0), 0, []
            for n, w in zip(sizes, widths):
                mats.append(_square(flat[at : at + w], n))
                at += w
            out.append((*[seg.iloc[0][k] for k in keys], int(r["fold"]), solve(*mats, (cuts[r["lo"] - 1], cuts[r["hi"] - 1]))))
        return pd.DataFrame(out, columns=[*keys, "fold", "coef"])

    return (
        moments.groupBy(*keys)
        .cogroup(segments.groupBy(*keys))
        .applyInPandas(fit, f"{key_ddl(segments, keys)}, fold int, coef array<double>")
    )


def dot(x, beta):
    return F.aggregate(
        F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
    )


def ridge(gram: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Coefficients of the last column on the others, least squares with a diagonal penalty."""
    a = gram[:-1, :-1] + np.diag(penalty)
    try:
        return np.linalg.solve(a, gram[:-1, -1])
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, gram[:-1, -1], rcond=None)[0]


# ------------------------------------------------- harmonics with autoregressive errors

_HARMONICS = len(tl.fourier_names())
_X = 1 + _HARMONICS


def _one_hour_back() -> np.ndarray:
    """Matrix turning the regressors of hour t into those of hour t-1 (a rotation per harmonic)."""
    turn = np.eye(_X)
    at = 1
    for p in tl.FOURIER_PERIODS:
        for k in range(1, tl.FOURIER_HARMONICS + 1):
            d = 2 * np.pi * k / p
            turn[at : at + 2, at : at + 2] = [[np.cos(d), -np.sin(d)], [np.sin(d), np.cos(d)]]
            at += 2
    return turn


def solve_harmonic(level: np.ndarray, lagged: np.ndarray, window=None) -> np.ndarray:
    """Coefficients, then the two autoregressive ones from the residual moments."""
    beta = ridge(level, np.full(_X, 1e-8))
    turn = _one_hour_back()
    # Residuals at t, t-1, t-2 as linear forms over (x_t, y_t, y_t-1, y_t-2).
    forms = np.zeros((3, _X + 3))
    back = np.eye(_X)
    for i in range(3):
        forms[i, :_X] = -(beta @ back)
        forms[i, _X + i] = 1.0
        back = turn @ back
    m = forms @ lagged @ forms.T
    phi = np.linalg.lstsq(m[1:, 1:], m[1:, 0], rcond=None)[0]
    # Pull roots on or outside the unit circle inside it, so a forecast cannot grow.
    radius = np.abs(np.roots([1.0, -phi[0], -phi[1]])).max()
    if radius >= 0.999:
        shrink = 0.999 / radius
        phi = phi * np.array([shrink, shrink**2])
    return np.concatenate([beta, phi])


def harmonic_regressors(ts):
    return F.array(F.lit(1.0), *tl.fourier(ts))


_HARMONIC_BLOCKS = [
    list(range(_X + 1)),
    list(range(_X + 3)),
]


def harmonic_rows(features: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Targets now, one and two hours back; unknown ones are null."""
    keys = list(keys)
    masked = features.select(*keys, "ts", F.when(F.col("bad_day") == 0, F.col("y")).alias("y"))
    order = Window.partitionBy(*keys, "__block").orderBy("ts")
    lagged = (
        with_halo(masked, 1, cfg)
        .withColumns({"y1": F.lag("y", 1).over(order), "y2": F.lag("y", 2).over(order)})
        .where("__own")
    )
    return lagged.select(*keys, "ts", "y", "y1", "y2")


def harmonic_vector():
    """Design vector (regressors, y, y one hour back, y two hours back) of a row of harmonic_rows(); unknown y is NaN."""
    ys = [F.coalesce(F.col(c), F.lit(float("nan"))) for c in ("y", "y1", "y2")]
    return F.concat(harmonic_regressors(F.col("ts")), F.array(*ys))


def harmonic_fit(
    features: DataFrame, folds: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Per fold: intercept, harmonic coefficients and two autoregressive ones."""
    segments = fold_segments(folds, cfg.sarima_years, keys)
    rows = harmonic_rows(features, keys, cfg)
    moments = segment_moments(rows, harmonic_vector(), segments, _HARMONIC_BLOCKS, keys)
    return solve_folds(moments, segments, _HARMONIC_BLOCKS, solve_harmonic, keys)


def harmonic_forecast(
    features: DataFrame, folds: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Regression on harmonics plus AR(2) residuals rolled forward from the cutoff."""
    keys = list(keys)
    coef = harmonic_fit(features, folds, keys, cfg)
    # The last two residuals before each target day; a quarantined hour counts as zero residual.
    ends = folds.select(
        *keys,
        "fold",
        "target_date",
        F.explode(F.array(F.col("cutoff"), F.col("cutoff") - tl.hours(1))).alias("ts"),
        "cutoff",
    )
    known = features.select(*keys, "ts", F.when(F.col("bad_day") == 0, F.col("y")).alias("y"))
    tail = (
        ends.join(known, [*keys, "ts"])
        .groupBy(*keys, "fold", "target_date", "cutoff")
        .agg(
            F.max(F.when(F.col("ts") == F.col("cutoff"), F.col("y"))).alias("y0"),
            F.max(F.when(F.col("ts") < F.col("cutoff"), F.col("y"))).alias("y1"),
        )
    )
    fitted = tail.join(coef, [*keys, "fold"])
    beta = F.slice("coef", 1, _X)
    phi1, phi2 = F.element_at("coef", _X + 1), F.element_at("coef", _X + 2)

    def residual(y, ts):
        return F.coalesce(F.col(y) - dot(harmonic_regressors(ts), beta), F.lit(0.0))

    # Accumulate (previous residual, the one before, all so far) over the horizon.
    rolled = F.aggregate(
        F.sequence(F.lit(1), F.lit(cfg.horizon)),
        F.struct(
            residual("y0", F.col("cutoff")).alias("a"),
            residual("y1", F.col("cutoff") - tl.hours(1)).alias("b"),
            F.array().cast("array<double>").alias("all"),
        ),
        lambda s, _: F.struct(
            (phi1 * s["a"] + phi2 * s["b"]).alias("a"),
            s["a"].alias("b"),
            F.concat(s["all"], F.array(phi1 * s["a"] + phi2 * s["b"])).alias("all"),
        ),
        lambda s: s["all"],
    )
    targets = fitted.select(
        *keys,
        "fold",
        beta.alias("beta"),
        F.posexplode(F.arrays_zip(tl.target_hours(F.col("target_date"), cfg).alias("ts"), rolled.alias("r"))).alias("i", "hour"),
    )
    ts = F.col("hour.ts")
    return targets.select(
        *keys,
        "fold",
        ts.alias("ts"),
        (dot(harmonic_regressors(ts), F.col("beta")) + F.col("hour.r")).alias("y_pred"),
    )


# ------------------------------------------------- additive trend, seasons and holidays

# Harmonics of the yearly, weekly and daily cycle, and how far apart the trend may bend.
YEARLY, WEEKLY, DAILY = (365.25, 10), (7.0, 3), (1.0, 4)
HINGES_A_YEAR = 4
TREND_ORIGIN = "TIMESTAMP_NTZ '2000-01-01 00:00:00'"


def trend_years(ts):
    return tl.hours_between(F.expr(TREND_ORIGIN), ts) / F.lit(24 * 365.25)


def calendar_hinges(folds: DataFrame, years: float) -> list[float]:
    """The bends, in years since the origin, that may lie inside some fold's window: at fixed calendar dates, so that a
    fold's bends don't depend on the other folds."""
    first, last = folds.agg(F.min(trend_years(window_start(F.col("cutoff"), years))), F.max(trend_years(F.col("cutoff")))).first()
    if first is None:
        return []
    return [k / HINGES_A_YEAR for k in range(int(np.ceil(first * HINGES_A_YEAR)), int(np.floor(last * HINGES_A_YEAR)) + 1)]


def additive_regressors(ts, hinges: list[float]):
    """Intercept, trend in years with a bend at each hinge, three cycles, one dummy per holiday."""
    hours = tl.hours_between(F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)
    t = trend_years(ts)
    bends = [F.greatest(t - F.lit(k), F.lit(0.0)) for k in hinges]
    waves = []
    for period, order in (YEARLY, WEEKLY, DAILY):
        for k in range(1, order + 1):
            turn = F.pmod(hours * F.lit(k) / F.lit(24.0 * period), F.lit(1.0)) * F.lit(2 * np.pi)
            waves += [F.sin(turn), F.cos(turn)]
    days = [F.coalesce(h.cast("double"), F.lit(0.0)) for h in tl.us_holidays(F.to_date(ts)).values()]
    return F.array(F.lit(1.0), t, *bends, *waves, *days)


_N_SEASONS = 2 * (YEARLY[1] + WEEKLY[1] + DAILY[1]) + 11


def solve_additive(gram: np.ndarray, window, hinges: list[float]) -> np.ndarray:
    """Coefficients of one fold. Bends at or outside the ends of its window are no inputs of it: before, they would repeat
    the trend, and after, nothing is known of them. The trend is solved in years before the cutoff, where it is small."""
    n, knots = len(gram) - 1, np.array(hinges)
    origin = np.datetime64("2000-01-01T00:00:00")
    start, end = ((np.datetime64(w) - origin) / np.timedelta64(1, "s") / (86400 * 365.25) for w in window)
    inside = np.concatenate([[True, True], (knots > start) & (knots < end), np.ones(_N_SEASONS, dtype=bool), [True]])
    shift = np.eye(n + 1)
    shift[0, 1] = -end  # trend input less the cutoff's, as a mix of trend and intercept
    moved = (shift.T @ gram @ shift)[np.ix_(inside, inside)]
    # Loose priors on level and seasons, a tight one on changes of slope.
    penalty = np.full(n, 1e-3)
    penalty[2 : 2 + len(knots)] = 4.0
    out = np.zeros(n + 1)
    out[inside] = [*ridge(moved, penalty[inside[:-1]]), 0.0]
    return (shift @ out)[:-1]


def additive_fit(
    features: DataFrame, folds: DataFrame, hinges: list[float], keys=KEYS, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Per fold: coefficients of the additive model over its capped window, bad days dropped."""
    keys = list(keys)
    segments = fold_segments(folds, cfg.prophet_years, keys)
    known = features.where((F.col("bad_day") == 0) & F.col("y").isNotNull())
    rows = known.select(*keys, "ts", "y")
    z = F.concat(additive_regressors(F.col("ts"), hinges), F.array("y"))
    blocks = [list(range(2 + len(hinges) + _N_SEASONS + 1))]
    moments = segment_moments(rows, z, segments, blocks, keys)
    return solve_folds(moments, segments, blocks, lambda gram, window: solve_additive(gram, window, hinges), keys)


def additive_forecast(
    features: DataFrame, folds: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Trend with bends at calendar dates, seasons and holidays; each fold from its own window alone."""
    keys = list(keys)
    hinges = calendar_hinges(folds, cfg.prophet_years)
    fit = additive_fit(features, folds, hinges, keys, cfg)
    hours = fo.fold_targets(folds, keys, cfg).select(*keys, "fold", "ts")
    return hours.join(fit, [*keys, "fold"]).select(
        *keys,
        "fold",
        "ts",
        dot(additive_regressors(F.col("ts"), hinges), F.col("coef")).alias("y_pred"),
    )


def harmonic_moment_report(
    features: DataFrame, folds: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Readable part of the harmonic model's segment sums, for checking them."""
    names = tl.fourier_names()
    segments = fold_segments(folds, cfg.sarima_years, keys)
    sums = segment_moments(harmonic_rows(features, keys, cfg), harmonic_vector(), segments, _HARMONIC_BLOCKS, keys)
    y, level_n, lag_n = _X, _X + 1, _X + 3

    def at(size, row, col, offset=0):
        """Sum over the partial matrices of one entry of an upper triangle, row by row."""
        return F.sum(F.col("moments")[offset + row * size - row * (row - 1) // 2 + (col - row)])

    after = level_n * (level_n + 1) // 2
    return sums.groupBy(*keys, "seg").agg(
        at(level_n, 0, 0).cast("bigint").alias("n"),
        F.round(at(level_n, 0, y), 3).alias("sum_y"),
        F.round(at(level_n, 1 + names.index("sin_24_1"), y), 3).alias("y_sin24"),
        F.round(at(level_n, 1 + names.index("cos_168_3"), y), 3).alias("y_cos168"),
        at(lag_n, 0, 0, after).cast("bigint").alias("n_lagged"),
        F.round(at(lag_n, _X, _X + 1, after) / 1_000_000, 3).alias("y_y1"),
        F.round(at(lag_n, _X, _X + 2, after) / 1_000_000, 3).alias("y_y2"),
    )


# ------------------------------------------------- training-fold standardisation

def standardisation(
    features: DataFrame, folds: DataFrame, years: float | None = None, keys=KEYS,
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Mean and population standard deviation (+1e-8) per fold over its training days: of all
    targets (pos 0) and of each exogenous position (pos 1..144).

    Days are summed per segment between fold boundaries; running totals over the few segments
    then serve every fold, so history is read once and not once per fold.
    """
    from hourloom.operators.features import sequence_days

    keys = list(keys)
    years = cfg.lstm_years if years is None else years
    # A day trains a fold if its week of history starts inside the window and it ends by the cutoff.
    shifted = folds.withColumn("cutoff", F.col("cutoff") - tl.hours(168 + cfg.horizon - 1))
    start_mark = window_start(F.col("cutoff") + tl.hours(168 + cfg.horizon - 1), years)
    marks = shifted.withColumn("start_mark", start_mark - F.expr("INTERVAL '0.000001' SECOND"))
    cuts = marks.groupBy(*keys).agg(
        F.array_sort(
            F.array_distinct(F.concat(F.collect_set("cutoff"), F.collect_set("start_mark")))
        ).alias("cuts")
    )
    week_start = tl.midnight(F.col("op_date")) + tl.hours(cfg.op_day_offset_h - 168)
    days = tl.join_series(sequence_days(features, keys, cfg).withColumn("ts", week_start), cuts, keys, cfg).select(
        *keys, "op_date", F.size(F.filter("cuts", lambda c: c < F.col("ts"))).alias("seg"))
    # Sums per segment and lead straight from the hours; one row of them holds seven positions.
    values = {0: F.col("y"), **{i: F.col(c).cast("double") for i, c in enumerate(SEQUENCE_INPUTS, 1)}}
    by_lead = features.join(days, [*keys, "op_date"]).groupBy(*keys, "seg", "lead").agg(
        F.count("y").alias("n"), *[f.alias(f"{c}{i}") for i, v in values.items() for c, f in (("s", F.sum(v)), ("q", F.sum(v * v)))])
    place = {i: F.lit(0) if i == 0 else len(SEQUENCE_INPUTS) * (F.col("lead") - 1) + i for i in values}
    stacked = by_lead.select(*keys, "seg", F.inline(F.array(*[
        F.struct(place[i].cast("int").alias("pos"), F.col("n"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q")) for i in values])))
    sums = stacked.groupBy(*keys, "pos", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    # Every (position, segment), so that running totals can be read at any boundary.
    dense = cuts.select(
        *keys, F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("seg"),
    ).select(*keys, "seg", F.explode(F.sequence(F.lit(0), F.lit(6 * cfg.horizon))).alias("pos"))
    run = Window.partitionBy(*keys, "pos").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    running = dense.join(sums, [*keys, "pos", "seg"], "left").select(
        *keys, "pos", "seg", *[F.coalesce(F.sum(c).over(run), F.lit(0)).alias(c) for c in ("n", "s", "q")]
    )
    edges = marks.join(cuts, keys).select(
        *keys,
        "fold",
        F.inline(
            F.array(
                F.struct((F.array_position("cuts", F.col("cutoff")) - 1).cast("int").alias("seg"), F.lit(1).alias("sign")),
                F.struct((F.array_position("cuts", F.col("start_mark")) - 1).cast("int").alias("seg"), F.lit(-1).alias("sign")),
            )
        ),
    )
    window = (
        edges.join(running, [*keys, "seg"])
        .groupBy(*keys, "fold", "pos")
        .agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("n", "s", "q")])
        .where("n > 0")
    )
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))) + F.lit(1e-8)
    return window.select(*keys, "fold", "pos", F.col("n").cast("bigint").alias("n"), mean.alias("mean"), spread.alias("std"))
