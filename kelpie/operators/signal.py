"""Signal operators that need a numeric kernel: one group is one signal, handed to numpy by Arrow.

A signal of any length goes through ``blocks`` first where its operator allows it; the grouped operators here
hold one group in a task, as one signal is one recording.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(samples: Column, size: int, hop: int) -> Column:
    """Overlapping blocks of an array; the last one may be shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(samples) - 1, F.lit(0)), F.lit(hop))
    return F.transform(starts, lambda i: F.slice(samples, i + 1, F.lit(size)))


def mid(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def side(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a - b) / 2)


def biquad(samples: Column, b: tuple[float, float, float], a: tuple[float, float]) -> Column:
    """Second-order recursive filter over an array, as a fold that carries two past inputs and outputs."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("x1", "x2", "y1", "y2")], F.array().cast("array<double>").alias("out"))

    def step(s, x):
        y = b[0] * x + b[1] * s["x1"] + b[2] * s["x2"] - a[0] * s["y1"] - a[1] * s["y2"]
        return F.struct(x.cast("double").alias("x1"), s["x1"].alias("x2"), y.alias("y1"), s["y1"].alias("y2"), F.concat(s["out"], F.array(y)).alias("out"))

    return F.aggregate(samples, zero, step, lambda s: s["out"])


def second_order(kind: str, corner: float, q: float, rate: float, gain_db: float = 0.0) -> tuple[tuple[float, float, float], tuple[float, float]]:
    """(b, a) of a high shelf, a high pass or a low pass with its corner at a frequency, by the bilinear transform with the corner kept in place."""
    k = math.tan(math.pi * corner / rate)
    below = 1 + k / q + k * k
    a = (2 * (k * k - 1) / below, (1 - k / q + k * k) / below)
    if kind == "high pass":
        return (1.0, -2.0, 1.0), a
    if kind == "low pass":
        return (k * k / below, 2 * k * k / below, k * k / below), a
    top = 10 ** (gain_db / 20)
    middle = top**SHELF_EXPONENT
    return ((top + middle * k / q + k * k) / below, 2 * (k * k - top) / below, (top - middle * k / q + k * k) / below), a


#: Fixed values of the K-weighting (ITU-R BS.1770): its shelf and its high pass, and the offset of the level.
SHELF_EXPONENT = 0.4996667741545416
SHELF = ("high shelf", 1681.9744509555319, 0.7071752369554193)
SHELF_GAIN_DB = 3.99984385397
HIGH_PASS = ("high pass", 38.13547087613982, 0.5003270373253953)
OFFSET_DB = -0.691


def k_weighting(rate: float) -> list[tuple]:
    """Both stages, designed for the file's rate."""
    return [second_order(*SHELF, rate, SHELF_GAIN_DB), second_order(*HIGH_PASS, rate)]


def weighted_energy(samples: Column, stages: list[tuple]) -> Column:
    """Sum of squares of an array after filters in series: one fold, which carries two past inputs and outputs of each stage."""
    names = [f"{x}{i}" for i in range(len(stages)) for x in ("x1_", "x2_", "y1_", "y2_")]
    zero = F.struct(*[F.lit(0.0).alias(n) for n in names], F.lit(0.0).alias("e"))

    def step(s, x):
        value, fields = x.cast("double"), []
        for i, (b, a) in enumerate(stages):
            out = b[0] * value + b[1] * s[f"x1_{i}"] + b[2] * s[f"x2_{i}"] - a[0] * s[f"y1_{i}"] - a[1] * s[f"y2_{i}"]
            fields += [value.alias(f"x1_{i}"), s[f"x1_{i}"].alias(f"x2_{i}"), out.alias(f"y1_{i}"), s[f"y1_{i}"].alias(f"y2_{i}")]
            value = out
        return F.struct(*fields, (s["e"] + value * value).alias("e"))

    return F.aggregate(samples, zero, step, lambda s: s["e"])


def k_weighted_level(df: DataFrame, key: str, order: str, value: str, rate: float) -> DataFrame:
    """Level of each series after both stages of the K-weighting."""
    one = _ordered(df, key, order, value)
    power = weighted_energy(F.col("v"), k_weighting(rate)) / F.size("v")
    return one.select(key, F.size("v").cast("long").alias("n"), F.round(OFFSET_DB + 10 * F.log10(F.greatest(power, F.lit(1e-20))), 6).alias("level_db"))


def half_band(taps: int = 15, beta: float = 5.0) -> list[float]:
    """A low pass at half of the band, of gain one: windowed sinc."""
    t = np.arange(taps) - taps // 2
    h = np.sinc(t / 2) * np.kaiser(taps, beta)
    return (h / h.sum()).tolist()


def decimated(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value) at half the rate; what lies beyond an end is silence. Neighbours are read by a window, so no series is gathered."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    h = half_band()
    middle = len(h) // 2
    near = lambda k: F.col(value) if k == 0 else F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)
    out = sum((F.lit(c) * F.coalesce(near(j - middle), F.lit(0.0)) for j, c in enumerate(h)), F.lit(0.0))
    return df.withColumn("_y", out).filter(F.pmod(order, F.lit(2)) == 0).select(key, (F.col(order) / 2).cast("long").alias(order), F.col("_y").alias(value))


def prominences(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, prominence) of the local maxima: how far one has to come down before ground higher than the peak begins, on the higher of both sides."""
    peaks = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1
    out = np.zeros(len(peaks))
    for side in (1, -1):
        y = x[::side]
        lowest = np.zeros(len(y))
        stack: list[tuple[float, float]] = []  # heights that fall, each with the lowest ground since the one before it
        for i, v in enumerate(y.tolist()):
            low = v
            while stack and stack[-1][0] <= v:
                low = min(low, stack.pop()[1])
            lowest[i] = low
            stack.append((v, low))
        base = lowest[::side][peaks]
        out = base if side == 1 else np.maximum(out, base)
    return peaks, x[peaks] - out


def peaks(df: DataFrame, key: str, order: str, value: str, least: float) -> DataFrame:
    def kernel(v):
        at, height = prominences(v)
        ok = height >= least
        return {"at": at[ok].astype(np.int64), "prominence": np.round(height[ok], 6)}

    return _per_row(_ordered(df, key, order, value), key, kernel, f"{key} long, at long, prominence double")


def _ordered(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One row per group with its values in order."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"))


def _per_row(df: DataFrame, key: str, kernel, schema: str) -> DataFrame:
    """Apply kernel(array) -> dict of equal-length arrays to each row's array ``v``."""

    def run(batches):
        for batch in batches:
            keys, out = [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = kernel(np.asarray(v.values.to_numpy(zero_copy_only=False), float))
                n = len(next(iter(got.values())))
                keys += [k] * n
                out.append(got)
            if out:
                names = list(out[0])
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *[pa.array(np.concatenate([o[n] for o in out])) for n in names]], names=[batch.schema.names[0], *names])

    return df.mapInArrow(run, schema)


def welch_psd(x: np.ndarray, size: int) -> np.ndarray:
    """One-sided power density: Hann windows, half overlap, mean removed; sampling rate 1."""
    size = min(size, len(x))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    hop = max(1, size // 2)
    frames = np.stack([x[i : i + size] for i in range(0, len(x) - size + 1, hop)])
    power = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * w, axis=1)) ** 2 / (w * w).sum()
    power[:, 1 : -1 if size % 2 == 0 else None] *= 2
    return power.mean(0)


def welch(df: DataFrame, key: str, order: str, value: str, size: int, places: int = 3) -> DataFrame:
    def kernel(v):
        p = welch_psd(v, size)
        return {"bin": np.arange(len(p), dtype=np.int64), "frequency": np.arange(len(p)) / min(size, len(v)), "power": np.round(p, places)}

    return _per_row(_ordered(df, key, order, value), key, kernel, f"{key} long, bin long, frequency double, power double")


def flux(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """(key, frames, mean_flux, max_flux): what the bins of a spectrum gain from one Hann frame to the next, half a frame on."""
    def kernel(v):
        n = min(size, len(v))
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        frames = np.stack([v[i : i + n] for i in range(0, len(v) - n + 1, max(1, n // 2))])
        mags = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * w, axis=1)) / math.sqrt((w * w).sum() or 1.0)
        gain = np.maximum(np.diff(mags, axis=0), 0).sum(1)
        some = slice(0, 1 if len(gain) else 0)
        return {"frames": np.array([len(gain)])[some], "mean_flux": np.array([round(gain.mean(), 4) if len(gain) else 0.0])[some], "max_flux": np.array([round(gain.max(initial=0.0), 4)])[some]}

    return _per_row(_ordered(df, key, order, value), key, kernel, f"{key} long, frames long, mean_flux double, max_flux double")


def frame_spectra(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """(key, frame, bin, mag): the magnitudes of Hann frames, half a frame apart."""
    def kernel(v):
        n = min(size, len(v))
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        frames = np.stack([v[i : i + n] for i in range(0, len(v) - n + 1, max(1, n // 2))])
        mags = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * w, axis=1)) / math.sqrt((w * w).sum() or 1.0)
        return {"frame": np.repeat(np.arange(len(mags)), mags.shape[1]), "bin": np.tile(np.arange(mags.shape[1]), len(mags)), "mag": mags.ravel()}

    return _per_row(_ordered(df, key, order, value), key, kernel, f"{key} long, frame long, bin long, mag double")


def checkerboard(x: np.ndarray, size: int) -> np.ndarray:
    """Novelty along the diagonal of a cosine self-similarity matrix, under a Gaussian checkerboard of half-width ``size``.

    The kernel is a product of one tapering step with itself, and the matrix one of unit rows with themselves, so the sum under the kernel
    is the squared length of the rows summed under the step: linear in the series, and the matrix is never made.
    """
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    t = np.arange(-size, size) + 0.5
    step = np.exp(-((t / (size / 2)) ** 2) / 2) * np.sign(t)
    padded = np.pad(unit, ((size, size - 1), (0, 0)))
    n = (np.stack([np.correlate(padded[:, k], step, mode="valid") for k in range(x.shape[1])], axis=1) ** 2).sum(1)
    span = n.max() - n.min()
    return (n - n.min()) / span if span > 0 else np.zeros(len(n))


def novelty(df: DataFrame, key: str, order: str, value: str, lags: int = 4, size: int = 8, least: float = 0.5, apart: int = 4) -> DataFrame:
    """Boundaries (position, strength): peaks of novelty over ``least``, those nearer than ``apart`` merged into the stronger."""

    def kernel(v):
        m = len(v) - lags + 1
        if m < 3:
            return {"at": np.zeros(0, np.int64), "strength": np.zeros(0)}
        n = checkerboard(np.stack([v[i : i + m] for i in range(lags)], axis=1), size)
        peaks = [i for i in range(1, m - 1) if n[i] >= least and n[i] > n[i - 1] and n[i] >= n[i + 1]]
        kept: list[int] = []
        for i in sorted(peaks, key=lambda k: (-n[k], k)):
            if all(abs(i - k) >= apart for k in kept):
                kept.append(i)
        kept.sort()
        return {"at": np.array(kept, np.int64), "strength": np.round(n[kept], 6)}

    return _per_row(_ordered(df, key, order, value), key, kernel, f"{key} long, at long, strength double")


def interpolators(factor: int, taps: int = 12) -> list[list[float]]:
    """For each place between two samples: the weights of the samples around."""
    t = np.arange(-taps, taps + 1)
    return [(np.sinc(t - k / factor) * np.kaiser(2 * taps + 1, 5.0)).tolist() for k in range(1, factor)]


def between(x: np.ndarray, factor: int, taps: int = 12, weights: np.ndarray | None = None) -> np.ndarray:
    """The series at ``factor`` times its rate; samples stay as they are. All places between two samples are one product of matrices;
    ``weights`` are the interpolators, which need not be worked out for each of many series."""
    weights = np.array(interpolators(factor, taps)) if weights is None else weights
    padded = np.concatenate([np.zeros(taps), x, np.zeros(taps)])
    out = np.empty((len(x), factor))
    out[:, 0] = x
    # A stretch at a time, so that a long series makes no matrix of its own.
    for lo in range(0, len(x), 1 << 14):
        near = np.lib.stride_tricks.sliding_window_view(padded[lo : lo + (1 << 14) + 2 * taps], 2 * taps + 1)
        out[lo : lo + (1 << 14), 1:] = near @ weights.T
    return out.ravel()


def oversampled_peak(x: np.ndarray, factor: int = 4, taps: int = 12, weights: np.ndarray | None = None) -> float:
    """Largest magnitude between samples. Runs of samples that cannot reach the best one so far, by the sum of the weights' magnitudes, are not interpolated."""
    best = float(np.abs(x).max(initial=0.0))
    if not len(x):
        return best
    weights = np.array(interpolators(factor, taps)) if weights is None else weights
    bound = np.abs(weights).sum(axis=1).max()
    near = np.lib.stride_tricks.sliding_window_view(np.pad(np.abs(x), taps), 2 * taps + 1).max(axis=1)
    if (near * bound <= best).all():
        return best
    return max(best, float(np.abs(between(x, factor, taps, weights)).max(initial=0.0)))


def true_peak(df: DataFrame, key: str, order: str, value: str, ceiling: float) -> DataFrame:
    """Sample peak, peaks between samples at 4 and 16 times the rate, and how many runs at 4 times the rate lie over a ceiling."""
    by_4, by_16 = (np.array(interpolators(f)) for f in (4, 16))

    def kernel(v):
        four = np.abs(between(v, 4, weights=by_4))
        over = four > ceiling
        runs = int(over[:1].sum() + (over[1:] & ~over[:-1]).sum())
        return {"true_peak": np.array([round(float(four.max(initial=0.0)), 6)]), "true_peak_16": np.array([round(oversampled_peak(v, 16, weights=by_16), 6)]), "sample_peak": np.array([float(np.abs(v).max(initial=0.0))]), "over_runs": np.array([runs])}

    return _per_row(_ordered(df, key, order, value), key, kernel, f"{key} long, true_peak double, true_peak_16 double, sample_peak double, over_runs long")


def band_pass(x: np.ndarray, low: float, high: float, rate: float) -> np.ndarray:
    """A series between two frequencies, without delay: Butterworth stages forwards and then backwards. Before its start the series is silent."""
    for _ in range(2):
        for kind, corner in (("high pass", low), ("low pass", high)):
            b, a = second_order(kind, corner, math.sqrt(0.5), rate)
            y, x1, x2, y1, y2 = np.empty(len(x)), 0.0, 0.0, 0.0, 0.0
            for i, v in enumerate(x.tolist()):
                y[i] = out = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
                x1, x2, y1, y2 = v, x1, out, y1
            x = y
        x = x[::-1]
    return x


def band_passed(df: DataFrame, key: str, order: str, value: str, low: float, high: float, rate: float) -> DataFrame:
    """(key, at, value) of each series between two frequencies."""
    def kernel(v):
        return {"at": np.arange(len(v), dtype=np.int64), "value": np.round(band_pass(v, low, high, rate), 4)}

    return _per_row(_ordered(df, key, order, value), key, kernel, f"{key} long, at long, value double")
