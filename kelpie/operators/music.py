"""Musical sequence operators: keys, state paths, notes, grouping with constraints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Key profiles of major and minor.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)

#: Tones of chord qualities and what follows the root's name.
QUALITIES = (
    ((0, 4, 7), ""), ((0, 3, 7), "m"), ((0, 3, 6), "dim"), ((0, 4, 8), "aug"), ((0, 2, 7), "sus2"), ((0, 5, 7), "sus4"), ((0, 4, 7, 11), "maj7"),
    ((0, 3, 7, 10), "m7"), ((0, 4, 7, 10), "7"), ((0, 3, 7, 9), "m6"), ((0, 4, 7, 9), "6"), ((0, 3, 6, 10), "m7b5"), ((0, 3, 6, 9), "dim7"),
)


def _centred(profile: tuple[float, ...]) -> list[float]:
    """A profile less its mean, of length one."""
    mean = sum(profile) / len(profile)
    norm = sum((p - mean) ** 2 for p in profile) ** 0.5
    return [(p - mean) / norm for p in profile]


def key_of(df: DataFrame, chroma: str, margin: float = 0.05) -> DataFrame:
    """df with tonic, mode, r and confidence: the best of 24 rotated profiles, no row multiplied."""
    tries = []
    for mode, profile in (("major", _centred(MAJOR)), ("minor", _centred(MINOR))):
        for k in range(12):
            turned = ", ".join(f"{profile[(i - k) % 12]!r}D" for i in range(12))
            r = f"aggregate(zip_with(`{chroma}`, array({turned}), (a, b) -> a * b), 0D, (s, v) -> s + v) / _spread"
            tries.append(f"named_struct('o', -round({r}, 9), 'mode', '{mode}', 'k', {k}, 'r', {r})")
    total = f"aggregate(`{chroma}`, 0D, (s, v) -> s + v)"
    square = f"aggregate(`{chroma}`, 0D, (s, v) -> s + v * v)"
    x = df.withColumn("_spread", F.expr(f"sqrt({square} - {total} * {total} / 12)")).filter("_spread > 0")
    x = x.withColumn("_t", F.expr(f"array_sort(array({', '.join(tries)}))"))
    best, second = F.get("_t", F.lit(0)), F.get("_t", F.lit(1))
    return x.select("*", best["k"].cast("int").alias("tonic"), best["mode"].alias("mode"), best["r"].alias("r"), F.when(best["r"] - second["r"] < margin, "low").otherwise("high").alias("confidence")).drop("_t", "_spread")


def chords_of(df: DataFrame, chroma: str, templates: list[tuple[str, list[float], int]], cost: float, least: float) -> DataFrame:
    """df with chord and score: the template of most correlation, less ``cost`` for each tone beyond three; N under ``least``. Rows of even energy are left out."""

    def run(batches):
        names = np.array([n for n, _, _ in templates])
        w = np.array([t for _, t, _ in templates])
        w = w / np.linalg.norm(w, axis=1, keepdims=True)
        extra = np.array([e for _, _, e in templates])
        alphabetical = np.argsort(names, kind="stable")
        for batch in batches:
            x = np.array(batch.column(chroma).to_pylist(), float).reshape(-1, 12)
            x = x - x.mean(1, keepdims=True)
            norm = np.linalg.norm(x, axis=1)
            ok = norm > 1e-12
            score = (x[ok] / norm[ok, None]) @ w.T - cost * extra
            best = alphabetical[np.argmax(np.round(score, 9)[:, alphabetical], axis=1)] if len(score) else np.zeros(0, int)
            top = score[np.arange(len(best)), best]
            kept = [batch.column(i).filter(pa.array(ok)) for i, n in enumerate(batch.schema.names) if n != chroma]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.where(top >= least, names[best], "N").tolist(), pa.string()), pa.array(top)], names=[*[n for n in batch.schema.names if n != chroma], "chord", "score"])

    others = [f for f in df.schema.fields if f.name != chroma]
    return df.mapInArrow(run, T.StructType([*others, T.StructField("chord", T.StringType()), T.StructField("score", T.DoubleType())]))


def smooth_paths(scores: list[np.ndarray], stay: float) -> list[np.ndarray]:
    """For each series of log scores (time x states): the states of most total score, where keeping a state has probability ``stay`` and every change the
    same one; of equal ones, the change is not made.

    All series advance together. What is kept of an instant is a bit for each state (whether coming from the best state before beats keeping this one) and
    that best state, so the way back needs no table of predecessors.
    """
    sizes = np.array([len(s) for s in scores])
    if not sizes.any():
        return [np.zeros(0, np.int64) for _ in scores]
    order = np.argsort(-sizes, kind="stable")
    longest, k = int(sizes.max()), scores[0].shape[1]
    grid = np.zeros((len(scores), longest, k))
    for row, i in enumerate(order):
        grid[row, : sizes[i]] = scores[i]
    alive = np.searchsorted(-sizes[order], -np.arange(longest), "left")  # series longer than t, which stand first
    change = np.log(1 - stay) - np.log(max(1, k - 1))
    total = grid[:, 0].copy()
    switch, leader = np.zeros((longest, len(scores), k), bool), np.zeros((longest, len(scores)), np.int64)
    for t in range(1, longest):
        n = alive[t]
        lead = total[:n].argmax(1)
        top = total[np.arange(n), lead] + change
        kept = total[:n] + np.log(stay)
        switch[t, :n], leader[t, :n] = top[:, None] > kept, lead
        total[:n] = np.maximum(top[:, None], kept) + grid[:n, t]
    at = total.argmax(1)
    paths = np.zeros((len(scores), longest), np.int64)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        paths[:n, t] = at[:n]
        if t:
            at[:n] = np.where(switch[t, np.arange(n), at[:n]], leader[t, :n], at[:n])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for row, i in enumerate(order):
        out[i] = paths[row, : sizes[i]]
    return out


def smoothed_states(df: DataFrame, key: str, order: str, state: str, stay: float = 0.86, gain: float = 2.0) -> DataFrame:
    """Runs (start, length, state) of the smoothed path over observed states; an observation favours its state by ``gain``. One batch of series at a time."""
    names = sorted(r[0] for r in df.select(state).distinct().collect())  # the states' vocabulary

    def run(batches):
        place = {x: i for i, x in enumerate(names)}
        for batch in batches:
            keys = batch.column("key").to_pylist()
            seen = [np.array([place[x] for x in s], np.int64) for s in batch.column("seen").to_pylist()]
            scores = [np.where(s[:, None] == np.arange(len(names))[None, :], gain, 0.0) for s in seen]
            rows: list[tuple] = []
            for k, path in zip(keys, smooth_paths(scores, stay), strict=True):
                cut = np.flatnonzero(np.diff(path, prepend=-1))
                rows += zip([k] * len(cut), cut.tolist(), np.diff(cut, append=len(path)).tolist(), [names[x] for x in path[cut].tolist()], strict=True)
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=["key", "start", "length", "state"])

    series = df.groupBy(F.col(key).cast("long").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(state).alias("s")))), lambda x: x["s"]).alias("seen"))
    return series.mapInArrow(run, "key long, start long, length long, state string").withColumnRenamed("key", key)


def notes_of(x: np.ndarray, split: float, least: int) -> list[tuple[int, int, float]]:
    """(start, length, level): a note ends when two values in a row leave a running reference by more than ``split``."""
    out, start, ref, off = [], 0, None, 0
    for i, v in enumerate(x):
        if ref is None:
            start, ref, off = i, v, 0
        elif abs(v - ref) > split:
            off += 1
            if off == 2:
                if i - 1 - start >= least:
                    out.append((start, i - 1 - start, float(np.median(x[start : i - 1]))))
                start, ref, off = i - 1, v, 0
        else:
            ref, off = 0.7 * ref + 0.3 * v, 0
    if ref is not None and len(x) - start >= least:
        out.append((start, len(x) - start, float(np.median(x[start:]))))
    return out


def segment_notes(df: DataFrame, key: str, order: str, value: str, split: float = 20.0, least: int = 2) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        got = notes_of(table.column(value).to_numpy(), split, least)
        return pa.table({key: pa.array([table.column(key)[0].as_py()] * len(got), pa.int64()), "start": pa.array([g[0] for g in got], pa.int64()), "length": pa.array([g[1] for g in got], pa.int64()), "level": pa.array([round(g[2], 6) for g in got], pa.float64())})

    return df.select(key, order, value).groupBy(key).applyInArrow(run, f"{key} long, start long, length long, level double")


def cluster_cannot_link(x: np.ndarray, flags: np.ndarray, stop: float = 0.8) -> np.ndarray:
    """Average-linkage labels on cosine distance; groups of different flags never merge; labels in order of first member.

    The mean distance of two groups is one less the product of their mean unit vectors, so a group is one vector and no matrix of distances is kept.
    Groups that are each other's nearest merge in one round: no merger brings a group nearer to one of them than the other is. A group whose nearest
    is ``stop`` or more away is finished.
    """
    label = np.arange(len(x))
    for flag in np.unique(flags):
        rows = np.flatnonzero(flags == flag)
        label[rows] = rows[_average_linkage(x[rows], stop)]
    _, first, names = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[names]


def _nearest_groups(mean: np.ndarray, ask: np.ndarray, live: np.ndarray, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(nearest of ``live``, distance) of each group of ``ask``, a bounded number of products at a time; of like ones the first."""
    near, least = np.zeros(len(ask), np.int64), np.full(len(ask), np.inf)
    step, among = max(1, cells // max(len(live), 1)), mean[live].T
    for lo in range(0, len(ask), step):
        d = 1 - mean[ask[lo : lo + step]] @ among
        d[ask[lo : lo + step][:, None] == live[None, :]] = np.inf
        at = d.argmin(axis=1)
        near[lo : lo + step], least[lo : lo + step] = live[at], d[np.arange(len(at)), at]
    return near, least


def _average_linkage(x: np.ndarray, stop: float) -> np.ndarray:
    """For each row the first row of its group."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    # Equal rows are at no distance and merge first; rows without a direction are at distance one from all.
    mean, first, label, size = np.unique(unit, axis=0, return_index=True, return_inverse=True, return_counts=True)
    zero = ~mean.any(axis=1)
    if zero.any() and stop <= 1:
        lone = zero[label.ravel()]
        out = np.arange(len(x))
        out[~lone] = np.flatnonzero(~lone)[_average_linkage(x[~lone], stop)]
        return out
    order = np.argsort(first)
    mean, first, size, label = mean[order], first[order], size[order].astype(float), np.argsort(order)[label.ravel()]
    parent, live = np.arange(len(mean)), np.arange(len(mean))
    near, least = _nearest_groups(mean, live, live) if len(live) > 1 else (live.copy(), np.full(len(live), np.inf))
    while len(live) > 1:
        live = live[least[live] < stop]
        if not len(live):
            break
        i = live[(near[near[live]] == live) & (live < near[live])]
        if not len(i):
            i = live[[np.argmin(least[live])]]  # like distances in a ring: the nearest pair
        a, b = np.minimum(i, near[i]), np.maximum(i, near[i])
        mean[a] = (size[a, None] * mean[a] + size[b, None] * mean[b]) / (size[a] + size[b])[:, None]
        size[a] += size[b]
        parent[b] = a
        gone, changed = np.zeros(len(mean), bool), np.zeros(len(mean), bool)
        gone[b], changed[a], changed[b] = True, True, True
        live = live[~gone[live]]
        if len(live) < 2:
            break
        again = live[changed[live] | changed[near[live]]]
        near[again], least[again] = _nearest_groups(mean, again, live)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return first[parent[label]]
