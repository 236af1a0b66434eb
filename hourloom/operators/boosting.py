"""Boosted regression trees on one small table: the fit inside one (series, lead) group.

A tree grows level by level from sums per node, input and bin of the input's values. Squared error gives the splits and
leaf values, absolute error on the held-out rows the number of rounds. Trees are rows of arrays in heap order: the children of slot k are
2k + 1 and 2k + 2, and a slot without a feature is a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rows of the fits that grow side by side: enough to spread the cost of a call, few enough not to outgrow a core's share of the cache.
AT_A_TIME = 16_000


@dataclass
class Ensemble:
    """base + sum of the trees' leaf values; `rounds` trees are kept."""

    base: float
    feature: np.ndarray  # rounds x slots, -1 in a leaf
    threshold: np.ndarray  # at most this value: left
    missing_left: np.ndarray  # where a missing value goes
    value: np.ndarray
    gain: np.ndarray  # per input, over the kept trees

    @property
    def rounds(self) -> int:
        return len(self.feature)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.rounds:
            return np.full(len(x), self.base)
        return self.base + self.value.ravel().take(self._leaves(x)).sum(axis=1)

    def _leaves(self, x: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf that each row reaches, by its place among the slots of all trees."""
        feature, threshold, missing_left = (a.ravel() for a in (self.feature, self.threshold, self.missing_left))
        root, flat = np.arange(self.rounds) * self.feature.shape[1], np.ravel(x)
        row, at = np.arange(len(x))[:, None] * x.shape[1], np.tile(root, (len(x), 1))
        while True:
            f = feature.take(at)
            inner = f >= 0
            if not inner.any():
                return at
            seen = flat.take(row + np.maximum(f, 0))
            left, gone = seen <= threshold.take(at), np.isnan(seen)
            if gone.any():
                left = np.where(gone, missing_left.take(at), left)
            at = np.where(inner, 2 * at - root + 2 - left, at)


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 rising values between which a column's known values fall; midpoints of neighbouring ones."""
    known = np.unique(column[~np.isnan(column)])
    if len(known) > bins:
        known = np.unique(np.quantile(column[~np.isnan(column)], np.linspace(0, 1, bins), method="nearest"))
    return known[:-1] + np.diff(known) / 2


def _sums(rank: np.ndarray, base: np.ndarray, target: np.ndarray, nodes: int, cells: int):
    """nodes x cells: sum of the target, and number of rows."""
    at = (rank[:, None] * cells + base).ravel()
    return (
        np.bincount(at, np.repeat(target, base.shape[1]), nodes * cells).reshape(nodes, cells),
        np.bincount(at, minlength=nodes * cells).reshape(nodes, cells).astype(float),
    )


class _Layout:
    """Where the cells of an input lie in a node's row of sums: one for each bin that holds values, and a last one for missing values.

    Inputs of few values, like those of the calendar, have few cells, and aren't scanned over bins that are always empty.
    """

    #: Inputs of at most so many bins are kept apart from the others.
    FEW = 16

    def __init__(self, used: np.ndarray, bins: int):
        self.bins, self.inputs, self.cells, self.groups = bins, len(used), 0, []
        self.start, self.last = np.zeros(len(used), dtype=np.int64), np.zeros(len(used), dtype=np.int64)
        for members in (np.flatnonzero(used <= self.FEW), np.flatnonzero(used > self.FEW)):
            if len(members):
                width = int(used[members].max()) + 1
                self.start[members] = self.cells + np.arange(len(members)) * width
                self.last[members] = self.start[members] + width - 1
                self.groups.append((members, slice(self.cells, self.cells + len(members) * width), (-1, len(members), width)))
                self.cells += len(members) * width
        order = np.argsort(self.start)
        self.missing = np.repeat(self.last[order], (self.last - self.start + 1)[order])  # of each cell's input
        # An input's cells as bins + 1 columns, the last one repeated.
        self.columns = np.minimum(self.start[:, None] + np.arange(bins + 1), self.last[:, None])

    def place(self, binned: np.ndarray) -> np.ndarray:
        return np.minimum(self.start + binned, self.last)

    def totals(self, rows: np.ndarray) -> np.ndarray:
        """nodes x 1: what the first input's cells add up to."""
        out, at, end = np.zeros((len(rows), self.bins + 1)), self.start[0], self.last[0]
        out[:, : end - at], out[:, -1] = rows[:, at:end], rows[:, end]
        return out.sum(axis=1)[:, None]

    def running(self, rows: np.ndarray) -> np.ndarray:
        """Sums up to each cell of an input."""
        out = np.empty_like(rows)
        for _, part, shape in self.groups:
            out[:, part] = np.cumsum(rows[:, part].reshape(shape), axis=2).reshape(len(rows), -1)
        return out

    def greatest(self, rows: np.ndarray) -> np.ndarray:
        """nodes x inputs: the greatest cell."""
        out = np.empty((len(rows), self.inputs))
        for members, part, shape in self.groups:
            out[:, members] = rows[:, part].reshape(shape).max(axis=2)
        return out


def _best_splits(sums: np.ndarray, counts: np.ndarray, columns: np.ndarray, least: int, layout: _Layout):
    """Per node: (gain, input, last bin that goes left, whether missing values go left).

    `columns` holds the inputs that each node may use.
    """
    each = np.arange(len(sums))
    total, n = layout.totals(sums), layout.totals(counts)
    before = total**2 / n
    left, left_n = layout.running(sums), layout.running(counts)  # with an input's last cell, all rows are left: no split

    def gains(s, c):
        g, rest, other = s * s, n - c, total - s
        with np.errstate(divide="ignore", invalid="ignore"):
            g /= c
            other *= other
            other /= rest
        g += other
        g -= before
        np.copyto(g, 0.0, where=np.minimum(c, rest, out=rest) < least)
        return g

    def best(g):
        top = np.where(columns, layout.greatest(g), 0.0)
        feature = top.argmax(axis=1)
        return top[each, feature], feature, g[each[:, None], layout.columns[feature]].argmax(axis=1)

    gain, feature, cut = best(gains(left, left_n))
    # No missing value seen: it would go with the larger side.
    to_left = 2 * left_n[each, layout.start[feature] + cut] >= n[:, 0]
    if counts[:, layout.last].any():
        seen = counts[each, layout.last[feature]] > 0
        to_left &= ~seen
        gone, gone_n = (a.take(layout.missing, axis=1) for a in (sums, counts))
        other, f, c = best(np.where(gone_n > 0, gains(left + gone, left_n + gone_n), 0.0))
        better = other > gain
        gain, feature, cut = np.where(better, other, gain), np.where(better, f, feature), np.where(better, c, cut)
        to_left = np.where(better, True, to_left)
    return gain, feature, cut, to_left


class _Draws:
    """Inputs and rows that each round learns from. They depend on the seed and the number of rows alone, so fits of as many rows share them."""

    def __init__(self, n: int, p: int, settings: dict):
        self.rng, self.n, self.p, self.made = np.random.default_rng(settings["seed"]), n, p, []
        self.rows = max(1, int(round(n * settings["subsamplingRate"])))
        self.columns = max(1, int(round(p * float(settings["featureSubsetStrategy"]))))

    def __getitem__(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        while number >= len(self.made):
            columns = np.zeros(self.p, dtype=bool)
            columns[self.rng.permutation(self.p)[: self.columns]] = True
            self.made.append((columns, np.sort(self.rng.permutation(self.n)[: self.rows]).astype(np.int32)))
        return self.made[number]


class _Fit:
    """One fit on its way: rows as bins, what is predicted so far, and the trees."""

    def __init__(self, place: int, x: np.ndarray, y: np.ndarray, n_valid: int, settings: dict):
        self.place, self.y, self.n = place, y, len(y) - n_valid
        known, missing = x[: self.n], settings["bins"]
        edges = [_cuts(c, settings["bins"]) for c in known.T]
        self.binned = np.stack([np.where(np.isnan(c), missing, np.searchsorted(e, c)) for c, e in zip(x.T, edges)], axis=1)
        self.used = np.array([len(e) + 1 for e in edges])
        self.cuts = np.full((x.shape[1], missing + 1), np.inf)
        for k, e in enumerate(edges):
            self.cuts[k, : len(e)] = e
        self.base = float(y[: self.n].mean())
        self.now = np.full(len(y), self.base)
        self.trees, self.gains, self.best, self.least_error = [], [], 0, np.inf

    def ended(self, off: np.ndarray, settings: dict) -> bool:
        """After a round that left its rows `off` their targets: note the error on the held-out ones, and whether it was the last one."""
        number = len(self.trees)
        if self.n == len(self.y):
            self.best = number
        else:
            error = float(np.add.reduce(off[self.n :]) / (len(self.y) - self.n))
            if error < self.least_error:
                self.best, self.least_error = number, error
            elif number - self.best >= settings["patience"]:
                return True
        return number >= settings["maxIter"]

    def ensemble(self) -> Ensemble:
        kept = self.trees[: self.best]
        return Ensemble(self.base, *(np.stack(a) for a in zip(*kept)), np.sum(self.gains[: self.best], axis=0))


class _Batch:
    """Fits that grow their trees side by side, a round at a time: nodes of all fits are one axis of the sums.

    A fit's trees are those that it would grow alone, for its sums add up its own rows in their own order.
    """

    def __init__(self, fits: list[_Fit], settings: dict):
        self.fits, self.settings = fits, settings
        self.binned = np.concatenate([f.binned for f in fits])
        self.bins, self.inputs = settings["bins"] + 1, self.binned.shape[1]
        self.layout = _Layout(np.max([f.used for f in fits], axis=0), settings["bins"])
        self.at = self.layout.place(self.binned)
        self.flat, self.row = self.binned.ravel(), np.arange(len(self.binned)) * self.inputs
        self.cuts = np.stack([f.cuts for f in fits])
        self.y, self.now = (np.concatenate([getattr(f, c) for f in fits]) for c in ("y", "now"))
        sizes = [len(f.y) for f in fits]
        self.begin = np.cumsum([0, *sizes])
        self.owner = np.repeat(np.arange(len(fits)), sizes)
        for i, f in enumerate(fits):  # what a fit predicts lies in the batch's array
            f.now = self.now[self.begin[i] : self.begin[i + 1]]

    def round(self, draws: dict[int, _Draws]) -> list[bool]:
        """Grow a tree of each fit; which fits have ended."""
        depth, least = self.settings["maxDepth"], self.settings["minInstancesPerNode"]
        n_fits, slots = len(self.fits), 2 ** (depth + 1) - 1
        drawn = [draws[f.n][len(f.trees)] for f in self.fits]
        columns = np.stack([c for c, _ in drawn])
        learnt = np.concatenate([r + b for (_, r), b in zip(drawn, self.begin)])
        ends = np.cumsum([0, *(len(r) for _, r in drawn)])
        target = (self.y - self.now).take(learnt)
        parts = [target[a:b] for a, b in zip(ends, ends[1:])]
        noise = np.array([1e-12 * float(t @ t) for t in parts])
        feature, threshold = np.full(n_fits * slots, -1, dtype=np.int16), np.zeros(n_fits * slots)
        missing_left, value, gain = np.zeros(n_fits * slots, dtype=bool), np.zeros(n_fits * slots), np.zeros(n_fits * self.inputs)
        place = self.owner * slots  # the slot that each row is in, held-out and not drawn ones as well
        here = place.take(learnt)
        nodes = np.arange(n_fits) * slots
        value[nodes] = [np.add.reduce(t) / len(t) for t in parts]
        base, rows = self.at.take(learnt, axis=0), np.arange(len(place))
        for _ in range(depth):
            rank_of = np.full(n_fits * slots, -1)
            rank_of[nodes] = np.arange(len(nodes))
            rank = rank_of.take(here)
            inside = np.flatnonzero(rank >= 0)
            if len(inside) < len(rank):
                learnt, target, rank, base = learnt.take(inside), target.take(inside), rank.take(inside), base.take(inside, axis=0)
            owner = nodes // slots
            sums, counts = _sums(rank, base, target, len(nodes), self.layout.cells)
            won, f, cut, to_left = _best_splits(sums, counts, columns[owner], least, self.layout)
            split = won > noise[owner]
            if not split.any():
                break
            at = nodes[split]
            feature[at], threshold[at], missing_left[at] = f[split], self.cuts[owner[split], f[split], cut[split]], to_left[split]
            gain += np.bincount(owner[split] * self.inputs + f[split], won[split], len(gain))

            rank_of[nodes[~split]] = -1
            rank = rank_of.take(place.take(rows))
            inside = np.flatnonzero(rank >= 0)
            rows, rank = rows.take(inside), rank.take(inside)
            inner = nodes % slots
            right = nodes + inner + 2
            goes_left = np.arange(self.bins) <= cut[:, None]
            goes_left[:, -1] = to_left
            seen = self.flat.take(self.row.take(rows) + f.take(rank))
            place[rows] = right.take(rank) - goes_left.ravel().take(rank * self.bins + seen)
            here = place.take(learnt)
            number = np.bincount(here, minlength=len(value))
            total = np.bincount(here, target, len(value))
            fresh = np.zeros(len(value), dtype=bool)
            fresh[right[split] - 1] = fresh[right[split]] = True
            children = np.flatnonzero(fresh & (number > 0))
            value[children] = total[children] / number[children]
            nodes = children[number[children] >= 2 * least]
            if not len(nodes):
                break
        value *= self.settings["stepSize"]
        self.now += value.take(place)
        off = np.abs(self.y - self.now)
        whole = [a.reshape(n_fits, slots) for a in (feature, threshold, missing_left, value)]
        gain = gain.reshape(n_fits, -1)
        for i, f in enumerate(self.fits):
            f.trees.append(tuple(a[i] for a in whole))
            f.gains.append(gain[i])
        return [f.ended(off[a:b], self.settings) for f, a, b in zip(self.fits, self.begin, self.begin[1:])]


def fit_many(tables, settings: dict) -> list[Ensemble]:
    """An Ensemble per (x, y, n_valid) of `tables`: boosted on all rows but the last n_valid, with the rounds up to the least
    absolute error on those kept. Fitting ends when `patience` rounds bring no lower error, or after maxIter rounds; without
    held-out rows all are kept.

    As many fits as have AT_A_TIME rows run side by side; where one ends, others take its place.
    """
    tables = list(tables)
    # Fits of as many rows follow each other, so that few draws are kept at a time.
    waiting = sorted(range(len(tables)), key=lambda i: len(tables[i][1]) - tables[i][2], reverse=True)
    draws, made, live, batch = {}, [None] * len(tables), [], None
    while waiting or live:
        if sum(len(f.y) for f in live) <= AT_A_TIME // 2:
            while waiting and (not live or sum(len(f.y) for f in live) + len(tables[waiting[-1]][1]) <= AT_A_TIME):
                i = waiting.pop()
                live.append(_Fit(i, *tables[i], settings))
                batch = None
            draws = {f.n: draws.get(f.n) or _Draws(f.n, f.binned.shape[1], settings) for f in live}
        batch = batch or _Batch(live, settings)
        ended = batch.round(draws)
        if any(ended):
            for f in (f for f, e in zip(live, ended) if e):
                made[f.place] = f.ensemble()
            live, batch = [f for f, e in zip(live, ended) if not e], None
    return made


def fit(x: np.ndarray, y: np.ndarray, n_valid: int, settings: dict) -> Ensemble:
    """fit_many() of one table."""
    return fit_many([(x, y, n_valid)], settings)[0]
