"""Whitening against a plain numpy version."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest

from hourloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, whitened string"


def plain(rows, components=16):
    """(vec_id, deviation, explained and whitened by component) of (vec_id, vector) rows; None where a component has no variance."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    real = e[order] > 1e-12 * e.max()
    white = q[:, order] / np.sqrt(np.where(real, e[order], 1))
    out = []
    for i, x in kept:
        x = np.array(x, dtype=object)
        y = ((x * n - sums) / n).astype(float) @ white
        out.append((i, int(((x * n - sums) ** 2).sum()), [s if r else 0.0 for s, r in zip(e[order] / np.trace(v), real)], [z if r else None for z, r in zip(y, real)]))
    return n, out


def compare(got, rows, components=16):
    n, expected = plain(rows, components)
    assert {r.n for r in got} == {n}
    k = len(expected[0][3])
    assert sorted(r.component for r in got) == sorted(list(range(1, k + 1)) * len(expected))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-6
    by = {}
    for r in got:
        by.setdefault((r.vec_id is None, r.vec_id or 0, r.deviation), {}).setdefault(r.component, []).append((r.whitened, r.explained))
    signs = {}
    for i, deviation, explained, y in expected:
        mine = by[(i is None, i or 0, deviation)]
        for c in range(k):
            for w, s in mine[c + 1]:
                assert s == pytest.approx(explained[c], rel=1e-6)
                if y[c] is None:
                    assert w is None
                elif abs(y[c]) > 1e-6:
                    sign = signs.setdefault(c, math.copysign(1, w * y[c]))
                    assert w == pytest.approx(sign * y[c], rel=1e-6, abs=1e-8)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "n", "w") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 7 * 8 * 5}, {"components": 3}])
def test_whitening_equals_numpy(spark, options):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(120, 7)) @ rng.normal(size=(7, 7))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    odd = [
        (900, None), (901, [1.0] * 6 + [None]), (902, [1.0] * 6 + [float("nan")]), (903, [float("inf")] + [0.0] * 6), (904, [-0.0] * 7),
        (None, [0.5] * 7), (5, rows[5][1]), (5, rows[5][1]), *[(1000 + k, rows[0][1]) for k in range(60)],
    ]
    compare(W.whiten(frame(spark, rows + odd), **options).collect(), rows + odd, options.get("components", 16))


def test_components_without_variance_are_null(spark):
    rows = [(i, [float(i % 3), 1.0, 2.0 * (i % 3)]) for i in range(9)]
    compare(W.whiten(frame(spark, rows)).collect(), rows)
    one = W.whiten(frame(spark, [(1, [0.25, 0.5]), (2, [0.25, 0.5])])).collect()
    assert sorted((r.vec_id, r.component, r.whitened, r.explained, r.deviation, r.identity_error) for r in one) == [
        (i, c, None, 0.0, 0, 0.0) for i in (1, 2) for c in (1, 2)]


def test_odd_tables(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(frame(spark, [(1, None), (2, [float("nan")])])).count() == 0
    assert W.whiten(frame(spark, [(1, []), (2, [])])).count() == 0
    # Vectors of another length than most are no vectors of this table; integers beyond a long don't exist.
    got = W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0]), (4, [1e30, 0.0])])).collect()
    assert {r.vec_id for r in got} == {1, 2}


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + 2**20 * i), float(i * i)]) for i in range(50)]
    n, expected = plain(rows)
    got = {r.vec_id: r.deviation for r in W.whiten(frame(spark, rows)).collect()}
    assert got == {i: d if d < 2**63 else None for i, d, _, _ in expected}


def test_the_given_vectors(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are absent")
    df = spark.read.parquet(path)
    compare(W.whiten(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])
