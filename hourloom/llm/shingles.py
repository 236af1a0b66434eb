"""Shingle sets of a batch of texts in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from hourloom.llm.words import split_words

# Odd 64-bit constants of common mixing functions.
MULTIPLY, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits stirred."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the distinct 64-bit hashes of its lower-cased shingles in order; fewer words than a shingle has count as one."""
    ends, codes, distinct = split_words(texts, lower=True)
    of_word = pd.util.hash_array(np.array(distinct.to_pylist(), object), categorize=False) if len(distinct) else np.zeros(0, np.uint64)
    h = of_word[codes]
    many = h[: max(0, len(h) - words + 1)].copy()
    for k in range(1, words):
        many = many * MULTIPLY + h[k : k + len(many)]
    many = mixed(many)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= words:
            out.append(np.unique(many[a : b - words + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = (one ^ h[k]) * MIX_2 + MULTIPLY
            out.append(mixed(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums a set: sets with equal sizes and sums are taken as equal."""
    return np.array([(s.sum(dtype=np.uint64), mixed(s ^ MULTIPLY).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
