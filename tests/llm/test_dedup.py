"""Exact dedup and the n-gram join against plain versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hourloom.llm import exact_dedup as E
from hourloom.llm import ngram_join as N
from hourloom.llm.components import components

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def groups_of(rows):
    """Expected (doc_id, keep_id, group_size, kept) of (doc_id, text) rows."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = Counter()
    for body, g in groups.items():
        best = min(g, key=lambda x: x[:3])
        for k, x in enumerate(sorted(g, key=lambda x: x[:3])):
            out[(x[3], best[3], len(g), k == 0, hashlib.sha256(body.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 16}, {"block_bytes": 64, "hash_block": lambda b: F.pmod(F.xxhash64(b), F.lit(3))}])
def test_exact_dedup_equals_grouping(odd, options):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.exact_dedup(odd, **options).collect())
    assert got == groups_of([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


def test_exact_dedup_of_nothing(nothing):
    assert E.exact_dedup(nothing).count() == 0


def components_of(rows, words=5):
    """Expected component of each row by comparing all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= 75 * (len(a) + len(sets[j]) - shared):
                up[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    return Counter((d, len(sets[i]), min(ids[root(i)], default=None)) for i, (d, _) in enumerate(rows))


def near_rows():
    """A hub with many near copies, of which some pairs are linked only over others."""
    words = [f"w{i}" for i in range(120)]
    rows = [(1000, " ".join(words))]
    for k in range(60):
        w = list(words)
        for m in range(1 + k % 4):
            w[(17 * k + 31 * m) % 120] = f"x{k}-{m}"
        rows.append((k, " ".join(w)))
    return rows + [(2000 + k, " ".join(words[: 5 + k])) for k in range(8)]


@pytest.mark.parametrize("options", [{}, {"frequent": 2, "block": 7}, {"part_bytes": 0, "parts": 3}, {"frequent": 10**9}])
def test_near_copies_equal_all_pairs(spark, options):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(docs, **options).collect())
    assert got == components_of(rows)


def test_whole_sets_across_blocks_are_of_open_units_only(spark, monkeypatch):
    """op3: a second comparison, across blocks, makes sets of the rows of units that are still open, not of all families again."""
    wanted, real = [], N._sets

    def spied(rows, m, words, make):
        if make is not N.bit_field:
            wanted.append(m.select("k").distinct().count())
        return real(rows, m, words, make)

    monkeypatch.setattr(N, "_sets", spied)
    near = near_rows()
    pairs = [(5000 + 2 * k + j, " ".join([f"p{k}-{i}" for i in range(40)] + ["end"] * j)) for k in range(40) for j in range(2)]
    docs = spark.createDataFrame(near + pairs, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(docs, block=7).collect())
    assert got == components_of(near + pairs)
    assert len(wanted) == 2 and wanted[0] >= 80 + wanted[1] > 80


def test_odd_rows_equal_all_pairs(odd, nothing):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(odd).collect())
    assert got == components_of([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert N.jaccard_components(nothing).count() == 0


def test_documents_equal_all_pairs(documents, texts):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(documents, frequent=4, block=4).collect())
    assert got == components_of(list(texts.items()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(900, 901)], "a long, b long"))
    got = {r.v: r.label for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 900: 900, 901: 900}
