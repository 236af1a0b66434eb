"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are made for every document; the trees are fitted on a bounded sample of labelled documents and flattened
into arrays of feature, threshold and value, through which all rows of a batch go down together in numpy.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most about so many labelled documents are fitted on.
SAMPLE = 20_000
#: A score from which a document counts as good.
ACCEPT = 0.7
STATS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "letters", "upper", "digits", "spaces", "symbols", "top_symbol", "odd_words", "capital_words",
    "distinct_words", "top_word", "distinct_fives", "lines", "distinct_lines", "line_length", "short_lines", "packed", "sentence", "long_words", "non_ascii",
)


def statistics(text: str) -> list[float]:
    """Numbers about one whole text; an empty text has zeros."""
    if not text:
        return [0.0] * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    w = max(1, len(words))
    codes, counts, odd, capital, lengths = _coded(words)
    fives = 1.0
    if w > 5:
        mixed = codes[:-4].copy()
        for k in range(1, 5):
            mixed = mixed * 1_000_003 + codes[k : k + len(mixed)]
        mixed.sort()
        fives = (np.count_nonzero(mixed[1:] != mixed[:-1]) + 1) / len(mixed)
    lines = [x for x in text.split("\n") if x.strip()]
    letters, upper = int(seen[97:123].sum() + seen[65:91].sum()), int(seen[65:91].sum())
    marks = np.concatenate([seen[33:44], seen[45:46], seen[47:48], seen[58:65], seen[91:97], seen[123:127]])  # all but commas and full stops
    mean = float(lengths @ counts) / w
    return [
        math.log1p(n), math.log1p(len(words)), mean, math.sqrt(max(0.0, float(lengths**2 @ counts) / w - mean * mean)), letters / n, upper / max(1, letters),
        int(seen[48:58].sum()) / n, int(seen[9:14].sum() + seen[32]) / n, int(marks.sum()) / n, int(marks.max()) / n,
        float(odd @ counts) / w, float(capital @ counts) / w, len(counts) / w, int(counts.max(initial=0)) / w, fives,
        math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), w / max(1, len(lines)), sum(len(x) < 40 for x in lines) / max(1, len(lines)),
        len(zlib.compress(raw, 1)) / n, (int(seen[46]) + int(seen[33]) + int(seen[63])) / w, float((lengths > 20) @ counts) / w, int(seen[128:].sum()) / n,
    ]


def _coded(words: list[str]):
    """Each word's number; and of each distinct word: its count, whether it ends in an odd sign, whether it is in capitals, its length."""
    number: dict[str, int] = {}
    codes = np.fromiter([number.setdefault(x, len(number)) for x in words], np.int64, len(words))
    k = len(number)
    odd = np.fromiter([not (x[-1].isalnum() or x[-1] in ".,") for x in number], np.float64, k)
    capital = np.fromiter(map(str.isupper, number), np.float64, k)
    return codes, np.bincount(codes, minlength=k).astype(np.float64), odd, capital, np.fromiter(map(len, number), np.float64, k)


@dataclass
class Trees:
    """Complete binary trees of one depth. feature and threshold: (trees, inner nodes); value: (trees, leaves), in log odds."""

    start: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0, penalty: float = 2.0) -> Trees:
    """Boosted trees with logistic loss; each level is grown from histograms of gradients over quantile bins."""
    inner = 2**depth - 1
    shape = (trees, inner)
    if not len(y) or y.min() == y.max():
        level = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Trees(level, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    start = math.log(y.mean() / (1 - y.mean()))
    feature, threshold, value = np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros((trees, inner + 1))
    total = np.full(len(y), start)
    for k in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            cut = np.full(width, bins)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (at - first) * bins + binned[j]
                sg, sh = (np.bincount(cell, z, width * bins).reshape(width, bins).cumsum(1) for z in (g, h))
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + penalty) + (tg - sg) ** 2 / (th - sh + penalty) - tg**2 / (th + penalty)
                gain[(sh < least) | (th - sh < least)] = 0
                gain = gain[:, : len(e)]
                b = gain.argmax(1)
                better = gain[np.arange(width), b] > best
                best = np.where(better, gain[np.arange(width), b], best)
                cut = np.where(better, b, cut)
                feature[k, first : first + width][better] = j
                threshold[k, first : first + width][better] = e[b[better]]
            mine = feature[k, at]
            at = 2 * at + 1 + (binned[mine, np.arange(len(y))] > cut[at - first])
        leaf = at - inner
        value[k] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        total += value[k][leaf]
    return Trees(start, depth, feature, threshold, value)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Trees:
    """Trees fitted on about `sample` labelled documents, picked by a hash of their id, none of them held out.

    An id labelled both ways counts by the majority of its labels (a tie as 1). Null ids and labels are left out.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna().where(~held_out(F.col("_id")))
    marked = marked.groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    n = marked.count()
    share = F.pmod(F.xxhash64("_id"), F.lit(2**40)) < int(2**40 * min(1.0, sample / max(1, n)))
    picked = marked.where(share)  # about `sample` rows
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "_id")

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "_y": b["_y"], "x": [statistics(t or "") for t in b["text"]]})

    found = rows.mapInPandas(stats, "_id long, _y int, x array<double>").toPandas()
    found = found.assign(k=found["x"].map(tuple)).sort_values(["_id", "k"]).drop_duplicates(["_id", "k"])
    return fit(np.array(found["x"].tolist(), float).reshape(-1, len(STATS)), found["_y"].to_numpy(float), **options)


def score(docs: DataFrame, model: Trees, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with one more column, a score from 0 to 1 made of the whole text alone; null counts as empty. A clashing column is replaced."""
    kept = [c for c in docs.columns if c != score_col]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(score_col, T.DoubleType())])
    at = kept.index(text_col)

    def scored(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array([statistics(t or "") for t in b.column(at).to_pylist()], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], names=[*b.schema.names, score_col])

    return docs.select(*kept).mapInArrow(scored, schema)
