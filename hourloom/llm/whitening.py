"""Embedding whitening with MLlib block matrices.

Rows become exact integers first: x = floor(64 * entry) + 1000000. The fit list holds each distinct x vector once: one
row of each group of equal vectors is marked. Rows are centred exactly, (n * x - S) / n with integer n and S, and packed,
in the task that reads them, into dense blocks of at most BLOCK_BYTES; no shuffle. Then

* the marked rows' blocks, stacked as one tall BlockMatrix F, give the scatter F' * F. Row blocks are dealt over as many
  middle splits as there are groups of SPLIT_BLOCKS blocks, and a split leaves one d x d sum.
* eigh of the d x d covariance runs on the driver: d is the length of a vector, whatever the number of rows.
* all rows' blocks, laid out in a grid (reading task, block of the task), times a block-diagonal matrix that repeats the
  d x k whitening matrix for each column of the grid give every row's components. MLlib deals such a product over both
  sides of the grid, so a task has a bounded share; one tall column would go to only as many tasks as the square root.

Blocks may have fewer rows than the rest: a product only needs their columns to agree. MLlib lists the blocks' positions,
16 bytes each, in the driver: 2 MB blocks make 0.5 million positions a terabyte of doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm import common as C

# How an entry becomes an integer.
SCALE, SHIFT = 64, 1_000_000
BLOCK_BYTES = 2 << 20
SPLIT_BLOCKS = 16
#: A component whose eigenvalue is below this share of the largest has no variance beyond rounding.
FLAT = 1e-12

_MATRIX = pa.struct([
    ("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
    ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_()),
])
_BLOCKS = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("about", T.ArrayType(T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("fit", T.BooleanType())]))),
    T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("fit", T.ArrayType(T.DoubleType())), T.StructField("n_fit", T.IntegerType()),
])
_AT = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType())])
_PLACED = T.StructType([T.StructField("at", _AT), T.StructField("m", MatrixUDT())])


def integer_rows(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_row (unique), vec_id, x of the rows with a usable vector.

    Left out: null vectors, vectors with a null or non-finite entry or one whose integer is beyond a long, and vectors
    of another length than most usable rows have (of equally frequent lengths the longest counts).
    """
    limit = float(2**62)
    entries = F.transform(F.col(vector_col), lambda e: F.floor(e.cast("double") * SCALE))
    usable = F.col(vector_col).isNotNull() & F.forall(
        F.col(vector_col), lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double") * SCALE) < limit), F.lit(False)))
    kept = embeddings.where(usable).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(entries, lambda e: e.cast("long") + SHIFT).alias("x"))
    rows = C.stage(kept.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    width = (sizes.first() or (0,))[0]
    return rows.where(F.size("x") == width)


def mark_distinct(rows: DataFrame) -> DataFrame:
    """Adds `fit`: true for one row of each group of equal x. Copies are reduced to one before they are shuffled."""
    first = rows.groupBy("x").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("fit"))
    return rows.join(first, "_row", "left").withColumn("fit", F.coalesce("fit", F.lit(False)))


def _packed(width: int, n: int, sums: list[int], block_rows: int):
    """A function for mapInArrow: rows -> centred row-major blocks, numbered within their task."""
    big = max(abs(s) for s in sums) * 2 + n * SHIFT * 4 > 2**62  # then the exact differences need Python's integers

    def centred(x: np.ndarray) -> np.ndarray:
        wide = x.astype(object) if big else x
        return np.asarray((wide * n - np.array(sums, dtype=object if big else np.int64)) / n, dtype=np.float64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, count = TaskContext.get().partitionId(), 0, [], 0

        def block(b: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            x = b["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            values, fit = centred(x), b["fit"].to_numpy()
            about = pa.StructArray.from_arrays([b[c].combine_chunks() for c in ("vec_id", "deviation", "fit")], names=["vec_id", "deviation", "fit"])
            seq += 1
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([seq - 1], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), about),
                pa.array([values.ravel()], pa.list_(pa.float64())), pa.array([values[fit].ravel()], pa.list_(pa.float64())),
                pa.array([int(fit.sum())], pa.int32())], names=_BLOCKS.names)

        for b in batches:
            held.append(b)
            count += len(b)
            while count >= block_rows:
                table = pa.Table.from_batches(held).combine_chunks()
                yield block(table.slice(0, block_rows).combine_chunks())
                held, count = table.slice(block_rows).to_batches(), count - block_rows
        if count:
            yield block(pa.Table.from_batches(held).combine_chunks())

    return pack


def _matrix(placed: DataFrame, width: int, rows_per_block: int, cols_per_block: int, rows: int, cols: int):
    """MLlib's BlockMatrix of (i, j, values row by row): values are read as matrices of `width` columns."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b["values"].value_lengths().to_numpy()
            flat = b["values"].flatten()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for k in range(len(b)):  # one block at a time, for memory's sake
                values = pa.ListArray.from_arrays(pa.array([0, sizes[k]], pa.int32()), flat.slice(ends[k], sizes[k]))
                none = pa.nulls(1, pa.list_(pa.int32()))
                m = pa.StructArray.from_arrays([
                    pa.array([1], pa.int8()), pa.array([sizes[k] // width], pa.int32()), pa.array([width], pa.int32()), none, none,
                    values, pa.array([True])], fields=list(_MATRIX))
                at = pa.StructArray.from_arrays([b["i"].slice(k, 1), b["j"].slice(k, 1)], names=["i", "j"])
                yield pa.RecordBatch.from_arrays([at, m], names=["at", "m"])

    return callMLlibFunc("createBlockMatrix", placed.select("i", "j", "values").mapInArrow(place, _PLACED), rows_per_block, cols_per_block, rows, cols)


def scatter(blocks: DataFrame, width: int, block_rows: int, per_part: int, parts: int, n_blocks: int) -> np.ndarray:
    """Sum over the marked rows of row' * row, by transpose-multiply."""
    tall = blocks.where("n_fit > 0").select((F.col("part") * per_part + F.col("seq")).alias("i"), F.lit(0).cast("long").alias("j"), F.col("fit").alias("values"))
    matrix = _matrix(tall, width, block_rows, width, parts * per_part * block_rows, width)
    product = matrix.transpose().multiply(matrix, max(1, n_blocks // SPLIT_BLOCKS))
    return np.array(product.toLocalMatrix().toArray()).reshape(width, width).T  # both ways alike: it is symmetric


def whitening_matrix(scattered: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d x k whitening matrix, explained shares, which components have variance): unit eigenvectors by falling eigenvalue."""
    values, vectors = np.linalg.eigh((scattered + scattered.T) / (2 * n))
    order = np.argsort(-values, kind="stable")[:components]
    e, total = values[order], float(np.trace(scattered)) / n
    real = e > FLAT * max(float(values.max(initial=0.0)), 0.0)
    real &= e > 0
    scale = np.where(real, 1 / np.sqrt(np.where(real, e, 1.0)), 0.0)
    return vectors[:, order] * scale, np.where(real, e / total if total > 0 else 0.0, 0.0), real


def project(blocks: DataFrame, whitening: np.ndarray, block_rows: int, per_part: int, parts: int) -> DataFrame:
    """(i, j, values): each block's rows times the whitening matrix, row by row."""
    width, k = whitening.shape
    spark = blocks.sparkSession
    grid = blocks.select(F.col("part").alias("i"), F.col("seq").alias("j"), "values")
    left = _matrix(grid, width, block_rows, width, parts * block_rows, per_part * width)
    flat = F.array(*[F.lit(float(v)) for v in whitening.ravel()])
    diagonal = spark.range(per_part).select(F.col("id").alias("i"), F.col("id").alias("j"), flat.alias("values"))
    right = _matrix(diagonal, k, width, k, per_part * width, per_part * k)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in zip(b.column(0).to_pylist(), b.column(1)):
                i, j = at.values()
                values = np.asarray(m["values"].values, dtype=np.float64)
                rows, cols = m["numRows"].as_py(), m["numCols"].as_py()
                by_row = values.reshape(rows, cols) if m["isTransposed"].as_py() else values.reshape(cols, rows).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([j], pa.int64()), pa.array([np.ascontiguousarray(by_row).ravel()], pa.list_(pa.float64()))],
                    names=["i", "j", "values"])

    return callMLlibFunc("getMatrixBlocks", left.multiply(right)).mapInArrow(unpack, "i long, j long, values array<double>")


def _covariance(made: DataFrame, k: int, n: int) -> np.ndarray:
    """Covariance of the marked rows' components: each batch sums, k * k + k numbers a batch."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b["y"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total = np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["c", "v"])

    got = made.where("fit").select("y").mapInArrow(sums, "c long, v double").groupBy("c").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(k * k + k)
    v[[r.c for r in got]] = [r.v for r in got]
    mean = v[k * k :] / n
    return v[: k * k].reshape(k, k) / n - np.outer(mean, mean)


def _exact_square(x: Column, n: int, sums: list[int]) -> Column:
    """Sum over dimensions of (n * x - S)^2 as a long; null where a long cannot hold it."""
    wide = "decimal(38,0)"
    total = F.lit(0).cast(wide)
    spread = F.zip_with(x, F.array(*[F.lit(s).cast("long") for s in sums]), lambda a, s: a * F.lit(n).cast("long") - s)
    added = F.aggregate(spread, total, lambda acc, d: (acc + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast(wide))
    return added.try_cast("long")


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = 16, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable row and component.

    integer_rows() says which rows are usable. There are as many components as asked for, or as a vector has entries;
    one without variance (equal vectors, fewer distinct vectors than dimensions) has whitened null and explained 0 and
    stays out of identity_error. Copies of a vector count once in the fit and are all returned, repeated rows too; a null
    vec_id is kept. No usable rows, or vectors without entries: no rows. Other columns are not read.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = C.stage(mark_distinct(integer_rows(embeddings, id_col, vector_col)), "vectors-marked")
    about = rows.agg(F.max(F.size("x")).alias("d"), F.count_if("fit").alias("n")).first()
    width, n = about.d or 0, about.n
    if not width:
        return spark.createDataFrame([], schema)
    sums = list(rows.where("fit").agg(*[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first())
    block_rows = max(1, block_bytes // (8 * width))
    measured = rows.select("vec_id", "x", "fit", _exact_square(F.col("x"), n, sums).alias("deviation"))
    blocks = C.stage(measured.mapInArrow(_packed(width, n, sums, block_rows), _BLOCKS), "vector-blocks")
    laid = blocks.agg(F.max("part").alias("p"), F.max("seq").alias("s"), F.count("*").alias("b")).first()
    parts, per_part = laid.p + 1, laid.s + 1

    white, explained, real = whitening_matrix(scatter(blocks, width, block_rows, per_part, parts, laid.b), n, min(components, width))
    k = white.shape[1]
    made = project(blocks, white, block_rows, per_part, parts)
    keyed = blocks.select(F.col("part").alias("i"), F.col("seq").alias("j"), "about").join(made, ["i", "j"])
    scored = C.stage(keyed.select(F.posexplode("about").alias("_at", "a"), "values").select(
        "a.vec_id", "a.fit", "a.deviation", F.slice("values", F.col("_at") * k + 1, F.lit(k)).alias("y")), "whitened")
    off = (_covariance(scored, k, n) - np.eye(k))[np.ix_(real, real)]
    error = float(np.abs(off).max(initial=0.0))

    facts = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(bool(r)).alias("real"), F.lit(float(s)).alias("explained")) for i, (r, s) in enumerate(zip(real, explained))])
    return scored.select("vec_id", "deviation", F.explode(F.arrays_zip(facts.alias("f"), F.col("y").alias("y"))).alias("c")).select(
        "vec_id", F.col("c.f.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.col("c.f.real"), F.col("c.y")).alias("whitened"), F.col("c.f.explained").alias("explained"), F.lit(error).alias("identity_error"))
