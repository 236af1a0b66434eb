"""Hidden Markov language model with an open vocabulary.

Latent states emit word classes. Each of the WORD_CLASSES most frequent words (and the end of a text) is a class of its own; every
other word, known or not, belongs to the class of its last two letters. Within such a class a word has the share of its training
count, less a discount that all unknown words of the class have together. So the probability of a text is the forward
probability of its classes times the shares of its rarer words, and both are exact.

Baum-Welch runs over all training documents: each task adds up expected counts of its documents, Spark adds up
the tasks'. The first parameters come from all of them as well: from a mixture in which every document has one state throughout.
Counts of rarer words, which grow with the corpus, are never gathered: documents' rarer words are joined with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm import common as C
from hourloom.llm.words import frequent, sliced, split_words

#: States, rounds of the mixture that the first parameters come from, and rounds of Baum-Welch; each over all training documents.
STATES, FIRST_ROUNDS, ROUNDS = 8, 6, 2
#: Words with a class of their own; classes of endings; words whose counts every task holds.
WORD_CLASSES, ENDING_CLASSES, FREQUENT = 2**14, 2**11, 2**17
#: Training cuts longer texts into pieces of so many tokens; scoring doesn't. Tokens that a task works on at a time.
PIECE, AT_A_TIME = 2**16, 300_000
DISCOUNT, UNSEEN, PRIOR = 0.5, 0.5, 100.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


@dataclass
class Vocabulary:
    """What every task knows: the frequent words with counts, and each ending class's mass. Of fixed size."""

    words: list[str]
    counts: np.ndarray
    own: int
    mass: np.ndarray  # of all words of an ending class, the unknown among them
    unknown: np.ndarray
    total: int  # training tokens, ends among them
    distinct: int
    documents: int

    @property
    def classes(self) -> int:
        return 1 + self.own + ENDING_CLASSES  # 0 is the end

    @property
    def base(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def prior(self) -> np.ndarray:
        p = np.concatenate([[self.documents + UNSEEN], self.counts[: self.own], self.mass])
        return p / p.sum()


def ending_class(word: Column) -> Column:
    return F.pmod(F.crc32(F.substring(word, -2, 2).cast("binary")), F.lit(ENDING_CLASSES)).cast("int")


def _ending(word: str) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % ENDING_CLASSES


def train_counts(rows: DataFrame) -> DataFrame:
    """word, n over training documents."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4000):
            _, codes, words = split_words(b.column(0), lower=True)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))], names=["word", "n"])

    return rows.where(~F.col("held_out")).select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    top = frequent(counts, FREQUENT).orderBy(F.desc("n"), "word").toArrow()  # FREQUENT rows at most
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy().astype(np.float64)
    own = min(WORD_CLASSES, len(words))
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    mass, unknown = np.full(ENDING_CLASSES, UNSEEN), np.full(ENDING_CLASSES, UNSEEN)
    for r in counts.groupBy(ending_class(F.col("word")).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # ENDING_CLASSES rows at most
        mass[r.k] += r.n
        unknown[r.k] += DISCOUNT * r.v
    for w, c in zip(words[:own], n[:own]):
        k = _ending(w)
        mass[k] -= c
        unknown[k] -= DISCOUNT
    return Vocabulary(words, n, own, mass, unknown, tokens + documents, distinct + (documents > 0), documents)


CODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, codes binary, rare array<string>, times array<int>"


def coded(rows: DataFrame, shared) -> DataFrame:
    """Documents as class numbers with what the known words add to both scores, and their rarer words with counts."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(**shared.value)
        place = {w: i for i, w in enumerate(v.words)}
        base_of = np.log10((v.counts + 0.5) / v.base)
        end = float(np.log10((v.documents + 0.5) / v.base))
        for b in sliced(batches):
            ends, codes, distinct = split_words(b.column(3), lower=True)
            names = distinct.to_pylist()
            at = np.fromiter((place.get(w, -1) for w in names), np.int64, len(names))
            ending = np.fromiter(map(_ending, names), np.int64, len(names))
            known, owned = at >= 0, (at >= 0) & (at < v.own)
            number = np.where(owned, at + 1, 1 + v.own + ending).astype(np.uint16)
            base = np.where(known, base_of[at] if len(base_of) else 0.0, 0.0)
            share = np.where(known & ~owned, np.log10(np.maximum((v.counts[at] if len(v.counts) else 0.0) - DISCOUNT, 1e-9) / v.mass[ending]), 0.0)
            out: list[list] = [[], [], [], [], [], [], []]
            zero = np.zeros(1, np.uint16).tobytes()
            for x, y in zip(ends[:-1], ends[1:]):
                here = codes[x:y]
                rare, times = np.unique(here[~known[here]], return_counts=True)
                out[0].append(y - x + 1)
                out[1].append(int(known[here].sum()) + (v.documents > 0))
                out[2].append(float(base[here].sum()) + end)
                out[3].append(float(share[here].sum()))
                out[4].append(number[here].tobytes() + zero)
                out[5].append([names[i] for i in rare.tolist()])
                out[6].append(times)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(o, k) for o, k in zip(out, kinds)]], names=[x.split()[0] for x in CODED.split(", ")])

    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(made, CODED)


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)


def maximised(first: np.ndarray, moves: np.ndarray, emitted: np.ndarray, prior: np.ndarray) -> Model:
    """Parameters from expected counts; emissions lean to the classes' overall shares, so no class is impossible."""
    e = emitted + PRIOR * prior[:, None]
    m = moves + 1
    f = first + 1
    return Model(f / f.sum(), m / m.sum(1, keepdims=True), e / e.sum(0, keepdims=True))


def _chunks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences by falling length, as many at a time as have about AT_A_TIME tokens."""
    order = np.argsort(-lengths, kind="stable")
    part = np.cumsum(lengths[order]) // AT_A_TIME
    for p in np.split(order, np.nonzero(np.diff(part))[0] + 1):
        if len(p):
            yield p


def _forward(model: Model, flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray, keep: bool):
    """Scaled forward recursion of sequences side by side, lengths falling: log likelihoods, and with keep all states and scales."""
    n = len(begin)
    alpha = np.zeros((n, len(model.start)))
    log = np.zeros(n)
    states = np.zeros((len(flat), len(model.start)), np.float32) if keep else None
    scales = np.zeros(len(flat)) if keep else None
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right") if n else []
    for t, k in enumerate(live):
        at = begin[:k] + t
        e = model.emit[flat[at]]
        now = (model.start * e) if t == 0 else (alpha[:k] @ model.move) * e
        s = now.sum(1)
        now /= s[:, None]
        alpha[:k] = now
        log[:k] += np.log(s)
        if keep:
            states[at], scales[at] = now, s
    return log, states, scales


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of first states, moves and emissions, added up over sequences."""
    s = len(model.start)
    first, moves, emitted = np.zeros(s), np.zeros((s, s)), np.zeros(model.emit.shape)
    sequences = [x[i : i + PIECE] for x in sequences for i in range(0, len(x), PIECE)]
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    for part in _chunks(lengths):
        flat, size = np.concatenate([sequences[i] for i in part]), lengths[part]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        _, states, scales = _forward(model, flat, begin, size, True)
        ahead = np.ones((len(part), s))
        weighted = np.zeros(states.shape, np.float32)  # what the backward recursion hands to the place before
        posterior = np.zeros(states.shape, np.float32)
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        for t in range(int(size[0]) - 1, -1, -1):
            k = live[t]
            at = begin[:k] + t
            posterior[at] = states[at] * ahead[:k]
            w = model.emit[flat[at]] * ahead[:k] / scales[at][:, None]
            weighted[at] = w
            ahead[:k] = w @ model.move.T
        first += posterior[begin].sum(0)
        inner = np.ones(len(flat), bool)
        inner[begin] = False
        later = np.nonzero(inner)[0]
        moves += (states[later - 1].T @ weighted[later]) * model.move
        for j in range(s):
            emitted[:, j] += np.bincount(flat, posterior[:, j], len(emitted))
    return first, moves, emitted


def mixed(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """expected() where a sequence has one state throughout: there are no moves to count."""
    s = len(model.start)
    first, emitted, log_emit = np.zeros(s), np.zeros(model.emit.shape), np.log(model.emit)
    sequences = [x[i : i + PIECE] for x in sequences for i in range(0, len(x), PIECE)]
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    for part in _chunks(lengths):
        flat, size = np.concatenate([sequences[i] for i in part]), lengths[part]
        log = np.add.reduceat(log_emit[flat], np.cumsum(size) - size) + np.log(model.start)
        share = np.exp(log - log.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        first += share.sum(0)
        for j in range(s):
            emitted[:, j] += np.bincount(flat, np.repeat(share[:, j], size), len(emitted))
    return first, np.zeros((s, s)), emitted


def first_model(v: Vocabulary, states: int) -> Model:
    """All words' shares, each state's times factors of its own, so that states differ; a state seldom changes."""
    emit = v.prior()[:, None] * np.exp(np.random.default_rng(7).normal(size=(v.classes, states)) / 2)
    move = np.full((states, states), 0.1) + np.eye(states) * 20
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _summed(learnt: DataFrame, model: Model, work) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """expected() or mixed() over all documents: tasks add up theirs, Spark the tasks'."""
    now = learnt.sparkSession.sparkContext.broadcast(vars(model))
    states, classes = len(model.start), len(model.emit)
    names = [f"s{i}" for i in range(states)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            got = work(Model(**now.value), [np.frombuffer(x, np.uint16) for x in b.column(0).to_pylist()])
            total = got if total is None else [x + y for x, y in zip(total, got)]
        if total is not None:
            first, moves, emitted = total
            used = np.nonzero(emitted.sum(1))[0]
            # Classes from 0; moves from state i as class -1 - i; first states as the class after those.
            keys = np.concatenate([used, -1 - np.arange(len(moves)), [-1 - len(moves)]])
            rows = np.concatenate([emitted[used], moves, first[None]])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.ascontiguousarray(rows[:, j])) for j in range(rows.shape[1])]], names=["c", *names])

    sums = learnt.select("codes").mapInArrow(counted, "c long, " + ", ".join(f"{x} double" for x in names)).groupBy("c").agg(*[F.sum(x).alias(x) for x in names]).toPandas()  # a row a class
    now.unpersist()
    values = sums.set_index("c").sort_index()
    emitted, moves = np.zeros((classes, states)), np.zeros((states, states))
    used = values.index[values.index >= 0]
    emitted[used] = values.loc[used].to_numpy()
    for i in range(states):
        if -1 - i in values.index:
            moves[i] = values.loc[-1 - i].to_numpy()
    first = values.loc[-1 - states].to_numpy() if -1 - states in values.index else np.zeros(states)
    return first, moves, emitted


def trained(table: DataFrame, v: Vocabulary, *, states: int = STATES, rounds: int = ROUNDS, first_rounds: int = FIRST_ROUNDS) -> Model:
    """Parameters from all training documents, in every round."""
    learnt, prior = table.where(~F.col("held_out")).select("codes"), v.prior()
    model = start = first_model(v, states)
    for _ in range(first_rounds):
        model = maximised(*_summed(learnt, model, mixed), prior)
    model = Model(model.start, start.move, model.emit)
    for _ in range(rounds):
        model = maximised(*_summed(learnt, model, expected), prior)
    return model


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each sequence's probability, over its whole length."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    out = np.zeros(len(sequences))
    for part in _chunks(lengths):
        size = lengths[part]
        flat = np.concatenate([sequences[i] for i in part])
        out[part] = _forward(model, flat, np.concatenate([[0], np.cumsum(size)[:-1]]), size, False)[0]
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, states: int = STATES, rounds: int = ROUNDS, first_rounds: int = FIRST_ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Null and white texts are an end alone. Null ids are trained on. Without training documents every token is unknown, and both scores are those of
    an empty count. No rows in, no rows out.
    """
    spark = docs.sparkSession
    rows = C.id_rows(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    counts = C.stage(train_counts(rows), "hmm-words")
    documents = rows.where(~F.col("held_out")).count()
    v = vocabulary(counts, documents)
    table = C.stage(coded(rows, spark.sparkContext.broadcast(vars(v))), "hmm-coded")
    model = spark.sparkContext.broadcast(vars(trained(table, v, states=states, rounds=rounds, first_rounds=first_rounds)))

    rarer = table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    known_least = v.counts.min() if len(v.counts) else float("inf")
    less = counts.where(F.col("n") < float(known_least)) if len(v.counts) else counts
    met = rarer.join(less, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mass, unknown = (F.element_at(F.lit([float(x) for x in a]).cast("array<double>"), ending_class(F.col("word")) + 1) for a in (v.mass, v.unknown))
    share = F.log10(F.when(F.col("n") > 0, F.col("n") - DISCOUNT).otherwise(unknown) / mass)
    added = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / v.base)).alias("base2"), F.sum(F.col("times") * share).alias("share2"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known2"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            log = log_likelihoods(Model(**model.value), [np.frombuffer(x, np.uint16) for x in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(log / np.log(10))], names=[*b.schema.names[:-1], "path"])

    paths = table.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "share", "codes").mapInArrow(
        scored, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, path double")
    zero = F.lit(0.0)
    return paths.join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known2", F.lit(0))).cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero)).alias("base_score"), (F.col("path") + F.col("share") + F.coalesce("share2", zero)).alias("score"))
