"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query of trigrams that every match must contain (trigrams.py). A task reads
its documents in blocks of at most BLOCK_BYTES of text and builds each block's inverted index: for every trigram that some
rule asks for, the sorted list of documents that have it. A rule's query is answered by intersecting and uniting those
postings; only the documents it leaves are verified with the expression. A rule without mandatory trigrams scans every
document of the block. A block's index says nothing about other blocks, so nothing is shuffled, and a lost task is read again.

The same postings can be written as a table, index_table(), to answer rules from later: candidates() does so with
joins and counts over the table alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm import common as C
from hourloom.llm.trigrams import Query, alternatives, trigram_query, trigrams_of

BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and what a match must satisfy to count."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0
    base: bool = False
    query: Query = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "query", trigram_query(self.pattern, self.flags))

    def finder(self) -> Callable[[str], list[tuple[int, int]]]:
        """A function from a text to the spans of the leftmost non-overlapping matches whose group is long enough."""
        matches = re.compile(self.pattern, self.flags).finditer
        return lambda text: [m.span() for m in matches(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The three base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]+", least=24, base=True),
)
# Public formats of keys and tokens.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,})"),
    Rule("slack", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"\b[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,256}:[^\s:/@]{3,256}@"),
)
RULES = (*BASE, *MORE)


def postings(texts: pa.Array, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Of the wanted trigrams (a table by code): the sorted numbers of the texts that contain them. Letters A-Z count as a-z."""
    lengths = pc.binary_length(texts).to_numpy()
    ends = np.cumsum(lengths)
    flat = np.frombuffer(b"".join(memoryview(s.as_buffer()) for s in texts), dtype=np.uint8)
    if len(flat) < 3:
        return {}
    lowered = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)
    codes = lowered[:-2].astype(np.int32) << 16
    codes |= lowered[1:-1].astype(np.int32) << 8
    codes |= lowered[2:]
    at = np.flatnonzero(wanted[codes])
    owner = np.searchsorted(ends, at, side="right")
    inside = at + 2 < ends[owner]  # a trigram over the end of a text is none
    pairs = np.unique(codes[at[inside]].astype(np.int64) << 32 | owner[inside])
    grams, docs = pairs >> 32, pairs & 0xFFFFFFFF
    cuts = np.flatnonzero(np.diff(grams)) + 1
    return {int(g[0]): d for g, d in zip(np.split(grams, cuts), np.split(docs, cuts)) if len(g)}


def matching(query: Query, index: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The numbers of the texts, of n, that satisfy a query."""
    if query is True:
        return np.arange(n)
    if isinstance(query, int):
        return index.get(query, np.zeros(0, dtype=np.int64))
    parts = [matching(q, index, n) for q in query[1]]
    if query[0] == "any":
        return np.unique(np.concatenate(parts))
    return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(parts, key=len))


def _table(rules: tuple[Rule, ...]) -> np.ndarray:
    wanted = np.zeros(1 << 24, dtype=bool)
    wanted[list(set().union(*(trigrams_of(r.query) for r in rules)))] = True
    return wanted


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of at most so many bytes of text; one longer text is a piece of its own."""
    for b in batches:
        sizes = pc.binary_length(b["text"]).to_numpy()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(b):
            yield b.slice(start)


def find_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules: tuple[Rule, ...] = RULES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, secret): every match of every rule, in code points, end exclusive.

    One row per row of docs, without matches an empty array. Spans come by start, then in the order of the rules; spans of
    different rules may overlap. Null texts count as empty. No rows in, no rows out. Other columns are not read.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, finders = _table(rules), [r.finder() for r in rules]
        for b in blocks(batches, block_bytes):
            texts, index = b["text"], postings(b["text"], wanted)
            found: dict[int, list[tuple[int, int, int]]] = {}
            read: dict[int, str] = {}
            for k, rule in enumerate(rules):
                for i in matching(rule.query, index, len(b)).tolist():
                    text = read.get(i)
                    if text is None:
                        text = texts[i].as_py()
                        if rule.query is not True:
                            read[i] = text
                    if spans := finders[k](text):
                        found.setdefault(i, []).extend((s, k, e) for s, e in spans)
                        read[i] = text
            rows = [[{"kind": rules[k].kind, "start": s, "end": e, "secret": read[i][s:e]} for s, k, e in sorted(found.get(i, []))] for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(rows, pa.list_(spans_type))], names=["doc_id", "spans"])

    spans_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())])
    return C.id_rows(docs, id_col, text_col).mapInArrow(scan, "doc_id long, spans array<struct<kind: string, start: long, end: long, secret: string>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: find_spans() as counts, a digest of the base kinds, and one line of all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(r.kind).alias(f"n_{r.kind}") for r in BASE]
    return find_spans(docs, id_col, text_col, **options).select(
        "doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{kind}]", **options) -> DataFrame:
    """doc_id and text with every span replaced by its mark; of overlapping spans the first one, grown to cover the others."""
    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
                parts, at, merged = [], 0, []
                for s in spans:
                    if merged and s["start"] < merged[-1][2]:
                        merged[-1][2] = max(merged[-1][2], s["end"])
                    else:
                        merged.append([s["kind"], s["start"], s["end"]])
                for kind, start, end in merged:
                    parts += [text[at:start], mark.format(kind=kind)]
                    at = end
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = C.stage(C.id_rows(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "texts")
    found = find_spans(rows, "_row", **options).where(F.size("spans") > 0).withColumnRenamed("doc_id", "_row")
    some = rows.join(found, "_row").select("doc_id", "text", "spans").mapInArrow(cover, "doc_id long, text string")
    return rows.join(found, "_row", "left_anti").select("doc_id", "text").unionByName(some)


def index_table(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules: tuple[Rule, ...] = RULES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The inverted index of the rules' trigrams: part, block, ids (the block's doc_ids), gram, docs (positions in ids, from 0).

    A block that has none of the trigrams still has a row, with gram null, so that rules without mandatory trigrams find its documents.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, part = _table(rules), TaskContext.get().partitionId()
        for number, b in enumerate(blocks(batches, block_bytes)):
            index = postings(b["text"], wanted)
            ids = b["doc_id"].to_pylist()
            grams = [None, *index]
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * len(grams), pa.int32()), pa.array([number] * len(grams), pa.int64()),
                pa.array([ids] + [None] * len(index), pa.list_(pa.int64())), pa.array(grams, pa.int32()),
                pa.array([None, *index.values()], pa.list_(pa.int32()))], names=["part", "block", "ids", "gram", "docs"])

    return C.id_rows(docs, id_col, text_col).mapInArrow(build, "part int, block long, ids array<long>, gram int, docs array<int>")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """kind, doc_id of the documents that a rule's query leaves, from index_table() alone.

    A query is taken as alternatives of trigrams that a document must all have; postings meet the alternatives over their
    trigram, and a document counts where it was met as often as the alternative has trigrams.
    """
    spark = index.sparkSession
    asked = [(r.kind, number, gram, len(grams)) for r in rules if r.query is not True for number, grams in enumerate(alternatives(r.query)) for gram in grams]
    everywhere = F.array(*[F.lit(r.kind) for r in rules if r.query is True]).cast("array<string>")
    ids = index.where(F.col("gram").isNull()).select("part", "block", F.posexplode("ids").alias("at", "doc_id"))
    found = (
        index.where(F.col("gram").isNotNull())
        .join(F.broadcast(spark.createDataFrame(asked, "kind string, number int, gram int, wanted int")), "gram")  # as long as the rules are
        .select("part", "block", "kind", "number", "wanted", F.explode("docs").alias("at"))
        .groupBy("part", "block", "kind", "number", "wanted", "at").count().where("count = wanted")
        .select("part", "block", "kind", "at").distinct()
    )
    return found.join(ids, ["part", "block", "at"]).select("kind", "doc_id").unionByName(
        ids.select(F.explode(everywhere).alias("kind"), "doc_id"))
