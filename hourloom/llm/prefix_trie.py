"""Conversation prefix trie from adaptive radix trees.

Each turn has an id of TURN_BYTES bytes, a digest of role and text read as a big-endian integer; a conversation's key is its
turns' ids one after the other. (128 bits: among 10^12 distinct turns two share an id with a chance of about 10^-15.)
Equal keys are counted first, so that a conversation that many ids have is one key. Keys are then dealt by range, so that a
task has neighbours and any share of the keys may begin with the same turns. A task puts its keys into an adaptive radix
tree and walks it bottom up; where a path crosses a whole number of turns, that depth is a node of the trie, and other
depths are none.

A node is complete in its task unless it is a beginning of the task's first or last key: only such nodes can have members
in two tasks. A task gives them under a digest of their path, with counts of what is complete below them. They are at most
two paths a task; their parts are summed by digest, and their subtree sums follow by doubling: in round k each node adds
the sums of the nodes 2**k above it.

A conversation's ids, some 20 bytes a turn, are in one row; only its ids, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm import common as C
from hourloom.llm import radix

TURN_BYTES = 16
#: Bytes of keys a task may build its tree from; the tree is some twenty times as large.
TASK_BYTES = 4 << 20
# Which conversation another one is rebuilt from, and of how many of its turns at most.
GROUP, HEAD_TURNS = 20, 4

_NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "words long, key binary, parent_key binary"
)
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """TURN_BYTES bytes that stand for a turn."""
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 2 * TURN_BYTES))


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and seq, its turns as (id, words) in order: by turn, null first, then by id. Rows without conv_id are no conversation's."""
    role, text = C.text_or_empty("role"), C.text_or_empty("text")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), turn_id(role, text).alias("id"), C.word_count(text).cast("int").alias("words")).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("s")).select(
        "conv_id", F.transform("s", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("seq"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the first conversation of its group of GROUP ids."""
    own = seqs.withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS).cast("int")})
    heads = seqs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, HEAD_TURNS - 1).alias("head"))
    first = F.slice(F.coalesce("head", F.slice("seq", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(first, rest).alias("seq"))


def end_digests(members: DataFrame) -> DataFrame:
    """key_id, ends_sha256: of (key_id, conv_id), the SHA-256 of each key's ids in ascending order, joined by commas.

    A digest needs its whole list in order. The list of one key is sorted and written out over many tasks, in chunks;
    a last task reads the chunks of its keys in order and holds no more than one batch.
    """
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = b["key_id"].to_pylist(), b["conv_id"].to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else [0]
            spans = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[i] for i, _ in spans], pa.binary()), pa.array([ids[i] for i, _ in spans], pa.int64()),
                pa.array([",".join(map(str, ids[i:j])) for i, j in spans], pa.string())], names=["key_id", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for b in batches:
            done = []
            for key, ids in zip(b["key_id"].to_pylist(), b["ids"].to_pylist()):
                if key == now:
                    running.update(b",")
                else:
                    done += [(now, running.hexdigest())] if running else []
                    now, running = key, hashlib.sha256()
                running.update(ids.encode())
            yield _digest_rows(done)
        yield _digest_rows([(now, running.hexdigest())] if running else [])

    ordered = members.repartitionByRange("key_id", "conv_id").sortWithinPartitions("key_id", "conv_id")
    written = ordered.mapInArrow(chunks, "key_id binary, first long, ids string")
    return written.repartition("key_id").sortWithinPartitions("key_id", "first").mapInArrow(digests, "key_id binary, ends_sha256 string")


def _digest_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], names=["key_id", "ends_sha256"])


class _Below:
    """What lies below a place in the tree: members, complete nodes' sums, and the trie nodes directly below."""

    __slots__ = ("convs", "least", "row", "leaves", "saved", "front", "edges")

    def __init__(self):
        self.convs, self.least, self.row, self.leaves, self.saved, self.front, self.edges = 0, None, None, 0, 0, [], 0

    def add(self, other: _Below) -> None:
        self.convs += other.convs
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.row = other.row if self.row is None else self.row
        self.leaves += other.leaves
        self.saved += other.saved
        self.front += other.front
        self.edges |= other.edges


def _path_digests(key: bytes) -> list[bytes]:
    """A digest of the first 0, 1, 2, ... turns of a key."""
    running, out = hashlib.blake2b(digest_size=16), []
    out.append(running.digest())
    for at in range(0, len(key), TURN_BYTES):
        running.update(key[at : at + TURN_BYTES])
        out.append(running.digest())
    return out


def trie_nodes(keys: list[bytes], words: list[list[int]], convs: list[int], least: list[int], ends: list[str]) -> dict[str, list]:
    """The trie nodes of one task's distinct keys, as columns of _NODES."""
    root = radix.Node(b"")
    for row, key in enumerate(keys):
        radix.insert(root, key, row)
    first, last = min(range(len(keys)), key=keys.__getitem__), max(range(len(keys)), key=keys.__getitem__)
    digests = {1: _path_digests(keys[first]), 2: _path_digests(keys[last])}
    out: dict[str, list] = {c.split()[0]: [] for c in _NODES.split(", ")}
    held: dict[int, _Below] = {}

    def emit(below: _Below, depth: int, end: str | None) -> None:
        edge = digests[1 if below.edges & 1 else 2][depth] if below.edges else None
        n_words = words[below.row][depth - 1] if depth else 0
        at = len(out["depth"])
        for child in below.front:
            out["parent_conv_id"][child], out["parent_key"][child] = (below.least, None) if edge is None else (None, edge)
        if edge is None:
            below.leaves += not below.front
            below.saved += (below.convs - 1) * n_words
            children = len(below.front)
        else:
            children = sum(out["key"][c] is None for c in below.front)
        for name, value in zip(out, (below.least, depth, None, below.convs, children, below.leaves, below.saved, end or _NO_ENDS, n_words, edge, None)):
            out[name].append(value)
        below.front = [at]

    for node, depth in radix.bottom_up(root):
        below, end = _Below(), None
        if node.value is not None:
            row, end = node.value, ends[node.value]
            below.convs, below.least, below.row = convs[row], least[row], row
            below.edges = (row == first) | 2 * (row == last)
        for _, child in node.items():
            below.add(held.pop(id(child)))
        top = depth - len(node.path)
        for at in range(depth // TURN_BYTES * TURN_BYTES, top if depth else -1, -TURN_BYTES):  # whole turns on the path to this node
            emit(below, at // TURN_BYTES, end if at == depth else None)
        held[id(node)] = below
    return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if not held:
        return
    table = pa.Table.from_batches(held)
    nodes = trie_nodes(*[table[c].to_pylist() for c in ("key", "words", "n", "least", "ends_sha256")])
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    made = pa.RecordBatch.from_arrays([pa.array(nodes[n], types[t]) for n, t in (c.split() for c in _NODES.split(", "))], names=list(nodes))
    for at in range(0, len(made), 20_000):
        yield made.slice(at, 20_000)


def _merged(nodes: DataFrame) -> DataFrame:
    """The nodes that several tasks may share, with all their numbers; key and parent_key stay."""
    summed = nodes.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"),
        F.sum("n_leaves").alias("inner_leaves"), F.sum("saved_tokens").alias("inner_saved"), F.first("words").alias("words"),
        F.first("parent_key", ignorenulls=True).alias("parent_key"), F.max(F.when(F.col("ends_sha256") != _NO_ENDS, F.col("ends_sha256"))).alias("ends"))
    edges = C.stage(summed, "trie-edges")
    parents = edges.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("shared"))
    whole = C.stage(edges.join(parents, "key", "left").withColumn("n_children", F.col("inner") + F.coalesce("shared", F.lit(0))), "trie-edges")

    state = C.stage(whole.select(
        "key", F.col("parent_key").alias("above"), (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "trie-sums")
    deepest, reach = whole.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        given = state.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        further = state.select(F.col("key").alias("above"), F.col("above").alias("next"))
        state = C.stage(
            state.join(given, "key", "left").join(further, "above", "left").select(
                "key", F.col("next").alias("above"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "trie-sums")
        reach *= 2
    return whole.join(state.drop("above"), "key").select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", (F.col("inner_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("inner_saved") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"))


def prefix_trie(seqs: DataFrame, *, task_bytes: int = TASK_BYTES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per trie node.

    `seqs` has a row per conversation: conv_id and seq, an array of (id, words). A node is a distinct beginning of
    conversations, the root that of all; one without turns is a member of the root alone. No conversations, no rows.
    """
    keyed = C.stage(seqs.select(
        "conv_id", F.coalesce(F.unhex(F.array_join(F.transform("seq", lambda t: F.hex(t["id"])), "")), F.lit(b"").cast("binary")).alias("key"),
        F.transform("seq", lambda t: t["words"]).alias("words")), "conversations")
    key_id = F.unhex(F.sha2("key", 256))
    ends = end_digests(keyed.select(key_id.alias("key_id"), "conv_id"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("words").alias("words"))
    distinct = C.stage(counted.withColumn("key_id", key_id).join(ends, "key_id").drop("key_id"), "distinct-conversations")
    held = distinct.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    tasks = max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // task_bytes))
    nodes = C.stage(distinct.repartitionByRange(tasks, "key").mapInArrow(_build, _NODES), "trie-nodes")

    merged = C.stage(_merged(nodes), "trie-merged")
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    complete = nodes.where(F.col("key").isNull())
    below_edge = complete.where(F.col("parent_key").isNotNull()).drop("parent_conv_id").unionByName(
        merged.drop("key"), allowMissingColumns=True).join(names, "parent_key", "left").withColumn("parent_conv_id", F.col("named"))
    return complete.where(F.col("parent_key").isNull()).select(*columns).unionByName(below_edge.select(*columns))


def conversation_trie(turns: DataFrame, **options) -> DataFrame:
    """prefix_trie() of the rebuilt conversations of (conv_id, turn, role, text) rows.

    Null role or text counts as empty. Turns come in order of turn, null first; rows of one turn, repeated ones too, all
    count, in order of their ids. Rows without conv_id are no conversation's. Other columns are not read.
    """
    return prefix_trie(C.stage(rebuilt(C.stage(sequences(turns), "turns")), "rebuilt"), **options)
