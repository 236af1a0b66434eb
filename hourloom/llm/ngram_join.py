"""N-gram Jaccard join by token-combination prefixes.

The tokens of a document are its distinct word shingles, as 64-bit hashes. All documents order their tokens alike: rare ones
first, then those that many documents have, by hash in either class. Of n tokens the first n - ceil(t n) + k are
the extended prefix; two documents of similarity t or more share at least k tokens of it (k: TOGETHER or a
twentieth of n). A shared rare token is indexed by itself. Two documents that share no rare token of their prefixes share two
frequent ones, so frequent tokens are indexed in pairs. (Of documents with more than BIG tokens, whose pairs would be
too many, frequent tokens are indexed singly.) Whole sets are then compared, so the index decides only on what is compared.

Documents with equal sets are one node. The documents of an index entry form a unit, named after the first of them; equal units of
many entries fall together. A document can be in many units, so there it is stood for by a field of bits, a few for each token: a bit of one
document's field that is missing in another's is a token that the other lacks, which bounds what they share. Documents that could be
similar by that bound are joined up to families, of which each document has one, and families' whole sets are compared.

Both times documents are compared in blocks of at most BLOCK and only a spanning forest of the links is kept; across blocks, documents
are compared only where they aren't in one component already. So a group of near copies costs neither a row a pair nor a task a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm import common as C
from hourloom.llm.components import components
from hourloom.llm.shingles import mixed, shingle_sets, signatures
from hourloom.llm.words import sliced

WORDS, THRESHOLD = 5, (75, 100)
#: Counted often enough in more than one batch, a token is frequent; at most so many are known to all tasks.
FREQUENT, MOST_FREQUENT = 64, 2**18
TOGETHER, BIG, BLOCK = 2, 159, 512
#: An index part beyond this is split by Spark instead of being held by a task.
PART_BYTES = 128 << 20
FILTER_BITS = 24


def _needed(n: int, t: tuple[int, int]) -> int:
    """Least tokens of a set of n that a similar set shares."""
    return -(-n * t[0] // t[1])


def _extra(n: int) -> int:
    return max(TOGETHER, 1 + n // 20)


def _prefix(n: int, t: tuple[int, int]) -> int:
    return min(n, n - _needed(n, t) + _extra(n))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return C.id_rows(docs, id_col, text_col).withColumn("k", C.row_key("doc_id", "text"))


def frequent_tokens(rows: DataFrame, words: int, t: tuple[int, int], least: int = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """Tokens that many documents have among their first ones, in order; at most `most`.

    A token counts where a batch has it twice or more. Missing one, or taking one too many, changes what is indexed how, not the result.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(0), words)
            _, first = np.unique(signatures(sets), axis=0, return_index=True)
            heads = [sets[i][: min(len(sets[i]), _prefix(len(sets[i]), t) * 3 // 2 + 8)] for i in first]
            tokens, n = np.unique(np.concatenate(heads) if heads else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["token", "n"])

    counts = C.stage(rows.select("text").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "token-counts")
    top = counts.orderBy(F.desc("n"), "token").limit(most).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def _keys(s: np.ndarray, often: np.ndarray, t: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set: of its rare tokens, and of its frequent ones (whose number is the third)."""
    n = len(s)
    p = _prefix(n, t)
    rare = s[~often][:p]
    common = s[often][: p - len(rare)] if len(rare) < p else s[:0]
    made = []
    if len(common) and n > BIG:
        made.append(common)
    if len(common) > 1 and n <= 4 * BIG // 3:
        i, j = np.triu_indices(len(common), 1)
        made.append(mixed(common[i] * np.uint64(3) + common[j]))
    return rare, np.concatenate(made) if made else s[:0], len(common)


INDEX = "row long, doc_id long, n int, sig1 long, sig2 long, k long, common int, part int, keys binary, owners binary, base long"


def index(rows: DataFrame, frequent, words: int, t: tuple[int, int], parts: int) -> DataFrame:
    """Rows of documents (part null) and of packed index entries: 32-bit keys of a part with the offsets of their documents from base."""
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        names = [x.split()[0] for x in INDEX.split(", ")]
        for b in sliced(batches, 5000):
            row, base = b.column(0).to_numpy(), b.column(0)[0].as_py() if len(b) else 0
            sets = shingle_sets(b.column(2), words)
            sig = signatures(sets)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            at = np.searchsorted(often, flat)
            known = (often[np.minimum(at, len(often) - 1)] == flat) if len(often) else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            _, first = np.unique(sig, axis=0, return_index=True)
            first = set(first.tolist())  # a copy has the keys of the first of its kind
            keys, owners, common = [], [], np.zeros(len(sets), np.int32)
            for i, s in enumerate(sets):
                rare, often_keys, common[i] = _keys(s, known[ends[i] : ends[i + 1]], t)
                if i in first and len(s) > 1:
                    keys += [rare & ~np.uint64(1), often_keys | np.uint64(1)]
                    owners.append(np.full(len(rare) + len(often_keys), row[i] - base, np.uint32))
            n = np.fromiter(map(len, sets), np.int32, len(sets))
            none = lambda kind, k=len(sets): pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(n), pa.array(np.ascontiguousarray(sig[:, 0])), pa.array(np.ascontiguousarray(sig[:, 1])), b.column(3), pa.array(common),
                none(pa.int32()), none(pa.binary()), none(pa.binary()), none(pa.int64())], names=names)
            if not keys:
                continue
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            part = (keys >> np.uint64(1)) % np.uint64(parts)
            low = (((keys >> np.uint64(1)) // np.uint64(parts)) << np.uint64(1) | keys & np.uint64(1)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            used, start = np.unique(part[order], return_index=True)
            low, owners = low[order], owners[order]
            cuts = [*start.tolist(), len(low)]
            none = lambda kind, k=len(used): pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays([
                none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int32()), pa.array(used.astype(np.int32)),
                pa.array([low[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()), pa.array([owners[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()),
                pa.array(np.full(len(used), base))], names=names)

    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "k").mapInArrow(indexed, INDEX)


def memberships(entries: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """row, unit, rare: the documents that share a key, under the first document that has it; rare: how many rare keys they share there."""
    def met(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in part["keys"]])
        rows = np.concatenate([np.frombuffer(o, np.uint32).astype(np.int64) + base for o, base in zip(part["owners"], part["base"])])
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        _, start, n = np.unique(keys, return_index=True, return_counts=True)
        first = np.minimum.reduceat(rows, start) if len(rows) else rows
        shared = np.repeat(n > 1, n)
        out = pd.DataFrame({"row": rows[shared], "unit": np.repeat(first, n)[shared], "rare": 1 - (keys[shared] & np.uint32(1)).astype(np.int64)})
        return out.groupby(["row", "unit"], as_index=False)["rare"].sum()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, keys, owners, base in zip(*[c.to_pylist() for c in b.columns]):
                k = np.frombuffer(keys, np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k + (part << 32)), pa.array(np.frombuffer(owners, np.uint32).astype(np.int64) + base)], names=["key", "row"])

    sizes = entries.groupBy("part").agg(F.sum(F.octet_length("keys")).alias("b")).where(F.col("b") > part_bytes)
    large = [r.part for r in sizes.select("part").collect()]  # a part is a number of the index, of which there are few
    small = entries.where(~F.col("part").isin(large)) if large else entries
    found = small.groupBy("part").applyInPandas(met, "row long, unit long, rare long")
    if large:
        flat = C.stage(entries.where(F.col("part").isin(large)).select("part", "keys", "owners", "base").mapInArrow(opened, "key long, row long"), "large-parts")
        units = C.stage(flat.groupBy("key").agg(F.min("row").alias("unit"), F.count("*").alias("c")).where("c > 1").drop("c"), "large-units")
        found = found.unionByName(flat.join(units, "key").select("row", "unit", (1 - F.col("key").bitwiseAND(1)).cast("long").alias("rare")))
    return found.groupBy("row", "unit").agg(F.sum("rare").alias("rare"))


def _forest(linked: list[tuple[int, int]], m: int) -> list[tuple[int, int]]:
    """The pairs that join what the ones before left apart."""
    up = list(range(m))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in linked:
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def bit_field(s: np.ndarray) -> bytes:
    """A bit for each token, by its hash, in a field of two to four bits a token; a power of two, so that wider fields fold."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    bits = np.zeros(width, bool)
    bits[s & np.uint64(width - 1)] = True
    return np.packbits(bits).tobytes()


def _hopeful(n: np.ndarray, fields: list[bytes], t: tuple[int, int], split: int | None = None, same: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that could be linked by their fields, as a spanning forest; with split, only pairs of one document before and one from it."""
    wide = np.fromiter(map(len, fields), np.int64, len(fields))
    linked = []
    for w in np.unique(wide).tolist():
        mine, folded = np.nonzero(wide == w)[0], np.nonzero(wide == 2 * w)[0]  # wider ones than that have too many tokens
        both = np.concatenate([mine, folded])
        f = np.stack([np.frombuffer(fields[i], np.uint8) for i in mine] + [np.bitwise_or.reduce(np.frombuffer(fields[i], np.uint8).reshape(2, w)) for i in folded])
        shared = np.zeros((len(mine), len(both)), np.float32)
        for x in range(0, w, 512):
            bits = np.unpackbits(f[:, x : x + 512], axis=1).astype(np.float32)
            shared += bits[: len(mine)] @ bits.T
        ones = np.bitwise_count(f).sum(1, dtype=np.int64)
        shared, na, nb = shared.astype(np.int64), n[mine][:, None], n[both][None]
        most = np.minimum(na - ones[: len(mine), None], nb - ones[None]) + shared
        i, j = np.nonzero(t[1] * most >= t[0] * (na + nb - most))
        i, j = mine[i], both[j]
        low, high = np.minimum(i, j), np.maximum(i, j)
        keep = (low < high) if split is None else (low < split) & (high >= split)
        if same is not None:
            keep &= same[low] != same[high]
        linked += zip(low[keep].tolist(), high[keep].tolist())
    return _forest(linked, len(fields))


def _links(n: np.ndarray, tokens: list[bytes], t: tuple[int, int], split: int | None = None, same: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Linked pairs, as a spanning forest. With split, only pairs of one set before and one from it; same: components already known."""
    sets, m = [np.frombuffer(x, np.uint64) for x in tokens], len(tokens)
    lefts = range(m) if split is None else range(split)
    if m <= 6:
        pairs = [(i, j) for i in lefts for j in range(i + 1 if split is None else split, m)]
        shared = {(i, j): len(np.intersect1d(sets[i], sets[j], True)) for i, j in pairs if t[1] * min(n[i], n[j]) >= t[0] * max(n[i], n[j]) and (same is None or same[i] != same[j])}
        linked = [(i, j) for (i, j), x in shared.items() if t[1] * x >= t[0] * (n[i] + n[j] - x)]
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        code = np.cumsum(new) - 1
        often = np.bincount(code) > 1
        keep = often[code]
        code, owner = (np.cumsum(often) - 1)[code[keep]], owner[keep]
        k = m if split is None else split
        shared = np.zeros((k, m if split is None else m - split), np.float32)
        width = 4096
        for c in range(0, int(often.sum()), width):  # columns of the token matrix, a few at a time
            a, b = np.searchsorted(code, [c, c + width])
            x = np.zeros((m, width), np.float32)
            x[owner[a:b], code[a:b] - c] = 1
            shared += x @ x.T if split is None else x[:split] @ x[split:].T
        nr = n if split is None else n[split:]
        good = t[1] * shared.astype(np.int64) >= t[0] * (n[:k, None] + nr[None] - shared.astype(np.int64))
        i, j = np.nonzero(good)
        j = j if split is None else j + split
        linked = [(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b or split is not None]
    return _forest(linked, m)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, gathered while their first `keys` columns stay the same; a row that comes again is left out."""
    now, held = None, []
    for b in sliced(batches):
        for r in zip(*[c.to_pylist() for c in b.columns]):
            if r[:keys] != now:
                if held:
                    yield held
                now, held = r[:keys], []
            if not held or held[-1] != r[keys:]:
                held.append(r[keys:])
    if held:
        yield held


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a.min(1)) if len(a) else a[:, 0]), pa.array(np.ascontiguousarray(a.max(1)) if len(a) else a[:, 0])], names=["a", "b"])


def _within(members: DataFrame, attach: Callable[[DataFrame], DataFrame], find: Callable, t: tuple[int, int], block: int, name: str) -> DataFrame:
    """v, label: components of the pairs that `find` links within a unit; rows without a link are missing.

    members (unit, row, m: rows of the unit, and what attach needs); attach adds n and data, which is what find compares.
    """
    needed = [c for c in members.columns if c not in ("unit", "row", "m")]
    blocks = F.ceil(F.col("m") / block).cast("int")
    laid = attach(members.select("unit", "row", F.pmod(F.xxhash64("row"), blocks).cast("int").alias("blk"), *needed))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 2):
            if len(group) > 1:
                of = find(np.array([g[1] for g in group]), [g[2] for g in group], t)
                if of:
                    yield _edges([(group[i][0], group[j][0]) for i, j in of])

    by_unit = laid.repartition("unit", "blk").sortWithinPartitions("unit", "blk", "row").select("unit", "blk", "row", "n", "data")
    edges = C.stage(by_unit.mapInArrow(inside, "a long, b long").distinct(), f"{name}-edges")
    label = components(edges)

    # Units of more than one block whose rows aren't in one component yet: those outside the largest one against all.
    wide = C.stage(members.where(blocks > 1).join(label.select(F.col("v").alias("row"), "label"), "row", "left").withColumn("label", F.coalesce("label", "row")), f"{name}-wide")
    shares = wide.groupBy("unit", "m", "label").agg(F.count("*").alias("c")).groupBy("unit", "m").agg(F.max(F.struct("c", "label")).alias("x")).where("x.c < m")
    shares = C.stage(shares.select("unit", F.col("x.label").alias("main"), (F.col("m") - F.col("x.c")).alias("out")), f"{name}-open")
    if shares.isEmpty():
        return label
    left = wide.join(shares, "unit")
    a, b = F.ceil(F.col("out") / block).cast("int"), blocks
    outer = left.where(F.col("label") != F.col("main")).select("unit", F.pmod(F.xxhash64("row"), a).cast("int").alias("ab"), F.explode(F.sequence(F.lit(0), b - 1)).alias("bb"), F.lit(0).alias("side"), "row", "label", *needed)
    inner = left.select("unit", F.explode(F.sequence(F.lit(0), a - 1)).alias("ab"), F.pmod(F.xxhash64("row"), b).cast("int").alias("bb"), F.lit(1).alias("side"), "row", "label", *needed)
    pairs = attach(outer.unionByName(inner)).repartition("unit", "ab", "bb").sortWithinPartitions("unit", "ab", "bb", "side", "row")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 3):
            split = sum(g[0] == 0 for g in group)
            if 0 < split < len(group):
                ids = [g[1] for g in group]
                of = find(np.array([g[3] for g in group]), [g[4] for g in group], t, split, np.array([g[2] for g in group]))
                if of:
                    yield _edges([(ids[i], ids[j]) for i, j in of])

    more = pairs.select("unit", "ab", "bb", "side", "row", "label", "n", "data").mapInArrow(across, "a long, b long").distinct()
    return components(C.stage(edges.unionByName(more), f"{name}-more"))


def _sets(rows: DataFrame, wanted: DataFrame, words: int, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """k, n, sig1, sig2, data: what `make` makes of the whole sets of the rows that wanted (with k) has, and of few others.

    A bit field of fixed size spares most others the way through the shuffle; equal sets of one k come once from a batch.
    """
    spark, slots = rows.sparkSession, 1 << FILTER_BITS
    word, bit = F.floor(F.pmod(F.col("k"), F.lit(slots)) / 64).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(k, {slots}) % 64 as int))")
    set_bits = wanted.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    field = np.zeros(slots // 64, np.int64)
    field[set_bits.column("w").to_numpy()] = set_bits.column("bits").to_numpy()
    known = spark.sparkContext.broadcast(np.unpackbits(field.view(np.uint8), bitorder="little"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            k = b.column(1).to_numpy()
            keep = np.nonzero(known.value[np.mod(k, slots)])[0]
            sets, k = shingle_sets(b.column(0).take(pa.array(keep)), words), k[keep]
            sig = signatures(sets)
            _, once = np.unique(np.column_stack([k, sig]), axis=0, return_index=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(k[once]), pa.array(np.fromiter((len(sets[i]) for i in once), np.int32, len(once))), pa.array(sig[once, 0]), pa.array(sig[once, 1]),
                pa.array([make(sets[i]) for i in once], pa.binary())], names=["k", "n", "sig1", "sig2", "data"])

    return rows.select("text", "k").mapInArrow(whole, "k long, n int, sig1 long, sig2 long, data binary")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, parts: int | None = None,
    frequent: int = FREQUENT, block: int = BLOCK, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """doc_id, n_shingles, component_id, k: one row per row of docs; k recognises the row again (common.row_key).

    Null and white texts have no shingles and no links: their component_id is their doc_id. Rows with equal sets are linked. component_id is
    the smallest doc_id of the rows that links reach (nulls apart). No rows in, no rows out. Other columns are not read.
    """
    spark, t = docs.sparkSession, threshold
    parts = parts or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _rows(docs, id_col, text_col)
    often = spark.sparkContext.broadcast(frequent_tokens(rows, words, t, frequent))  # MOST_FREQUENT numbers at most
    made = C.stage(index(rows, often, words, t, parts), "ngram-index")
    nodes = made.where("part is null").select("row", "doc_id", "n", "sig1", "sig2", "k", "common")
    same = ["n", "sig1", "sig2"]
    firsts = C.stage(nodes.where("n > 0").groupBy(*same).agg(F.min(F.struct("row", "k", "common")).alias("f")).select(*same, "f.row", "f.k", "f.common"), "ngram-sets")

    least = F.greatest(F.lit(TOGETHER), 1 + F.floor(F.ceil(F.col("n") * t[0] / t[1]) / 20))
    member = C.stage(memberships(made.where("part is not null").select("part", "keys", "owners", "base"), part_bytes), "ngram-members")
    enough = member.groupBy("row").agg(F.sum("rare").alias("rare")).join(firsts, "row").where(F.col("rare") + F.col("common") >= least)
    unit_size = lambda m: m.groupBy("unit").agg(F.count("*").alias("m")).where("m > 1")
    chosen = C.stage(member.select("row", "unit").join(enough.select("row"), "row"), "ngram-chosen")
    units = C.stage(unit_size(chosen), "ngram-units")
    chosen = C.stage(chosen.join(units, "unit"), "ngram-units-rows")

    # Documents are met again by key and set, for two documents may have one key. Whole sets travel only for families.
    again = ["k", *same]
    one = C.stage(chosen.select("row").distinct().join(firsts.select("row", *again), "row"), "ngram-compared")
    fields = C.stage(_sets(rows, one, words, bit_field).join(one, again).select("row", "n", "data").dropDuplicates(["row"]), "ngram-fields")
    family = _within(chosen, lambda m: m.join(fields, "row"), _hopeful, t, block, "ngram-units").withColumnsRenamed({"v": "row", "label": "unit"})
    sizes = C.stage(unit_size(family), "ngram-families")
    families = C.stage(family.join(sizes, "unit").join(one, "row").select("unit", "row", "m", *again), "ngram-families-rows")
    # Sets are made for the rows at hand: across blocks, those are the few of units that are still open.
    label = _within(families, lambda m: m.join(_sets(rows, m, words, np.ndarray.tobytes), again), _links, t, block, "ngram-sets-met")

    named = nodes.join(firsts.select(*same, F.col("row").alias("first")), same, "left").join(label.withColumnRenamed("v", "first"), "first", "left")
    named = C.stage(named.select("doc_id", "n", "k", F.coalesce("label", "first", "row").alias("label")), "ngram-named")
    least_id = C.stage(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "ngram-ids")
    return named.join(least_id, "label").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "k")
