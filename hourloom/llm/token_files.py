"""Token ids as Parquet list columns.

Documents are put in order of their id, encoded, and written as a list column: dictionary-encoded, in row groups of a
set size, with page indexes. A reader that wants few documents skips row groups and pages by doc_id; one that wants only
lengths and places reads none of the ids.

Encoding uses a table of the distinct pieces between single spaces: the byte-level pattern never matches across such a space, so
a text's ids are those of its pieces, each with the space before it. Texts with double spaces or spaces at an end go to the
tokenizer whole. Pieces of letters, marks and single line ends are cut further, where the pattern always cuts them, and their
parts go to the tokenizer's model.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.llm import common as C
from hourloom.llm.words import encoder, sliced
from hourloom.session import stage_root

ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 256 << 10
#: Pieces that a task remembers from batch to batch.
REMEMBERED = 300_000
#: New pieces that go to the tokenizer in one row.
IN_A_ROW = 500
# A space as byte-level vocabularies write it; texts that are not to be cut at spaces.
SPACE_BYTE = "\u0120"
UNSAFE = r"^ | $|  |^$|[\t-\r\x{85}\p{Z}] [\t-\r\x{85}\p{Z}]"
WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
SPACE_AT_ENDS = rf"\A{WHITE}|{WHITE}\z"
# Letters and marks (no apostrophe, which may open a contraction) whose kind is beyond doubt; the parts of a piece, and pieces of nothing else.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]+"
PART = rf" ?{LETTERS}| ?{MARKS}|\n"
OF_LETTERS = rf"\A ?{LETTERS}\z"
OF_PARTS = rf"\A ?(?:{LETTERS}|{MARKS})+(?:\n(?:{LETTERS}|{MARKS})+)*\z"
#: Parts that go to the tokenizer's model before their ids are put into an array.
PARTS_AT_A_TIME = 4000
END_ID = 0


class _Pieces:
    """Pieces by number, and the ids of all of them in one array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def find(self, names: list[str]) -> np.ndarray:
        """Each name's number, -1 if unknown."""
        return np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The names' numbers from now on."""
        first = len(self.ends) - 1
        self.number.update(zip(names, range(first, first + len(names))))
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return first + np.arange(len(names))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each range, one range after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _part_encoder(tokenizer_json: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None:
    """A function from parts of pieces to the ids of all and how many each has, by the tokenizer's model alone.

    None, if the tokenizer changes texts first or cuts them by another pattern than the byte-level one.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    cuts = json.loads(tokenizer_json)
    by = cuts.get("pre_tokenizer") or {}
    if cuts.get("normalizer") or by.get("type") != "ByteLevel" or by.get("add_prefix_space") or not by.get("use_regex", True):
        return None
    tokenize, id_of = Tokenizer.from_str(tokenizer_json).model.tokenize, attrgetter("id")
    bytewise, char = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), np.zeros(256, "<u4")
    for c in map(chr, range(256)):  # all bytes of the parts' characters, as byte-level vocabularies write them
        char[list(c.encode())] = [ord(x) for x in bytewise.pre_tokenize_str(c)[0][0]]

    def ids_of(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i in range(0, len(parts), PARTS_AT_A_TIME):
            written = char[np.frombuffer("\0".join(parts[i : i + PARTS_AT_A_TIME]).encode(), np.uint8)].tobytes().decode("utf-32-le")
            tokens = list(map(tokenize, written.split(chr(char[0]))))
            ids.append(np.fromiter(map(id_of, chain.from_iterable(tokens)), np.int32))
            sizes.append(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        return np.concatenate(ids), np.concatenate(sizes)

    return ids_of


@lru_cache(maxsize=1)
def piece_encoder(tokenizer_json: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to the ids of all, one text after the other, and how many each has; for byte-level tokenizers.

    Made inside a task, and kept by the worker process for its next ones. Texts are cut at single spaces, where a tokenizer of this kind always cuts,
    and each distinct piece is encoded once. New pieces are put together from their parts, each of which is encoded once as well. Others go
    in long rows to the tokenizer; an id whose piece opens with a space begins the next one. Texts with white space on both sides of a space
    are encoded whole.
    """
    ids_of, ids_of_parts, parts_of = encoder(tokenizer_json), _part_encoder(tokenizer_json), re.compile(PART).findall
    vocabulary = json.loads(tokenizer_json)["model"]["vocab"]
    added = [token["content"] for token in json.loads(tokenizer_json).get("added_tokens") or []]
    opens = np.zeros(max(vocabulary.values()) + 1, bool)
    opens[[i for token, i in vocabulary.items() if token.startswith(SPACE_BYTE)]] = True
    known, older = _Pieces(), _Pieces()

    def each_alone(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        made = ids_of(texts, lambda ids: np.array(ids, np.int32))
        return np.concatenate([np.empty(0, np.int32), *made]), np.fromiter(map(len, made), np.int64, len(made))

    def recall(names: list[str]) -> np.ndarray:
        """The names' numbers, -1 of new ones; what only the older pieces have is taken over."""
        at = known.find(names)
        missing = at < 0
        if older.number and missing.any():
            rest = list(compress(names, missing.tolist()))
            before = older.find(rest)
            again = before >= 0
            begin, size = older.ends[before[again]], older.ends[before[again] + 1] - older.ends[before[again]]
            at[np.flatnonzero(missing)[again]] = known.add(list(compress(rest, again.tolist())), older.ids[_ranges(begin, size)], size)
        return at

    def add_parts(parts: list[str]) -> np.ndarray:
        return known.add(parts, *ids_of_parts(parts))

    def learn(names: list[str], alone: np.ndarray) -> np.ndarray:
        """The names' numbers."""
        if ids_of_parts is None or not names:
            return learn_others(names, alone)
        number, all_names = np.empty(len(names), np.int64), pa.array(names, pa.large_string())
        matches = lambda of: pc.match_substring_regex(all_names, of).to_numpy(zero_copy_only=False)
        words, cut = matches(OF_LETTERS), matches(OF_PARTS)
        for token in added:  # found in a text before it is cut
            cut &= ~pc.match_substring(all_names, token).to_numpy(zero_copy_only=False)
        words &= cut
        cut &= ~words
        number[words] = add_parts(list(compress(names, words.tolist())))
        if cut.any():
            joint = list(compress(names, cut.tolist()))
            parts = list(map(parts_of, joint))
            many = np.fromiter(map(len, parts), np.int64, len(parts))
            coded = pa.array(list(chain.from_iterable(parts)), pa.large_string()).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            at = recall(distinct)
            at[at < 0] = add_parts(list(compress(distinct, (at < 0).tolist())))
            at = at[coded.indices.to_numpy()]
            begin, size = known.ends[at], known.ends[at + 1] - known.ends[at]
            sizes = np.add.reduceat(size, np.cumsum(many) - many)
            number[cut] = known.add(joint, known.ids[_ranges(begin, size)], sizes)
        others = ~(words | cut)
        number[others] = learn_others(list(compress(names, others.tolist())), alone[others])
        return number

    def learn_others(names: list[str], alone: np.ndarray) -> np.ndarray:
        """The numbers of names that go to the whole tokenizer."""
        number = np.empty(len(names), np.int64)
        by_itself = list(compress(names, alone.tolist()))
        number[alone] = known.add(by_itself, *each_alone(by_itself))
        rest = list(compress(names, (~alone).tolist()))
        ids, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i in range(0, len(rest), IN_A_ROW):
            few = rest[i : i + IN_A_ROW]
            row = np.array(ids_of(["".join(few)])[0], np.int32)
            at = np.flatnonzero(opens[np.minimum(row, len(opens) - 1)])
            row, size = (row, np.diff(at, append=len(row))) if len(at) == len(few) else each_alone(few)
            ids.append(row)
            sizes.append(size)
        number[~alone] = known.add(rest, np.concatenate(ids), np.concatenate(sizes))
        return number

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nonlocal known, older
        if len(known.number) > REMEMBERED:
            known, older = _Pieces(), known
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.invert(pc.match_substring_regex(texts, UNSAFE)).to_numpy(zero_copy_only=False)
        whole, whole_size = each_alone(texts.filter(pa.array(~plain)).to_pylist())
        pieces = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        ends = pieces.offsets.to_numpy()
        ends = ends - ends[0]
        coded = pieces.flatten().dictionary_encode()
        # Number 2k is a piece after a space, 2k + 1 the same piece at a text's start.
        number = coded.indices.to_numpy().astype(np.int64) * 2
        number[ends[:-1]] += 1
        place = np.bincount(number, minlength=2 * len(coded.dictionary))
        used = np.nonzero(place)[0]
        place[used] = np.arange(len(used))
        distinct = coded.dictionary.take(pa.array(used // 2))
        names = pc.binary_join_element_wise(pa.array([" ", ""], pa.large_string()).take(pa.array(used % 2)), distinct, pa.scalar("", pa.large_string())).to_pylist()
        at = recall(names)
        new = at < 0
        alone = (used % 2 == 1) | pc.match_substring_regex(distinct, SPACE_AT_ENDS).to_numpy(zero_copy_only=False)
        at[new] = learn(list(compress(names, new.tolist())), alone[new])

        # Texts as numbers of pieces, a whole text being one piece; pieces as ranges of one array of ids.
        ids = np.concatenate([known.ids, whole])
        begin = np.concatenate([known.ends[at], len(known.ids) + np.cumsum(whole_size) - whole_size])
        size = np.concatenate([known.ends[at + 1] - known.ends[at], whole_size])
        many = np.ones(len(texts), np.int64)
        many[plain] = np.diff(ends)
        cut = np.repeat(plain, many)
        number_of = np.empty(len(cut), np.int64)
        number_of[cut] = place[number]
        number_of[~cut] = len(names) + np.arange(len(whole_size))
        each = size[number_of]
        totals = np.add.reduceat(each, np.cumsum(many) - many) if len(many) else many
        return ids[_ranges(begin[number_of], each)], totals

    return encode


def write_tokens(
    docs: DataFrame, path: str, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
) -> None:
    """Writes doc_id, part, seq, n_tokens, tokens in ascending order of doc_id (nulls last); part and seq count files and rows in them.

    Every text (null: empty) ends with end_id. Rows with one doc_id come in order of their text's hash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_or_empty(text_col).alias("text"))
    keys = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = rows.select("doc_id", "text", keys[1].alias("_h"), keys[2].alias("_r")).repartitionByRange(keys[0], "_h", "_r")
    ordered = ordered.sortWithinPartitions(keys[0], "_h", "_r").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seq = piece_encoder(tokenizer_json), 0
        for b in sliced(batches):
            ids, n = encode(b.column(1))
            ends = np.cumsum(n + 1)
            flat = np.full(len(ids) + len(n), end_id, np.int32)
            inner = np.ones(len(flat), bool)
            inner[ends - 1] = False
            flat[inner] = ids
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.arange(seq, seq + len(n))), pa.array(n + 1), lists], names=["doc_id", "part", "seq", "n_tokens", "tokens"])
            seq += len(n)

    (
        ordered.mapInArrow(encoded, "doc_id long, part int, seq long, n_tokens long, tokens array<int>")
        .write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", "true").option("compression", "zstd").parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, *, first_id: int | None = None, last_id: int | None = None, tokens: bool = True) -> DataFrame:
    """Documents of a range of ids; without tokens, none of the id pages is read."""
    rows = spark.read.parquet(path)
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    return rows if tokens else rows.drop("tokens")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, seq, n_tokens, start: how many ids stand before each document. Reads no ids.

    First the files' sums are added up (a row per file), then the rows of each file.
    """
    rows = read_tokens(spark, path, tokens=False)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = files.select("part", (F.sum("_n").over(W.orderBy("part")) - F.col("_n")).alias("_before"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return rows.withColumn("_in", inside).join(before, "part").withColumn("start", F.col("_before") + F.col("_in")).drop("_in", "_before")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, ids_crc32 of the ids read back, as little-endian unsigned 32-bit numbers."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ends = lists.offsets.to_numpy()
            flat = np.ascontiguousarray(lists.values.to_numpy().astype("<u4"))
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64())], names=["part", "seq", "ids_crc32"])

    return spark.read.parquet(path).select("part", "seq", "tokens").mapInArrow(summed, "part int, seq long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_json: str, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: written to the shared folder, and read back. No rows in, no rows out."""
    spark = docs.sparkSession
    path = f"{stage_root(spark)}/llm-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_json, **options)
    return starts(spark, path).join(checksums(spark, path), ["part", "seq"]).select("doc_id", "start", "n_tokens", "ids_crc32")
