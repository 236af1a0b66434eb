"""BPE encoding and decoding through a table of distinct words.

Words are what stands between white space. Documents are read in units of a few megabytes; a unit numbers its distinct words.
The words go, packed by bucket of their hash, to the one task that owns the bucket; there each distinct word of the corpus is
encoded once. The ids go back to the unit, in the order in which its words are numbered, and meet its documents, which
are word numbers by then. A unit joins the ids of its distinct words with the vocabulary's pieces, a table of fixed size.

Texts aren't moved, and a word that all documents have counts once a unit. Word numbers are made in a second reading of the
documents and not written in between, so documents must be a written table or a scan, which reads the same twice; checksums tell if not.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm import common as C
from hourloom.llm.words import encoder, sliced, split_words

#: Bytes of text after which a unit ends, and bytes of text for each bucket of words.
UNIT, BUCKET = 2**24, 2**24
#: A unit's row with its documents (bucket -1) has their ids, ends and word numbers and its words' checksums; its rows with words
#: have n words or, once answered, the ids of n words. `encoded` counts the words that were encoded for this row.
UNITS = "unit long, bucket int, n long, size long, packed binary, check long, encoded int, doc_ids array<long>, ends array<long>, checks array<long>"
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3]
NAMES = [x.split()[0] for x in UNITS.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=NAMES)


def _packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True) if size else b""


def load(path: str) -> str:
    """A tokenizer's JSON, without truncation and padding. Read once, by the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return json.dumps(spec | {"truncation": None, "padding": None})


def pieces(tokenizer_json: str) -> list[str]:
    """The piece of each id, added tokens included; ids without a piece have an empty one."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True)
    table = [""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        table[i] = piece
    return table


def units(docs: DataFrame, buckets: int, unit_bytes: int = UNIT, documents: bool = False) -> DataFrame:
    """Documents (doc_id, text) as rows of UNITS: of their words or of the documents. A unit's words are numbered by bucket, then by code point."""
    def packed(unit: int, parts: list[tuple]) -> pa.RecordBatch:
        together = pa.chunked_array([p[3] for p in parts]).combine_chunks().cast(pa.string()).dictionary_encode()
        words = together.dictionary
        hashed = pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False) if len(words) else np.zeros(0, np.uint64)
        bucket = (hashed % np.uint64(buckets)).astype(np.int32)
        order = pc.sort_indices(pa.table({"b": bucket, "w": words}), sort_keys=[("b", "ascending"), ("w", "ascending")]).to_numpy()
        here, start = np.unique(bucket[order], return_index=True)
        words = words.take(pa.array(order))
        blobs = ["\n".join(words.slice(x, y - x).to_pylist()).encode() for x, y in zip(start, [*start[1:], len(words)])]
        if not documents:
            counts = np.diff([*start, len(words)])
            return _rows([(unit, b, n, len(t), _packed(t), zlib.crc32(t), None, None, None, None) for b, n, t in zip(here.tolist(), counts.tolist(), blobs)])
        number = np.empty(len(words), np.uint32)
        number[order] = np.arange(len(words), dtype=np.uint32)
        number = number[together.indices.to_numpy()]  # of each part's own words, one part after the other
        codes, ends, ids, base, length = [], [np.zeros(1, np.int64)], [], 0, 0
        for doc_ids, to, at, own in parts:
            codes.append(number[base + at])
            ends.append(to[1:] + length)
            ids += doc_ids.to_pylist()
            base, length = base + len(own), length + len(at)
        return _rows([(unit, -1, len(words), 4 * length, _packed(np.concatenate(codes).tobytes()), None, None, ids, np.concatenate(ends), [zlib.crc32(t) for t in blobs])])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for b in sliced(batches, 500):
            parts.append((b.column(0), *split_words(b.column(1), lower=False)))
            size += pc.sum(pc.binary_length(b.column(1))).as_py() or 0
            if size >= unit_bytes:
                yield packed(unit, parts)
                unit, parts, size = unit + 1, [], 0
        if parts:
            yield packed(unit, parts)

    return docs.mapInArrow(numbered, UNITS)


def answers(unit_words: DataFrame, tokenizer_json: str, buckets: int) -> DataFrame:
    """Rows of words -> rows of their ids: 32-bit numbers, first how many ids each word has, then all the ids.

    A bucket is in one task, which encodes each of its words once.
    """
    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_json)
        known: dict[str, list[int]] = {}
        for b in batches:
            for r in b.select(NAMES[:6]).to_pylist():
                words = _unpacked(r["packed"], r["size"]).decode().split("\n")
                new = [w for w in words if w not in known]
                known.update(zip(new, encode(new)))
                ids = [known[w] for w in words]
                numbers = np.fromiter(chain(map(len, ids), chain.from_iterable(ids)), np.uint32)
                yield _rows([(r["unit"], r["bucket"], r["n"], 4 * len(numbers), _packed(numbers.tobytes()), r["check"], len(new), None, None, None)])

    return unit_words.repartition(buckets, "bucket").mapInArrow(answered, UNITS)


def encode_documents(
    docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT, bucket_bytes: int = BUCKET, keep_ids: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with keep_ids): one row per row of docs.

    ids_sha256 is of the ids in decimal with a space between, decoded_sha256 of their pieces with a space between, which is how the
    library decodes where a tokenizer file names no decoder. Null and white texts have no ids. No rows in, no rows out.
    """
    rows = C.id_rows(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = 1 + size // bucket_bytes
    met = units(rows, buckets, unit_bytes, documents=True).unionByName(answers(units(rows, buckets, unit_bytes), tokenizer_json, buckets))
    table = docs.sparkSession.sparkContext.broadcast(pieces(tokenizer_json))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def replaced(unit: pa.Table) -> pa.Table:
        own, *words = unit.sort_by("bucket").to_pylist()
        if own["bucket"] != -1 or own["checks"] != [r["check"] for r in words]:
            raise RuntimeError("documents came in another order when they were read again; pass a written table")
        numbers = [np.frombuffer(_unpacked(r["packed"], r["size"]), np.uint32) for r in words]
        length = np.concatenate([x[: r["n"]] for x, r in zip(numbers, words)] or [np.zeros(0, np.uint32)]).astype(np.int64)
        ids = np.concatenate([x[r["n"] :] for x, r in zip(numbers, words)] or [np.zeros(0, np.uint32)])
        to = np.cumsum(length)
        digits, piece = np.array([str(i) for i in range(len(table.value))], object), np.array(table.value, object)
        as_ids, as_text = np.empty(len(length), object), np.empty(len(length), object)
        for filled, names_of in ((as_ids, digits), (as_text, piece)):
            flat = names_of[ids].tolist()
            filled[:] = [" ".join(flat[x:y]) for x, y in zip((to - length).tolist(), to.tolist())]
        solid = bool((length > 0).all())
        codes, ends = np.frombuffer(_unpacked(own["packed"], own["size"]), np.uint32), own["ends"]
        out: list[list] = [[] for _ in names]
        for doc, x, y in zip(own["doc_ids"], ends[:-1], ends[1:]):
            here = codes[x:y]
            i, t = as_ids[here].tolist(), as_text[here].tolist()
            i, t = (" ".join(i), " ".join(t)) if solid else (" ".join(filter(None, i)), " ".join(filter(None, t)))
            made = (doc, int(length[here].sum()), hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), list(map(int, i.split())) if keep_ids else None, t)
            for column, value in zip(out, made):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        return pa.table([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return met.groupBy("unit").applyInArrow(replaced, schema)
