"""Splitting a batch of texts into numbered words with pyarrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What counts as white space between words.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(where each text's words begin and end, each word's number, the distinct words); a null text has no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)  # white space at the ends leaves an empty word
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    coded = flat.filter(real).dictionary_encode()
    return kept[ends - ends[0]], coded.indices.to_numpy(), coded.dictionary


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: what is made of a batch is several times its size. Copies, for some of pyarrow's text functions misread a part of an array."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b if len(b) <= rows else b.take(pa.array(np.arange(i, min(len(b), i + rows))))
            pa.default_memory_pool().release_unused()


def encoder(tokenizer_json: str, words: int = 4000, chars: int = 200_000):
    """A function from texts to lists of ids; encodings, many times the size of their texts, are kept for a few texts at a time. Made inside a task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)

    def encode(texts: list[str], made=lambda ids: ids) -> list:
        out, now, size = [], [], 0
        for x in texts:
            now.append(x)
            size += len(x)
            if size >= chars or len(now) >= words:
                out += [made(e.ids) for e in tok.encode_batch_fast(now, add_special_tokens=False)]
                now, size = [], 0
        return out + [made(e.ids) for e in tok.encode_batch_fast(now, add_special_tokens=False)]

    return encode


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words seen at least as often as some count, at most `most` of them."""
    of = sorted(((r.n, r.k) for r in counts.groupBy("n").agg(F.count("*").alias("k")).where(F.col("n") >= 2).orderBy(F.desc("n")).limit(most).collect()), reverse=True)  # a row for each count
    least, words = None, 0
    for n, k in of:
        words += k
        if words > most:
            break
        least = n
    return counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
