"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, whatever the document's length, so sketches of very
unequal documents can be compared for containment and merged. What a short document keeps is left to chance: of n shingles
about n * FRACTION, and none at all with probability (1 - FRACTION) ** n.

Everything is made of SQL functions; a text is cut into words once and each of its shingles is hashed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.llm import common as C

WORDS, FRACTION = 5, 1 / 4
#: Text of one bucket in which documents meet their next ones.
BUCKET_BYTES = 32 << 20


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes, not negative, of the shingles of a lower-cased text, repeats included; fewer words than a shingle has count as one."""
    def of(w: Column) -> Column:
        last = F.size(w) - words
        many = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, words)), 1))
        return F.when(last >= 0, many).when(last > -words, F.array(F.shiftrightunsigned(F.xxhash64(w), 1))).otherwise(F.array().cast("array<long>"))

    lowered = F.translate(text, C.UPPER, C.LOWER)
    return _bind(F.filter(F.split(lowered, C.SPACE + "+"), lambda x: x != ""), of)


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """Distinct hashes below the fraction of the range, in order."""
    return F.array_sort(F.array_distinct(F.filter(shingle_hashes(text, words), lambda x: x < int(2**63 * fraction))))


def fingerprint(sketched: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.lower(F.concat_ws("", F.transform(sketched, lambda x: F.lpad(F.hex(x), 16, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1: hashes that both sketches keep over those that one keeps.

    Two empty sketches are alike (1); an empty one is unlike any other (0).
    """
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(_bind(shared, lambda n: n / (F.size(a) + F.size(b) - n)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 if a's sketch is empty."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of the union of both documents' shingles."""
    return F.array_sort(F.array_union(a, b))


def with_next(docs: DataFrame, made: dict[str, Column], *, buckets: int | None = None) -> DataFrame:
    """doc_id, text and the columns `made` of text, each also of the next document (next_...) in descending doc_id.

    After the last document comes the first. Rows with one doc_id come in order of their text's hash; null ids come last.

    Documents go once over a shuffle, to the bucket of their range of ids; a bucket's first document is also sent to the bucket before, as
    the end of its last one. Ranges are cut at quantiles; where one id has many rows, they are spread by their hash.
    """
    spark = docs.sparkSession
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, -(-size // BUCKET_BYTES))
    low = F.lit(-(2**63))
    rows = docs.select("doc_id", "text", F.bitwise_not(F.coalesce(F.col("doc_id"), low)).alias("_o"), F.xxhash64("text").alias("_h"))
    steps = [i / buckets for i in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx("_o", steps, 100 * buckets)).first()[0] if steps else []  # one number a bucket
    below, upto = (F.size(F.filter(F.lit(cuts or []).cast("array<long>"), f)) for f in (lambda c: c < F.col("_o"), lambda c: c <= F.col("_o")))
    share = (F.col("_h") / F.lit(2.0**64)) + 0.5
    placed = rows.withColumn("_b", (below + F.floor(F.least(share, F.lit(1 - 2**-40)) * (upto - below + 1))).cast("int"))
    firsts = placed.groupBy("_b").agg(F.min(F.struct("_o", "_h")).alias("f")).orderBy("_b").collect()  # one row a bucket
    before = {}
    for i, r in enumerate(firsts):
        before[(r.f["_o"], r.f["_h"])] = firsts[i - 1]["_b"]
    ghost = spark.createDataFrame([(o, h, b) for (o, h), b in before.items()], "_o long, _h long, _to int")
    # As many rows as there are buckets.
    sent = placed.join(F.broadcast(ghost), ["_o", "_h"], "left").withColumn("_place", F.explode(F.when(
        F.col("_to").isNull(), F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("g")))).otherwise(
        F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("g")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("g"))))))
    dealt = sent.select("doc_id", "text", "_o", "_h", F.col("_place.b").alias("_b"), F.col("_place.g").alias("_g")).repartition("_b")
    ready = dealt.select("*", *[c.alias(n) for n, c in made.items()])
    order = W.partitionBy("_b").orderBy("_g", "_o", "_h")
    return ready.select("doc_id", "text", "_g", *made, *[F.lead(n).over(order).alias(f"next_{n}") for n in ("text", *made)]).where("_g = 0").drop("_g")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third (rounded down) replaced by the beginning of the following text."""
    n = F.char_length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per row of docs.

    Null texts count as empty; they have an empty fingerprint. A single document is its own next one. No rows in, no rows out.
    """
    both = with_next(C.id_rows(docs, id_col, text_col), {"sk": sketch(F.col("text"))}, **options)
    cut = both.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "sk", "next_sk", edited(F.col("text"), F.col("next_text")).alias("edit"))
    made = cut.select("*", sketch(F.col("edit")).alias("esk"))
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("sk")).alias("fingerprint"),
        fingerprint(F.col("esk")).alias("edited_fingerprint"), likeness(F.col("sk"), F.col("esk")).alias("near_edited"), likeness(F.col("sk"), F.col("next_sk")).alias("near_next"))
