"""Fingerprints, tokens, sharding, mixing, quality, pages and the language model against plain versions."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from hourloom.llm import bpe, fingerprints, hmm, mixing, quality, sharding, token_files, wrappers
from hourloom.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(t):
    w = WORD.findall((t or "").translate(ASCII_LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_sketch(t):
    """Spark hashes a list of words one after the other, each seeded by the hash before, from 42."""
    kept = set()
    for words in shingles(t):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        kept.add(h >> 1)
    return {h for h in kept if h < 2**61}


def test_fingerprints_of_documents(documents, texts):
    order = sorted(texts, reverse=True)
    seen = {r.doc_id: r for r in fingerprints.fingerprint_edits(documents).collect()}
    by_text = defaultdict(set)
    for k, i in enumerate(order):
        t, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        n = len(t) // 3
        edit = t[: len(t) - n] + nxt[:n]
        r = seen[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        sketches = [plain_sketch(x) for x in (t, edit, nxt)]
        assert [r.fingerprint, r.edited_fingerprint] == ["".join(f"{h:016x}" for h in sorted(x)) for x in sketches[:2]]
        assert r.near_edited == pytest.approx(jaccard(sketches[0], sketches[1])) and r.near_next == pytest.approx(jaccard(sketches[0], sketches[2]))
        if len(shingles(t)) >= 200:
            assert abs(r.near_edited - jaccard(shingles(t), shingles(edit))) < 0.25 and abs(r.near_next - jaccard(shingles(t), shingles(nxt))) < 0.25
        by_text[t].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_of_odd_rows(odd, nothing, spark):
    for buckets in (1, 7):
        got = fingerprints.fingerprint_edits(odd, buckets=buckets).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {""}
    assert fingerprints.fingerprint_edits(nothing).count() == 0
    alone = fingerprints.fingerprint_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1.0


def test_sketches_merge_and_contain(spark):
    long, short = " ".join(f"a{i}" for i in range(5000)), " ".join(f"a{i}" for i in range(300))
    other = " ".join(f"b{i}" for i in range(900))
    row = spark.createDataFrame([(long, short, other, long + " | " + other)], "l string, s string, o string, u string").select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "lsou"])
    r = row.select(fingerprints.containment(F.col("s"), F.col("l")).alias("inside"), fingerprints.containment(F.col("o"), F.col("l")).alias("outside"),
                   F.size(F.array_except(fingerprints.merged(F.col("l"), F.col("o")), F.col("u"))).alias("extra")).first()
    assert r.inside > 0.95 and r.outside < 0.05 and r.extra == 0


def test_token_files_round_trip(odd, nothing, documents, texts, tmp_path, spark):
    from tokenizers import Tokenizer

    spec = tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_str(spec)
    for docs in (odd, documents):
        path = str(tmp_path / f"t{docs.count()}")
        token_files.write_tokens(docs, path, spec)
        rows = token_files.read_tokens(spark, path).orderBy("part", "seq").collect()
        ids = [r.doc_id for r in rows]
        assert ids == sorted(ids, key=lambda i: (i is None, i)) and len(rows) == docs.count()
        want = Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in docs.select("doc_id", "text").collect())
        assert Counter((r.doc_id, tuple(r.tokens)) for r in rows) == want
        at = {(r.part, r.seq): r.start for r in token_files.starts(spark, path).collect()}
        crc = {(r.part, r.seq): r.ids_crc32 for r in token_files.checksums(spark, path).collect()}
        total = 0
        for r in rows:
            assert at[r.part, r.seq] == total and crc[r.part, r.seq] == zlib.crc32(np.array(r.tokens, "<u4").tobytes())
            total += len(r.tokens)
    some = token_files.read_tokens(spark, path, first_id=10, last_id=12, tokens=False)
    assert sorted(r.doc_id for r in some.collect()) == [10, 11, 12] and "tokens" not in some.columns
    assert token_files.token_table(nothing, spec).count() == 0


def test_pieces_are_kept_as_ranges_of_ids(monkeypatch):
    """op2: pieces are numbers and ranges of one array; those of the generation before are moved over, with the tokenizer's ids."""
    from tokenizers import Tokenizer

    pieces = token_files._Pieces()
    assert pieces.add([" a", " b"], np.array([5, 6, 7], np.int32), np.array([1, 2])).tolist() == [0, 1]
    assert pieces.find([" b", " c", " a"]).tolist() == [1, -1, 0] and pieces.ends.tolist() == [0, 1, 3]
    spec = tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_str(spec)
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    token_files.piece_encoder.cache_clear()
    encode = token_files.piece_encoder(spec)
    batches = [["a b c", " a", "b ", "x\n y", "q  z", None], ["", "a b zz", "\ta b", "a\u3000 b  c"], ["a\x1c b\x1f c", "c b a zz", "<|endoftext|> x"], []]
    for texts in batches:
        ids, n = encode(pa.array(texts, pa.string()))
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    token_files.piece_encoder.cache_clear()


def test_pieces_are_put_together_from_parts(monkeypatch):
    """op2: letters, marks and line ends go to the model, once each, and only other pieces to the whole tokenizer; ids are the library's."""
    from tokenizers import Tokenizer

    spec = tokenizer("byte_bpe_50k.json")
    tok, rows = Tokenizer.from_str(spec), []

    def spied(tokenizer_json):
        inner = real(tokenizer_json)
        return lambda texts, *made: rows.extend(t for t in texts if t) or inner(texts, *made)

    real = token_files.encoder
    monkeypatch.setattr(token_files, "encoder", spied)
    token_files.piece_encoder.cache_clear()
    encode = token_files.piece_encoder(spec)
    plain = ["Un été, déjà!", "(word) word. word,\nÀ word?%%% _a_b__ x=y;z #@& ...", "word", "a\nb.\nC", "&&& word\n&&& ~`^|"]
    odd = ["it's we'll 'tis ''", "l'été 12,5 a1 ª µm º", "x\n\ny z", "e\u0301t\u00e9 \u6f22, a\ttab", "a<|endoftext|>b <|endoftext|> <|end", "a\x00b \u2019s", "×÷ a×b"]
    for texts in (plain, odd, plain[::-1] + odd):
        ids, n = encode(pa.array(texts, pa.string()))
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
        assert texts is not plain or not rows
    token_files.piece_encoder.cache_clear()
    other = json.loads(spec)
    other["pre_tokenizer"]["add_prefix_space"] = True
    assert token_files._part_encoder(json.dumps(other)) is None


def test_bpe_equals_the_library(odd, nothing, documents):
    from tokenizers import Tokenizer

    spec = tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_str(spec)
    for docs, size in ((odd, 1000), (odd, bpe.UNIT), (documents, 50_000)):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = tok.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        got = bpe.encode_documents(docs, spec, unit_bytes=size, bucket_bytes=size, keep_ids=True).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
        assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_documents(nothing, spec).count() == 0


def test_each_distinct_word_is_encoded_once(documents, texts):
    made = bpe.units(documents.select("doc_id", "text").repartition(5), 7, 50_000)
    got = bpe.answers(made, tokenizer("word_bpe_49k.json"), 7).select("unit", "n", "encoded").collect()
    words = {w for t in texts.values() for w in WORD.findall(t)}
    assert sum(r.encoded for r in got) == len(words) < sum(r.n for r in got) and len({r.unit for r in got}) > 3


def plain_kd(points, weights, shards):
    """Shard of each point: cut along the widest dimension, relative to all points, where the lower side holds its part."""
    all_ranges = [max(1, r) for r in np.ptp(points, axis=0).tolist()]
    out = np.zeros(len(points), int)

    def split(rows, k, first):
        if k == 1 or not len(rows):
            out[rows] = first
            return
        wide = [r / a for r, a in zip(np.ptp(points[rows], axis=0).tolist(), all_ranges)]
        x = points[rows, wide.index(max(wide))]
        places = np.unique(x)
        below = np.cumsum([weights[rows][x == p].sum() for p in places])
        goal = k // 2 / k * below[-1]
        i = int(np.searchsorted(below, goal))
        i -= i > 0 and below[i] - goal > goal - below[i - 1]
        split(rows[x <= places[i]], k // 2, first)
        split(rows[x > places[i]], k - k // 2, first + k // 2)

    split(np.arange(len(points)), shards, 0)
    return out


def test_shards_equal_a_plain_tree(spark, documents):
    text, size = F.col("text"), F.octet_length("text").cast("long") + 1
    coords = F.array(*sharding.document_dimensions(text, size, F.crc32(text.cast("binary"))))
    rows = documents.where("text is not null").select("doc_id", coords.alias("coords"), size.alias("weight"))
    got = sharding.kd_tree(rows, 5, tolerance=0).toPandas()
    assert got["shard"].tolist() == plain_kd(np.array(got["coords"].tolist()), got["weight"].to_numpy(), 5).tolist()


def test_shards_are_even_and_keep_copies_together(documents, odd, nothing):
    got = sharding.kd_shards(documents, shards=8, rows_a_bucket=20).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() < 1.35 * sums.mean()  # few and long documents
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    rows = sharding.kd_shards(odd, target_bytes=100_000).toPandas()
    assert len(rows) == odd.count() and all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard")["slot"])
    assert sharding.kd_shards(nothing, shards=8).count() == 0


def test_many_equal_weights_split_evenly(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 8, "0").alias("text"))
    assert sharding.kd_shards(docs, shards=5).groupBy("shard").count().agg(F.max("count"), F.min("count")).first() == (800, 800)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free, total = {}, set(order), share * sum(sizes.values())
    while free:
        rest = total - sum(out.values())
        part = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if part[s] >= most * sizes[s]}
        if not full:
            return out | part
        out |= {s: most * sizes[s] for s in full}
        free -= full
    return out


def test_mixture_meets_its_targets(documents, odd, nothing):
    for docs in (documents, odd):
        got = mixing.mix(docs).toPandas()
        assert len(got) == docs.count()
        got["source"] = got["source"].where(got["source"].notna(), None)
        sizes = {s: int(got[got["source"].isna() if s is None else got["source"] == s]["size"].sum()) for s in set(got["source"])}
        want = targets(sizes)
        for s in sizes:
            g = got[got["source"].isna() if s is None else got["source"] == s]
            assert g["target"].iloc[0] == pytest.approx(want[s]) and g["source_size"].iloc[0] == sizes[s]
            assert abs(g["taken"].sum() - want[s]) <= g["size"].max() / 2 + 1 and (g["taken"] <= 2 * g["size"]).all()
        again = mixing.mix(docs).toPandas()
        assert Counter(zip(again["_key"], again["taken"])) == Counter(zip(got["_key"], got["taken"]))
    assert mixing.mix(nothing).count() == 0


def test_coarse_bins_take_the_same(documents):
    one = {r.doc_id: r.taken for r in mixing.mix(documents, bins=3).collect()}
    assert one == {r.doc_id: r.taken for r in mixing.mix(documents).collect()}


def test_quality_separates_held_out_documents(spark, documents, odd, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(docs, labels)
    out = quality.score(docs, model).where(quality.held_out(F.col("doc_id"))).join(labels.select("doc_id", "quality"), "doc_id").select("score", "quality").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97 and (good >= 0.7).mean() > 0.95
    scored = quality.score(odd, model)
    assert scored.columns == [c for c in odd.columns if c != "score"] + ["score"]
    rows = scored.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(nothing, model).count() == 0
    empty = quality.train(nothing, labels)
    assert {r.score for r in quality.score(odd, empty).collect()} == {0.5}


def test_trees_go_down_as_one_by_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y, trees=30)
    assert ((m.score(x) > 0.5) == (y == 1)).mean() > 0.97

    def one(row):
        total = m.start
        for f, t, v in zip(m.feature, m.threshold, m.value):
            at = 0
            for _ in range(m.depth):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(m.score(x[:50]), [one(r) for r in x[:50]])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><div class="site-menu menu"><a href=/>Home</a></div>
<div class="cookie-notice">We use cookies</div><div class="content"><h2>{title}</h2><p>First {n} &amp; <a href=x>link</a>&nbsp;more.<div class="ad">Buy {n}</div>
<p>Line<br>two</p><ul><li>a<li>b {n}</ul><form>Sign {n} up</form></div><aside>Side {n}</aside><section id="comments"><p>nice {n} comment</section><div class="footer">F {n}"""


def test_wrapper_finds_the_article():
    pages = [PAGE.format(title=f"Title {k}", n=k * 7) for k in range(5)]
    template = wrappers.unpacked(wrappers.induce(pages[:4]))
    for k, p in enumerate(pages):
        title, line, item = f"Title {k}\nFirst {k * 7} & link more.\n", "Line two\na\n", f"b {k * 7}"
        # What stands on every page is template; on a page alone nothing can be told to be.
        assert wrappers.extract(p, template) == title + item
        assert wrappers.extract(p, wrappers.unpacked(wrappers.induce([p]))) == title + line + item


def test_repeated_texts_are_template_without_telling_names():
    """On a host without telling names, alignment alone finds the slot and takes what repeats out of it."""
    page = "<div class=x1><p>Hello to our readers</p></div><div class=x2>{body}<p>All rights are with us.</p><div class=x3>Read on</div></div><div class=x4><p>Made by us</p></div>"
    bodies = [[f"Story {k} part {j} with words of its own" for j in range(2 + k % 3)] for k in range(6)]
    pages = [page.format(body="".join(f"<p>{x}</p>" for x in b)) for b in bodies]
    template = wrappers.unpacked(wrappers.induce(pages[:5]))
    assert [wrappers.extract(p, template) for p in pages] == ["\n".join(b) for b in bodies]
    copies = [pages[0] + f"<!-- {k} -->" for k in range(5)]
    same = wrappers.unpacked(wrappers.induce(copies))
    assert bodies[0][0] in wrappers.extract(copies[0], same) and "All rights" in wrappers.extract(copies[0], same)


def heaviest(a, b):
    """Plain recursive simple tree matching over all pairs of kids."""
    if a["label"] != b["label"]:
        return 0
    x, y = a["kids"], b["kids"]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + heaviest(p, q))
    return m[len(x)][len(y)] + 1


def test_alignment_equals_plain_tree_matching():
    rng = np.random.default_rng(8)

    def tree(depth):
        names = rng.permutation(6)[: rng.integers(0, 6)] if depth else []
        return {"label": "n", "kids": [tree(depth - 1) | {"label": f"n{k}"} for k in names]}

    for _ in range(200):
        a, b = tree(3), tree(3)
        pairs = wrappers.align(a, b)
        assert len(pairs) == heaviest(a, b) and all(p["label"] == q["label"] for p, q in pairs)


def plain_text(page):
    """The article of a page of the test tables, by a plain reader of tags: without names or tags of other parts."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.blocks, self.now = [], [], ""

        def flush(self):
            if text := " ".join(self.now.split()):
                self.blocks.append((text, any(m for _, _, m in self.open), any(o for _, o, _ in self.open)))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            names = set(re.split(r"[^a-z]+", " ".join(a.get(k) or "" for k in ("class", "id", "role", "itemprop")).lower()))
            if tag in wrappers.BLOCKS:
                self.flush()
                if tag in wrappers.CLOSES_P and self.open and any(t == "p" for t, _, _ in self.open):
                    at = max(i for i, x in enumerate(self.open) if x[0] == "p")
                    if not any(x[0] in wrappers.BLOCKS for x in self.open[at + 1 :]):
                        del self.open[at:]
            if tag == "br":
                self.now += " "
            elif tag not in wrappers.VOID:
                off = tag in wrappers.ASIDE_TAGS or tag in ("head", "header") or bool(names & wrappers.ASIDE_NAMES) or "hidden" in a or "none" in (a.get("style") or "")
                self.open.append((tag, off, tag in wrappers.MAIN_TAGS or bool(names & wrappers.MAIN_NAMES)))

        def handle_endtag(self, tag):
            if tag in wrappers.BLOCKS:
                self.flush()
            at = max((i for i, x in enumerate(self.open) if x[0] == tag), default=None)
            if at is not None:
                del self.open[at:]

        def handle_data(self, data):
            if not any(o for _, o, _ in self.open):
                self.now += data

    r = Reader()
    r.feed(page)
    r.flush()
    inside = [t for t, m, o in r.blocks if m]
    return "\n".join(inside or [t for t, _, _ in r.blocks])


def test_pages_equal_a_plain_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = wrappers.extract_pages(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    same = sum(r.text == plain_text(html[r.page_id] or "") for r in got)
    assert same >= 0.9 * len(got)


def test_hostile_pages_end_soon():
    import time

    began = time.monotonic()
    for page, want in (
        ("<a " * 330_000, ""), ("<p class='>x" * 20_000, None), ("<div class=ad>" * 3000 + "x", ""), ("<nav>" * 5000 + "x", ""),
        ("<div>" * 20_000 + "</span>" * 20_000 + "z", "z"), ("<b><div>" * 10_000 + "</b>" * 10_000 + "q", "q"), ("kept <!-- " + "<!-- " * 9000, "kept"),
    ):
        text = wrappers.extract(page, wrappers.unpacked(wrappers.induce([page])))
        assert want is None or text == want
    assert time.monotonic() - began < 60


def test_pages_with_odd_rows(spark):
    deep = "<div>" * 3000 + "deep"
    rows = [(1, None, None), (2, "http://h/x", ""), (3, "http://h/y", deep), (4, "http://h/z", "just text &lt; more"), (5, "bad url", "<p>a<p>b"), (5, "bad url", "<p>a<p>b"), (6, "http://h/", "<script>x")]
    got = wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("template", F.lit("clash")))
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == [(1, "", 0), (2, "", 0), (3, "deep", 4), (4, "just text < more", 16), (5, "a\nb", 3), (5, "a\nb", 3), (6, "", 0)]
    assert wrappers.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_model_counts(spark, documents, texts, odd, nothing):
    got = {r.doc_id: r for r in hmm.score_documents(documents, rounds=1).collect()}
    tokens = {i: WORD.findall(t.translate(ASCII_LOWER)) + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n = sum(c.values())
    for i, t in tokens.items():
        r = got[i]
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n) and r.base_score == pytest.approx(base)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    rows = hmm.score_documents(odd, rounds=1).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r.score) for r in rows)
    assert hmm.score_documents(nothing, rounds=1).count() == 0


def test_every_training_document_shapes_the_first_parameters(spark):
    """more documents than any sample had; one alone of them, moved, changes the model."""
    rows = [(i, i, False, np.array([1 + i % 2, 3 + i % 5, 0], np.uint16).tobytes()) for i in range(2000)]
    v = hmm.Vocabulary(["a", "b"], np.array([1000.0, 1000.0]), 2, np.ones(hmm.ENDING_CLASSES), np.ones(hmm.ENDING_CLASSES), 6000, 3, 2000)
    schema = "row long, doc_id long, held_out boolean, codes binary"
    fit = lambda rows: hmm.trained(spark.createDataFrame(rows, schema), v, states=2, rounds=0, first_rounds=2)
    whole = fit(rows)
    for k in (0, 777, 1999):
        other = [r if r[0] != k else (*r[:3], np.array([40, 41, 0], np.uint16).tobytes()) for r in rows]
        assert abs(fit(other).emit[40] - whole.emit[40]).max() > 1e-6


def test_mixture_counts_by_hand():
    rng = np.random.default_rng(4)
    k, s = 6, 3
    m = hmm.Model(rng.dirichlet(np.ones(s)), np.eye(s), rng.dirichlet(np.ones(k), s).T.copy())
    seqs = [rng.integers(0, k, n).astype(np.uint16) for n in (1, 4, 9)]
    first, emitted = np.zeros(s), np.zeros((k, s))
    for x in seqs:
        share = m.start * np.prod(m.emit[x], axis=0)
        share /= share.sum()
        first += share
        np.add.at(emitted, x, share)
    got = hmm.mixed(m, seqs)
    np.testing.assert_allclose(got[0], first)
    np.testing.assert_allclose(got[2], emitted)


def test_forward_equals_summing_over_all_paths():
    rng = np.random.default_rng(3)
    s, k = 3, 5
    m = hmm.Model(rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(k), s).T.copy())
    seqs = [np.array(x, np.uint16) for x in ([0], [1, 2, 3, 4], [4, 4, 0], [2] * 6)]
    import itertools

    for x, log in zip(seqs, hmm.log_likelihoods(m, seqs)):
        total = sum(
            m.start[p[0]] * np.prod([m.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([m.emit[c, q] for c, q in zip(x, p)])
            for p in itertools.product(range(s), repeat=len(x)))
        assert log == pytest.approx(np.log(total))
    first, moves, emitted = hmm.expected(m, seqs)
    assert first.sum() == pytest.approx(4, rel=1e-4) and moves.sum() == pytest.approx(sum(len(x) - 1 for x in seqs), rel=1e-4) and emitted.sum() == pytest.approx(14, rel=1e-4)
    better = hmm.maximised(first, moves, emitted, np.full(k, 1 / k))
    assert np.allclose([better.start.sum(), *better.move.sum(1), *better.emit.sum(0)], 1)


def test_probabilities_add_up_to_one(spark, documents):
    """Over the words and the unknown of every ending class."""
    rows = documents.select("doc_id", "text").withColumn("held_out", F.lit(False))
    counts = hmm.train_counts(rows)
    v = hmm.vocabulary(counts, 200)
    share = np.zeros(hmm.ENDING_CLASSES) + v.unknown
    for r in counts.collect():
        if r.word not in set(v.words[: v.own]):
            share[hmm._ending(r.word)] += r.n - hmm.DISCOUNT
    assert np.allclose(share, v.mass)


def test_split_words():
    from hourloom.llm.words import split_words

    ends, codes, words = split_words(pa.array([" a b\x0ba ", None, "", "B\x1cc"]), True)
    assert ends.tolist() == [0, 3, 3, 3, 4] and [words[i].as_py() for i in codes] == ["a", "b", "a", "b\x1cc"]
