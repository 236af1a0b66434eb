"""The conversation trie against plain grouping of prefixes, and the radix tree against a dict."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from hourloom.llm import prefix_trie as P
from hourloom.llm import radix

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string, seq string, n string"


def turn_key(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def plain(rows):
    """Expected rows of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, turn_key(role, text), role or "", text or ""))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for s in members:
        if s:
            children[s[:-1]] += 1
    for s, who in members.items():
        cost = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            saved[s[:d]] += cost
            leaves[s[:d]] += not children[s]
    out = Counter()
    for s, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(made[c]) == len(s)))
        out[(min(who), len(s), min(members[s[:-1]]) if s else None, len(who), children[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "k", "s", "n") for r in rows], SCHEMA).repartition(3)


def check(spark, rows, **options):
    got = Counter(tuple(r) for r in P.conversation_trie(frame(spark, rows), **options).collect())
    assert got == plain(rows)


def shared_rows(seed=0, conversations=300):
    """Many conversations that begin alike, some of them one inside another."""
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        first = 0 if rng.random() < 0.6 else rng.randrange(4)
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of  {first if t < 3 else rng.randrange(3)} x"))
    return rows


@pytest.mark.parametrize("task_bytes", [P.TASK_BYTES, 200])
def test_trie_equals_grouping(spark, task_bytes):
    check(spark, shared_rows(), task_bytes=task_bytes)


def test_odd_conversations(spark):
    rows = [
        (None, 0, "user", "nobody's"), (7, None, "user", "first"), (7, 0, None, None), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, 3, "", ""),
        (45, 1, "user", "no base: may be cut to nothing"), (47, 1, "user", "a"), (49, 1, "user", "a"), (53, 0, "user", "a"),
        (-3, 0, "user", "negative"), (0, 0, "system", "base"), (0, 5, "user", "é́ 漢字 \x1c\x85"), (2**62, 0, "user", "x" * 100_000),
        *[(100 + 20 * k, t, "user", f"same {t}") for k in range(40) for t in range(3)],
        *[(2000, t, "user", f"long {t}") for t in range(500)], *[(2020, t, "user", f"long {t}") for t in range(300)],
    ]
    check(spark, rows)
    check(spark, rows, task_bytes=1000)
    check(spark, [(45 + 40 * k, 0, "user", "gone") for k in range(60)])
    check(spark, [(3, 0, "user", "alone")])


def test_no_conversations(spark):
    assert P.conversation_trie(frame(spark, [])).count() == 0
    assert P.conversation_trie(frame(spark, [(None, 0, "user", "x")])).count() == 0


def test_the_given_conversations(spark, documents):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in P.conversation_trie(df).collect()) == plain(rows)


def test_radix_tree_equals_a_dict():
    rng = random.Random(5)
    root, kept = radix.Node(b""), {}
    for value in range(6000):
        key = bytes(rng.randrange(256 if rng.random() < 0.5 else 3) for _ in range(rng.randrange(7)))
        radix.insert(root, key, value)
        kept[key] = value
    found, sizes, waiting = {}, set(), [(root, b"")]
    while waiting:
        node, path = waiting.pop()
        sizes.add(node.size)
        assert node is root or node.value is not None or len(list(node.items())) > 1  # paths are compressed
        if node.value is not None:
            found[path] = node.value
        waiting += [(c, path + c.path) for _, c in node.items()]
    assert found == kept and sizes == set(radix.LAYOUTS)
    seen = [id(n) for n, _ in radix.bottom_up(root)]
    assert seen[-1] == id(root) and len(seen) == len(set(seen))
