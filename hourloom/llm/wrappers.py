"""HTML extraction by wrapper induction.

The DOM trees of a few pages of a host are aligned by simple tree matching. Texts that stand at the same node on all of them become the
host's template, at every depth and paragraphs included; nodes whose text varies become slots; the slot that holds most of the varying
text that is neither links nor a menu, header, advert or the like is where the host keeps its articles. Each page is then aligned with
its host's template, and what the slot holds beside the template's texts is taken.

Runs of equal siblings (the paragraphs of an article) count as one node in the alignment, so that trees stay small; the texts of
its members are still told apart. Parsing and alignment take a page's length times a logarithm, whatever its nesting, and don't recurse.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm import common as C

#: Pages of a host that its template is made of, at most; pages a text must stand on to be template.
PAGES, REPEATS = 8, 3
#: Where less than this share of the text varies, a host's pages are copies of one article, and nothing in them is template.
VARYING = 0.1

# What HTML and common usage give these names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math title head object".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ASIDE_TAGS = frozenset("nav footer aside form button select menu dialog".split()) | RAW
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu "
    "modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related reply replies respond share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
MAIN_TAGS, MAIN_NAMES = ("article", "main"), frozenset(("article", "articlebody", "main", "content", "entry", "post", "story"))

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_PLAIN = re.compile(r"[^>\"']*")
_NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "hidden", "kids")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kids, self.hidden = tag, [], False
        self.names: frozenset[str] = frozenset()
        if "=" in attributes or "hidden" in attributes:
            found = set()
            for m in _NAMES.finditer(attributes):
                kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if kind == "style":
                    self.hidden |= "display:none" in value.replace(" ", "")
                elif kind in ("hidden", "aria-hidden"):
                    self.hidden |= kind == "hidden" or value == "true"
                else:
                    found.update(x for x in re.split(r"[^a-z]+", value) if x)
            self.names = frozenset(found)

    @property
    def label(self) -> str:
        return self.tag + "".join(f".{x}" for x in sorted(self.names))

    def aside(self) -> bool:
        """A menu, footer, advert, form and so on, by its tag or names."""
        return self.hidden or self.tag in ASIDE_TAGS or bool(self.names & ASIDE_NAMES)


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(text before, tag in lower case with / in front of a closing one, attributes, end) for each tag; comments have the tag ''.

    A > inside quotes doesn't end a tag. From the first tag on whose quotes never close, quotes count for nothing, so that a page is read
    once. A tag that the page's end cuts off is left out. What a reader sends back is the place to go on from.
    """
    pos, quotes = 0, True
    while m := _OPEN.search(page, pos):
        start, end = m.start(), -1
        if m[2] is None:
            close = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(close, m.end())
            end = end + len(close) if end >= 0 else -1
        elif quotes:
            end = _PLAIN.match(page, m.end()).end()
            while end < len(page) and page[end] != ">":
                end = page.find(page[end], end + 1)
                if end < 0:
                    break
                end = _PLAIN.match(page, end + 1).end()
            quotes = 0 <= end < len(page)
            end = end + 1 if quotes else -1
        if end < 0 and m[2]:
            end = page.find(">", m.end()) + 1 or -1
        if end < 0:
            yield page[pos:start], "", "", len(page)
            return
        back = yield page[pos:start], (m[1] + m[2].lower() if m[2] else ""), (page[m.end() : end - 1] if m[2] else ""), end
        pos = end if back is None else back
    yield page[pos:], "", "", len(page)


def parse(page: str) -> Node:
    """The page's tree; texts keep their character references. Unclosed and stray tags are tolerated."""
    root = Node("#root")
    path = [root]  # open nodes
    places: dict[str, list[int]] = {}  # where in the path a tag is open
    walls: list[int] = []  # where blocks are

    def close(upto: int) -> None:
        while len(path) > upto:
            tag = path.pop().tag
            places[tag].pop()
            if tag in BLOCKS:
                walls.pop()

    def close_own(tags: set[str], fence: set[str]) -> None:
        """Ends the innermost open node of these tags, unless another block but a paragraph lies between."""
        for i in reversed(walls):
            tag = path[i].tag
            if tag in tags:
                return close(i)
            if tag != "p" or tag in fence:
                return None
        return None

    reader = tokens(page)
    token = next(reader, None)
    while token:
        before, tag, attributes, end = token
        back = None
        if before:
            path[-1].kids.append(before)
        if tag.startswith("/"):
            tag = tag[1:]
            if places.get(tag):
                i = places[tag][-1]
                if tag in BLOCKS or not (walls and walls[-1] > i):
                    close(i)
        elif tag:
            if tag in CLOSES_P:
                close_own({"p"}, {"table", "body"})
            if tag == "option":
                if places.get(tag) and not (walls and walls[-1] > places[tag][-1]):
                    close(places[tag][-1])
            elif tag in SAME:
                close_own(SAME[tag], {"ul", "ol", "dl", "table", "menu"})
            node = Node(tag, attributes)
            path[-1].kids.append(node)
            if tag in RAW:
                if tag != "head":
                    over = _RAW_END[tag].search(page, end)
                    back = over.end() if over else len(page)
            elif tag not in VOID and not attributes.endswith("/"):
                if tag in BLOCKS:
                    walls.append(len(path))
                places.setdefault(tag, []).append(len(path))
                path.append(node)
        try:
            token = reader.send(back)
        except StopIteration:
            token = None
    return root


def blocks(node: Node, skip) -> list[str]:
    """Texts of the blocks under a node in page order, without nodes for which skip(node); white space is one space."""
    out: list[str] = []
    now: list[str] = []

    def flush():
        if now:
            text = _WHITE.sub(" ", entities.unescape("".join(now))).strip()
            if text:
                out.append(text)
            now.clear()

    stack: list = [iter(node.kids)]
    open_nodes = [node]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if open_nodes.pop().tag in BLOCKS:
                flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag in ("br", "wbr"):
            now.append(" " if x.tag == "br" else "")
        elif not skip(x):
            if x.tag in BLOCKS:
                flush()
            stack.append(iter(x.kids))
            open_nodes.append(x)
        elif x.tag in BLOCKS:
            flush()
    flush()
    return out


def _clean(pieces: list[str]) -> str:
    return _WHITE.sub(" ", entities.unescape("".join(pieces))).strip()


def outline(root: Node) -> dict:
    """The tree that is aligned. Equal siblings are one node, inline markup belongs to its block.

    A node has its label, tag, whether it is aside, its kids, its members in the page, for each of them its own text and whether it
    is without blocks, and the length of the text in links.
    """
    top = _part(root)
    todo = [top]
    while todo:
        here = todo.pop()
        groups: dict[str, dict] = {}
        for member in here["nodes"]:
            pieces, leaf = [], True
            inner = [] if member.tag in RAW else [(x, False) for x in reversed(member.kids)]
            while inner:
                x, link = inner.pop()
                if isinstance(x, str):
                    pieces.append(x)
                    here["links"] += len(x) if link and not x.isspace() else 0
                elif x.tag in BLOCKS or x.aside():
                    leaf = False
                    label = x.label
                    if label in groups:
                        groups[label]["nodes"].append(x)
                    else:
                        groups[label] = _part(x)
                elif x.tag not in RAW:
                    inner.extend((k, link or x.tag == "a") for k in reversed(x.kids))
            here["texts"].append(_clean(pieces))
            here["leaf"].append(leaf)
        here["kids"] = list(groups.values())
        todo += here["kids"]
    return top


def _part(node: Node) -> dict:
    return {"label": node.label, "tag": node.tag, "aside": node.aside(), "kids": [], "nodes": [node], "texts": [], "leaf": [], "links": 0}


def align(a: dict, b: dict) -> list[tuple[dict, dict]]:
    """Simple tree matching: the pairs of the most nodes that two trees share with roots, order and parents kept."""
    if a["label"] != b["label"]:
        return []
    pairs, below = [(a, b)], []
    for x, y in pairs:  # grows; siblings of one tree have labels of their own
        place = {k["label"]: j for j, k in enumerate(y["kids"])}
        below.append([])
        for k in x["kids"]:
            j = place.get(k["label"])
            if j is not None:
                below[-1].append((len(pairs), j))
                pairs.append((k, y["kids"][j]))
    size = [1] * len(pairs)
    for i in range(len(pairs) - 1, -1, -1):
        below[i] = _heaviest(below[i], size)
        size[i] += sum(size[k] for k in below[i])
    found = [0]
    for i in found:
        found += below[i]
    return [pairs[i] for i in found]


def _heaviest(kids: list[tuple[int, int]], size: list[int]) -> list[int]:
    """Of (pair, place) the pairs of the heaviest run with rising places, over a tree of running maxima."""
    if all(x[1] < y[1] for x, y in zip(kids, kids[1:])):
        return [k for k, _ in kids]
    rank = {j: r for r, j in enumerate(sorted({j for _, j in kids}), 1)}
    best: list[tuple] = [(0, None)] * (len(rank) + 1)

    def upto(r: int) -> tuple:
        top = best[0]
        while r:
            top = best[r] if best[r][0] > top[0] else top
            r -= r & -r
        return top

    for k, j in kids:
        before = upto(rank[j] - 1)
        now, r = (before[0] + size[k], (k, before[1])), rank[j]
        while r < len(best):
            best[r] = now if now[0] > best[r][0] else best[r]
            r += r & -r
    run, last = [], upto(len(rank))[1]
    while last:
        run.append(last[0])
        last = last[1]
    return run[::-1]


def _walk(top: dict) -> list[dict]:
    """A tree's nodes, parents first."""
    nodes = [top]
    for t in nodes:
        nodes += t["kids"]
    return nodes


def induce(pages: list[str]) -> list[list]:
    """A host's template, parents first: [label, number of the parent, texts that are template, 1 for the slot]."""
    trees = {}
    for page in pages:
        tree = outline(parse(page))
        said, todo = [], [tree]
        for t in todo:
            said += t["texts"]
            todo += [k for k in t["kids"] if not k["aside"]]
        trees.setdefault(tuple(sorted(said)), tree)  # pages that say the same count once
    template: dict = {}
    for tree in trees.values():
        if not template:
            template = _fresh(tree)
        _add(template, tree)
    if not template:
        return []
    total = _settle(template, True)
    if total < VARYING * sum(t["mass"] for t in _walk(template) if not t["off"]):
        total = _settle(template, False)
    _slot(template, total)["slot"] = 1
    nodes = _walk(template)
    number = {id(k): n for n, t in enumerate(nodes) for k in t["kids"]}
    return [[t["label"], number.get(id(t), -1), sorted(t["constant"]), t.get("slot", 0)] for t in nodes]


def _fresh(tree: dict) -> dict:
    """An empty template node."""
    return {"label": tree["label"], "tag": tree["tag"], "aside": tree["aside"], "pages": 0, "seen": {}, "mass": 0, "kids": []}


def _add(template: dict, tree: dict) -> None:
    """Counts a page's texts in at the nodes it shares with the template; nodes that only some pages have are added."""
    todo = [align(template, tree)]
    for pairs in todo:
        met = {id(q) for _, q in pairs}
        for p, q in pairs:
            p["pages"] += 1
            p["mass"] += max(0, sum(map(len, q["texts"])) - q["links"])
            for text in set(q["texts"]):
                p["seen"][text] = p["seen"].get(text, 0) + 1
            for k in q["kids"]:
                if id(k) not in met:
                    p["kids"].append(_fresh(k))
                    todo.append([(p["kids"][-1], k)])


def _settle(template: dict, repeated: bool) -> int:
    """Marks template texts and nodes off the article, and sums up the varying text at and below each node; returns the whole."""
    template["off"] = template["aside"]
    nodes = _walk(template)
    for t in nodes:
        t["constant"] = {x for x, n in t["seen"].items() if x and repeated and n == t["pages"] >= REPEATS}
        t["varying"] = 0 if t["off"] else max(0, t["mass"] - t["pages"] * sum(map(len, t["constant"])))
        for k in t["kids"]:
            k["off"] = t["off"] or k["aside"] or k["tag"] in ("header", "head")
    for t in reversed(nodes):
        t["varying"] += sum(k["varying"] for k in t["kids"])
    return template["varying"]


def _slot(template: dict, total: int) -> dict:
    """The innermost node named as an article that holds half of the varying text; else the smallest that holds most of it."""
    slot, todo = None, [template] if total else []
    while todo:
        t = todo.pop()
        inside = [k for k in t["kids"] if k["varying"] * 2 >= total and not k["off"]]
        named = t is not template and (t["tag"] in MAIN_TAGS or set(t["label"].split(".")[1:]) & MAIN_NAMES)
        if named:
            slot = t
            todo = [] if t["tag"] == "article" else inside[::-1]
        else:
            todo += inside[::-1]
    if slot is not None:
        return slot
    slot = template
    while total:
        k = next((k for k in slot["kids"] if k["varying"] >= 0.8 * total), None)
        if k is None or k["tag"] in ("p", "ul", "ol", "table", "li", "pre", "blockquote"):
            break
        slot = k
    return slot


def unpacked(template: list[list]) -> dict:
    """The tree of an induced template."""
    nodes = [{"label": label, "kids": [], "constant": frozenset(constant), "slot": slot} for label, _, constant, slot in template]
    for node, (_, up, _, _) in zip(nodes, template):
        if up >= 0:
            nodes[up]["kids"].append(node)
    return nodes[0] if nodes else {}


def extract(page: str, template: dict) -> str:
    """The page's blocks in its host's slot without template texts, joined by newlines; where the page has no such place, its own best one."""
    if not page:
        return ""
    tree = outline(parse(page))
    pairs = align(template, tree) if template else []
    slot = next((q for p, q in pairs if p["slot"]), None)
    if slot is None or not _says(slot):
        pairs = align(unpacked(induce([page])), tree)
        slot = next(q for p, q in pairs if p["slot"])
    repeated = {
        id(n) for p, q in pairs if p["constant"] for n, text, leaf in zip(q["nodes"], q["texts"], q["leaf"]) if leaf and text in p["constant"]}
    found: list[str] = []
    for n in slot["nodes"]:
        top = n.tag in ("#root", "html", "body")
        found += blocks(n, lambda x: id(x) in repeated or x.aside() or x.tag == "header" and top)
    return "\n".join(found)


def _says(slot: dict) -> bool:
    """Whether a node or a block below it that isn't aside has text."""
    todo = [slot]
    for t in todo:
        if any(t["texts"]):
            return True
        todo += [k for k in t["kids"] if not k["aside"]]
    return False


def host(url) -> F.Column:
    """The host of a URL without user, port and www., in lower case; empty for none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, most: int = PAGES) -> DataFrame:
    """host, template: made of at most `most` pages of a host, one of each class of a hash of the page."""
    slot = F.pmod(F.xxhash64("html"), F.lit(most))
    picked = pages.where("html <> ''").groupBy("host", slot.alias("_slot")).agg(F.min(F.struct(F.xxhash64("html", F.lit(1)).alias("h"), "html")).alias("p"))
    gathered = picked.groupBy("host").agg(F.sort_array(F.collect_list("p")).alias("ps")).select("host", F.col("ps.html").alias("htmls"))

    def induced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "template": [json.dumps(induce(list(x))) for x in b["htmls"]]})

    return gathered.mapInPandas(induced, "host string, template string")


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages.

    A null or empty page has an empty text, a page without URL belongs to the host ''. A host with one page has a template of its
    tags and names alone. Tags cut off at a page's end are left out. A text of fewer than REPEATS pages is never template, and pages
    that say the same count once, so copies of one article stay whole. No rows in, no rows out.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), C.text_or_empty(html_col).alias("html")).withColumn("host", host(F.col("url")))
    made = C.stage(templates(rows, most), "templates")
    met = rows.join(made, "host", "left").select("page_id", "url", "html", "template")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for b in batches:
            texts = []
            for page, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if t not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[t] = unpacked(json.loads(t)) if t else {}
                texts.append(extract(page, known[t]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return met.mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
