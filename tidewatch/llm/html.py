"""Main text of web pages by wrapper induction.

A page is parsed into a tree of its block elements; inline elements only carry text. For each host a
seed page is chosen, the tree of every other page is aligned with the seed's by simple tree matching
(children matched in order, so that as many nodes as possible pair up with equal tags, and equal text
counts twice), and a node whose text equals the seed's on at least half of the host's different pages
is template: constant. The rest is varying, and content if it lies in the main region and outside
elements that say they are menus, headers, footers, sidebars, notices, adverts, forms or comments.

Evidence comes from pages that mostly differ from the seed: copies and near copies of one page are one
vote (``votes``), so a page copied or changed a little many times is no template. A page with an explicit
article is aligned and votes like any other, for the nodes outside of the article: what stands in articles
only is content, however many of them hold it.

All pages are aligned; the seed is one row per host, and its tree without texts is broadcast only if
a check of its size allows it. The aligned blocks are stored, evidence is counted over all of them.

Output: character references decoded, white space inside a block one space, blocks in page order
joined by a newline.

Defined cases: null or empty html gives the empty text; a null or unreadable url is a host of its own;
hosts with fewer than ``LEAST`` votes have no template; markup that is never closed
reaches to the end of its parent; repeated rows are treated alike; an empty table gives an empty table."""

from __future__ import annotations

import html as references
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidewatch.plans.lineage import stored

LEAST, SHARE = 3, 0.5  # votes for a constant node, and their share of the host's
SEED_CHARS = 16_384  # seeds are taken from pages up to this length, if the host has one
BROADCAST = 32_000_000  # bytes of seed trees, or template nodes, that may be broadcast

# fixed values: elements of HTML by their role here
BLOCKS = frozenset("""html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th
 blockquote pre figure figcaption details summary address fieldset hgroup center nav header footer aside form menu dialog search""".split())
OUT = frozenset("nav footer aside form menu dialog search".split())
SKIPPED = frozenset("button select textarea svg iframe object canvas noscript template video audio head datalist map".split())
PLAIN = frozenset("textarea iframe".split())  # skipped elements that hold no markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
RAW = frozenset("script style title xmp noembed noframes".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "thead": ("caption",)}
# fixed values: words in class, id and role that mark boilerplate; the stems match by their beginning
HINTS = frozenset("""nav navbar navigation menu menubar topbar toolbar masthead header footer sidebar aside complementary contentinfo banner ad ads
 adbox adslot sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup
 login search share sharing social related recommended recommendations breadcrumb breadcrumbs pager pagination widget comment comments commentlist
 reply replies respond disqus discussion form skip hidden""".split())
NOT_ARTICLE = frozenset("comment comments reply replies respond related recommended promo promotion sponsor sponsored ad ads advert advertisement".split())
STEMS = ("advert", "comment", "sidebar", "breadcrumb", "cookie", "newsletter", "sponsor", "subscri")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>", re.S)
_HINT = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b(?!\s*=\s*["']?(?:until|false))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A block element: ``items`` are its texts and child nodes in page order."""
    __slots__ = ("tag", "attrs", "items", "kids", "mark", "linked")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs = tag, attrs
        self.items: list = []
        self.kids: list[Node] = []
        self.mark = -1
        self.linked: list[bool] = []


def parse(page: str) -> Node:
    """The tree of block elements of a page."""
    root = Node("#root", "")
    stack, cur = [root], root
    text: list[str] = []
    at, link, in_link, size = 0, 0, 0, 0
    skip: list[str] = []  # the open elements from the skipped one on
    inline: list[str] = []  # other open elements outside of it, and how many there were where each block began
    below, count = [0], defaultdict(int)
    last: dict[str, int] = {}
    lower = ""

    def flush() -> None:
        nonlocal in_link, size
        if text:
            run = "".join(text)
            if "&" in run:
                run = references.unescape(run)
            run = " ".join(run.split())
            if run:
                cur.items.append(run)
                cur.linked.append(size > 0 and in_link >= 0.9 * size)
            text.clear()
        in_link = size = 0

    def unwind(n: int) -> None:
        for t in inline[n:]:
            count[t] -= 1
        del inline[n:]

    def closed(tag: str) -> bool:
        """Whether an end tag of this kind is still to come."""
        nonlocal lower
        if tag not in last:
            lower = lower or page.lower()
            last[tag] = lower.rfind("</" + tag)
        return last[tag] >= at

    scan = _TOKEN.scanner(page)
    raw = None
    while True:
        m = scan.search()
        if m is None:
            break
        if m.start() < at:  # inside raw text that was skipped
            continue
        if skip == ["head"] and page[at:m.start()].strip():  # text ends a head
            skip.clear()
        if m.start() > at and not skip:
            piece = page[at:m.start()]
            text.append(piece)
            size += len(piece)
            if link:
                in_link += len(piece)
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not close:
            raw = re.compile(rf"</{re.escape(tag)}[^>]*>|\Z", re.I)
            at = raw.search(page, at).end()
            continue
        if skip:
            ends = False
            if close:
                if tag in skip:
                    while skip.pop() != tag:
                        pass
                    continue
                ends = count[tag] > 0 or tag in BLOCKS and any(n.tag == tag for n in stack)
            elif skip == ["head"]:
                ends = tag not in IN_HEAD
            elif tag in ("article", "main", "body"):  # an element that is never closed holds no main text
                ends = not closed(skip[0])
            if not ends:
                if not close and tag not in VOID and not attrs.endswith("/"):
                    skip.append(tag)
                continue
            skip.clear()
        if tag in SKIPPED:
            if not close and not attrs.endswith("/"):
                skip.append(tag)
                if tag in PLAIN:
                    end = re.compile(rf"<(/?){tag}\b[^>]*>", re.I).search(page, at) if closed(tag) else None
                    if end and end[1]:
                        at = end.end()
                        skip.clear()
            continue
        if tag not in BLOCKS and tag not in VOID:
            if not close:
                if not attrs.endswith("/"):
                    inline.append(tag)
                    count[tag] += 1
            elif count[tag]:
                n = len(inline) - 1
                while inline[n] != tag:
                    n -= 1
                unwind(n)
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            link = 0 if close else 1
        elif tag == "hr":
            flush()
        elif tag in BLOCKS:
            flush()
            if close:
                link = 0  # an open link ends with the block it stands in
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        unwind(below[i])
                        del stack[i:], below[i:]
                        cur = stack[-1]
                        break
            else:
                closes = CLOSES.get(tag, ())
                while cur.tag == "p" or cur.tag in closes:
                    stack.pop()
                    unwind(below.pop())
                    cur = stack[-1]
                if attrs.endswith("/"):
                    continue
                new = Node(tag, attrs)
                cur.items.append(new)
                cur.kids.append(new)
                cur.linked.append(False)
                stack.append(new)
                below.append(len(inline))
                cur = new
    if at < len(page) and (not skip or skip == ["head"]):
        text.append(page[at:])
    flush()
    return root


def holds(node: Node, tags: tuple[str, ...]) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag in tags:
            return True
        todo += n.kids
    return False


def boilerplate(node: Node) -> bool:
    """Whether an element says that it is no main text. What holds the article itself is never out by its name."""
    if node.tag in OUT:
        return True
    if node.tag == "header":
        return not holds(node, ("h1",))
    if not node.attrs:
        return False
    for m in _HINT.finditer(node.attrs):
        name, value = (m[1] or m[5] or "").lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role"):
            words = {w.lower() for w in _WORD.findall(value)}
            if node.tag in ("article", "main"):
                if words & NOT_ARTICLE:
                    return True
            elif (words & HINTS or any(w.startswith(STEMS) for w in words)) and not holds(node, ("article", "main", "h1")):
                return True
    return False


def region(root: Node) -> list[tuple[str, Node]]:
    """Texts of the main region with the nodes they stand in: the articles, else the main element, else the body."""
    return _region(root)[0]


def _region(root: Node) -> tuple[list[tuple[str, Node]], bool]:
    """The main region, and whether it is an explicit article."""
    articles, mains, todo = [], [], [root]
    while todo:
        n = todo.pop()
        if n is not root and boilerplate(n):
            continue
        if n.tag == "article":
            articles.append(n)
        else:
            if n.tag == "main" or "main" in n.attrs and re.search(r"role\s*=\s*[\"']?main\b", n.attrs):
                mains.append(n)
            todo += reversed(n.kids)
    for tops, links in ((articles, True), (mains[:1], True), ([root], False)):
        out = []
        for top in tops:
            todo = [(top, iter(zip(top.items, top.linked)))]
            while todo:
                node, rest = todo[-1]
                for item, linked in rest:
                    if isinstance(item, str):
                        if links or not linked:
                            out.append((item, node))
                    elif not boilerplate(item):
                        todo.append((item, iter(zip(item.items, item.linked))))
                        break
                else:
                    todo.pop()
        if out:
            return out, tops is articles
    return [], False


def around(root: Node) -> list[int]:
    """The seed nodes that a page with an explicit article holds outside of articles and of what is boilerplate by its name."""
    out, todo = set(), [root]
    while todo:
        n = todo.pop()
        if n.tag == "article" or n is not root and boilerplate(n):
            continue
        if n.mark >= 0:
            out.add(n.mark)
        todo += n.kids
    return sorted(out)


def skeleton(node: Node) -> list:
    """[tag, hash of the own texts, children] without the texts."""
    out: list = []
    todo = [(node, out)]
    while todo:
        n, into = todo.pop()
        kids: list = []
        into += [n.tag, own(n), kids]
        for k in n.kids:
            kids.append([])
            todo.append((k, kids[-1]))
    return out


def own(node: Node) -> int:
    """31-bit hash of a node's own texts; 0 if it has none."""
    texts = [x for x in node.items if isinstance(x, str)]
    return (xxhash.xxh32_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) >> 1 or 1) if texts else 0


class Seed:
    """A host's seed tree with numbered nodes."""

    def __init__(self, tree: list):
        self.nodes: list[tuple[str, int, list[int]]] = []
        todo = [(tree, -1)]
        kids: list[list[int]] = []
        while todo:
            t, parent = todo.pop()
            i = len(self.nodes)
            kids.append([])
            self.nodes.append((t[0], t[1], kids[i]))
            if parent >= 0:
                kids[parent].append(i)
            todo += [(k, i) for k in reversed(t[2])]


def align(root: Node, seed: Seed) -> int:
    """Simple tree matching of a page with the seed: sets ``mark`` of nodes to the matched seed node
    where their texts are equal too, and gives the size of the matching. Subtrees are matched from the leaves up, level by level of the
    page, so depth is no matter of recursion."""
    # nodes of the page, children before parents; only pairs at the same depth can match
    level, levels = [root], []
    while level:
        levels.append(level)
        level = [k for n in level for k in n.kids]
    seeds, now = [], [0]
    while now:
        seeds.append(now)
        now = [k for i in now for k in seed.nodes[i][2]]
    hashes = {id(n): own(n) for lv in levels for n in lv}
    score: dict[tuple[int, int], int] = {}
    for lv, sv in zip(reversed(levels[:len(seeds)]), reversed(seeds[:len(levels)])):
        by: dict[str, list[int]] = {}
        for j in sv:
            by.setdefault(seed.nodes[j][0], []).append(j)
        for n in lv:
            h = hashes[id(n)]
            for j in by.get(n.tag, ()):
                _, sh, sk = seed.nodes[j]
                below = _match(n.kids, sk, score)[-1][-1] if n.kids and sk else 0
                score[id(n), j] = 1 + (1 if h and h == sh else 0) + below
    todo = [(root, 0)] if (id(root), 0) in score else []
    while todo:
        n, j = todo.pop()
        _, sh, sk = seed.nodes[j]
        if hashes[id(n)] and hashes[id(n)] == sh:
            n.mark = j
        if not (n.kids and sk):
            continue
        m = _match(n.kids, sk, score)
        a, b = len(n.kids), len(sk)
        while a and b:
            w = score.get((id(n.kids[a - 1]), sk[b - 1]), 0)
            if w and m[a][b] == m[a - 1][b - 1] + w:
                todo.append((n.kids[a - 1], sk[b - 1]))
                a, b = a - 1, b - 1
            elif m[a][b] == m[a - 1][b]:
                a -= 1
            else:
                b -= 1
    return score.get((id(root), 0), 0)


def _match(kids: list[Node], others: list[int], score: dict) -> list[list[int]]:
    """Best total of matching two lists of children in order, for all their beginnings."""
    last = [0] * (len(others) + 1)
    out = [last]
    get = score.get
    for n in kids:
        row, i, best = [0], id(n), 0
        for j, o in enumerate(others):
            w = get((i, o))
            up = last[j + 1]
            if up > best:
                best = up
            if w is not None and last[j] + w > best:
                best = last[j] + w
            row.append(best)
        out.append(row)
        last = row
    return out


BLOCK = "array<struct<text:string,node:int>>"


def _placed(df: DataFrame, small: DataFrame, size: int) -> DataFrame:
    """Left join by host; the small side is broadcast only up to a checked size."""
    return df.join(F.broadcast(small) if size <= BROADCAST else small, "_host", "left")


def blocks(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` (without html) with _host, _sig (hash of the main texts), _blocks: the texts of the main
    region, each with the seed node that it equals, or -1, _article: whether that is an article, and _around: if so,
    the seed nodes held outside of it."""
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))
    rest = [F.col(f"`{c}`") for c in pages.columns if c != html]
    rows = pages.select(F.struct(*rest).alias("_row"), host.alias("_host"), F.col(html).alias("_html"))
    order = F.struct(F.length("_html") > SEED_CHARS, F.xxhash64("_html"))
    seeds = rows.where(F.length("_html") > 0).groupBy("_host").agg(F.min_by("_html", order).alias("_html"))

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [json.dumps(skeleton(parse(h.as_py())), separators=(",", ":")) for h in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees, pa.string())], names=["_host", "_seed"])

    seeds = stored(seeds.mapInArrow(reduce, "_host string, _seed string"), "seeds")
    size = seeds.agg(F.sum(F.octet_length("_seed"))).first()[0] or 0
    joined = _placed(rows, seeds, size).select("_row", "_host", "_html", "_seed")
    kind = pa.list_(pa.struct([("text", pa.string()), ("node", pa.int32())]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Seed] = {}
        for b in batches:
            out, sigs, free, outer = [], [], [], []
            for page, tree in zip(b.column(2), b.column(3)):
                page, tree = page.as_py(), tree.as_py()
                root = parse(page or "")
                found, article = _region(root)
                if found and tree:
                    if tree not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[tree] = Seed(json.loads(tree))
                    align(root, known[tree])
                out.append([{"text": t, "node": n.mark} for t, n in found])
                free.append(article)
                outer.append(around(root) if article else None)
                sigs.append(xxhash.xxh64_intdigest("\n".join(t for t, _ in found).encode("utf-8", "surrogatepass")) - (1 << 63))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sigs, pa.int64()), pa.array(out, kind), pa.array(free, pa.bool_()),
                                              pa.array(outer, pa.list_(pa.int32()))], names=["_row", "_host", "_sig", "_blocks", "_article", "_around"])

    schema = joined.select("_row", "_host").schema.add("_sig", "long").add("_blocks", _type()).add("_article", "boolean").add("_around", ArrayType(IntegerType()))
    return joined.mapInArrow(work, schema)


def _type():
    return ArrayType(StructType([StructField("text", StringType()), StructField("node", IntegerType())]))


def votes(aligned: DataFrame) -> DataFrame:
    """(_host, m, _vote): per page that mostly differs from the seed, its seed nodes, outside of its article if
    it has one, and the vote it belongs to.

    Near copies of the seed hold few other blocks and have no vote of their own. Near copies of another
    page share most blocks that are not the seed's: their vote is named by the first of these that other
    pages hold too. A page without a majority of such blocks votes alone."""
    own = F.filter("_blocks", lambda x: x["node"] < 0)
    size = lambda b: F.aggregate(F.transform(b, lambda x: F.char_length(x["text"])), F.lit(0), lambda a, n: a + n)
    held = F.array_distinct(F.transform(F.filter("_blocks", lambda x: x["node"] >= 0), lambda x: x["node"]))
    pages = aligned.select("_host", "_sig", F.when(F.col("_article"), F.col("_around")).otherwise(held).alias("m"),
                           F.array_distinct(F.transform(own, lambda x: F.xxhash64(x["text"]))).alias("b"),
                           ((2 * F.size(own) >= F.size("_blocks")) | (2 * size(own) >= size(F.col("_blocks")))).alias("far"))
    # a page without a seed node is no evidence for one, but counts in the share
    pages = pages.where("far AND size(b) > 0").dropDuplicates(["_host", "_sig"])
    each = pages.select("_host", "_sig", F.explode("b").alias("x"))
    shared = each.groupBy("_host", "x").agg(F.count("*").alias("k")).where("k > 1").select("_host", "x")
    met = each.join(shared, ["_host", "x"]).groupBy("_host", "_sig").agg(F.min("x").alias("x"), F.count("*").alias("k"))
    named = pages.join(met, ["_host", "_sig"], "left")
    # names of groups and of single pages are numbers of two kinds
    return named.select("_host", "m", F.when(2 * F.col("k") >= F.size("b"), F.struct(F.lit(True).alias("group"), F.col("x").alias("id")))
                        .otherwise(F.struct(F.lit(False).alias("group"), F.col("_sig").alias("id"))).alias("_vote"))


def templates(aligned: DataFrame) -> DataFrame:
    """(_host, _template): seed nodes that are constant over the host's votes, the seed's own being one."""
    marks = stored(votes(aligned), "votes")
    pages = marks.select("_host", "_vote").distinct().groupBy("_host").agg((F.count("*") + 1).alias("n"))
    found = marks.select("_host", "_vote", F.explode("m").alias("node")).distinct().groupBy("_host", "node").agg((F.count("*") + 1).alias("k"))
    const = found.where(F.col("k") >= LEAST).join(pages, "_host").where(F.col("k") >= SHARE * F.col("n"))
    return const.groupBy("_host").agg(F.collect_list("node").alias("_template"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without html, with the main text (a column of that name is replaced)."""
    aligned = stored(blocks(pages, url, html), "blocks")
    const = stored(templates(aligned), "templates")
    size = const.agg(F.sum(F.size("_template") * 4 + F.octet_length("_host"))).first()[0] or 0
    both = _placed(aligned, const, size)
    kept = F.filter("_blocks", lambda x: (x["node"] < 0) | F.col("_template").isNull() | ~F.array_contains("_template", x["node"]))
    out = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    names = [c for c in pages.columns if c not in (html, text)]
    return both.select(*[F.col("_row")[c].alias(c) for c in names], out.alias(text))
