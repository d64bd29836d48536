"""Main text of web pages by wrappers induced from pages of the same host.

A page becomes a tree of its block elements, with neighbouring siblings of equal
shape folded into one slot (a list of any length, a body of any number of
paragraphs). Pages of one host with the same tree are aligned slot by slot where
they are counted. Different trees of a host are aligned with its most frequent one
by simple tree matching, the greatest order-preserving match of equal labels. A
slot with the same text on every page is template; varying slots are content,
except in elements that name themselves as navigation, adverts, comments and the
like, whose words may vary from page to page.

The content of a page is what varies inside its article or main element, or, where a
host uses neither, inside the smallest element that holds most of the varying text.
A host with fewer than ``MIN_PAGES`` pages of a slot shows no variation; there all
slots count as varying.

A null or empty html, or one without text, gives the empty text. A null url and urls
without a host share one wrapper. Unclosed elements end where HTML lets them, at
the next block or with the page. Rows that share a page_id are pages of their own.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feefloor.llm.common import over_batches, table
from feefloor.session import cut_lineage

#: Pages that must share a slot's text before it is template.
MIN_PAGES = 3
#: Share of varying text that an element must hold to be the content.
MOST = 0.7

# Elements of HTML and the names sites give to what is not their text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea svg iframe object select button".split())
BLOCKS = set("""html head body title address article aside blockquote center dd details dialog dir
div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main
menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul option
""".split())
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl menu table".split())
#: Blocks that end an open paragraph.
ENDS_P = BLOCKS - set("html head body title td th tr tbody thead tfoot caption".split())
NOT_TEXT = set("head title nav aside footer form menu dialog search header".split())
NOT_CONTENT = set("""ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs
comment comments comentarios commentaires kommentare respond replies disqus cookie cookies consent
gdpr notice notices alert popup modal overlay menu menus nav navbar navigation navbox sidebar side
aside footer header masthead topbar toolbar promo promotion promoted sponsor sponsored sponsors
share sharing social newsletter subscribe subscription signup login related recommended
pagination pager widget widgets form search skip toc""".split())
MAIN = {"article", "main"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                    r"|<[!?][^>]*+>|[^<]++|<", re.DOTALL)
#: For what follows a tag that never ends: no tag reaches over the next one's start.
_BROKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?][^<>]*+>|[^<]++|<",
                     re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_NAME = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#\s]+)")


# --- pages to trees --------------------------------------------------------------

@dataclass(slots=True)
class Node:
    label: str
    tag: str
    parent: "Node | None"
    kids: list["Node"] = field(default_factory=list)
    slot: int = -1
    shape: int = 0


def label_of(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role, without digits."""
    names = [n for _, value in _ATTRIBUTE.findall(attributes)
             for n in _NAME.findall(value.lower())]
    return ".".join([tag, *sorted(set(names))])


def scan(html: str):
    """Tags, comments and stretches of text in order, in time linear in the page.

    A tag that never ends is text; from there on quotes are not trusted.
    """
    pattern, at = _TOKEN, 0
    while at < len(html):
        m = pattern.match(html, at)
        if m[0] == "<" and html[at + 1:at + 2] not in ("", " ", "\n", "\t"):
            pattern = _BROKEN
        yield m
        at = m.end()


def parse(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements and the text blocks in page order."""
    root = Node("page", "page", None)
    at, blocks, text = root, [], []
    open_: Counter[str] = Counter()  # of the elements that are open, by tag

    def flush():
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            blocks.append((at, line))
        text.clear()

    def leave(node):
        """Close what is open up to and with ``node``."""
        nonlocal at
        while at is not node.parent:
            open_[at.tag] -= 1
            at = at.parent

    skip = None
    for m in scan(html):
        tag = m[2]
        if tag is None:
            if skip is None and (m[0][0] != "<" or m[0] == "<"):
                text.append(m[0])
            continue
        tag = tag.lower()
        if skip is not None:
            if m[1] and tag == skip:
                skip = None
            continue
        if m[1]:
            if tag in BLOCKS and open_[tag]:
                target = at
                while target.tag != tag:
                    target = target.parent
                flush()
                leave(target)
            continue
        if tag == "br" or tag == "hr":
            text.append(" ")
        if tag in RAW and not m[3].rstrip().endswith("/"):
            skip = tag
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if tag in ENDS_P and at.tag == "p":
            leave(at)
        if tag in ENDS_ITSELF and any(open_[t] for t in ENDS_ITSELF[tag]):
            target = at
            while target is not root and target.tag not in SCOPES:
                if target.tag in ENDS_ITSELF[tag]:
                    leave(target)
                    if tag != "tr":
                        break
                target = target.parent
        node = Node(label_of(tag, m[3]), tag, at)
        at.kids.append(node)
        open_[tag] += 1
        at = node
    flush()
    return root, blocks


def fold(root: Node) -> tuple[str, int]:
    """Give every node its slot; the folded tree as text, and the number of slots.

    A node's shape is a hash of its label and its kids' shapes, equal neighbours once,
    so a page's text of a tree is as long as its tree and no node holds another's.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.kids))
    for node in reversed(order):
        node.shape = _hash(f"{node.label}({','.join(str(k.shape) for k in _runs(node))})")
    text, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            text.append(node)
            continue
        text.append(node.label)
        kids = _runs(node)
        if kids:
            parts = [x for kid in kids for x in (",", kid)]
            todo += [")", *reversed(parts[1:]), "("]
    return "".join(text), _number(root)


def _runs(node: Node) -> list[Node]:
    """The first of each run of neighbouring kids of equal shape."""
    return [k for i, k in enumerate(node.kids) if i == 0 or k.shape != node.kids[i - 1].shape]


def _number(root: Node) -> int:
    """Slots in the order of the folded tree; equal neighbours share theirs."""
    todo, count = [[root]], 0
    while todo:
        group = todo.pop()
        for node in group:
            node.slot = count
        count += 1
        # Nodes of a group have equal shapes, so their folded kids line up.
        runs: list[list[Node]] = []
        for node in group:
            k = -1
            for i, kid in enumerate(node.kids):
                if i == 0 or kid.shape != node.kids[i - 1].shape:
                    k += 1
                if k == len(runs):
                    runs.append([])
                runs[k].append(kid)
        todo.extend(reversed(runs))
    return count


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].rpartition("@")[2].lower() if found else ""


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"),
                                          digest_size=8).digest(), "little", signed=True)


# --- trees to wrappers ---------------------------------------------------------------

@dataclass(slots=True)
class Tree:
    label: str
    slot: int
    kids: list["Tree"] = field(default_factory=list)


def read_tree(shape: str) -> Tree:
    """The folded tree of a shape, its slots numbered as ``fold`` numbers them."""
    count, path, root = 0, [], None
    for label, mark in re.findall(r"([^(),]+)|([(),])", shape):
        if label:
            node = Tree(label, count)
            count += 1
            if path and path[-1] is not None:
                path[-1].kids.append(node)
            root = root or node
            last = node
        elif mark == "(":
            path.append(last)
        elif mark == ")":
            path.pop()
    return root


def match(a: Tree, b: Tree) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: nodes matched, and the pairs of slots (of a, of b)."""
    if a.label != b.label:
        return 0, []
    if a is b:
        slots, todo = [], [a]
        while todo:
            node = todo.pop()
            slots.append((node.slot, node.slot))
            todo.extend(node.kids)
        return len(slots), slots
    size: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[Tree, Tree]]] = {}
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        if not ready:
            todo.append((x, y, True))
            todo.extend((k, m, False) for k in x.kids for m in y.kids if k.label == m.label)
            continue
        rows, columns = len(x.kids), len(y.kids)
        best = [[0] * (columns + 1) for _ in range(rows + 1)]
        for i, k in enumerate(x.kids):
            for j, m in enumerate(y.kids):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j],
                                         best[i][j] + size.get((k.slot, m.slot), 0))
        own, i, j = [], rows, columns
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                own.append((x.kids[i], y.kids[j]))
        size[x.slot, y.slot], chosen[x.slot, y.slot] = best[rows][columns] + 1, own
    pairs, walk = [], [(a, b)]
    while walk:
        x, y = walk.pop()
        pairs.append((x.slot, y.slot))
        walk.extend(chosen[x.slot, y.slot])
    return size[a.slot, b.slot], pairs


def excluded(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in NOT_TEXT or bool(NOT_CONTENT.intersection(names) if tag not in MAIN
                                   and tag not in ("html", "body") else False)


def content_slots(tree: Tree, chars: dict[int, float], constant: set[int]) -> list[int]:
    """Slots of the main text: see the module."""
    def below(node, stop):
        todo = [node]
        while todo:
            node = todo.pop()
            if not stop(node.label):
                yield node
                todo.extend(reversed(node.kids))

    # From the leaves up: what lies in an element outside of excluded ones, and the
    # main elements in it. Of a main element around articles the articles are the text.
    mass, held, mains = {}, {}, {}
    for node in reversed(list(below(tree, lambda label: False))):
        if excluded(node.label):
            mass[node.slot], held[node.slot], mains[node.slot] = 0, 0, []
            continue
        own = chars.get(node.slot, 0)
        mass[node.slot] = ((0 if node.slot in constant else own)
                           + sum(mass[k.slot] for k in node.kids))
        held[node.slot] = own + sum(held[k.slot] for k in node.kids)
        found = [x for k in node.kids for x in mains[k.slot]]
        mains[node.slot] = found or ([node] if node.label.split(".")[0] in MAIN else [])

    tops = [n for n in mains[tree.slot] if held[n.slot]]
    if not tops:
        top, whole = tree, mass[tree.slot]
        while True:
            heavy = [k for k in top.kids if not excluded(k.label) and whole
                     and mass[k.slot] >= MOST * whole]
            if not heavy:
                break
            top = heavy[0]
        tops = [top]
    found = [n.slot for t in tops for n in below(t, lambda x: excluded(x) and x != t.label)]
    varying = [s for s in found if s not in constant]
    return sorted(varying if any(chars.get(s) for s in varying) else found)


# --- Spark --------------------------------------------------------------------------------

def read(pages: DataFrame) -> DataFrame:
    """(host, tree id, shape, slot, text hash range, chars, pages), added up by batch."""

    def run(batch):
        sums: dict[tuple[str, int, int], list] = {}
        shapes: dict[int, str] = {}
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            root, blocks = parse(html or "")
            shape, _ = fold(root)
            tree, host = _hash(shape), host_of(url)
            shapes[tree] = shape
            texts = defaultdict(list)
            for node, text in blocks:
                texts[node.slot].append(text)
            texts[0] = texts[0]  # every page counts at its root
            for slot, lines in texts.items():
                value, size = _hash("\n".join(lines)), sum(map(len, lines))
                row = sums.setdefault((host, tree, slot), [value, value, 0, 0])
                row[0], row[1] = min(row[0], value), max(row[1], value)
                row[2] += size
                row[3] += 1
        keys, rows = list(sums), list(sums.values())
        yield {"host": pa.array([k[0] for k in keys], pa.string()),
               "tree": pa.array([k[1] for k in keys], pa.int64()),
               "shape": pa.array([shapes[k[1]] if k[2] == 0 else None for k in keys], pa.string()),
               "slot": pa.array([k[2] for k in keys], pa.int32()),
               **{name: pa.array([r[i] for r in rows], pa.int64())
                  for i, name in enumerate(("low", "high", "chars", "n"))}}

    return over_batches(pages.select("url", "html"), run,
                        "host string,tree long,shape string,slot int,low long,high long,"
                        "chars long,n long")


def wrappers(seen: DataFrame) -> DataFrame:
    """(host, tree, slots): the content slots of every tree of every host."""
    slots = seen.groupBy("host", "tree", "slot").agg(
        F.max("shape").alias("shape"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("chars").alias("chars"), F.sum("n").alias("n"))
    trees = slots.groupBy("host", "tree").agg(
        F.max("shape").alias("shape"), F.max(F.when(F.col("slot") == 0, F.col("n"))).alias("n"),
        F.collect_list(F.struct("slot", "low", "high", "chars", "n")).alias("slots"))
    trees = cut_lineage(trees, "trees")
    most = trees.groupBy("host").agg(
        F.max(F.struct("n", "tree", "shape")).alias("m"), F.count("*").alias("n_trees")).select(
        "host", F.col("m.shape").alias("template_shape"))
    # Every tree is aligned by itself, so the trees of one host spread over all tasks.
    asked = trees.join(most, "host").repartition("host", "tree")

    def align(batch):
        templates: dict[str, Tree] = {}
        matched, parts = [], []
        for r in batch.select(["shape", "template_shape", "slots"]).to_pylist():
            template = r["template_shape"]
            if template not in templates:
                templates[template] = read_tree(template)
            own = templates[template] if r["shape"] == template else read_tree(r["shape"])
            pairs = dict(match(own, templates[template])[1])
            matched.append([{"own": a, "slot": b} for a, b in pairs.items()])
            parts.append([{"slot": pairs[s["slot"]], "low": s["low"], "high": s["high"],
                           "n": s["n"]} for s in r["slots"] if s["slot"] in pairs])
        yield {**{c: batch.column(c) for c in ("host", "tree", "shape", "slots")},
               "pairs": pa.array(matched, pa.list_(pa.struct(
                   [("own", pa.int32()), ("slot", pa.int32())]))),
               "parts": pa.array(parts, pa.list_(pa.struct(
                   [("slot", pa.int32()), ("low", pa.int64()), ("high", pa.int64()),
                    ("n", pa.int64())])))}

    aligned = cut_lineage(over_batches(
        asked, align, "host string,tree long,shape string,"
        "slots array<struct<slot:int,low:bigint,high:bigint,chars:bigint,n:bigint>>,"
        "pairs array<struct<own:int,slot:int>>,"
        "parts array<struct<slot:int,low:bigint,high:bigint,n:bigint>>"), "aligned")
    # One row a template slot, over all trees of the host; then one row a host.
    fixed = (aligned.select("host", F.explode("parts").alias("s"))
             .groupBy("host", F.col("s.slot").alias("slot"))
             .agg(F.min("s.low").alias("low"), F.max("s.high").alias("high"),
                  F.sum("s.n").alias("n"))
             .where((F.col("low") == F.col("high")) & (F.col("n") >= MIN_PAGES))
             .groupBy("host").agg(F.collect_list("slot").alias("fixed")))

    def induce(batch):
        out = []
        for r in batch.select(["shape", "slots", "pairs", "fixed"]).to_pylist():
            fixed_, pairs = set(r["fixed"] or ()), {p["own"]: p["slot"] for p in r["pairs"]}
            own = {s["slot"]: s["chars"] / s["n"] for s in r["slots"]}
            constant = {s for s in own if pairs.get(s) in fixed_}
            out.append(content_slots(read_tree(r["shape"]), own, constant))
        yield {"host": batch.column("host"), "tree": batch.column("tree"),
               "slots": pa.array(out, pa.list_(pa.int32()))}

    return over_batches(aligned.drop("parts").join(fixed, "host", "left"), induce,
                        "host string,tree long,slots array<int>")


def keyed(pages: DataFrame) -> DataFrame:
    """``pages`` with their host and the id of their tree."""

    def run(batch):
        trees = [_hash(fold(parse(h or "")[0])[0]) for h in batch.column("html").to_pylist()]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"),
               "html": batch.column("html"),
               "host": pa.array([host_of(u) for u in batch.column("url").to_pylist()]),
               "tree": pa.array(trees, pa.int64())}

    return over_batches(pages, run,
                        "page_id long,url string,html string,host string,tree long")


def html_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    known = cut_lineage(wrappers(read(pages)), "wrappers")
    wrapped = keyed(pages).join(known, ["host", "tree"]).select("page_id", "url", "html", "slots")

    def run(batch):
        out = []
        for html, slots in zip(batch.column("html").to_pylist(),
                               batch.column("slots").to_pylist()):
            root, blocks = parse(html or "")
            fold(root)
            wanted = set(slots)
            out.append("\n".join(text for node, text in blocks if node.slot in wanted))
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"),
               "text": pa.array(out, pa.string()),
               "n_chars": pa.array([len(t) for t in out], pa.int64())}

    return over_batches(wrapped, run, "page_id long,url string,text string,n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))
