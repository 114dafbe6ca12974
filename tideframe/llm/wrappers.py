"""Main text of web pages by wrapper induction.

Each host gives a bounded sample of different pages. They are parsed and each is aligned with a reference page by simple tree
matching. A node whose text stays the same on most of them is template; slots whose text varies are content. The wrapper of
a host is the path to the smallest element that holds most of the varying text, and the constant labels at or below it.
Applied to a page, it gives the text of all elements at that path, less those labels. What a host repeats inside its content
stays, unless its form is that of a label: a few words without a sentence's end, in no heading, list or table ("Read more").

Pages that repeat each other for the greater part count as one, so that a text which many copies share is no template for it.
Elements that by their name, class, id or role are no article (menus, footers, adverts, forms, comments and so on) are
passed over, unless nearly all varying text of the host lies in elements with such a class. A host with a single page, or a
page that lacks the wrapper's path, gives its articles or main elements, else its body, whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import tidy
from .dom import BLOCK, Node, match_trees, parse
from .idfilter import id_filter
from .scratch import Scratch
from .streams import groups

#: Pages of each host that its wrapper is learned from, and bytes of all wrappers up to which they are broadcast.
SAMPLED = 8
BROADCAST_BYTES = 32 << 20
#: Rows (host, hash of a page) of all samples up to which they are broadcast.
BROADCAST_ROWS = 200_000
MERGED = 32
#: The share of aligned pages with the same text that makes a node constant, and of the varying text that the content holds.
CONSTANT, SHARE = 0.6, 0.7
#: The aligned pages besides the reference that a constant node needs.
ALIGNED = 2
#: Two pages that share this part of the text of either count as copies of each other.
COPY = 0.7
#: The part of the varying text outside elements with a class of NO_CONTENT_HINT below which those classes are not heeded.
UNHINTED = 0.1
# Elements, and words of a class, id or role, that are no part of an article; elements that are never told by those words.
NO_CONTENT = frozenset("script style nav footer aside form noscript template iframe svg button select textarea input head title object canvas audio video dialog menu noembed noframes xmp".split())
NO_CONTENT_HINT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side-bar|footer|site-header|masthead|cookie|cookies|consent|notice|notices|alert|popup|modal|newsletter|subscribe|signup|comment|comments|discussion|replies|reply|related|recommended|share|sharing|social|search|pagination|pager|widget|toolbar|contentinfo|complementary)(?:$|[\s_-])"
)
#: Words of a label at most, what ends a sentence, and elements whose text is never a label.
LABEL_WORDS, SENTENCE_END = 4, tuple(".!?:;…。！？")
NO_LABEL = frozenset("h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre code figcaption".split())
UNHINTED_TAGS = frozenset("html body main".split())
COMMENT_HINTS = frozenset("comment comments reply replies related recommended ad ads advert sponsored promo".split())
SMALL = frozenset("p h1 h2 h3 h4 h5 h6 li b a span em i strong td th tr tbody dt dd br".split())


@lru_cache(maxsize=1 << 14)
def hinted(tag: str, hints: str) -> bool:
    """Whether an element's class, id or role says that it is no part of an article."""
    if not hints or tag in UNHINTED_TAGS:
        return False
    if tag == "article":  # classes of the page are often set on its article: only whole words count
        return not COMMENT_HINTS.isdisjoint(hints.split())
    return NO_CONTENT_HINT.search(hints) is not None


def no_content(node: Node, in_article: bool) -> bool:
    """Whether an element is by its name no part of an article; a header inside the article is part of it."""
    return node.tag in NO_CONTENT or (node.tag == "header" and not in_article)


def is_label(node: Node, text: str) -> bool:
    """Whether a text has the form of a label, not of a part of an article."""
    return node.tag not in NO_LABEL and len(text.split()) <= LABEL_WORDS and not text.rstrip().endswith(SENTENCE_END)


def code(text: str, way: int = 0) -> int:
    """A short fixed number of a text, and of the way to it."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass"), way)


def walk(root: Node) -> Iterator[tuple[Node, Node | None, int, bool]]:
    """Elements that may hold content, in page order: each with its parent, the code of the way to it, and whether it lies in
    one with a class of no content."""
    stack: list = [(root, None, 0, False, False)]
    while stack:
        node, above, way, out, inside = stack.pop()
        yield node, above, way, out
        inside = inside or node.tag == "article"
        stack += [(c, node, code(c.label, way), out or hinted(c.tag, c.hints), inside) for c in reversed(node.elements()) if not no_content(c, inside or c.tag == "article")]


def different(texts: list[Counter]) -> list[int]:
    """Numbers of the pages that are no copies of an earlier one (texts: characters of each block's text, by its code)."""
    kept: list[int] = []
    for i, mine in enumerate(texts):
        size = sum(mine.values())
        if size and all(sum((mine & texts[k]).values()) < COPY * min(size, sum(texts[k].values())) for k in kept):
            kept.append(i)
    return kept


def place(node: Node, above: Node) -> tuple[int, int]:
    """Where an element stands among its siblings of the same label, from the first and from the last."""
    same = [c for c in above.elements() if c.label == node.label]
    at = next(i for i, c in enumerate(same) if c is node)
    return at, len(same) - 1 - at


def step_to(label: str, places: set[tuple[int, int]]) -> list:
    """A step of a path: the label, and the place among siblings of that label (from the last: negative) that all aligned
    pages agree on; none if it is the only one, or if they do not agree."""
    first, last = {f for f, _ in places}, {b for _, b in places}
    if places == {(0, 0)} or (len(first) > 1 and len(last) > 1):
        return [label, None]
    return [label, first.pop() if len(first) == 1 else -1 - last.pop()]


def induce(pages: list[str]) -> dict | None:
    """The wrapper of a host from sampled pages: path to the content, and codes of constant labels by way. None if fewer than
    two are different, or if no element holds most of what varies."""
    trees = [parse(p) for p in dict.fromkeys(pages) if p]
    nodes = [list(walk(tree)) for tree in trees]
    texts = [[n.own_text() for n, *_ in part] for part in nodes]
    masses = []
    for part in texts:
        masses.append(Counter())
        for text in filter(None, part):
            masses[-1][code(text)] += len(text)
    kept = different(masses)
    if len(kept) < 2:
        return None
    reference = max(kept, key=lambda i: (len(nodes[i]), -i))
    seen, same = Counter(), Counter()
    matched: dict[int, dict[int, Node]] = {reference: {id(n): n for n, *_ in nodes[reference]}}
    for k in kept:
        if k != reference:
            _, pairs = match_trees(trees[reference], trees[k])
            matched[k] = {id(b): a for a, b in pairs}
            for a, b in pairs:
                if text := a.own_text():
                    seen[id(a)] += 1
                    same[id(a)] += text == b.own_text()
    fixed = {a for a, n in seen.items() if n >= ALIGNED and same[a] >= CONSTANT * n}
    # what varies counts at the node of the reference that it is aligned with, else at that of the nearest node around it
    clean, every, constants = Counter(), Counter(), set()
    aligned: dict[int, list[tuple[Node, Node]]] = {}
    for k in kept:
        around: dict[int, Node] = {}
        for (node, above, way, out), text in zip(nodes[k], texts[k], strict=True):
            at = matched[k].get(id(node))
            source = around[id(node)] = at if at is not None else around[id(above)]
            if at is not None and above is not None:
                aligned.setdefault(id(at), []).append((node, above))
            if text and at is not None and id(at) in fixed and text == at.own_text():
                if is_label(node, text):
                    constants.add((way, code(text)))
            elif text:
                every[id(source)] += len(text)
                clean[id(source)] += 0 if out else len(text)
    heed = sum(clean.values()) >= UNHINTED * sum(every.values())
    mass = clean if heed else every
    below: dict[int, list[Node]] = {}
    for node, above, *_ in reversed(nodes[reference]):  # a node stands after the one around it
        if above is not None:
            mass[id(above)] += mass[id(node)]
            below.setdefault(id(above), []).append(node)
    best, path = trees[reference], []
    while steps := below.get(id(best)):
        top = max(reversed(steps), key=lambda n: mass[id(n)])
        # the content is an element with parts, not one of its paragraphs
        if not mass[id(top)] or mass[id(top)] < SHARE * mass[id(best)] or top.tag in SMALL:
            break
        best = top
        path.append(step_to(top.label, {place(n, above) for n, above in aligned[id(top)]}))
    return {"path": path, "heed": heed, "constants": sorted(map(list, constants))} if path else None


def follow(root: Node, path: list[list]) -> list[tuple[Node, int]]:
    """The elements at a path of steps, in page order, with the code of the way to them; none if a step leads nowhere."""
    found, way = [root], 0
    for label, at in path:
        after = []
        for node in found:
            same = [c for c in node.elements() if c.label == label]
            after += same if at is None else same[at : at + 1 or None] if -len(same) <= at < len(same) else []
        found, way = after, code(label, way)
    return [(n, way) for n in found]


def articles(root: Node) -> list[tuple[Node, int]]:
    """The outermost article elements of a page, else its main elements, its body, or all of it."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in found:
            found[node.tag].append(node)
        if node.tag != "article":
            stack += [c for c in reversed(node.elements()) if not no_content(c, False) and not hinted(c.tag, c.hints)]
    return [(n, 0) for n in next((v for v in found.values() if v), [root])[:None if found["article"] else 1]]


def block_text(node: Node, way: int, constants: set[tuple[int, int]], heed: bool) -> str:
    """The text of an element: white space as one space, blocks joined by one, without constant and no-content elements."""
    out: list[str] = []
    stack: list = [(node, way)]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
            continue
        node, way = top
        edge = [" "] if node.tag in BLOCK else []
        inner: list = list(edge)
        silent = bool(constants) and (way, code(node.own_text())) in constants
        for child in node.children:
            if isinstance(child, str):
                if not silent:
                    inner.append(child)
            elif not no_content(child, True) and not (heed and hinted(child.tag, child.hints)):
                inner.append((child, code(child.label, way) if constants else 0))
        stack += reversed(inner + edge)
    return "".join(out)


def extract(page: str | None, wrapper: dict | None) -> str:
    """Main text of a page by its host's wrapper; empty if there is none."""
    tree = parse(page)
    found = follow(tree, wrapper["path"]) if wrapper else []
    constants = {tuple(c) for c in wrapper["constants"]} if found else set()
    heed = wrapper["heed"] if found else True
    return " ".join(" ".join(block_text(n, w, constants, heed) for n, w in found or articles(tree)).split())


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, ["host"]):
        wrapper = induce(table.column("html").to_pylist())
        if wrapper:
            yield pa.record_batch({"host": pa.array([table.column("host")[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(wrapper)], pa.string())})


def host_of(url):
    """The host of a URL column, lower-case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def learn_wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wrapper as JSON) of the hosts that have one. A host's sample is its SAMPLED distinct pages of least hash, over
    all its pages; copies of a page count once, before anything is sampled."""
    rows = pages.where("html is not null").select(host_of("url").alias("host"), F.xxhash64("html").alias("rank"), "html")
    # the least of each task, of each of MERGED groups of tasks, then of all: no step sees many rows of a large host
    least = lambda *key: F.row_number().over(W.partitionBy(*key).orderBy("rank"))
    merged = rows.select("host", "rank").distinct().withColumn("group", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    merged = merged.withColumn("n", least("host", "group")).where(F.col("n") <= SAMPLED).select("host", "rank")
    chosen = scratch.cut(merged.withColumn("n", least("host")).where(F.col("n") <= SAMPLED))
    wanted = chosen.join(chosen.where("n = 2").select("host"), "host", "left_semi").select("host", "rank")
    key = ["host", "rank"]
    if chosen.count() <= BROADCAST_ROWS:
        sample = rows.join(F.broadcast(wanted), key, "left_semi").dropDuplicates(key)
    else:
        sample = rows.where(id_filter(wanted, "rank").may_hold("rank")).dropDuplicates(key).join(wanted, key, "left_semi")
    return sample.repartition("host").sortWithinPartitions("host", "rank").mapInArrow(tidy(_induce), "host string, wrapper string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict | None] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if wrapper not in known:
                if len(known) > 10_000:
                    known.clear()
                known[wrapper] = json.loads(wrapper) if wrapper else None
            texts.append(extract(page, known[wrapper]))
        yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})


def extract_pages(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page. A null page has the empty text; a null or odd url is of
    the host "". Equal rows give equal rows. Other columns are ignored; an empty table gives no row."""
    scratch = Scratch(pages.sparkSession)
    wrappers = scratch.cut(learn_wrappers(pages, scratch)) if wrappers is None else wrappers
    small = (wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of("url").alias("host"))
    joined = rows.join(F.broadcast(wrappers) if small else wrappers, "host", "left")
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")
