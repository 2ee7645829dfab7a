"""Main text of web pages by wrapper induction: pages of one host are aligned, what stays the same is template."""

from __future__ import annotations

import bisect
import functools
import hashlib
import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, slices, table, written

#: Pages of a host that may become first pages of layouts in the first round; twice as many in each later one, up to MOST.
DRAWN, MOST = 8, 256
#: Alignment goes so many levels down, further than pages are nested.
DEPTH = 400
#: Pairs of children that are weighed against each other; longer lists are aligned by their symbols alone.
PAIRS = 4096
#: Counts that a task holds before it hands them on, and first pages of layouts that it keeps as trees.
COUNTS, KEPT = 100_000, 256
#: Pages of one layout have this share of the smaller one's elements in common; a slot holds this share of varying text.
LIKE, SHARE = 0.5, 0.8
TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("html body div section article main td center table".split())
#: Elements that end an open p, and those that end an open element of their own kind.
ENDS_P = BLOCKS - frozenset("html body option legend caption dd dt li td th tr tbody thead tfoot".split()) | {"li", "dd", "dt", "td", "th", "tr"}
SIBLING = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol"), "dd": ("dl",), "dt": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",), "option": ("select",)}
NEVER = frozenset("head script style noscript template iframe svg nav footer aside form button select textarea dialog menu title".split())
ROLE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed|s)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|menu|nav(?:igation|bar)?|breadcrumbs?|sidebar|side|aside|widget|footer|masthead|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|tags|toolbar|login|search|skip)(?:$|[\s_-]|\d)", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header|topbar)(?:$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "mark", "children", "parent", "size", "shape")

    def __init__(self, tag: str, mark: str, parent: Node | None):
        self.tag, self.mark, self.parent = tag, mark, parent
        # set by Page: number of elements at and below this one, a hash of their symbols
        self.size = self.shape = 0
        self.children: list[Node | str] = []


def parse(page: str) -> Node:
    """A tree of elements and decoded text; tags that are left open end where HTML ends them."""
    root = here = Node("", "", None)
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            here.children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            here.children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            up: Node | None = here
            while up is not None and up.tag != tag:
                up = up.parent
            # an inline end tag does not reach beyond the block it is in
            if up is not None and up.parent is not None and (tag in BLOCKS or not crosses(here, up)):
                here = up.parent
            continue
        if tag in ENDS_P:
            up = here
            while up is not None and up.tag != "p" and (up.tag not in BLOCKS):
                up = up.parent
            if up is not None and up.tag == "p":
                here = up.parent
        if tag in SIBLING:
            up = here
            while up is not None and up.tag not in SIBLING[tag] and up.tag not in SCOPE[tag]:
                up = up.parent
            if up is not None and up.tag in SIBLING[tag]:
                here = up.parent
        attributes = m[3] if m[2] else m[6]
        mark = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)) if attributes and "=" in attributes else ""
        node = Node(tag, mark, here)
        here.children.append(node)
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.children.append(page[at : close.start() if close else end])
            at = close.end() if close else end
            continue
        here = node
    return root


def crosses(here: Node, up: Node) -> bool:
    while here is not up:
        if here.tag in BLOCKS:
            return True
        here = here.parent
    return False


@functools.lru_cache(maxsize=65536)
def named(tag: str, mark: str) -> str:
    return f"{tag}.{'.'.join(sorted(re.sub(r'[0-9]+', '0', mark).split()))}" if mark else tag


def symbol(node: Node) -> str:
    return named(node.tag, node.mark)


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element is no part of an article by its name or role. inside: it is in one."""
    if node.tag in NEVER:
        return True
    if node.tag == "header" or HEADER.search(node.mark):
        return not inside
    return node.tag not in ("html", "body", "article", "main") and bool(node.mark and ROLE.search(node.mark))


def elements(node: Node) -> list[Node]:
    """node and the elements below it, parents and earlier siblings first."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]
    return out


class Page:
    """A page's tree with what alignment takes: sizes, shapes, and how many elements there are by path."""

    def __init__(self, html: str):
        self.tree = parse(html)
        order = elements(self.tree)
        for x in reversed(order):
            below = [c for c in x.children if isinstance(c, Node)]
            x.size = 1 + sum(c.size for c in below)
            x.shape = hash((symbol(x), *[c.shape for c in below]))
        at = {id(self.tree): 0}
        for x in order[1:]:
            at[id(x)] = hash((at[id(x.parent)], symbol(x)))
        self.size = self.tree.size
        self.paths = Counter(at[id(x)] for x in order[1:])


def match(a: Node, b: Node, depth: int, found: list | None, memo: dict) -> int:
    """Simple tree matching: the most element pairs in order with equal symbols, parents paired before children.

    found: gets the pairs.
    """
    if symbol(a) != symbol(b):
        return 0
    if a.shape and a.shape == b.shape:
        # the same elements below both: all of them pair
        if found is not None:
            found += zip(elements(a), elements(b), strict=True)
        return a.size
    if found is not None:
        found.append((a, b))
    elif (id(a), id(b)) in memo:
        return memo[id(a), id(b)]
    if depth >= DEPTH:
        return 1
    x = [c for c in a.children if isinstance(c, Node)]
    y = [c for c in b.children if isinstance(c, Node)]
    if len(x) * len(y) > PAIRS:
        # in order, each child with the next one of its symbol
        total, at = 1, 0
        where: dict[str, list[int]] = {}
        for j, q in enumerate(y):
            where.setdefault(symbol(q), []).append(j)
        for p in x:
            places = where.get(symbol(p), [])
            k = bisect.bisect_left(places, at)
            if k < len(places):
                total += match(p, y[places[k]], depth + 1, found, memo)
                at = places[k] + 1
        memo[id(a), id(b)] = total
        return total
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    w = [[0] * len(y) for _ in x]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            w[i][j] = match(p, q, depth + 1, None, memo)
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w[i][j])
    if found is not None:
        i, j = len(x), len(y)
        while i and j:
            if w[i - 1][j - 1] and m[i][j] == m[i - 1][j - 1] + w[i - 1][j - 1]:
                i, j = i - 1, j - 1
                match(x[i], y[j], depth + 1, found, memo)
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
    memo[id(a), id(b)] = m[-1][-1] + 1
    return m[-1][-1] + 1


def own_text(node: Node) -> str:
    return SPACE.sub(" ", " ".join(c for c in node.children if isinstance(c, str))).strip()


def path_of(node: Node) -> str:
    out = []
    while node.parent is not None:
        out.append(symbol(node))
        node = node.parent
    return "/".join(reversed(out))


def digest(path: str, text: str) -> str:
    return hashlib.md5(f"{path}\n{text}".encode()).hexdigest()[:16]


def aligned(a: Node, b: Node) -> list[tuple[Node, Node]]:
    pairs: list[tuple[Node, Node]] = []
    memo: dict = {}
    for x, y in zip([c for c in a.children if isinstance(c, Node)], [c for c in b.children if isinstance(c, Node)], strict=False):
        match(x, y, 0, pairs, memo)
    return pairs


def alike(base: Page, page: Page) -> list[tuple[Node, Node]] | None:
    """Pairs of the two pages' elements if these are at least LIKE of the smaller one's."""
    least = LIKE * min(base.size, page.size)
    # paired elements have equal paths
    if sum(min(base.paths[p], page.paths[p]) for p in base.paths.keys() & page.paths.keys()) < least:
        return None
    pairs = aligned(base.tree, page.tree)
    return pairs if len(pairs) >= least else None


def layouts(pages: Iterable[tuple[int, str]]) -> list[tuple[int, str]]:
    """The (key, html) that are not like an earlier one that is kept; pages without elements have no layout."""
    kept: list[tuple[int, str, Page]] = []
    for key, html in pages:
        page = Page(html)
        if page.size > 1 and all(alike(base, page) is None for _, _, base in kept):
            kept.append((key, html, page))
    return [(key, html) for key, html, _ in kept]


def tally(pairs: list[tuple[Node, Node]], page: Page) -> dict[tuple[str, str], tuple[int, int]]:
    """What a page says of its layout, given its pairs with the layout's first page: (kind, value) to two counts.

    pages: 1. same: texts equal to the first page's, as path and text, 1 each. path: characters at and below the path
    that are not, and whether the page has the path more than once. A page that shares more than half of its text with
    the first page is a copy of it and says nothing.
    """
    texts = [(a, b, own_text(a), own_text(b)) for a, b in pairs]
    shown = [(a, s, t) for a, _, s, t in texts if a.tag not in RAW]
    total = sum(len(s) for _, s, _ in shown)
    if not total or 2 * sum(len(s) for _, s, t in shown if s == t) > total:
        return {}
    out = {("pages", ""): (1, 0)} | {("same", digest(path_of(a), s)): (1, 0) for a, s, t in shown if s and s == t}
    # what differs from its partner or has none fills a slot
    fixed = {id(b) for _, b, s, t in texts if s == t}
    order: list[tuple[Node, str, int]] = []
    stack = [(c, symbol(c), -1) for c in page.tree.children if isinstance(c, Node)]
    while stack:
        x, path, above = stack.pop()
        place = len(order)
        order.append((x, path, above))
        if x.tag not in RAW and x.tag != "head":
            stack += [(c, f"{path}/{symbol(c)}", place) for c in x.children if isinstance(c, Node)]
    filled = [0 if id(x) in fixed or x.tag in RAW or x.tag == "head" else len(own_text(x)) for x, _, _ in order]
    varying: dict[str, int] = {}
    often: dict[str, int] = {}
    for i in range(len(order) - 1, -1, -1):
        _, path, above = order[i]
        if above >= 0:
            filled[above] += filled[i]
        varying[path] = varying.get(path, 0) + filled[i]
        often[path] = often.get(path, 0) + 1
    return out | {("path", path): (n, int(often[path] > 1)) for path, n in varying.items() if n}


def wrapper(found: Iterable[tuple[int, int, str, str]]) -> dict:
    """A host's wrapper from (pages, layout, kind, value): slots of the layouts with most pages first, template texts."""
    paths: dict[tuple[int, int], list[str]] = {}
    same = set()
    for pages, layout, kind, value in found:
        if kind == "same":
            same.add(value)
        else:
            paths.setdefault((-pages, layout), []).append(value)
    roots = [root for _, x in sorted(paths.items()) if (root := slot(x))]
    return {"roots": list(dict.fromkeys(roots)), "same": sorted(same)}


def slot(paths: list[str]) -> str:
    """The deepest of the paths that hold the varying text, with the article around it if there is one.

    '' if that is the whole page or boilerplate by name.
    """
    name = lambda step: re.split(r"[.]", step)[0]
    deep = [p for p in paths if name(p.rpartition("/")[2]) in HOLDERS]
    steps = max(deep, key=lambda p: (p.count("/"), p), default="").split("/")
    around = [i for i, step in enumerate(steps) if name(step) in ("article", "main")]
    if around:
        steps = steps[: around[0] + 1]
    elif name(steps[-1]) in ("", "html", "body"):
        return ""
    inside = False
    for step in steps:
        tag, _, mark = step.partition(".")
        if boilerplate(Node(tag, mark.replace(".", " "), None), inside):
            return ""
        inside |= tag in ("article", "main")
    return "/".join(steps)


def induce(pages: list[str]) -> dict:
    """The wrapper of a few pages at hand; wrappers() does the same for any number of them."""
    firsts = [(key, Page(html)) for key, html in layouts(enumerate(pages))]
    sums: dict[int, dict[tuple[str, str], tuple[int, int]]] = {key: {} for key, _ in firsts}
    for key, html in enumerate(pages):
        page = Page(html)
        for first, base in firsts if key not in sums else ():
            if (pairs := alike(base, page)) is not None:
                for k, (n, m) in tally(pairs, page).items():
                    x = sums[first].get(k, (0, 0))
                    sums[first][k] = (x[0] + n, x[1] + m)
                break
    found = []
    for first, counts in sums.items():
        compared = counts.get(("pages", ""), (0, 0))[0]
        best = max((n for (kind, _), (n, _) in counts.items() if kind == "path"), default=0)
        for (kind, value), (n, m) in counts.items():
            if kind == "path" and n >= SHARE * best and m <= (1 - SHARE) * compared or kind == "same" and compared > 1 and n >= SHARE * compared:
                found.append((compared, first, kind, value))
    return wrapper(found)


def extract(page: str | None, wrapper: dict | None) -> tuple[str, bool]:
    """Blocks of the main text, joined by line ends, and whether the wrapper said where they are."""
    if not page:
        return "", False
    tree = parse(page)
    same = frozenset((wrapper or {}).get("same") or ())

    def blocks(starts: list[Node], inside: bool) -> list[str]:
        out: list[str] = []
        line: list[str] = []

        def end():
            if text := SPACE.sub(" ", "".join(line)).strip():
                out.append(text)
            line.clear()

        for start in starts:
            # (element, whether it is in an article, its path) to enter; None to end a block
            stack: list = [(start, inside, path_of(start))]
            while stack:
                x = stack.pop()
                if x is None:
                    end()
                    continue
                if isinstance(x, str):
                    line.append(x)
                    continue
                node, within, path = x
                if node is not start and boilerplate(node, within):
                    line.append(" ")
                    continue
                if same and (text := own_text(node)) and digest(path, text) in same:
                    drop = True
                else:
                    drop = False
                within = within or node.tag in ("article", "main")
                block = node.tag in BLOCKS
                if block:
                    end()
                    stack.append(None)
                if node.tag == "br":
                    line.append(" ")
                stack += [c if isinstance(c, str) else (c, within, f"{path}/{symbol(c)}" if path else symbol(c)) for c in reversed(node.children) if not (drop and isinstance(c, str))]
            end()
        return out

    def outermost(test) -> list[Node]:
        found, stack = [], [tree]
        while stack:
            x = stack.pop()
            if x is not tree and test(x):
                found.append(x)
            else:
                stack += [c for c in reversed(x.children) if isinstance(c, Node)]
        return found

    # the slots of the first layout that the page has; names of elements where there is no wrapper, or none that fits
    for root in (wrapper or {}).get("roots") or ():
        if (starts := outermost(lambda x, root=root: path_of(x) == root)) and (found := blocks(starts, True)):
            return "\n".join(found), True
    starts = [x for x in outermost(lambda x: x.tag == "article") if not any(boilerplate(up, False) for up in ancestors(x))]
    if starts:
        return "\n".join(blocks(starts, True)), False
    return "\n".join(blocks(outermost(lambda x: x.tag == "main") or [tree], False)), False


def ancestors(node: Node) -> Iterator[Node]:
    while node.parent is not None and node.parent.parent is not None:
        node = node.parent
        yield node


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def first_pages(rest: DataFrame, drawn: int) -> DataFrame:
    """(host, layouts): of the pages of a host with the drawn least hashes, those that are not like each other, with their html, as JSON."""
    order = Window.partitionBy("host").orderBy("key")
    keys = rest.select("host", "key").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= drawn).drop("n")
    chosen = rest.join(written(keys, "drawn"), ["host", "key"]).dropDuplicates(["host", "key"]).select("host", "key", "html")
    def lead(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        kept = layouts(zip(group.column("key").to_pylist(), group.column("html").to_pylist(), strict=True))
        return pa.table({"host": group.column("host")[:1].combine_chunks(), "layouts": pa.array([zlib.compress(json.dumps(kept).encode("utf-8", "surrogatepass"), 1)], pa.binary())})

    # compressed as they go along with each page of the host, and not again by the file: Spark knows their size when it decides on a broadcast
    return written(chosen.groupBy("host").applyInArrow(lead, "host string, layouts binary"), "firsts", "uncompressed")


def counted(rest: DataFrame, firsts: DataFrame) -> DataFrame:
    """All pages aligned with the first pages of their host's layouts: sums of tally() by layout, and, as kind rest, pages like none."""
    schema = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("n", pa.int64()), ("m", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # firsts of a host, as trees where they were needed
        known: dict[str, list[list]] = {}
        sums: dict[tuple[str, int, str, str], list[int]] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in slices(batches, 256):
            left = []
            for host_, key, html, packed in zip(*(x.to_pylist() for x in batch.columns[:3]), batch.column(3), strict=True):
                page = Page(html)
                if page.size == 1:
                    continue
                if host_ not in known:
                    if sum(map(len, known.values())) >= KEPT:
                        known.clear()
                    known[host_] = json.loads(zlib.decompress(packed.as_py())) if packed.is_valid else []
                for first in known[host_]:
                    layout, base = first
                    if layout == key:
                        break
                    if isinstance(base, str):
                        base = first[1] = Page(base)
                    if (pairs := alike(base, page)) is not None:
                        for (kind, value), (n, m) in tally(pairs, page).items():
                            x = sums.setdefault((host_, layout, kind, value), [0, 0])
                            x[0] += n
                            x[1] += m
                        break
                else:
                    left.append((host_, key, "rest", html, 0, 0))
            if left:
                yield out(left)
            if len(sums) > COUNTS:
                yield out([(*k, *x) for k, x in sums.items()])
                sums.clear()
        if sums:
            yield out([(*k, *x) for k, x in sums.items()])

    return rest.join(firsts, "host", "left").select("host", "key", "html", "layouts").mapInArrow(lean(run), "host string, layout long, kind string, value string, n long, m long")


def wrappers(pages: DataFrame) -> DataFrame:
    """(url, html) to (host, wrapper as JSON), from all pages of each host.

    A page belongs to the first layout whose first page shares LIKE of the elements of the smaller of the two. Rounds
    draw first pages from those that are like none so far, until there are no such pages. A layout's slot holds SHARE of
    the text that differs from the first page's, summed over all its pages, and comes once in SHARE of them at least;
    its template texts are the first page's that SHARE of its pages have in the same place.
    """
    rest = pages.where("html IS NOT NULL AND html <> ''").select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("key"), "html")
    drawn, rounds = DRAWN, []
    while not rounds or not found.where("kind = 'rest'").isEmpty():
        found = written(counted(rest, first_pages(rest, drawn)), "counted")
        rounds.append(found.where("kind <> 'rest'"))
        # dealt anew, as pages that are like none may lie in few files; not to more tasks, as each makes trees of the first pages
        rest = found.where("kind = 'rest'").select("host", F.col("layout").alias("key"), F.col("value").alias("html")).repartition(pages.sparkSession.sparkContext.defaultParallelism)
        drawn = min(2 * drawn, MOST)
    sums = written(functools.reduce(DataFrame.unionByName, rounds).groupBy("host", "layout", "kind", "value").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "sums")
    paths = sums.where("kind = 'path'")
    most = paths.groupBy("host", "layout").agg(F.max("n").alias("best"))
    many = sums.where("kind = 'pages'").select("host", "layout", F.col("n").alias("pages"))
    slots = paths.join(most, ["host", "layout"]).join(many, ["host", "layout"]).where((F.col("n") >= SHARE * F.col("best")) & (F.col("m") <= (1 - SHARE) * F.col("pages")))
    same = sums.where("kind = 'same'").join(many, ["host", "layout"]).where((F.col("pages") > 1) & (F.col("n") >= SHARE * F.col("pages")))
    columns = ["host", "pages", "layout", "kind", "value"]

    def learn(group: pa.Table) -> pa.Table:
        found = wrapper(zip(*(group.column(c).to_pylist() for c in columns[1:]), strict=True))
        return pa.table({"host": group.column("host")[:1].combine_chunks(), "wrapper": [json.dumps(found)]})

    return slots.select(columns).unionByName(same.select(columns)).groupBy("host").applyInArrow(learn, "host string, wrapper string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, induced (whether the host's wrapper said where the text is).

    Null or empty html gives an empty text; a null url or one without a host belongs to the host ''. A host with a
    single page, or copies of one, has no template, and a page may have a layout of its own: there names and roles of
    elements decide alone. Repeated rows are extracted each; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    learnt = written(wrappers(rows), "wrappers").select(F.col("host").alias("of"), "wrapper")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, dict] = {}
        for batch in batches:
            out, induced = [], []
            for page, wrapper in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if wrapper is not None and wrapper not in read:
                    if len(read) > 1000:
                        read.clear()
                    read[wrapper] = json.loads(wrapper)
                text, by = extract(page.as_py(), read.get(wrapper) if wrapper is not None else None)
                out.append(text)
                induced.append(by)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(induced, pa.bool_())], ["id", "url", "text", "induced"])

    return rows.join(learnt, host(F.col("url")) == F.col("of"), "left").select("id", "url", "html", "wrapper").mapInArrow(run, "id long, url string, text string, induced boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "induced")
