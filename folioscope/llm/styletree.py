"""Main text of web pages with a style tree per site.

Pages of one host are merged: nodes with the same chain of tags, classes and ids are one node
of the host's tree. A node's presentation importance is the entropy of its child sequences over
the pages; its content importance is how little the texts below it repeat between pages. The
composite importance weighs both. Branches of low importance that many pages share are removed
from each page. Counts are summed before the shuffle by (host, node, value), so a host with a
third of all pages is no hot group, and no host is ever gathered in one task.

Entropy cannot tell a menu that differs on every page from an article, nor an article that a
site repeats from a notice. So tags and names decide first: menus, footers, sidebars, notices,
adverts, forms, comments and the like go. Where a page marks regions (`main`, `article`), only
regions are read: of all outermost ones the `main` or the articles that hold most text once the tree
has had its say, a `main` in a tie. Inside an article, or a `main` that holds none, the tree removes
nothing: headings, lists and notes that recur there are the article's. It decides on what stands in
a `main` beside an article, and on pages whose markup names no region. Equal pages of a host count
once, so copies make nothing look repeated. A page that the tree would leave empty keeps its text.

Defined results: null or empty html has an empty text; pages without a host form one site;
repeated rows each get their text; other columns stay, in struct `row`. Broken markup is read as
browsers do in outline: unknown end tags are skipped, an open `p` or `li` ends at the next.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from folioscope.llm.common import stored
from folioscope.llm.rangejoin import parts

#: A branch is removed if at least MIN_PAGES pages of the host hold it and its importance is lower.
MIN_PAGES, LOW = 8, 0.3
#: Nodes to remove, of all hosts together, that may go to every task: 8 bytes each.
BROADCAST_NODES = 1_000_000
#: Ways that a host's pages are dealt out otherwise.
SALTS = 32
#: Share of content in a node's composite importance; presentation has the rest.
CONTENT = 0.9

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe noembed noframes xmp template".split())
DROPPED = set(
    "head nav footer aside form button select option datalist label fieldset dialog menu svg canvas "
    "object audio video applet map".split()
) | RAW
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr td th input".split()
)
#: Parts of class and id names that mark what does not belong to an article.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor "
    "sponsored cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login sidebar related recommended recommendations share sharing social "
    "comment comments disqus reply replies respond menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead toolbar pagination pager widget widgets".split()
)
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Names of an article that is a reader's.
READERS = set("comment comments disqus reply replies respond".split())
#: Open elements that a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEP_OPEN = set("article main section div table ul ol body html td blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</?[a-zA-Z](?:(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*+>?)", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\s(class|id|role|hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _hash(*parts_: object) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts_)).encode("utf-8", "replace")) - (1 << 63)


class Node:
    """An open element: its place in the style tree and what it means for the text below.

    `region` is 1 in a `main`, 2 in an `article`; `outer` the outermost of these around it.
    """

    __slots__ = ("tag", "path", "drop", "region", "outer", "children")

    def __init__(self, tag: str, path: int, drop: bool, region: int, outer: Node | None = None):
        self.tag, self.path, self.drop, self.region = tag, path, drop, region
        self.outer = outer or (self if region else None)
        self.children: list[str] = []


def _unwanted(tag: str, attributes: dict[str, str], region: int) -> bool:
    if tag in DROPPED or "hidden" in attributes or attributes.get("role", "").lower() in ROLES:
        return True
    if tag == "header" and not region:
        return True
    if tag == "article":
        return bool(_words(attributes) & (NAMES if region else READERS))
    if tag in ("html", "body", "main"):
        return False
    return _named(attributes) or (not region and "header" in _words(attributes))


def _words(attributes: dict[str, str]) -> set[str]:
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return {w.lower() for w in _PIECES.findall(named)}


def _named(attributes: dict[str, str]) -> bool:
    return bool(_words(attributes) & NAMES)


def walk(page: str) -> Iterator[tuple]:
    """Text pieces and block borders of a page: (text or None, node chain); ends with the nodes.

    Yields ("text", string, stack), ("break",) and ("close", node) for every element.
    """
    root = Node("", _hash("root"), False, 0)
    stack = [root]

    def close(to: int) -> Iterator[tuple]:
        while len(stack) > to:
            node = stack.pop()
            if node.tag not in INLINE:
                yield ("break",)
            yield ("close", node)

    at = 0
    while True:
        match = _TOKEN.search(page, at)
        end = match.start() if match else len(page)
        if end > at:
            yield ("text", page[at:end], stack)
        if not match:
            break
        token, at = match.group(), match.end()
        name = _NAME.match(token)
        if not name:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            if tag == "p" and not any(n.tag == "p" for n in stack):
                yield ("break",)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    yield from close(k)
                    break
                if tag in INLINE and stack[k].tag in KEEP_OPEN:
                    break
            continue
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(token)}
        if tag not in INLINE or tag in ("td", "th"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS.get(tag, ()) or (stack[k].tag == "p" and tag not in INLINE):
                    yield from close(k)
                    break
                if stack[k].tag in KEEP_OPEN and stack[k].tag not in ENDS.get(tag, ()):
                    break
        top = stack[-1]
        style = re.sub(r"\d{3,}", "0", f"{tag}.{attributes.get('class', '')}#{attributes.get('id', '')}")
        top.children.append(style)
        if tag in VOID:
            yield ("text", " ", stack) if tag in INLINE else ("break",)
            continue
        region = max(top.region, 2 if tag == "article" else 1 if tag == "main" else 0)
        drop = top.drop or _unwanted(tag, attributes, top.region)
        node = Node(tag, _hash(top.path, style), drop, region, top.outer)
        if tag in ("td", "th"):
            yield ("text", " ", stack)
        elif tag not in INLINE:
            yield ("break",)
        stack.append(node)
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])|\\Z", re.I).search(page, at)
            at = stop.start()
    yield from close(1)


def _squeeze(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


def features(page: str) -> tuple[dict[int, tuple[int, ...]], set[tuple[int, int, int]]]:
    """Nodes of a page with their chains, and its (node, kind, value): 0 child sequence, 1 text."""
    chains: dict[int, tuple[int, ...]] = {}
    found: set[tuple[int, int, int]] = set()
    for event in walk(page):
        if event[0] == "text":
            stack = event[2]
            if not stack[-1].drop and (text := " ".join(event[1].split())):
                chain = tuple(n.path for n in stack)
                chains[chain[-1]] = chain
                found.add((chain[-1], 1, _hash(text)))
                for k, path in enumerate(chain):
                    if path not in chains:
                        chains[path] = chain[: k + 1]
        elif event[0] == "close" and not event[1].drop:
            found.add((event[1].path, 0, _hash(*event[1].children)))
    return chains, {f for f in found if f[0] in chains}


def main_text(page: str, low: set[int]) -> str:
    """The text of a page's article without the nodes of low importance."""
    #: Blocks as (outermost region, inside an article, of low importance, pieces).
    blocks: list[tuple[Node | None, bool, bool, list[str]]] = []
    fresh = True
    for event in walk(page):
        if event[0] == "break":
            fresh = True
        elif event[0] == "text":
            stack = event[2]
            top = stack[-1]
            if top.drop:
                continue
            weak = bool(low) and any(n.path in low for n in stack)
            place = (top.outer, top.region == 2, weak)
            if fresh or blocks[-1][:3] != place:
                blocks.append((*place, []))
                fresh = False
            blocks[-1][3].append(event[1])
    texts = [(*place, text) for *place, pieces in blocks if (text := _squeeze(pieces))]
    # A main without an article is the article itself.
    holds = {outer for outer, inside, _, _ in texts if inside}
    texts = [
        (outer, weak and not inside and (outer is None or outer in holds), text) for outer, inside, weak, text in texts
    ]
    chosen = _region({outer for outer, *_ in blocks}, texts)
    texts = [(weak, text) for outer, weak, text in texts if outer in chosen]
    strong = "\n\n".join(text for weak, text in texts if not weak)
    return strong or "\n\n".join(text for _, text in texts)


def _region(seen: set[Node | None], texts: list[tuple[Node | None, bool, str]]) -> set[Node | None]:
    """The outermost regions that are read: the fullest main, or all articles if one holds more."""
    amount = {outer: 0 for outer in seen if outer is not None}
    if not amount:
        return {None}
    for outer, weak, text in texts:
        if outer is not None and not weak:
            amount[outer] += len(text)
    mains = [node for node in amount if node.tag == "main"]
    articles = [node for node in amount if node.tag == "article"]
    fullest = max(mains, key=amount.__getitem__, default=None)
    longest = max((amount[node] for node in articles), default=0)
    if fullest is not None and amount[fullest] >= longest:
        return {fullest}
    return set(articles)


def _distinct(slim: DataFrame) -> DataFrame:
    """Each page of a host once; only pages that have copies are shuffled."""
    marked = slim.withColumn("print", F.xxhash64("host", "html"))
    again = stored(marked.groupBy("print").count().where("count > 1").select("print"))
    if again.count() <= BROADCAST_NODES:
        again = F.broadcast(again)
    copies = marked.join(again, "print", "left_semi").dropDuplicates(["print"])
    return marked.join(again, "print", "left_anti").unionByName(copies).select("host", "html")


def importance(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The importance of every node of every host: host, path, pages, presentation, content."""
    schema = "host string, path long, chain array<long>, kind int, value long, pages long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains: dict = {}
            counts: Counter = Counter()
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                nodes, found = features(page.as_py() or "")
                chains.update(nodes)  # a path's fingerprint stands for its chain
                counts.update((host, path, 2, 0) for path in nodes)
                counts.update((host, *f) for f in found)
            columns = list(zip(*counts)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                    pa.array([chains[p] for p in columns[1]], pa.list_(pa.int64())),
                    pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                ["host", "path", "chain", "kind", "value", "pages"],
            )

    host, _ = parts("url")
    slim = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).select(host.alias("host"), "html")
    slim = _distinct(slim)
    seen = slim.mapInArrow(count, schema)
    values = seen.groupBy("host", "path", "kind", "value").agg(
        F.sum("pages").alias("n"), F.first("chain").alias("chain")
    )
    kind, n = F.col("kind"), F.col("n")
    nodes = stored(values.groupBy("host", "path").agg(
        F.max(F.when(kind == 2, n)).alias("pages"),
        F.sum(F.when(kind == 0, n * F.log(n))).alias("shapes_log"),
        F.sum(F.when(kind == 0, n)).alias("shapes"),
        F.sum(F.when(kind == 1, n * F.log(n))).alias("texts_log"),
        F.sum(F.when(kind == 1, n)).alias("texts"),
        F.first("chain").alias("chain"),
    ))
    own = F.when(
        F.col("pages") > 1, 1 - F.col("texts_log") / (F.col("texts") * F.log("pages"))
    ).otherwise(F.lit(1.0))
    below = (
        nodes.where("texts > 0")
        .select("host", F.explode("chain").alias("path"), "texts", (own * F.col("texts")).alias("worth"))
        .groupBy("host", "path")
        .agg((F.sum("worth") / F.sum("texts")).alias("content"))
    )
    shape = F.when(
        (F.col("pages") > 1) & (F.col("shapes") > 0),
        (F.log("shapes") - F.col("shapes_log") / F.col("shapes")) / F.log("pages"),
    ).otherwise(F.lit(1.0))
    return nodes.select("host", "path", "pages", F.least(shape, F.lit(1.0)).alias("presentation")).join(
        below, ["host", "path"]
    )


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Every row as struct `row` with the text of its article."""
    worth = F.lit(CONTENT) * F.col("content") + F.lit(1 - CONTENT) * F.col("presentation")
    low = stored(
        importance(pages, url, html)
        .where((F.col("pages") >= MIN_PAGES) & (worth < LOW))
        .groupBy("host").agg(F.collect_set("path").alias("low"))
    )
    shape = T.StructType([T.StructField("row", pages.schema), T.StructField("text", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column("row").field(html)
            texts = [
                main_text(page.as_py() or "", set(paths.as_py() or ()))
                for page, paths in zip(content, batch.column("low"))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    host, _ = parts("url")
    rows = pages.select(F.struct("*").alias("row"), F.col(url).alias("url"))
    rows = rows.select("row", host.alias("host"))
    if (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_NODES:
        rows = rows.join(F.broadcast(low), "host", "left")
    else:  # a host may own a third of all pages, so its pages are dealt out by salt
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("salt", salt).join(low.withColumn("salt", every), ["host", "salt"], "left")
    return rows.select("row", "low").mapInArrow(read, shape)
