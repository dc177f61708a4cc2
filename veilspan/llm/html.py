"""Main text of web pages by wrapper induction.

For each host a few pages are parsed and their trees aligned with that of the first by simple tree
matching. Slots whose text varies are content. The wrapper is the path to the smallest element that holds all content outside
menus, adverts and the like. Texts that stand at the same tags inside it on most of these pages may
be template; they are if nearly all pages of the host have them, which all are counted for. Every
page is then cut by its wrapper, where template goes only with its very text; a page whose tree
lacks the wrapper's path is judged by its own.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import cut_lineage, ship

#: Pages of a host that are aligned, those with the smallest hash. Larger trees than this, by nodes
#: or depth, are aligned part by part from the top. Of an element with more than WIDE children those
#: in the middle stay unaligned: they count as varying, so that the content element holds them.
PAGES, NODES, DEPTH, WIDE = 6, 1500, 150, 200
#: Template stands on so many of the host's pages at least.
CONSTANT = 0.9
#: Links outside of these are navigation and do not tell where content is.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())

# Fixed sets of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of these kinds; the search stops at the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: An end tag does not reach out of these.
SCOPE = frozenset("html body article main section aside nav header footer td th table form div".split())

#: Elements that never hold main text.
SKIPPED = frozenset(
    "nav aside footer form script style noscript template iframe object svg math canvas button select "
    "textarea dialog menu head title audio video map datalist input xmp noembed noframes".split()
)
_NOISE = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|sidebar|side[-_]?bar|menu|nav|"
    r"navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|"
    r"overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|"
    r"comments?|disqus|replies|respond|footer|masthead|toolbar|widget|skip[-_]?link|pagination|pager)"
    r"(?:$|[-_ ])",
    re.I,
)
_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split()
)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_KEEP = re.compile(r"\b(?:class|id|role|hidden|aria-hidden|style)\b", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: tag, signature (tag and classes), whether it is noise, and its children, which
    are nodes and texts in page order."""

    __slots__ = ("children", "cut", "noise", "sign", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.cut = tag, [], False
        self.sign, self.noise = tag, tag in SKIPPED
        if attributes and _KEEP.search(attributes):
            given = {
                m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(_ATTRIBUTE.finditer(attributes)))
            }
            names = f"{given.get('class', '')} {given.get('id', '')}"
            if given.get("class"):
                self.sign = f"{tag}.{'.'.join(sorted(given['class'].split()))}"
            self.noise = self.noise or (
                tag not in ("html", "body", "article", "main") and bool(_NOISE.search(names))
                or given.get("role", "").lower() in _ROLES
                or "hidden" in given
                or given.get("aria-hidden", "").lower() == "true"
                or bool(_HIDDEN.search(given.get("style", "")))
                or tag == "article" and bool(re.search(r"\bcomment", names, re.I))
            )

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def upper(self) -> list[Node]:
        """Child nodes that take part in the alignment."""
        return [c for c in self.nodes() if not c.cut]


def parse(page: str) -> Node:
    """The tree of a page, however broken; texts keep their references and white space."""
    root = Node("#root")
    stack = [root]
    at, size = 0, len(page)
    while at < size:
        open_at = page.find("<", at)
        if open_at < 0:
            stack[-1].children.append(page[at:])
            break
        m = _TAG.match(page, open_at)
        if not m:  # a lone < is text
            stack[-1].children.append(page[at : open_at + 1])
            at = open_at + 1
            continue
        if open_at > at:
            stack[-1].children.append(page[at:open_at])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = name.lower()
        if m[1] or m[4]:
            _close(stack, tag)
            continue
        if tag in BLOCK:
            _close_paragraph(stack)
        if tag in CLOSES:
            _close_implied(stack, *CLOSES[tag])
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        attributes = m[3] or m[6] or ""
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
            node.children.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else size
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path", "use")):
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in SCOPE and tag not in SCOPE:
            return


def _close_paragraph(stack: list[Node]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == "p":
            del stack[k:]
            return
        if stack[k].tag in SCOPE or stack[k].tag in ("li", "button", "blockquote"):
            return


def _close_implied(stack: list[Node], ended: set[str], stops: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in ended:
            del stack[k:]
            if "tr" not in ended:
                return
        elif stack[k].tag in stops:
            return


def blocks(node: Node, dropped: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks below a node in page order, without noise and dropped nodes (by id())."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x is not node and (x.noise or id(x) in dropped):
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            parts.append("\n")
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo.extend(reversed(x.children))
        else:
            todo.extend(reversed(x.children))
    flush()
    return out


def steps(node: Node) -> list[tuple[str, Node]]:
    """Children with their place among those of the same signature."""
    seen: dict[str, int] = {}
    out = []
    for child in node.nodes():
        k = seen[child.sign] = seen.get(child.sign, -1) + 1
        out.append((f"{child.sign}[{k}]", child))
    return out


def _own_text(node: Node) -> str:
    return " ".join(" ".join([c for c in node.children if isinstance(c, str)]).split())


def match(a: Node, b: Node, memo: dict) -> int:
    """Size of the largest common top-down tree (simple tree matching)."""
    if a.sign != b.sign:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + _table(a.upper(), b.upper(), memo)[-1][-1]
    return memo[key]


def _table(xs: list[Node], ys: list[Node], memo: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = rows[-1], [0]
        for j, y in enumerate(ys):
            both = above[j] + match(x, y, memo) if x.sign == y.sign else 0
            row.append(max(above[j + 1], row[-1], both))
        rows.append(row)
    return rows


def aligned(a: Node, b: Node, memo: dict) -> Iterator[tuple[Node, Node]]:
    """Pairs of nodes that the largest common tree puts on each other."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        yield x, y
        xs, ys = x.upper(), y.upper()
        rows = _table(xs, ys, memo)
        i, j = len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((xs[i], ys[j]))


def _limit(root: Node) -> None:
    """Keep the upper NODES nodes below a root for the alignment, DEPTH levels at most."""
    level, left = [root], NODES
    for depth in range(DEPTH + 1):
        below = []
        for x in level:
            own = x.nodes()
            room = min(len(own), left, WIDE) if depth < DEPTH else 0
            left -= room
            for i, c in enumerate(own):
                c.cut = room - room // 2 <= i < len(own) - room // 2
            below += x.upper()
        level = below


def all_aligned(a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
    """Pairs of aligned nodes of trees of any size, part by part."""
    parts = [(a, b)]
    while parts:
        top = parts.pop()
        for x in top:
            _limit(x)
        for pair in list(aligned(*top, {})):
            if pair != top and any(c.cut for x in pair for c in x.nodes()):
                parts.append(pair)
            else:
                yield pair


def _digest(*parts: str) -> str:
    return blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).hexdigest()


def slots(content: Node) -> list[tuple[str, Node]]:
    """The nodes below an element, outside noise, that have a text of their own, each with a key:
    a digest of the signatures that lead to it and of all that is in it."""
    order = [(content, "")]
    for x, way in order:
        order.extend((c, _digest(way, c.sign)) for c in x.nodes() if not c.noise)
    whole: dict[int, str] = {}
    for x, _ in reversed(order):
        parts = [" ".join(c.split()) if isinstance(c, str) else whole.get(id(c), "") for c in x.children]
        whole[id(x)] = _digest(x.sign, *filter(None, parts))
    return [(_digest(way, whole[id(x)]), x) for x, way in order[1:] if _own_text(x)]


def induce(pages: list[str]) -> dict | None:
    """The wrapper of a host's pages: path of the content element, and keys of the slots inside it
    that may be template; None if the pages tell nothing."""
    trees = [parse(page) for page in dict.fromkeys(pages)]
    if len(trees) < 2:
        return None
    first, others = trees[0], trees[1:]
    seen: dict[int, list[str]] = {}
    more: set[int] = set()  # elements of the first page in which another page has text of its own
    for other in others:
        partner = {id(y): x for x, y in all_aligned(first, other)}
        todo = [(other, first, False)]
        while todo:
            y, around, prose = todo.pop()
            x, prose = partner.get(id(y)), prose or y.tag in PROSE
            if y.noise or y.tag == "a" and not prose:
                continue
            if x is not None:
                seen.setdefault(id(x), []).append(_own_text(y))
            elif _own_text(y):
                more.add(id(around))
            todo.extend((c, x or around, prose) for c in y.nodes())
    varying = _varying(first, seen, more)
    if not varying[id(first)]:
        return None
    path: list[str] = []
    node = first
    while node.tag not in ("article", "main"):
        held = [(step, c) for step, c in steps(node) if varying.get(id(c))]
        own = varying[id(node)] - sum(varying[id(c)] for _, c in held)
        if own or len(held) != 1 or held[0][1].tag not in BLOCK - PROSE - {"li"}:
            break
        path.append(held[0][0])
        node = held[0][1]
    constant: list[str] = []
    if node.tag not in ("article", "main"):
        # All of an article is content; elsewhere what stands on most pages may be template.
        held_by = Counter(key for tree in trees for key in _keys_of(tree, path))
        constant = sorted(k for k, n in held_by.items() if n >= 3 and 2 * n > len(trees))
    return {"path": path, "constant": constant}


def _keys_of(root: Node, path: list[str]) -> set[str]:
    content = _walk(root, path)
    return set() if content is None else {key for key, _ in slots(content)}


def _varying(root: Node, seen: dict[int, list[str]], more: set[int]) -> dict[int, int]:
    """By id(), of each node outside noise and navigation, how many nodes in it have a text that is
    not the same on all pages, or other pages have more in them."""
    order: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    for x, _, prose in order:
        inside = prose or x.tag in PROSE
        order.extend((c, x, inside) for c in x.nodes() if not c.noise and (inside or c.tag != "a"))
    out = dict.fromkeys([id(x) for x, _, _ in order], 0)
    for x, around, _ in reversed(order):
        own = _own_text(x)
        out[id(x)] += id(x) in more or bool(own and any(t != own for t in seen.get(id(x), [""])))
        if around is not None:
            out[id(around)] += out[id(x)]
    return out


def _walk(node: Node, path: list[str]) -> Node | None:
    for step in path:
        node = next((c for s, c in steps(node) if s == step), None)
        if node is None:
            return None
    return node


def _largest(root: Node, tag: str) -> list[Node]:
    """The element of a kind with the most text, outside noise and other such elements, and its
    siblings of that kind."""
    found, todo = [], [(root, [root])]
    while todo:
        x, siblings = todo.pop()
        if x.noise:
            continue
        if x.tag == tag:
            found.append((x, siblings))
        else:
            own = x.nodes()
            todo.extend((c, own) for c in reversed(own))
    if not found:
        return []
    _, siblings = max(found, key=lambda f: sum(map(len, blocks(f[0]))))
    return [x for x in siblings if x.tag == tag and not x.noise]


def extract(page: str, wrapper: dict | None) -> str:
    """The main text of a page: the wrapper's element, else the page's articles, main or body."""
    root = parse(page)
    dropped: frozenset[int] = frozenset()
    content = _walk(root, wrapper["path"]) if wrapper else None
    if content is None:
        parts = _largest(root, "article") or _largest(root, "main") or _largest(root, "body") or [root]
    elif content.tag in ("article", "main"):
        around = _walk(root, wrapper["path"][:-1])
        parts = [x for x in around.nodes() if x.tag == content.tag and not x.noise]
    else:
        parts = _largest(content, "article") or _largest(content, "main")
        if not parts:
            parts = [content]
            template = set(wrapper["constant"])
            if template:
                dropped = frozenset(id(x) for key, x in slots(content) if key in template)
    return "\n".join([text for part in parts for text in blocks(part, dropped)])


def host(url):
    """The host of a url, in lower case; null and others without one share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", most: int = PAGES) -> DataFrame:
    """host_ and wrapper (JSON) of each host with at least two different pages."""
    rows = pages.select(host(F.col(url_col)).alias("host_"), F.col(html_col).alias("html_")).filter(
        "html_ IS NOT NULL"
    )
    rows = rows.withColumn("hash_", F.xxhash64("host_", "html_"))
    # The limit by rank is applied within each task before anything is shuffled.
    order = Window.partitionBy("host_").orderBy("hash_")
    few = rows.withColumn("n_", F.row_number().over(order)).filter(F.col("n_") <= most)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        wrapper = induce(group.sort_values("n_")["html_"].tolist())
        return pd.DataFrame({"host_": [group["host_"].iloc[0]], "wrapper": [json.dumps(wrapper)]})

    return few.groupBy("host_").applyInPandas(learn, "host_ string, wrapper string")


def confirmed(pages: DataFrame, learned: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``learned`` with only those slots in its wrappers that nearly all pages of the host have."""
    open_ = learned.filter("get_json_object(wrapper, '$.constant') <> '[]'")
    rows = (
        pages.select(host(F.col(url_col)).alias("host_"), F.col(html_col).alias("html_"))
        .filter("html_ <> ''")
        .join(open_, "host_")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for name, page, plan in zip(batch["host_"], batch["html_"], batch["wrapper"], strict=True):
                wrapper = json.loads(plan)
                seen[name, ""] += 1
                seen.update((name, k) for k in _keys_of(parse(page), wrapper["path"]).intersection(wrapper["constant"]))
            if len(seen) > 100_000:
                yield _counted(seen)
                seen.clear()
        yield _counted(seen)

    n = rows.select("host_", "html_", "wrapper").mapInPandas(count, "host_ string, key string, n long")
    n = n.groupBy("host_", "key").agg(F.sum("n").alias("n"))
    # Keys of a host come from its few aligned pages, so the list is as short as those are.
    by_host = n.groupBy("host_").agg(
        F.max(F.when(F.col("key") == "", F.col("n"))).alias("pages_"),
        F.collect_list(F.when(F.col("key") != "", F.struct("key", "n"))).alias("keys_"),
    )
    kept = F.expr(f"transform(filter(keys_, x -> x.n >= {CONSTANT} * pages_), x -> x.key)")
    by_host = by_host.select("host_", F.array_sort(kept).alias("kept_"))
    path = F.from_json("wrapper", "path array<string>")["path"]
    anew = F.to_json(F.struct(path.alias("path"), F.col("kept_").alias("constant")))
    return learned.join(by_host, "host_", "left").select(
        "host_", F.when(F.col("kept_").isNull(), F.col("wrapper")).otherwise(anew).alias("wrapper")
    )


def _counted(seen: Counter) -> pd.DataFrame:
    return pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["host_", "key", "n"]).astype({"n": "int64"})


def main_texts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with main_text and wrapper (JSON, null without one) added.

    Null and empty pages have an empty text. Pages without a host count as one host's. Rows come
    back as they are given, repeated or without an id; an empty table gives no rows. Columns of ``pages`` with the new names are replaced.
    """
    ship(pages.sparkSession)
    pages = pages.drop("main_text", "wrapper")
    learned = cut_lineage(wrappers(pages, url_col, html_col))
    learned = cut_lineage(confirmed(pages, learned, url_col, html_col)).withColumnRenamed("host_", "__host")

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, dict | None] = {}
        for htmls, plans in batches:
            out = []
            for page, plan in zip(htmls, plans, strict=True):
                if plan and plan not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[plan] = json.loads(plan)
                out.append(extract(page, known[plan] if plan else None) if page else "")
            yield pd.Series(out, dtype=object)

    joined = pages.withColumn("__host", host(F.col(url_col))).join(learned, "__host", "left")
    return joined.select(*pages.columns, "wrapper", cut(F.col(html_col), F.col("wrapper")).alias("main_text"))
