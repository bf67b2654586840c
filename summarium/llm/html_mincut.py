"""Main-text extraction by minimum-cut labelling.

A page is cut into blocks (text between block-level tags).  A classifier gives every
block an evidence from its text alone (length, link density, sentence end, heading),
which becomes its capacity from the source or to the sink.  Elements that mark a zone
(``article``, ``nav``, ``footer``, class words such as ``sidebar``) are nodes of their
own: their mark is their terminal capacity, and an edge joins each block with its nearest
zone.  Blocks that follow one another, and blocks that follow one another under the same
parent, are joined by smoothness edges whose capacity falls with their distance in the
document tree and across the border of a zone.  The maximum flow separates content from
boilerplate, so a short line of an article stays and a long paragraph of a footer goes.

A zone that holds the page's principal element (``main``, else the ``article`` with most
text or the first ``h1``, where the zone also has half the page's text) is a wrapper, and its mark is
ignored.  So are class words that only say that something else has a feature
(``has-sidebar``, ``ad-free``, ``comments-open``).  Where the cut finds no content, the
evidence of the blocks outside marked zones is raised to that of the best one.

Scale: row-local, no shuffle; one Arrow function over the html column.  Nodes whose
evidence exceeds all their edges are settled first and folded into their neighbours, so
the flow runs on the few that are left; parsing visits each tag once, so pages of any
length and nesting stay linear.

Defined cases: null and empty html give an empty text of length 0, an empty table an
empty result; unclosed tags, comments, scripts and quotes end where a browser would end
them or with the page; unmatched closing tags are skipped; very long pages are read whole;
a page whose blocks all lie in boilerplate zones gives an empty text; null ids are kept,
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset("""address article aside blockquote body br button caption center dd
    details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol option p pre search section select
    summary table tbody td tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("""area base br col embed hr img input link meta param source track
    wbr""".split())
#: Their content is no text of the page.
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math xmp "
                     "noembed noframes object audio video canvas".split())
#: An opening tag ends an open element of its group.
CLOSED_BY = {"p": BLOCK_TAGS - {"br"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")),
             "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")),
             "td": frozenset(("td", "th", "tr", "tbody")), "th": frozenset(("td", "th", "tr", "tbody")),
             "option": frozenset(("option",))}

#: Tags that hold no two of their kind without one of these between them.
SCOPES = frozenset("table div section article ul ol td th tr".split())
TABLE_PARTS = frozenset("tr td th tbody tfoot".split())

BOILER_TAGS = frozenset("nav footer aside menu dialog button select search label form".split())
MAIN_TAGS = frozenset(("article", "main"))
BOILER_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adbox adsense aside
    banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright
    dialog discussion disqus disclaimer follow footer gdpr header masthead menu modal nav navbar
    navigation newsletter notice notices notification notifications overlay pager pagination
    popup promo promoted promotion recommend recommendations recommended related replies reply
    respond search share sharing sidebar sidebars signin signup login register skip social sponsor
    sponsored sponsors subscribe subscription syndication teaser teasers toolbar topbar tracking
    trending widget widgets alert alerts feedback rating ratings reviews""".split())
MAIN_WORDS = frozenset("article content entry main post story prose".split())
#: What a header belongs to that is the title of an article.
TITLED = frozenset("article entry post story".split())
#: A class that begins or ends so says what an element has or lacks, not what it is.
MODIFIER_FIRST = frozenset("has no not with without is hide show".split())
MODIFIER_LAST = frozenset("free less open closed enabled disabled on off layout visible".split())
#: Classes of an article that name its labels.
LABEL_FIRST = frozenset("category tag type format status".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog "
                         "alert alertdialog menu menubar toolbar".split())

# Evidence for content (positive) from the text of a block, in log-odds.
BIAS, PER_LENGTH, PER_LINKS, SENTENCE, HEADING = -1.0, 0.7, -5.0, 0.8, 0.6
RIGHTS = -3.0
# Terminal capacity of a zone's mark.
SURE = float("inf")
# Edges from a block to its zone: above any evidence and smoothness for boilerplate.
TO_BOILER, TO_MAIN = 20.0, 5.0
# Smoothness: neighbours in the same parent, across a zone's border, and the number of
# steps in the tree beyond which it no longer falls.
SMOOTH, ACROSS, FAR = 2.0, 0.25, 12

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)
    | <!\[CDATA\[.*?(?:\]\]>|\Z)
    | <[!?][^>]*(?:>|\Z)
    | <(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>
    | <(/?)([A-Za-z][^\s/>]*+)([^>]*)(?:>|\Z)""", re.X | re.S)
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RIGHTS = re.compile(r"(?i:©|\(c\)|copyright|all rights reserved)")


class _Element:
    __slots__ = ("tag", "parent", "depth", "block", "scope", "link", "hidden", "words", "mark", "role",
                 "chars", "holds", "zone")

    def __init__(self, tag, parent):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if parent is None or tag in BLOCK_TAGS else parent.block
        #: The nearest element around that an opening tag may end, itself included.
        self.scope = self if tag in CLOSED_BY else (
            None if parent is None or tag in SCOPES else parent.scope)
        self.link = tag == "a" or parent is not None and parent.link
        self.hidden = parent is not None and parent.hidden
        self.words, self.role = (), ""
        self.chars, self.holds, self.zone = 0, False, None


def _describe(e: _Element, attributes: str) -> None:
    """Keep what the attributes say: the words of every class and id, role, hidden."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names = [[w.lower() for w in _NAME_WORD.findall(x)] for x in value.split()]
            e.words += tuple(n for n in names if n)
        elif name == "role":
            e.role = value.lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            e.hidden = True
        elif name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            e.hidden = True


def _mark(e: _Element, in_main: bool) -> float:
    """The terminal capacity that tag, role and classes give an element; 0 for none."""
    tag = e.tag
    if tag in ("", "html", "body"):
        return 0.0
    if tag in BOILER_TAGS or e.role in BOILER_ROLES or tag == "header" and not in_main:
        return -SURE
    if tag == "main" or e.role in MAIN_TAGS:
        return SURE
    likely = False
    for name in e.words:
        if name[0] in MODIFIER_FIRST or len(name) > 1 and name[-1] in MODIFIER_LAST:
            continue
        if tag == "article" and name[0] in LABEL_FIRST:
            continue
        boiler = BOILER_WORDS.intersection(name)
        # the header of an article holds its title
        if boiler and not (boiler <= {"header", "byline"} and (in_main or TITLED.intersection(name))):
            return -SURE
        likely = likely or not MAIN_WORDS.isdisjoint(name)
    if tag == "article":
        return SURE
    return SURE if likely and tag in ("div", "section", "td") else 0.0


def _principal(elements: list[_Element]) -> _Element | None:
    """``main``, else the article with most text, else the first ``h1``."""
    for tag in ("main", "article", "h1"):
        found = [e for e in elements if e.tag == tag and not e.hidden
                 and (tag != "article" or _mark(e, False) > 0)]
        if found:
            return max(found, key=lambda e: e.chars) if tag == "article" else found[0]
    return None


def _zones(elements: list[_Element], blocks: list[Block]) -> list[_Element]:
    """Set every element's nearest zone; the zones.  ``elements`` are in page order."""
    for b in blocks:
        b.element.chars += len(b.text) - min(len(b.text), b.link_chars)
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.chars += e.chars
    principal = _principal(elements)
    total = elements[0].chars
    e = principal.parent if principal else None
    while e is not None:
        e.holds = principal.tag == "main" or 2 * e.chars > total
        e = e.parent
    out = []
    for e in elements:
        outer = e.parent.zone if e.parent is not None else None
        mark = _mark(e, outer is not None and outer.mark > 0)
        # a wrapper says nothing; content lies neither in boilerplate nor in content anew
        if mark < 0 and e.holds or mark > 0 and outer is not None:
            mark = 0.0
        e.mark = mark
        e.zone = e if mark else outer
        if mark:
            out.append(e)
    return out


class Block:
    __slots__ = ("text", "element", "link_chars")

    def __init__(self, text, element, link_chars):
        self.text, self.element, self.link_chars = text, element, link_chars


def parsed(page: str) -> tuple[list[Block], list[_Element]]:
    """The text blocks of a page in order, entities decoded, white space collapsed, and
    its elements in order, the root first."""
    root = _Element("", None)
    elements = [root]
    opened: Counter[str] = Counter()
    at, pieces, linked = root, [], 0
    out: list[Block] = []
    holder = root
    pos, n = 0, len(page)

    def flush():
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, holder, linked))
            pieces, linked = [], 0

    def add(raw):
        nonlocal linked, holder
        if at.hidden:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if not pieces:
            holder = at.block
        pieces.append(text)
        if at.link:
            linked += len(text.strip())

    def leave(tag):
        """Close the nearest open element of a tag and all inside it."""
        nonlocal at
        while True:
            e, at = at, at.parent
            opened[e.tag] -= 1
            if e.tag == tag:
                return

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            add(page[pos:])
            break
        if lt > pos:
            add(page[pos:lt])
        m = _TAG.match(page, lt)
        if m is None:
            add("<")
            pos = lt + 1
            continue
        pos = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            if page.startswith("<![CDATA[", lt):
                add(m.group()[9:-3])
            continue
        tag = name.lower()
        closing = m.group(1) or m.group(4)
        if tag in BLOCK_TAGS:
            flush()
        if closing:
            if opened[tag]:  # else it closes nothing
                leave(tag)
            continue
        attributes = m.group(3) or m.group(6) or ""
        if tag in RAW_TAGS:
            if not attributes.endswith("/"):
                end = re.compile(rf"(?i)</{tag}\b[^>]*(?:>|\Z)").search(page, pos)
                pos = end.end() if end else n
            continue
        if tag in VOID_TAGS:
            continue
        if tag in BLOCK_TAGS:
            e = at.scope  # what the new block closes
            while e is not None:
                if tag in CLOSED_BY[e.tag]:
                    leave(e.tag)
                    e = at.scope
                elif e.tag in SCOPES and tag not in TABLE_PARTS:
                    break
                else:
                    e = e.parent.scope
        at = _Element(tag, at)
        opened[tag] += 1
        elements.append(at)
        if attributes:
            _describe(at, attributes)
    flush()
    return out, elements


def evidence(b: Block) -> float:
    """Log-odds that the block is content, from its text alone."""
    e, text = b.element, b.text
    n = len(text)
    s = BIAS + PER_LENGTH * min(5.0, (n / 20) ** 0.5) + PER_LINKS * min(1.0, b.link_chars / n)
    if text[-1] in ".!?:;\"”»…" and n > 20:
        s += SENTENCE
    if len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1].isdigit():
        s += HEADING
    if n < 200 and _RIGHTS.search(text):
        s += RIGHTS
    return s


def tree_distance(a: _Element, b: _Element) -> int:
    """Steps between two elements over their lowest common ancestor, at most ``FAR``."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the next block, and to the next of the same parent."""
    out = []
    last: dict[int, int] = {}

    def join(i, j, w):
        same = blocks[i].element.zone is blocks[j].element.zone
        out.append((i, j, w if same else ACROSS * w))

    for j, b in enumerate(blocks):
        if j:
            d = tree_distance(blocks[j - 1].element, b.element)
            join(j - 1, j, SMOOTH / max(1, d - 1) ** 1.5)
        parent = id(b.element.parent or b.element)
        i = last.get(parent)
        if i is not None and i != j - 1:
            join(i, j, SMOOTH / 2)
        last[parent] = j
    return out


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    ``terminal[i]`` > 0 is the capacity from the source, < 0 that to the sink.  Nodes
    that no cut of their edges can turn are settled first; the rest is solved by
    Dinic's maximum flow."""
    n = len(terminal)
    t = list(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    load = [sum(d.values()) for d in near]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None or abs(t[i]) < load[i]:
            continue
        side[i] = t[i] > 0
        for j, w in near[i].items():
            t[j] += w if side[i] else -w
            del near[j][i]
            load[j] = load[j] - w if near[j] else 0.0
            queue.append(j)
        near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, source in zip(rest, _max_flow(rest, t, near)):
            side[i] = source
    return [bool(s) for s in side]


def _max_flow(nodes: list[int], t: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic on the undirected graph of ``nodes``; whether each is reachable from the
    source in the residual graph."""
    number = {v: k for k, v in enumerate(nodes)}
    n = len(nodes)
    S, T, EPS = n, n + 1, 1e-9
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for k, v in enumerate(nodes):
        if t[v] > 0:
            cap[S][k], cap[k][S] = t[v], 0.0
        elif t[v] < 0:
            cap[k][T], cap[T][k] = -t[v], 0.0
        for u, w in near[v].items():
            cap[k][number[u]] = w
    while True:
        level = [-1] * (n + 2)
        level[S] = 0
        queue = deque([S])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > EPS and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[T] < 0:
            return [level[k] >= 0 for k in range(n)]
        arcs = [list(c) for c in cap]
        path = [S]
        while path:  # augment along the level graph, without recursion
            u = path[-1]
            if u == T:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                path = [S]
                continue
            while arcs[u]:
                v = arcs[u][-1]
                if cap[u][v] > EPS and level[v] == level[u] + 1:
                    path.append(v)
                    break
                arcs[u].pop()
            else:
                path.pop()
                if path:
                    arcs[path[-1]].pop()


def labelled(page: str | None) -> list[tuple[str, bool]]:
    """(text, is content) of every block of a page."""
    blocks, elements = parsed(page or "")
    if not blocks:
        return []
    n = len(blocks)
    zones = _zones(elements, blocks)
    number = {id(z): n + k for k, z in enumerate(zones)}
    edges = edges_of(blocks)
    for i, b in enumerate(blocks):
        z = b.element.zone
        if z is not None:
            edges.append((i, number[id(z)], TO_MAIN if z.mark > 0 else TO_BOILER))
    own = [evidence(b) for b in blocks]
    marks = [z.mark for z in zones]
    sides = minimum_cut(own + marks, edges)[:n]
    free = [i for i, b in enumerate(blocks) if b.element.zone is None or b.element.zone.mark > 0]
    if free and not any(sides):
        lift = SENTENCE - max(own[i] for i in free)
        for i in free:
            own[i] += lift
        sides = minimum_cut(own + marks, edges)[:n]
    return [(b.text, s) for b, s in zip(blocks, sides)]


def main_text(page: str | None) -> str:
    return " ".join(text for text, content in labelled(page) if content)


def _extract_batch(pages: pd.Series) -> pd.DataFrame:
    texts = [main_text(p) for p in pages]
    return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})


def extract(html: Column) -> Column:
    """Struct (text, n_chars) of an html column."""
    return F.pandas_udf(_extract_batch, "text string, n_chars long")(html)


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url",
                  html: str = "html") -> DataFrame:
    """(key, url, text, n_chars)."""
    return (df.select(F.col(key), F.col(url), extract(F.col(html)).alias("main"))
              .select(key, url, "main.text", "main.n_chars"))
