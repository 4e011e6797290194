"""Main text of HTML pages by minimum cut.

A page is cut into blocks of text. A linear classifier gives each block a cost for being called content and one for boilerplate; these
are its capacities to the two terminals. Blocks that follow each other, and blocks near each other in the element tree, are tied by
smoothness edges. The minimum cut separates content from boilerplate. Blocks whose terminal outweighs all their ties are settled
first, which changes no minimum; augmenting paths do the rest.
"""

import html
import re
from collections import deque
from math import log1p

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows

#: Element names of HTML by their part in a page.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q ruby rb rp rt s samp small span "
                    "strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template iframe noembed noframes".split())
_AWAY = frozenset("head title nav footer aside form button select option textarea noscript dialog menu fieldset legend label input".split())
_MAIN = frozenset(("article", "main"))
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section "
                    "table ul".split())
#: Words of class, id and role that name parts of a page.
_AWAY_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs captcha comment comments consent contentinfo cookie cookies "
    "complementary dialog disclaimer discussion disqus footer footnav gdpr header login masthead menu metadata modal nav navbar navigation newsletter notice "
    "notification outbrain overlay pager pagination paywall popup privacy promo promoted promotion rail recommend recommended related replies reply respond "
    "search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription taboola tags teaser toc toolbar topbar tracking warning "
    "widget widgets".split())
_TITLE_WORDS = frozenset(("header", "metadata"))
_MAIN_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
#: Phrases of legal and consent notices and of calls to sign up; single words such as "cookies" may stand in any article.
_NOTICES = re.compile(r"©|\ball rights reserved\b|\buses? cookies\b|\b(?:accept|our|of) cookies\b|\bcookie (?:policy|settings|notice)\b|\bsubscribe (?:to our|now)\b|\bsign (?:in to|up for)\b"
                      r"|\bprivacy policy\b|\bterms of (?:use|service)\b", re.I)
#: "has-sidebar" and the like name what a part of the page is not.
_BESIDE = re.compile(r"(?:has|with|no|without)[-_]\w+", re.I)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""", re.S)  # quotes hold a ">" only as a value's own
_ATTRIBUTES = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Weights of the classifier, in the units of the ties below.
WEIGHTS = {"away": -9.0, "main": 1.6, "main_word": 1.2, "link": -3.0, "length": 1.0, "short": -0.4, "heading": 0.8, "list": -0.6, "notice": -2.0}
NEXT, SIBLING, NEAR = 0.4, 0.8, 0.3


class _Element:
    __slots__ = ("away", "block", "depth", "main", "main_word", "name", "parent")

    def __init__(self, name: str, parent: "_Element | None", attributes: str):
        self.name, self.parent = name, parent
        up = parent or _ROOT
        self.depth, self.away, self.main, self.main_word = (up.depth + 1 if parent else 0), up.away, up.main, up.main_word
        self.block = up.block if name in _INLINE and parent else self  # the innermost element that is no inline one
        words, hidden = set(), False
        if attributes:
            for m in _ATTRIBUTES.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id", "role"):
                    words.update(w.lower() for w in _WORDS.findall(_BESIDE.sub(" ", value)))
                elif key == "style":
                    hidden |= "display:none" in value.replace(" ", "").lower()
                else:
                    hidden |= value.lower() != "false"
        if name in ("html", "body"):
            return
        # words for what is beside the text win over words for the text: "article-comments" are comments; but a post's header has its title
        aside = words & _AWAY_WORDS
        named = bool(aside) and name not in _MAIN and not (words & _MAIN_WORDS and aside <= _TITLE_WORDS)
        if hidden or name in _AWAY or named or name == "header" and not self.main:
            self.away = True
        self.main |= name in _MAIN
        self.main_word |= bool(words & _MAIN_WORDS)


class _Root:
    depth, away, main, main_word, block = -1, False, False, False, None


_ROOT = _Root()


class Block:
    """Text between two tags that end a line, with the element it stands in."""

    __slots__ = ("element", "linked", "text")

    def __init__(self, element: _Element | None, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def blocks_of(page: str) -> list[Block]:
    """The blocks with text in page order; scripts, styles and comments are none."""
    out: list[Block] = []
    top: _Element | None = None
    parts: list[str] = []
    at, links, linked, size = 0, 0, 0, len(page)
    owner: _Element | None = None

    def text(piece: str) -> None:
        nonlocal linked, owner
        if "&" in piece:
            piece = html.unescape(piece)
        if not parts or owner is None:
            owner = top
        parts.append(piece)
        if links:
            linked += len(piece)

    def close() -> None:
        nonlocal linked, owner
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                block = owner.block if owner is not None else None
                out.append(Block(None if block is not None and block.name in _INLINE else block, joined, min(linked, len(joined))))
            parts.clear()
        linked, owner = 0, None

    counts: dict[str, int] = {}  # open elements by name: what is not open needs no search

    def leave(name: str) -> None:
        nonlocal top, links
        if not counts.get(name):
            return
        seek = top
        while seek.name != name:
            seek = seek.parent
        while top is not seek.parent:
            links -= top.name == "a"
            counts[top.name] -= 1
            top = top.parent

    def inside(name: str, until: tuple[str, ...]) -> bool:
        if not counts.get(name):
            return False
        seek = top
        while seek is not None and seek.name not in until:
            if seek.name == name:
                return True
            seek = seek.parent
        return False

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in _RAW and not m[1]:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        inline = name in _INLINE
        if not inline:
            close()
        if m[1]:
            leave(name)
        else:
            if name == "br":
                parts.append(" ")
            elif name in _ENDS_P and inside("p", ("article", "section", "div", "td", "body", "li")):
                leave("p")
            elif name in ("li", "option", "tr", "td", "th", "dt", "dd") and inside(name, ("ul", "ol", "table", "dl", "select")):
                leave(name)
            if name not in _VOID and not m[3].endswith("/"):
                if name == "a":
                    if links:
                        leave("a")
                    links += 1
                top = _Element(name, top, m[3])
                counts[name] = counts.get(name, 0) + 1
    close()
    return out


def content_score(block: Block) -> float:
    """The classifier: positive for content, negative for boilerplate."""
    e, n = block.element, len(block.text)
    s = WEIGHTS["length"] * min(2.0, log1p(n / 40)) + WEIGHTS["short"] + WEIGHTS["link"] * block.linked / n
    if e is not None:
        if e.away:
            s += WEIGHTS["away"]
        elif e.main:
            s += WEIGHTS["main"]
        elif e.main_word:
            s += WEIGHTS["main_word"]
        if e.name in ("h1", "h2", "h3"):
            s += WEIGHTS["heading"]
        elif e.name == "li" and not e.main:
            s += WEIGHTS["list"]
    if (e is None or not e.main) and (found := len(_NOTICES.findall(block.text))):
        s += WEIGHTS["notice"] * min(1.0, 120 * found / n)  # the longer a text, the less one phrase says of it
    return s


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next one, more if their elements are near, and with the last one of the same parent.

    What the page itself sets apart (an advert between two paragraphs) is tied to nothing outside.
    """
    out, last = [], {}
    for i, b in enumerate(blocks):
        parent = b.element.parent if b.element is not None else None
        apart = b.element is not None and b.element.away
        if i:
            a = blocks[i - 1]
            other = a.element.parent if a.element is not None else None
            if apart == (a.element is not None and a.element.away):
                near = SIBLING if other is parent else NEAR if b.element is not None and a.element is not None and (parent is a.element or other is b.element) else 0.0
                out.append((i - 1, i, NEXT + near))
        before = last.get((id(parent), apart))
        if before is not None and before < i - 1:
            out.append((before, i, SIBLING / 2))
        last[id(parent), apart] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) that minimise the scores given up plus the ties cut. Costs are whole thousandths."""
    n = len(scores)
    unary = [round(1000 * s) for s in scores]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        w = round(1000 * w)
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # a block that outweighs its ties keeps its side in some minimum
        i = queue.popleft()
        if label[i] is None and abs(unary[i]) >= sum(near[i].values()):
            label[i] = unary[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                unary[j] += w if label[i] else -w
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _source_side(rest, unary, near)
        for i in rest:
            label[i] = i in side
    return [bool(x) for x in label]


def _source_side(nodes: list[int], unary: list[int], near: list[dict[int, int]]) -> set[int]:
    """Nodes on the content side of a minimum cut, after a maximum flow by blocking flows over levels."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = {i: dict(near[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        if unary[i] > 0:
            room[source][i], room[i][source] = unary[i], 0
        elif unary[i] < 0:
            room[i][sink], room[sink][i] = -unary[i], 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level) - {source}
        ways = {u: iter(tuple(room[u])) for u in level}  # edges not yet used up in this round
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                cut = None
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    room[a][b] -= flow
                    room[b][a] += flow
                    if room[a][b] == 0 and cut is None:
                        cut = k
                # go on from before the first edge that is full; its start tries its next edge
                path = path[:cut + 1]
                continue
            for v in ways[u]:
                if room[u][v] > 0 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


def main_text(page: str | None) -> str:
    """Content blocks in page order, one on each line; "" for null, empty and pages without content."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = minimum_cut([content_score(b) for b in blocks], ties(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row, from its whole html.

    Null and empty html give an empty text. Broken, unclosed and cut-off markup is read as far as it goes. Nulls in the other columns
    and repeated rows stay; an empty table gives an empty result; other columns are ignored whatever their names. One map without a
    shuffle.
    """

    def extract(r):
        texts = [main_text(h) for h in r["html"]]
        return {"page_id": r["page_id"], "url": r["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_rows(rows, extract, "page_id bigint, url string, text string, n_chars bigint")
