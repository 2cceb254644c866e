"""Main text of web pages by tree scoring.

Paragraphs pass points, for their length and their commas, to the elements around them: all to the parent, half to the
grandparent, less further up. Points count less the more of an element's text is links. The element with most points
is the main container; siblings with a fifth of its points, and headings and paragraphs beside it, are kept too. Of
elements with equal points the first one scored, which is the deepest of the earliest paragraph, is the container.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# --- fixed values: elements by what they do
_WORDS = lambda s: frozenset(s.split())
VOID = _WORDS("area base br col embed hr img input link meta param source track wbr")
RAW = _WORDS("script style textarea title xmp noembed noframes iframe")
DROPPED = _WORDS("script style noscript template iframe object embed svg math canvas audio video select button textarea input option datalist nav aside menu dialog head title form footer header")
BLOCK = _WORDS("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul")
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
CLOSED_BY = {"li": ("li", _WORDS("ul ol menu")), "dt": ("dt dd", _WORDS("dl")), "dd": ("dt dd", _WORDS("dl")), "tr": ("tr td th", _WORDS("table tbody thead tfoot")), "td": ("td th", _WORDS("tr table")), "th": ("td th", _WORDS("tr table")), "option": ("option", _WORDS("select"))}
SCORED = _WORDS("p pre td blockquote li dd h2 h3 h4 h5 h6")
HEADINGS = _WORDS("h1 h2 h3 h4 h5 h6")
#: Words of class, id and role that mark an element as no part of the article.
NOISE = _WORDS(
    "ad ads adv advert adverts advertisement advertising adsense banner banners billboard sponsor sponsored sponsors promo promoted promotion "
    "comment comments commentlist disqus respond reply replies discussion sidebar sidebars side rail menu menus nav navbar navigation navigate breadcrumb breadcrumbs "
    "footer foot footnotes header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay dialog share sharing social shares follow related recommend "
    "recommended recommendations newsletter subscribe subscription signup login register search pagination pager pages widget widgets toolbar skip copyright legal disclaimer "
    "outbrain taboola contentinfo complementary hidden tags toc feedback rating print tools"
)
#: Those of them that mark what readers wrote: it may well be longer than the article.
TALK = _WORDS("comment comments commentlist disqus respond reply replies discussion")
#: Those of them that parts of an article bear too; lists (ul, ol) that bear them are noise all the same.
HARMLESS = _WORDS("foot footnotes side rail overlay dialog toc tags pages feedback rating print tools copyright legal disclaimer")
#: First words of class names that tell what a layout has, not what an element is: no-sidebar, has-header.
HAVING = _WORDS("no not has have with without")
#: Tags that hold the page's text on some pages (a form or header around it) and are dropped on others.
DOUBTFUL = _WORDS("form header footer aside menu dialog")
GOOD = _WORDS("article content entry main post body text story blog page hentry prose")
# --- end of fixed values

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_EDGE = re.compile(r"[>\"']")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("attrs", "children", "held", "near", "noise", "parent", "points", "tag", "text_len", "link_len")

    def __init__(self, tag: str, parent: "Node | None", attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node | str] = []
        self.noise, self.points, self.text_len, self.link_len, self.held = False, 0.0, 0, 0, 0.0
        self.near = _NONE if parent is None else parent.near
        for k, (names, stop) in _CLOSING.get(tag, ()):
            self.near = self.near[:k] + (self if tag in names else None,) + self.near[k + 1 :]


#: What a new tag closes: the nearest element of ``names``, unless one of ``stop`` is nearer.
_BY_NAMES = {names: stop for names, stop in CLOSED_BY.values()}
_RULES = [(_WORDS("p"), _WORDS("td th li div section article blockquote button body")), *((_WORDS(names), stop) for names, stop in _BY_NAMES.items())]
_RULE_OF = {tag: 1 + list(_BY_NAMES).index(names) for tag, (names, _) in CLOSED_BY.items()}
_NONE: tuple = (None,) * len(_RULES)
_CLOSING = {tag: [(k, r) for k, r in enumerate(_RULES) if tag in r[0] | r[1]] for tag in set().union(*(n | s for n, s in _RULES))}
_ROWS = ("tr", "table", "tbody", "thead", "tfoot")


class _Scanner:
    """Ends of tags. A tag ends at the first > outside quotes, or, if there is none, at the first one.

    Where a search came to the end of the page in vain, a later one that starts outside its quotes would too.
    """

    def __init__(self, source: str):
        self.source, self.vain = source, []

    def end(self, at: int) -> int:
        """Place after the tag whose name ends at ``at``; -1 if the page ends first."""
        for starts, ends in self.vain:
            k = bisect.bisect_right(starts, at) - 1
            if at >= (starts[0] if starts else at) and (k < 0 or at > ends[k]) or not starts:
                return self.source.find(">", at) + 1 or -1
        place, starts, ends = at, [at], [at - 1]
        while (m := _EDGE.search(self.source, place)) is not None:
            if m[0] == ">":
                return m.end()
            close = self.source.find(m[0], m.end())
            if close < 0:
                break
            starts.append(m.start())
            ends.append(close)
            place = close + 1
        self.vain.append((starts, ends))
        return self.source.find(">", at) + 1 or -1


def parse(source: str) -> Node:
    """The tree of a page: unclosed and misplaced tags are mended as browsers mostly do; text is not yet decoded.

    Every step costs the same however deep the tree is: what is open is counted by tag, and each element knows the
    nearest one that a rule may close.
    """
    root = Node("html", None)
    here, at, size, scanner = root, 0, len(source), _Scanner(source)
    counts = [Counter()]  # open elements by tag: in all, then inside each open table cell
    stop = 0

    def close(until: Node) -> Node:
        """Closes what is open below ``until``."""
        node = here
        while node is not until:
            for c in counts if len(counts) == 1 else (counts[0], counts[-1]):
                c[node.tag] -= 1
            if node.tag in ("td", "th"):
                counts.pop()
                if len(counts) > 1:
                    counts[-1][node.tag] -= 1
            node = node.parent
        return until

    while at < size:
        m = _OPEN.search(source, at)
        if m is None:
            here.children.append(source[at:])
            break
        begin, name = m.start(), m.group(4)
        if m.group(1):
            stop = source.find("-->", m.end())
            stop = size if stop < 0 else stop + 3
        elif m.group(2):
            stop = source.find(">", m.end()) + 1
        else:
            stop = scanner.end(m.end())
        if stop <= 0:  # no tag: the page ends inside it
            here.children.append(source[at:])
            break
        if begin > at:
            here.children.append(source[at:begin])
        at = stop
        if name is None:
            continue
        tag, attrs = name.lower(), source[m.end() : stop]
        if m.group(3):
            inner = counts[-1] if tag in BLOCK and tag not in _ROWS else counts[0]
            if inner[tag] > 0 or len(counts) > 1 and tag in ("td", "th") and counts[0][tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                if node.parent is not None:
                    here = close(node.parent)
            continue
        if tag in ("html", "body"):
            if tag == "body" and here.tag == "head":
                here = close(here.parent)
            if tag == "html":
                continue
        if tag in CLOSES_P and here.near[0] is not None:
            here = close(here.near[0].parent)
        if tag in CLOSED_BY:
            k = _RULE_OF[tag]
            node = here.near[k]
            while node is not None and node.tag in _RULES[k][0]:
                here = close(node.parent)
                node = here
        new = Node(tag, here, attrs if len(attrs) > 1 else "")
        here.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            new.children.append(source[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not attrs.endswith("/>") or tag in ("p", "div", "span", "a", "b", "i", "article", "section", "li"):
            here = new
            for c in counts if len(counts) == 1 else (counts[0], counts[-1]):
                c[tag] += 1
            if tag in ("td", "th"):
                counts.append(Counter())
    return root


def _marks(node: Node) -> tuple[set[str], bool]:
    """Words of class, id and role; whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for name, value in _ATTR.findall(node.attrs.rstrip("/>")) if node.attrs else []:
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDE.search(value):
            hidden = True
        elif name in ("class", "id", "role"):
            for own in _CAMEL.sub("-", html.unescape(value)).lower().split():
                parts = _SPLIT.split(own)
                words |= set(parts if parts[0] not in HAVING else parts[:1])
    return words, hidden


def _mark(node: Node, inside: bool) -> set[str]:
    """What marks an element as noise: its tag in capitals, or words of class, id and role; HIDDEN if it is.

    inside: below an article or main element, where a header is the article's own.
    """
    if node.tag in ("html", "body", "main"):
        return set()
    if node.tag in DROPPED:
        return set() if node.tag == "header" and inside else {node.tag.upper()}
    if not node.attrs:
        return set()
    words, hidden = _marks(node)
    if hidden:
        return {"HIDDEN"}
    bad = words & NOISE
    if node.tag == "article" and bad <= HARMLESS | {"related"}:
        return set()
    if inside and node.tag not in ("ul", "ol"):
        bad = bad - HARMLESS - {"header"}
    return bad


_SOFT = NOISE | {t.upper() for t in DOUBTFUL}


def _weigh(root: Node) -> None:
    """Marks noise below ``root``.

    Hidden elements and tags that never hold an article are noise. Other marks are doubted where the page's paragraphs
    contradict them. An element is no noise if the article or main element with most points is inside, or if it holds
    more than half of the points (of that article's, if it is inside it); marks that many elements share are dropped if
    these hold more than half together.
    What readers wrote is noise as long as a tenth of the points is outside.
    """
    marked: list[tuple[Node, set[str]]] = []
    todo = [(root, False)]
    order: list[Node] = []
    while todo:
        at, inside = todo.pop()
        marks = _mark(at, inside)
        if marks - _SOFT:
            at.noise = True
            continue
        order.append(at)
        if marks:
            marked.append((at, marks))
        inside = inside or at.tag in ("article", "main")
        todo += [(c, inside) for c in at.children if not isinstance(c, str)]
    if not marked:
        return
    for p in _paragraphs(root):
        p.held += _points(p) or 0.0
    for at in reversed(order):
        if at.parent is not None:
            at.parent.held += at.held
    soft = {id(at): marks for at, marks in marked}
    total, inner = root.held, set()  # inner: below an element that readers wrote
    talk = 0.0
    for at in order:
        if at.parent is not None and id(at.parent) in inner:
            inner.add(id(at))
        elif soft.get(id(at), set()) & TALK and total - at.held >= 0.1 * total:
            inner.add(id(at))
            at.noise = True
            talk += at.held
    if total - talk >= 0.1 * total:
        total -= talk
    else:
        for at in order:
            at.noise, inner = False, set()
    # points without what readers wrote
    spared = dict.fromkeys(map(id, order), 0.0)
    for at in reversed(order):
        spared[id(at)] += at.held - sum(c.held for c in at.children if not isinstance(c, str))
        if at.parent is not None and not at.noise:
            spared[id(at.parent)] += spared[id(at)]
    named = [at for at in order if at.tag in ("article", "main") and id(at) not in soft and id(at) not in inner and spared[id(at)] > 0]
    top = max(named, key=lambda at: spared[id(at)], default=None)
    around, up = set(), top
    while up is not None:
        around.add(id(up))
        up = up.parent
    # elements below one follow it in ``order``
    size = dict.fromkeys(map(id, order), 1)
    for at in reversed(order):
        if at.parent is not None:
            size[id(at.parent)] += size[id(at)]
    place = {id(at): k for k, at in enumerate(order)}
    within = range(place[id(top)], place[id(top)] + size[id(top)]) if top is not None else range(0)
    half = {True: 0.5 * spared[id(top)] if top is not None else 0.0, False: 0.5 * total}
    doubted = [(at, marks, place[id(at)] in within) for at, marks in marked if id(at) not in inner and id(at) not in around]
    doubted = [(at, marks, part) for at, marks, part in doubted if spared[id(at)] <= half[part]]
    # a mark counts an element once, not again for those inside it
    shared: dict[tuple[str, bool], float] = {}
    ends: dict[tuple[str, bool], int] = {}
    for at, marks, part in doubted:
        for m in marks:
            if place[id(at)] >= ends.get((m, part), 0):
                shared[m, part] = shared.get((m, part), 0.0) + spared[id(at)]
                ends[m, part] = place[id(at)] + size[id(at)]
    for at, marks, part in doubted:
        at.noise = any(shared[m, part] <= half[part] for m in marks)


def _space(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _measure(node: Node, link: bool) -> None:
    """Measures text and links below ``node``, without noise."""
    todo = [(node, link, False)]
    while todo:
        at, link, done = todo.pop()
        if not done:
            if at.noise:
                continue
            link = link or at.tag == "a"
            todo.append((at, link, True))
            todo += [(c, link, False) for c in at.children if not isinstance(c, str)]
            continue
        own = sum(len(c.strip()) for c in at.children if isinstance(c, str))
        at.text_len = own + sum(c.text_len for c in at.children if not isinstance(c, str))
        at.link_len = at.text_len if link else sum(c.link_len for c in at.children if not isinstance(c, str))


def _paragraphs(root: Node) -> Iterator[Node]:
    """Elements that hold text of their own, directly or in inline elements, in page order."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.noise:
            continue
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
        if node.tag in SCORED or node.tag in ("div", "section", "article", "body", "main", "html") and any(isinstance(c, str) and len(c.strip()) > 1 for c in node.children):
            yield node


def _own_text(node: Node) -> tuple[int, int, int]:
    """Length, commas and link length of text in a block, without blocks below it."""
    size = commas = links = 0
    todo: list[tuple[Node | str, bool]] = [(c, node.tag == "a") for c in node.children]
    while todo:
        x, link = todo.pop()
        if isinstance(x, str):
            n = len(x.strip())
            size += n
            links += n if link else 0
            commas += x.count(",") + x.count("、") + x.count("，")
        elif not x.noise and x.tag not in BLOCK:
            todo += [(c, link or x.tag == "a") for c in x.children]
    return size, commas, links


def _points(node: Node) -> float | None:
    """Points of a paragraph; None without text of its own."""
    size, commas, links = _own_text(node)
    if not size:
        return None
    return ((1 + commas if size >= 25 else 0.25) + min(size / 100, 3)) * (1 - links / size)


def _density(node: Node) -> float:
    return node.link_len / node.text_len if node.text_len else 0.0


def _chosen(root: Node) -> list[Node]:
    """The main container and the siblings that belong to it, in page order."""
    _weigh(root)
    _measure(root, False)
    scored: dict[int, Node] = {}
    for p in _paragraphs(root):
        points = _points(p)
        if points is None:
            continue
        up = p if p.tag not in SCORED else p.parent
        for share in (1.0, 0.5, 0.25, 0.125, 0.0625):
            if up is None:
                break
            if id(up) not in scored:
                scored[id(up)] = up
                words, _ = _marks(up)
                up.points += (4.0 if up.tag in ("article", "main") else 1.0 if up.tag in ("div", "section") else 0.0) + (3.0 if words & GOOD else 0.0)
            up.points += points * share
            up = up.parent
    if not scored:
        return []
    for n in scored.values():
        n.points *= 1 - _density(n)
    best = max(scored.values(), key=lambda n: n.points)
    top = best.points
    # the article around the best container, if the page names one
    up = best
    while up is not None:
        if up.tag == "article" and not up.noise:
            best = up
            break
        up = up.parent
    else:
        up = best
        while up is not None and up.tag != "main":
            up = up.parent
        if up is not None:
            best = up
    if best.parent is None or best.tag in ("article", "main", "body"):
        near = [c for c in best.parent.children if not isinstance(c, str)] if best.parent is not None and best.tag == "article" else [best]
        return [c for c in near if c is best or not c.noise and c.tag == "article" and c.points >= 0.5 * top]
    out = []
    for c in best.parent.children:
        if isinstance(c, str) or c.noise and c is not best:
            continue
        text = c.text_len
        if c is best or c.points >= 0.2 * top or c.tag in HEADINGS and text:
            out.append(c)
        elif c.tag == "p" and (text > 80 and _density(c) < 0.25 or 0 < text <= 80 and not c.link_len):
            out.append(c)
    return out


def _blocks(nodes: list[Node]) -> Iterator[str]:
    """Text of the blocks of ``nodes``, white space in one block as one space, entities decoded."""
    run: list[str] = []
    for top in nodes:
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:  # a block's end
                yield _space("".join(run))
                run.clear()
            elif isinstance(x, str):
                run.append(x)
            elif x.noise and x is not top:
                run.append(" ")
            elif x.tag == "br":
                run.append(" ")
            else:
                if x.tag in BLOCK:
                    yield _space("".join(run))
                    run.clear()
                    todo.append(None)
                elif x.tag in ("td", "th"):
                    run.append(" ")
                todo += reversed(x.children)
        yield _space("".join(run))
        run.clear()


def main_text(source: str | None) -> str:
    """The main text of one page: blocks in page order, joined by a line feed; empty if there is none."""
    if not source:
        return ""
    root = parse(source.replace("\0", ""))
    return "\n".join(b for b in _blocks(_chosen(root)) if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty html give an empty text; so does a page whose text is all in menus, scripts or hidden elements. Repeated rows are
    handled each, other columns are ignored, an empty table gives no rows. A page is read whole, however long; nesting
    of any depth is walked without recursion.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                texts = [main_text(h) for h in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
