"""Main text of web pages: a tree of elements, points passed from paragraphs to ancestors, the best container kept."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame

from .common import per_text

#: Comments, declarations and tags; a quoted attribute value may hold ">", a tag cut off by the page's end is dropped.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))|\b(hidden)\b")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noembed", "xmp")}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead title tr ul caption".split()
)
#: A start tag ends these open elements if they are met before one of the stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements whose text is none of the page's.
DROPPED = set("script style noscript template button select input textarea label iframe object embed svg canvas audio video head title".split())
#: Elements that seldom hold the main text; what they hold decides.
DOUBTFUL = set("nav footer aside form fieldset dialog menu search".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form tooltip".split())
#: Parts of class names and ids that mark other than main text.
ASIDE = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist disqus discussion replies reply respond responses "
    "related recommended recommendations share sharing social follow widget pager pagination paging skip hidden copyright legal "
    "disclaimer paywall form search tags".split()
)
#: Names of readers' comments.
COMMENTS = set("comment comments commentlist disqus discussion replies reply respond responses".split())
#: Names that pages give to wrappers as well as to asides.
BROAD = set("sidebar side overlay hidden modal tags form search skip widget social share toolbar".split())
#: Names that say how an element is laid out, or what else there is on the page, not what it is.
LAYOUT = re.compile(r"^(?:no|has|with|without|is|not|show|hide|enable|disable)-|-(?:with|no|has|without)-|-(?:hidden|fixed|sticky|visible|open|closed|enabled|disabled|layout|on|off)$")
GOOD = re.compile(r"article|body|content|entry|main|page|post|story|text|blog", re.I)
WEIGHT = {"article": 25, "main": 20, "section": 5, "div": 5, "td": 3, "pre": 3, "blockquote": 3, "li": -3, "ul": -3, "ol": -3, "dl": -3, "th": -5}
PARAGRAPHS = set("p pre td blockquote div section article main li dd".split())


class Element:
    __slots__ = ("tag", "parent", "kids", "off", "doubt", "score", "chars", "link_chars", "named", "points")

    def __init__(self, tag: str, parent: Element | None, off: bool = False, doubt: str = "", named: str = ""):
        self.tag, self.parent, self.off, self.doubt, self.named = tag, parent, off, doubt, named
        self.kids: list[Element | str] = []
        self.score, self.chars, self.link_chars, self.points = 0.0, 0, 0, 0.0


def is_aside(tag: str, attributes: str, parent: Element) -> tuple[bool, str, str]:
    """Whether an element's text is none of the page's (it is hidden or no text), why else it may not be main text
    (``comments``, ``tag``, ``name`` or ``broad``, or nothing), and its class and id."""
    if tag in DROPPED:
        return True, "", ""
    in_article = tag == "header" and inside(parent, ("article", "main"))
    doubt = "tag" if tag in DOUBTFUL or tag == "header" and not in_article else ""
    if "=" not in attributes and "hidden" not in attributes:
        return False, doubt, ""
    named, off = [], False
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c)
        if name in ("class", "id"):
            named.append(value)
        elif name == "role" and value.lower() in ROLES:
            doubt = doubt or "name"
        elif name == "aria-hidden" and value == "true" or hidden:
            off = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            off = True
    label = " ".join(named)
    own = [n for n in re.sub(r"([a-z])([A-Z])", r"\1-\2", label).lower().split() if not LAYOUT.search(n) or n == "visually-hidden"]
    parts = set(re.split(r"[^a-z]+", " ".join(own)))
    if parts & ASIDE and tag not in ("body", "html", "article", "main"):
        doubt = doubt or ("" if in_article and parts & ASIDE <= {"header"} else "broad" if parts & ASIDE <= BROAD else "name")
    if tag == "article" and parts & {"comment", "comments", "reply", "related", "ad", "ads", "promo", "sponsored"}:
        doubt = "name"
    return off, "comments" if doubt and parts & COMMENTS else doubt, label


def inside(element: Element | None, tags: tuple[str, ...]) -> bool:
    while element is not None:
        if element.tag in tags:
            return True
        element = element.parent
    return False


def parse(page: str) -> Element:
    """The tree of a page. End tags close the nearest open element of their name; text of raw elements is skipped."""
    root = here = Element("#root", None)
    depth: dict[str, int] = {}
    at = 0

    def close(upto: Element) -> None:
        nonlocal here
        while True:
            depth[here.tag] -= 1
            last, here = here, here.parent
            if last is upto:
                return

    def open_one(tags: set[str], stops: set[str]) -> Element | None:
        e = here
        while e is not root and e.tag not in stops:
            if e.tag in tags:
                return e
            e = e.parent
        return None

    while at < len(page):
        m = MARKUP.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            here.kids.append(page[at:end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if depth.get(tag):
                found = open_one({tag}, set())
                if found is not None:
                    close(found)
            continue
        attributes = m[3] or m[6] or ""
        if tag in BLOCK and depth.get("p") and tag != "option":
            found = open_one({"p"}, {"button", "td", "th", "caption", "object"})
            if found is not None:
                close(found)
        if tag in ENDS:
            found = open_one(*ENDS[tag])
            if found is not None:
                close(found)
        off, doubt, named = is_aside(tag, attributes, here)
        child = Element(tag, here, off or here.off, doubt, named)
        here.kids.append(child)
        if tag in RAW:
            stop = RAW[tag].search(page, at)
            at = stop.start() if stop else len(page)
        if tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path", "use")):
            depth[tag] = depth.get(tag, 0) + 1
            here = child
    return root


def walk(root: Element):
    """Elements in page order, each with its way out: (element, False) going in, (element, True) coming out."""
    stack: list[tuple[Element, int]] = [(root, 0)]
    yield root, False
    while stack:
        e, k = stack.pop()
        while k < len(e.kids):
            kid = e.kids[k]
            k += 1
            if isinstance(kid, Element):
                stack.append((e, k))
                yield kid, False
                e, k = kid, 0
        yield e, True


def spoken_points(e: Element, own: list[str]) -> float:
    """A paragraph's points: one, one more for each comma and each hundred characters up to three, less its links."""
    if e.tag not in PARAGRAPHS:
        return 0.0
    spoken = e.chars - sum(k.chars for k in e.kids if isinstance(k, Element) and k.tag in BLOCK)
    if spoken < 25:
        return 0.0
    commas = sum(t.count(",") + t.count("，") + t.count("、") for t in own)
    return (1 + commas + min(spoken / 100, 3)) * (1 - e.link_chars / max(1, e.chars))


def measured(e: Element) -> list[str]:
    """Sets an element's lengths of text and of links from its own texts, which it returns, and its children's."""
    own = [html.unescape(k) if "&" in k else k for k in e.kids if isinstance(k, str)]
    inline = [k for k in e.kids if isinstance(k, Element)]
    e.chars = len(" ".join(" ".join(own).split())) + sum(k.chars for k in inline)
    e.link_chars = e.chars if e.tag == "a" else sum(k.link_chars for k in inline)
    return own


def drop_asides(root: Element) -> None:
    """Turns doubtful elements off with all below them, but for those that hold what the page is about: its richest
    article or main, or at least half of its paragraphs' points (which does not save a nav, footer or header, nor
    comments). Comments stay only if they hold that article and four fifths of the points."""
    if not any(e.doubt for e, out in walk(root) if not out and not e.off):
        return
    best = None
    for e, out in walk(root):
        if out and not e.off:
            own = measured(e)
            e.points = (spoken_points(e, own) if e.tag in ("p", "pre", "blockquote") else 0) + sum(k.points for k in e.kids if isinstance(k, Element))
            if e.tag in ("article", "main") and not e.doubt and e.chars and (best is None or (e.points, e.chars) >= (best.points, best.chars)):
                best = e
    holders, bare = set(), best is None
    while best is not None:
        holders.add(id(best))
        best = best.parent
    for e, out in walk(root):
        if out or e.parent is None:
            continue
        share = e.points / root.points if root.points else 0.0
        if e.doubt == "comments":
            saved = id(e) in holders and share >= 0.8
        else:
            saved = id(e) in holders or bare and share >= 0.5 and (e.doubt == "broad" or e.tag in ("form", "fieldset", "aside"))
        e.off = e.off or e.parent.off or bool(e.doubt) and not saved
    for e, out in walk(root):
        if not out:
            e.chars = e.link_chars = 0


def score(root: Element) -> list[Element]:
    """Points for every container: a paragraph's parent gets all of its points (see spoken_points), the next ancestor
    half, others a share that falls with distance."""
    touched: dict[int, Element] = {}
    for e, out in walk(root):
        if not out or e.off:
            continue
        points = spoken_points(e, measured(e))
        if not points:
            continue
        up, level = (e.parent if e.tag in ("p", "li", "dd", "pre", "blockquote", "td") else e), 0
        while up is not None and up is not root and level < 5:
            if id(up) not in touched:
                touched[id(up)] = up
                up.score += WEIGHT.get(up.tag, 0) + (25 if up.named and GOOD.search(up.named) else 0)
            up.score += points / (1, 2, 6, 9, 12)[level]
            up, level = up.parent, level + 1
    for e in touched.values():
        e.score *= 1 - e.link_chars / max(1, e.chars)
    return list(touched.values())


def chosen(root: Element) -> list[Element]:
    """The elements whose text is the main text, in page order."""
    drop_asides(root)
    scored = score(root)
    named = [e for e, out in walk(root) if not out and not e.off and e.tag in ("article", "main") and e.chars]
    if not scored:
        if named:
            top = max(named, key=lambda e: e.chars)
            return [top]
        body = next((e for e, out in walk(root) if not out and e.tag == "body"), root)
        return [body]
    best = max(scored, key=lambda e: e.score)
    up = best
    while up is not None:  # an article is kept whole, whichever of its parts scored best
        if up.tag == "article":
            best = up
        up = up.parent
    if best.tag != "article":
        up = best
        while up is not None:
            if up.tag == "main":
                best = up
            up = up.parent
    if best.parent is None:
        return [best]
    bar, kept = max(10.0, 0.2 * best.score), []
    for e in best.parent.kids:
        if not isinstance(e, Element) or e.off:
            continue
        density = e.link_chars / max(1, e.chars)
        heads = e.tag in ("h1", "h2", "hgroup") and best.tag not in ("article", "main")
        para = e.tag == "p" and best.tag not in ("article", "main") and (e.chars > 80 and density < 0.25 or 0 < e.chars <= 80 and density == 0)
        if e is best or e.score >= bar and (best.tag not in ("article", "main") or e.tag == best.tag) or heads or para:
            kept.append(e)
    return kept


def blocks(elements: list[Element]) -> list[str]:
    """Texts of the blocks below the elements, white space made single, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append(text)
            run.clear()

    for top in elements:
        flush()
        stack: list[tuple[Element, int]] = [(top, 0)]
        while stack:
            e, k = stack.pop()
            if k == 0:
                if e.off:
                    continue
                if e.tag in BLOCK:
                    flush()
                elif e.tag in ("br", "img", "wbr") and e.tag != "wbr":
                    run.append(" ")
            if k < len(e.kids):
                stack.append((e, k + 1))
                kid = e.kids[k]
                if isinstance(kid, str):
                    run.append(kid)
                else:
                    stack.append((kid, 0))
            elif e.tag in BLOCK:
                flush()
        flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by newlines; empty if there is none."""
    return "\n".join(blocks(chosen(parse(page)))) if page else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars. Whole pages, one pass, no shuffle.

    A null or empty page, or one without text, has the empty text. Null ids and urls pass unchanged, repeated rows give
    repeated results, an empty table none; other columns are neither read nor returned. Nesting costs no recursion.
    """
    from pyspark.sql import functions as F

    def make():
        def work(texts: list[str | None]) -> pd.DataFrame:
            found = [main_text(t) for t in texts]
            return pd.DataFrame({"text": found, "n_chars": [len(t) for t in found]})

        return work

    own = pages.select(F.struct(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).alias("doc"), F.col(html_col).alias("html"))
    found = per_text(own, make, "text string, n_chars long", "doc", "html")
    return found.select("doc_id.page_id", "doc_id.url", "text", "n_chars")
