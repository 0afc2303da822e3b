"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block, and empty lines where containers begin and end. A line has a
weight: its characters outside links, more of them in a heading and inside an article, next to none in what is
marked as boilerplate. The weights of each window of lines are summed. The text surges where a window reaches the
threshold, which the page's highest window and the markup bound, and dives where a window is empty; the lines from
the last dive before a surge to the next one are kept, so that a title before a long paragraph stays.
Each boilerplate element is a distribution of its own, beside the lines around it. Markup only weighs:
the windows decide what is kept.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import append, bounded_batches

#: Lines of a window; the threshold of a surge, in characters, with and without a named article, and as a share of the highest window.
WINDOW, SURGE, NAMED_SURGE, RATIO = 3, 80, 1000, 0.25
#: Weight of a character in a named article and in a heading; of one in boilerplate, and of a line of that at most.
ARTICLE, HEADING, MARKED, MOST = 100, 4, 0.002, 0.3
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|math|object|canvas|audio|video|select|head)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*?>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>?", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)(?:>|(?=<)|\Z)|</?[a-zA-Z][^>]*>")
_NAMED = re.compile(r"\b(class|id|role|style|aria-hidden|hidden|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPEN = frozenset("p li dt dd td th tr option".split())  # a next block may end these without a closing tag
_ALWAYS = frozenset("nav footer aside form menu dialog button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar comment comments commentlist disqus respond replies cookie cookies gdpr consent notice notices alert disclaimer copyright menu nav navbar navigation breadcrumb breadcrumbs footer popup modal overlay newsletter subscribe signup login share sharing social related recommended widget toolbar pagination pager masthead topbar skip".split()
)
_NAMES = re.compile(r"<(?:article|main)\b|role\s*=\s*[\"']?(?:main|article)\b", re.I)
_ROLE = re.compile(r"\brole\s*=\s*[\"']?(?:main|article)\b", re.I)
_HEADINGS = frozenset("h1 h2 h3".split())
_CONTAINERS = frozenset("aside blockquote body center details div dl fieldset footer form header hr legend menu nav ol section table ul".split())
_TOPS = frozenset("header topnav siteheader".split())


def _boilerplate(tag: str, attributes: str, inside: bool, named: bool) -> bool:
    if tag in _ALWAYS or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _NAMED.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if named and (name == "role" and value in _ROLES or name in ("class", "id") and any(w in _WORDS or w in _TOPS and not inside for w in re.split(r"[^a-z0-9]+", value))):
            return True
    return False


@dataclass
class Line:
    """A block's text, its weight, and the distribution that it is in (0, or that of a boilerplate element)."""

    text: str
    weight: float = 0.0
    flow: int = 0


def lines(page: str, named: bool = True) -> tuple[list[Line], bool]:
    """The lines of a page in order, and whether it names its article; without `named`, class names count for nothing."""
    page = _RAW.sub(" ", page)
    article = _NAMES.search(page) is not None
    out: list[Line] = []
    text: list[str] = []
    links = [0, 0]  # open ones, and the characters of this line that are in one
    roles: list[list] = []  # of elements that are the article by their role: tag, and how many of its kind are open
    inside, heading, skipped, depth, flow, flows, blank, at = 0, False, "", 0, 0, 0, 0, 0

    def close() -> None:
        nonlocal blank
        own = " ".join(html.unescape("".join(text)).split())
        if own:
            size = len(own) if inside else max(0, len(own) - links[1])
            plain = size * (HEADING if heading else 1) * (ARTICLE if inside else 1)
            out.append(Line(own, min(MOST, MARKED * size) if flow else plain, flow))
            blank = blank if flow else 0
        text.clear()
        links[1] = 0

    def gap(n: int = 1) -> None:
        nonlocal blank
        out.extend(Line("") for _ in range(n))
        blank += n

    def enter(n: int) -> None:
        nonlocal inside
        close()
        gap(WINDOW)
        inside = max(0, inside + n)

    for m in _TAG.finditer(page):
        own = page[at : m.start()]
        if own:
            text.append(own)
            if links[0]:
                links[1] += len(html.unescape(own))
        at = m.end()
        if m[2] is None:
            continue
        end, tag, attributes = m[1], m[2].lower(), m[3]
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            links[0] = 0 if end else 1
        if skipped:
            if tag == skipped:
                depth += -1 if end else 0 if skipped in _OPEN else 1
            if depth <= 0 or skipped in _OPEN and tag in _BLOCK:  # the boilerplate ends here
                close()
                own_end = end and tag == skipped
                skipped, flow = "", 0
                if own_end:
                    continue
            else:
                if tag in _BLOCK:
                    close()
                continue
        if roles and tag == roles[-1][0]:
            roles[-1][1] += -1 if end else 1
            if not roles[-1][1]:
                roles.pop()
                enter(-1)
                continue
        if tag in ("article", "main"):
            enter(-1 if end else 1)
        elif not end and tag not in _VOID and _ROLE.search(attributes):
            roles.append([tag, 1])
            enter(1)
        elif not end and tag not in _VOID and _boilerplate(tag, attributes, inside > 0, named):
            close()
            if not inside or blank < WINDOW - 1:
                gap()
            flows += 1
            skipped, depth, flow = tag, 1, flows
        elif tag in _BLOCK:
            close()
            heading = not end and tag in _HEADINGS
            if tag in _CONTAINERS and (not inside or blank < WINDOW - 1):
                gap()
    text.append(page[at:])
    close()
    return out, article


def sums(weights: list[float]) -> list[float]:
    """The weight of the window that begins at each line."""
    return [sum(weights[k : k + WINDOW]) for k in range(len(weights))]


def threshold(page: list[Line], article: bool, highest: float) -> float:
    return max(ARTICLE if article else 1.0, min(NAMED_SURGE if article else SURGE, RATIO * highest))


def chosen(page: list[Line], article: bool) -> list[int]:
    """The places of the lines between a surge and a dive, and of those between it and the dive before."""
    flows: dict[int, list[int]] = {}
    for k, line in enumerate(page):
        flows.setdefault(line.flow, []).append(k)
    windows = {f: sums([page[k].weight for k in of]) for f, of in flows.items()}
    surge = threshold(page, article, max((x for w in windows.values() for x in w), default=0.0))
    kept: list[int] = []
    for f, of in flows.items():
        held: list[int] = []
        surged = False
        for k, total in zip(of, windows[f], strict=True):
            if not total:  # a dive
                if surged:
                    kept += held
                held, surged = [], False
            elif held or page[k].weight:
                surged |= total >= surge
                held.append(k)
        if surged:
            kept += held
    return sorted(kept)


def main_text(page: str | None) -> str:
    """The lines that the distribution keeps, joined by one line break; empty if there are none.

    If class names leave nothing on a page that names no article, they count for nothing.
    """
    own, article = lines(page or "")
    kept = chosen(own, article)
    if not kept and not article:
        own, article = lines(page or "", named=False)
        kept = chosen(own, article)
    return "\n".join(own[k].text for k in kept if own[k].text)


def extract(pages: DataFrame) -> DataFrame:
    """pages, all columns, with main_text and n_chars (its code points).

    A null or empty html has an empty text; repeated pages have equal texts; an empty table gives
    no rows; columns of these names, in any case, are replaced; others may have any name. Whole pages are read, however long; a page
    that is cut off inside a tag, a script or a comment loses only that.
    """
    bounded_batches(pages.sparkSession)

    def each(of: list[str | None]) -> dict:
        texts = [main_text(x) for x in of]
        return {"main_text": texts, "n_chars": [len(t) for t in texts]}

    return append(pages, ["html"], each, "main_text string, n_chars bigint")
