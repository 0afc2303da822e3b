"""Line-block distribution against a slow version of it, and what the rule itself decides."""

import random
import re
from html.parser import HTMLParser

import pytest

from textsketch.llm import htmltext


class _Slow(HTMLParser):
    """Lines of a well-formed page as (text, weight, flow), by a stack of open elements."""

    BLOCKS = "p div h1 h2 li ul section".split()

    def __init__(self):
        super().__init__()
        self.stack, self.out, self.text, self.linked, self.flows = [], [], "", 0, 0

    def flow(self):
        return next((f for _, f in self.stack if f), 0)

    def close_line(self):
        own = " ".join(self.text.split())
        if own:
            tags = [t for t, _ in self.stack]
            inside = "article" in tags
            n = len(own) if inside else len(own) - self.linked
            w = n * (4 if "h1" in tags or "h2" in tags else 1) * (100 if inside else 1)
            self.out.append((own, min(0.3, 0.002 * n) if self.flow() else w, self.flow()))
        self.text, self.linked = "", 0

    def gap(self, n=1):
        inside = "article" in [t for t, _ in self.stack]
        for _ in range(n):
            trailing = 0
            for text, _, f in reversed([x for x in self.out if not x[2]]):
                if text:
                    break
                trailing += 1
            if n == 3 or not inside or trailing < 2:
                self.out.append(("", 0, 0))

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "b", "br"):
            self.text += " " * (tag == "br")
            if tag != "br":
                self.stack.append((tag, 0))
            return
        self.close_line()
        marked = not self.flow() and (tag in ("nav", "footer", "form") or dict(attrs).get("class") in ("ad", "comments"))
        if tag == "article" and not self.flow():
            self.gap(3)
        elif not self.flow() and (marked or tag in ("div", "ul")):
            self.gap()
        self.flows += marked
        self.stack.append((tag, self.flows if marked else 0))

    def handle_endtag(self, tag):
        if tag in ("a", "b"):
            self.stack.pop()
            return
        self.close_line()
        if tag == "article" and not self.flow():
            self.gap(3)
        was = self.stack.pop()[1]
        if tag in ("div", "ul") and not self.flow() and not was:
            self.gap()

    def handle_data(self, data):
        self.text += data
        if "a" in [t for t, _ in self.stack]:
            self.linked += len(data)


def _slow_text(page):
    parser = _Slow()
    parser.feed(page)
    parser.close_line()
    article, kept = "<article" in page, []
    by = {}
    for k, (_, w, f) in enumerate(parser.out):
        by.setdefault(f, []).append((k, w))
    window = lambda of, i: of[i][1] + (of[i + 1][1] if i + 1 < len(of) else 0) + (of[i + 2][1] if i + 2 < len(of) else 0)
    top = max((window(of, i) for of in by.values() for i in range(len(of))), default=0)
    surge = max(100 if article else 1, min(1000 if article else 80, top / 4))
    for of in by.values():
        dives = [-1, *(i for i in range(len(of)) if window(of, i) == 0), len(of)]
        for a, b in zip(dives, dives[1:]):  # noqa: B905
            stretch = range(a + 1, b)
            first = next((i for i in stretch if of[i][1]), b)
            if any(window(of, i) >= surge for i in range(first, b)):
                kept += [of[i][0] for i in range(first, b)]
    return "\n".join(parser.out[k][0] for k in sorted(kept) if parser.out[k][0])


def _page(rng):
    words = lambda a, b: " ".join(rng.choice(["an", "other", "thing", "of", "it"]) for _ in range(rng.randint(a, b)))
    para = lambda: f"<p>{words(0, 4)} <a href=x>{words(1, 3)}</a> {words(0, 40)}</p>" if rng.random() < 0.3 else f"<p>{words(1, 40)}</p>"
    part = lambda: "".join(para() for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(rng.randint(1, 7)):
        kind = rng.randrange(8)
        out.append(
            [f"<nav><ul><li><a>{words(1, 2)}</a></li></ul></nav>", f'<div class="ad">{words(1, 60)}</div>', f"<article><h1>{words(1, 4)}</h1>{part()}<div>{part()}</div></article>", f"<div><h2>{words(1, 3)}</h2>{part()}</div>",
             f"<ul>{''.join(f'<li><a>{words(1, 2)}</a></li>' for _ in range(rng.randint(1, 5)))}</ul>", f'<div class="comments">{part()}</div>', f"<div><div>{part()}</div></div>", f"<footer>{words(1, 9)}</footer>"][kind]
        )
    return f"<html><body>{''.join(out)}</body></html>"


def test_against_a_slow_version():
    rng, some = random.Random(3), 0
    for _ in range(1500):
        page = _page(rng)
        got = htmltext.main_text(page)
        want = _slow_text(page)
        if want or "<article" in page:  # else class names count for nothing
            assert got == want, page
            some += bool(want)
    assert some > 1000


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]


def _truth(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return "\n".join(x for part in re.split(r"</?(?:p|h1)>", inner) if (x := htmltext.main_text(part.replace("<br>", " "))))


def test_the_windows_decide(pages):
    """Not markup: without the rule no page has its text, and without class names or named articles the rule still finds it."""
    for page in pages:
        want = _truth(page)
        assert htmltext.main_text(page) == want
        every, article = htmltext.lines(page)
        assert "\n".join(x.text for x in every if x.text) != want  # the rule taken away
        bare, article = htmltext.lines(page, named=False)
        assert "\n".join(bare[k].text for k in htmltext.chosen(bare, article) if bare[k].text) == want
        div = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert htmltext.main_text(div) == want
        every, article = htmltext.lines(div)
        assert not article and "\n".join(x.text for x in every if x.text) != want


def test_surges_dives_and_weights():
    text = "long text " * 30
    for page, want in (
        (f"<h1>Short title</h1><p>short lead</p><p>{text}</p>", f"Short title\nshort lead\n{text.strip()}"),
        (f"<div><article>teaser</article></div><div><p>{text * 5}</p><p>end</p></div>", f"teaser\n{(text * 5).strip()}\nend"),
        ("<article>A</article><div>outside text</div>", "A"),
        ("<div role=main><div><p>in</p></div><p>more</p></div><div>out</div>", "in\nmore"),
        ("<article><p>t</p>" + "<p><a>link</a></p>" * 5 + "</article>", "t" + "\nlink" * 5),
        (f"<ul>{'<li><a>go</a></li>' * 4}</ul><p>{text}</p><ul>{'<li><a>go</a></li>' * 4}</ul>", text.strip()),
        (f"<article><p>{text}</p><div class=ad>{text * 9}</div><p>Tail.</p></article>", f"{text.strip()}\nTail."),
    ):
        assert htmltext.main_text(page) == want
