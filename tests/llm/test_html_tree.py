"""The extraction against a second, plain implementation: html.parser, a tree of dicts and recursion."""

import re
from html.parser import HTMLParser

import pytest

from graphloom.llm import html_extract as H


class Dom(HTMLParser):
    """A tree of elements {tag, attrs, parts}; parts are texts (text, whether in a link) and elements, for tidy pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "#root", "attrs": {}, "parts": [], "up": None}
        self.at, self.links, self.raw = self.root, 0, None

    def handle_starttag(self, tag, attrs):
        if self.raw:
            return
        if tag in H.RAW:
            self.raw = tag
        elif tag == "a":
            self.links += 1
        elif tag == "br":
            self.at["parts"].append((" ", False))
        elif tag in H.BLOCK or tag in H.DROPPED:
            self.at["parts"].append(one := {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "parts": [], "up": self.at})
            self.at = one

    def handle_endtag(self, tag):
        if self.raw:
            self.raw = None if tag == self.raw else self.raw
        elif tag == "a":
            self.links -= 1
        elif tag == self.at["tag"]:
            self.at = self.at["up"]

    def handle_data(self, data):
        if not self.raw:
            self.at["parts"].append((data, self.links > 0))


def line(e):
    while e:
        yield e
        e = e["up"]


def dropped(e):
    names = (e["attrs"].get("class", "") + " " + e["attrs"].get("id", "")).split()
    if e["tag"] in H.DROPPED or e["attrs"].get("role") in H.ROLES or "hidden" in e["attrs"]:
        return True
    if e["tag"] == "header":
        return not any(x["tag"] in ("article", "main") for x in line(e["up"]))
    return e["tag"] not in ("html", "body", "main", "article") and H.verdict_of_names(names) == "other"


def runs(e, out):
    """Blocks (element, text, linked characters) in page order."""
    if dropped(e):
        return out
    held = []

    def end():
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            out.append((e, text, min(len(text), sum(len(t.strip()) for t, linked in held if linked))))
        held.clear()

    for part in e["parts"]:
        if isinstance(part, tuple):
            held.append(part)
        else:
            end()
            runs(part, out)
    end()
    return out


def plain_text(page):
    dom = Dom()
    dom.feed(page)
    dom.close()
    found = runs(dom.root, [])
    inside = lambda e, top: any(x is top for x in line(e))
    everything = {id(x): x for e, _, _ in found for x in line(e)}
    points = dict.fromkeys(everything, 0.0)
    for e, text, linked in found:
        score = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        start = e["up"] if e["tag"] in H.PARAGRAPH else e
        for level, x in enumerate(list(line(start))[:5]):
            points[id(x)] += score / [1, 2, 6, 9, 12][level]
    if not found:
        return ""
    density = lambda e: sum(n for x, _, n in found if inside(x, e)) / max(1, sum(len(t) for x, t, _ in found if inside(x, e)))
    worth = {k: points[k] * (1 - density(e)) for k, e in everything.items()}
    best = everything[max(worth, key=worth.get)]
    whole = [x for x in line(best) if x["tag"] in ("article", "main")]
    top = whole[0] if whole else best
    linked_blocks = lambda e: sum(1 for x, _, n in found if n and inside(x, e))
    menus = [e for k, e in everything.items() if e["tag"] in H.LISTS and linked_blocks(e) > 1 and density(e) >= 0.5 and worth[k] < worth[id(best)]]
    out = []
    for e, text, linked in found:
        if inside(e, top):
            below = []
            for x in line(e):
                if x is top:
                    break
                below.append(x)
            keep = not any(x is m for x in below for m in menus)
        elif whole or top["up"] is None or not inside(e, top["up"]):
            keep = False
        else:
            chain = list(line(e))
            at = next(i for i, x in enumerate(chain) if x is top["up"])
            side = chain[at - 1] if at else None
            keep = 4 * linked < len(text) if side is None or side["tag"] in H.PARAGRAPH else side["tag"] == top["tag"] and worth[id(side)] >= worth[id(best)] / 5
        if keep:
            out.append(text)
    return " ".join(out)


P = "".join(f"<p>Sentence {i} of the article, with commas, and &amp; signs, tells more than a menu does.</p>" for i in range(6))
PAGES = [
    f"<html><body><nav><ul><li><a href=1>x</a></li></ul></nav><div class='story'><h1>T</h1>{P}</div><div class='story'><p>{'More, of it, ' * 30}</p></div><div class='other'><p>no</p></div><footer>f</footer></body></html>",
    f"<html><body><main><article><header><h1>Head</h1></header>{P}<ul><li><a href=1>Other one</a></li><li><a href=2>Other two</a></li></ul></article><article><p>Short.</p></article></main></body></html>",
    f"<html><body><div><div>{P}</div><div class='comments'>{P}</div><p>A <a href=1>link</a> beside, not long.</p></div></body></html>",
    f"<html><body><article><h1>A</h1>{P}<div><a href=1>one thing</a><div><a href=2>another</a></div></div><table><tr><td>cell, one</td><td>cell two</td></tr></table><blockquote>Said, so.</blockquote></article><aside>{P}</aside></body></html>",
    "<html><body><p>Only one, short.</p></body></html>",
    "<html><head><title>t</title></head><body><script>x('<p>no</p>')</script></body></html>",
]


@pytest.mark.parametrize("page", PAGES)
def test_against_plain_tree(page):
    assert H.main_text(page) == plain_text(page)


def test_pages_of_the_tables(spark):
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        want = plain_text(row.html or "")
        assert H.main_text(row.html) == want
        body = re.search(r"<article>(.*)</article>", row.html or "", re.S)
        if body:
            assert want


@pytest.mark.parametrize("name", ["content sidebar-right", "post-with-comments", "share-price-report", "ad-free", "adFree", "entry no-comments", "article-header"])
def test_class_names_do_not_lose_the_article(name):
    text = H.main_text(f"<body><nav><a>x</a></nav><div class='{name}'>{P}</div><div class='comments'><p>Nice, very, nice.</p></div></body>")
    assert text.startswith("Sentence 0") and text.endswith("menu does.")


@pytest.mark.parametrize("name", ["ad", "ads-top", "sidebar", "content-sidebar", "comment-body", "commentList", "cookie-notice", "related-posts", "page-footer", "header-content", "newsletter-signup"])
def test_class_names_of_other_parts(name):
    text = H.main_text(f"<body><div class='post'>{P}</div><div class='{name}'><p>Another, text, that is, no article, but has, commas, as well.</p></div></body>")
    assert text.endswith("menu does.") and "Another" not in text


def test_doubtful_names_go_by_their_share():
    small = f"<body><div>{P}</div><div class='share-price-report'><p>Price, now, is, up.</p></div></body>"
    assert "Price" not in H.main_text(small)
    assert H.main_text(f"<body><div class='widget'>{P}</div></body>").startswith("Sentence 0")  # the only text, and enough of it
    assert H.main_text("<body><div class='ad'>Buy, now.</div></body>") == ""


def test_menu_within_the_article_goes():
    text = H.main_text(f"<article>{P}<ul><li><a href=1>Other one</a></li><li><a href=2>Other two</a></li></ul><ul><li>kept, item</li><li>with <a>a link</a> in longer text</li></ul></article>")
    assert "Other" not in text and "kept, item with a link in longer text" in text


def test_very_long_page():
    page = "<html><body><nav>n</nav><article>" + "<p>Long, page, with &eacute; text.</p>" * 40_000 + "</article></body></html>"
    assert H.main_text(page) == " ".join(["Long, page, with é text."] * 40_000)
