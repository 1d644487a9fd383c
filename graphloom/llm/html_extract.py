"""HTML extraction by tree scoring: paragraphs pass points up, discounted by link density; the best container is kept."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

#: Elements that start a block of their own.
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements without an end tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and elements that never hold main text.
RAW = set("script style noscript template textarea title iframe noembed noframes xmp".split())
DROPPED = RAW | set("head nav footer aside form button select option fieldset menu dialog svg math object canvas audio video map search".split())
#: Words of class and id attributes that name what is not the article, ...
HINTS = set("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies dialog disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion related recommended replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: ... those that name the article, those that only name a place or a kind of box, and those that only mention a thing.
ARTICLE = set("article articles body content contents entries entry main page post posts single stories story text".split())
PLACES = set("area aside bar block bottom box btn button buttons card col column container count desktop first fixed global group holder icon icons inner item items last left link links list local meta mobile module outer panel primary region right row secondary section side site slot small sticky title top unit wide widget widgets wrap wrapper".split())
MENTIONS = set("has no non not with without".split())
#: Roles of what is not the article.
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Containers that may be a list of links, which is a menu wherever it stands.
LISTS = set("ul ol menu dl table div section".split())
#: Characters without links from which a page's only text is main text whatever its class.
ENOUGH = 200
#: Elements that pass their points to their parent, not to themselves.
PARAGRAPH = set("p li h1 h2 h3 h4 h5 h6 pre blockquote td th dd dt figcaption caption".split())
#: An open element that a start tag of the same family ends, up to a boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_attribute = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_piece = re.compile(r"[a-z]+")


class Node:
    """A block element: its place in the tree, what its class says and the points that reach it."""

    __slots__ = ("blocks", "chars", "drop", "linked", "links", "parent", "points", "tag", "verdict")

    def __init__(self, tag: str, parent: Node | None, verdict: str):
        self.tag, self.parent, self.verdict = tag, parent, verdict
        self.drop = verdict == "drop" or parent is not None and parent.drop
        self.points, self.chars, self.links, self.blocks, self.linked = 0.0, 0, 0, 0, 0

    def line(self):
        """The element and its ancestors, inner first."""
        at = self
        while at is not None:
            yield at
            at = at.parent


def verdict_of_names(names: list[str]) -> str:
    """What class and id names say: "other" (no main text), "doubt" or "".

    A name speaks against an element if it has only words of HINTS, PLACES and ARTICLE, a hint among them; it is in doubt
    if a hint is its first or last word beside others. Another name that speaks for it makes a doubt of both.
    """
    against = for_ = doubt = False
    for name in names:
        words = _piece.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
        if not words or MENTIONS & set(words) or words[-1] == "header" and words[0] in ARTICLE:
            continue
        if not HINTS & set(words):
            for_ |= words[0] in ARTICLE and set(words) <= ARTICLE | PLACES
        elif set(words) <= HINTS | PLACES | ARTICLE:
            against = True
        else:
            doubt |= words[0] in HINTS or words[-1] in HINTS
    return "other" if against and not for_ else "doubt" if against or doubt else ""


def verdict(tag: str, attributes: str, parent: Node | None) -> str:
    """Whether an element and all it holds is no main text: "drop", or what its names say."""
    if tag in DROPPED:
        return "drop"
    if tag == "header":  # the heading of an article belongs to it
        return "" if any(x.tag in ("article", "main") for x in (parent.line() if parent else ())) else "drop"
    if not attributes or tag in ("html", "body", "main", "article") and "comment" not in attributes:
        return ""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _attribute.finditer(attributes)}
    if re.search(r"(?:^|\s)hidden(?:\s|$)", _attribute.sub(" ", attributes)) or found.get("aria-hidden") == "true" or _hidden.search(found.get("style", "")):
        return "drop"
    if found.get("role", "").lower() in ROLES:
        return "drop"
    return verdict_of_names((found.get("class", "") + " " + found.get("id", "")).split())


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """(element, text, characters in links) of each block of text in page order, without dropped elements."""
    root = Node("#root", None, "")
    stack, found, parts = [root], [], []
    links = linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not stack[-1].drop:
                found.append((stack[-1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    at = 0
    while True:
        m = _token.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                parts.append(" ")
            elif tag in BLOCK or tag in DROPPED:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        flush()
                        del stack[i:]
                        links = 0
                        break
            continue
        attributes = m[3] or m[6] or ""
        if tag == "a":
            links += 1
        elif tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag in BLOCK:
                flush()
        elif tag in ("br", "hr") or tag in VOID:
            if tag == "hr":
                flush()
            parts.append(" ")
        elif tag in BLOCK or verdict(tag, attributes, stack[-1]):
            flush()
            links = 0
            if stack[-1].tag == "p":
                stack.pop()
            if tag in CLOSES:
                ends, bounds = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in bounds:
                        break
                    if stack[i].tag in ends:
                        del stack[i:]
                        break
            if not attributes.endswith("/") or tag in BLOCK:
                stack.append(Node(tag, stack[-1], verdict(tag, attributes, stack[-1])))
    flush()
    return found


def wanted(found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks without the elements whose names speak against them.

    An element in doubt stays if it has half of the text of the page that is in no link and in no other such element. If
    nothing is left, an element that the names speak against stays on the same terms and with ENOUGH of such text.
    """
    named = [(x, next((v for v in ("other", "doubt") if any(n.verdict == v for n in x[0].line())), "")) for x in found]
    if all(not v for _, v in named):
        return found
    for level, out, least in (("doubt", "other", 0), ("other", "", ENOUGH)):
        mine = [x for x, v in named if v != out or not out]
        plain: dict[int, int] = {}
        total = 0
        for node, text, linked in mine:
            total += len(text) - linked
            for n in node.line():
                if n.verdict == level:
                    plain[id(n)] = plain.get(id(n), 0) + len(text) - linked
        stay = {n for n, size in plain.items() if 2 * size >= total and size > least}
        left = [x for x in mine if all(n.verdict not in ("doubt", "other") or n.verdict == level and id(n) in stay or level == "other" and n.verdict == "doubt" for n in x[0].line())]
        if left:
            return left
    return []


def main_text(page: str | None) -> str:
    """The text of the best container and of its siblings that score, blocks joined by a space; empty if none.

    Inside an article the same scores decide: a container of two blocks or more with half of its text in links is a menu.
    """
    found = wanted(blocks(page or ""))
    scored: dict[int, Node] = {}
    for node, text, linked in found:
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        for own in node.line():
            own.chars += len(text)
            own.links += linked
            own.blocks += 1
            own.linked += linked > 0
        at, level = node.parent if node.tag in PARAGRAPH else node, 0
        while at is not None and level < 5:
            at.points += points / (1, 2, 6, 9, 12)[level]
            scored[id(at)] = at
            at, level = at.parent, level + 1
    if not scored:
        return ""
    worth = lambda n: n.points * (1 - n.links / max(1, n.chars))
    best = max(scored.values(), key=worth)
    whole = next((n for n in best.line() if n.tag in ("article", "main")), None)
    top = whole or best
    if top.tag == "main":
        inner = [n for n in scored.values() if n.tag == "article" and any(x is top for x in n.line())]
        top = max(inner, key=worth) if len(inner) == 1 else top
    menu = lambda n: n.tag in LISTS and n.linked > 1 and 2 * n.links >= n.chars and worth(n) < worth(best)
    limit = worth(best) / 5
    out = []
    for node, text, linked in found:
        line = list(node.line())
        depth = next((i for i, n in enumerate(line) if n is top), None)
        if depth is not None:
            keep = not any(menu(n) for n in line[:depth])
        elif whole is not None or top.parent is None or top.parent not in line:
            keep = False
        else:  # beside the best container
            at = line.index(top.parent)
            side = line[at - 1] if at else None
            if side is None or side.tag in PARAGRAPH:
                keep = 4 * linked < len(text)
            else:
                keep = side.tag == top.tag and worth(side) >= limit
        if keep:
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html", carry: Sequence[str] = ("url",)) -> DataFrame:
    """(key, carried columns, text, n_chars) for each row of ``pages``.

    A null or empty page, and one without main text, has an empty text. The whole page is read; unclosed and truncated
    markup is read as far as it goes. Repeated rows come out repeatedly; columns not in ``carry`` are not read.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [main_text(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), part.column(2)], names=["_key", "text", "n_chars", "_carry"])

    source = pages.select(F.col(key).alias("_key"), F.col(page).cast("string").alias("_page"), F.struct(F.lit(0).alias("_"), *carry).alias("_carry"))
    out = source.mapInArrow(run, f"_key {source.schema['_key'].dataType.simpleString()}, text string, n_chars long, _carry {source.schema['_carry'].dataType.simpleString()}")
    return out.select(F.col("_key").alias(key), *(F.col("_carry")[c].alias(c) for c in carry), "text", "n_chars")
