"""Main text of web pages by two passes of block rules.

Pass 1 labels blocks by link density, stop-word density and length: good, bad, or undecided when
too short or too mixed to tell. Where a block stands is a feature of these rules: an article, main
or content-named container lowers the density a block needs and text outside it needs more;
page furniture (navigation, forms, comments) is bad. An element whose class or id merely contains a furniture word
(no-sidebar, has-comments) is furniture too, unless the page's good text is inside it. Pass 2 gives undecided blocks the label of the
nearest decided neighbours, first those of the same section of the page.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import sized

#: Elements whose text is never shown, that are page furniture, that hold an article, that break blocks.
HIDDEN = frozenset("script style noscript template svg math head iframe object canvas textarea select".split())
RAW = frozenset("script style textarea title noscript iframe".split())
FURNITURE = frozenset("nav footer aside form menu dialog button header".split())
CONTENT = {"article": 3, "main": 2}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of class and id names that mark furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright"
    " disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo"
    " promoted recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription tags"
    " teaser toolbar widget".split()
)
#: Words of class and id names that mark the text of a page without an article element.
CONTENT_MARKS = frozenset("article body content entry main post story".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her"
    " she there would their we him been has when who will no more if out so said what up its about into than them can only other"
    " der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer"
    " um am sind noch wie einem über einen so zum haben nur oder aber vor zur bis mehr durch man"
    " le la les de des du et en un une que est pour qui dans ce il au pas plus par sur se ne sont avec son ou comme mais on nous sa elle aux"
    " el los las del y que se con una por su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre".split()
)
#: Elements that may stand in a head; any other ends it.
HEAD_PARTS = frozenset("base link meta noscript script style template title".split())
#: Pass 1: shares of linked text and of stop words, and lengths in characters.
LINKS_MOST, STOP_LOW, STOP_HIGH, SHORT, LONG = 0.5, 0.15, 0.28, 70, 200

#: Quotes count only behind an equals sign; nothing is tried twice, so a page of any kind is scanned in one go.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'>])([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
_HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)
_NOTICE = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)
_NAME = re.compile(r"[a-z]+")
#: Good text outside the elements that only contain a furniture word, as a share of what the greatest holds, that shows them to be furniture.
OUTSIDE = 0.1
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    section: int
    furniture: bool
    content: int  # 3 in an article element, 2 in main, 1 in a container named like content, 0 elsewhere
    heading: bool = False
    mark: int = 0  # innermost open element whose name contains a furniture word, 0 for none
    label: str = ""
    rule: str = ""  # what decided: links, place, notice, density, length, neighbour or default


def names(attributes: str) -> list[str]:
    """Classes and ids in lower case."""
    return [x for name, a, b, c in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for x in (a or b or c).lower().split()]


def named(attributes: str, marks: frozenset[str]) -> bool:
    return any(not marks.isdisjoint(_NAME.findall(x)) for x in names(attributes))


def marks_furniture(element: str, attributes: str) -> bool:
    """Whether an element is furniture by its role, because it is hidden, or because a class or id is a furniture word.

    An article's classes often list its topics; it is furniture only if one begins with such a word (comment-body).
    """
    for x in names(attributes):
        if x in MARKS or element in CONTENT and _NAME.findall(x)[:1] and _NAME.findall(x)[0] in MARKS:
            return True
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value.strip() in ROLES or name == "aria-hidden" and value == "true":
            return True
    return name_is_hidden(attributes)


def settle(found: list[Block], parents: list[int]) -> None:
    """Decide which elements whose names contain a furniture word are furniture: not those around the page's good text.

    From outside in, the one with most good text is let go while hardly any stands outside of all.
    """
    level = max((b.content for b in found if not b.furniture), default=0)
    judged = [first_pass(b, level) for b in found]
    good = [len(b.text) * (label == "good") for b, (label, _) in zip(found, judged, strict=True)]
    if not any(good):
        good = [len(b.text) * (rule not in ("links", "place", "notice")) for b, (_, rule) in zip(found, judged, strict=True)]
    own = [0] * len(parents)
    for b, n in zip(found, good, strict=True):
        own[b.mark] += n
    within = list(own)
    below: list[list[int]] = [[] for _ in parents]
    for i in range(len(parents) - 1, 0, -1):
        below[parents[i]].append(i)
        if parents[i]:
            within[parents[i]] += within[i]
    outside, let_go = own[0], {0}
    heap = [(-within[i], i) for i in below[0]]
    heapq.heapify(heap)
    while heap and outside < -OUTSIDE * heap[0][0]:
        _, i = heapq.heappop(heap)
        let_go.add(i)
        outside += own[i]
        for j in below[i]:
            heapq.heappush(heap, (-within[j], j))
    for b in found:
        b.furniture = b.furniture or b.mark not in let_go


def name_is_hidden(attributes: str) -> bool:
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", attributes, re.I)) if "hidden" in attributes or "display" in attributes else False


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with the share of linked text and the kind of place they stand in."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int, int]] = []  # name, hidden, furniture, content, mark
    opened: Counter[str] = Counter()
    parents = [0]  # of each mark
    parts: list[str] = []
    linked = section = 0
    anchor: int | None = None  # depth of the stack at the open link

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text and not (stack and stack[-1][1]):
            top = stack[-1] if stack else ("", False, False, 0, 0)
            out.append(Block(text, linked, section, top[2], top[3], any(x[0] in HEADINGS for x in stack[-2:]), top[4]))
        parts.clear()
        linked = 0

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    at, size = 0, len(page)
    while at <= size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text and not (stack and stack[-1][1]):
            text = html.unescape(text)
            parts.append(text)
            if anchor is not None:
                linked += len(" ".join(text.split()))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                close()
            if name == "a":
                anchor = None
            if opened[name]:
                was = stack[-1][2], stack[-1][4]
                while pop() != name:
                    pass
                section += was != ((stack[-1][2], stack[-1][4]) if stack else (False, 0))
                if anchor is not None and len(stack) < anchor:
                    anchor = None
                if name in FURNITURE or name in CONTENT or name == "section":
                    section += 1
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD_PARTS:
            pop()
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            close()
            if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                pop()
                if anchor is not None and len(stack) < anchor:
                    anchor = None
        if name in FURNITURE or name in CONTENT or name == "section":
            section += 1
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name == "a":
            anchor = len(stack) if _HREF.search(m[3]) else None
            continue
        up = stack[-1] if stack else ("", False, False, 0, 0)
        page_itself = name in ("body", "html")
        content = max(up[3], CONTENT.get(name, 0), int(not page_itself and named(m[3], CONTENT_MARKS)))
        # a header inside an article is its title; elsewhere it is the site's
        furniture = up[2] or name in FURNITURE and not (name == "header" and content > 1) or not page_itself and marks_furniture(name, m[3])
        mark = up[4]
        if not furniture and not page_itself and name not in CONTENT and named(m[3], MARKS):
            parents.append(mark)
            mark = len(parents) - 1
        if name in BLOCK or name in HIDDEN or name in FURNITURE:
            section += (furniture, mark) != (up[2], up[4])
            stack.append((name, up[1] or name in HIDDEN, furniture, content, mark))
            opened[name] += 1
    close()
    if len(parents) > 1:
        settle(out, parents)
    return out


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP for w in words) / max(1, len(words))


def first_pass(b: Block, level: int) -> tuple[str, str]:
    """Label and rule. ``level`` is the best content level on the page, 0 if no container is named.

    Inside content few stop words make a block good, and a long one without them stays undecided, as does a linked one
    of an article (its sources); outside an article or main element even prose is at most undecided.
    """
    size, inside = len(b.text), bool(level) and b.content >= level
    if b.linked > LINKS_MOST * size:
        return ("", "") if inside and level > 1 and not b.furniture else ("bad", "links")
    if b.furniture:
        return "bad", "place"
    if not inside and size < LONG and _NOTICE.match(b.text):
        return "bad", "notice"
    if size < SHORT or inside and b.heading:
        return "", ""
    stop = stop_share(b.text)
    if inside:
        return ("good", "density") if stop >= STOP_LOW else ("", "")
    if level > 1:
        return ("", "") if stop >= STOP_HIGH and size >= LONG else ("bad", "density")
    if stop >= STOP_HIGH:
        return "good", "density"
    if size < LONG:
        return "", ""
    return ("good" if stop >= STOP_LOW else "bad"), "length"


def second_pass(found: list[Block]) -> None:
    """Undecided blocks take the nearest decided label of their section, else of the page.

    Only blocks on the same side count as neighbours: within an article or main element, or outside
    it; furniture inside content is none. Of two neighbours at the same distance the good one counts.
    Without decided neighbours a block is good, but bad outside the article of a page. A heading in
    content that only furniture follows (say, of the comments) is bad. Where pass 1 makes nothing good
    (a language without stop words here, a page of short lines) long blocks without links are good, else
    those with stop words, else all but links, furniture and notices.
    """
    level = max((b.content for b in found if not b.furniture), default=0)
    inside = [bool(level) and b.content >= level for b in found]
    for b in found:
        b.label, b.rule = first_pass(b, level)
    if not any(b.label == "good" for b in found):
        rest = [b for i, b in enumerate(found) if b.rule not in ("links", "place", "notice") and (inside[i] or level < 2)]
        for ok, rule in ((lambda b: len(b.text) >= LONG, "length"), (lambda b: stop_share(b.text) >= STOP_LOW, "density"), (lambda b: True, "default")):
            for b in [b for b in rest if ok(b)]:
                b.label, b.rule = "good", rule
            if any(b.label == "good" for b in rest):
                break
    first = [b.label for b in found]

    def nearest(same: bool) -> list[tuple[int, bool, str]]:
        best = [(1 << 30, True, "")] * len(found)
        for order in (range(len(found)), range(len(found) - 1, -1, -1)):
            last: dict[bool, int] = {}
            for i in order:
                side = level > 1 and inside[i]
                if first[i]:
                    if not (inside[i] and found[i].furniture):
                        last[side] = i
                elif (at := last.get(side)) is not None and (not same or found[at].section == found[i].section):
                    best[i] = min(best[i], (abs(i - at), first[at] != "good", first[at]))
        return best

    within, anywhere = nearest(True), nearest(False)
    last_inside = max((i for i, b in enumerate(found) if inside[i] and not b.furniture), default=-1)
    for i, b in enumerate(found):
        if first[i]:
            continue
        if b.heading and inside[i] and i == last_inside and i + 1 < len(found) and found[i + 1].furniture and inside[i + 1]:
            b.label, b.rule = "bad", "neighbour"
        elif near := within[i][2] or anywhere[i][2]:
            b.label, b.rule = near, "neighbour"
        else:
            b.label, b.rule = "bad" if level > 1 and not inside[i] else "good", "default"


def main_text(page: str | None) -> str:
    """Good blocks of a page joined by newlines; empty for null, empty and textless pages."""
    found = blocks(page or "")
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == "good")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, url, text, n_chars (code points).

    Character references are decoded and white space inside a block becomes one space. A null
    html gives an empty text; unclosed elements end with their parent; repeated rows are
    extracted each; other columns are ignored; an empty table gives none.
    """
    sized(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
