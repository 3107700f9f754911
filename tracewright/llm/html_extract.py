"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page is read once, tag by tag, into leaf blocks: runs of text not parted by a block-level tag. Each block
has features of its ancestors' tags and class names, its own tag, its length, link share and punctuation. The
field is trained on labelled pages that this module lays out from templates and is decoded by Viterbi.
Scripts, styles, a form's controls and other elements that never show article text, comments and markup are left
out while reading; a form's other blocks are the field's to judge. The blocks tagged as content are joined by
line feeds; nothing is cut.

Broken pages: an open head ends at the first tag of a body; a button or the like that is never closed ends at the
next block-level tag; a quoted value whose quote never closes before a space, a slash or the tag's end is no value,
and the tag ends at the next ``>``; a tag without any is the page's end, as in browsers. Reading takes time in
proportion to the page's length, whatever its tags and however deep they are nested.

Null or empty html gives an empty text, as does a page without any content block. Character references are
decoded, white space within a block becomes one space. Text outside of any block-level tag is a block too.
Repeated rows are read alike, null ids and urls are kept, an empty table gives no rows, a very long page is read
whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.crf import LinearChainCRF
from tracewright.llm.common import tuned

BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("head script style noscript template textarea select button option svg iframe object canvas audio video title".split())
#: Tags that may stand in a head; any other block ends an open head.
_IN_HEAD = frozenset("head script style noscript template title object".split())
RAW = frozenset("script style textarea title".split())
#: Tags that a new one of the same group closes.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_LIST = frozenset("ul ol dl table".split())
_LOOSE = frozenset("p li dt dd tr td th".split())
#: Left-out elements that may hold one another.
_NESTED = frozenset("svg object template noscript".split())
_NEAR = frozenset("article main nav header footer aside section ul ol table menu dialog figure form".split())
#: A tag whose quotes all close before the next angle bracket, which is nearly every one; no part gives back what it took.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)([^>"']*+(?:"[^"<>]*+"[^>"']*+|'[^'<>]*+'[^>"']*+)*+)>""")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_VALUE = re.compile(r"""=\s*+(["'])|>""")
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*["']?([^"'>]*)""", re.I)
_WORD = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_BOTH = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in SKIP}


class Node:
    """An open element: its tag, and what its blocks are told of it and its ancestors."""

    __slots__ = ("inner", "names", "near", "tag", "weak")

    def __init__(self, tag: str, names: frozenset, above: Node | None, weak: bool = False):
        self.tag, self.weak = tag, weak
        self.names = names | above.names if above and names else above.names if above else names
        self.near, self.inner = (above.near, above.inner) if above else (frozenset(), "")
        if tag in _NEAR:
            self.near, self.inner = self.near | {tag}, tag


class Block:
    __slots__ = ("linked", "node", "parts", "whole")

    def __init__(self, node: Node | None):
        self.node, self.parts, self.linked, self.whole = node, [], 0, None

    def text(self) -> str:
        if self.whole is None:
            self.whole = " ".join("".join(self.parts).split())
        return self.whole


def _tag_end(page: str, at: int) -> int:
    """The place after the tag that begins before ``at``, of which ``_TAG`` can't tell; the page's end if nothing ends it."""
    while True:
        m = _VALUE.search(page, at)
        if m is None:
            return len(page)
        if not m[1]:
            return m.end()
        close = page.find(m[1], m.end())
        if close < 0 or page[close + 1 : close + 2] not in _AFTER_VALUE:
            end = page.find(">", m.end())
            return end + 1 if end >= 0 else len(page)
        at = close + 1


_AFTER_VALUE = frozenset(["", " ", "\t", "\n", "\f", "\r", "/", ">"])


def blocks(page: str) -> list[Block]:
    """The leaf blocks with any text, in page order."""
    out: list[Block] = []
    stack: list[Node] = []
    opened: Counter[str] = Counter()
    ends_of: dict[str, list[tuple[int, bool]]] = {}
    now: Block | None = None
    at, skip, links, end = 0, 0, 0, len(page)

    def say(part: str) -> None:
        nonlocal now
        if not part or skip:
            return
        if now is None:
            if part.isspace():
                return
            now = Block(stack[-1] if stack else None)
            out.append(now)
        now.parts.append(part)
        if links:
            now.linked += len(part)

    def close(k: int) -> None:
        nonlocal skip
        for node in stack[k:]:
            skip -= node.tag in SKIP
            opened[node.tag] -= 1
        del stack[k:]

    def closed(tag: str, place: int) -> bool:
        """Whether an end tag comes after a place before another start of this tag."""
        if tag not in ends_of:
            ends_of[tag] = [(m.start(), bool(m[1])) for m in _BOTH[tag].finditer(page)][::-1]
        rest = ends_of[tag]
        while rest and rest[-1][0] < place:
            rest.pop()
        return bool(rest) and (rest[-1][1] or tag in _NESTED)

    def end_weak() -> None:
        while stack and stack[-1].weak:
            close(len(stack) - 1)

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(_decoded(page[at:]))
            break
        if lt > at:
            say(_decoded(page[at:lt]))
        m = _TAG.match(page, lt)
        if m:
            at, rest = m.end(), m[3]
        elif m := _NAME.match(page, lt):
            at = _tag_end(page, m.end())
            if at == end and page[-1] != ">":
                break
            rest = page[m.end() : at - 1]
        elif page.startswith("<!--", lt):
            at = page.find("-->", lt + 2)
            at = end if at < 0 else at + 3
            continue
        elif page[lt + 1 : lt + 2] in ("!", "?", "/") and page[lt + 2 : lt + 3]:
            at = page.find(">", lt)
            at = end if at < 0 else at + 1
            continue
        else:
            say("<")
            at = lt + 1
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK or tag in SKIP:
                now = None
                if tag in BLOCK:
                    end_weak()
                if opened[tag]:
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            elif tag == "a":
                links = max(0, links - 1)
            continue
        if tag == "br":
            say(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK or tag in SKIP:
            now, links = None, 0
            if tag in BLOCK:
                end_weak()
            if opened["head"] and tag not in _IN_HEAD:
                close(next(k for k, node in enumerate(stack) if node.tag == "head"))
            ends = _ENDS.get(tag, _ENDS["p"])
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ends:
                    close(k)
                    if tag == "p":
                        break
                elif stack[k].tag in _LIST or stack[k].tag not in _LOOSE:
                    break
            if tag == "hr" or rest.endswith("/"):
                continue
            named = frozenset(w for x in _NAMED.findall(rest) for w in _WORD.findall(x.lower()) if w in _KNOWN) if rest else frozenset()
            weak = tag in SKIP and tag != "head" and not closed(tag, at)
            stack.append(Node(tag, named, stack[-1] if stack else None, weak))
            opened[tag] += 1
            skip += tag in SKIP
            if tag in RAW:
                stop = _END[tag].search(page, at)
                at = stop.start() if stop else end
    return [b for b in out if b.text()]


def _decoded(part: str) -> str:
    return html.unescape(part) if "&" in part else part


def describe(block: Block) -> list[str]:
    text, node = block.text(), block.node
    n = len(text)
    near, inner, names, tag = (node.near, node.inner, node.names, node.tag) if node else (frozenset(), "", frozenset(), "")
    link = block.linked / max(1, n)
    return [
        "bias", f"tag={tag}", f"length={min(n, 400).bit_length()}", f"link={int(link * 4)}", f"ends={text[-1] in '.!?'}", f"mark={text[0] in '©' or 'opyright' in text}",
        *(f"in={t}" for t in near), f"inner={inner}", f"article={'article' in near or 'main' in near}", *(f"name={w}" for w in names),
    ]


# Names that sites give to parts of a page.
_PARTS = {
    "ad": "ad ads advert advertisement adbox adsense banner sponsor sponsored promo promoted".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay".split(),
    "side": "sidebar side widget related recommended trending popular recirc".split(),
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar".split(),
    "foot": "footer copyright legal bottom colophon".split(),
    "talk": "comment comments reply replies discussion disqus respond".split(),
    "share": "share social follow subscribe newsletter signup login".split(),
    "body": "article content post entry body story main text page".split(),
}

#: Class names that blocks are told of; any other would be unknown to the field.
_KNOWN = frozenset(w for names in _PARTS.values() for w in names)


def labelled_pages(count: int = 300, seed: int = 3) -> list[list[tuple[Block, int]]]:
    """Pages laid out from templates, each block with 1 for article text or 0."""
    rng = random.Random(seed)
    marks = ("", "")

    def words(least: int, most: int) -> str:
        made = ["".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(least, most))]
        return (" ".join(made)).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def box(kind: str, inner: str, tag: str = "div") -> str:
        return f'<{tag} class="{rng.choice(_PARTS[kind])}">{inner}</{tag}>'

    def p(label: int, least: int = 2, most: int = 60, tag: str = "p") -> str:
        return f"<{tag}>{marks[label]}{words(least, most)}</{tag}>"

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{marks[0]}{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"

    def aside() -> str:
        kind = rng.choice(["ad", "notice", "side", "share", "menu"])
        inner = rng.choice([p(0, 2, 15), p(0, 5, 40), links(), f"{marks[0]}{words(2, 20)}"])
        return rng.choice([box(kind, inner), box(kind, inner, "section"), f"<aside>{inner}</aside>"])

    pages = []
    for _ in range(count):
        body = [p(1, 1, 14, "h1")] if rng.random() < 0.85 else []
        for _ in range(rng.randint(0, 12)):
            body.append(rng.choice([p(1), p(1, 1, 80), p(1), p(1, 1, 8, "h2"), "<ul>" + "".join(p(1, 2, 20, "li") for _ in range(3)) + "</ul>", f"<blockquote>{p(1, 5, 30)}</blockquote>", f"<p>{marks[1]}<b>{words(1, 30)}<br>", f'<p>{marks[1]}{words(3, 20)} <a href="/y">{words(1, 4)}</a> {words(2, 9)}</p>']))
            if rng.random() < 0.12:
                body.append(aside())
        comments = box("talk", "".join(p(0, 2, 40) for _ in range(rng.randint(1, 5))), rng.choice(["div", "section"])) if rng.random() < 0.3 else ""
        inside = rng.random() < 0.4
        inner = "".join(body) + (comments if inside else "")
        shell = rng.choice(["article", "article", "article", "main", "div", "main+article"])
        core = f"<article>{inner}</article>" if shell == "article" else f"<main>{inner}</main>" if shell == "main" else f"<main><article>{inner}</article></main>" if shell == "main+article" else box("body", inner)
        top = rng.choice([f"<nav>{links()}</nav>", f"<header>{p(0, 1, 6, rng.choice(['h1', 'p', 'div']))}<nav>{links()}</nav></header>", box("menu", links()), ""])
        bottom = rng.choice([f"<footer>{marks[0]}&copy; {words(1, 12)}</footer>", f"<footer>{p(0, 2, 20)}{links()}</footer>", box("foot", p(0, 2, 20)), ""])
        parts = [top, *(aside() for _ in range(rng.choice([0, 1, 1, 2]))), core, "" if inside else comments, *(aside() for _ in range(rng.choice([0, 0, 1]))), bottom]
        found = blocks("<html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>")
        page = []
        for b in found:
            raw = "".join(b.parts)
            label = int(marks[1] in raw)
            b.parts, b.whole = [raw.replace(marks[0], "").replace(marks[1], "")], None
            page.append((b, label))
        pages.append(page)
    return pages


def fit(pages: list[list[tuple[Block, int]]] | None = None) -> LinearChainCRF:
    pages = labelled_pages() if pages is None else pages
    return LinearChainCRF(2).fit([[describe(b) for b, _ in page] for page in pages], [[y for _, y in page] for page in pages], epochs=80)


@cache
def trained() -> LinearChainCRF:
    """The field of this module's own pages, fitted once a session."""
    return fit()


def main_text(model: LinearChainCRF, page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    labels = model.decode(model.emissions([describe(b) for b in found]))
    return "\n".join(b.text() for b, y in zip(found, labels, strict=True) if y)


def extracted(pages: DataFrame, model: LinearChainCRF | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    tuned(pages.sparkSession)
    model = model or trained()
    kept = pages.selectExpr("page_id", "cast(url as string) as url", "cast(html as string) as html")
    kind = kept.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(model, x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return kept.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long").withColumn("text", F.col("text"))
