"""Main text of web pages by two-pass block rules.

The markup is read once by a tolerant scanner into blocks (text between block-level tags) with their length, the share of their
characters inside links, the share of stop words and their container. Pass one classifies every block by these:

* bad: inside a boilerplate container (navigation, header, footer, sidebar, form, notice, advert, comments, hidden parts), or mostly
  links;
* good: long and dense in stop words; bad: long without stop words; near: in between; short: too short to tell.

A marked article moves labels by one step, it does not decide alone. The mark counts unless the text outside it that is dense in stop
words is more than MARK characters and more than the text of the largest marked article (articles that are teaser cards). Where it
counts, blocks inside go up (long without stop words and short to near, near to good) and blocks outside go down (good to near, near to
short, short to bad). Where it does not, all labels stay.

Pass two gives short and near blocks the label of the nearest decided neighbour (near blocks take good from either side, a short
block between different labels takes the nearer one, on a tie the one before). Undecided blocks inside an article look at decided
blocks inside articles only; if there are none they are kept where the mark counts. Good blocks are joined in page order.

Defined cases: null and empty html give an empty text. Text without markup is one block and kept. Unclosed and stray tags are
tolerated; an unclosed script, style or comment ends with the page. Repeated rows each get a row. An empty table gives an empty
result. Extra columns are unread.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SLICE = 8 << 20

# fixed values: function words of English, French, German and Spanish
STOP_WORDS = frozenset(
    """a about all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on or
    our she so that the their there they this to was we were what which who will with would you your
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses
    son sont sur un une vous
    aber als am an auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im ist mit
    nach nicht noch nur oder sich sie sind so über um und von vor war wie wir zu zum zur
    al como con cuando del el ella ellos es esta este ha hay las lo los más me mi muy no nos o para pero por porque se si sin sobre su
    sus también te tu una uno y ya""".split()
)

BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LOOSE_TAGS = frozenset("p li dt dd tr td th option".split())  # end tags are optional: these hold no state
RAW_TAGS = "script|style|noscript|template|iframe|svg|textarea|title|math|object|canvas|audio|video"
BAD_TAGS = frozenset("nav footer aside form button select menu dialog head".split())
BAD_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar
    breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay
    newsletter subscribe subscription signup login search social share sharing comment comments disqus reply replies respond related
    recommended widget toolbar pagination pager skip hidden""".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
SETTINGS = frozenset("has with without no is body page site wrapper container content".split())  # "with-sidebar" describes a layout, not a sidebar

TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW_TAGS})\b[^>]*(?:/>|>(?:.*?</(?P=raw)\s*>|.*\Z))|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-z][^>]*>""",
    re.S | re.I,
)
ATTR = re.compile(r"""([a-z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG, FEW, MANY, LINKS, ALL_LINKS = 70, 200, 0.12, 0.22, 0.33, 0.8
MARK = 400  # dense characters outside that a marked article outweighs whatever it holds
UP = {"sparse": "near", "short": "near", "near": "good"}
DOWN = {"sparse": "bad", "good": "near", "near": "short", "short": "bad"}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(raw)}


def container_kind(tag: str, raw: str, in_article: bool) -> str | None:
    """'bad' for boilerplate, 'article' for a marked article, None otherwise."""
    if tag in BAD_TAGS or (tag == "header" and not in_article):
        return "bad"
    if tag in ("html", "body"):
        return None
    if raw.strip():
        a = _attributes(raw)
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) or a.get("role", "") in BAD_ROLES:
            return "bad"
        if tag not in ("article", "main"):
            for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
                parts = re.split(r"[^a-z]+", name)
                if not SETTINGS.intersection(parts) and (BAD_NAMES.intersection(parts) or ("header" in parts and not in_article)):
                    return "bad"
        if a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody":
            return "article"
    return "article" if tag in ("article", "main") else None


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
Block = tuple[str, int, str | None, bool, int]


def blocks(page: str) -> list[Block]:
    """(text with white space collapsed, characters inside links, container kind, is a heading, number of the innermost marked
    article or 0) of every non-empty block in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str | None, int]] = []  # open elements and what holds from there: bad outweighs article
    parts: list[str] = []
    linked, in_link, heading = 0, False, False
    state: str | None = None
    article, articles = 0, 0

    def close():
        nonlocal linked, parts
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, min(linked, len(text)), state, heading, article))
        parts, linked = [], 0

    def said(chunk: str):
        nonlocal linked
        if chunk:
            chunk = html.unescape(chunk)
            parts.append(chunk)
            if in_link:
                linked += len(chunk.strip())

    at = 0
    for m in TOKEN.finditer(page):
        said(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() == "title":
                close()
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m["end"]
            continue
        if tag == "br":
            parts.append("\n")
            continue
        block = tag in BLOCK_TAGS
        if block:
            close()
            heading = tag in HEADINGS and not m["end"]
        if tag in VOID_TAGS or tag in LOOSE_TAGS and not m["attrs"].strip() and not m["end"]:
            continue
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    state, article = stack[-1][1:] if stack else (None, 0)
                    break
                if stack[i][0] in ("article", "main", "body", "nav", "footer", "header", "aside", "form") and tag not in BLOCK_TAGS:
                    break  # an inline end tag does not close a section
            if block:
                in_link = False
        elif block or m["attrs"].strip():
            kind = container_kind(tag, m["attrs"], state == "article")
            if kind is not None or tag not in LOOSE_TAGS:
                if tag in LOOSE_TAGS and stack and stack[-1][0] == tag:
                    stack.pop()
                    state, article = stack[-1][1:] if stack else (None, 0)
                if kind is not None and not block:
                    close()
                state = "bad" if "bad" in (state, kind) else kind or state
                if kind == "article":
                    articles += 1
                    article = articles
                stack.append((tag, state, article))
    said(page[at:])
    close()
    return out


def by_density(text: str, linked: int, kind: str | None) -> str:
    """Label of a block by its links, length and stop words; 'sparse' is long without stop words."""
    n, links = len(text), linked / len(text)
    if kind == "bad" or links > (ALL_LINKS if kind == "article" else LINKS):
        return "bad"
    if n < SHORT:
        return "bad" if kind != "article" and (links > 0 or "©" in text) else "short"
    words = WORD.findall(text.lower())
    dense = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return "good" if dense >= MANY and n >= LONG else "near" if dense >= FEW else "sparse"


def mark_counts(found: list[Block], first: list[str]) -> bool:
    """Whether the page's marked articles are where its main text is."""
    held: dict[int, int] = {}
    outside = 0
    for (text, _, kind, _, article), x in zip(found, first, strict=True):
        if kind == "article" and x != "bad":
            held[article] = held.get(article, 0) + len(text)
        elif kind is None and x in ("good", "near"):
            outside += len(text)
    return bool(held) and outside <= max(MARK, *held.values())


def labels(found: list[Block]) -> list[bool]:
    """Pass one and pass two: True for blocks of the main text."""
    first = [by_density(*b[:3]) for b in found]
    inside = [b[2] == "article" for b in found]
    counts = mark_counts(found, first)
    if counts:
        first = [(UP if own else DOWN).get(x, x) for x, own in zip(first, inside, strict=True)]
    first = ["bad" if x == "sparse" else x for x in first]
    # nothing is decided: what is dense counts, else what is short; inside the article before outside
    for own, label in [(True, "near"), (False, "near"), (True, "short"), (False, "short")]:
        if "good" not in first and (counts or not own):
            first = ["good" if x == label and y == own else x for x, y in zip(first, inside, strict=True)]
    everywhere = [i for i, x in enumerate(first) if x in ("good", "bad")]
    within = [i for i in everywhere if inside[i]]
    out = []
    for i, x in enumerate(first):
        if x in ("good", "bad"):
            out.append(x == "good")
            continue
        decided = within if inside[i] else everywhere
        below = bisect_left(decided, i)
        left = decided[below - 1] if below else None
        right = decided[below] if below < len(decided) else None
        sides = [first[j] for j in (left, right) if j is not None]
        if x == "near" or len(set(sides)) < 2:
            out.append("good" in sides or not sides and (counts or not inside[i]))
        else:
            after = right - i < i - left or (right - i == i - left and found[i][3])
            out.append(first[right if after else left] == "good")
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b[0] for b, keep in zip(found, labels(found), strict=True) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, ...) -> (page_id, url, text, n_chars)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "html", SLICE):
                texts = [main_text(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return common.add_id_check(pages, ["page_id", "url", "html"]).mapInArrow(extract, "page_id long, url string, text string, n_chars long")
