"""Main text of web pages by equivalence-class template deduction over same-host pages.

Pages of a host are taken in groups of about ``GROUP_PAGES`` (a host with more is
split by a hash of the whole row, so no host is one task).  In a group:

1.  Every page becomes tokens: tags and words, each together with its path of open
    elements (its role).
2.  Tokens with the same occurrence vector over the group's distinct pages form an
    equivalence class.  A class is valid if it is in ``SUPPORT`` of the pages, at
    least three, and its tokens keep one order in all of them; tokens out of order
    leave it.  Classes are nested: each repetition of one lies in one gap of another,
    or has the other's repetitions whole in its own gaps; one that straddles a class
    of larger support, on any page, is dropped.
3.  The valid classes are the template; what lies between its tokens are slots.  A
    block whose words all belong to the template is no slot but part of the frame.
4.  The main slots are those inside ``article`` or ``main`` elements if these hold
    at least half of the page's slot text; where one of several articles holds most
    of their slot text, the others (readers' replies, cards) aren't, nor is an
    article inside another.  Elsewhere (no such element, teaser
    cards) they are the slots under the deepest element path that holds most of
    the slot text of the group's pages of that kind, and those of a lone ``article``
    or ``main``.  Slots under navigation, headers, footers, asides, forms, scripts,
    styles, hidden elements, or elements whose class, id or role names such a part,
    an advert, a notice or comments, are never main slots.

Inside an article region a block of template words is frame only if its path holds
no other text on any page of the group: a menu that all pages repeat goes, a
sentence that pages share between their own ones stays.  A page whose regions are
template altogether keeps them, unless more slot text lies outside.

Blocks end at block-level tags; a line break tag is white space.  Character
references are decoded, white space runs become one space, blocks are joined by
an empty line.  Broken markup is read leniently: unknown end tags are ignored, an
open paragraph ends at the next block, everything ends with its container.

Defined results: null or empty html gives an empty text; pages with a null url
are one host, dealt like any other; repeated rows are repeated and count once as
evidence and in memory; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_PAGES = 64
SUPPORT = 0.5
#: The part of the slot text that a container, or one of several articles, has to hold.
MOST = 0.7
#: Copies of a repeated row's answer that are held at once.
REPEATED = 64
#: Hosts with more than one group that may be broadcast; beyond it they are joined by a shuffle.
MAX_BROADCAST_HOSTS = 100_000

# HTML element kinds and words that name parts of a frame.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = ("script", "style", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "svg", "math", "object", "canvas", "xmp")
FRAME = set("head nav footer aside form menu button select dialog fieldset".split()) | set(RAW)
FRAME_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
FRAME_WORDS = set(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidenav menu submenu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer bottombar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login register "
    "share sharing social related recommended recommendations comment comments commentary remark remarks discussion discussions talkback disqus reply replies responses respond pagination pager widget toolbar search skip alert toast paywall copyright legal outbrain taboola".split()
)
#: Before such a word the part itself is meant: "has-sidebar" names a page, "post-comments" comments.
DENIALS = set("no has with without not free".split())
#: A header of one of these belongs to the text.
HEADED = set("article post entry content story main page title".split())
#: These may be searched, shared or sold as a whole, so a part of that name is no frame.
WHOLES = set("search share notice legal promo respond register".split())

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*+>?""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    path: tuple[str, ...]
    main: bool
    text: str = ""
    words: range = range(0)  # places in the page's tokens
    article: int = 0  # the page's articles from 1; 0: in none
    place: tuple[tuple[str, int], ...] = ()  # the path with each element's number among those of its kind beside it


@dataclass
class Page:
    tokens: list[tuple[str, str]]
    blocks: list[Block]
    regions: int  # outermost article or main elements
    elements: list[tuple[tuple[str, int], ...]] = field(default_factory=list)  # the places of all block elements


def _attributes(tag: str, name: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(tag, len(name) + 1)}


def _is_frame(name: str, attributes: dict[str, str], in_main: bool) -> bool:
    if name in FRAME:
        return True
    if name == "header" and not in_main:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in FRAME_ROLES:
        return True
    if name in ("html", "body", "main"):
        return False
    return any(_names_frame([w.lower() for w in WORDS_OF_NAME.findall(label)]) for label in f"{attributes.get('class', '')} {attributes.get('id', '')}".split())


def _names_frame(words: list[str]) -> bool:
    """Whether a class or id, cut into words, names a part of the frame."""
    parts = {w for w in words if w in FRAME_WORDS}
    if not parts or DENIALS & set(words):
        return False
    kept = HEADED & set(words)
    if kept and parts <= {"header"}:
        return False
    # "search-content", "legal-page": the thing named last is the text itself.
    return not (parts <= WHOLES and words[-1] in HEADED | {"body"})


def parse(html: str) -> Page:
    """The page's tokens with their paths, and its text blocks that are in no frame element."""
    tokens: list[tuple[str, str]] = []
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, bool, int]] = []  # name, label, frame, main, article
    parts: list[str] = []
    path, frame, main, article = "", False, False, 0
    regions = articles = 0
    beside: Counter = Counter()  # block elements of a kind under a place
    elements: list[tuple[tuple[str, int], ...]] = []
    places: list[tuple[tuple[str, int], ...]] = []  # of the open elements

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                labels = tuple(s[1] for s in stack)
                blocks.append(Block(labels, main, text, range(len(tokens), len(tokens) + text.count(" ") + 1), article, places[-1] if places else ()))
                tokens.extend((path, w) for w in text.split(" "))

    def state() -> None:
        nonlocal path, frame, main, article
        path = "/".join(s[1] for s in stack if s[1])
        frame, main, article = stack[-1][2:] if stack else (False, False, 0)
        del places[len(stack) :]

    at, size = 0, len(html)
    while at < size:
        m = MARKUP.search(html, at)
        if m is None:
            if not frame:
                parts.append(html[at:])
            break
        if m.start() > at and not frame:
            parts.append(html[at : m.start()])
        at = m.end()
        tag = m[0]
        if tag.startswith("<![CDATA["):
            if not frame:
                parts.append(tag[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if tag[1] in "!?":
            continue
        name = NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if name in BLOCK:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    state()
                    break
                if stack[i][0] in ("article", "main", "body", "td", "th") and name not in BLOCK:
                    break
            tokens.append((path, f"</{name}>"))
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            if not tag.endswith("/>"):
                at = end.end() if end else size
            parts.append(" ")
            continue
        if name in BLOCK:
            close()
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item the item before
                if stack[i][0] == "p" or (name == stack[i][0] and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    del stack[i:]
                    state()
                    break
                if stack[i][0] in BLOCK:
                    break
        attributes = _attributes(tag, name) if len(tag) > len(name) + 2 else {}
        label = name if name in BLOCK else ""
        if label and attributes.get("class"):
            label += "." + attributes["class"].split()[0] if attributes["class"].split() else ""
        tokens.append((path, f"<{label or name}>"))
        if name == "br":
            parts.append(" ")
        if name in VOID or tag.endswith("/>"):
            continue
        becomes_main = main or name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
        is_article = name == "article" or attributes.get("role", "").lower() == "article"
        hides = frame or _is_frame(name, attributes, main) or (is_article and article > 0)
        if hides and not frame:
            close()
        articles += is_article and not hides
        place = places[-1] if places else ()
        if label:
            beside[place, label] += 1
            place = (*place, (label, beside[place, label]))
            elements.append(place)
        places.append(place)
        stack.append((name, label, hides, becomes_main, articles if is_article and not hides else article))
        regions += becomes_main and not main and not hides
        state()
    close()
    return Page(tokens, blocks, regions, elements)


def _runs_in_order(places: dict[tuple[str, str], list[np.ndarray]], keys: list) -> list:
    """The keys of a class that keep one order on all pages, in that order.

    Every occurrence of a key must fall between the same neighbours: sorted by
    first occurrence, the n-th occurrences of all keys come before the n+1-th.
    """
    pages = range(len(places[keys[0]]))
    some = next(p for p in pages if len(places[keys[0]][p]))
    keys = sorted(keys, key=lambda k: int(places[k][some][0]))
    kept = [keys[0]]
    for key in keys[1:]:
        last, first = kept[-1], kept[0]
        good = all((places[key][p] > places[last][p]).all() and (places[first][p][1:] > places[key][p][:-1]).all() for p in pages)
        if good:
            kept.append(key)
    return kept


def template(pages: list[Page]) -> set[tuple[str, str]]:
    """The tokens of the valid, nested equivalence classes of a group of distinct pages."""
    least = max(3, int(np.ceil(SUPPORT * len(pages))))
    if len(pages) < 3:
        return set()
    vectors: dict[tuple[str, str], list[int]] = {}
    for i, page in enumerate(pages):
        for token, n in Counter(page.tokens).items():
            vectors.setdefault(token, [0] * len(pages))[i] = n
    classes: dict[tuple[int, ...], list] = defaultdict(list)
    for token, vector in vectors.items():
        if len(pages) - vector.count(0) >= least:
            classes[tuple(vector)].append(token)
    wanted = {t for keys in classes.values() for t in keys}
    places = {t: [np.zeros(0, np.int64)] * len(pages) for t in wanted}
    for i, page in enumerate(pages):
        own: dict[tuple[str, str], list[int]] = defaultdict(list)
        for at, token in enumerate(page.tokens):
            if token in wanted:
                own[token].append(at)
        for token, found in own.items():
            places[token][i] = np.array(found)
    # Larger support first: the outer frame is settled before what nests in it.
    ordered = sorted(classes.items(), key=lambda c: (-sum(1 for n in c[0] if n), -sum(c[0] and [1 for n in c[0] if n == 1]), c[0]))
    out: set[tuple[str, str]] = set()
    spans: list[list[np.ndarray]] = []  # of each class and page a row of places for each repetition
    for _, keys in ordered:
        kept = _runs_in_order(places, keys)
        if len(kept) == 1:  # a single token can't straddle
            out.update(kept)
            continue
        mine = [np.stack([places[k][p] for k in kept], 1) for p in range(len(pages))]
        if all(_nested(mine, other) for other in spans):
            out.update(kept)
            spans.append(mine)
    return out


def _nested(inner: list[np.ndarray], outer: list[np.ndarray]) -> bool:
    """Whether on every page each repetition of a class lies in one gap of the other, or has its repetitions whole in its own gaps."""
    for a, b in zip(inner, outer, strict=True):
        if not len(a) or not len(b):
            continue
        flat, n = b.ravel(), b.shape[1]
        low, high = np.searchsorted(flat, a[:, 0]), np.searchsorted(flat, a[:, -1])
        for row in np.flatnonzero(low < high):
            if low[row] % n or high[row] % n:
                return False
            gaps = np.searchsorted(a[row], flat[low[row] : high[row]]).reshape(-1, n)
            if (gaps != gaps[:, :1]).any():
                return False
    return True


def fixed_places(pages: list[Page]) -> Callable[[tuple[tuple[str, int], ...]], tuple]:
    """A function from an element's place to its role over the group's distinct pages.

    Elements of a kind that all pages with any have equally often beside each other
    (their occurrence vector is constant) have a role each, by their number; others
    of a kind share one.
    """
    roles: dict[tuple, tuple] = {(): ()}
    by_depth: dict[int, list] = defaultdict(list)
    for page in pages:
        for place in page.elements:
            by_depth[len(place)].append((id(page), place))
    for depth in sorted(by_depth):
        times: dict[tuple, dict] = defaultdict(Counter)  # parent's role and kind: how often under each parent
        for page, place in by_depth[depth]:
            times[roles[place[:-1]], place[-1][0]][page, place[:-1]] += 1
        fixed = {key for key, n in times.items() if len(pages) >= 3 and len(set(n.values())) == 1}
        for _, place in by_depth[depth]:
            parent, (label, number) = roles[place[:-1]], place[-1]
            roles[place] = (*parent, (label, number if (parent, label) in fixed else 0))
    return lambda place: roles[place]


def _container(blocks: list[tuple[tuple, int]]) -> tuple:
    """The deepest role under which most of the text lies."""
    total = sum(n for _, n in blocks)
    under: Counter = Counter()
    for path, n in blocks:
        for depth in range(len(path) + 1):
            under[path[:depth]] += n
    good = [p for p, n in under.items() if n >= MOST * total and (not p or p[-1][0].split(".")[0] not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", ""))]
    return max(good, key=lambda p: (len(p), p)) if good else ()


def extract(htmls: list[str | None]) -> list[tuple[str, int]]:
    """(main text, number of the page's template tokens) of each page of one group.

    Words that stay as data of an article region aren't counted as template.
    """
    pages = [parse(h or "") for h in htmls]
    distinct = list({h or "": p for h, p in zip(htmls, pages, strict=True)}.values())
    frame = template(distinct)
    framed = [[all(p.tokens[w] in frame for w in b.words) for b in p.blocks] for p in pages]
    data = {b.path for p, own in zip(pages, framed, strict=True) for b, whole in zip(p.blocks, own, strict=True) if b.main and not whole}
    parts = []
    for page, own in zip(pages, framed, strict=True):
        slots = [b for b, whole in zip(page.blocks, own, strict=True) if not whole or (b.main and b.path in data)]
        inside, outside = [b for b in slots if b.main], [b for b in slots if not b.main]
        region = _leading(inside or [b for b in page.blocks if b.main])
        by_tag = page.regions > 0 and _size(region) >= _size(outside)
        n_template = sum(1 for t in page.tokens if t in frame) - sum(1 for b in inside for w in b.words if page.tokens[w] in frame)
        parts.append((by_tag, region if by_tag else slots, n_template))
    role = fixed_places(distinct)
    loose = [(role(b.place), len(b.text)) for by_tag, own, _ in parts if not by_tag for b in own]
    container = _container(loose) if loose else ()
    out = []
    for page, (by_tag, own, n_template) in zip(pages, parts, strict=True):
        chosen = own
        if not by_tag:
            chosen = [b for b in own if role(b.place)[: len(container)] == container or (b.main and page.regions == 1)] or own
        out.append(("\n\n".join(b.text for b in chosen), n_template))
    return out


def _leading(region: list[Block]) -> list[Block]:
    """The blocks without the articles beside one that holds most of the articles' text."""
    sizes = Counter()
    for b in region:
        if b.article:
            sizes[b.article] += len(b.text)
    if len(sizes) < 2:
        return region
    largest, size = max(sizes.items(), key=lambda x: (x[1], -x[0]))
    return [b for b in region if b.article in (0, largest)] if size >= MOST * sum(sizes.values()) else region


def _size(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def main_text(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars, n_template`` of every page."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("host", host)
    large = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_pages)
    large = large.select(F.col("host").alias("large"), F.ceil(F.col("n") / group_pages).alias("groups"))
    if large.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS:
        large = F.broadcast(large)
    # All of a row is hashed: repeated ids and null urls are dealt out too.
    place = F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("groups", F.lit(1)))
    dealt = rows.join(large, rows.host == F.col("large"), "left").withColumn("part", place)
    dealt = dealt.select("host", "part", "page_id", "url", "html").repartition("host", "part").sortWithinPartitions("host", "part", "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # of the running group: [page, url, html, times]

        def answer() -> Iterator[pa.RecordBatch]:
            found = extract([h[2] for h in held])
            for (page, url, _, times), (text, n) in zip(held, found, strict=True):
                for left in range(times, 0, -REPEATED):
                    k = min(left, REPEATED)
                    columns = ([page] * k, pa.int64()), ([url] * k, pa.string()), ([text] * k, pa.string()), ([len(text)] * k, pa.int64()), ([n] * k, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], names=["page_id", "url", "text", "n_chars", "n_template"])

        for batch in batches:
            for host, part, page, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, part) != key:
                    if held:
                        yield from answer()
                    key, held = (host, part), []
                if held and held[-1][:3] == [page, url, text]:
                    held[-1][3] += 1
                else:
                    held.append([page, url, text, 1])
        if held:
            yield from answer()

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long")
