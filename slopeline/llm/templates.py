"""Main text of web pages by equivalence classes of template tokens.

Tokens are tags and text strings, told apart by the chain of open elements around them. The
occurrence vector of a token over the pages of a host says how often each page has it; tokens with
equal vectors form an equivalence class. Vectors are never built: each page adds one hash of
itself and the count to an exclusive-or, so a host with a third of all pages is summed on the map
side, and equal sums mean equal vectors.

Pages of a host are grouped by layout (the elements down to LAYOUT_DEPTH), so that each of several
layouts has its template, if LAYOUT_SHARE of the host's pages have it; a page of a rarer one is its own
layout. Strings are compared over the whole host. Containers of one name under one element take
different roles by their place among each other. The tokens that nearly all pages of a layout (SUPPORT) have exactly once form its root class; empty pages do not
count and copies of a page count as one. A class is valid if its tokens stand in the same order, which
a second pass checks; tokens that break the order leave it. The rest, in order, is the
template; other classes are nested in the slot between the two root tokens around them.

Slots are judged by their text over all pages of the layout. Text of a nested class (a block element
whose number differs from page to page, such as an item or a comment) or in a paragraph or heading is
prose; a bare string in an element of the template is not. The article is the innermost root element that holds MAIN_SHARE of the
running text and has no prose, nor any text of an element around it, outside; an ``article`` or ``main``
element with that share, or with no such text outside, goes first. Where a page has such text outside, the page takes the next
element around that has none. Its slots, without boilerplate elements and without blocks that consist of
template strings, are the text.

The tag and class lists are hints beside the template: listed tags are never content, and an element
with a listed class goes if the template repeats it or it holds little of the page's text.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import of_worker, text_batches, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select option button".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption li dd dt".split())
#: An opening tag ends open ones of these names, up to the given limits.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
        "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",))}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog head".split()) | RAW
BOILERPLATE_WORDS = frozenset(("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
                               "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription comment comments commentlist respond reply replies disqus "
                               "related recommended share sharing social footer widget login signup search pagination pager skip toolbar").split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the running text of a layout's pages that the article's element holds at least.
MAIN_SHARE = 0.8
#: Support of the classes: share of a layout's pages that have a root token once, share that have a token of
#: any class, and distinct pages that a template string needs at least.
SUPPORT, FREQUENT, LEAST = 0.8, 0.5, 3
#: An element with a listed class or id that the template does not repeat is boilerplate up to this share of the
#: page's running text.
LITTLE_SHARE = 0.1
#: Elements down to this depth tell layouts apart; a layout has a template from this share of the host's pages
#: (so a host has at most its inverse of them), and from two pages.
LAYOUT_DEPTH, LAYOUT_SHARE = 3, 0.01
#: A block element is steady in a layout if the variance of its number on a page is at most this.
STEADY = 0.1
#: Sums of weights are compared up to this.
ROUNDING = 1e-6

_PLAIN = re.compile(r"[^>\"']*")
#: Tags that a worker keeps worked out.
MOST_TAGS = 10_000
#: A tag whose quotation marks are closed; it ends where ``tag_at`` ends it.
_PLAIN_TAG = re.compile(r"""</[a-zA-Z][^>"'<]*+>|<[a-zA-Z][^>"'<]*+(?:(?:"[^"]*+"|'[^']*+')[^>"'<]*+)*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_MASK = (1 << 64) - 1

TOKENS = "host string, layout long, token long, kind int, uses long, mark long, position double, mass long, depth int, flag int, squares long, n_rows long, n_pages double, n_once double"
CHECKS = "host string, layout long, token long, broken double, seen double, stray double, inside long, total long"


class Event:
    """Kinds of what ``scan`` yields."""

    OPEN, CLOSE, TEXT, BREAK = range(4)


#: The kind of a token that counts a block element whatever its place among its like.
COUNT = 4
ITEMS = frozenset("li dd dt tr td th thead tbody tfoot option".split())


def _listed(name: str, attributes: str) -> bool:
    """Whether a class, id or role names boilerplate: a hint that ``flagged`` weighs."""
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        words = {w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value))}
        if words & (BOILERPLATE_ROLES if key.lower() == "role" else BOILERPLATE_WORDS) and name not in ("body", "html", "article", "main"):
            return True
    return False


def _label(name: str, attributes: str, listed: bool) -> str:
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    return name + "".join(f"{mark}{found[k]}" for k, mark in (("class", "."), ("role", "@"), ("id", "#")) if k in found and (k != "id" or listed))


def tag_at(page: str, begin: int, dead: set) -> tuple[int, str] | None:
    """End and text of the tag that begins with the ``<`` at ``begin``, for any but the plainest ones; an empty
    text where no tag begins there, a text of ``!`` for comments and the like, None where nothing more ends.
    An unclosed comment lasts to the end; a tag with an unclosed quotation mark ends at the next ``>``. ``dead``
    are the marks known not to occur again, so that all calls together take linear time."""
    mark = page[begin + 1 : begin + 2]
    if page.startswith("<!--", begin):
        end = page.find("-->", begin + 4)
        return (len(page) if end < 0 else end + 3), "!"
    if page.startswith("<![CDATA[", begin) and (end := page.find("]]>", begin)) >= 0:
        return end + 3, "!"
    closing = mark == "/" and page[begin + 2 : begin + 3].isascii() and page[begin + 2 : begin + 3].isalpha()
    if closing or mark and mark in "!?":
        end = page.find(">", begin + 1) + 1
        return (end, page[begin:end] if closing else "!") if end else None
    if not (mark.isascii() and mark.isalpha()):
        return begin + 1, ""
    end = begin + 1
    while True:
        end = _PLAIN.match(page, end).end()
        if end >= len(page):
            return None
        quote = page[end]
        if quote == ">":
            return end + 1, page[begin : end + 1]
        other = -1 if quote in dead else page.find(quote, end + 1)
        if other < 0:
            dead.add(quote)
            end = page.find(">", end) + 1
            return (end, page[begin:end]) if end else None
        end = other + 1


class _Tag:
    """What a tag's text says."""

    __slots__ = ("name", "closing", "void", "closes_p", "ends", "listed", "label", "block", "placed", "heading", "bad", "header", "link", "bare", "raw")

    def __init__(self, text: str):
        self.closing = text[1] == "/"
        name = _NAME.match(text, 1 + self.closing)[0]
        attributes, self.name = text[1 + self.closing + len(name) : -1], name.lower()
        name = self.name
        self.void, self.closes_p, self.ends = name in VOID, name in CLOSES_P, ENDS.get(name)
        self.listed = not self.closing and _listed(name, attributes)
        self.label = 0 if self.closing else xxhash.xxh64_intdigest(_label(name, attributes, self.listed))
        self.block, self.heading = name in BLOCK, name in HEADINGS
        self.placed = self.block and name not in PROSE and name not in ITEMS
        self.bad, self.header, self.link = name in BOILERPLATE_TAGS, name == "header", name == "a"
        self.bare = attributes.endswith("/") and name in ("svg", "math", "path")
        self.raw = name in ("script", "style", "textarea", "title", "noscript", "template", "iframe")


def chained(path: int, label: int) -> int:
    path = ((path ^ label) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK
    return path ^ path >> 29


def tag_of(text: str, known: dict) -> _Tag:
    """The tag of a text; those without a class, id or role are one a name."""
    low = text.lower()
    if text[1] != "/" and ("class" in low or "id" in low or "role" in low or not text.isascii()) and _ATTRIBUTE.search(text):
        key = text
    else:
        key = _NAME.match(text, 1 + (text[1] == "/"))[0]
        key = f"</{key}>" if text[1] == "/" else f"<{key}/>" if text.endswith("/>") else f"<{key}>"
    if key not in known:
        if len(known) > MOST_TAGS:
            known.clear()
        known[key] = _Tag(key)
    return known[key]


class _Open:
    """The open elements: (name, path, boilerplate, link, block, heading, path without places, the block's
    path without places), and the places of each name."""

    ROOT = ("", 0, False, False, 0, False, 0, 0)

    def __init__(self):
        self.stack: list[tuple] = []
        self.places: dict[str, list[int]] = {}

    def last(self, names) -> int:
        place = -1
        for n in names:
            found = self.places.get(n)
            if found and found[-1] > place:
                place = found[-1]
        return place

    def push(self, entry: tuple) -> None:
        self.places.setdefault(entry[0], []).append(len(self.stack))
        self.stack.append(entry)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()

    def end(self, names, limits) -> None:
        """Close the last open element of ``names`` unless one of ``limits`` lies inside it."""
        place = self.last(names)
        if place >= 0 and place > self.last(limits):
            self.cut(place)


P_ENDS = ("div", "article", "section", "td", "th", "li", "body", "main", "blockquote")


def scan(page: str) -> list[tuple]:
    """(kind, tag name or raw text, path, depth, within a boilerplate tag, within a link, opens an element with a listed
    class, path of the innermost block, within a heading, text with single spaces, that block's path without places)
    in order.

    A path is a hash of the chain of labels, so its size does not grow with the depth; a container's
    label has its place among its like under one element. Elements left
    open are closed as browsers do it: a block ends an open paragraph, an item an open item; a closing
    tag ends what is open inside it, and one without an opening is skipped. Takes linear time."""
    open_now, met, dead = _Open(), {}, set()
    out: list[tuple] = []
    add = out.append
    known = of_worker("tags", dict)
    stack, places = open_now.stack, open_now.places
    find, plain_tag, size = page.find, _PLAIN_TAG.match, len(page)
    at = look = 0  # where the next text begins, and where a tag may
    while True:
        begin = find("<", look)
        if begin >= 0:
            simple = plain_tag(page, begin)
            end, text = (simple.end(), simple[0]) if simple else tag_at(page, begin, dead) or (-1, "")
            if end >= 0 and not text:
                look = end
                continue
        if begin < 0 or end < 0:
            begin = size
        if begin > at:
            _, path, bad, link, block, heading, _, count = stack[-1] if stack else _Open.ROOT
            raw = page[at:begin]
            add((Event.TEXT, raw, path, len(stack), bad, link, False, block, heading, " ".join(raw.split()), count))
        if begin == size:
            return out
        at = look = end
        if text == "!":
            continue
        tag = known.get(text)
        if tag is None:
            tag = tag_of(text, known)
        name = tag.name
        if tag.closing:
            found = places.get(name)
            if found:
                place = found[-1]
                _, path, bad, link, block, heading, _, count = stack[place]
                open_now.cut(place)
                add((Event.CLOSE, name, path, place + 1, bad, link, False, block, heading, "", count))
            elif name == "p":
                _, path, bad, _, block, heading, _, count = stack[-1] if stack else _Open.ROOT
                add((Event.BREAK, "hr", path, len(stack), bad, False, False, block, heading, "", count))
            continue
        if tag.closes_p and places.get("p"):
            open_now.end(("p",), P_ENDS)
        if tag.ends:
            open_now.end(*tag.ends)
        _, above, bad, link, block, heading, plain, count = stack[-1] if stack else _Open.ROOT
        depth = len(stack)
        if tag.void:
            add((Event.BREAK, name, above, depth, bad, link, False, block, heading, "", count))
            continue
        path = chained(above, tag.label)
        plain = path if plain == above else chained(plain, tag.label)
        if tag.placed:
            place = met[path] = met.get(path, -1) + 1
            path = chained(path, place) if place else path
        bad = bad or tag.bad or tag.header and open_now.last(("article", "main")) < 0
        link, heading = link or tag.link, heading or tag.heading
        if tag.block:
            block, count = path, plain
        add((Event.OPEN, name, path, depth + 1, bad, link, tag.listed, block, heading, "", count))
        if tag.bare:
            continue
        if tag.raw:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = look = stop.end() if stop else size
            add((Event.CLOSE, name, path, depth + 1, bad, link, False, block, heading, "", count))
            continue
        open_now.push((name, path, bad, link, block, heading, plain, count))


def element_token(kind: int, path: int) -> int:
    return (((path + kind) * 0xD6E8FEB86659FD93 + kind) & _MASK) - (1 << 63)


def event_token(event: tuple) -> int:
    if event[0] == Event.TEXT:  # a string by its block, whichever of its like that is
        return xxhash.xxh64_intdigest(event[9], event[10]) - (1 << 63)
    return element_token(event[0], event[2])


def spans(events: list[tuple]) -> tuple[dict[int, int], dict[int, int]]:
    """By opening event: the event after the element's last one, and the opening event around it (-1 for none)."""
    ends, around, open_now = {}, {}, []
    for k, e in enumerate(events):
        least = e[3] if e[0] in (Event.OPEN, Event.CLOSE) else e[3] + 1
        while open_now and events[open_now[-1]][3] >= least:
            ends[open_now.pop()] = k
        if e[0] == Event.OPEN:
            around[k] = open_now[-1] if open_now else -1
            open_now.append(k)
    return ends | {k: len(events) for k in open_now}, around


def is_running(e: tuple, fixed=frozenset()) -> bool:
    """Running text: no boilerplate, no template string, no link but in a heading."""
    return e[0] == Event.TEXT and bool(e[9]) and not e[4] and (not e[5] or e[8]) and not (fixed and event_token(e) in fixed)


def running(events: list[tuple], fixed=frozenset()) -> list[int]:
    """Running text before each event and in all."""
    sums = [0]
    total = 0
    for e in events:
        if e[0] == Event.TEXT and is_running(e, fixed):
            total += len(e[9])
        sums.append(total)
    return sums


class Stray:
    """Running text that must not stay outside the article: prose, and text of an element around it.
    ``steady`` are the block elements of the template (None: all, for a page by itself)."""

    def __init__(self, events: list[tuple], ends: dict, around: dict, fixed, steady):
        self.ends, self.around = ends, around
        prose = {e[2] for e in events if e[0] == Event.OPEN and e[1] in PROSE}
        self.sums, self.bare = [0], {}
        total = 0
        for e in events:
            if e[0] == Event.TEXT and is_running(e, fixed):
                if e[7] in prose or e[7] and steady is not None and element_token(COUNT, e[10]) not in steady:
                    total += len(e[9])
                else:
                    self.bare[e[7]] = self.bare.get(e[7], 0) + len(e[9])
            self.sums.append(total)
        #: Bare text of the elements around each one (a path is met once around it, if it is a root token).
        self.above: dict[int, int] = {}
        for k, up in around.items():  # in order
            self.above[k] = self.above[up] + self.bare.get(events[up][2], 0) if up >= 0 else self.bare.get(0, 0)

    def outside(self, k: int) -> int:
        return self.sums[-1] - self.sums[self.ends[k]] + self.sums[k] + self.above[k]


def flagged(page: str, repeated=frozenset()) -> tuple[list[tuple], dict[int, int], dict[int, int]]:
    """The events of ``scan`` and their ``spans``, where elements with a listed class are boilerplate as well if the host's
    template repeats them or they hold little of the page's text (LITTLE_SHARE). One around an ``article`` or ``main``
    never is, nor one with most of the running text: of the host's, for those in the template, or of the page's."""
    events = scan(page)
    ends, around = spans(events)
    listed = [k for k, e in enumerate(events) if e[6] and not e[4]]
    if not listed:
        return events, ends, around
    sums = running(events)
    articles = [k for k, e in enumerate(events) if e[0] == Event.OPEN and e[1] in ("article", "main") and not e[4]]
    done = 0
    for k in listed:
        inside = bisect_right(articles, k)
        holds = inside < len(articles) and articles[inside] < ends[k]
        if k >= done and not holds and (event_token(events[k]) in repeated or (sums[ends[k]] - sums[k]) <= LITTLE_SHARE * sums[-1]):
            done = ends[k]
            events[k:done] = [(*e[:4], True, *e[5:]) for e in events[k:done]]
    return events, ends, around


def layout_of(events: list[tuple]) -> int:
    """What tells layouts apart: the elements down to ``LAYOUT_DEPTH``."""
    top = sorted({e[2] for e in events if e[0] == Event.OPEN and e[3] <= LAYOUT_DEPTH})
    return xxhash.xxh64_intdigest(np.array(top, np.uint64).tobytes()) - (1 << 63) | 1


def page_tokens(page: str) -> tuple[int, dict[int, list]]:
    """The page's layout, and by token: kind, uses, position of the first use, running text inside (open
    tags), depth, and flags of open tags (1: a listed class, 2: article or main). Token 0 is the page itself;
    tokens of the kind COUNT are block elements whatever their places."""
    events = scan(page)
    (ends, _), sums = spans(events), running(events)
    out: dict[int, list] = {0: [-1, 1, 0, sums[-1], 0, 0]}
    for n, e in enumerate(events):
        if e[0] == Event.BREAK or e[0] == Event.TEXT and not e[9]:
            continue
        t = event_token(e)
        mass = sums[ends[n]] - sums[n] if e[0] == Event.OPEN else 0
        if e[0] == Event.OPEN and e[1] in BLOCK:
            out.setdefault(element_token(COUNT, e[10]), [COUNT, 0, n, 0, e[3], 0])[1] += 1
        if t in out:
            out[t][1] += 1
            out[t][3] += mass
        else:
            out[t] = [e[0], 1, n, mass, e[3], 0 if e[0] != Event.OPEN else e[6] + 2 * (e[1] in ("article", "main"))]
    return layout_of(events), out


def hosts(url) -> "F.Column":
    """The lower-cased host of a URL; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(hosts(F.col("url").cast("string")).alias("host"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))


def distinct_pages(rows: DataFrame) -> DataFrame:
    """The rows with text and their weight: copies of a page within a host share a weight of one."""
    keyed = rows.filter(F.col("html").rlike(r"\S")).withColumn("copy", F.xxhash64("host", "html"))
    copies = written(keyed.groupBy("copy").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")
    return keyed.join(copies, "copy", "left").select("host", "page_id", "html", (1 / F.coalesce("n", F.lit(1))).alias("weight"))


def token_classes(pages: DataFrame) -> DataFrame:
    """One row per host, layout and frequent token (on half of the pages or more): its class (the
    fingerprint of its occurrence vector), pages, uses, mean position and running text. Layout 0 is the
    whole host, for its strings and opening tags, however frequent."""

    def run(batches):
        for b in batches:
            rows: dict[tuple[str, int], dict[int, list]] = {}
            for host, page_id, page, weight in zip(*(b.column(c).to_pylist() for c in ("host", "page_id", "html", "weight"))):
                own = xxhash.xxh64_intdigest(f"{page_id}\0{page}")
                layout, tokens = page_tokens(page)
                of_layout, marks = rows.setdefault((host, layout), {}), {}
                for t, (kind, uses, position, mass, depth, flag) in tokens.items():
                    mark = marks.get(uses)
                    if mark is None:
                        mark = marks[uses] = xxhash.xxh64_intdigest(f"{own} {uses}")
                    have = of_layout.get(t)
                    if have is None:
                        of_layout[t] = [kind, uses, mark, position, mass, depth, flag, uses * uses, 1, weight, weight if uses == 1 else 0.0]
                    else:
                        have[1] += uses
                        have[2] ^= mark
                        have[3] += position
                        have[4] += mass
                        have[6] |= flag
                        have[7] += uses * uses
                        have[8] += 1
                        have[9] += weight
                        if uses == 1:
                            have[10] += weight
            for (host, _), of_layout in list(rows.items()):
                of_host = rows.setdefault((host, 0), {})
                for t, one in of_layout.items():
                    if one[0] == Event.CLOSE:
                        continue
                    have = of_host.get(t)
                    of_host[t] = one if have is None else [*have[:1], have[1] + one[1], have[2] ^ one[2], have[3] + one[3], have[4] + one[4], have[5], have[6] | one[6], *(x + y for x, y in zip(have[7:], one[7:]))]
            keys, values = [(*k, t) for k, some in rows.items() for t in some], [v for some in rows.values() for v in some.values()]
            kind, uses, mark, position, mass, depth, flag, squares, n_rows, n_pages, n_once = zip(*values) if values else [()] * 11
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()), pa.array(kind, pa.int32()), pa.array(uses, pa.int64()),
                 pa.array(np.array(mark, np.uint64).view(np.int64)), pa.array([float(v) for v in position], pa.float64()), pa.array(mass, pa.int64()), pa.array(depth, pa.int32()),
                 pa.array(flag, pa.int32()), pa.array(squares, pa.int64()), pa.array(n_rows, pa.int64()), pa.array(n_pages, pa.float64()), pa.array(n_once, pa.float64())],
                names=[c.split()[0] for c in TOKENS.split(", ")])

    counted = (pages if "weight" in pages.columns else distinct_pages(pages)).mapInArrow(run, TOKENS)
    tokens = written(counted.groupBy("host", "layout", "token").agg(
        F.min("kind").alias("kind"), F.sum("uses").alias("uses"), F.bit_xor("mark").alias("class"), F.sum("n_rows").alias("n_rows"), (F.sum("position") / F.sum("n_rows")).alias("position"), F.sum("mass").alias("mass"),
        F.min("depth").alias("depth"), F.bit_or("flag").alias("flag"), F.sum("squares").alias("squares"), F.sum("n_pages").alias("n_pages"), F.sum("n_once").alias("n_once")), "tokens")
    sizes = tokens.filter("kind = -1").select("host", "layout", F.round("n_pages").cast("long").alias("host_pages"), F.col("mass").alias("host_mass"))
    whole = sizes.filter("layout = 0").select("host", F.col("host_pages").alias("all_pages"))
    usual = (F.col("layout") == 0) | (F.col("host_pages") >= F.greatest(F.lit(2), LAYOUT_SHARE * F.col("all_pages")))
    sizes = sizes.join(whole, "host").filter(usual).drop("all_pages")
    # Over a whole host only what at least two pages share can be template.
    enough = F.when(F.col("layout") == 0, F.col("n_rows") > 1).otherwise(F.col("n_pages") + ROUNDING >= FREQUENT * F.col("host_pages"))
    return tokens.filter("kind >= 0").join(sizes, ["host", "layout"]).filter(enough)


def _in_order(places: list[int]) -> list[bool]:
    """Which entries belong to one longest rising subsequence."""
    import bisect

    tails, index, before = [], [], [-1] * len(places)
    for k, p in enumerate(places):
        at = bisect.bisect_left(tails, p)
        before[k] = index[at - 1] if at else -1
        if at == len(tails):
            tails.append(p)
            index.append(k)
        else:
            tails[at], index[at] = p, k
    keep, k = [False] * len(places), index[-1] if index else -1
    while k >= 0:
        keep[k] = True
        k = before[k]
    return keep


def of_hosts(batch: pa.RecordBatch, names: list[str], layouts: str, make) -> dict[str, tuple[dict, frozenset, frozenset]]:
    """By host, from its first row in the batch: its layouts, template strings and repeated elements."""
    out = {}
    for k, host in enumerate(names):
        if host not in out:
            found, fixed, repeated = (batch.column(c)[k].as_py() for c in (layouts, "fixed", "repeated"))
            out[host] = {r["layout"]: make(r) for r in found or ()}, frozenset(fixed or ()), frozenset(repeated or ())
    return out


def deduce_templates(pages: DataFrame) -> DataFrame:
    """One row per host and layout (those that LAYOUT_SHARE of the host's pages have): host_pages (distinct, not
    empty, of the layout), ``root`` (the template's tokens in order), ``steady`` (its block elements), ``main`` (the token of the element that holds the article, null if no root element does),
    ``nested`` (other classes of two or more tokens: the slot they lie in and their size), ``fixed``
    (the host's template strings: on nearly all pages of the host or of a layout, or in a nested class with an
    element) and ``repeated`` (elements with a listed class that are frequent and hold less than half of the text)."""
    pages = distinct_pages(pages)
    classes = written(token_classes(pages), "classes")
    group = ["host", "layout"]
    counts = classes.filter((F.col("kind") == COUNT) & (F.col("layout") != 0))
    varies = F.col("squares") / F.col("n_rows") - F.pow(F.col("uses") / F.col("n_rows"), 2)
    steady = counts.filter(varies <= STEADY).groupBy(*group).agg(F.collect_list("token").alias("steady"))
    own, of_host = classes.filter(f"layout <> 0 and kind <> {COUNT}"), classes.filter("layout = 0")
    # Text strings tell template from content only where there are distinct pages to compare.
    enough = F.col("n_pages") + ROUNDING >= LEAST
    whole = (F.col("n_once") + ROUNDING >= SUPPORT * F.col("host_pages")) & ((F.col("kind") != Event.TEXT) | (F.col("n_rows") >= LEAST))
    groups = own.filter(~whole).groupBy(*group, "class", "uses").agg(F.count(F.lit(1)).alias("size"), F.avg("position").alias("position")).filter("size > 1")
    strings = classes.filter((F.col("kind") == Event.TEXT) & enough & (F.col("n_pages") + ROUNDING >= SUPPORT * F.col("host_pages"))).select("host", "token")
    # A string that occurs on just the pages, and as often, as an element around a slot: a nested class.
    boxes = of_host.filter(F.col("kind").isin(Event.OPEN, COUNT)).select("host", "class", "uses").distinct()
    inner = of_host.filter((F.col("kind") == Event.TEXT) & enough & (F.col("n_pages") + ROUNDING >= FREQUENT * F.col("host_pages"))).join(boxes, ["host", "class", "uses"], "left_semi").select("host", "token")
    fixed = strings.union(inner).groupBy("host").agg(F.collect_set("token").alias("fixed"))
    repeated = (classes.filter((F.col("flag").bitwiseAND(1) == 1) & enough & (2 * F.col("mass") < F.col("host_mass")) & (F.col("n_pages") + ROUNDING >= FREQUENT * F.col("host_pages")))
                .groupBy("host").agg(F.collect_set("token").alias("repeated")))
    roots = own.filter(whole).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("position", "token"))).alias("root")).select(*group, F.col("root.token").alias("root"))
    known = written(roots.join(steady, group, "left").join(fixed, "host", "left").join(repeated, "host", "left"), "known")
    by_host = known.groupBy("host").agg(F.collect_list(F.struct("layout", "root", "steady")).alias("roots"), F.first("fixed").alias("fixed"), F.first("repeated").alias("repeated"))

    def check(batches):
        for b in batches:
            out: dict[tuple[str, int, int], list] = {}
            hosts_of = b.column("host").to_pylist()
            templates = of_hosts(b, hosts_of, "roots", lambda r: (r["root"], frozenset(r["steady"] or ())))
            for host, page, weight in zip(hosts_of, *(b.column(c).to_pylist() for c in ("html", "weight"))):
                layouts, fixed, elements = templates[host]
                events, ends, around = flagged(page, elements)
                layout = layout_of(events)
                if layout not in layouts:
                    continue
                root, steady_ones = layouts[layout]
                sums, stray = running(events, fixed), Stray(events, ends, around, fixed, steady_ones)
                places: dict[int, int] = {}
                for k, e in enumerate(events):
                    if e[0] != Event.BREAK:
                        t = event_token(e)
                        places[t] = -1 if t in places else k
                once = [t for t in root if places.get(t, -1) >= 0]
                for t, fine in zip(once, _in_order([places[t] for t in once])):
                    k = places[t]
                    opens = events[k][0] == Event.OPEN and sums[-1] > 0
                    if fine and not opens:
                        continue
                    mass = sums[ends[k]] - sums[k] if opens else 0
                    have = out.setdefault((host, layout, t), [0.0, 0.0, 0.0, 0, 0])
                    have[0] += 0.0 if fine else weight
                    if opens:
                        have[1] += weight
                        have[2] += weight if stray.outside(k) else 0.0
                        have[3] += mass
                        have[4] += sums[-1]
            columns = list(zip(*out.values())) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), *(pa.array([k[j] for k in out], pa.int64()) for j in (1, 2)), *(pa.array(c, pa.float64()) for c in columns[:3]),
                                              *(pa.array(c, pa.int64()) for c in columns[3:])], names=[c.split()[0] for c in CHECKS.split(", ")])

    checks = (pages.join(by_host, "host").select("host", "html", "weight", "roots", "fixed", "repeated").mapInArrow(check, CHECKS)
              .groupBy(*group, "token").agg(*(F.sum(c).alias(c) for c in ("broken", "seen", "stray", "inside", "total"))))
    valid = written(own.filter(whole).join(checks, [*group, "token"], "left").filter(F.coalesce("broken", F.lit(0.0)) <= (1 - SUPPORT) * F.col("host_pages") + ROUNDING), "valid")
    ordered = valid.groupBy(*group).agg(F.max("host_pages").alias("host_pages"), F.sort_array(F.collect_list(F.struct("position", "token"))).alias("root"))
    article_tag = F.col("flag").bitwiseAND(2) == 2
    share, alone = F.col("inside") >= MAIN_SHARE * F.col("total"), F.col("stray") <= (1 - SUPPORT) * F.col("seen") + ROUNDING
    holds = (valid.filter((F.col("total") > 0) & (F.col("inside") > 0) & F.when(article_tag, share | alone).otherwise(share & alone))
             .groupBy(*group).agg(F.max_by("token", F.struct(article_tag, F.when(article_tag, -F.col("depth")).otherwise(F.col("depth")), "token")).alias("main")))
    slots = ordered.select(*group, F.col("root.position").alias("bounds"))
    nested = (groups.join(slots, group)
              .groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.size(F.filter("bounds", lambda p: p < F.col("position"))).alias("slot"), "class", "size", "uses"))).alias("nested")))
    return (ordered.select(*group, "host_pages", F.col("root.token").alias("root")).join(holds, group, "left").join(nested, group, "left")
            .join(known.select(*group, "steady", "fixed", "repeated"), group, "left"))


def main_of(events: list[tuple], ends: dict, stray: Stray, strings) -> list[int]:
    """The article's element by the rule for layouts, from one page."""
    sums, paths = running(events, strings), {}
    for k, e in enumerate(events):
        if e[0] == Event.OPEN:
            paths[e[2]] = paths.get(e[2], 0) + 1
    some = [k for k in sorted(ends) if paths[events[k][2]] == 1 and not events[k][4] and sums[ends[k]] > sums[k]]
    share = {k for k in some if sums[ends[k]] - sums[k] >= MAIN_SHARE * sums[-1]}
    tagged = [k for k in some if events[k][1] in ("article", "main") and (k in share or not stray.outside(k))]
    if tagged:
        return tagged[:1]
    inner = [k for k in share if not stray.outside(k)]
    return [max(inner, key=lambda k: events[k][3])] if inner else []


def article(page: str, templates: dict[int, tuple] | None = None, fixed: list[int] | None = None, repeated: list[int] | None = None) -> str:
    """Text of the slots inside the main element: blocks joined by line feeds, white space within a
    block as one space, character references decoded, boilerplate elements left out, and blocks left
    out that consist of the template's strings alone. ``templates`` gives the main token and the steady
    elements of each layout of the host; a page of another layout is judged by itself.

    If the main element is no ``article`` or ``main`` and the page has prose outside it, or text of an
    element around it, the next element around that has none, or an ``article`` or ``main``, takes its
    place. A page without the main element (or a layout without one) gives its outermost ``article`` and
    ``main`` elements, or else its body."""
    strings = frozenset(fixed or ())
    events, ends, around = flagged(page, frozenset(repeated or ()))
    known = templates.get(layout_of(events)) if templates else None
    stray = Stray(events, ends, around, strings, frozenset(known[1] or ()) if known else None)
    if known:
        mains = [k for k, e in enumerate(events) if e[0] == Event.OPEN and element_token(Event.OPEN, e[2]) == known[0]] if known[0] is not None else []
    else:
        mains = main_of(events, ends, stray, strings)
    regions = []
    if len(mains) == 1:
        k = mains[0]
        while k >= 0 and events[k][1] not in ("article", "main") and stray.outside(k):
            k = around[k]
        regions = [(k, ends[k])] if k >= 0 else [(0, len(events))]
    else:
        for k, e in enumerate(events):
            if e[0] == Event.OPEN and e[1] in ("article", "main") and not e[4] and (not regions or k >= regions[-1][1]):
                regions.append((k, ends[k]))
    blocks, line, own = [], [], False

    def close() -> None:
        nonlocal own
        text = " ".join("".join(line).split())
        if text and own:
            blocks.append(text)
        line.clear()
        own = False

    for start, end in regions or [(0, len(events))]:
        for e in events[start:end]:
            kind, text, bad = e[0], e[1], e[4]
            if kind == Event.TEXT:
                if not bad:
                    line.append(entities.unescape(text))
                    own = own or bool(e[9]) and not (strings and event_token(e) in strings)
            elif kind == Event.BREAK:
                if text == "hr":
                    close()
                else:
                    line.append(" ")
            elif text in BLOCK:
                close()
        close()
    return "\n".join(blocks)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text (empty if none) and n_chars, its code points.

    Null html is an empty page; pages whose URL is null or has no host form one host; a host with
    fewer than LEAST distinct pages has a template of tags alone; repeated rows are extracted alike;
    other columns are not read; an empty table gives an empty result."""
    text_batches(pages.sparkSession)
    rows = _rows(pages)
    found = written(deduce_templates(rows).select("host", "layout", "main", "steady", "fixed", "repeated"), "templates")
    templates = found.groupBy("host").agg(F.collect_list(F.struct("layout", "main", "steady")).alias("layouts"), F.first("fixed").alias("fixed"), F.first("repeated").alias("repeated"))

    def run(batches):
        for b in batches:
            hosts_of = b.column("host").to_pylist()
            known = of_hosts(b, hosts_of, "layouts", lambda r: (r["main"], frozenset(r["steady"] or ())))
            texts = [article(page or "", *known[host]) for host, page in zip(hosts_of, b.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(templates, "host", "left").select("host", "page_id", "url", "html", "layouts", "fixed", "repeated").mapInArrow(run, "page_id long, url string, text string, n_chars long")
