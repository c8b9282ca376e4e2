"""Main text of web pages by wrappers inferred per host.

Pages of one host come from few templates. Every page becomes a stream of block elements and texts; the streams of a
host are aligned one after the other into a regular expression without unions: an element that some pages lack becomes
optional, equal neighbours become a repeated group, texts become slots that are constant or vary. Aligning is
associative, so every task aligns its own pages first and only one wrapper per host and task is shuffled; all pages
take part, and a host of any size is spread. Main text is chosen page by page:

* inside ``article`` and ``main``, where the page has one with text that is not a comment or a teaser;
* else in every slot of the wrapper with few links;
* never in elements whose tag, role, class or id says menu, header, footer, sidebar, notice, advert, form or comments;
  such words do not count on ``html``, ``body`` and elements that hold ``main`` or the page's article;
* outside ``article`` and ``main``, never a slot with the same text on all of three or more different pages (copies count
  as one); where nothing varies on the whole host, no slot counts as constant.

Defined results: a null page or one without main text gives the empty text; pages without a url form one host;
repeated rows are handled one by one; an empty table gives an empty result. White space includes no-break spaces.
"""

from __future__ import annotations

import html as references
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtables.llm.common import col

HOSTS_AT_ONCE = 500
MERGE_GROUPS = 32
SAME_ON = 3
MOST_LINKS = 0.5

# Names of elements.
BLOCKS = frozenset(
    "html body div article section main nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 "
    "blockquote pre figure figcaption address details summary dialog menu center hgroup search".split()
)
RAW = frozenset("script style title textarea noscript template iframe svg math object select button option audio video canvas".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
CLOSES_P = BLOCKS - {"html", "body"}
# Words that name what is not main text, as tags, roles, classes or ids.
OUTSIDE = frozenset(
    "nav footer aside form menu dialog search ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice "
    "notices gdpr popup modal overlay sidebar navbar navigation breadcrumb breadcrumbs share sharing social comment comments disqus respond replies related recommended "
    "newsletter subscribe subscription signup login toolbar pagination pager widget copyright contentinfo complementary alert skip hidden masthead".split()
)
HEADERS = frozenset("header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_token = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/][^>]*\Z""", re.S
)
_named = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_words = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_ends: dict[str, re.Pattern] = {}


def _kind(tag: str, attributes: str) -> str:
    """An element's name in a path: tag and the words of its role, class and id; digits do not count."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag
    found: list[str] = []
    for name, value in _named.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            found.append("hidden")
        elif name in ("class", "id", "role"):
            found.extend(w.lower() for w in _words.findall(value))
    return ".".join([tag, *sorted(set(found))])


def blocks(page: str) -> Iterator[tuple[tuple[tuple[str, int], ...], str, int]]:
    """The texts of a page in order: path of (name, serial) of the open blocks, text, characters inside links."""
    stack: list[tuple[str, str, int]] = []  # tag, name, serial
    parts: list[str] = []
    linked, link, serial, at = 0, 0, 0, 0

    def flush():
        nonlocal parts, linked
        text = " ".join(references.unescape("".join(parts)).split())
        given, parts = linked, []
        linked = 0
        if text:
            yield tuple((name, k) for _, name, k in stack), text, min(given, len(text))

    while (m := _token.search(page, at)) is not None:
        if m.start() > at:
            parts.append(page[at : m.start()])
            if link:
                linked += len(parts[-1].strip())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                link = 0
            if tag in BLOCKS:
                yield from flush()
                if any(t == tag for t, _, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
            continue
        if tag in RAW:
            if (m[3] or m[6] or "").endswith("/"):
                continue
            if tag not in _ends:
                _ends[tag] = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)
            end = _ends[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "a":
            link = 1
        if tag in ("br", "hr"):
            parts.append(" ")
        if tag in BLOCKS:
            yield from flush()
            link = 0
            if tag in CLOSES_P and stack and stack[-1][0] in HEADINGS | {"p"}:
                stack.pop()
            if tag in ("li", "dt", "dd", "td", "th", "tr"):
                same = {"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag != "tr" else {"td", "th", "tr"}
                while stack and stack[-1][0] in same:
                    stack.pop()
            serial += 1
            stack.append((tag, _kind(tag, m[3] or m[6] or ""), serial))
    if at < len(page):
        parts.append(page[at:])
    yield from flush()


# A wrapper node: [name, up to ``SAME_ON`` checksums of different pages, optional, repeated, text length, length in links, crc of the text, varies, children].
NAME, PAGES, OPTIONAL, REPEATED, LENGTH, LINKED, CRC, VARIES, KIDS = range(9)


def tree(page: str) -> list:
    """The block elements with text of one page, equal neighbours folded into repeated groups."""
    shown = [0]  # the checksum of all texts of the page, shared by its elements
    root = ["", shown, False, False, 0, 0, 0, False, []]
    open_nodes: list[tuple[int, list]] = [(0, root)]
    for path, text, linked in blocks(page):
        depth = 1
        while depth < len(open_nodes) and depth <= len(path) and open_nodes[depth][0] == path[depth - 1][1]:
            depth += 1
        del open_nodes[depth:]
        for name, serial in path[depth - 1 :]:
            node = [name, shown, False, False, 0, 0, 0, False, []]
            open_nodes[-1][1][KIDS].append(node)
            open_nodes.append((serial, node))
        leaf = open_nodes[-1][1]
        leaf[LENGTH] += len(text)
        leaf[LINKED] += linked
        data = text.encode("utf-8", "replace")
        leaf[CRC] = zlib.crc32(data, leaf[CRC])
        shown[0] = zlib.crc32(data + b"\n", shown[0])
    return _folded(root)


def _folded(node: list) -> list:
    kids: list[list] = []
    for kid in map(_folded, node[KIDS]):
        if kids and kids[-1][NAME] == kid[NAME]:
            kids[-1] = _joined(kids[-1], kid, same_page=True)
        else:
            kids.append(kid)
    # Groups of two or three different elements that repeat: one of each stays.
    for width in (2, 3):
        at = 0
        while at + 2 * width <= len(kids):
            if [k[NAME] for k in kids[at : at + width]] == [k[NAME] for k in kids[at + width : at + 2 * width]]:
                kids[at : at + 2 * width] = [_joined(a, b, same_page=True) for a, b in zip(kids[at : at + width], kids[at + width : at + 2 * width], strict=True)]
            else:
                at += 1
    node[KIDS] = kids
    return node


def _pages(a: list[int], b: list[int]) -> list[int]:
    """Checksums of different pages, no more than needed to call a slot constant."""
    return a if len(a) >= SAME_ON or a == b else sorted({*a, *b})[:SAME_ON]


def _joined(a: list, b: list, same_page: bool = False) -> list:
    """Two elements of one name as one."""
    crc = zlib.crc32(b[CRC].to_bytes(4, "little"), a[CRC]) if same_page else a[CRC]
    return [
        a[NAME], a[PAGES] if same_page else _pages(a[PAGES], b[PAGES]), a[OPTIONAL] or b[OPTIONAL], same_page or a[REPEATED] or b[REPEATED],
        a[LENGTH] + b[LENGTH], a[LINKED] + b[LINKED], crc, a[VARIES] or b[VARIES] or (not same_page and a[CRC] != b[CRC]),
        _aligned(a[KIDS], b[KIDS], same_page),
    ]


def _aligned(a: list[list], b: list[list], same_page: bool) -> list[list]:
    left, right = [k[NAME] for k in a], [k[NAME] for k in b]
    if left == right:
        return [_joined(x, y, same_page) for x, y in zip(a, b, strict=True)]
    out: list[list] = []
    for kind, a0, a1, b0, b1 in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            out.extend(_joined(x, y, same_page) for x, y in zip(a[a0:a1], b[b0:b1], strict=True))
            continue
        for kid in a[a0:a1] + b[b0:b1]:
            # A second place of an element that stands beside it already is one more repetition.
            if out and out[-1][NAME] == kid[NAME]:
                out[-1] = _joined(out[-1], kid, same_page)
                out[-1][REPEATED] = True
            else:
                out.append(kid)
            out[-1][OPTIONAL] = True
    return out


def align(a: list | None, b: list) -> list:
    """Two wrappers of one host as one."""
    return b if a is None else _joined(a, b)


@lru_cache(maxsize=65_536)
def outside(name: str, in_article: bool) -> bool:
    """Does the name of an element say that it is not main text? Those of the whole page say nothing."""
    words = name.split(".")
    return words[0] not in ("html", "body") and (not OUTSIDE.isdisjoint(words) or (not in_article and not HEADERS.isdisjoint(words)))


def _region(names: list[str]) -> tuple[str, int]:
    """Which region a path lies in, and where in the path it begins."""
    kind, at = "", len(names)
    for k, name in enumerate(names):
        tag = name.split(".")[0]
        if tag == "article":
            return "article", min(k, at)
        if not kind and (tag == "main" or "role.main" in name):
            kind, at = "main", k
    return kind, at


def _varies(node: list) -> bool:
    """Is a slot not known to be constant? That takes ``SAME_ON`` different pages, copies of one page show nothing."""
    return node[VARIES] or len(node[PAGES]) < SAME_ON


def _open(node: list, inside: bool) -> Iterator[list]:
    """The elements of a wrapper that are not marked as outside."""
    for kid in node[KIDS]:
        here = inside or bool(_region([kid[NAME]])[0])
        if not outside(kid[NAME], here):
            yield kid
            yield from _open(kid, here)


def main_paths(wrapper: list) -> dict[str, bool]:
    """For every path of the wrapper outside ``article`` and ``main``: is its own text main text on pages without them?"""
    paths: dict[str, tuple[list, bool]] = {}

    def walk(node: list, path: str, out: bool) -> None:
        for kid in node[KIDS]:
            if _region([kid[NAME]])[0]:
                continue
            gone = out or outside(kid[NAME], False)
            at = f"{path}>{kid[NAME]}"
            if at in paths:
                known = paths[at][0]
                both = any(_varies(x) for x in (known, kid) if x[LENGTH])
                seen = _pages(known[PAGES], kid[PAGES])
                paths[at] = ([known[NAME], seen, *known[OPTIONAL:LENGTH], known[LENGTH] + kid[LENGTH], known[LINKED] + kid[LINKED], known[CRC], both, []], gone)
            else:
                paths[at] = (kid, gone)
            walk(kid, at, gone)

    walk(wrapper, "", False)

    # A host without any slot that varies has shown no template yet.
    unknown = not any(node[LENGTH] > 0 and _varies(node) for node in _open(wrapper, False))

    def good(node: list, gone: bool) -> bool:
        return not gone and node[LENGTH] > 0 and (unknown or _varies(node)) and node[LINKED] <= MOST_LINKS * node[LENGTH]

    return {p: good(node, gone) for p, (node, gone) in paths.items()}


def _chosen(found: list, keep: dict[str, bool]) -> list[bool]:
    """Which of a page's texts are main text. Marks do not count on elements that hold ``main`` or the page's article."""
    places = [_region([name for name, _ in path]) for path, _, _ in found]
    both = list(zip(found, places, strict=True))
    unmarked: set[int] = set()  # serials

    def clear(path, at: int, first: int = 0) -> bool:
        return not any(outside(name, k >= at) and serial not in unmarked for k, (name, serial) in enumerate(path) if k >= first)

    def choose() -> tuple[list[bool], bool]:
        alive = [clear(path, at) for (path, _, _), (_, at) in both]
        in_article = any(good and region == "article" for good, (region, _) in zip(alive, places, strict=True))
        if any(good and region for good, (region, _) in zip(alive, places, strict=True)):
            return [good and region != "" for good, (region, _) in zip(alive, places, strict=True)], in_article
        return [good and keep.get("".join(f">{name}" for name, _ in path), False) for good, (path, _, _) in zip(alive, found, strict=True)], in_article

    articles: dict[int, int] = {}  # serial: length of its text
    above: dict[int, set[int]] = {}
    for (path, text, _), (region, at) in both:
        if not region:
            continue
        start = next((k for k, (name, _) in enumerate(path) if name.split(".")[0] == "article"), None)
        if start is None or start > at:
            unmarked.update(serial for _, serial in path[: at + 1])
        if start is not None and clear(path, at, start):
            articles[path[start][1]] = articles.get(path[start][1], 0) + len(text)
            above[path[start][1]] = {serial for _, serial in path[:start]}
    chosen, in_article = choose()
    if articles and not in_article:
        # All articles are below marked elements: the longest is the page's article, unless the rest is longer.
        longest = max(articles, key=articles.__getitem__)
        if articles[longest] > sum(len(text) for good, (_, text, _) in zip(chosen, found, strict=True) if good):
            unmarked |= above[longest]
            chosen, _ = choose()
    return chosen


def extract(page: str, keep: dict[str, bool]) -> str:
    """The main text of one page: its own elements say whether it is inside ``article`` and ``main`` or by ``keep``."""
    found = list(blocks(page))
    return " ".join(text for good, (_, text, _) in zip(_chosen(found, keep), found, strict=True) if good)


def _host(url: str):
    found = F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(found, F.lit(""))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per host: host, wrapper (as JSON). All pages take part."""

    def fold(rows: Iterator[tuple[str, list]]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]}, SCHEMA)

        for host, found in rows:
            held[host] = align(held.get(host), found)
            if len(held) >= HOSTS_AT_ONCE:
                yield out()
                held.clear()
        yield out()

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold((h, tree(p.as_py())) for b in batches for h, p in zip(b.column(0).to_pylist(), b.column(1), strict=True))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold((h, json.loads(w)) for b in batches for h, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

    found = pages.where(col(html).isNotNull()).select(_host(url).alias("host"), col(html).alias("html")).mapInArrow(infer, "host string, wrapper string")
    spread = F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_GROUPS))
    for keys in ([F.col("host"), spread], [F.col("host")]):
        found = found.repartition(*keys).sortWithinPartitions("host", "wrapper").mapInArrow(merge, "host string, wrapper string")
    return found


SCHEMA = pa.schema([("host", pa.string()), ("wrapper", pa.string())])


def extract_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    known = wrappers(pages, url, html)
    rows = pages.select(col("page_id").alias("page_id"), col(url).cast("string").alias("url"), F.coalesce(col(html), F.lit("")).alias("html"), _host(url).alias("host"))
    # A host's pages meet its wrapper in ``MERGE_GROUPS`` parts, whatever the host's share of all pages.
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(MERGE_GROUPS)).cast("int")
    copies = known.select("host", "wrapper", F.explode(F.sequence(F.lit(0), F.lit(MERGE_GROUPS - 1))).alias("part"))
    joined = rows.withColumn("part", part).join(copies, ["host", "part"], "left").select("page_id", "url", "html", "wrapper")
    kind = T.StructType([T.StructField("page_id", joined.schema["page_id"].dataType)]).add("url", "string").add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict[str | None, dict[str, bool]] = {None: {}}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2), batch.column(3), strict=True):
                wrapper = wrapper.as_py()
                if wrapper not in paths:
                    if len(paths) > HOSTS_AT_ONCE:
                        paths = {None: {}}
                    paths[wrapper] = main_paths(json.loads(wrapper))
                texts.append(extract(page.as_py(), paths[wrapper]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.mapInArrow(run, kind)
