"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of structural tokens (block tags with class and id) and texts. Streams of a host are aligned one after
another. Where two differ, the mismatch becomes an optional group, a run of equal neighbours becomes a repeated group, and
texts that differ become a text slot; texts that stay the same on pages that differ otherwise are part of the template.
Wrappers merge like the pages do, so they are inferred in tasks, then merged by host in salted steps; a host of any size
never meets in one task.

A wrapper decides for each slot whether it belongs to the article. Inside article or main elements slots are kept, less
what is marked as navigation, advert, notice, comment and the like, and less the template's own text: a constant line of a
div or section, of PHRASE characters at most, that no page's alignment made optional or repeated. On pages without such
elements, slots outside marked regions are kept that neither repeat the template's own text nor consist of links. Marks
are words of tags, roles, classes and ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, written

# Tag names of HTML by their part in a page, and words that mark regions in class and id names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
SKIPPED = frozenset("nav footer aside form title button select option datalist dialog menu search label fieldset legend object canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form note".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar side aside rail menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing comment comments commentlist discussion reply replies respond disqus related recommended recommendations widget toolbar pagination pager legal copyright disclaimer login search skip".split()
)
#: Beginnings of longer words of the same kind, and words that only say whether a part is there.
MARK_STEMS = ("comment", "advert", "sponsor", "cookie", "newsletter", "breadcrumb", "sidebar", "subscri", "usercomment")
ABOUT = frozenset("has with no without".split())
#: Of an article or main element only these say that it is something else.
NOT_MAIN = frozenset("ad ads advert advertisement sponsor sponsored promo promoted comment comments reply related widget teaser".split())
MAIN_MARKS = frozenset("article content post entry story main".split())
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title", "option", "optgroup", "body", "html"}
#: Opening one ends an open one of the same kind, up to the container.
SIBLINGS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|math|xmp|noembed|noframes|head)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>"
    r"|[^<]+"
    r"|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_DIGITS = re.compile(r"\d+")
MAX_DEPTH = 48
#: Children of a node beyond which it is a repeated group of optional members, one for each signature and kind: no text is lost by it.
MAX_ROW = 24
#: Inside articles only constants of these elements, and no longer than this, are template: paragraphs, headings, cells and articles that a host mirrors are not.
PLAIN = frozenset("div section".split())
PHRASE = 200
#: Hosts whose wrappers a task holds before it sends them on.
HOSTS_HELD = 1_000


def _read_tag(tag: str, attributes: str) -> tuple[str, int]:
    """(signature, 1 skipped, 2 main, 4 hidden header, 0 neither) of an opening tag."""
    sig, kind = tag, 1 if tag in SKIPPED else 2 if tag in ("article", "main") else 4 if tag == "header" else 0
    if attributes and not attributes.isspace():
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        words = {w.lower() for w in _PART.findall(names)}
        marks = set() if words & ABOUT or tag in ("html", "body") else {w for w in words if w in MARKS or w.startswith(MARK_STEMS)}
        if tag in ("article", "main"):
            marks &= NOT_MAIN
        role = found.get("role", "").lower()
        if names:
            sig += "." + _DIGITS.sub("N", names)
        if role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            kind = 1
        elif marks:
            kind = 4 if marks == {"header"} else 1
        elif kind == 0 and (role in ("main", "article") or (tag in ("div", "section", "td") and words & MAIN_MARKS)):
            kind = 2
    return sig, kind


def _short(path: list[tuple[str, int]]) -> tuple:
    """The path, or of a deep one its beginning and one element for the rest: a hash of it, with the kind that counts there."""
    if len(path) <= MAX_DEPTH:
        return tuple(path)
    rest = path[MAX_DEPTH - 1 :]
    kinds = {k for _, k in rest}
    return (*path[: MAX_DEPTH - 1], (f"+{xxhash.xxh64_hexdigest(repr(rest))}", next(k for k in (1, 2, 4, 0) if k in kinds)))


def blocks(html: str) -> Iterator[tuple[tuple, bool, str, int]]:
    """(path, skipped, text, link characters) of each block of text, in page order.

    The path holds (signature, kind) of the open structural elements; texts have references decoded and runs of white space
    as one space. Unclosed and stray tags are taken as browsers take them, roughly.
    """
    path: list[tuple[str, str, int]] = []  # (tag, signature, kind)
    parts: list[str] = []
    dropped: list[tuple[str, int]] = []  # open inline elements that are skipped, and where their text begins
    links, in_link = 0, False

    def block():
        """What has been gathered, as a list of no or one block."""
        nonlocal links
        text, n, links = " ".join(unescape("".join(parts)).split()) if parts else "", links, 0
        parts.clear()
        dropped.clear()
        if not text:
            return ()
        inside = any(k == 2 for _, _, k in path)
        skipped = any(k == 1 or (k == 4 and not inside) for _, _, k in path)
        return ((_short([(s, k) for _, s, k in path]), skipped, text, n),)

    for m in _TOKEN.finditer(html):
        tag = m[3] or m[6]
        if tag is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                parts.append(raw)
                if in_link:
                    links += len(raw)
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag in VOID:
            parts.append(" ")
            if tag == "hr":
                yield from block()
            continue
        if tag == "a":
            in_link = not closing
        if tag not in BLOCKS:
            if closing:
                if dropped and dropped[-1][0] == tag:
                    del parts[dropped.pop()[1] :]
            elif (tag in SKIPPED or attributes) and not attributes.endswith("/") and _read_tag(tag, attributes)[1] == 1:
                dropped.append((tag, len(parts)))
            continue
        yield from block()
        if closing:
            at = next((k for k in range(len(path) - 1, -1, -1) if path[k][0] == tag), -1)
            if at >= 0:
                del path[at:]
            continue
        if tag in ENDS_P and (at := next((k for k in range(len(path) - 1, -1, -1) if path[k][0] == "p"), -1)) >= 0:
            del path[at:]
        if tag in SIBLINGS:
            like = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] in SIBLINGS[tag]:
                    break
                if path[k][0] in like:
                    del path[k:]
                    break
        path.append((tag, *_read_tag(tag, attributes)))
    yield from block()


# A wrapper is [signature, kind, optional, repeated, text, children, chars, links, pages with text]; text: None no text, 0 a slot, else the
# constant, a long one as its beginning and a hash of the whole. Of the pages, by hashes of all their texts that are not skipped, the least TEMPLATE_PAGES different ones are held.
TEMPLATE_PAGES = 3


def _node(sig: str, kind: int) -> list:
    return [sig, kind, 0, 0, None, [], 0, 0, []]


def _unite(a: list, b: list) -> None:
    """Align b with a; a becomes the wrapper of both."""
    a[2], a[3] = a[2] | b[2], a[3] | b[3]
    if b[4] is not None:
        a[4] = b[4] if a[4] is None else a[4] if a[4] == b[4] else 0
    a[6], a[7], a[8] = a[6] + b[6], a[7] + b[7], sorted({*a[8], *b[8]})[:TEMPLATE_PAGES]
    _align(a[5], b[5])


def _align(a: list, b: list) -> None:
    """Children of b aligned with those of a, by the next place where signatures and kinds meet; the rest is optional on both sides."""
    at, met = 0, set()
    for child in b:
        k = next((k for k in range(at, len(a)) if a[k][:2] == child[:2]), -1)
        if k < 0:
            child[2] = 1
            a.insert(at, child)
            at += 1
        else:
            _unite(a[k], child)
            at = k + 1
        met.add(id(a[at - 1]))
    for child in a:
        if id(child) not in met:
            child[2] = 1
    if len(a) > MAX_ROW:
        # Too varied for one sequence: a repeated group of optional members, one for each signature and kind.
        merged: dict[tuple, list] = {}
        for child in a:
            child[2] = child[3] = 1
            if (own := tuple(child[:2])) in merged:
                _unite(merged[own], child)
            else:
                merged[own] = child
        a[:] = merged.values()


def page_wrapper(html: str) -> list:
    """The wrapper of one page: equal neighbours are already repeated groups."""
    root = _node("", 0)
    open_nodes = [root]
    last: tuple = ()
    found = list(blocks(html))
    # A constant is the same on its pages, so their remaining texts differ where their whole texts do.
    page = xxhash.xxh64_hexdigest("\n".join(text for _, skipped, text, _ in found if not skipped))
    for path, _, text, links in found:
        same = 0
        while same < min(len(path), len(last)) and path[same] == last[same]:
            same += 1
        if same == len(path) == len(last) and same:
            same -= 1  # a further block of the same kind
        del open_nodes[same + 1 :]
        for sig, kind in path[same:]:
            row = open_nodes[-1][5]
            if row and row[-1][:2] == [sig, kind]:
                row[-1][3] = 1
            else:
                row.append(_node(sig, kind))
            open_nodes.append(row[-1])
        node = open_nodes[-1]
        own = text if len(text) <= PHRASE else f"{text[:PHRASE]}+{xxhash.xxh64_hexdigest(text)}"
        node[4] = own if node[4] is None else node[4] if node[4] == own else 0
        node[6], node[7], node[8] = node[6] + len(text), node[7] + min(links, len(text)), [page]
        last = path
    return root


def kept_paths(wrapper: list) -> tuple[set, set]:
    """Paths of slots inside article elements, and of slots that pages without such elements keep."""
    main, rest = set(), set()

    def walk(node, path, inside, skipped, fixed):
        sig, kind = node[0], node[1]
        # Part of every page, once: neither the node nor one that holds it is optional or repeated.
        fixed = fixed and not node[2] and not node[3]
        path = (*path, (sig, kind)) if sig else path
        inside = inside or kind == 2
        skipped = skipped or kind == 1 or (kind == 4 and not inside)
        if node[4] is not None and not skipped:
            constant = node[4] != 0 and len(node[8]) >= TEMPLATE_PAGES
            if inside:
                if not (constant and fixed and sig.partition(".")[0] in PLAIN and len(node[4]) <= PHRASE):
                    main.add(path)
            elif not constant and 2 * node[7] <= node[6]:
                rest.add(path)
        for child in node[5]:
            walk(child, path, inside, skipped, fixed)

    walk(wrapper, (), False, False, True)
    return main, rest


def main_text(html: str, main: set, rest: set) -> str:
    """Texts of the kept slots of a page, one line each."""
    inside, outside = [], []
    for path, skipped, text, _ in blocks(html):
        if skipped:
            continue
        if path in main:
            inside.append(text)
        elif path in rest:
            outside.append(text)
    return "\n".join(inside or outside)


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _merge(wrappers: list[str], counts: list[int]) -> tuple[str, int]:
    first, *others = (json.loads(w) for w in wrappers)
    for other in others:
        _unite(first, other)
    return json.dumps(first, separators=(",", ":")), int(sum(counts))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages): the wrapper of each host as JSON, inferred from all its pages."""

    def infer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def out():
            cols = [pa.array(list(found)), pa.array([json.dumps(w, separators=(",", ":")) for w, _ in found.values()]), pa.array([n for _, n in found.values()], pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(cols, ["host", "wrapper", "pages"])

        for hosts, htmls in batches(rows, "host", "html"):
            for host, html in zip(hosts, htmls, strict=True):
                own, host = page_wrapper(html.as_py() or ""), host.as_py()
                if host in found:
                    _unite(found[host][0], own)
                    found[host][1] += 1
                else:
                    found[host] = [own, 1]
            if len(found) >= HOSTS_HELD:
                yield out()
        if found:
            yield out()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("wrapper")
        wrapper, n = _merge(part["wrapper"].tolist(), part["pages"].tolist())
        return pd.DataFrame({"host": part["host"].iloc[:1], "wrapper": [wrapper], "pages": [n]})

    schema = "host string, wrapper string, pages long"
    some = pages.select(_host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(infer, schema)
    salted = some.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(16)).alias("salt")).applyInPandas(merge, schema)
    return salted.groupBy("host").applyInPandas(merge, schema)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of `pages`.

    Null html is empty and gives an empty text. Pages without host share a wrapper of their own. Repeated rows and null ids
    each get a row; an empty table gives an empty result; further columns are ignored.
    """
    wrappers = written(host_wrappers(pages), "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host(F.col("url").cast("string")).alias("host"))
    # Spark broadcasts the wrappers only while they are small; otherwise pages and wrappers meet by host.
    rows = rows.join(wrappers.select("host", "wrapper"), "host", "left").select("page_id", "url", "html", "wrapper")

    def run(rows_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for ids, urls, htmls, ws in batches(rows_in, "page_id", "url", "html", "wrapper"):
            texts = []
            for html, w in zip(htmls, ws, strict=True):
                key = w.as_py()
                if key not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[key] = kept_paths(json.loads(key)) if key else (set(), set())
                texts.append(main_text(html.as_py() or "", *known[key]))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
