"""Main text of web pages, with wrappers inferred for each host as union-free regular expressions.

A page is a stream of tokens, tags and texts. The streams of a host are aligned
tag by tag: a text of one page meets the texts of the other pages inside the same tags. Each
mismatch is resolved as it comes: texts that differ become a slot, a place that some
pages lack becomes an optional group, and one that a page has several times a
repeated group. A text that every page with its place has there stays a literal. What
is kept of an alignment are counts and greatest values, so aligning one page after
the other gives the same wrapper in any order, and the parts of a large host are merged
without gathering its pages.

The wrapper says where a host's main text is: its slots in the innermost container that
holds most of the host's text. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts and comments in it are left out, and so are the wrapper's literals. A
page without a wrapper, or without the container, gives its article (or main element;
without one, the body) instead.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm._tables import small, store

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*[\"']?\s*([^\s\"'>]+)", re.I)
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"[ \t\n\r\f\v   -     　]+")
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|sidebar|aside|widget|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager"
    r"|header|masthead|footer|comments?|disqus|replies|respond|related|recommend\w*|share|sharing|social|newsletter|subscribe|signup|login|search|toolbar|skip)(?:$|[\s_\d-])",
    re.I,
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_OUT = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "object", "canvas", "video", "audio", "head"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
#: Pages that a literal must be on at least; on fewer, texts may agree by chance.
TEMPLATE_PAGES = 5
#: Share of a host's characters that its container holds at least.
CONTAINER = 0.7
_CONTAINERS = {"article", "main", "section", "div", "td", "center", "body"}
#: Hosts whose literals are broadcast; beyond, pages are joined with them by a shuffle.
BROADCAST_HOSTS = 20_000


def decoded(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def tokens(page: str):
    """(kind, name, attributes or text): kinds open, close, text."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        slash, name, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if name:
            yield ("close" if slash else "open"), name.lower(), rest
        elif m[1] is None and not m[0].startswith("<"):
            yield "text", "", m[0]
    if at < len(page):
        yield "text", "", page[at:]


def _is_out(name: str, rest: str) -> bool:
    if name in _OUT:
        return True
    if not rest or name in ("html", "body", "article", "main") and "comment" not in rest.lower():
        return False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and _BOILER.search(value) or key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _tag(name: str, rest: str) -> str:
    """A tag token: the name with the first class, whose digits may differ from page to page."""
    m = _CLASS.search(rest) if rest else None
    return f"{name}.{_DIGITS.sub('#', m[1])}" if m else name


def blocks(page: str) -> list[tuple[str, bool, bool, str]]:
    """(path of tags, whether in an article, whether boilerplate, text) of each non-empty block in page order."""
    out: list[tuple[str, bool, bool, str]] = []
    stack: list[tuple[str, bool, bool, str]] = []
    held: list[str] = []
    boiler, article = 0, 0

    def flush():
        if held:
            text = _SPACE.sub(" ", decoded("".join(held))).strip(" ")
            held.clear()
            if text:
                out.append(("/".join(s[3] for s in stack), article > 0, boiler > 0, text))

    for kind, name, rest in tokens(page):
        if kind == "text":
            held.append(rest)
            continue
        if name == "br":
            held.append(" ")
            continue
        out_here = kind == "open" and name not in _VOID and _is_out(name, rest)
        if name in _INLINE and not out_here and not (kind == "close" and stack and stack[-1][0] == name and stack[-1][1]):
            if kind == "close":
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name and stack[k][1]:
                        flush()
                        for gone in stack[k:]:
                            boiler -= gone[1]
                            article -= gone[2]
                        del stack[k:]
                        break
                    if stack[k][0] not in _INLINE:
                        break
            continue
        flush()
        if name in _VOID:
            continue
        if kind == "open":
            if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                gone = stack.pop()
                boiler, article = boiler - gone[1], article - gone[2]
            main = name in ("article", "main") or 'role="main"' in rest
            if not rest.rstrip().endswith("/") or main:
                stack.append((name, out_here, main and not out_here, _tag(name, rest)))
                boiler, article = boiler + out_here, article + (main and not out_here)
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for gone in stack[k:]:
                        boiler -= gone[1]
                        article -= gone[2]
                    del stack[k:]
                    break
    flush()
    return out


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


def main_text(found: list[tuple[str, bool, bool, str]], literals: set[int] = frozenset(), container: str | None = None) -> str:
    """The page's blocks that are its own; ``container`` and ``literals`` (keys) are of the host's wrapper."""
    inside = [(path, t) for path, _, o, t in found if not o and f"{path}/".startswith(f"{container}/")] if container is not None else []
    if not inside:
        has_article = any(a and not o for _, a, o, _ in found)
        inside = [(path, t) for path, a, o, t in found if not o and (a or not has_article)]
    own = [t for path, t in inside if _key(path, t) not in literals] if literals else [t for _, t in inside]
    return "\n".join(own or [t for _, t in inside])  # pages that are all alike are no template


def _prefixes(batches):
    """(host, container, depth, chars) of each container around each place."""
    for b in batches:
        rows = []
        for name, place, chars in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            tags = place.split("/")
            rows += [(name, "/".join(tags[: k + 1]), k, chars) for k, t in enumerate(tags) if t.partition(".")[0] in _CONTAINERS]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "container", "depth", "chars"])


def _containers(items: DataFrame) -> DataFrame:
    """(host, container) of a wrapper's items, for hosts that have one."""
    places = items.where("literal is null").select("host", "place", "chars")
    held = places.mapInArrow(_prefixes, "host string, container string, depth long, chars long").groupBy("host", "container", "depth").agg(F.sum("chars").alias("chars"))
    whole = places.groupBy(F.col("host").alias("_h")).agg(F.sum("chars").alias("_chars"))
    held = held.join(whole, F.col("host") == F.col("_h")).where(F.col("chars") >= CONTAINER * F.col("_chars"))
    return held.groupBy("host").agg(F.max(F.struct("depth", "container")).alias("c")).select("host", F.col("c.container").alias("container"))


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def _stream_rows(batches):
    """(host, place, literal, times, at, chars) of each page: its places (literal null) with how often it has them and the characters outside of boilerplate there, and the distinct texts of each place."""
    for b in batches:
        rows: list[tuple] = []
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            name, times, texts = _host(url), {}, {}
            for at, (path, _, out, text) in enumerate(blocks(page or "")):
                first, n, chars = times.get(path, (at, 0, 0))
                times[path] = (first, n + 1, chars + (0 if out else len(text)))
                texts.setdefault((path, text), at)
            rows += [(name, path, None, n, at, chars) for path, (at, n, chars) in times.items()]
            rows += [(name, path, _key(path, text), 1, at, 0) for (path, text), at in texts.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _STREAM)


_STREAM = ["host", "place", "literal", "times", "at", "chars"]


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", template_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """The hosts' wrappers, stored, a row an item: host, place (path of tags), literal (the key of its text; null for a slot), pages, position, chars (outside of boilerplate, over all pages), host_pages, optional, repeated.

    An item is optional if some pages of the host lack its place, repeated if a page
    has the place more than once. A place is a slot unless all its pages, and at
    least ``template_pages``, share a text there; a place with literals is also a
    slot if its pages have other texts besides. Null pages count as empty.
    """
    base = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = base.mapInArrow(_stream_rows, "host string, place string, literal long, times long, at long, chars long")
    items = store(rows.groupBy("host", "place", "literal").agg(F.count("*").alias("pages"), F.max("times").alias("times"), F.avg("at").alias("position"), F.sum("chars").alias("chars")).where(F.col("literal").isNull() | (F.col("pages") >= template_pages)), "wrapper-items")
    hosts = base.groupBy(host(F.col("url")).alias("_host")).agg(F.count("*").alias("_all"))
    places = items.where("literal is null").select(F.col("host").alias("_h"), F.col("place").alias("_p"), F.col("pages").alias("_pages"), F.col("times").alias("_times"))
    both = items.join(places, (F.col("host") == F.col("_h")) & (F.col("place") == F.col("_p"))).join(hosts, F.col("host") == F.col("_host"))
    both = both.where(F.col("literal").isNull() | (F.col("pages") == F.col("_pages")))
    fixed = F.sum(F.col("literal").isNotNull().cast("long")).over(Window.partitionBy("host", "place"))
    both = both.withColumn("_fixed", fixed).where(F.col("literal").isNotNull() | (F.col("_fixed") < F.col("_times")))
    return store(both.select("host", "place", "literal", "pages", "position", "chars", F.col("_all").alias("host_pages"), (F.col("_pages") < F.col("_all")).alias("optional"), (F.col("_times") > 1).alias("repeated")), "wrappers")


def expression(items: list[tuple[str, str | None, bool, bool]]) -> str:
    """A wrapper's items (place, literal text or None, optional, repeated), in order, as a regular expression over tags and texts."""
    out = []
    for place, text, optional, repeated in items:
        tags = [x.partition(".")[0] for x in place.split("/") if x]
        one = "".join(f"<{x}>" for x in tags) + ("#text" if text is None else text) + "".join(f"</{x}>" for x in reversed(tags))
        out.append(f"({one}){'*' if optional and repeated else '?' if optional else '+'}" if optional or repeated else one)
    return "".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", template_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """One row for each page: id, url, text, n_chars (code points).

    A null page gives empty text. Pages without a host share a wrapper. Hosts of fewer
    than ``template_pages`` pages have none. Literals of the wrapper are left out,
    in articles too, unless nothing else would be left.
    Repeated rows each give a row; other columns are ignored; an empty
    table gives an empty table.
    """
    wrappers = infer_wrappers(pages, url_col, html_col, template_pages).where(F.col("host_pages") >= template_pages)
    literals = wrappers.where("literal is not null").groupBy("host").agg(F.sort_array(F.collect_set("literal")).alias("template"))
    template = store(_containers(wrappers).join(literals, "host", "full").withColumnRenamed("host", "_host"), "templates")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    base = base.join(small(template, BROADCAST_HOSTS), host(F.col("url")) == F.col("_host"), "left").select("id", "url", "html", "template", "container")
    kinds = [base.schema[c].dataType.simpleString() for c in ("id", "url")]

    def run(batches):
        for b in batches:
            texts = [main_text(blocks(page or ""), frozenset(t or ()), c) for page, t, c in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    out = base.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
