"""Nearest-URL page differencing: blocks of pages as lines, compared with the page of the nearest path on the same host.

A line that the longest common subsequence of two such pages shares belongs to the template and goes. Two things bound that
rule. Markup that names its purpose (navigation, adverts, comments, ...) is dropped at once. And inside an explicit article
(<article>, <main> or such a role) lines go only where a template has them, in an unbroken run behind the headline or at the end, and
only when two neighbours with other headlines have them in the same place: mirrored articles and quotes are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweir.llm.shared import Scratch
from claimweir.llm.shingles import cut_batches, small_batches
from claimweir.operators.lookup import lookup_join
from claimweir.operators.numbering import number_ranges

_NAME = re.compile(r"</?([a-zA-Z][\w:-]*+)")
#: The rest of a tag. Quotes count behind an equals sign only; each of the possessive repeats reads a character once.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
# Elements whose contents are no text.
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas", "audio", "video", "title"}
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in _RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|style|aria-hidden|aria-label|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Element names of HTML and common names of page parts.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "datalist"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_PARTS = re.compile(
    r"ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|gdpr|notice\w*|popup\w*|modal\w*|overlay\w*"
    r"|newsletter\w*|subscri\w*|signup|sidebar\w*|widget\w*|menu\w*|nav|navbar\w*|navigation|breadcrumb\w*|footer\w*|masthead|topbar|toolbar"
    r"|comment|comments|commentlist|disqus\w*|respond|repl(?:y|ies)|share\w*|sharing|social\w*|related\w*|recommend\w*|pagination|pager"
    r"|login|search\w*|copyright|disclaimer|hidden"
)
_WHOLE = {"site-header", "page-header", "skip-link"}
#: Words that may stand beside the name of a part in a class, as in ad-box; any other makes it another name (has-sidebar).
_BESIDE = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "component", "container", "content",
    "desktop", "fixed", "floating", "form", "global", "group", "head", "header", "heading", "icon", "icons", "inner", "item", "items", "js", "left", "link", "links",
    "list", "main", "media", "message", "mobile", "module", "news", "outer", "page", "panel", "policy", "post", "posts", "primary", "region", "right", "row",
    "secondary", "section", "site", "slot", "sticky", "stories", "story", "text", "title", "top", "unit", "wrap", "wrapper",
}
#: What a class drops inside an explicit article: adverts, comments, buttons. Any other name there may be that of a section of the text.
_PARTS_INSIDE = re.compile(r"ad|ads|adv|advert\w*|adsense|sponsor\w*|comment|comments|commentlist|disqus\w*")
_INTERFACE = {"bar", "btn", "button", "buttons", "icon", "icons", "links", "toolbar"}
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comment|reply)(?:$|[\s_-])")
#: Pages that share this part of the longer one's text are copies and say nothing about their template.
COPY = 0.8
#: Bytes of html, and lines of pages that are compared, that become Python objects at a time; a batch of a task may hold 10,000 pages.
PAGE_BYTES = 1 << 20
LINES = 1 << 15


def _names_part(names: str, inside: bool = False) -> bool:
    """Whether a class or id, as a whole, names a page part; inside an article only adverts, comments and buttons are such parts."""
    for name in names.split():
        parts = [x for x in re.split(r"[_-]+", name) if x]
        named = [_PARTS.fullmatch(x) is not None for x in parts]
        if (not inside and name in _WHOLE) or (any(named) and all(n or x in _BESIDE or x.isdigit() for n, x in zip(named, parts, strict=True))):
            if not inside or any(x in _INTERFACE or _PARTS_INSIDE.fullmatch(x) for x in parts):
                return True
    return False


class Tag(NamedTuple):
    """Where markup starts and ends; comments and elements without text have no name."""

    start: int
    end: int
    name: str = ""
    closes: bool = False
    attributes: str = ""


def scan(page: str) -> list[Tag]:
    """The markup of a page, in time linear in the page.

    A tag whose end cannot be found behind its quotes makes the rest of the page be read without regard to quotes: every later tag
    ends at the next `>`. Where no `>` follows, the rest is text; unclosed comments and scripts reach to the end.
    """
    out, at, last, quoted = [], 0, page.rfind(">"), True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            out.append(Tag(start, at))
        elif start > last:
            break
        elif (name := _NAME.match(page, start)) is not None:
            rest = _REST.match(page, name.end()) if quoted else None
            quoted = quoted and rest is not None
            at = rest.end() if rest else page.find(">", name.end()) + 1
            if not at:  # the name itself reaches beyond the last >
                break
            lower, closes = name[1].lower(), page[start + 1] == "/"
            if lower in _RAW and not closes:
                end = _RAW_END[lower].search(page, at)
                at = end.end() if end else len(page)
                out.append(Tag(start, at))
            else:
                out.append(Tag(start, at, lower, closes, page[name.end() : at - 1]))
        elif page[start + 1 : start + 2] in ("!", "?", "/"):
            at = page.find(">", start) + 1
            out.append(Tag(start, at))
        else:
            at = start + 1
    return out


class _Open:
    """Open elements, found by name without a search."""

    def __init__(self) -> None:
        self.stack: list[tuple] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, *rest) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, *rest))

    def close(self, name: str) -> bool:
        """End the innermost element of a name and all inside it; False if there is none."""
        places = self.places.get(name)
        if not places:
            return False
        place = places[-1]
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()
        return True


def _attributes(tag: Tag) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(tag.attributes)}


def _names(attributes: dict[str, str]) -> str:
    return f"{attributes.get('class', '')} {attributes.get('id', '')}"


def _starts_article(name: str, attributes: dict[str, str]) -> bool:
    return name in ("article", "main") or attributes.get("role", "") in ("article", "main") or attributes.get("itemprop") == "articlebody"


def _holders(tags: list[Tag]) -> set[int]:
    """Where elements start that hold a <main>, or all articles of the page; comments and articles in navigation do not count."""
    open_ = _Open()  # name, start, closed to articles
    mains: set[int] = set()
    common: list[int] | None = None  # elements around all articles so far
    least = 0  # fewest open elements since the last article
    for tag in tags:
        if not tag.name or tag.name in _VOID:
            continue
        if tag.closes:
            open_.close(tag.name)
            least = min(least, len(open_.stack))
            continue
        closed = bool(open_.stack) and open_.stack[-1][2]
        attributes = {} if closed else _attributes(tag)
        if not closed and _starts_article(tag.name, attributes):
            if tag.name == "main" or attributes.get("role") == "main":
                for _, start, _ in reversed(open_.stack):
                    if start in mains:
                        break
                    mains.add(start)
            elif _COMMENT.search(_names(attributes)) is None:
                if common is None:
                    common = [start for _, start, _ in open_.stack]
                else:
                    del common[least:]
                least = len(common)
            closed = True
        open_.push(tag.name, tag.start, closed or (tag.name in _DROPPED and tag.name != "form"))
    return mains | set(common or ())


def page_lines(page: str | None) -> tuple[list[str], bool, int]:
    """The blocks of a whole page in page order, whether they come from an explicit article, and which is its headline (the first
    <h1>; -1 without one).

    Character references are decoded, white space becomes one space, empty blocks go. Unclosed elements end with their parent,
    stray end tags are ignored. Null gives no blocks. An element that holds the page's article is not dropped for its class, and
    inside an article only classes of adverts, comments and buttons drop an element, inline ones aside.
    """
    page = page or ""
    lines: list[tuple[str, bool, bool]] = []
    open_ = _Open()  # name, dropped, inside an article
    run: list[str] = []
    dropped = article = any_article = heading = False

    def end_block() -> None:
        nonlocal heading
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                lines.append((text, article, heading))
            run.clear()
        heading = False

    at = 0
    tags = scan(page)
    holders = _holders(tags)
    for tag in tags:
        if tag.start > at and not dropped:
            run.append(page[at : tag.start])
        at = tag.end
        name = tag.name
        if not name:
            continue
        if name not in _INLINE:
            end_block()
        if tag.closes:
            if open_.close(name):
                outer = open_.stack[-1][1:] if open_.stack else (False, False)
                if outer != (dropped, article):
                    end_block()
                dropped, article = outer
            continue
        if name in _VOID:
            continue
        attributes = _attributes(tag)
        role = attributes.get("role", "")
        starts = _starts_article(name, attributes)
        named = _names(attributes)
        holds = tag.start in holders
        drops = (
            (name in _DROPPED and not (name == "form" and holds))
            or (name == "header" and not article)
            or role in _ROLES
            or "hidden" in attributes
            or attributes.get("aria-hidden") == "true"
            or "display:none" in attributes.get("style", "").replace(" ", "")
            or (name not in ("html", "body", "article", "main") and not holds and not (article and name in _INLINE) and _names_part(named, article))
            or (name == "article" and _COMMENT.search(named) is not None)
        )
        if drops != dropped or starts:
            end_block()
        dropped = dropped or drops
        article = article or starts
        any_article = any_article or (starts and not dropped)
        heading = heading or name == "h1"
        open_.push(name, dropped, article)
    if at < len(page) and not dropped:
        run.append(page[at:])
    end_block()
    kept = [(text, first) for text, inside, first in lines if inside or not any_article]
    headline = next((i for i, (_, first) in enumerate(kept) if first), -1)
    return [text for text, _ in kept], any_article, headline


def shared_lines(mine: list[str], theirs: list[str]) -> np.ndarray:
    """Which of `mine` are in the longest common subsequence with `theirs`; among several, some one of them, always the same."""
    out = np.zeros(len(mine), bool)
    both = set(mine) & set(theirs)
    places = [i for i, line in enumerate(mine) if line in both]
    number = {line: n for n, line in enumerate(sorted(both))}
    a = np.array([number[mine[i]] for i in places], np.int64)
    b = np.array([number[line] for line in theirs if line in both], np.int64)
    out[np.array(places, np.int64)[_common(a, b)]] = True
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common subsequence of a with each beginning of b."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in a of a longest common subsequence with b, in linear memory (divide and conquer)."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64)
    if len(a) == 1:
        return np.zeros(int((b == a[0]).any()), np.int64)
    half = len(a) // 2
    ahead, behind = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
    cut = int(np.argmax(ahead + behind))
    return np.concatenate([_common(a[:half], b[:cut]), _common(a[half:], b[cut:]) + half])


class Lines(NamedTuple):
    """A page as hashes and sizes of its lines, and which of them is its headline (-1: none)."""

    own: list[int]
    sizes: list[int]
    headline: int

    def same_article(self, other: Lines) -> bool:
        return self.headline >= 0 and other.headline >= 0 and self.own[self.headline] == other.own[other.headline]


def lines_at_edges(mine: Lines, theirs: Lines) -> np.ndarray:
    """Which lines of an article stand in the same place in another one: behind the headline, or counted from the end."""
    out = np.zeros(len(mine.own), bool)
    for at, other in zip(range(mine.headline + 1, len(mine.own)), theirs.own[theirs.headline + 1 :], strict=False):
        if mine.own[at] != other:
            break
        out[at] = True
    for at, other in zip(range(len(mine.own) - 1, mine.headline, -1), reversed(theirs.own[theirs.headline + 1 :]), strict=False):
        if mine.own[at] != other:
            break
        out[at] = True
    return out


def lines_of_template(mine: Lines, neighbours: list[Lines | None], explicit: bool) -> list[int]:
    """Places of the lines to delete from a page, given its neighbours, nearest first.

    Copies of the page are passed over, and for an explicit article pages of the same headline, which are other versions of it. On a
    page without an explicit article the lines shared with the first neighbour go. Inside an article those go that two share at the
    same place, in an unbroken run behind the headline or up to the end; what is shared elsewhere may be quoted. The headline stays, and
    an article that has nothing else of its own stays whole.
    """
    size = np.array(mine.sizes)
    found = []
    for other in neighbours:
        if other is not None and len(found) < 1 + explicit and not (explicit and mine.same_article(other)):
            shared = shared_lines(mine.own, other.own)
            if not _copied(size[shared].sum(), size.sum(), sum(other.sizes)):
                found.append(lines_at_edges(mine, other) if explicit else shared)
    if len(found) < 1 + explicit:
        return []
    gone = np.logical_and.reduce(found)
    return [] if explicit and gone[mine.headline + 1 :].all() else np.flatnonzero(gone).tolist()


def _copied(shared: int, mine: int, theirs: int) -> bool:
    return shared >= COPY * max(mine, theirs)


def few_lines(batches: Iterator[pa.RecordBatch], *pages: list[str], most: int = LINES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the pages of each row (columns, or fields of columns) have `most` lines together, or there is one row."""

    def lines(batch: pa.RecordBatch) -> pa.Array:
        counts = [pc.list_value_length(pc.struct_field(batch.column(at[0]), [*at[1:], "own"])) for at in pages]
        return pa.array(sum(pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64) for n in counts))

    return cut_batches(batches, lines, most)


def page_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars): the main text of every page, its blocks joined by one space, and its code points.

    Pages are ordered by host and path, those with an explicit article and those without apart. The neighbours of a page are
    the nearest pages before and after it, on the same host, that are no copies of it: two pages are copies when they share
    80 % of the text of the longer one, articles also when they have the same headline, and runs of copies are passed over. A page
    without an article loses the lines that it shares with the neighbour of the longer common path (ties: the one before). An
    article loses those behind its headline and at its end that both neighbours (at the end of a host: the nearest two) have in the
    same place; with fewer nothing is known about a template, and nothing is deleted. Equal pages stand once in that order. Where copies drift so far that the page beyond a run is a copy again, that
    side has no neighbour. A null url counts as host and path of no letters; null or empty html gives an empty text. Repeated
    rows give repeated results. Ordering is by ranges over all hosts, so a large host is in many tasks; pages are compared by
    64-bit hashes of their lines.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "pages")
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    schema = T.StructType(
        [
            rows.schema["id"],
            rows.schema["url"],
            T.StructField("lines", T.ArrayType(T.StringType())),
            T.StructField("explicit", T.BooleanType()),
            T.StructField("headline", T.IntegerType()),
        ]
    )

    def parse(batches):
        for batch in small_batches(batches, 2, PAGE_BYTES):
            found = [page_lines(page) for page in batch.column(2).to_pylist()]
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*found, strict=True), (pa.list_(pa.string()), pa.bool_(), pa.int32()), strict=True)] if found else None
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "url", "lines", "explicit", "headline"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][\w+.-]*://[^/?#]*)?([^?#]*)", 1)
    parsed = scratch.write(rows.mapInArrow(parse, schema)).withColumns({"host": host, "path": path, "mark": F.xxhash64(F.array_join("lines", "\n"))})
    page = ["host", "explicit", "path", "mark"]
    content = F.struct(F.transform("lines", lambda x: F.xxhash64(x)).alias("own"), F.transform("lines", F.char_length).alias("sizes"), "headline")
    hashed = parsed.filter(F.size("lines") > 0).select(*page, content.alias("page"))
    distinct = scratch.write(hashed.groupBy(*page).agg(F.first("page").alias("page")))
    order = scratch.write(number_ranges(distinct, page, "at"))
    scratch.drop(distinct)

    def copies(batches):
        for batch in few_lines(batches, ["page"], ["theirs"]):
            same = []
            for mine, theirs, explicit in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                mine, theirs = Lines(**mine), Lines(**theirs)
                shared = np.array(mine.sizes)[shared_lines(mine.own, theirs.own)].sum()
                same.append(bool(_copied(shared, sum(mine.sizes), sum(theirs.sizes)) or (explicit and mine.same_article(theirs))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.bool_())], names=["at", "copy"])

    following = order.select("host", "explicit", (F.col("at") - 1).alias("at"), F.col("page").alias("theirs"))
    pairs = order.join(following, ["host", "explicit", "at"]).select("at", "page", "theirs", "explicit")
    pairs = scratch.write(pairs.mapInArrow(copies, "at long, copy boolean"))
    # Steps to the next page on either side; those to a copy are doubled until they leave its run or the host.
    ahead = pairs.select(F.lit(True).alias("ahead"), "at", (F.col("at") + 1).alias("to"), "copy")
    steps = scratch.write(ahead.unionByName(pairs.select(F.lit(False).alias("ahead"), (F.col("at") + 1).alias("at"), F.col("at").alias("to"), "copy")))
    while not steps.filter("copy").isEmpty():
        further = steps.select("ahead", F.col("at").alias("to"), F.col("to").alias("beyond"), F.col("copy").alias("again"))
        doubled = steps.filter("copy").join(further, ["ahead", "to"]).select("ahead", "at", F.col("beyond").alias("to"), F.col("again").alias("copy"))
        before, steps = steps, scratch.write(steps.filter("NOT copy").unionByName(doubled))
        scratch.drop(before)
    near = order.select("at", "explicit", "path")
    for ahead, name in ((False, "before"), (True, "after")):
        near = near.join(steps.filter(F.col("ahead") == ahead).select("at", F.col("to").alias(name)), "at", "left")
    # An article at an end of its host has both neighbours on one side.
    near = near.withColumns({"ahead": F.col("before").isNull(), "one": F.coalesce("before", "after")})
    near = near.withColumn("one", F.when(F.col("explicit") & (F.col("before").isNull() | F.col("after").isNull()), F.col("one")))
    near = lookup_join(scratch.write(near), steps.select("ahead", F.col("at").alias("one"), F.col("to").alias("two")), ["ahead", "one"], "left")
    near = near.select("at", F.coalesce("before", "two").alias("before"), F.coalesce("after", "two").alias("after"))
    near = scratch.write(near.filter("before IS NOT NULL OR after IS NOT NULL"))
    for name in ("before", "after"):
        theirs = order.select(F.col("at").alias(name), F.struct("path", "page").alias(f"{name}_page"))
        wide = scratch.write(lookup_join(near, theirs, [name], "left").drop(name))
        scratch.drop(near)
        near = wide
    both = order.join(near, "at").select(*page, "page", "before_page", "after_page")

    def differ(batches):
        for batch in few_lines(batches, ["page"], ["before_page", "page"], ["after_page", "page"]):
            explicit, path, mine, before, after = (c.to_pylist() for c in (batch.column(1), batch.column(2), *batch.columns[4:]))
            gone = []
            for article, own, lines, x, y in zip(explicit, path, mine, before, after, strict=True):
                neighbours = sorted((z for z in (x, y) if z is not None), key=lambda z: -len(commonprefix([own, z["path"]])))  # noqa: B023
                gone.append(lines_of_template(Lines(**lines), [Lines(**z["page"]) for z in neighbours], article))
            keep = pa.array([len(x) > 0 for x in gone], pa.bool_())
            columns = [*batch.columns[:4], pa.array(gone, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=[*page, "gone"])

    told = scratch.write(both.mapInArrow(differ, "host string, explicit boolean, path string, mark long, gone array<int>"))
    scratch.drop(order, pairs, steps, near)
    rest = lookup_join(parsed, told, page, "left")
    kept = F.filter("lines", lambda line, k: F.col("gone").isNull() | ~F.array_contains("gone", k))
    text = F.array_join(kept, " ")
    return rest.select(F.col("id").alias(id_column), F.col("url").alias(url_column), text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
