"""Main text of web pages by differencing each page against the page with the nearest URL on its host.

A page is read into lines (blocks of text).  Pages stand in order of host and URL path, and each is compared with its
neighbours there: lines that the longest common subsequence of both pages' lines aligns are shared, and shared
lines outside an article are the site's furniture and are deleted.  A neighbour that shares nearly all lines which are not marked as
furniture is a mirror of the page and tells nothing, so the other one is asked.  Elements decide what differencing leaves open: lines
that differ from page to page and yet stand in menus, adverts or comments go, and lines of an article stay though another
page has the same passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_rank

#: Elements whose text is never shown as text, and elements that hold furniture.
HIDDEN = {"head", "title", "script", "style", "noscript", "template", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "dialog"}
#: What a head can hold: anything else ends it, as its end tag may be left out.
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
MARKED = {"nav", "header", "footer", "aside", "form", "menu"}
#: Elements of an article.
MAIN = {"article", "main"}
#: Elements inside a line of text.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that a paragraph end does not reach through.
SCOPES = {"article", "main", "section", "div", "body", "td", "li", "blockquote", "nav", "footer", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words in class, id or role that mark menus, notices, adverts, side bars and reader comments, and words that undo them.
FURNITURE = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe"}
#: Words that begin the names of other things too (``search-results``): they mark furniture alone or at the end.
LAST_ONLY = {"search", "header"}
UNDONE = {"no", "not", "has", "with", "without", "hide", "hidden", "js"}
#: Elements that a word in class or id can mark inside an article; what holds a line of text itself is part of it.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "details", "article", "fieldset", "center"}
#: On pages without an article a mark on an element that holds so much of the text is none.
WHOLE_PAGE = 0.9
#: A neighbour that shares so many of a page's unmarked lines is a mirror.
MIRROR = 0.9

FREE, KEPT, GONE = 0, 1, 2


def furniture_word(value: str) -> bool:
    """Whether a class, id or role marks furniture: whole tokens, or the first or last word of a hyphenated one (``no-sidebar`` does not)."""
    for token in value.lower().split():
        parts = [x for x in token.replace("_", "-").split("-") if x]
        if parts and parts[0] not in UNDONE and (parts[0] in FURNITURE - LAST_ONLY or parts[-1] in FURNITURE):
            return True
    return False


class Lines(HTMLParser):
    """Lines of a page, each with the marks of the elements it stands in.

    An article takes no mark from what stands around it.  A mark by name on an element around the page's first article, or without one any mark around
    nearly all of its text, is dropped: what wraps the page is no furniture.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Open elements: name, whether hidden, whether in an article, marks.
        self.open: list[tuple[str, bool, bool, tuple[int, ...]]] = []
        self.part: list[str] = []
        self.found: list[tuple[str, bool, tuple[int, ...]]] = []
        self.n_marks, self.void, self.worded, self.seen_main = 0, set(), set(), False

    def end_line(self) -> None:
        text = " ".join("".join(self.part).split())
        self.part = []
        _, hidden, kept, marks = self.open[-1] if self.open else ("", False, False, ())
        if text and not hidden:
            self.found.append((text, kept, marks))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.end_line()
        if tag not in IN_HEAD:
            self.end_head()
        if tag in VOID:
            return
        if tag == "p":  # a paragraph ends the one before it
            self.leave("p", SCOPES)
        _, hidden, kept, marks = self.open[-1] if self.open else ("", False, False, ())
        main = tag in MAIN or ("role", "main") in attrs
        if tag in HIDDEN:
            hidden = True
        elif tag not in ("html", "body") and not hidden:
            named = (not kept or tag in CONTAINERS) and any(v and furniture_word(v) for k, v in attrs if k in ("class", "id", "role"))
            if named or (tag in MARKED and not (tag == "header" and kept)):
                if tag not in MARKED:
                    self.worded.add(self.n_marks)
                marks, self.n_marks = (*marks, self.n_marks), self.n_marks + 1
            if main and not (self.seen_main and marks):
                if not self.seen_main:
                    self.void.update(self.worded.intersection(marks))
                    marks = ()
                self.seen_main = kept = True
        self.open.append((tag, hidden, kept, marks))

    def end_head(self) -> None:
        if self.open and self.open[-1][0] == "head":
            self.open.pop()

    def leave(self, tag: str, limits: set[str]) -> None:
        """Close the innermost element of this name, unless an element in ``limits`` stands before it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in limits:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        if tag not in VOID:
            self.leave(tag, set() if tag in ("html", "body") else {"article", "main", "body"} - {tag})

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self.end_head()
        self.part.append(data)

    def unknown_decl(self, data: str) -> None:
        pass

    def lines(self) -> list[tuple[str, int]]:
        """Each line with GONE (in marked elements), KEPT (in an article) or FREE."""
        held, total = [0] * self.n_marks, 0
        for text, _, marks in self.found:
            total += len(text)
            for m in marks:
                held[m] += len(text)
        void = self.void | ({m for m, n in enumerate(held) if n > WHOLE_PAGE * total} if not self.seen_main else set())
        return [(text, GONE if any(m not in void for m in marks) else KEPT if kept else FREE) for text, kept, marks in self.found]


def page_lines(html: str | None) -> list[tuple[str, int]]:
    p = Lines()
    p.feed(html or "")
    p.close()
    p.end_line()
    return p.lines()


def _last_row(x: list[int], y: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``x`` with each head of ``y`` (none of it first)."""
    places: dict[int, int] = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    full = row = (1 << len(y)) - 1
    for v in x:
        u = row & places.get(v, 0)
        row = ((row + u) | (row - u)) & full
    # Zero bits of the row up to place j count the length for y[:j+1].
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


#: Pairs of lines up to which the whole table is kept, as one bit each; larger ones are halved until they fit.
TABLE = 1 << 26


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; equal heads and tails are matched first.

    Rows of the table are bits of one integer, so a row costs a few operations on long integers.  Of large pairs only the
    last rows of two halves are kept and the pair is cut where they meet best, so memory grows with the lines, not with their pairs.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    out = list(range(head))
    if x and y and len(x) > 1 and len(x) * len(y) > TABLE:
        half = len(x) // 2
        both = _last_row(x[:half], y) + _last_row(x[half:][::-1], y[::-1])[::-1]
        cut = int(np.argmax(both))
        out += [head + i for i in shared_lines(x[:half], y[:cut])] + [head + half + i for i in shared_lines(x[half:], y[cut:])]
    elif x and y:
        places: dict[int, int] = {}
        for j, v in enumerate(y):
            places[v] = places.get(v, 0) | 1 << j
        full, row, rows = (1 << len(y)) - 1, (1 << len(y)) - 1, []
        for v in x:
            m = places.get(v, 0)
            u = row & m
            row = ((row + u) | (row - u)) & full
            rows.append(row)
        # Zero bits of row i up to place j count the length for x[:i+1] and y[:j+1].
        found, j = [], len(y) - 1
        for i in range(len(x) - 1, -1, -1):
            while j >= 0 and rows[i] >> j & 1:
                j -= 1
            if j < 0:
                break
            if i and not rows[i - 1] >> j & 1:
                continue
            found.append(head + i)
            j -= 1
        out += found[::-1]
    return out + list(range(len(a) - tail, len(a)))


def decided(lines: list[int], states: bytes, neighbours: list[list[int]]) -> list[int]:
    """Places of lines to delete because the nearest page that is no mirror has them too; lines of an article stay."""
    unmarked = sum(s != GONE for s in states)
    for other in neighbours:
        shared = shared_lines(lines, other)
        # A page of a line or two may well share them.
        if unmarked > 2 and sum(states[i] != GONE for i in shared) >= MIRROR * unmarked:
            continue
        return [i for i in shared if states[i] != KEPT]
    return []


def site_and_path(url: str | None) -> tuple[str, str]:
    """Host in lower case, and path; what cannot be read as a URL has an empty host and itself as path."""
    try:
        u = urlsplit(url or "")
        return (u.hostname or ""), u.path
    except ValueError:
        return "", url or ""


def _hashed(html: str | None) -> tuple[list[int], bytes]:
    """Hashes and states of a page's lines."""
    lines = page_lines(html)
    return [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in lines], bytes(s for _, s in lines)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_lines, n_shared, n_marked) per input row: the main text, lines joined by one newline.

    n_lines counts the page's lines, n_shared those that differencing deletes, n_marked those that differ from the
    neighbour's and go for their elements alone.  Character references are decoded, white space inside a line becomes one space.
    Null, empty and textless pages have an empty text.  A page that is alone on its host shares nothing.  Pages that tie in host and path
    stand in order of a hash of id and html; repeated rows are one page there, and mirrors of a page take nothing from it.
    Very long pages are compared whole, in memory that grows with their lines.  Null ids, urls and pages are allowed; an
    empty table gives no rows; other columns are not read, whatever their names.

    Only hashes of lines move to be compared: they are range-sorted by host and path, so a host with a third of all
    pages is spread over many tasks, and each page meets its two neighbours by its place in the order.
    """
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    key = F.xxhash64("page_id", "url", "html", F.col("page_id").isNull(), F.col("url").isNull()).alias("key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hosts = [site_and_path(u) for u in part.column(1).to_pylist()]
                lines = [_hashed(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([h for h, _ in hosts]), pa.array([p for _, p in hosts]), pa.array([x for x, _ in lines], pa.list_(pa.int64())), pa.array([x for _, x in lines], pa.binary())],
                    names=["key", "host", "path", "lines", "states"],
                )

    # Rows that repeat a page in full have one key and one place.
    hashed = pages.select(key, "url", "html").mapInArrow(read, "key long, host string, path string, lines array<long>, states binary").dropDuplicates(["key"])
    ranked = materialise(with_rank(hashed, "host", "path", "key"), "pages")
    near = [ranked.select((F.col("rank") + d).alias("rank"), F.col("host").alias(f"host{i}"), F.col("path").alias(f"path{i}"), F.col("lines").alias(f"lines{i}")) for i, d in enumerate((1, -1))]
    trio = ranked.join(near[0], "rank", "left").join(near[1], "rank", "left")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for host, path, lines, states, *other in zip(*(b.column(i).to_pylist() for i in range(1, 11)), strict=True):
                there = [(common_prefix(path, other[i + 1]), -i, other[i + 2]) for i in (0, 3) if other[i] == host and other[i + 1] is not None]
                out.append(decided(lines, states, [x[2] for x in sorted(there, key=lambda x: x[:2], reverse=True)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["key", "shared"])

    columns = ["key", "host", "path", "lines", "states", "host0", "path0", "lines0", "host1", "path1", "lines1"]
    shared = trio.select(columns).mapInArrow(align, "key long, shared array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, places, gone, counts = [], [], [], []
            for html in b.column(3).to_pylist():
                ls = page_lines(html)
                texts.append([t for t, s in ls if s != GONE])
                places.append([i for i, (_, s) in enumerate(ls) if s != GONE])
                gone.append([i for i, (_, s) in enumerate(ls) if s == GONE])
                counts.append(len(ls))
            kinds = ((texts, pa.list_(pa.string())), (places, pa.list_(pa.int32())), (gone, pa.list_(pa.int32())), (counts, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(x, t) for x, t in kinds)], names=["key", "page_id", "url", "texts", "places", "gone", "n_lines"])

    # Lines outside marked elements travel on to meet their page's decision; of the others only the places.
    lined = pages.select(key, "page_id", "url", "html").mapInArrow(cut, "key long, page_id long, url string, texts array<string>, places array<int>, gone array<int>, n_lines int")
    joined = lined.join(shared, "key", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<int>")))
    kept = F.filter("texts", lambda t, i: ~F.array_contains("shared", F.element_at("places", i + 1)))
    return joined.select("page_id", "url", F.array_join(kept, "\n").alias("text"), "n_lines", F.size("shared").alias("n_shared"), F.size(F.array_except("gone", "shared")).alias("n_marked"))


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n
