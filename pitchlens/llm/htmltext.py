"""Main text of web pages by comparing each page with the nearest page of its host.

Pages are sorted by host and URL path. Each is paired with the neighbour, of those with other lines, whose
URL shares the longer beginning; the text lines of both are aligned by their longest common subsequence, and lines that
they share are deleted as the site's frame. Elements that say what they are (navigation, adverts,
forms and so on) are left out, and lines in a page's article element are never deleted: copies of a
page, or of a passage, share lines that are content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.llm.common import table

# Elements and names by their role in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol"
    " optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
LEFT_OUT = set(
    "title script style noscript template iframe object svg nav footer aside form button select"
    " textarea dialog canvas audio video menu".split()
)
FRAME_NAMES = set(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie"
    " cookies cookie-notice cookie-banner cookie-consent consent notice notices gdpr popup modal newsletter subscribe signup sidebar aside nav"
    " navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments respond disqus"
    " share sharing social related pagination widget".split()
)
# Of names in several parts, such as comment-list or main-nav: the first part, or the last one, says it.
FRAME_FIRST = set("ad ads advert adverts comment comments cookie cookies share sharing social related sponsor sponsored".split())
FRAME_LAST = set(
    "ad ads advert adverts comments cookies footer nav navbar navigation sidebar breadcrumb breadcrumbs"
    " newsletter pagination popup share".split()
)
# Parts that say that a frame is not in the element itself, but beside it or nowhere.
BESIDE = set("no with without has open closed off disabled".split())
# Frames that are never around the article, though they may hold articles of their own.
NEVER_AROUND = set("comment comments respond disqus related ad ads advert adverts advertisement sponsored".split())
FRAME_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog".split())
# Elements that end where a like element starts.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
OTHER, FRAME, MAIN = 0, 1, 2


def frame_names(names: set[str]) -> set[str]:
    """The parts of class names and ids by which an element says that it is frame; ``header`` is one, too."""
    found = set()
    for name in names:
        parts = re.split(r"[-_]+", name)
        if name in FRAME_NAMES or name == "header" or name == "cookieconsent":
            found.add(name)
        elif len(parts) > 1 and not BESIDE & set(parts):
            found |= ({parts[0]} & FRAME_FIRST) | ({parts[-1]} & FRAME_LAST)
    return found


class _Lines(HTMLParser):
    """Splits a page into lines (one per block) with their kind.

    ``articles`` has, for each article or main element that is not in another one, how much text it
    holds and the numbers of the elements around it that are frame by their name. The elements ``spared``
    keep the kind of what they are in.
    """

    def __init__(self, spared: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.spared, self.elements = spared, 0
        self.named: list[tuple[int, int, bool]] = []  # depth, number, may hold the article: open elements so named
        self.articles: list[list] = []
        self.inside: int | None = None  # depth of the outermost open article
        self.open: list[tuple[str, int]] = []
        self.words: list[str] = []
        self.lines: list[tuple[str, int]] = []

    @property
    def kind(self) -> int:
        return self.open[-1][1] if self.open else OTHER

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.lines.append((text, self.kind))
            if self.inside is not None:
                self.articles[-1][0] += len(text)

    def leave(self, at: int) -> None:
        self.flush()
        self.close_from(at)

    def close_from(self, at: int) -> None:
        del self.open[at:]
        while self.named and self.named[-1][0] >= at:
            self.named.pop()
        if self.inside is not None and self.inside >= at:
            self.inside = None

    def around_the_article(self) -> frozenset[int]:
        """The elements around the largest article that are frame by their name, and should not be."""
        free = [(size, -i, around) for i, (size, around, may) in enumerate(self.articles) if may]
        return frozenset(max(free)[2]) if free else frozenset()

    def kind_of(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        given = dict(attrs)
        names = set(f"{given.get('class') or ''} {given.get('id') or ''}".lower().split())
        role = (given.get("role") or "").lower()
        main = tag in ("article", "main") or role in ("main", "article") or given.get("itemprop") == "articleBody"
        self.elements += 1
        outermost = tag in ("article", "main") and self.inside is None
        found = frame_names(names)
        if tag in ("html", "body", "main") or outermost or self.elements in self.spared:
            found = set()
        if outermost:
            self.articles.append([0, [n for _, n, _ in self.named], all(may for _, _, may in self.named)])
            self.inside = len(self.open)
        if found:
            self.named.append((len(self.open), self.elements, not found & NEVER_AROUND))
        if self.kind == FRAME or tag in LEFT_OUT:
            return FRAME
        if found - {"header"} or role in FRAME_ROLES:
            return FRAME
        if main:
            return MAIN
        if self.kind != MAIN and (tag == "header" or "header" in found):
            return FRAME
        return self.kind

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.words.append(" ")
        if tag in VOID:
            if tag in BLOCKS:
                self.flush()
            return
        ends = IMPLIED.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name in ends:
                self.leave(at)
            elif name in BLOCKS and name not in ("p",):
                break
        if tag in BLOCKS or tag in LEFT_OUT:
            self.flush()
        kind = self.kind_of(tag, attrs)
        if kind != self.kind:
            self.flush()
        self.open.append((tag, kind))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            name, kind = self.open[at]
            if name == tag:
                outer = self.open[at - 1][1] if at else OTHER
                if tag in BLOCKS or kind != outer or any(n in BLOCKS for n, _ in self.open[at:]):
                    self.leave(at)
                else:
                    self.close_from(at)
                return
            if tag not in BLOCKS and tag not in LEFT_OUT and name in BLOCKS:
                return  # a stray end of an inline element ends no block

    def handle_data(self, data: str) -> None:
        self.words.append(data)


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """The text lines of a page, one per block, each with its kind."""

    def parsed(spared: frozenset[int] = frozenset()) -> _Lines:
        parser = _Lines(spared)
        parser.feed(html or "")
        parser.close()
        parser.flush()
        return parser

    first = parsed()
    spared = first.around_the_article()
    return (parsed(spared) if spared else first).lines


def common_lines(a: list[str], b: list[str]) -> tuple[list[int], list[int]]:
    """Indices of a longest common subsequence of ``a`` and ``b``, by bit-parallel rows.

    A row is one large integer: bit j is 0 where the subsequence grows at ``b[j]``.
    """
    full = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    row, rows = full, []
    for line in a:
        hit = row & where.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j, left, right = len(a) - 1, len(b) - 1, [], []
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            left.append(i)
            right.append(j)
            i, j = i - 1, j - 1
    return left[::-1], right[::-1]


def main_text(own: list[tuple[str, int]], near: list[tuple[str, int]] | None) -> str:
    """Blocks of a page that are left after comparison with its nearest page.

    Lines in an article element stay. Of the others, frame elements go, and lines that the nearest
    page shares go. Where there is an article element, nothing outside it counts.
    """
    if any(kind == MAIN for _, kind in own):
        return "\n\n".join(t for t, kind in own if kind == MAIN)
    gone: set[int] = set()
    if near is not None:
        gone = set(common_lines([t for t, _ in own], [t for t, _ in near])[0])
    return "\n\n".join(t for i, (t, kind) in enumerate(own) if kind == OTHER and i not in gone)


def _shared_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pages in; each is compared with the nearest other one before or after it on its host."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                yield row | {"lines": page_lines(row.pop("html"))}

    def result(before: dict | None, page: dict, lines: list, after: dict | None) -> tuple:
        best, near = -1, None
        for other in (before, after):
            if other is not None and page["host"] is not None and other["host"] == page["host"]:
                close = _shared_start(page["path"], other["path"])
                if close > best:
                    best, near = close, other["lines"]
        return page["page_id"], page["url"], main_text(lines, near)

    def out(found: list[tuple]) -> pa.RecordBatch:
        ids, urls, texts = zip(*found)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    # Neighbours with the same lines, such as copies, tell nothing: a run of them is held, its lines once,
    # until the next page with other lines comes.
    before, run, found = None, [], []
    for page in rows():
        if run and (page["host"] != run[0]["host"] or page["lines"] != run[0]["lines"]):
            found += [result(before, p, run[0]["lines"], page) for p in run]
            before, run = run[-1] | {"lines": run[0]["lines"]}, []
        run.append(page if not run else page | {"lines": None})
        while len(found) >= 500:
            yield out(found[:500])
            found = found[500:]
    found += [result(before, p, run[0]["lines"], None) for p in run]
    for start in range(0, len(found), 500):
        yield out(found[start : start + 500])


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id``, ``url``, ``text`` (main text, empty if none) and ``n_chars`` of every row.

    Pages are dealt out by ranges of host and path, so a host with very many pages is spread over
    tasks; the first and the last page of a range have a neighbour on one side. A page is compared with
    the nearest page whose lines differ from its own: of a run of equal pages a task holds the lines once. A null page is empty; a page without a host is compared with none;
    repeated rows and rows without an id are rows like others; an empty table gives no rows.
    Further columns are not read.
    """
    url = F.col(url_col).cast("string")
    bare = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", "")
    placed = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        url.alias("url"),
        F.col(html_col).alias("html"),
        F.when(F.contains(url, F.lit("://")), F.substring_index(F.regexp_replace(bare, r"[/?#].*$", ""), "@", -1)).alias("host"),
        F.coalesce(F.regexp_replace(bare, r"^[^/?#]*", ""), F.lit("")).alias("path"),
    )
    placed = placed.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    return placed.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def html_query(spark, folder: str) -> DataFrame:
    """op8: all pages."""
    return extract(table(spark, folder, "pages"))
