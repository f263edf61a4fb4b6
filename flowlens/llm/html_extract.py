"""Main text of web pages, by differencing pages with their nearest URLs.

``page_lines`` reads a page as its visible text blocks, each marked as lying in the page's declared main
content (``article``, ``main``), in an element that is furniture by its kind or name (menus, headers and
footers of the page, sidebars, notices, adverts, forms, reader comments), or elsewhere. Pages of a host
are paired with the neighbour whose URL path is nearest; the two pages' lines are aligned by longest
common subsequence, and shared lines are template. A page's text is its lines without furniture and
without template. The neighbour is the nearest page whose lines differ: a repeated row, or the same article under
another query string, would share every line, and a page without lines none. Alignment decides each line
by itself, also on pages that declare main content: a line that is not shared stays wherever it stands,
and a shared one stays only inside declared main content, as articles quote, copy and license one another
(5 % of the article lines of the test pages also stand in the nearest page). Furniture often differs
between neighbours (95 % of such lines there are shared with neither), so it goes by its markup. An
``article`` or ``main`` is content also inside an element whose class or id alone looks like furniture
(a layout wrapper), unless that element lies in declared content (reader comments, teasers).

Only line hashes and marks are sorted over all (host, path), so no html moves; ranges split a host of very
many pages. Pages are aligned inside their sorted range; those at its two ends, whose neighbour lies in another
range, are aligned afterwards with the page that each range keeps for the next one. The pages are then read
again: where no line lies elsewhere than in furniture or declared content, their text is complete at once, the
lines of the others (not their html) meet what the alignment says. Alignment takes memory in proportion to the
lines of two pages.

Defined results: null html is an empty page (empty text); null URLs share one empty host; rows that are
equal in id, URL and html get the same result each; an empty table gives an empty table; other columns
pass through, whatever their names; the html itself passes only on demand.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.lineage import written

FURNITURE, OTHER, MAIN = 0, 1, 2
_NAMED = 3  # furniture by class or id only, outside declared content; an article in it is content

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("head script style noscript template textarea svg math iframe object canvas video audio title".split())
_FURNITURE = frozenset("nav footer aside form menu dialog button select label fieldset".split())
_CLOSED_BY = {"p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disclaimer|disqus|footer|gdpr|login|masthead|menu|modal|nav\w*|newsletter|notice|notification|overlay|pager|pagination|"
    r"popup|promo\w*|recommend\w*|related|reply|replies|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])"
)
#: Words that may stand beside a furniture word in a name inside declared content: "related-posts" goes, "related-work" stays.
_GENERIC = frozenset(
    "area articles bar block bottom box button buttons container content embed footer form group header icons inline inner item items left links link list main module more nav outer page panel post posts right row section site slot "
    "stories thread title toggle top unit widgets wrap wrapper".split()
)
#: Elements that end at their end tag, or hold nothing but themselves where it is missing.
_MEDIA = frozenset("svg math iframe object canvas video audio noscript template".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[_-]\S*")  # says what stands beside the element, not what it is
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _furniture_name(value: str) -> bool:
    """Whether a class or id inside declared content names furniture as a whole: nothing but furniture words and generic ones."""
    return any(_NAMES.search(token) and all(part in _GENERIC or part.isdigit() or _NAMES.fullmatch(part) for part in re.split("[-_]+", token) if part) for token in value.split())


def _attribute_furniture(attributes: str, declared: bool = False) -> int:
    """FURNITURE for hidden elements and roles, _NAMED for classes and ids (inside ``declared`` content whole names only), else OTHER."""
    found = OTHER
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return FURNITURE
        if name in ("class", "id") and (_furniture_name if declared else _NAMES.search)(_LAYOUT.sub("", value)):
            found = _NAMED
    return found


def page_lines(page: str) -> list[tuple[int, str]]:
    """(mark, text) of each visible block, in page order."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the mark of what stands in them
    opened: Counter[str] = Counter()
    endless: set[str] = set()
    mark, at = OTHER, 0

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((FURNITURE if mark == _NAMED else mark, text))
            held.clear()

    def leave(depth: int) -> None:
        opened.subtract(name for name, _ in stack[depth:])
        del stack[depth:]

    while True:
        m = _TOKEN.search(page, at)
        held.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        if m[1]:
            if name in _BLOCKS:
                close()
            for depth in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[depth][0] == name:
                    leave(depth)
                    break
                if stack[depth][0] in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                    break  # a stray end tag does not leave the content
            mark = stack[-1][1] if stack else OTHER
            continue
        if name in _SKIPPED:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at) if not m[3].endswith("/") and name not in endless else None
            if end is None and not m[3].endswith("/"):
                endless.add(name)  # none from here on either
            at = end.end() if end else at if name == "head" or name in _MEDIA or m[3].endswith("/") else len(page)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in _BLOCKS:
            close()
            while stack and name in _CLOSED_BY.get(stack[-1][0], ()):
                leave(len(stack) - 1)
            # a block ends an open paragraph and what it holds
            nearest = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _BLOCKS), -1) if opened["p"] > 0 else -1
            if nearest >= 0 and stack[nearest][0] == "p":
                leave(nearest)
            mark = stack[-1][1] if stack else OTHER
        if name in _VOID or m[3].endswith("/"):
            continue
        inside = mark
        if name in ("article", "main"):
            if mark in (OTHER, MAIN) or mark == _NAMED and _attribute_furniture(m[3]) == OTHER:
                inside = MAIN
        elif inside != FURNITURE:
            # a form may stand around a whole page: an article in it is content
            by = _NAMED if name == "form" else FURNITURE if name in _FURNITURE or name == "header" and mark != MAIN else _attribute_furniture(m[3], mark == MAIN) if name not in ("body", "html") else OTHER
            if by != OTHER:
                inside = FURNITURE if mark == MAIN else min(mark, by) if mark == _NAMED else by
        if name in _BLOCKS or inside != mark:
            if inside != mark:
                close()
            mark = inside
        stack.append((name, mark))
        opened[name] += 1
    close()
    return out


TABLE_CELLS = 1 << 20


def _lengths(mine: list[int], other: np.ndarray) -> np.ndarray:
    """For each beginning of ``other`` the length of its longest common subsequence with ``mine``."""
    row = np.zeros(len(other) + 1, dtype=np.int32)
    for x in mine:
        step = np.where(other == x, row[:-1] + 1, row[1:])
        np.maximum.accumulate(step, out=row[1:])
    return row


def _common_places(mine: list[int], other: np.ndarray) -> list[int]:
    """Places in ``mine`` of a longest common subsequence: by a table where it is small, else by halves, in linear memory."""
    if not mine or not len(other):
        return []
    if len(mine) > 1 and len(mine) * len(other) > TABLE_CELLS:
        half = len(mine) // 2
        cut = int(np.argmax(_lengths(mine[:half], other) + _lengths(mine[:half - 1 : -1], other[::-1])[::-1]))
        return _common_places(mine[:half], other[:cut]) + [half + i for i in _common_places(mine[half:], other[cut:])]
    table = np.zeros((len(mine) + 1, len(other) + 1), dtype=np.int32)
    for i in range(len(mine) - 1, -1, -1):
        step = np.where(other == mine[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(step[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(mine) and j < len(other):
        if mine[i] == other[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def shared_lines(mine: list[int], other: list[int]) -> list[bool]:
    """Which of my lines lie on a longest common subsequence with the other page's.

    Common ends are taken off first; between them, lines that the other page lacks cannot be shared.
    """
    n, m, begin = len(mine), len(other), 0
    while begin < n and begin < m and mine[begin] == other[begin]:
        begin += 1
    tail = 0
    while tail < n - begin and tail < m - begin and mine[n - 1 - tail] == other[m - 1 - tail]:
        tail += 1
    out = [True] * begin + [False] * (n - begin - tail) + [True] * tail
    theirs, ours = set(other[begin : m - tail]), set(mine[begin : n - tail])
    a = [i for i in range(begin, n - tail) if mine[i] in theirs]
    b = np.array([x for x in other[begin : m - tail] if x in ours], dtype=np.int64)
    for i in _common_places([mine[i] for i in a], b):
        out[a[i]] = True
    return out


def nearness(path: str, other: str) -> tuple[int, int, int]:
    """How near two URL paths are: segments they begin with alike, then characters, then closeness in length."""
    alike = 0
    for x, y in zip(path.split("/"), other.split("/")):
        if x != y:
            break
        alike += 1
    same = next((i for i, (x, y) in enumerate(zip(path, other)) if x != y), min(len(path), len(other)))
    return alike, same, -abs(len(path) - len(other))


def nearest(page: dict, before: dict | None, after: dict | None) -> list[int] | None:
    """Lines of the nearer of the two neighbours in the page's host (of equals the one before); null if it has none."""
    near = [(nearness(page["path"], x["path"]), -i, x["lines"]) for i, x in enumerate((before, after)) if x and x["host"] == page["host"]]
    return max(near)[2] if near else None


def kept_text(marks: bytes, texts: list[str], shared: bytes | None) -> str:
    """The lines that are no furniture (``texts``), without those outside declared content that are ``shared``."""
    if not shared:
        return "\n".join(texts)
    held = (i for i, mark in enumerate(marks) if mark != FURNITURE)
    return "\n".join(t for i, t in zip(held, texts, strict=True) if marks[i] == MAIN or not shared[i])


_ROWS = 512
_PAGE = pa.struct([("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64()))])
_PAGE_DDL = "struct<host:string,path:string,lines:array<bigint>>"
_ALIGNED = {"key": pa.int64(), "shared": pa.binary(), "part": pa.int32(), "at": pa.int64(), "marks": pa.binary(), "page": _PAGE, "before": _PAGE, "after": _PAGE}
_ALIGNED_DDL = f"key bigint, shared binary, part int, at bigint, marks binary, page {_PAGE_DDL}, before {_PAGE_DDL}, after {_PAGE_DDL}"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, host, path, content hash, line hashes and marks of each page that has lines."""
    for batch in batches:
        for first in range(0, len(batch), _ROWS):
            part = batch.slice(first, _ROWS)
            lines, marks, content = [], [], []
            for page in part.column(0).to_pylist():
                blocks = page_lines(page or "")
                lines.append([xxhash.xxh3_64_intdigest(t) - (1 << 63) for _, t in blocks])
                marks.append(bytes(mark for mark, _ in blocks))
                content.append(xxhash.xxh3_64_intdigest(np.array(lines[-1], dtype=np.int64).tobytes()) - (1 << 63))
            columns = [pa.array(content, pa.int64()), pa.array(lines, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            found = pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=["key", "host", "path", "content", "lines", "marks"])
            yield found.filter(pa.array([bool(x) for x in lines], pa.bool_()))


def _decided(marks: bytes, page: dict, before: dict | None, after: dict | None) -> bytes | None:
    """A byte for each line of the page, whether it is shared with the nearest page; null if no line depends on it."""
    other = nearest(page, before, after) if OTHER in marks else None
    return bytes(shared_lines(page["lines"], other)) if other else None


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What sorted pages share. A page whose neighbour on one side lies in another range comes with the one that it
    knows; of the others only those come of which a line is shared."""
    from pyspark import TaskContext

    own, at = TaskContext.get().partitionId(), 0
    before: dict | None = None  # the page before the run
    pending: list[tuple[int, dict, bytes]] = []  # a run: pages of equal lines, one after the other
    done: list[tuple] = []

    def close(after: dict | None) -> None:
        nonlocal at
        for key, page, marks in pending:
            at += 1
            if before is None or after is None:
                done.append((key, None, own, at, marks, page, before, after))
            elif shared := _decided(marks, page, before, after):
                done.append((key, shared, own, at, None, None, None, None))
        pending.clear()

    def flush() -> Iterator[pa.RecordBatch]:
        for first in range(0, len(done), _ROWS):
            columns = zip(*done[first : first + _ROWS], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ALIGNED.values(), strict=True)], names=list(_ALIGNED))
        done.clear()

    for batch in batches:
        for first in range(0, len(batch), _ROWS):
            for key, host, path, lines, marks in zip(*(batch.column(i).slice(first, _ROWS).to_pylist() for i in (0, 1, 2, 4, 5)), strict=True):
                page = {"host": host, "path": path, "lines": lines}
                if pending and (pending[-1][1]["lines"] != lines or pending[-1][1]["host"] != host):
                    last = pending[-1][1]
                    close(page)
                    before = last
                pending.append((key, page, marks))
            yield from flush()
    close(None)
    yield from flush()


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pages at the ends of ranges share, with both neighbours known."""
    for batch in batches:
        for first in range(0, len(batch), _ROWS):
            key, *rest = (c.slice(first, _ROWS) for c in batch.columns)
            shared = [_decided(*row) for row in zip(*(c.to_pylist() for c in rest), strict=True)]
            yield pa.RecordBatch.from_arrays([key, pa.array(shared, pa.binary())], names=["key", "shared"])


def _render(complete: bool):
    """Rows (html, key, passed columns). ``complete``: texts of the pages that need no alignment; else the lines of those that do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), _ROWS):
                part = batch.slice(first, _ROWS)
                rows, marks, texts = [], [], []
                for i, page in enumerate(part.column(0).to_pylist()):
                    blocks = page_lines(page or "")
                    if complete != any(mark == OTHER for mark, _ in blocks):
                        rows.append(i)
                        marks.append(bytes(mark for mark, _ in blocks))
                        texts.append([t for mark, t in blocks if mark != FURNITURE])
                kept = part.take(pa.array(rows, pa.int64())).columns
                if complete:
                    yield pa.RecordBatch.from_arrays([*kept[2:], pa.array(["\n".join(t) for t in texts], pa.string())], names=[*part.schema.names[2:], "extracted"])
                else:
                    more = [pa.array(marks, pa.binary()), pa.array(texts, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*kept[1:], *more], names=[*part.schema.names[1:], "marks", "texts"])

    return run


def _finish(n_passed: int):
    """Rows (passed columns, marks, texts, shared): the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), _ROWS):
                part = batch.slice(first, _ROWS)
                rows = zip(*(c.to_pylist() for c in part.columns[n_passed:]), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:n_passed], pa.array([kept_text(*row) for row in rows], pa.string())], names=[*part.schema.names[:n_passed], "extracted"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", out_col: str = "main_text", keep_html: bool = False) -> DataFrame:
    """``pages`` with the main text of each page (empty where there is none), without its html unless ``keep_html``."""
    names = [c for c in pages.columns if keep_html or c != html_col]
    own = [f"c{i}" for i in range(len(names))]
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    html = F.col(html_col).cast("string")
    source = pages.select(
        html.alias("html"), F.xxhash64(F.col(id_col).cast("string"), url, html).alias("key"), F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"), *[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)],
    )
    types = {f.name: f.dataType.simpleString() for f in source.schema}
    ddl = ", ".join(f"`{c}` {types[c]}" for c in own)
    hashed = written(source.select("html", "key", "host", "path").mapInArrow(_hashes, "key bigint, host string, path string, content bigint, lines array<bigint>, marks binary"))
    # one sort over all hosts; ranges split large hosts; pages of equal lines stand together in each path
    ranged = hashed.repartitionByRange("host", "path", "content", "key").sortWithinPartitions("host", "path", "content", "key")
    aligned = written(ranged.mapInArrow(_align, _ALIGNED_DDL))
    ends = aligned.where("page IS NOT NULL")
    keep = [F.min_by("page", "at").alias("first"), F.min_by("after", "at").alias("second"), F.max_by("page", "at").alias("last"), F.max_by("before", "at").alias("last_but")]
    every, reverse = Window.orderBy("part"), Window.orderBy(F.desc("part"))  # one row for each range
    edges = ends.groupBy("part").agg(*keep).select(
        "part", F.coalesce(_other(F.lag("last").over(every), F.col("first")), F.lag("last_but").over(every)).alias("earlier"),
        F.coalesce(_other(F.lead("first").over(every), F.col("last")), F.lead("second").over(every)).alias("later"),
    )
    edges = edges.select("part", F.last("earlier", True).over(every).alias("earlier"), F.last("later", True).over(reverse).alias("later"))
    known = ends.join(edges, "part").select("key", "marks", "page", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))
    shared = aligned.where("page IS NULL").select("key", "shared").union(known.mapInArrow(_decide, "key bigint, shared binary").where("shared IS NOT NULL"))
    shared = shared.groupBy("key").agg(F.first("shared").alias("shared"))  # rows given twice
    read = source.select("html", "key", *own)
    complete = read.mapInArrow(_render(True), f"{ddl}, extracted string")
    open_pages = read.mapInArrow(_render(False), f"key bigint, {ddl}, marks binary, texts array<string>")
    met = open_pages.join(shared, "key", "left").select(*own, "marks", "texts", "shared").mapInArrow(_finish(len(own)), f"{ddl}, extracted string")
    return complete.union(met).select(*[F.col(o).alias(n) for n, o in zip(names, own, strict=True)], F.col("extracted").alias(out_col))


def _other(neighbour, page):
    """The neighbour, or null where it holds the page's own lines."""
    return F.when((neighbour["host"] != page["host"]) | (neighbour["lines"] != page["lines"]), neighbour)
