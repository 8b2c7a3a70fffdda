"""Text of web pages without the templates of their sites.

Each page is parsed to a tree of elements; the hash of an element is of its tag, its own text and the hashes of its
children. Per host, Spark counts among how many page contents each hash occurs. An element whose hash occurs among many contents of
its host (``MIN_PAGES`` and ``MIN_SHARE`` of them) is a template: it is deleted with all within it, and the text of the rest
is extracted, block by block. Elements of fewer than ``MIN_CHARS`` characters of text and the page as a whole (html, body,
head) are never templates.

The content of a page is its longest run of own text of an element, other than of elements on more than half of the pages
of a host of ``MANY_PAGES`` or more. Copies of one article count once, whatever surrounds them, and all keep it.

A host has few templates however many pages it has (at most elements a page / ``MIN_SHARE``), so they travel as one list
a host: broadcast while all lists together are small, else joined by host and a salt that spreads large hosts.

Defined cases: an empty table has no rows; a null or empty html has null or empty text; a page of any length is parsed
whole, in time that grows in proportion to it; a null or hostless url belongs to the host "" that has no
templates; repeated rows are one content; broken markup is read on as far as it goes (unclosed
elements end with their parent, unknown ends are skipped); further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.llm.common import stored, text_batches

MIN_PAGES, MIN_SHARE, MIN_CHARS = 3, 0.005, 15
#: A quarter of the hashes (8 bytes each) that all lists together may hold to be broadcast: 32 MB.
BROADCAST_ROWS = 1_000_000
#: Of an element on more than this share of a host's pages, if they are so many or more, the text is nobody's content.
MANY_PAGES, MOST_PAGES = 10, 0.5
_NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
#: The common tag, up to the next ``<`` at most.
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>")
_SIGNS = re.compile("[>\"']")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea svg iframe".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_WHOLE = frozenset(["html", "head", "body", ""])
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "parts", "hash", "chars")

    def __init__(self, tag: str):
        self.tag, self.parts, self.hash, self.chars = tag, [], 0, 0


class _Ends:
    """Where the tags of a page end: the first ``>`` outside quotes. Every sign is looked at a bounded number of times,
    however many tags have no end: places from where a search failed fail at once the next time."""

    def __init__(self, page: str):
        self.page = page
        self.signs = [m.start() for m in _SIGNS.finditer(page)]
        self.partner = [-1] * len(self.signs)
        last: dict[str, int] = {}
        for i in range(len(self.signs) - 1, -1, -1):
            c = page[self.signs[i]]
            self.partner[i] = last.get(c, -1)
            last[c] = i
        self.dead: set[int] = set()

    def after(self, at: int) -> int:
        """The place of the end of the tag whose name ends at ``at``, or -1."""
        i, seen = bisect_left(self.signs, at), []
        while i < len(self.signs) and i not in self.dead:
            if self.page[self.signs[i]] == ">":
                return self.signs[i]
            seen.append(i)
            if self.partner[i] < 0:
                break
            i = self.partner[i] + 1
        self.dead.update(seen)
        return -1


def _marks(page: str) -> Iterator[tuple[int, int, str, bool, bool]]:
    """(start, end, tag, is an end?, closes itself?) of each tag in order; comments and declarations have no tag. The caller
    sends the place to go on from, if it isn't the end."""
    ends, at, last = None, 0, page.rfind(">")
    while (at := page.find("<" if at <= last else "<!--", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
            mark = (at, end, "", False, False)
        elif (m := _TAG.match(page, at)) is not None:
            end = m.end()
            mark = (at, end, m[2].lower(), bool(m[1]), end - 1 > m.end(2) and page[end - 2] == "/")
        elif (m := _NAME.match(page, at)) is not None:
            ends = ends or _Ends(page)
            if (close := ends.after(m.end())) < 0:
                at += 1
                continue
            end = close + 1
            mark = (at, end, m[2].lower(), bool(m[1]), close > m.end() and page[close - 1] == "/")
        elif page.startswith(("<!", "<?"), at) and (end := page.find(">", at) + 1):
            mark = (at, end, "", False, False)
        else:
            at += 1
            continue
        at = (yield mark) or end


def parse(page: str) -> tuple[Element, list[Element]]:
    """The root and all elements, each with its hash and characters of text; ends come before their parents'. Time grows in
    proportion to the page, however broken it is."""
    root = Element("")
    stack, done = [root], []
    open_: dict[str, int] = {}
    blocks: list[int] = []

    def close() -> None:
        e = stack.pop()
        if stack:
            open_[e.tag] -= 1
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        sums = [e.tag]
        for p in e.parts:
            if isinstance(p, str):
                sums.append(p)
                e.chars += len(p)
            else:
                sums.append(f"\x00{p.hash}")
                e.chars += p.chars
        e.hash = xxhash.xxh3_64_intdigest("\x01".join(sums)) - (1 << 63)
        done.append(e)

    def said(begin: int, end: int) -> None:
        if text := _SPACE.sub(" ", entities.unescape(page[begin:end])):
            stack[-1].parts.append(text)

    at, marks = 0, _marks(page)
    mark = next(marks, None)
    while mark is not None:
        start, end, tag, is_end, alone = mark
        said(at, start)
        at = end
        if not tag:
            pass
        elif is_end:
            if open_.get(tag):
                while stack[-1].tag != tag:
                    close()
                close()
        elif tag in _RAW:
            if not alone:
                m = re.compile(f"</{tag}", re.I).search(page, at)
                at = (page.find(">", m.end()) + 1 or len(page)) if m else len(page)
        else:
            if blocks and tag in _CLOSES.get(stack[blocks[-1]].tag, ()):
                keep = blocks[-1]
                while len(stack) > keep:
                    close()
            e = Element(tag)
            stack[-1].parts.append(e)
            open_[tag] = open_.get(tag, 0) + 1
            if tag in _BLOCK:
                blocks.append(len(stack))
            stack.append(e)
            if tag in _VOID or alone:
                close()
        try:
            mark = marks.send(at)
        except StopIteration:
            mark = None
    said(at, len(page))
    while stack:
        close()
    return root, done


def candidates(done: list[Element]) -> set[int]:
    return {e.hash for e in done if e.chars >= MIN_CHARS and e.tag not in _WHOLE}


def text_of(root: Element, templates: frozenset[int] | set[int]) -> tuple[str, int]:
    """The text outside templates, a block a line, and the number of deleted subtrees."""
    out: list[str] = []
    deleted = 0
    todo: list = [root]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            out.append(e)
            continue
        if e.hash in templates and e.chars >= MIN_CHARS and e.tag not in _WHOLE:
            deleted += 1
            continue
        if e.tag in _BLOCK:
            out.append("\n")
            todo.append("\n")
        todo.extend(reversed(e.parts))
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x), deleted


def contents(done: list[Element]) -> list[tuple[int, int]]:
    """Hashes of each element's own text and of the element, from the longest text on."""
    own = ((e, "".join(p for p in e.parts if isinstance(p, str)).strip()) for e in done)
    found = sorted((-len(text), xxhash.xxh3_64_intdigest(text) - (1 << 63), e.hash) for e, text in own if text)
    return [(text, element) for _, text, element in found]


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, 1):
        done = [parse(h)[1] if h else [] for h in batch.column(1).to_pylist()]
        found = [sorted(candidates(d)) for d in done]
        own = [contents(d) for d in done]
        lists = [pa.array([[x[k] for x in row] for row in own], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), *lists], ["host", "hashes", "texts", "elements"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: tuple[object, frozenset[int]] = (None, frozenset())
    for batch in text_batches(batches, 2):
        texts, counts = [], []
        for host, page, templates in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
            if host != known[0]:
                known = (host, frozenset(templates.as_py() or ()))
            text, n = text_of(parse(page)[0], known[1]) if page else (page, 0)
            texts.append(text)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["page_id", "url", "text", "deleted"])


def host_of(url):
    """The host of a url in lower case; "" for none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _parsed(pages: DataFrame) -> DataFrame:
    """(host, hashes, texts, elements) of each page of a host."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''")
    return rows.mapInArrow(_hashes, "host string, hashes array<long>, texts array<long>, elements array<long>")


def _recurring(each: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    counted = each.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    sizes = each.groupBy("host").agg(F.count("*").alias("pages"))
    return counted.join(sizes, "host").where(F.col("n") >= F.lit(min_share) * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("templates"))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, templates): the hashes that recur on the pages of each host, each row a page."""
    return _recurring(_parsed(pages), min_pages, min_share)


def _with_lists(rows: DataFrame, per_host: DataFrame, salt: list[str], salts: int) -> DataFrame:
    """``rows`` with the ``templates`` of their hosts."""
    size = per_host.agg(F.sum(F.size("templates") + 1)).first()[0] or 0
    if size <= 4 * BROADCAST_ROWS:
        return rows.join(F.broadcast(per_host), "host", "left")
    salted = per_host.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*salt), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")


def content_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, salts: int = 32) -> DataFrame:
    """(host, templates): the hashes that recur among the distinct contents of each host's pages."""
    each = stored(_parsed(pages), "parsed")
    many = each.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MANY_PAGES)
    common = stored(_recurring(each, 1, MOST_PAGES + 1e-9).join(many, "host", "left_semi"), "common")
    own = F.filter(F.arrays_zip("texts", "elements"), lambda x: ~F.array_contains(F.coalesce("templates", F.array().cast("array<long>")), x["elements"]))
    keyed = _with_lists(each, common, ["hashes"], salts).select("host", "hashes", F.get(own, F.lit(0))["texts"].alias("content")).where("content is not null")
    merged = keyed.select("host", "content", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    sizes = keyed.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("contents"))
    return merged.join(sizes, "host").where(F.col("n") >= F.lit(min_share) * F.col("contents")).groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("templates"))


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, salts: int = 32) -> DataFrame:
    """(page_id, url, text, deleted) of each row."""
    per_host = stored(content_templates(pages, min_pages, min_share, salts), "templates")
    rows = _with_lists(pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")), per_host, ["page_id", "url"], salts)
    kinds = pages.schema
    schema = T.StructType([T.StructField("page_id", kinds["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("deleted", T.LongType())])
    return rows.select("page_id", "url", "html", "host", "templates").mapInArrow(_texts, schema)
