"""Parsers: documents (doc_id, text, ...) to flat nodes (doc_id, ord, level, title, text, line_start, line_end).

Line-based formats are window plans. Formats that need a parser of their own run in Arrow batches of whole files.
"""

from __future__ import annotations

import ast
import csv
import io
import json
import os
import re
import shutil
import subprocess
import tempfile
import warnings
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.operators.lineage import cut as cut_lineage

_KINDS = {
    "markdown": "md markdown mdx", "json": "json", "jsonl": "jsonl", "csv": "csv", "html": "html htm", "xml": "xml", "pdf": "pdf epub xps oxps fb2 cbz cbr", "doc": "doc", "docx": "docx", "excel": "xlsx xlsm xltx xltm", "text": "txt log rst",
    "code": "py java js jsx ts tsx c h cc cpp cxx hpp cs php go rb rs swift kt scala lua r sql sh bash el clj ex exs erl hs jl ml pl m css toml yaml yml dockerfile mk",
}
SOURCE_TYPES = {f".{ext}": kind for kind, exts in _KINDS.items() for ext in exts.split()}
#: Which scorers a source type is searched with.
PREFILTERS = {kind: ["fts"] for kind in _KINDS} | {"code": ["grep", "fts"], "jsonl": ["grep", "fts"], "json": ["grep"]}
#: Source types whose hierarchy tree search gains from.
TREE_TYPES = ("markdown", "json")


def source_type(extension: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in sorted(SOURCE_TYPES.items()) for x in pair])
    return F.coalesce(F.element_at(table, F.lower(extension)), F.lit("text"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, raw): lines from 1."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\f", "\n")
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("line", F.col("line") + 1)


def preprocessed(text: Column) -> Column:
    """One kind of line end, and at most one blank line together."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\f", "\n"), "\n{3,}", "\n\n")


def _in_order() -> W:
    return W.partitionBy("doc_id").orderBy("line")


def cut(marked: DataFrame, drop_preamble: bool = True) -> DataFrame:
    """Flat nodes of lines (doc_id, line, raw, level, title), ``level`` null but on headings: each node's text runs from
    its heading to the line before the next. Text before the first heading is dropped, or a node of its own."""
    scoped = marked.withColumn("scope", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(_in_order().rowsBetween(W.unboundedPreceding, 0)))
    if drop_preamble:
        scoped = scoped.where("scope > 0")
    got = scoped.groupBy("doc_id", "scope").agg(
        F.first("level", True).alias("level"), F.first("title", True).alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n").alias("text"), F.min("line").alias("line_start"), F.max("line").alias("line_end")
    )
    got = got.withColumns({"level": F.coalesce("level", F.lit(1)), "title": F.coalesce("title", F.lit("")), "text": F.regexp_replace("text", r"\A\s+|\s+\z", "")})
    if not drop_preamble:
        got = got.where("scope > 0 or text <> ''")
    return got.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("scope"))).select("doc_id", "ord", "level", "title", "text", "line_start", "line_end")


def outside_fences(rows: DataFrame) -> DataFrame:
    """Lines with ``open``: neither a fence nor within one."""
    fence = F.trim("raw").startswith("```")
    return rows.withColumn("open", ~fence & (F.sum(F.when(fence, 1).otherwise(0)).over(_in_order().rowsBetween(W.unboundedPreceding, 0)) % 2 == 0))


def markdown(docs: DataFrame, drop_preamble: bool = True) -> DataFrame:
    """Headings ``#`` to ``######`` outside fences."""
    rows = outside_fences(lines(docs))
    heading = F.col("open") & F.trim("raw").rlike(r"^#{1,6}\s+.+$")
    marks = F.regexp_extract(F.trim("raw"), r"^(#{1,6})\s+(.+)$", 1)
    return cut(rows.withColumns({"level": F.when(heading, F.length(marks)), "title": F.when(heading, F.trim(F.regexp_extract(F.trim("raw"), r"^(#{1,6})\s+(.+)$", 2)))}), drop_preamble)


_NUM = "一二三四五六七八九十百千万零"


def heading_level(raw: Column, before: Column, after: Column) -> Column:
    """Level of a plain-text heading line, null for others: the first rule that fits decides."""
    line = F.trim(raw)
    prefix = F.regexp_extract(line, r"^((?:\d+\.)+\d*)\s+(.+)$", 1)
    roman = F.regexp_extract(line, r"^([IVXLCDM]+)\.\s+(.+)$", 1)
    blank = F.coalesce(F.trim(before) == "", F.lit(True)) | F.coalesce(F.trim(after) == "", F.lit(True))
    return (
        F.when(line == "", F.lit(None))
        .when(line.rlike(f"^第[{_NUM}\\d]+[章节篇部]"), F.when(line.rlike("[章篇部]"), 1).otherwise(2))
        .when(line.rlike(f"^[{_NUM}]+[、.．]\\s*.+$"), 1)
        .when(line.rlike(f"^[（(][{_NUM}\\d]+[)）]\\s*.+$"), 2)
        .when(line.rlike(r"^(?:\d+\.)+\d*\s+[A-Za-z一-鿿]") & (F.length(line) < 80), F.size(F.split(F.regexp_replace(prefix, r"\.$", ""), r"\.")))
        .when(line.rlike(r"^\(?\d+\)\s+.+$"), 2)
        .when((roman != "") & roman.rlike("^(?:XX|X?(?:IX|IV|V?I{1,3}|V)|X)$"), 1)
        .when(line.rlike(r"^[A-Z][.)]\s+.+$") & (F.length(line) < 60), 2)
        .when(line.rlike(r"^[A-Z][A-Z\s\-:,&/]{2,}$") & (F.length(line) < 80) & blank, 1)
    )


def text_headings(docs: DataFrame, pages: bool = False) -> DataFrame:
    """(doc_id, line, raw, level, title) with levels on heading lines, underlined titles among them, and, with ``pages``,
    on page marks (``[PAGE 3]``)."""
    rows = outside_fences(lines(docs))
    w = _in_order()
    own = F.when(F.col("open"), heading_level(F.col("raw"), F.lag("raw").over(w), F.lead("raw").over(w)))
    if pages:
        own = F.when(F.trim("raw").rlike(_PAGE), 1).otherwise(own)
    rows = rows.withColumn("own", own)
    under = F.trim(F.lead("raw").over(w))
    marked = F.col("open") & F.col("own").isNull() & (F.trim("raw") != "") & (F.length(F.trim("raw")) < 80) & under.rlike(r"^[=\-~^+#]{3,}$") & ~F.trim("raw").rlike(r"^[=\-~^+#]{3,}$")
    level = F.when(marked, F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (("=", 1), ("-", 2), ("~", 3), ("^", 4)) for x in p]), F.substring(under, 1, 1)), F.lit(2))).otherwise(F.col("own"))
    title = F.trim("raw")
    if pages:
        title = F.regexp_replace(title, _PAGE, "Page $1")
    return rows.withColumns({"level": level, "title": F.when(level.isNotNull(), title)}).drop("own", "open")


def plain_text(docs: DataFrame, drop_preamble: bool = True, pages: bool = False) -> DataFrame:
    """Detected headings; a text without any is one root titled by the document's name."""
    clean = docs.select("doc_id", preprocessed(F.coalesce("text", F.lit(""))).alias("text"), *[c for c in ("doc_name",) if c in docs.columns])
    found = cut(text_headings(clean, pages), drop_preamble)
    name = F.col("doc_name") if "doc_name" in docs.columns else F.col("doc_id").cast("string")
    none = clean.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = none.select("doc_id", F.lit(1).alias("ord"), F.lit(1).alias("level"), name.alias("title"), "text", F.lit(1).alias("line_start"), F.size(F.split("text", "\n")).alias("line_end"))
    return found.unionByName(whole)


def paged_text(docs: DataFrame, most: int = 8000) -> DataFrame:
    """Texts (doc_id, text) with page marks: nodes at their headings, or at their pages where headings are so few that the
    nodes would hold more than ``most`` characters on average."""
    name = [c for c in ("doc_name",) if c in docs.columns]
    clean = docs.select("doc_id", preprocessed(F.coalesce("text", F.lit(""))).alias("text"), *name)
    heads = text_headings(clean).groupBy("doc_id").agg(F.count("level").alias("heads"))
    sparse = clean.join(heads, "doc_id").where(F.length("text") / (F.col("heads") + 1) > most).select("doc_id")
    return plain_text(clean.join(sparse, "doc_id", "left_anti")).unionByName(plain_text(clean.join(sparse, "doc_id", "left_semi"), pages=True))


def paragraphs(docs: DataFrame) -> DataFrame:
    """A node for each paragraph, titled by its first line up to 80 characters."""
    parts = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n")).alias("i", "raw")).withColumn("text", F.trim("raw")).where("text <> ''")
    ord_ = F.row_number().over(W.partitionBy("doc_id").orderBy("i"))
    return parts.select("doc_id", ord_.alias("ord"), F.lit(1).alias("level"), F.substring(F.element_at(F.split("text", "\n"), 1), 1, 80).alias("title"), "text", ord_.alias("line_start"), ord_.alias("line_end"))


_PAGE = r"^\[PAGE\s+(\d+)\]$"
_MODS = r"(?:(?:public|private|protected|internal|static|abstract|final|export|default|async)\s+)*"
CODE_RULES: dict[str, list[tuple[str, int]]] = {
    ".py": [(r"^(class\s+\w+.*)", 1), (r"^(\s*(?:async\s+)?def\s+\w+.*)", 2)],
    ".java": [(rf"^(\s*{_MODS}(?:class|interface)\s+\w+.*)", 1), (rf"^(\s*{_MODS}function\s+\w+.*)", 2), (rf"^(\s*{_MODS}(?!return\b|else\b|new\b|throw\b)(?:[\w<>\[\],]+\s+)+\w+\s*\(.*)", 2)],
    ".go": [(r"^(\s*type\s+\w+\s+(?:struct|interface).*)", 1), (r"^(\s*func\s+(?:\([^)]+\)\s+)?\w+.*)", 2)],
    ".html": [(rf"^\s*<h{n}.*>(.*)</h{n}>", n) for n in (1, 2, 3)] + [(r'^\s*<(?:div|section).*id="(.*)".*>', 2)],
    ".xml": [(r"^\s*<(\w+).*>\s*$", 1)],
}
for _ext in (".ts", ".js", ".cpp", ".cc", ".cs", ".php"):
    CODE_RULES[_ext] = CODE_RULES[".java"]


def code(docs: DataFrame, extension: str, drop_preamble: bool = True) -> DataFrame:
    """Classes and functions by the patterns of the language; ``xml`` is read the same way."""
    rows = lines(docs)
    level, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    line = F.rtrim("raw")
    for pattern, n in reversed(CODE_RULES.get(extension, [])):
        hit = line.rlike(pattern)
        level, title = F.when(hit, n).otherwise(level), F.when(hit, F.regexp_extract(line, pattern, 1)).otherwise(title)
    title = F.substring(F.trim(F.regexp_replace(F.trim(title), r"[:{]+$", "")), 1, 100)
    return cut(rows.withColumns({"level": level, "title": title}), drop_preamble)


def table_rows(table: DataFrame, doc_id: str, key: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of a table as nodes below a root of its columns: ``h: v; h: v`` without blanks, by order of ``key``. Rows are
    sorted over all tasks, and numbered from how many there are before each task's."""
    columns = columns or table.columns
    cells = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    sorted_ = cut_lineage(table.select(F.concat_ws("; ", *cells).alias("text"), F.col(key).alias("__key")).orderBy("__key").withColumn("__id", F.monotonically_increasing_id()).drop("__key"), "rows")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a task
    rows = sorted_.withColumn("__part", part).join(F.broadcast(before), "__part")
    rows = rows.select(F.lit(doc_id).alias("doc_id"), (F.col("__before") + place + 2).cast("int").alias("ord"), F.lit(2).alias("level"), "text")
    rows = rows.withColumn("title", F.when(F.col("text") != "", F.substring("text", 1, 80)).otherwise(F.concat(F.lit("Row "), F.col("ord"))))
    root = table.sparkSession.range(1).select(F.lit(doc_id).alias("doc_id"), F.lit(1).alias("ord"), F.lit(1).alias("level"), F.lit(doc_id).alias("title"), F.lit("Columns: " + ", ".join(columns)).alias("text"))
    return root.unionByName(rows.select(*root.columns)).withColumns({"line_start": F.col("ord"), "line_end": F.col("ord")}).select("doc_id", "ord", "level", "title", "text", "line_start", "line_end")


def conversations(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text): a root each, a node for each turn."""
    ord_ = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role")) + 1
    doc = F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("doc_id")
    rows = turns.select(doc, ord_.alias("ord"), F.lit(2).alias("level"), F.concat(F.lit("turn "), F.col("turn"), F.lit(" "), F.col("role")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    roots = turns.select("conv_id").distinct().select(doc, F.lit(1).alias("ord"), F.lit(1).alias("level"), F.concat(F.lit("conversation "), F.col("conv_id")).alias("title"), F.lit("").alias("text"))
    return roots.unionByName(rows).withColumns({"line_start": F.col("ord"), "line_end": F.col("ord")})


def html_native(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, text) with one ``<h1>``: its title and the text without tags, scripts and styles."""
    bare = F.regexp_replace("text", r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
    title = F.trim(F.regexp_replace(F.regexp_extract("text", r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"(?s)<[^>]*>", ""))
    return pages.select("doc_id", F.lit(1).alias("ord"), F.lit(1).alias("level"), title.alias("title"), body.alias("text"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))


# Formats with parsers of their own: functions of a text (or bytes) and a name to (level, title, text, first, last line).

Flat = list[tuple[int, str, str, int, int]]


def json_nodes(value: object, prefix: str = "", level: int = 1) -> Flat:
    """Containers have empty texts, scalars ``key: value``; titles are dotted paths."""
    out: Flat = []
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else [("value", value)]
    for k, v in items:
        path = f"{prefix}[{k}]" if isinstance(value, list) else f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict | list):
            out += [(level, path, "", 1, 1), *json_nodes(v, path, level + 1)]
        else:
            out.append((level, path, f"{k}: {v}" if isinstance(value, dict) else str(v), 1, 1))
    return out


def json_flat(text: str, name: str) -> Flat:
    try:
        return json_nodes(json.loads(text))
    except ValueError:
        return [(1, name, text, 1, text.count("\n") + 1)]


def jsonl_flat(text: str, name: str, key_field: str | None = None) -> Flat:
    out: Flat = []
    place = 0
    for number, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            continue
        try:
            record = json.loads(line)
        except ValueError:
            continue
        title, texts, below = f"record[{place}]", [], []
        if isinstance(record, dict):
            short = next((f"{k}: {v}" for k, v in record.items() if isinstance(v, str) and len(v) < 200), None)
            title = str(record[key_field]) if key_field in record else short or title
            for k, v in record.items():
                if isinstance(v, dict | list):
                    below += json_nodes(v, f"record[{place}].{k}", 2)
                else:
                    texts.append(f"{k}: {v}")
        else:
            texts = [str(record)]
        out += [(1, title, "\n".join(texts), number, number), *((a, b, c, number, number) for a, b, c, _, _ in below)]
        place += 1
    return out


def csv_flat(text: str, name: str) -> Flat:
    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        return [(1, name, "", 1, 1)]
    out: Flat = [(1, name, "Columns: " + ", ".join(rows[0]), 1, 1)]
    for i, row in enumerate(rows[1:], 2):
        line = "; ".join(f"{h}: {v}" for h, v in zip(rows[0], row, strict=False) if v.strip())
        out.append((2, line[:80] or f"Row {i}", line, i, i))
    return out


class _Headings(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.heads: list[list] = []
        self.skip, self.head = 0, False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.head = True
            self.heads.append([int(tag[1]), ""])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.head = False

    def handle_data(self, data):
        if not self.skip and (s := data.strip()):
            self.parts.append(s)
            if self.head:
                self.heads[-1][1] = (self.heads[-1][1] + " " + s).strip()


def html_flat(text: str, name: str, bare: int = 1) -> Flat:
    """Headings h1 to h6, each at the first later line that holds its title; without any, one node of level ``bare``."""
    p = _Headings()
    p.feed(text)
    p.close()
    found = "\n".join(p.parts).split("\n")
    marks, at = [], 0
    for level, title in p.heads:
        line = next((i for i in range(at, len(found)) if title and (title in found[i] or found[i] in title)), None)
        if line is not None:
            marks.append((level, title, line))
            at = line + 1
    if not marks:
        return [(bare, name, "\n".join(found), 1, len(found))]
    ends = [m[2] for m in marks[1:]] + [len(found)]
    return [(level, title, "\n".join(found[s:e]), s + 1, e) for (level, title, s), e in zip(marks, ends, strict=True)]


def python_flat(text: str, name: str) -> Flat:
    """Classes with bases and functions with arguments, from the syntax tree; broken sources have none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    marks = []

    def walk(node: ast.AST) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef):
                bases = ", ".join(ast.unparse(b) for b in x.bases)
                marks.append((1, f"class {x.name}" + (f"({bases})" if bases else ""), x.lineno))
            elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "async def" if isinstance(x, ast.AsyncFunctionDef) else "def"
                marks.append((2, f"{kind} {x.name}({ast.unparse(x.args)})" + (f" -> {ast.unparse(x.returns)}" if x.returns else ""), x.lineno))
            walk(x)

    walk(tree)
    rows = text.split("\n")
    marks.sort(key=lambda m: m[2])
    ends = [m[2] - 1 for m in marks[1:]] + [len(rows)]
    return [(level, title[:120], "\n".join(rows[s - 1 : e]), s, e) for (level, title, s), e in zip(marks, ends, strict=True)]


def treesitter_flat(text: str, name: str) -> Flat:
    """Classes and functions of the grammar package's tree, if it is installed; otherwise none, and patterns decide."""
    try:
        from tree_sitter_language_pack import get_parser
    except ModuleNotFoundError:
        return []
    kinds = {"class": 1, "interface": 1, "struct": 1, "enum": 1, "trait": 1, "impl": 1, "module": 1, "function": 2, "method": 2, "constructor": 2}
    marks: dict[int, tuple[int, str]] = {}
    todo = [get_parser(name.rpartition(".")[2]).parse(text.encode()).root_node]
    while todo:
        n = todo.pop()
        kind = n.type.split("_")[0]
        if kind in kinds and n.type.endswith(("definition", "declaration", "item", "specifier")):
            marks.setdefault(n.start_point[0] + 1, (kinds[kind], n.text.decode("utf-8", "replace").split("\n")[0].rstrip(" :{")[:120]))
        todo += n.children
    rows = text.split("\n")
    order = sorted(marks)
    return [(*marks[s], "\n".join(rows[s - 1 : e]), s, e) for s, e in zip(order, [x - 1 for x in order[1:]] + [len(rows)], strict=True)]


def config_flat(text: str, name: str) -> Flat:
    """TOML, and YAML where its package is installed, as value trees; broken or unread ones whole."""
    try:
        if name.endswith(".toml"):
            import tomllib

            return json_nodes(tomllib.loads(text))
        import yaml

        return json_nodes(yaml.safe_load(text))
    except (ModuleNotFoundError, ValueError):
        return [(1, name, text, 1, text.count("\n") + 1)]
    except Exception as broken:  # yaml's errors share no base with ValueError
        if type(broken).__module__.startswith("yaml"):
            return [(1, name, text, 1, text.count("\n") + 1)]
        raise


_OOXML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_flat(data: bytes, name: str) -> Flat:
    """Paragraphs of style ``heading n`` head the paragraphs below them."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out: list[list] = []
    for i, p in enumerate(body.iter(f"{_OOXML}p"), 1):
        text = "".join(t.text or "" for t in p.iter(f"{_OOXML}t")).strip()
        style = p.find(f"{_OOXML}pPr/{_OOXML}pStyle")
        m = re.match(r"(?i)heading\s*(\d)", style.get(f"{_OOXML}val", "") if style is not None else "")
        if m and text:
            out.append([int(m[1]), text, [text], i, i])
        elif text:
            if not out:
                out.append([1, name, [], i, i])
            out[-1][2].append(text)
            out[-1][4] = i
    return [(a, b, "\n".join(c), d, e) for a, b, c, d, e in out]


def excel_flat(data: bytes, name: str, most: int = 200) -> Flat:
    """A node a sheet: header, up to ``most`` rows and how many more there are."""
    z = zipfile.ZipFile(io.BytesIO(data))
    texts = []
    if "xl/sharedStrings.xml" in z.namelist():
        texts = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
    sheets = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")]
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out: Flat = []
    for i, (title, f) in enumerate(zip(sheets, files, strict=False), 1):
        rows = []
        for row in ET.fromstring(z.read(f)).iter(f"{_SHEET}row"):
            cells = []
            for c in row.iter(f"{_SHEET}c"):
                v = c.find(f"{_SHEET}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                cells.append(texts[int(v.text)] if v is not None and c.get("t") == "s" else v.text if v is not None else inline)
            if any(cells):
                rows.append(" | ".join(x or "" for x in cells))
        body = [*rows[: most + 1], *([f"... ({len(rows) - most - 1} more rows)"] if len(rows) > most + 1 else [])]
        out.append((1, f"{title} ({max(len(rows) - 1, 0)} rows)", "\n".join(body) or "(empty sheet)", i, i))
    return out or [(1, name, "(empty workbook)", 1, 1)]


def pdf(docs: DataFrame) -> DataFrame:
    """PDFs and e-books (doc_id, content), if the reader package is installed; unreadable ones are empty."""

    @F.pandas_udf("string")
    def text(content: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else pdf_headings(pdf_text(bytes(c), n or "")) for c, n in zip(content, name, strict=True)], dtype=object)

    return paged_text(docs.withColumn("text", text("content", F.col("doc_id").cast("string"))))


def pdf_text(data: bytes, name: str) -> str:
    """The pages that hold text, each after its mark; empty for a file that can't be read."""
    import pymupdf

    try:
        with pymupdf.open(stream=data, filetype=name.rpartition(".")[2] or "pdf") as book:
            pages = [p.get_text().strip() for p in book]
    except RuntimeError as why:
        warnings.warn(f"{name} can't be read: {why}", stacklevel=2)
        return ""
    return "\n".join(f"\n[PAGE {i}]\n{t}" for i, t in enumerate(pages, 1) if t)


#: Single words in capitals that head sections although they are short; others may be labels of tables.
SECTION_WORDS = frozenset("ABSTRACT APPENDIX BACKGROUND CONCLUSION CONCLUSIONS DISCUSSION EVALUATION EXPERIMENTS KEYWORDS LIMITATIONS METHODOLOGY METHODS MOTIVATION OVERVIEW REFERENCES RESULTS SUMMARY".split())
_CAPITALS = r"[A-Z][A-Z \t\-:,&/()]"


def pdf_headings(text: str) -> str:
    """Numbers alone on a line join the capital title on the next; capital titles of six letters or more, single words if
    long or known to head sections, get blank lines around them."""

    def apart(m: re.Match) -> str:
        title = m[1].strip()
        label = len(title.split()) == 1 and len(title) < 12 and title not in SECTION_WORDS
        return m[0] if label or len(title) < 6 else f"\n{title}\n"

    text = re.sub(rf"(?m)^[ \t]*(\d+(?:\.\d+)*\.?)[ \t]*\n[ \t]*({_CAPITALS}{{2,}})$", lambda m: ("\n" if m.start() else "") + f"{m[1]} {m[2].strip()}\n", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(rf"(?m)^[ \t]*({_CAPITALS}{{2,}})$", apart, text))


def doc_flat(data: bytes, name: str) -> Flat:
    """Old word-processor files through the first converter that is there."""
    with tempfile.NamedTemporaryFile(suffix=".doc") as f:
        f.write(data)
        f.flush()
        folder = tempfile.mkdtemp()  # the converter's own output, read here and removed
        office = ["--headless", "--convert-to", "txt:Text", "--outdir", folder]
        for tool in (["textutil", "-convert", "txt", "-stdout"], ["antiword"], ["catdoc"], ["libreoffice", *office], ["soffice", *office]):
            try:
                done = subprocess.run([*tool, f.name], capture_output=True, timeout=60)
            except (FileNotFoundError, subprocess.TimeoutExpired):
                continue
            written = os.path.join(folder, os.path.basename(f.name).removesuffix(".doc") + ".txt")
            if not done.returncode and (done.stdout.strip() or os.path.isfile(written)):
                raw = done.stdout
                if tool[0].endswith("office"):
                    with open(written, "rb") as made:
                        raw = made.read()
                shutil.rmtree(folder)
                text = raw.decode("utf-8", "replace")
                return [(1, name, text, 1, text.count("\n") + 1)]
        shutil.rmtree(folder)
    raise RuntimeError("no converter for .doc files is installed")


def html(docs: DataFrame) -> DataFrame:
    """Pages by their headings; those without any by the headings that their text shows."""
    found = files(docs, lambda text, name: html_flat(text, name, bare=0))
    bare = found.where("level = 0").select("doc_id", "text")
    if "doc_name" in docs.columns:
        bare = bare.join(docs.select("doc_id", "doc_name"), "doc_id")
    return found.where("level > 0").unionByName(plain_text(bare))


def files(docs: DataFrame, parse: Callable[[object, str], Flat], column: str = "text") -> DataFrame:
    """``parse`` over whole files (doc_id, ``column``) in Arrow batches; nulls have no nodes."""
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ord", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, *n) for d, x in zip(pdf["doc_id"], pdf[column], strict=True) if x is not None for i, n in enumerate(parse(x, str(d)), 1)]
            yield pd.DataFrame(rows, columns=out.names)

    return docs.select("doc_id", column).mapInPandas(run, out)


class Registry:
    """Source types to parsers (DataFrame to flat nodes); unknown ones are plain text. Callers may register their own."""

    def __init__(self) -> None:
        self.types = dict(SOURCE_TYPES)
        self.parsers: dict[str, Callable[[DataFrame], DataFrame]] = {
            "markdown": markdown, "text": plain_text, "xml": lambda d: code(d, ".xml"), "json": lambda d: files(d, json_flat), "jsonl": lambda d: files(d, jsonl_flat), "csv": lambda d: files(d, csv_flat), "html": html,
            "docx": lambda d: files(d, docx_flat, "content"), "excel": lambda d: files(d, excel_flat, "content"), "pdf": pdf, "doc": lambda d: files(d, doc_flat, "content"),
        }

    def register(self, extension: str, parse: Callable[[object, str], Flat] | Callable[[DataFrame], DataFrame], source_type: str | None = None, whole_frame: bool = False) -> None:
        kind = source_type or extension.lstrip(".")
        self.types[extension] = kind
        self.parsers[kind] = parse if whole_frame else lambda d: files(d, parse)

    def supported(self) -> list[str]:
        return sorted(self.types)

    def parse(self, docs: DataFrame, extension: str) -> DataFrame:
        kind = self.types.get(extension.lower(), "text")
        if kind != "code":
            return self.parsers.get(kind, plain_text)(docs)
        if extension in (".toml", ".yaml", ".yml"):
            return files(docs.withColumn("doc_id", F.col("doc_id")), lambda t, n, e=extension: config_flat(t, n + e))
        exact = files(docs, python_flat if extension == ".py" else lambda t, n, e=extension: treesitter_flat(t, n + e))
        rest = docs.join(exact.select("doc_id").distinct(), "doc_id", "left_anti")
        return exact.unionByName(code(rest, extension) if extension in CODE_RULES else plain_text(rest))
