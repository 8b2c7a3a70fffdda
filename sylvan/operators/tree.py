"""Trees of titled nodes as flat DataFrames: built from levels by windows, walked by joins and path arrays.

Nodes: ``doc_id, ord, level, parent_ord, depth, path, node_id, parent_node_id, title, text, line_start, line_end``; ``ord``
is the pre-order place from 1, ``path`` the ords from the root to the node itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions import text as X
from sylvan.operators.lineage import cut
from sylvan.operators.order import HEADS

#: Nodes of a document that go through one window; longer documents are cut into stretches.
STRETCH = 500_000


def with_parents(flat: DataFrame, max_level: int | None = None) -> DataFrame:
    """``flat`` (doc_id, ord, level, ...) with ``parent_ord``, ``depth`` and ``path``.

    A node's ancestors are, of the last nodes seen at each smaller level, those that no later node of a level smaller
    still has closed. ``max_level`` is the largest level, looked up if it isn't given. Of a document longer than ``STRETCH``
    each stretch is a window of its own, which starts from the last nodes of the stretches before.
    """
    longest, deepest = flat.agg(F.max("ord"), F.max("level")).first()
    max_level = max_level or deepest or 1
    level, inner = F.col("level"), range(1, max_level)
    own = lambda k: F.when(level == k, F.col("ord"))
    keys, rows = ["doc_id"], flat
    if (longest or 0) > STRETCH and inner:
        keys, rows = ["doc_id", "__stretch"], flat.withColumn("__stretch", F.floor((F.col("ord") - 1) / STRETCH))
        earlier = W.partitionBy("doc_id").orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
        ends = rows.groupBy(*keys).agg(*[F.max(own(k)).alias(f"__m{k}") for k in inner])
        ends = cut(ends.select(F.col("doc_id").alias("__d"), F.col("__stretch").alias("__s"), *[F.max(f"__m{k}").over(earlier).alias(f"__b{k}") for k in inner]), "ends")
        here = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__stretch") == F.col("__s"))
        rows = rows.join(F.broadcast(ends) if ends.count() <= HEADS else ends, here)
    so_far = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    last = lambda k: F.coalesce(F.last(own(k), ignorenulls=True).over(so_far), *([F.col(f"__b{k}")] if len(keys) > 1 else []), F.lit(0))
    lasts = F.array(*[last(k) for k in inner]) if inner else F.array(F.lit(0))
    open_ = F.filter(F.transform(F.slice(F.col("__lasts"), F.lit(1), F.greatest(level - 1, F.lit(0))), lambda x, i: F.when((x > 0) & (x > F.coalesce(F.array_max(F.slice(F.col("__lasts"), F.lit(1), i)), F.lit(0))), x)), lambda x: x.isNotNull())
    out = rows.withColumn("__lasts", lasts).withColumn("__open", open_)
    size = F.size("__open")
    return out.select(*flat.columns, F.when(size > 0, F.element_at("__open", -1)).alias("parent_ord"), size.alias("depth"), F.concat("__open", F.array("ord")).alias("path"))


def with_ids(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``node_id`` and ``parent_node_id``: 16 hex digits of the md5 of all normalised titles from the root,
    each with its number among equal siblings. Edits elsewhere leave an id as it is."""
    same = W.partitionBy("doc_id", "parent_ord", "__title").orderBy("ord")
    named = nodes.withColumn("__title", X.normal_title(F.col("title"))).withColumn("__part", F.concat("__title", F.lit("#"), (F.row_number().over(same) - 1).cast("string")))
    parts = named.select("doc_id", F.col("ord").alias("__o"), F.col("__part").alias("__p"))
    steps = named.select("doc_id", "ord", F.posexplode("path").alias("__i", "__o")).join(parts, ["doc_id", "__o"])
    ids = steps.groupBy("doc_id", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__p"))), lambda x: x["__p"]), "/").alias("__sig"))
    ids = ids.select("doc_id", "ord", F.substring(F.md5("__sig"), 1, 16).alias("node_id"))
    parents = ids.select("doc_id", F.col("ord").alias("parent_ord"), F.col("node_id").alias("parent_node_id"))
    return named.drop("__title", "__part").join(ids, ["doc_id", "ord"]).join(parents, ["doc_id", "parent_ord"], "left")


def shaped(flat: DataFrame, split: int | None = 8000, thin: int | None = None) -> DataFrame:
    """``flat`` as it is indexed: small subtrees thinned if asked for, then texts of more than ``split`` characters split.
    Only documents that need it pass through Python."""
    flat = flat.select("doc_id", *(F.col(c).cast("int").alias(c) for c in ("ord", "level")), "title", "text", *(F.col(c).cast("int").alias(c) for c in ("line_start", "line_end")))
    if thin:
        flat = thinned(flat, thin)
    if split:
        flat = cut(flat)
        long = flat.where(F.length("text") > split).select("doc_id").distinct()
        flat = flat.join(long, "doc_id", "left_anti").unionByName(split_oversized(flat.join(long, "doc_id", "left_semi"), split))
    return flat


def build(flat: DataFrame, max_level: int | None = None) -> DataFrame:
    """Levels to a whole tree with ids, summaries and content hashes. Places and ids are found by titles alone; texts join
    once, at the end."""
    bare = ["doc_id", "ord", "level", "title"]
    out = with_ids(with_parents(flat.select(*bare), max_level)).join(flat.drop("level", "title"), ["doc_id", "ord"])
    return out.withColumns({"summary": X.summary(F.col("text")), "content_hash": F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16)})


def leaves(nodes: DataFrame) -> DataFrame:
    inner = nodes.select("doc_id", F.col("parent_ord").alias("ord")).where("ord is not null").distinct()
    return nodes.join(inner, ["doc_id", "ord"], "left_anti")


def children(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Children of the nodes (doc_id, ord) of ``of``."""
    return nodes.join(of.select("doc_id", F.col("ord").alias("parent_ord")).distinct(), ["doc_id", "parent_ord"], "left_semi")


def siblings(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, sibling): pairs of nodes with one parent; roots of a document are siblings."""
    a = nodes.select("doc_id", F.coalesce("parent_ord", F.lit(0)).alias("__p"), "ord")
    b = nodes.select("doc_id", F.coalesce("parent_ord", F.lit(0)).alias("__p"), F.col("ord").alias("sibling"))
    return a.join(b, ["doc_id", "__p"]).where("ord <> sibling").drop("__p")


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, root, ord) of all nodes at or below the given (doc_id, ord)."""
    steps = nodes.select("doc_id", "ord", F.explode("path").alias("root"))
    return steps.join(roots.select("doc_id", F.col("ord").alias("root")).distinct(), ["doc_id", "root"], "left_semi").select("doc_id", "root", "ord")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, titles): titles from the root to the parent, joined."""
    titles = nodes.select("doc_id", F.col("ord").alias("__o"), "title")
    steps = nodes.select("doc_id", "ord", F.posexplode("path").alias("__i", "__o")).where("__o <> ord").join(titles, ["doc_id", "__o"])
    return steps.groupBy("doc_id", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "title"))), lambda x: x["title"]), " > ").alias("titles"))


def subtree_chars(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, chars): characters of a node and all below it, one more for each further node with text."""
    steps = nodes.select("doc_id", F.explode("path").alias("at"), "ord", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    own = F.sum("n") + F.sum(F.when((F.col("n") > 0) & (F.col("ord") != F.col("at")), 1).otherwise(0))
    return steps.groupBy("doc_id", F.col("at").alias("ord")).agg(own.cast("long").alias("chars"))


def description(nodes: DataFrame) -> DataFrame:
    """(doc_id, description): the first five titles and the first text of more than 20 characters, cut at 200."""
    first = F.min_by("text", F.when(F.length("text") > 20, F.col("ord")))
    head = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("title") != "", F.struct("ord", "title")))), 1, 5), lambda x: x["title"])
    got = nodes.groupBy("doc_id").agg(F.array_join(head, " > ").alias("t"), first.alias("x"))
    return got.select("doc_id", F.concat_ws(". ", F.when(F.col("t") != "", F.col("t")), F.substring("x", 1, 200)).alias("description"))


def meaningful_depth(nodes: DataFrame) -> DataFrame:
    """(doc_id, deep): whether some root has a child."""
    return nodes.groupBy("doc_id").agg((F.max("depth") >= 1).alias("deep"))


def toc(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, line): titles set in by depth."""
    return nodes.select("doc_id", "ord", F.concat(F.expr("repeat('  ', depth)"), F.coalesce("title", F.lit(""))).alias("line"))


def nested_json(nodes: DataFrame, fields: tuple[str, ...] = ("title", "node_id", "summary", "text", "line_start", "line_end")) -> DataFrame:
    """(doc_id, tree): each document's nodes one within the other, as JSON text with ``nodes`` last."""
    import json

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        roots: list[dict] = []
        at: dict[int, dict] = {}
        for r in pdf.sort_values("ord").to_dict("records"):
            node = {f: r[f].item() if hasattr(r[f], "item") else r[f] for f in fields} | {"nodes": []}
            at[r["ord"]] = node
            (at[int(r["parent_ord"])]["nodes"] if pd.notna(r["parent_ord"]) else roots).append(node)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "tree": [json.dumps(roots, ensure_ascii=False, separators=(",", ":"))]})

    out = T.StructType([T.StructField("doc_id", nodes.schema["doc_id"].dataType), T.StructField("tree", T.StringType())])
    return nodes.select("doc_id", "ord", "parent_ord", *fields).groupBy("doc_id").applyInPandas(run, out)


def without_text(nodes: DataFrame, *fields: str) -> DataFrame:
    return nodes.drop(*(fields or ("text",)))


def hard_split(texts: DataFrame, most: int = 8000) -> DataFrame:
    """(..., part, piece): texts cut every ``most`` characters; parts count from 1."""
    count = F.greatest(F.ceil(F.length("text") / F.lit(most)), F.lit(1)).cast("int")
    parts = texts.withColumn("part", F.explode(F.sequence(F.lit(1), count)))
    return parts.withColumn("piece", F.substring("text", (F.col("part") - 1) * most + 1, F.lit(most)))


def _boundary_parts(text: str, most: int) -> list[str]:
    """Whole paragraphs packed up to ``most`` characters; if one is longer, whole lines; if one is longer, a cut every
    ``most`` characters."""
    for joint in ("\n\n", "\n"):
        units = text.split(joint)
        if max(map(len, units)) > most:
            continue
        out = [units[0]]
        for u in units[1:]:
            if len(out[-1]) + len(joint) + len(u) > most:
                out.append(u)
            else:
                out[-1] += joint + u
        return out
    return [text[i : i + most] for i in range(0, len(text), most)]


def split_oversized(flat: DataFrame, most: int = 8000) -> DataFrame:
    """``flat`` (doc_id, ord, level, title, text, line_start, line_end) whose long texts become children ``title (part i)``;
    what was below such a node now is below its last part. Levels are spread so that parts fit between."""
    out = T.StructType([T.StructField("doc_id", flat.schema["doc_id"].dataType), *(T.StructField(n, T.IntegerType()) for n in ("ord", "level")), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("line_start", "line_end"))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, open_ = [], []  # open_: (level, levels added)
        for r in pdf.sort_values("ord").itertuples(index=False):
            while open_ and open_[-1][0] >= r.level:
                open_.pop()
            level = r.level + sum(x for _, x in open_)
            parts = _boundary_parts(r.text, most) if isinstance(r.text, str) and len(r.text) > most else []
            rows.append((r.doc_id, len(rows) + 1, level, r.title, "" if parts else r.text, r.line_start, r.line_end))
            for i, p in enumerate(parts, 1):
                rows.append((r.doc_id, len(rows) + 1, level + 1, f"{r.title} (part {i})", p, r.line_start, r.line_end))
            open_.append((r.level, 1 if parts else 0))
        return pd.DataFrame(rows, columns=out.names)

    return flat.select(*out.names).groupBy("doc_id").applyInPandas(run, out)


def thinned(flat: DataFrame, least: int = 15000) -> DataFrame:
    """``flat`` where a node whose whole subtree has fewer than ``least`` characters takes in all below it."""
    out = T.StructType([T.StructField("doc_id", flat.schema["doc_id"].dataType), *(T.StructField(n, T.IntegerType()) for n in ("ord", "level")), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("line_start", "line_end"))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [list(r) for r in pdf.sort_values("ord")[out.names].itertuples(index=False)]
        keep, i = [], 0
        while i < len(rows):
            end = i + 1
            while end < len(rows) and rows[end][2] > rows[i][2]:
                end += 1
            texts = [r[4] for r in rows[i:end] if r[4]]
            row = rows[i]
            if end > i + 1 and len("\n".join(texts)) < least:
                row[4], row[6] = "\n\n".join(texts), rows[end - 1][6]
                i = end
            else:
                i += 1
            keep.append([row[0], len(keep) + 1, *row[2:]])
        return pd.DataFrame(keep, columns=out.names)

    return flat.select(*out.names).groupBy("doc_id").applyInPandas(run, out)


def find(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def in_subtree(path: Column, ord_: Column) -> Column:
    return F.array_contains(path, ord_)


def stack_parents(levels: Iterator[int]) -> list[int]:
    """The definition of a parent, one level after the other (for tests): places from 1, 0 for none."""
    stack: list[tuple[int, int]] = []
    out = []
    for i, level in enumerate(levels, 1):
        while stack and stack[-1][0] >= level:
            stack.pop()
        out.append(stack[-1][1] if stack else 0)
        stack.append((level, i))
    return out
