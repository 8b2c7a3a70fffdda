"""Matching and scoring over postings: boolean expressions with BM25, substring and pattern scorers, normalising, routing.

An expression is one plan: each leaf selects its postings, one aggregation by node brings the leaves together, and the
boolean structure is a filter over which leaves are present.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvan.config import DOCUMENTED
from sylvan.functions import text as X
from sylvan.operators.lineage import cut, small_batches
from sylvan.plans.query import Cut, Leaf, Node

K1, B = 1.2, 0.75
#: Words of all queries of a batch (a word a query) up to which they are broadcast: some 100 MB.
BATCH_TERMS = 1_000_000
#: Scores of a block of documents in a batch (a few times 8 bytes each).
BLOCK_SCORES = 1_000_000


def _weight(weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for c, w in weights.items():
        out = F.when(F.col("col") == c, float(w)).otherwise(out)
    return out


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def leaf_rows(posts: DataFrame, leaf: Leaf) -> tuple[DataFrame, DataFrame]:
    """Instances (doc_id, node_id, col, dl, hits) of a leaf, and the rows its document frequency counts."""
    own = posts.where(F.col("col") == leaf.column) if leaf.column else posts
    if leaf.kind == "prefix":
        found = own.where(F.col("term").startswith(leaf.terms[0])).groupBy("doc_id", "node_id", "col", "dl").agg(F.sum("tf").alias("hits"))
        return found, found
    if leaf.kind == "term":
        found = own.where(F.col("term") == leaf.terms[0]).select("doc_id", "node_id", "col", "dl", F.col("tf").cast("long").alias("hits"))
        return found, found
    terms = leaf.terms if leaf.kind == "phrase" else (*leaf.terms, *leaf.others)
    lists = own.where(F.col("term").isin(*set(terms))).groupBy("doc_id", "node_id", "col", "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    lists = lists.where(reduce(lambda a, b: a & b, [F.map_contains_key("at", t) for t in set(terms)]))
    at = lambda t: F.element_at("at", F.lit(t))
    if leaf.kind == "phrase":
        starts = reduce(lambda a, b: F.array_intersect(a, b), [_shifted(at(t), i) for i, t in enumerate(terms)])
        found = lists.select("doc_id", "node_id", "col", "dl", F.size(starts).cast("long").alias("hits")).where("hits > 0")
        return found, found
    near = reduce(lambda a, b: F.filter(a, lambda p: F.exists(at(b), lambda q: (F.abs(p - q) <= leaf.distance + 1) & (p != q))), leaf.others, at(leaf.terms[0]))
    found = lists.select("doc_id", "node_id", "col", "dl", F.size(near).cast("long").alias("hits")).where("hits > 0")
    return found, own.where(F.col("term") == leaf.terms[0])


def bm25(posts: DataFrame, stats: DataFrame, expression: Node | Leaf | None, weights: dict[str, float] = DOCUMENTED, doc_ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, score) of the nodes that match. Frequencies are of the whole index; ``doc_ids`` only filters."""
    if expression is None:
        return posts.select("doc_id", "node_id", F.lit(0.0).alias("score")).limit(0)
    leaves: list[Leaf] = []
    scored: set[int] = set()

    def condition(tree: Node | Leaf, counts: bool) -> Column:
        if isinstance(tree, Leaf):
            if tree not in leaves:
                leaves.append(tree)
            i = leaves.index(tree)
            if counts:
                scored.add(i)
            return F.col(f"c{i}").isNotNull()
        if tree.op == "not":
            return condition(tree.parts[0], counts) & ~condition(tree.parts[1], False)
        parts = [condition(p, counts) for p in tree.parts]
        return reduce((lambda a, b: a & b) if tree.op == "and" else (lambda a, b: a | b), parts)

    matches = condition(expression, True)
    rows, frequencies = [], []
    for i, leaf in enumerate(leaves):
        found, counted = leaf_rows(posts, leaf)
        rows.append(found.select("doc_id", "node_id", "dl", F.lit(i).alias("leaf"), (_weight(weights) * F.col("hits")).alias("f")))
        frequencies.append(counted.select("doc_id", "node_id").distinct().agg(F.count("*").alias("df")).withColumn("leaf", F.lit(i)))
    own = lambda name: [F.when(F.col("leaf") == i, F.col(name)) for i in range(len(leaves))]
    each = reduce(DataFrame.unionByName, rows).groupBy("doc_id", "node_id").agg(F.max("dl").alias("dl"), *[F.sum(x).alias(f"f{i}") for i, x in enumerate(own("f"))])
    dfs = reduce(DataFrame.unionByName, frequencies).agg(*[F.max(x).alias(f"df{i}") for i, x in enumerate(own("df"))])
    each = each.crossJoin(F.broadcast(dfs)).crossJoin(F.broadcast(stats))  # one row each
    wide = each.select("doc_id", "node_id", *[bm25_part(F.col("n"), F.col(f"df{i}"), F.col(f"f{i}"), F.col("dl"), F.col("avgdl")).alias(f"c{i}") for i in range(len(leaves))])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"c{i}"), F.lit(0.0)) for i in sorted(scored)])
    out = wide.where(matches).select("doc_id", "node_id", total.alias("score"))
    return out.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi") if doc_ids is not None else out


def bm25_part(n: Column, df: Column, f: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.greatest(F.lit(1e-6), F.log((n - df + 0.5) / (df + 0.5)))
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def _asked(queries: DataFrame, how: Cut) -> DataFrame:
    """(query_id, term): the distinct words of plain queries, as a table."""
    squeezed = F.transform(F.split(F.coalesce("query", F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"(?U)[^\w]", ""))
    kept = F.filter(squeezed, lambda w: ~F.upper(w).isin("AND", "OR", "NOT", "NEAR"))
    return cut(queries.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform(kept, lambda w: X.index_tokens(w, how.mode, how.dictionary))))).alias("term")))


def bm25_batch(posts: DataFrame, stats: DataFrame, queries: DataFrame, weights: dict[str, float] = DOCUMENTED, how: Cut | None = None) -> DataFrame:
    """(query_id, doc_id, node_id, score) of plain queries (query_id, query), all at once.

    The queries' words (with their frequencies) are the small side: as long as its size, counted, allows, it is broadcast
    and the postings stay where they are, whatever words are frequent; beyond that the join shuffles, and skew is split."""
    asked = _asked(queries, how or Cut())
    wanted = asked.select("term").distinct()
    small = F.broadcast if asked.count() <= BATCH_TERMS else (lambda df: df)
    own = posts.join(small(wanted), "term", "left_semi")
    df = own.select("term", "doc_id", "node_id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    side = cut(asked.join(df, "term").groupBy("term", "df").agg(F.sort_array(F.collect_list("query_id")).alias("ids")))
    hits = own.groupBy("term", "doc_id", "node_id", "dl").agg(F.sum(_weight(weights) * F.col("tf")).alias("f"))
    parts = hits.join(small(side), "term").crossJoin(F.broadcast(stats)).select("ids", "doc_id", "node_id", bm25_part(F.col("n"), F.col("df"), F.col("f"), F.col("dl"), F.col("avgdl")).alias("p"))
    return parts.select(F.explode("ids").alias("query_id"), "doc_id", "node_id", "p").groupBy("query_id", "doc_id", "node_id").agg(F.sum("p").alias("score"))


def _best_documents(starts: np.ndarray, owners: np.ndarray, queries: int, k: int):
    """Rows (doc_id, node_id, no, p) in the order of documents and nodes to the nodes of each query's ``k`` best documents
    among them: (q, doc_id, node_id, score, best, nine). The queries of word ``no`` are ``owners[starts[no]:starts[no + 1]]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(queries, -1.0)  # of a query's k-th best document so far
        tops: dict[int, list[tuple]] = {}

        def block(rows: pa.Table, doc: np.ndarray, node: np.ndarray) -> None:
            doc, node = doc - doc[0], node - node[0]
            no, p = rows.column("no").to_numpy(), rows.column("p").to_numpy()
            n = starts[no + 1] - starts[no]
            at = np.repeat(starts[no] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat(node * queries, n) + owners[at]
            nodes = int(node[-1]) + 1
            scores = np.bincount(cell, np.repeat(p, n), nodes * queries)
            scores[np.bincount(cell, minlength=nodes * queries) == 0] = -1.0
            scores = scores.reshape(nodes, queries)
            first = np.flatnonzero(np.diff(node, prepend=-1))
            edges = np.append(np.flatnonzero(np.diff(doc[first], prepend=-1)), nodes)
            best = np.maximum.reduceat(scores, edges[:-1], axis=0)
            nine = np.round(best, 9)
            for _ in range(min(k, len(nine))):
                top = nine.argmax(axis=0)  # of equal ones the first in order
                value = nine[top, np.arange(queries)]
                for q in np.flatnonzero(value > least).tolist():
                    d = int(top[q])
                    own = np.arange(edges[d], edges[d + 1])
                    own = own[scores[own, q] >= 0]
                    took = rows.take(pa.array(first[own])).select(["doc_id", "node_id"])
                    held = tops.setdefault(q, [])
                    held.append((float(value[q]), float(best[d, q]), took, scores[own, q]))
                    held.sort(key=lambda x: -x[0])  # stable: of equal ones the earlier document stays
                    del held[k:]
                    if len(held) == k:
                        least[q] = held[-1][0]
                nine[top, np.arange(queries)] = -2.0

        def blocks(rows: pa.Table, doc: np.ndarray, node: np.ndarray) -> None:
            """Whole documents, of some million scores at a time."""
            work = np.cumsum(starts[rows.column("no").to_numpy() + 1] - starts[rows.column("no").to_numpy()] + np.diff(node, prepend=-1) * queries)
            heads = np.flatnonzero(np.diff(doc, prepend=-1))
            cuts = [0, *heads[np.flatnonzero(np.diff(work[heads] // BLOCK_SCORES)) + 1].tolist(), len(doc)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                block(rows.slice(begin, end - begin), doc[begin:end], node[begin:end])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            codes = [rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in ("doc_id", "node_id")]
            new = np.append(True, np.diff(codes[0]) != 0)
            doc = np.cumsum(new) - 1
            node = np.cumsum(new | np.append(True, np.diff(codes[1]) != 0)) - 1
            last = int(np.flatnonzero(new)[-1])  # its document may go on
            if last:
                blocks(rows.slice(0, last), doc[:last], node[:last])
            held = rows.slice(last)
        if held is not None:
            codes = held.column("node_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            block(held, np.zeros(len(codes), np.int64), np.cumsum(np.append(True, np.diff(codes) != 0)) - 1)
        for q, found in tops.items():
            for nine, best, took, scores in found:
                n = len(scores)
                yield pa.RecordBatch.from_arrays([pa.array([q] * n, pa.int32()), *(c.combine_chunks() for c in took.columns), pa.array(scores), pa.array([best] * n), pa.array([nine] * n)], ["q", "doc_id", "node_id", "score", "best", "nine"])

    return run


def batch_routed(posts: DataFrame, stats: DataFrame, queries: DataFrame, k: int, weights: dict[str, float] = DOCUMENTED, how: Cut | None = None) -> DataFrame:
    """(query_id, doc_id, node_id, score, best, doc_rank): the nodes found in each query's ``k`` best documents.

    Few documents of the many that hold some word of a query are kept, so scores aren't written out: postings of the
    queries' words come together by document, are scored there against all queries, and a task returns its best."""
    asked = _asked(queries, how or Cut())
    rank = lambda best: F.dense_rank().over(W.partitionBy("query_id").orderBy(F.desc(best), "doc_id"))
    if asked.count() > BATCH_TERMS:
        raw = cut(bm25_batch(posts, stats, queries, weights, how))
        best = raw.groupBy("query_id", "doc_id").agg(F.max("score").alias("best")).withColumn("doc_rank", rank(F.round("best", 9))).where(F.col("doc_rank") <= k)
        return raw.join(best, ["query_id", "doc_id"]).select("query_id", "doc_id", "node_id", "score", "best", "doc_rank")
    small_batches(posts.sparkSession)
    ids = sorted({r[0] for r in asked.select("query_id").distinct().collect()}, key=lambda x: (x is not None, x))
    place = {x: i for i, x in enumerate(ids)}
    words: dict[str, list[int]] = {}
    for r in asked.toLocalIterator():
        words.setdefault(r["term"], []).append(place[r["query_id"]])
    terms = sorted(words)
    starts = np.cumsum([0] + [len(words[w]) for w in terms]).astype(np.int64)
    owners = np.array([q for w in terms for q in sorted(words[w])], np.int64)
    spark = posts.sparkSession
    numbers = F.broadcast(spark.createDataFrame(list(zip(terms, range(len(terms)), strict=True)), "term string, no int"))
    own = posts.where("doc_id is not null").join(numbers, "term")
    df = F.broadcast(cut(own.select("no", "doc_id", "node_id").distinct().groupBy("no").agg(F.count("*").alias("df"))))
    hits = own.select("no", "doc_id", "node_id", "dl", (_weight(weights) * F.col("tf")).alias("f")).repartition("doc_id").groupBy("doc_id", "node_id", "no", "dl").agg(F.sum("f").alias("f"))
    parts = hits.join(df, "no").crossJoin(F.broadcast(stats)).select("doc_id", "node_id", "no", bm25_part(F.col("n"), F.col("df"), F.col("f"), F.col("dl"), F.col("avgdl")).alias("p"))
    kind = {c: posts.schema[c].dataType.simpleString() for c in ("doc_id", "node_id")}
    got = parts.sortWithinPartitions("doc_id", "node_id", "no").mapInArrow(_best_documents(starts, owners, len(ids), k), f"q int, doc_id {kind['doc_id']}, node_id {kind['node_id']}, score double, best double, nine double")
    named = spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    got = got.join(F.broadcast(named), "q").withColumn("doc_rank", rank("nine")).where(F.col("doc_rank") <= k)
    return got.select("query_id", "doc_id", "node_id", "score", "best", "doc_rank")


def like(nodes: DataFrame, keywords: list[str], weights: dict[str, float] = DOCUMENTED) -> DataFrame:
    """Sum of the weights of the columns that hold a keyword as a substring."""
    parts = [F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(k.lower())), float(w)).otherwise(0.0) for k in keywords for c, w in weights.items() if c in nodes.columns]
    return nodes.select("doc_id", "node_id", reduce(lambda a, b: a + b, parts, F.lit(0.0)).alias("score")).where("score > 0")


def grep(nodes: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """1.0 for each node whose title, summary or text holds the query."""
    cols = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "summary", "text") if c in nodes.columns]
    if regex:
        re.compile(query)
        hit = [c.rlike(query if case_sensitive else f"(?iu){query}") for c in cols]
    else:
        hit = [F.contains(c if case_sensitive else F.lower(c), F.lit(query if case_sensitive else query.lower())) for c in cols]
    return nodes.where(reduce(lambda a, b: a | b, hit)).select("doc_id", "node_id", F.lit(1.0).alias("score"))


def grep_lines(lines: DataFrame, nodes: DataFrame, pattern: str) -> DataFrame:
    """Matching lines (doc_id, line, raw) counted by the nodes whose line range holds them, as a share of the document's
    largest count."""
    hits = lines.where(F.col("raw").rlike(f"(?iu){pattern}")).select("doc_id", "line")
    counted = hits.join(nodes.select("doc_id", "node_id", "line_start", "line_end"), "doc_id").where("line between line_start and line_end").groupBy("doc_id", "node_id").agg(F.count("*").alias("n"))
    return counted.select("doc_id", "node_id", (F.col("n") / F.max("n").over(W.partitionBy("doc_id"))).alias("score"))


def grep_count(nodes: DataFrame, pattern: str) -> DataFrame:
    """Matches of a pattern in a node's text, as a share of the largest number in its document."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"(?iu){pattern}"))
    got = nodes.select("doc_id", "node_id", n.alias("n")).where("n > 0")
    return got.select("doc_id", "node_id", (F.col("n") / F.max("n").over(W.partitionBy("doc_id"))).alias("score"))


def combined(*scores: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, scores).groupBy("doc_id", "node_id").agg(F.sum("score").alias("score"))


def phrase_boosted(top: DataFrame, phrase: DataFrame, boost: float = 1.5) -> DataFrame:
    """Scores of the chosen nodes, raised where the phrase matches too."""
    marked = phrase.select("doc_id", "node_id", F.lit(True).alias("__p"))
    return top.join(marked, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.when(F.col("__p"), F.col("score") * boost).otherwise(F.col("score")).alias("score"))


def normalised(scores: DataFrame) -> DataFrame:
    """Scores as shares of the best of their document."""
    best = F.max("score").over(W.partitionBy("doc_id"))
    return scores.select("doc_id", "node_id", F.when(best > 0, F.col("score") / best).otherwise(0.0).alias("score"))


def propagated(scores: DataFrame, nodes: DataFrame, decay: float = 0.6) -> DataFrame:
    """Normalised scores where each parent gains ``decay`` times its best child's, one step, from the scores before;
    normalised again where a document passes 1; 6 decimals."""
    up = scores.join(nodes.select("doc_id", "node_id", "parent_node_id"), ["doc_id", "node_id"]).where("parent_node_id is not null").groupBy("doc_id", F.col("parent_node_id").alias("node_id")).agg((F.lit(decay) * F.max("score")).alias("score"))
    total = scores.unionByName(up).groupBy("doc_id", "node_id").agg(F.sum("score").alias("score"))
    best = F.greatest(F.max("score").over(W.partitionBy("doc_id")), F.lit(1.0))
    return total.select("doc_id", "node_id", F.round(F.col("score") / best, 6).alias("score"))


def doc_aggregate(scores: DataFrame, candidates: int = 200, top_k: int = 20) -> DataFrame:
    """(doc_id, hit_count, best_score, avg_score) over the best nodes, best documents first."""
    best = scores.orderBy(F.desc("score"), "doc_id", "node_id").limit(candidates)
    return best.groupBy("doc_id").agg(F.count("*").alias("hit_count"), F.max("score").alias("best_score"), F.avg("score").alias("avg_score")).orderBy(F.desc("best_score"), "doc_id").limit(top_k)


def routed(scores: DataFrame, top_k: int = 3) -> DataFrame:
    """(doc_id, best, doc_rank) of the best documents by raw score."""
    best = scores.groupBy("doc_id").agg(F.max("score").alias("best")).orderBy(F.desc(F.round("best", 9)), "doc_id").limit(top_k)
    return best.withColumn("doc_rank", F.row_number().over(W.orderBy(F.desc(F.round("best", 9)), "doc_id")))


def term_idf(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, term, idf): smooth inverse frequency within each document, by substrings."""
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    each = nodes.select("doc_id", low.alias("low"), F.explode(F.array(*[F.lit(t) for t in terms])).alias("term"))
    return each.groupBy("doc_id", "term").agg((F.log((F.count("*") + 1) / (F.sum(F.contains("low", "term").cast("int")) + 1)) + 1).alias("idf"))
