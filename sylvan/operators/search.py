"""Search over an index: routing, flat and tree mode, merging, texts under a budget, many queries at once."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.config import Config
from sylvan.operators import index, score, tree, walk
from sylvan.operators.lineage import cut
from sylvan.plans import query as Q
from sylvan.sources import parsers


@dataclass
class Corpus:
    """Nodes (doc_id, node_id, parent_node_id, ord, depth, path, title, summary, text, ...), documents (doc_id, doc_name,
    source_type), postings and corpus statistics."""

    nodes: DataFrame
    documents: DataFrame
    postings: DataFrame
    stats: DataFrame
    cut: Q.Cut = field(default_factory=Q.Cut)

    @classmethod
    def of(cls, nodes: DataFrame, documents: DataFrame, markdown: bool = False, with_summary: bool = True, mode: str = "bigram", dictionary: tuple[str, ...] = ()) -> Corpus:
        """``mode`` and ``dictionary`` say how ideographs are cut to words, in texts as in queries."""
        posts = index.postings(index.fields(nodes, markdown, with_summary), mode, dictionary)
        return cls(nodes, documents, posts, index.stats_of(posts, nodes), Q.Cut(mode, dictionary))

    @classmethod
    def saved(cls, store: index.Index) -> Corpus:
        """The corpus of a saved index."""
        nodes, posts = store.table("nodes"), store.table("postings")
        return cls(nodes, store.table("documents"), posts, index.stats_of(posts, nodes))


@dataclass
class Result:
    """``flat_nodes`` in rank order, ``documents`` with their nodes, ``routed`` documents (doc_id, doc_rank), those without
    a node too, and in tree mode ``paths``."""

    flat_nodes: DataFrame
    documents: DataFrame
    mode: str
    paths: DataFrame | None = None
    routed: DataFrame | None = None


def auto_mode(nodes: DataFrame, documents: DataFrame, ratio: float = 0.30) -> DataFrame:
    """One row (share, mode): tree if enough documents are of a kind with hierarchy and are deep."""
    deep = tree.meaningful_depth(nodes)
    flag = F.col("source_type").isin(*parsers.TREE_TYPES) & F.coalesce("deep", F.lit(False))
    share = documents.join(deep, "doc_id", "left").agg(F.coalesce(F.avg(flag.cast("double")), F.lit(0.0)).alias("share"))
    return share.select("share", F.when(F.col("share") >= ratio, "tree").otherwise("flat").alias("mode"))


def top_nodes(scores: DataFrame, most: int) -> DataFrame:
    """The best nodes of each document."""
    return scores.withColumn("node_rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "node_id"))).where(F.col("node_rank") <= most)


def merged(top: DataFrame, docs: DataFrame, strategy: str = "interleave") -> DataFrame:
    """``top`` with ``rank``: by document rank, then score (``interleave``, ``per_doc``), or by score over all
    (``global_score``)."""
    if strategy not in ("interleave", "per_doc", "global_score"):
        raise ValueError(f"no such strategy: {strategy}")
    out = top.join(docs.select("doc_id", "doc_rank"), "doc_id")
    order = [F.desc("score"), F.col("doc_id"), F.col("node_id")] if strategy == "global_score" else [F.col("doc_rank"), F.desc("score"), F.col("node_id")]
    return out.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def attached(top: DataFrame, nodes: DataFrame, text_mode: str = "full", include_ancestors: bool = False) -> DataFrame:
    """Titles, texts (``full``, ``summary`` or ``none``), line ranges and, on request, the titles above."""
    text = {"full": F.col("text"), "summary": F.col("summary") if "summary" in nodes.columns else F.col("text"), "none": F.lit("")}[text_mode]
    own = [c for c in ("line_start", "line_end") if c in nodes.columns]
    out = top.join(nodes.select("doc_id", "node_id", "title", text.alias("text"), "ord", *own), ["doc_id", "node_id"])
    if include_ancestors:
        out = out.join(tree.ancestors(nodes).withColumnRenamed("titles", "ancestors"), ["doc_id", "ord"], "left")
    return out


def shares(sizes: DataFrame, most: int, keys: list[str]) -> DataFrame:
    """(keys, rank, chars) of the texts that get a part of ``most`` characters, of ``sizes`` (keys, rank, place, total, n):
    the place from 1 among all ``total`` texts of a group and the length. A text that isn't empty takes one character at
    least while some are left, so only the first ``most`` such texts of a group can get any, and only they are brought together."""
    kind = sizes.schema
    out = T.StructType([*(kind[c] for c in (*keys, "rank")), T.StructField("chars", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        left, taken = most, []
        for place, total, n in zip(pdf["place"].tolist(), pdf["total"].tolist(), pdf["n"].tolist(), strict=True):
            if left <= 0:
                break
            taken.append(min(max(left // (total - place + 1), 1), n))
            left -= taken[-1]
        return pdf[: len(taken)].assign(chars=taken)[out.names]

    first = sizes.where("n > 0").withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy("place"))).where(F.col("__k") <= most)
    return first.drop("__k").groupBy(*keys).applyInPandas(run, out)


def budgeted(flat: DataFrame, most: int = 32_000, by: str | None = None) -> DataFrame:
    """``flat`` with texts cut in rank order: each node gets an even share of what is left, what it leaves flows on. Lengths
    alone are brought together; each text is cut where its row is. ``rank`` is unique (within ``by``)."""
    keys = [by] if by else []
    sizes = flat.select(*keys, "rank", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    sizes = sizes.withColumns({"place": F.row_number().over(W.partitionBy(*keys).orderBy("rank")), "total": F.count("*").over(W.partitionBy(*keys))})
    got = shares(sizes, most, keys).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("rank").alias("__rank"), F.col("chars").alias("__chars"))
    same = F.col("rank") == F.col("__rank")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    cut_ = flat.join(got, same, "left")
    return cut_.select(*[F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.coalesce("__chars", F.lit(0))).alias("text") if c == "text" else F.col(c) for c in flat.columns])


def node_scores(corpus: Corpus, mode: Q.Mode, config: Config, docs: DataFrame | None = None, pre_filter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Raw scores by the query's mode: the given filter, patterns, or full text with literal search added for the source
    types that are searched that way too."""
    nodes = corpus.nodes if docs is None else corpus.nodes.join(docs.select("doc_id"), "doc_id", "left_semi")
    if pre_filter is not None:
        return pre_filter(nodes).select("doc_id", "node_id", "score")
    if mode.kind == "regex":
        return score.grep(nodes, mode.regex, regex=True)
    by_chain = lambda name, has: [t for t, chain in parsers.PREFILTERS.items() if (name in chain) == has]
    of_type = lambda types: corpus.documents.where(F.col("source_type").isin(*types)).select("doc_id")
    full = score.bm25(corpus.postings, corpus.stats, mode.expression, config.weights, docs).join(of_type(by_chain("fts", False)), "doc_id", "left_anti")
    return score.combined(full, score.grep(nodes.join(of_type(by_chain("grep", True)), "doc_id", "left_semi"), mode.query))


def search_nodes(corpus: Corpus, query: str, top_k: int = 20, expression: str | None = None, doc_ids: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """(doc_id, node_id, title, summary, depth, score): the best nodes by full text. Of plain queries of two words or more,
    the chosen nodes that hold them as a phrase gain ``phrase_boost``."""
    c = config or Config()
    mode = Q.classify(query, expression, cut=corpus.cut)
    raw = score.bm25(corpus.postings, corpus.stats, mode.expression, c.weights, doc_ids)
    best = raw.orderBy(F.desc(F.round("score", 9)), "doc_id", "node_id").limit(top_k)
    said = [w for w in re.split(r"\W+", query.lower()) if len(w) > 2]
    if expression is None and len(said) >= 2:
        best = cut(best)
        phrase = score.bm25(corpus.postings, corpus.stats, Q.parse('"' + " ".join(said) + '"', corpus.cut), c.weights)
        best = score.phrase_boosted(best, phrase.join(best, ["doc_id", "node_id"], "left_semi"), c.phrase_boost)
    meta = corpus.nodes.select("doc_id", "node_id", "title", F.col("summary") if "summary" in corpus.nodes.columns else F.lit(None).cast("string").alias("summary"), "depth")
    return best.join(meta, ["doc_id", "node_id"]).select("doc_id", "node_id", "title", "summary", "depth", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id", "node_id")


def search_documents(corpus: Corpus, query: str, top_k: int = 20, expression: str | None = None, config: Config | None = None) -> DataFrame:
    """(doc_id, doc_name, hit_count, best_score, avg_score) of the documents of the 200 best nodes."""
    found = score.doc_aggregate(search_nodes(corpus, query, 200, expression, config=config), 200, top_k)
    return found.join(corpus.documents.select("doc_id", "doc_name"), "doc_id", "left").select("doc_id", "doc_name", "hit_count", F.round("best_score", 6).alias("best_score"), F.round("avg_score", 6).alias("avg_score")).orderBy(F.desc("best_score"), "doc_id")


def document_scores(corpus: Corpus, query: str, doc_ids: DataFrame | None = None, expression: str | None = None, config: Config | None = None) -> DataFrame:
    """(doc_id, node_id, score) within documents (all, or those of ``doc_ids``): normalised and passed up."""
    c = config or Config()
    raw = score.bm25(corpus.postings, corpus.stats, Q.classify(query, expression, cut=corpus.cut).expression, c.weights, doc_ids)
    return score.propagated(score.normalised(raw), corpus.nodes, c.ancestor_decay)


def ranked_ids(corpus: Corpus, query: str, top_k: int = 10, doc_ids: DataFrame | None = None, expression: str | None = None, config: Config | None = None) -> DataFrame:
    """(doc_id, node_id) of the best nodes by :func:`document_scores`, best first."""
    return document_scores(corpus, query, doc_ids, expression, config).orderBy(F.desc("score"), "doc_id", "node_id").limit(top_k).select("doc_id", "node_id")


def search(corpus: Corpus, query: str, config: Config | None = None, expression: str | None = None, regex: bool = False, pre_filter: Callable[[DataFrame], DataFrame] | None = None, include_ancestors: bool = False) -> Result:
    """One query. Nothing found by text routes to the first documents, with no nodes; a pattern without a match to none."""
    c = config or Config()
    mode = Q.classify(query, expression, regex, corpus.cut)
    raw = cut(node_scores(corpus, mode, c, pre_filter=pre_filter))  # read by routing and by scoring
    docs = cut(score.routed(raw, c.top_k_docs))
    if mode.kind != "regex" and pre_filter is None and docs.isEmpty():
        first = corpus.documents.select("doc_id").orderBy("doc_id").limit(c.top_k_docs)
        docs = cut(first.select("doc_id", F.lit(0.0).alias("best"), F.row_number().over(W.orderBy("doc_id")).alias("doc_rank")))
    chosen = raw.join(docs.select("doc_id"), "doc_id", "left_semi")
    scores = score.propagated(score.normalised(chosen), corpus.nodes, c.ancestor_decay)
    picked = corpus.documents.join(docs.select("doc_id"), "doc_id", "left_semi")
    kind = c.search_mode
    if kind == "auto":
        own = corpus.nodes.join(docs.select("doc_id"), "doc_id", "left_semi")
        kind = auto_mode(own, picked, c.tree_ratio).first()["mode"]
    paths = None
    if kind == "tree":
        plan = Q.query_plan(query)
        trees = cut(walk.scored_tree(corpus.nodes.join(docs.select("doc_id"), "doc_id", "left_semi"), scores))
        walked = trees.join(walk.walked_docs(scores, c.max_walked_docs), "doc_id", "left_semi")
        states = cut(walk.walk(walked, walk.anchors(walked, plan, c.anchor_top_k), plan, c))
        paths = walk.paths(states, trees, plan, c.path_top_k, c.path_top_k)
        scores = walk.reranked(trees, states, plan, c.top_k_docs).select("doc_id", "node_id", "score")
    top = merged(top_nodes(scores, c.max_nodes_per_doc), docs, c.merge_strategy)
    flat = budgeted(attached(top, corpus.nodes, c.text_mode, include_ancestors), c.budget_chars)
    flat = flat.join(corpus.documents.select("doc_id", "doc_name"), "doc_id").orderBy("rank")
    grouped = flat.groupBy("doc_id", "doc_name", "doc_rank").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", "title", "score", "text"))).alias("nodes")).orderBy("doc_rank")
    return Result(flat, grouped, kind, paths, docs.select("doc_id", "doc_rank"))


def batch_search(corpus: Corpus, queries: DataFrame, config: Config | None = None) -> DataFrame:
    """Many plain queries (query_id, query) in one plan: routed documents, normalised and propagated scores, the best
    nodes of each (query_id, doc_id, node_id, doc_rank, node_rank, score)."""
    c = config or Config()
    norm = cut(score.batch_routed(corpus.postings, corpus.stats, queries, c.top_k_docs, c.weights, corpus.cut))
    norm = norm.withColumn("score", F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0))
    parents = corpus.nodes.where("parent_node_id is not null").select("doc_id", "node_id", "parent_node_id")
    up = norm.join(parents, ["doc_id", "node_id"]).groupBy("query_id", "doc_id", "doc_rank", F.col("parent_node_id").alias("node_id")).agg((c.ancestor_decay * F.max("score")).alias("score"))
    total = norm.select("query_id", "doc_id", "doc_rank", "node_id", "score").unionByName(up).groupBy("query_id", "doc_id", "doc_rank", "node_id").agg(F.sum("score").alias("score"))
    best = F.greatest(F.max("score").over(W.partitionBy("query_id", "doc_id")), F.lit(1.0))
    out = total.withColumn("score", F.round(F.col("score") / best, 6))
    rank = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "node_id"))
    return out.withColumn("node_rank", rank).where(F.col("node_rank") <= c.max_nodes_per_doc)


def search_many(corpus: Corpus, queries: list[dict], config: Config | None = None) -> DataFrame:
    """Queries of any mode (``query`` and any further argument of :func:`search`), each as it would be alone: its flat nodes
    with ``query_no``, from 0 in the order given, one plan for all. For many plain queries there is :func:`batch_search`."""
    parts = [search(corpus, **(({"config": config} if config else {}) | q)).flat_nodes.withColumn("query_no", F.lit(i)) for i, q in enumerate(queries)]
    if not parts:
        raise ValueError("no query")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy("query_no", "rank")
