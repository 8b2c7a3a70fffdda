"""Search in trees: anchors, best-first walks, paths and re-ranking.

All but the walk is set-oriented. Each re-ranking stage reads a snapshot of the scores before it. Scored trees are
DataFrames ``doc_id, node_id, parent_node_id, ord, depth, title, text, leaf, fts, score``.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.config import Config
from sylvan.functions import text as X
from sylvan.operators.lineage import cut
from sylvan.plans.query import QueryPlan

GENERIC = tuple(sorted(["overview", "background", "introduction", "abstract", "related work"] + [f"conclusion{s}{t}" for s in ("", "s") for t in ("", " and outlook", " and future work")] + ["acknowledgements", "acknowledgments"]))


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def scored_tree(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Nodes with their full-text score, 0 where there is none."""
    inner = nodes.where("parent_node_id is not null").select("doc_id", F.col("parent_node_id").alias("node_id"), F.lit(False).alias("__l")).distinct()
    out = nodes.join(scores.select("doc_id", "node_id", F.col("score").alias("fts")), ["doc_id", "node_id"], "left").join(inner, ["doc_id", "node_id"], "left")
    return out.withColumns({"fts": F.coalesce("fts", F.lit(0.0)), "leaf": F.coalesce("__l", F.lit(True)), "score": F.coalesce("fts", F.lit(0.0))}).drop("__l")


def title_match(title: Column, plan: QueryPlan) -> Column:
    return X.contains_any(title, _array(plan.terms)).cast("double")


def phrase_match(title: Column, text: Column, plan: QueryPlan) -> Column:
    return X.contains_any(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))), _array(plan.phrases)).cast("double")


def full_text() -> Column:
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))


def anchor_score(plan: QueryPlan, idf: Column | None = None) -> Column:
    raw = F.col("fts") + 0.15 * title_match(F.col("title"), plan) + 0.07 * phrase_match(F.col("title"), F.col("text"), plan) + 0.10 * X.overlap(full_text(), _array(plan.terms), idf) - 0.10 * F.least(F.col("depth") / 6.0, F.lit(1.0))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def anchors(tree: DataFrame, plan: QueryPlan, top_k: int = 5) -> DataFrame:
    """The best anchors of each document: of those that begin with the same three nodes only the best."""
    doc = W.partitionBy("doc_id")
    some = tree.where("fts > 0").withColumn("__r", F.rank().over(doc.orderBy(F.desc("fts")))).where(F.col("__r") <= 3 * top_k).withColumn("anchor", anchor_score(plan))
    head = W.partitionBy("doc_id", F.slice("path", 1, 3)).orderBy(F.desc("anchor"), "ord")
    one = some.withColumn("__n", F.row_number().over(head)).where("__n = 1")
    return one.withColumn("anchor_rank", F.row_number().over(doc.orderBy(F.desc("anchor"), "ord"))).where(F.col("anchor_rank") <= top_k).drop("__r", "__n")


def walked_docs(scores: DataFrame, most: int = 20) -> DataFrame:
    """The documents to walk, by their best raw score."""
    best = scores.groupBy("doc_id").agg(F.max("score").alias("best"))
    return best.orderBy(F.desc("best"), "doc_id").limit(most).select("doc_id")


STATES = "doc_id string, node_id string, score double, hop int, step int, anchor_id string, path array<int>, reasons array<string>"


def _overlap(text: str, terms: list[str], idf: dict[str, float] | None) -> float:
    low = text.lower()
    weigh = (lambda t: idf.get(t, 1.0)) if idf else (lambda t: 1.0)
    total = sum(map(weigh, terms))
    return sum(weigh(t) for t in terms if t in low) / total if total else 0.0


def walk(tree: DataFrame, found: DataFrame, plan: QueryPlan, config: Config | None = None) -> DataFrame:
    """Best-first walks from the anchors ``found``: the states in the order they were expanded. Equal scores go by hop,
    then by place in the document."""
    c = config or Config()
    terms, phrases = list(plan.terms), [p.lower() for p in plan.phrases]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        rows = {r.ord: r for r in pdf.itertuples(index=False)}
        below: dict[int, list[int]] = {}
        for o, r in rows.items():
            below.setdefault(int(r.parent_ord) if pd.notna(r.parent_ord) else 0, []).append(o)
        idf = None
        if len(rows) > 20 and sum(r.fts > 0 for r in rows.values()) >= 5:
            import math

            texts = [f"{r.title or ''} {r.text or ''}".lower() for r in rows.values()]
            idf = {t: math.log((len(texts) + 1) / (sum(t in x for x in texts) + 1)) + 1 for t in terms}
        parent = {o: int(r.parent_ord) if pd.notna(r.parent_ord) else 0 for o, r in rows.items()}
        heap = [(-r.anchor, 0, o, o, tuple(r.path), r.fts, o, ("anchor",)) for o, r in rows.items() if pd.notna(r.anchor)]
        heapq.heapify(heap)
        seen: set[int] = set()
        out = []
        while heap and len(out) < c.max_expansions:
            minus, hop, at, _, path, up, first, why = heapq.heappop(heap)
            if at in seen:
                continue
            seen.add(at)
            r, score = rows[at], -minus
            out.append((r.doc_id, r.node_id, score, hop, len(out) + 1, rows[first].node_id, list(path), list(why)))
            if score >= c.early_stop:
                break
            if score < c.least_frontier or hop >= c.max_hops:
                continue
            beside = [o for o in below.get(parent[at], []) if o != at][: c.max_siblings]
            near = [(o, "child") for o in below.get(at, [])] + ([(parent[at], "parent")] if parent[at] else []) + [(o, "sibling") for o in beside]
            carried = max(up, r.fts)
            for o, kind in near:
                if o in seen:
                    continue
                n = rows[o]
                whole = f"{n.title or ''} {n.text or ''}"
                value = 0.45 * n.fts + 0.15 * _overlap(whole, terms, idf) + 0.08 * any(t in (n.title or "").lower() for t in terms) + 0.07 * any(p in whole.lower() for p in phrases) + 0.12 * carried - 0.08 * min((hop + 1) / c.max_hops, 1.0)
                heapq.heappush(heap, (-max(value, 0.0), hop + 1, o, o, (*path, o) if kind == "child" else tuple(n.path), carried, first, (*why, kind)))
        return pd.DataFrame(out, columns=["doc_id", "node_id", "score", "hop", "step", "anchor_id", "path", "reasons"])

    # a row a document, so that the texts are shuffled once: by document, as the walk needs them
    marks = found.groupBy("doc_id", "node_id").agg(F.max("anchor").alias("anchor")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "anchor"))).alias("__marks"))
    own = ["doc_id", "node_id", "ord", "parent_ord", "path", "title", "text", "fts"]
    marked = tree.select(*own).join(marks, "doc_id").select(*own, F.try_element_at("__marks", F.col("node_id")).alias("anchor"))
    return marked.groupBy("doc_id").applyInPandas(run, STATES)


def paths(states: DataFrame, tree: DataFrame, plan: QueryPlan, per_doc: int = 3, overall: int = 3) -> DataFrame:
    """The best paths from root to answer: one a target, scored by leaf, coverage and consistency of titles."""
    target = states.withColumn("__n", F.row_number().over(W.partitionBy("doc_id", "node_id").orderBy(F.desc("score"), "hop", "step"))).where("__n = 1").withColumn("__r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "step"))).where(F.col("__r") <= 2 * per_doc)
    names = tree.select("doc_id", F.col("ord").alias("__o"), F.col("title").alias("__t"), F.col("node_id").alias("__id"))
    steps = target.select("doc_id", "node_id", F.posexplode("path").alias("__i", "__o")).join(names, ["doc_id", "__o"])
    terms = _array(plan.terms)
    hit = X.contains_any(F.col("__t"), terms).cast("double")
    titles = steps.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("__i", "__id", "__t"))).alias("steps"), F.avg(hit).alias("consistency"), F.concat_ws(" ", F.collect_list("__t")).alias("__all"), F.count("*").alias("length"))
    out = target.join(titles, ["doc_id", "node_id"]).join(tree.select("doc_id", "node_id", "fts", "text"), ["doc_id", "node_id"])
    score = 0.30 * F.col("score") + 0.30 * F.col("fts") + 0.20 * X.overlap(F.col("text"), terms) + 0.10 * F.col("consistency") + 0.08 * X.overlap(F.col("__all"), terms) + 0.07 * (1 - 0.5 * F.least(F.col("length") / 6.0, F.lit(1.0)))
    out = out.withColumn("path_score", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4))
    out = out.withColumn("__k", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("path_score"), "step"))).where(F.col("__k") <= per_doc)
    line = F.transform("steps", lambda s: F.struct(s["__id"].alias("node_id"), s["__t"].alias("title")))
    return out.orderBy(F.desc("path_score"), "doc_id", "step").limit(overall).select("doc_id", F.col("path_score").alias("score"), F.element_at("steps", 1)["__id"].alias("root_node_id"), "anchor_id", F.col("node_id").alias("target_node_id"), line.alias("path"), "reasons", F.substring("text", 1, 300).alias("snippet"))


# Re-ranking


def doc_cap(tree: DataFrame, docs: int, least: int = 50) -> DataFrame:
    """The best nodes of each document, at most ``max(least, min(500, 2000 / docs))``."""
    most = max(least, min(500, 2000 // max(docs, 1)))
    return tree.withColumn("__r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "ord"))).where(F.col("__r") <= most).drop("__r")


def generic_demoted(tree: DataFrame, plan: QueryPlan) -> DataFrame:
    """General sections at depth 1 count 0.70, unless a term is in their title."""
    base = F.trim(F.lower(F.element_at(F.split("title", " ::: "), 1)))
    hit = (F.col("depth") == 1) & base.isin(*GENERIC) & ~X.contains_any(base, _array(plan.terms))
    return tree.withColumn("score", F.when(hit, F.col("score") * 0.70).otherwise(F.col("score")))


def leaf_raised(tree: DataFrame) -> DataFrame:
    return tree.withColumn("score", F.when(F.col("leaf") & (F.length("text") > 100), F.col("score") * 1.08).otherwise(F.col("score")))


def prefix_raised(tree: DataFrame) -> DataFrame:
    """Nodes that scored nothing gain 0.30 of the best of the document's 20 first whose title is a beginning of theirs."""
    first = tree.where("fts >= 0.15").withColumn("__r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("fts"), "ord"))).where("__r <= 20").select("doc_id", F.col("title").alias("__t"), F.col("fts").alias("__f"))
    low = tree.where("score <= 0.005").select("doc_id", "node_id", "title")
    got = low.join(first, "doc_id").where((F.col("__t") != "") & F.col("title").startswith(F.col("__t")) & (F.col("title") != F.col("__t"))).groupBy("doc_id", "node_id").agg((0.30 * F.max("__f")).alias("__g"))
    return tree.join(got, ["doc_id", "node_id"], "left").withColumn("score", F.coalesce("__g", "score")).drop("__g")


def walk_raised(tree: DataFrame, states: DataFrame, plan: QueryPlan) -> DataFrame:
    """Walked nodes gain by their walk score; nodes reached only by walking score by overlap and hops."""
    best = states.groupBy("doc_id", "node_id").agg(F.max("score").alias("__w"), F.min("hop").alias("__h"))
    own = X.overlap(full_text(), _array(plan.terms))
    far = F.least(0.25 * own * (1 - 0.15 * (F.col("__h") - 1)), F.lit(0.20))
    score = F.when(F.col("__w").isNull(), F.col("score")).when(F.col("fts") > 0, F.col("score") + 0.15 * (0.3 * F.col("__w") + 0.7 * F.col("fts"))).when((F.col("__h") <= 3) & (own >= 0.40), F.greatest(F.col("score"), far)).otherwise(F.col("score"))
    return tree.join(best, ["doc_id", "node_id"], "left").withColumn("score", score).drop("__w", "__h")


def parent_raised(tree: DataFrame, plan: QueryPlan) -> DataFrame:
    """Nodes under a better parent or grandparent gain by their overlap."""
    up = tree.select("doc_id", F.col("node_id").alias("parent_node_id"), F.col("fts").alias("__p"), F.col("parent_node_id").alias("__gid"))
    top = tree.select("doc_id", F.col("node_id").alias("__gid"), F.col("fts").alias("__g"))
    got = tree.join(up, ["doc_id", "parent_node_id"], "left").join(top, ["doc_id", "__gid"], "left").withColumn("__o", X.overlap(full_text(), _array(plan.terms)))
    fits = (F.col("__o") >= 0.20) & (F.col("score") >= 0.01)
    add = F.when(fits & (F.col("__p") > F.col("score") + 0.06), 0.50 * F.col("__p") * F.col("__o")).otherwise(0.0) + F.when(fits & (F.col("__g") > F.col("score") + 0.10), 0.25 * F.col("__g") * F.col("__o")).otherwise(0.0)
    return got.withColumn("score", F.col("score") + add).drop("__p", "__g", "__gid", "__o")


def density_raised(tree: DataFrame, plan: QueryPlan) -> DataFrame:
    own = X.overlap(full_text(), _array(plan.terms))
    hit = (own >= 0.5) & (F.col("score") >= 0.05) & F.lit(len(plan.terms) >= 2)
    return tree.withColumn("score", F.when(hit, F.col("score") + 0.12 * own * F.col("score")).otherwise(F.col("score")))


def subtree_raised(tree: DataFrame) -> DataFrame:
    """Nodes far below the best of parent, children and siblings move 0.30 of the way up."""
    up = tree.select("doc_id", F.col("node_id").alias("parent_node_id"), F.col("score").alias("__p"))
    down = tree.where("parent_node_id is not null").groupBy("doc_id", F.col("parent_node_id").alias("node_id")).agg(F.max("score").alias("__c"))
    beside = tree.groupBy("doc_id", F.coalesce("parent_node_id", F.lit("")).alias("__k")).agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, 2).alias("__s"))
    got = tree.join(up, ["doc_id", "parent_node_id"], "left").join(down, ["doc_id", "node_id"], "left").withColumn("__k", F.coalesce("parent_node_id", F.lit(""))).join(beside, ["doc_id", "__k"], "left")
    sibling = F.when(F.col("score") == F.get("__s", F.lit(0)), F.get("__s", F.lit(1))).otherwise(F.get("__s", F.lit(0)))
    best = F.greatest(F.coalesce("__p", F.lit(0.0)), F.coalesce("__c", F.lit(0.0)), F.coalesce(sibling, F.lit(0.0)))
    hit = (best > 1.5 * F.col("score")) & (best > 0.15)
    return got.withColumn("score", F.when(hit, F.col("score") + 0.30 * (best - F.col("score"))).otherwise(F.col("score"))).drop("__p", "__c", "__s", "__k")


def title_raised(tree: DataFrame, plan: QueryPlan) -> DataFrame:
    own = X.overlap(F.col("title"), _array(plan.terms))
    return tree.withColumn("score", F.col("score") + 0.15 * own * F.greatest("score", F.lit(0.10)))


def reranked(tree: DataFrame, states: DataFrame, plan: QueryPlan, docs: int) -> DataFrame:
    """All stages in order, scores to 4 decimals, best first. Stages that join the tree with itself start from a table."""
    stages = [
        lambda t: doc_cap(t, docs), lambda t: generic_demoted(t, plan), leaf_raised, cut, prefix_raised, lambda t: walk_raised(t, states, plan), lambda t: doc_cap(t, docs, 100),
        cut, lambda t: parent_raised(t, plan), lambda t: density_raised(t, plan), cut, subtree_raised, lambda t: title_raised(t, plan),
    ]
    out = reduce(lambda t, stage: stage(t), stages, tree)
    return out.withColumn("score", F.round("score", 4)).where("score > 0").orderBy(F.desc("score"), "doc_id", "ord")
