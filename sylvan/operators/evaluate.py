"""Retrieval and answer quality as plans: ranked results against relevance judgements."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.functions import text as X
from sylvan.operators.lineage import cut, small_batches

#: Vectors of one block, and the value that stands for no cosine.
BLOCK_VECTORS, NO_COSINE = 4096, -9.0


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, precision, recall, hit, rr, ndcg, f1) of ``ranked`` (query_id, item, rank) against ``relevant``
    (query_id, item); a query without judged items is left out, one without results scores 0."""
    judged = relevant.select("query_id", "item").distinct()
    size = judged.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranked.join(judged, ["query_id", "item"], "left_semi").groupBy("query_id").agg(
        F.sum((F.col("rank") <= k).cast("int")).alias("tp"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg")
    )
    m = size.join(hits, "query_id", "left").na.fill({"tp": 0, "dcg": 0.0})
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    p, r = F.col("tp") / k, F.col("tp") / F.col("n")
    return m.select("query_id", p.alias("precision"), r.alias("recall"), (F.col("tp") > 0).cast("double").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("dcg") / ideal).alias("ndcg"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def averages(metrics: DataFrame, by: str | None = None) -> DataFrame:
    own = [c for c in metrics.columns if c not in ("query_id", by)]
    return metrics.groupBy(*([by] if by else [])).agg(*[F.avg(c).alias(c) for c in own], F.count("*").alias("queries"))


def support_metrics(ranked: DataFrame, supports: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, sp_recall, covered): the share of supporting titles among the first ``k``, and whether all are."""
    top = ranked.where(F.col("rank") <= k).select("query_id", F.col("item").alias("title")).distinct().withColumn("found", F.lit(1.0))
    got = supports.select("query_id", "title").distinct().join(top, ["query_id", "title"], "left").na.fill({"found": 0.0})
    return got.groupBy("query_id").agg(F.avg("found").alias("sp_recall"), F.min("found").alias("covered"))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """(query_id, em, f1) of (query_id, answer, gold): equality and bag overlap of normalised words."""
    words = lambda c: F.filter(F.split(X.normal_answer(F.col(c)), " "), lambda w: w != "")
    rows = answers.select("query_id", (X.normal_answer(F.col("answer")) == X.normal_answer(F.col("gold"))).cast("double").alias("em"), words("answer").alias("a"), words("gold").alias("g"))
    count: Column = F.lit(0)
    common = F.aggregate(F.array_distinct("a"), count, lambda s, w: s + F.least(F.size(F.filter("a", lambda x: x == w)), F.size(F.filter("g", lambda x: x == w))))
    p, r = common / F.size("a"), common / F.size("g")
    return rows.select("query_id", "em", F.when((F.size("a") > 0) & (F.size("g") > 0) & (common > 0), 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


#: Beginnings of evidence that are held against the nodes at a time (some 10 MB); more go in further passes.
EVIDENCE_HEADS = 50_000


def evidence_match(evidence: DataFrame, nodes: DataFrame, chars: tuple[int, ...] = (80, 50, 30)) -> DataFrame:
    """(query_id, doc_id, node_id): nodes whose text holds the evidence's beginning, the longest that is found anywhere; or,
    with a ``title`` in both, whose title is the evidence's."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    # whoever holds a beginning holds the shortest one, and each word with white space on both sides of it as a word of its own
    inner = lambda c: F.filter(F.slice(F.split(c, " "), 2, F.greatest(F.size(F.split(c, " ")) - 2, F.lit(0))), lambda w: w != "")
    longest = lambda c: F.aggregate(inner(c), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    begun = evidence.select("query_id", norm(F.col("text")).alias("__t"))
    begun = begun.select("query_id", longest(F.substring("__t", 1, min(chars))).alias("word"), F.posexplode(F.array(*[F.substring("__t", 1, n) for n in chars])).alias("i", "head"))
    heads = cut(begun.where("head <> ''"))
    passes = -(-heads.count() // EVIDENCE_HEADS) or 1
    texts = nodes.select("doc_id", "node_id", norm(F.col("text")).alias("t"))
    parts = [heads.where(F.pmod(F.xxhash64("head"), F.lit(passes)) == k) for k in range(passes)] if passes > 1 else [heads]
    got = ["query_id", "i", "doc_id", "node_id"]
    hits = []
    for h in parts:
        words = h.where("word <> ''").agg(F.collect_set("word").alias("__words"))
        some = texts.crossJoin(F.broadcast(words)).select("doc_id", "node_id", "t", F.explode(F.array_intersect(F.split("t", " "), "__words")).alias("word"))
        hits.append(some.join(F.broadcast(h), (some["word"] == h["word"]) & F.contains(F.col("t"), F.col("head"))).select(*got))
        if not h.where("word = ''").isEmpty():  # no word is whole: held against every text
            hits.append(texts.join(F.broadcast(h.where("word = ''")), F.contains(F.col("t"), F.col("head"))).select(*got))
    hits = reduce(DataFrame.unionByName, hits)
    hits = cut(hits)
    best = hits.groupBy("query_id").agg(F.min("i").alias("i"))
    found = hits.join(best, ["query_id", "i"]).select("query_id", "doc_id", "node_id")
    if "title" in evidence.columns and "title" in nodes.columns:
        named = evidence.select("query_id", norm(F.col("title")).alias("__t")).where("__t <> ''").join(nodes.select("doc_id", "node_id", norm(F.col("title")).alias("__t")), "__t")
        found = found.unionByName(named.select("query_id", "doc_id", "node_id"))
    return found.distinct()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, embedding) as blocks of ids and one matrix of unit vectors; what has no direction is NaN."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_VECTORS):
            ids, vectors = batch.column(0).slice(at, BLOCK_VECTORS), batch.column(1).slice(at, BLOCK_VECTORS)
            for width in set(pc.fill_null(pc.list_value_length(vectors), 0).to_pylist()):
                mask = pc.equal(pc.fill_null(pc.list_value_length(vectors), 0), width)
                own = vectors.filter(mask)
                rows = np.array([[np.nan if x is None else x for x in v] if v else [] for v in own.to_pylist()], np.float64).reshape(len(own), width)
                with np.errstate(invalid="ignore", divide="ignore"):
                    rows = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
                named = ids.filter(mask)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named), pa.array([width], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["ids", "width", "rows"])


def _tops(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, among = batch.column("q_ids")[i].values, batch.column("ids")[i].values
                q, v = (np.frombuffer(batch.column(f"{x}rows")[i].as_py()).reshape(n, batch.column(f"{x}width")[i].as_py()) for x, n in (("q_", len(asked)), ("", len(among))))
                order = pc.sort_indices(among)
                among, v = among.take(order), v[order.to_numpy()]
                step = max(1, 4_000_000 // len(among))
                for at in range(0, len(asked), step):
                    part = q[at : at + step]
                    cosine = part @ v.T if q.shape[1] == v.shape[1] and q.shape[1] else np.full((len(part), len(among)), np.nan)
                    cosine[np.isnan(cosine)] = NO_COSINE
                    # what rounding may lift to the k-th place stays a candidate
                    least = np.partition(cosine, -k, axis=1)[:, -k, None] - 2e-6 if k < len(among) else NO_COSINE
                    row, col = np.nonzero(cosine >= least)
                    value = np.round(cosine[row, col], 6)
                    first = np.lexsort((col, -value, row))
                    row, col, value = row[first], col[first], value[first]
                    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, col, value = row[kept], col[kept], value[kept]
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(row + at)), among.take(pa.array(col)), pa.array(value, mask=value == NO_COSINE)], ["query_id", "vec_id", "cosine"])

    return run


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 10, among: DataFrame | None = None) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the baseline that compares each query vector with all (or those of ``among``), block
    by block.

    A pair without a cosine (a null, a zero vector, other lengths) has null and ranks last.
    """
    from pyspark.sql import Window as W

    spark = vectors.sparkSession
    small_batches(spark)
    if among is not None:
        vectors = vectors.join(among.select("vec_id"), "vec_id", "left_semi")
    parts = math.ceil(math.sqrt(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        kind = df.schema[name].dataType.simpleString()
        return df.select(name, "embedding").mapInArrow(_packed, f"ids array<{kind}>, width int, rows binary").repartition(parts)

    own, asked = blocks(vectors, "vec_id"), blocks(queries, "query_id")
    pairs = own.crossJoin(asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns]))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cosine double"
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return pairs.mapInArrow(_tops(k), schema).withColumn("rank", rank).where(F.col("rank") <= k)


def paragraph_chunks(docs: DataFrame, most: int = 1000) -> DataFrame:
    """(doc_id, chunk, text): paragraphs packed up to ``most`` characters in order."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(a, p):
        fits = F.length(a["held"]) + F.length(p) + 2 <= most
        return F.when(a["held"] == "", F.struct(a["done"].alias("done"), p.alias("held"))).when(fits, F.struct(a["done"].alias("done"), F.concat(a["held"], F.lit("\n\n"), p).alias("held"))).otherwise(F.struct(F.concat(a["done"], F.array(a["held"])).alias("done"), p.alias("held")))

    end = docs.select("doc_id", F.aggregate(parts, start, step).alias("s"))
    chunks = F.filter(F.concat("s.done", F.array("s.held")), lambda x: x != "")
    return end.select("doc_id", F.posexplode(chunks).alias("chunk", "text"))


def cost_stats(costs: DataFrame) -> DataFrame:
    """Averages and sums of (seconds, prompt_tokens, completion_tokens) over queries."""
    return costs.agg(F.count("*").alias("queries"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("avg_seconds"), F.avg("prompt_tokens").alias("avg_prompt_tokens"), F.avg("completion_tokens").alias("avg_completion_tokens"))
