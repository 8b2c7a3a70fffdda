"""Exact top-k search by BM25 with block-at-a-time pruning.

Runs of consecutive documents form blocks. A block keeps a forward index: for each document the query terms it holds with
their counts. A table of its own keeps each block's largest weight of each term; summed over a query's terms, these bound
the score of any document in the block. A query's blocks are taken by falling bound, over all tasks, in rounds: the next
``FIRST`` blocks, then ``GROWTH`` times as many, and so on. A round scores its blocks alone, through their forward indexes;
the others are not read to Python. The k-th best score so far is the query's floor, and the query is done as soon as the
bound of its next block is below it. Nothing that could enter the result is left out.

Scores are rounded to 6 decimals; equal ones rank by ``doc_id``, nulls last. Each distinct term of a query counts once.

Defined cases: texts that are null or hold no word are no documents and match nothing; texts of any length are read whole; a
query without a word of the corpus has no result; repeated rows, of documents as of queries, are answered apiece (queries
by their id and text); a query has fewer than k rows where fewer documents share a term; an empty table gives no rows;
further columns are ignored. Queries pass through the driver, ``QUERIES_A_PASS`` at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.llm.common import discard, maybe_broadcast, stored, text_batches

K1, B = 1.2, 0.75
BLOCK_DOCS = 256
#: Blocks of each query in the first round, and how many times more in each further one.
FIRST, GROWTH = 2, 8
#: Queries of one pass over the index; more are answered in more passes.
QUERIES_A_PASS = 2_000
#: How many blocks and queries there were, and pairs of both that were scored, since the count was last cleared.
PRUNED: Counter = Counter()
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _index(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_ids", "lengths", "starts", "terms", "counts", "distinct", "dfs"]
        ids: list = []
        lengths: list[int] = []
        starts, terms, counts = [0], [], []

        def block() -> pa.RecordBatch:
            distinct, dfs = np.unique(np.array(terms, np.int32), return_counts=True)
            whole = [pa.array([x], pa.list_(t)) for x, t in ((ids, id_type), (lengths, pa.int32()), (starts, pa.int32()), (terms, pa.int32()), (counts, pa.int32()), (distinct, pa.int32()), (dfs, pa.int64()))]
            return pa.RecordBatch.from_arrays(whole, names)

        for batch in text_batches(batches, 1):
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text) if text else ()
                if not found:
                    continue
                known = Counter(map(vocabulary.get, found))
                known.pop(None, None)
                ids.append(doc_id)
                lengths.append(len(found))
                terms.extend(known)
                counts.extend(known.values())
                starts.append(len(terms))
                if len(ids) == BLOCK_DOCS:
                    yield block()
                    ids, lengths, starts, terms, counts = [], [], [0], [], []
        if ids:
            yield block()

    return run


class Scorer:
    """Weights of terms and queries: ``owners`` are the places of queries, ``terms`` and ``edges`` their terms."""

    def __init__(self, idf: np.ndarray, mean: float, terms: np.ndarray, edges: np.ndarray, k: int):
        self.idf, self.mean, self.terms, self.edges, self.k = idf, mean, terms, edges, k

    def weights(self, block: dict) -> np.ndarray:
        per_doc = np.diff(block["starts"])
        norm = np.repeat(K1 * (1 - B + B * block["lengths"] / self.mean), per_doc)
        tf = block["counts"].astype(np.float64)
        return self.idf[block["terms"]] * tf * (K1 + 1) / (tf + norm)

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Of each query, from a block's terms and their largest weights."""
        dense = np.zeros(len(self.idf))
        dense[terms] = most
        return np.add.reduceat(np.append(dense[self.terms], 0.0), self.edges[:-1]) * (np.diff(self.edges) > 0)

    def score(self, block: dict, query: int) -> np.ndarray:
        chosen = np.zeros(len(self.idf), bool)
        chosen[self.terms[self.edges[query] : self.edges[query + 1]]] = True
        held = np.where(chosen[block["terms"]], block["weights"], 0.0)
        return np.round(np.add.reduceat(np.append(held, 0.0), block["starts"][:-1]) * (np.diff(block["starts"]) > 0), 6)


def _maxima(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = {n: np.array(batch.column(n)[i].values) for n in ("lengths", "starts", "terms", "counts")}
                terms = np.array(batch.column("distinct")[i].values)
                most = np.zeros(len(scorer.idf))
                np.maximum.at(most, block["terms"], scorer.weights(block))
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), pa.array([terms], pa.list_(pa.int32())), pa.array([most[terms]], pa.list_(pa.float64()))], ["block", "terms", "most"])

    return run


def _next(scorer: Scorer, floors: np.ndarray, marks: dict[str, np.ndarray], n: int):
    """Of each query that isn't done, this task's ``n`` first blocks by (falling bound, block) that come after its mark and
    whose bound reaches its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.flatnonzero(marks["open"])
        blocks, bounds = [], []

        def rows() -> pa.RecordBatch:
            block, bound = np.array(blocks, np.int64), np.stack(bounds)
            which, place = [], []
            for q in open_:
                b = bound[:, q]
                after = (b < marks["bound"][q]) | (b == marks["bound"][q]) & (block > marks["block"][q])
                found = np.flatnonzero(after & (b > 0) & (b + 2e-6 >= floors[q]))
                found = found[np.lexsort((block[found], -b[found]))][:n]
                which.append(found)
                place.append(np.full(len(found), q))
            which, place = np.concatenate(which or [np.zeros(0, np.int64)]), np.concatenate(place or [np.zeros(0, np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(block[which]), pa.array(bound[which, place] if len(which) else np.zeros(0))], ["place", "block", "bound"])

        for batch in batches:
            for i in range(batch.num_rows):
                blocks.append(batch.column("block")[i].as_py())
                bounds.append(scorer.bounds(np.array(batch.column("terms")[i].values), np.array(batch.column("most")[i].values)))
                if len(blocks) == 4096:
                    yield rows()
                    blocks, bounds = [], []
        if blocks:
            yield rows()

    return run


def _scored(scorer: Scorer, floors: np.ndarray):
    """The best documents of this task's blocks (with the ``places`` of the queries they are scored for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, best = floors.copy(), {}
        id_type = None
        for batch in batches:
            for i in range(batch.num_rows):
                block = {n: np.array(batch.column(n)[i].values) for n in ("lengths", "starts", "terms", "counts")}
                block["weights"], ids = scorer.weights(block), batch.column("doc_ids")[i].values
                id_type = ids.type
                for q in batch.column("places")[i].as_py():
                    scores = scorer.score(block, q)
                    hits = np.flatnonzero((scores > 0) & (scores >= floor[q]))
                    if len(hits):
                        pool = best.get(q, []) + list(zip(scores[hits].tolist(), ids.take(pa.array(hits)).to_pylist(), strict=True))
                        pool.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                        best[q] = pool[: scorer.k]
                        if len(best[q]) == scorer.k:
                            floor[q] = max(floor[q], best[q][-1][0])
        if best:
            rows = [(q, i, s) for q, own in best.items() for s, i in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.float64())], ["place", "doc_id", "score"])

    return run


def top_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query."""
    asked = queries.select(F.col(query_id).alias("item_id"), F.col(query_text).alias("text")).where("item_id is not null and text is not null")
    kinds = {"item_id": asked.schema["item_id"].dataType, "doc_id": docs.schema[id_col].dataType}
    out = None
    batch: list[tuple[object, list[str]]] = []
    for row in asked.orderBy("item_id", "text").toLocalIterator():
        batch.append((row["item_id"], sorted(set(words(row["text"])))))
        if len(batch) == QUERIES_A_PASS:
            found = _answer(docs, batch, k, id_col, text_col, kinds)
            out = found if out is None else out.unionByName(found)
            batch = []
    if batch or out is None:
        found = _answer(docs, batch, k, id_col, text_col, kinds)
        out = found if out is None else out.unionByName(found)
    return out


def _answer(docs: DataFrame, batch: list[tuple[object, list[str]]], k: int, id_col: str, text_col: str, kinds: dict) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, own in batch for w in own}))}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(kinds["doc_id"])), *(T.StructField(c, ints) for c in ("lengths", "starts", "terms", "counts", "distinct")), T.StructField("dfs", T.ArrayType(T.LongType()))])
    index = stored(rows.mapInArrow(_index(vocabulary), schema).withColumn("block", F.monotonically_increasing_id()), "forward")
    size = index.select(F.size("doc_ids").cast("long").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    n, total = size[0] or 0, size[1] or 0
    idf = np.zeros(len(vocabulary))
    for r in index.select(F.explode(F.arrays_zip("distinct", "dfs")).alias("x")).groupBy("x.distinct").agg(F.sum("x.dfs").alias("df")).toLocalIterator():
        idf[r["distinct"]] = math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
    # terms that no document holds weigh nothing
    edges = np.concatenate(([0], np.cumsum([len(own) for _, own in batch]))).astype(np.int64)
    terms = np.array([vocabulary[w] for _, own in batch for w in own], np.int64)
    scorer = Scorer(idf, total / n if n else 1.0, terms, edges, k)
    found = T.StructType([T.StructField("place", T.LongType()), T.StructField("doc_id", kinds["doc_id"]), T.StructField("score", T.DoubleType())])
    maxima = stored(index.mapInArrow(_maxima(scorer), "block long, terms array<int>, most array<double>"), "maxima")
    by_rank = W.partitionBy("place").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    by_bound = W.partitionBy("place").orderBy(F.desc("bound"), "block")
    floors = np.zeros(len(batch))
    marks = {"open": np.ones(len(batch), bool), "bound": np.full(len(batch), np.inf), "block": np.full(len(batch), -1)}
    best, turn = None, FIRST
    seen = Counter(blocks=maxima.count(), queries=len(batch))
    while marks["open"].any():
        pairs = maxima.mapInArrow(_next(scorer, floors, marks, turn), "place long, block long, bound double")
        pairs = stored(pairs.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= turn), "pairs")
        last = {r["place"]: r for r in pairs.groupBy("place").agg(F.count("*").alias("n"), F.max_by(F.struct("bound", "block"), "n").alias("at")).collect()}
        for q in np.flatnonzero(marks["open"]):
            r = last.get(int(q))
            if r is not None:
                marks["bound"][q], marks["block"][q] = r["at"]["bound"], r["at"]["block"]
                seen["scored"] += r["n"]
            marks["open"][q] = r is not None and r["n"] == turn
        if last:
            wanted = stored(pairs.groupBy("block").agg(F.collect_list("place").alias("places")), "wanted")
            blocks = index.select("block", "doc_ids", "lengths", "starts", "terms", "counts").join(maybe_broadcast(wanted), "block").drop("block")
            hits = blocks.mapInArrow(_scored(scorer, floors), found)
            hits = (hits if best is None else hits.unionByName(best)).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
            old, best = best, stored(hits.drop("rank"), "best")
            for r in best.groupBy("place").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k).collect():
                floors[r["place"]] = r["score"]
            for spent in (old, wanted):
                if spent is not None:
                    discard(spent)
        discard(pairs)
        turn *= GROWTH
    PRUNED.update(seen)
    names = spark.createDataFrame([(i, b[0]) for i, b in enumerate(batch)], T.StructType([T.StructField("place", T.LongType()), T.StructField("item_id", kinds["item_id"])]))
    hits = (best if best is not None else spark.createDataFrame([], found)).withColumn("rank", F.row_number().over(by_rank).cast("long"))
    return hits.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score")
