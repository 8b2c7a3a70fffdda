"""The inverted index as tables, and its upkeep: difference, deletion, renaming, pruning, checks, statistics.

``postings(term, doc_id, node_id, col, tf, positions, dl)`` carries the node's length, so scoring needs no join with nodes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import text as X
from sylvan.operators.lineage import cut, small_batches
from sylvan.plans.query import COLUMNS
from sylvan.sources import discovery

#: Words that are sorted at a time (some 100 bytes each for a while, in each of an executor's workers).
BATCH_WORDS = 250_000


def fields(nodes: DataFrame, markdown: bool | Column = False, with_summary: bool = True) -> DataFrame:
    """Nodes (doc_id, node_id, title, text) with the indexed columns; Markdown texts are split into theirs."""
    text = F.coalesce("text", F.lit(""))
    plain = {"front_matter": F.lit(""), "code_blocks": F.lit(""), "body": text}
    if markdown is False:
        out = nodes.withColumns(plain)
    else:
        split = dict(zip(plain, X.md_fields(text), strict=True))
        out = nodes.withColumns(split if markdown is True else {c: F.when(markdown, split[c]).otherwise(plain[c]) for c in plain})
    return out.withColumn("summary", X.summary(text) if with_summary else F.lit(""))


def _counted(columns: list[str]):
    """Rows (doc_id, node_id, words of each column) to postings, by whole arrays: words become codes, equal codes of a row
    runs of a stable sort, and a run's places are the positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = sum(pc.list_value_length(whole.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
            edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_WORDS)) + 1).tolist(), whole.num_rows]
            for begin, end in zip(edges, edges[1:], strict=False):
                batch, dl = whole.slice(begin, end - begin), sizes[begin:end]
                for name in columns:
                    words = batch.column(name)
                    n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                    coded = words.flatten().dictionary_encode()
                    codes = coded.indices.to_numpy().astype(np.int64)
                    if not len(codes):
                        continue
                    row = np.repeat(np.arange(len(n)), n)
                    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    key = row * len(coded.dictionary) + codes
                    order = np.argsort(key, kind="stable")
                    key = key[order]
                    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    first = order[heads]
                    ends = np.append(heads, len(key)).astype(np.int32)
                    own = pa.array(row[first])
                    yield pa.RecordBatch.from_arrays(
                        [coded.dictionary.take(pa.array(codes[first])), batch.column("doc_id").take(own), batch.column("node_id").take(own), pa.array([name]).take(pa.array(np.zeros(len(heads), np.int64))), pa.array(dl[row[first]].astype(np.int32)), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order].astype(np.int32)))],
                        ["term", "doc_id", "node_id", "col", "dl", "tf", "positions"],
                    )

    return run


def postings(indexed: DataFrame, mode: str = "bigram", dictionary: tuple[str, ...] = ()) -> DataFrame:
    """One row a term, node and column. ``indexed`` has (doc_id, node_id) and any of the indexed columns. All words of a
    node are in its row, so they are counted there, in Arrow batches of bounded size; nothing is shuffled."""
    small_batches(indexed.sparkSession)
    own = [c for c in COLUMNS if c in indexed.columns]
    words = indexed.select("doc_id", "node_id", *[X.index_tokens(F.col(c), mode, dictionary).alias(c) for c in own])
    kind = {c: words.schema[c].dataType.simpleString() for c in ("doc_id", "node_id")}
    return words.mapInArrow(_counted(own), f"term string, doc_id {kind['doc_id']}, node_id {kind['node_id']}, col string, dl int, tf int, positions array<int>")


def by_term(posts: DataFrame) -> DataFrame:
    """Postings in files sorted by term, so that a search reads the row groups of its terms; frequent terms are spread."""
    return posts.hint("rebalance", F.col("term")).sortWithinPartitions("term")


def corpus_stats(indexed: DataFrame, mode: str = "bigram") -> DataFrame:
    """One row (n, avgdl) over all nodes, those without a word too."""
    own = [F.size(X.index_tokens(F.col(c), mode)) for c in COLUMNS if c in indexed.columns]
    return indexed.agg(F.count("*").alias("n"), F.avg(sum(own[1:], own[0])).alias("avgdl"))


def stats_of(posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same row from postings (whose counts add up to the lengths) and the number of nodes: no text is read again."""
    return nodes.agg(F.count("*").alias("n")).crossJoin(posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("__w"))).select("n", (F.col("__w") / F.greatest("n", F.lit(1))).alias("avgdl"))


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return posts.groupBy("term", "doc_id", "node_id").agg(F.sum("tf").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


class Index:
    """Tables in segments below ``path``. Every change writes one new segment: the new rows and the keys of the rows before
    it that are gone. A small pointer file lists the segments, so a reader sees either the old or the new state whole;
    :meth:`compact` merges them, and does so by itself beyond ``MAX_SEGMENTS``.

    ``documents``, ``nodes`` and ``postings`` go by ``doc_id``, ``meta`` (source_path, file_hash) by ``source_path``.
    """

    KEYS = {"documents": "doc_id", "nodes": "doc_id", "postings": "doc_id", "meta": "source_path"}
    TABLES = tuple(KEYS)
    MAX_SEGMENTS = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def _exists(self, name: str) -> bool:
        fs, jvm = self._fs()
        return fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def segments(self) -> list[str]:
        """The segments of the current state, oldest first."""
        if not self._exists("CURRENT"):
            return []
        return [r[0] for r in self.spark.read.text(f"{self.path}/CURRENT").collect()]  # at most MAX_SEGMENTS lines

    def version(self) -> str | None:
        found = self.segments()
        return found[-1] if found else None

    def table(self, name: str) -> DataFrame:
        found = self.segments()
        if not found:
            raise FileNotFoundError(f"no index in {self.path}")
        return self._table(name, found)

    def _table(self, name: str, found: list[str]) -> DataFrame:
        """The rows of each segment that no later one has replaced or removed."""
        key, rows, gone = self.KEYS[name], None, None
        for i, segment in enumerate(found):
            if self._exists(f"{segment}/{name}"):
                own = self.spark.read.parquet(f"{self.path}/{segment}/{name}").withColumn("__at", F.lit(i))
                rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
            if i and self._exists(f"{segment}/gone"):
                own = self.spark.read.parquet(f"{self.path}/{segment}/gone").where(F.col("of") == name).select(F.col("key").alias("__key"), F.lit(i).alias("__since"))
                gone = own if gone is None else gone.unionByName(own)
        if rows is None:
            raise FileNotFoundError(f"no {name} in {self.path}")
        if gone is not None:
            gone = gone.groupBy("__key").agg(F.max("__since").alias("__since"))
            rows = rows.join(gone, (F.col(key).cast("string") == F.col("__key")) & (F.col("__at") < F.col("__since")), "left_anti")
        return rows.drop("__at")

    def _write(self, segment: str, name: str, df: DataFrame) -> None:
        if name == "postings":
            df = by_term(df)
        df.write.parquet(f"{self.path}/{segment}/{name}")

    def _point(self, segments: list[str]) -> None:
        """Make ``segments`` the current state, by one atomic rename."""
        fs, jvm = self._fs()
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray("".join(f"{s}\n" for s in segments).encode()))
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        sc = self.spark.sparkContext
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = sc._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(final), over)

    def save(self, **tables: DataFrame) -> str:
        """Make the given tables the whole state; those that aren't given are taken over."""
        old, new = self.segments(), f"s-{uuid.uuid4().hex}"
        for name in self.TABLES:
            df = tables.get(name)
            if df is None and old:
                df = self._table(name, old)
            if df is not None:
                self._write(new, name, df)
        self._point([new])
        return new

    def change(self, gone: dict[str, DataFrame], **tables: DataFrame) -> str:
        """A new segment: rows of ``tables``, before which the keys ``gone`` (a column a table) end. Files are written
        before the pointer moves, so plans over the state so far may be among them."""
        old, new = self.segments(), f"s-{uuid.uuid4().hex}"
        for name, df in tables.items():
            self._write(new, name, df)
        keys = None
        for name, df in gone.items():
            own = df.select(F.lit(name).alias("of"), F.col(df.columns[0]).cast("string").alias("key")).distinct()
            keys = own if keys is None else keys.unionByName(own)
        if keys is not None:
            keys.write.parquet(f"{self.path}/{new}/gone")
        self._point([*old, new])
        if len(old) + 1 > self.MAX_SEGMENTS:
            self.compact()
        return new

    def vacuum(self) -> int:
        """Remove all segments but the current ones, once no reader is on them; how many there were."""
        fs, jvm = self._fs()
        current, gone = set(self.segments()), 0
        for entry in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)):
            name = entry.getPath().getName()
            if name.startswith("s-") and name not in current:
                fs.delete(entry.getPath(), True)
                gone += 1
        return gone

    def add(self, nodes: DataFrame, documents: DataFrame, meta: DataFrame | None = None, markdown: bool | Column = False, force: bool = False, mode: str = "bigram") -> dict[str, int]:
        """Index documents anew or again; documents without a changed node are left as they are, unless ``force``. Counts of
        nodes by state. ``markdown`` may be a column of ``nodes``."""
        fresh = fields(nodes, markdown).withColumn("content_hash", F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16))
        if self.version() is None:
            fresh = cut(fresh)
            self.save(documents=documents, nodes=fresh, postings=postings(fresh, mode), meta=meta if meta is not None else self.spark.createDataFrame([], "source_path string, file_hash string"))
            return {"added": fresh.count(), "changed": 0, "removed": 0, "kept": 0}
        fresh = cut(fresh)
        old = self.table("nodes")
        states = cut(node_diff(old.join(fresh.select("doc_id").distinct(), "doc_id", "left_semi"), fresh))
        touched = fresh.select("doc_id").distinct() if force else states.where("state <> 'kept'").select("doc_id").distinct()
        counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
        replaced = fresh.join(touched, "doc_id", "left_semi")
        gone = {"documents": documents.select("doc_id"), "nodes": touched, "postings": touched} | ({"meta": meta.select("source_path")} if meta is not None else {})
        self.change(gone, documents=documents, nodes=replaced, postings=postings(replaced, mode), **({"meta": meta} if meta is not None else {}))
        return {k: counts.get(k, 0) for k in ("added", "changed", "removed", "kept")}

    def delete(self, doc_ids: list[str] | DataFrame) -> int:
        """Remove documents (given, or those of column ``doc_id``) from all tables; how many there were."""
        gone = doc_ids.select("doc_id") if isinstance(doc_ids, DataFrame) else self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
        known = cut(self.table("documents").join(gone.distinct(), "doc_id", "left_semi"))
        n = known.count()
        if n:
            ends = {name: known.select("doc_id") for name in ("documents", "nodes", "postings")}
            self.change(ends | ({"meta": known.select("source_path").where("source_path is not null")} if "source_path" in known.columns else {}))
        return n

    def delete_paths(self, *paths_or_ids: str) -> int:
        """Remove documents by source path (as stored, or as the file system writes it), else by id; how many there were."""
        asked = self.spark.createDataFrame([(p, q) for p in paths_or_ids for q in {p, discovery.qualified(self.spark, p)}], "asked string, source_path string")
        docs = self.table("documents")
        by_path = cut(docs.join(asked, "source_path").select("doc_id", "asked")) if "source_path" in docs.columns else self.spark.createDataFrame([], "doc_id string, asked string")
        by_id = asked.select("asked").distinct().join(by_path, "asked", "left_anti").select(F.col("asked").alias("doc_id"))
        return self.delete(by_path.select("doc_id").unionByName(by_id).distinct())

    def rename(self, old: str, new: str, source_path: str | None = None) -> bool:
        """Give a document another id (and path) without parsing it again; refused if the new one is taken."""
        return self.rename_all(self.spark.createDataFrame([(old, new, source_path)], "old string, new string, path string")) == 1

    def rename_all(self, moved: DataFrame) -> int:
        """Give documents (old, new, path) other ids and paths, in one change; those whose new id is taken stay. How many."""
        docs = self.table("documents")
        ids = docs.select("doc_id")
        moved = cut(moved.join(ids.withColumnRenamed("doc_id", "old"), "old", "left_semi").join(ids.withColumnRenamed("doc_id", "new"), "new", "left_anti"))
        n = moved.count()
        if n:
            swapped = lambda df: df.join(moved.select(F.col("old").alias("doc_id"), "new"), "doc_id").withColumn("doc_id", F.col("new")).drop("new")
            documents = docs.join(moved.select(F.col("old").alias("doc_id"), "new", "path"), "doc_id").withColumn("doc_id", F.col("new"))
            gone, tables = {name: moved.select("old") for name in ("documents", "nodes", "postings")}, {}
            if "source_path" in docs.columns:
                was = cut(documents.where("path is not null").select(F.col("source_path").alias("was"), F.col("path").alias("source_path")))
                documents = documents.withColumn("source_path", F.coalesce("path", "source_path"))
                gone["meta"] = was.select("was")
                tables["meta"] = self.table("meta").join(was.withColumnRenamed("source_path", "path"), F.col("source_path") == F.col("was")).select(F.col("path").alias("source_path"), "file_hash")
            self.change(gone, documents=documents.select(*docs.columns), nodes=swapped(self.table("nodes")), postings=swapped(self.table("postings")), **tables)
        return n

    def load(self, doc_id: str | None = None) -> DataFrame:
        """Nodes of one document or of all, in order."""
        nodes = self.table("nodes")
        return (nodes if doc_id is None else nodes.where(F.col("doc_id") == doc_id)).orderBy("doc_id", "ord")

    def missing_files(self) -> DataFrame:
        """(source_path) of known files that are gone from their file systems, looked up where the rows are."""
        paths = self.table("meta").select("source_path")
        folders = [r[0] for r in paths.select(F.regexp_extract("source_path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct().toLocalIterator()]
        there = [f for f in folders if discovery.exists(self.spark, f)]
        if not there:
            return paths
        found = self.spark.read.format("binaryFile").load(there).select(F.col("path").alias("source_path"))
        return paths.join(found, "source_path", "left_anti")

    def verify(self, files: bool = False) -> dict[str, int]:
        """How many ids and paths belong to no document, and, on request, how many known files are gone."""
        found = {name: df.count() for name, df in orphans(self.table("documents"), self.table("nodes"), self.table("postings"), self.table("meta")).items()}
        return found | ({"missing_files": self.missing_files().count()} if files else {})

    def repair(self, drop_missing_files: bool = False) -> dict[str, int]:
        """Drop what belongs to no document, and, on request, documents whose files are gone; how many keys by table."""
        done = {}
        if drop_missing_files:
            gone = cut(self.missing_files())
            docs = self.table("documents")
            done["missing_files"] = self.delete(docs.join(gone, "source_path", "left_semi")) if "source_path" in docs.columns else 0
        found = {name: cut(df) for name, df in orphans(self.table("documents"), self.table("nodes"), self.table("postings"), self.table("meta")).items()}
        done |= {name: df.count() for name, df in found.items()}
        if any(done[name] for name in found):
            self.change(found)
        return done

    def compact(self, files: int | None = None) -> None:
        """Merge all segments to one, of ``files`` files a table if given."""
        self.save(**({n: self.table(n).coalesce(files) for n in self.TABLES} if files else {}))

    def clear(self) -> None:
        self.save(**{n: self.table(n).limit(0) for n in self.TABLES})

    def stats(self) -> DataFrame:
        return index_stats(self.table("documents"), self.table("nodes"))

    def indexed_files(self) -> DataFrame:
        return self.table("meta").select("source_path").orderBy("source_path")

    def is_indexed(self, doc_id: str) -> bool:
        return bool(self.version()) and bool(self.table("documents").where(F.col("doc_id") == doc_id).limit(1).count())


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, node_id, state): added, changed, removed or kept, by content hash."""
    a = old.select("doc_id", "node_id", F.col("content_hash").alias("__a"))
    b = new.select("doc_id", "node_id", F.col("content_hash").alias("__b"))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") == F.col("__b"), "kept").otherwise("changed")
    return a.join(b, ["doc_id", "node_id"], "full_outer").select("doc_id", "node_id", state.alias("state"))


def changed_files(listed: DataFrame, meta: DataFrame) -> DataFrame:
    """Listed (source_path, file_hash) that are new or differ."""
    return listed.join(meta, ["source_path", "file_hash"], "left_anti")


def pruned(meta: DataFrame, listed: DataFrame) -> DataFrame:
    """Known files that are listed no more."""
    return meta.join(listed, "source_path", "left_anti")


def moves(meta: DataFrame, listed: DataFrame) -> DataFrame:
    """(old_path, new_path): content that vanished from one path and stands at a new one; of several the first."""
    return moved(pruned(meta, listed), listed.join(meta, "source_path", "left_anti"))


def moved(gone: DataFrame, come: DataFrame) -> DataFrame:
    """The same of vanished and new files (source_path, file_hash)."""
    side = lambda df, name: df.groupBy("file_hash").agg(F.min("source_path").alias(name))
    return side(gone, "old_path").join(side(come, "new_path"), "file_hash").select("old_path", "new_path")


def orphans(documents: DataFrame, nodes: DataFrame, posts: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    """Ids of nodes and postings without a document, and paths of meta rows without one."""
    ids = documents.select("doc_id")
    out = {"nodes": nodes.select("doc_id").distinct().join(ids, "doc_id", "left_anti"), "postings": posts.select("doc_id").distinct().join(ids, "doc_id", "left_anti")}
    if "source_path" in documents.columns:
        out["meta"] = meta.join(documents.select("source_path"), "source_path", "left_anti").select("source_path")
    return out


def unindexed(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    return wanted.select("doc_id").exceptAll(documents.select("doc_id"))


def index_stats(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_type, documents, nodes, chars)."""
    sizes = nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.sum(F.length("text")).alias("chars"))
    return documents.join(sizes, "doc_id", "left").groupBy("source_type").agg(F.count("*").alias("documents"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
