"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming search.

A signature is ``K`` symbols of 16 bits, one per MinHash of the document's word trigrams. The distance of two
signatures is the number of symbols in which they differ. The signature is split into ``K / CHUNK`` chunks; by the
pigeonhole principle two signatures at distance ``RADIUS`` or less differ in at most ``RADIUS // chunks`` symbols of
some chunk. Each chunk therefore emits one key for every way to leave that many symbols out, and every pair within the
radius shares a key. Buckets are verified against the whole signatures, so the search is exact for the signature
distance: no partner or candidate is capped. Keys are sorted by Spark and read as a stream; a bucket of more than ``BIG``
members is cut into blocks, and every two blocks are a bucket of their own, so that no task compares more at a time.

Defined cases: a null text, or one without a word, has no signature and is in no group. Texts of fewer than three words
have one shingle, the whole text. Repeated rows and equal ids are documents of their own and group by their texts.
A group's representative is its smallest non-null ``doc_id``. An empty table has no rows; texts of any length are hashed
whole. Further columns are carried or ignored, never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.llm.common import discard, maybe_broadcast, small_batches, stored, text_batches

K, CHUNK, RADIUS, SHINGLE = 64, 4, 31, 3
#: Members of a bucket that is verified as one; keys, and members of buckets, of one task.
BIG, TASK_KEYS, TASK_MEMBERS = 4096, 4_000_000, 1_000_000
_WORD = re.compile(r"\w+")
_U64, _U32 = np.uint64, np.uint32
_MIX1, _MIX2 = _U64(0xBF58476D1CE4E5B9), _U64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words, remembered while there are few enough."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _MIX1
    x = (x ^ (x >> _U64(27))) * _MIX2
    return x ^ (x >> _U64(31))


def permutations(k: int = K) -> tuple[np.ndarray, np.ndarray]:
    s = mix(np.arange(1, 2 * k + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
    return (s[:k] >> _U64(32)).astype(_U32) | _U32(1), (s[k:] >> _U64(32)).astype(_U32)


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of the runs of ``n`` words; of the whole if there are fewer words."""
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, _U64)
    for i in range(n):
        total = total * _U64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
    return (mix(total + _U64(n)) >> _U64(32)).astype(_U32)


def signature(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), 0xFFFFFFFF, _U32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (a[:, None] * x[None, i : i + 2048] + b[:, None]).min(axis=1), out=low)
    return ((low * _U32(0x9E3779B1)) >> _U32(16)).astype("<u2")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = permutations()
    hashes = WordHashes()
    for batch in text_batches(batches, 2):
        digests, signs = [], []
        for text in batch.column(2).to_pylist():
            words = _WORD.findall(text.lower()) if text else ()
            if not words:
                digests.append(None)
                signs.append(None)
                continue
            ids = np.fromiter(map(hashes.__getitem__, words), _U64, len(words))
            digests.append(xxhash.xxh3_128_digest(ids.tobytes()))
            signs.append(signature(shingle_hashes(ids), a, b).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "text_hash", "digest", "sig"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, digest, sig) of each row; digest is of the word sequence, both null without words."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())])
    return rows.mapInArrow(_sign, schema)


def chunk_keys(sigs: np.ndarray, radius: int, chunk: int) -> np.ndarray:
    """(rows, keys): for every chunk a key for each way to leave out the errors that pigeonhole allows in it."""
    n, k = sigs.shape
    chunks = k // chunk
    kept = list(combinations(range(chunk), chunk - min(radius // chunks, chunk - 1)))
    parts = sigs.reshape(n, chunks, chunk).astype(_U64)
    out = np.empty((n, chunks, len(kept)), _U64)
    for j, which in enumerate(kept):
        h = np.broadcast_to(mix(np.arange(chunks, dtype=_U64) * _U64(len(kept)) + _U64(j + 1)), (n, chunks))
        for p in which:
            h = mix(h ^ (parts[:, :, p] + _U64(0x9E3779B97F4A7C15)))
        out[:, :, j] = h
    return out.reshape(n, -1)


def _keys(radius: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                part = batch.slice(i, 4000)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(part.num_rows, -1)
                keys = chunk_keys(sigs, radius, chunk)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], ["key", "nid"])

    return run


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of two or more equal values."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    some = np.diff(edge) > 1
    return edge[:-1][some], edge[1:][some]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Members of each key of two or more, from batches (key, nid) in order of the key."""
    own, parts = None, []  # the key that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        key, nid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if parts and key[0] == own:
            n = len(key) if key[-1] == own else int(np.argmax(key != own))
            parts.append(nid[:n])
            key, nid = key[n:], nid[n:]
            if not len(key):
                continue
        if parts:
            yield np.concatenate(parts)
        last = int(np.argmax(key == key[-1]))
        for s, e in zip(*_runs(key[:last]), strict=True) if last else ():
            yield nid[s:e]
        own, parts = key[-1], [nid[last:]]
    if parts:
        yield np.concatenate(parts)


def _blocked(members: np.ndarray, big: int) -> Iterator[np.ndarray]:
    """``members`` whole, or every two of its blocks together."""
    if len(members) <= big:
        yield members
        return
    blocks = np.array_split(members, -(-len(members) // (big // 2)))
    for a, b in combinations(blocks, 2):
        yield np.concatenate([a, b])


def _buckets(big: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct member lists of this partition's buckets of two or more."""
        seen = set()
        out: list[np.ndarray] = []
        held = 0
        for some in _streamed(batches):
            members = np.unique(some)
            if len(members) < 2 or (d := xxhash.xxh3_128_digest(members.tobytes())) in seen:
                continue
            seen.add(d)
            for part in _blocked(members, big):
                out.append(part)
                held += len(part)
                if held > 500_000:
                    yield _lists(out)
                    out, held = [], 0
        if out:
            yield _lists(out)

    return run


def _lists(members: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(m) for m in members]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(members)))], ["members"])


def linked(sigs: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its component, where rows within ``radius`` are linked. Exact: every row that has
    joined a component is compared with all rows that have joined none."""
    root = np.full(len(sigs), -1)
    free = np.arange(len(sigs))
    while len(free):
        first, queue, free = free[0], [free[0]], free[1:]
        root[first] = first
        while queue and len(free):
            at = queue.pop()
            near = np.zeros(len(free), bool)
            for i in range(0, len(free), 65536):
                near[i : i + 65536] = np.count_nonzero(sigs[free[i : i + 65536]] != sigs[at], axis=1) <= radius
            root[free[near]] = first
            queue.extend(free[near])
            free = free[~near]
    return root


def _verify(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        bucket, nid = (np.concatenate([b.column(i).to_numpy() for b in table]) for i in (0, 1))
        sigs = np.frombuffer(b"".join(x for b in table for x in b.column(2).to_pylist()), "<u2").reshape(len(nid), -1)
        table.clear()
        order = np.lexsort((nid, bucket))
        bucket, nid = bucket[order], nid[order]
        starts, ends = _runs(bucket)
        two = starts[ends - starts == 2]
        a, b = order[two], order[two + 1]
        near = np.concatenate([np.count_nonzero(sigs[a[i : i + 100_000]] != sigs[b[i : i + 100_000]], axis=1) <= radius for i in range(0, len(a), 100_000)] or [np.zeros(0, bool)])
        src, dst = [nid[two + 1][near]], [nid[two][near]]
        for s, e in zip(starts, ends, strict=True):
            if e - s > 2:
                root = linked(sigs[order[s:e]], radius)
                out = np.flatnonzero(root != np.arange(e - s))
                src.append(nid[s:e][out])
                dst.append(nid[s:e][root[out]])
        src, dst = np.concatenate(src), np.concatenate(dst)
        if len(src):
            pairs = np.unique(np.stack([src, dst], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes; each step is a map-side combined minimum and
    a join, written to the shared folder.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        """Each u with its neighbours v, and the least of both."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = edges = stored(edges, "edges")
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("v < u").distinct()
        small = smallest(down)
        edges = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        old, edges = before, stored(edges, "edges")
        discard(old)
        before = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now


def near_edges(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Star edges (a, b) of ``nodes`` (nid, sig), a stored table, whose components are those of all pairs within ``radius``.
    Tasks are as many as the keys and the members need."""
    session = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda rows, most: max(-(-rows // most), min(session, -(-rows // (most // 16))), 1)
    keys = nodes.select("nid", "sig").mapInArrow(_keys(radius, chunk), "key long, nid long")
    keys = keys.repartition(tasks(nodes.count() * K, TASK_KEYS), "key").sortWithinPartitions("key")
    buckets = keys.mapInArrow(_buckets(BIG), "members array<long>").distinct()
    buckets = stored(buckets.select(F.monotonically_increasing_id().alias("bucket"), "members"), "buckets")
    total = buckets.agg(F.sum(F.size("members").cast("long"))).first()[0] or 0
    members = buckets.select("bucket", F.explode("members").alias("nid")).join(nodes.select("nid", "sig"), "nid")
    return members.select("bucket", "nid", "sig").repartition(tasks(total, TASK_MEMBERS), "bucket").mapInArrow(_verify(radius), "a long, b long")


def _grouped(docs: DataFrame, radius: int, id_col: str, text_col: str) -> DataFrame:
    signed = stored(signatures(docs, id_col, text_col), "signed")
    rows = signed.where("digest is not null")
    nodes = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.any_value("sig").alias("sig"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("nid"), "*"), "nodes")
    roots = components(near_edges(nodes, radius))
    named = nodes.select("nid", "digest", "least", "n").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    total = named.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("n").alias("group_size")).where("group_size > 1")
    groups = named.join(total, "root").select("digest", "root", "group_id", "group_size")
    return rows.select("doc_id", "text_hash", "digest").join(groups, "digest").drop("digest")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, group_size) of every row in a group of two or more near or exact copies."""
    return _grouped(docs, radius, id_col, text_col).select("doc_id", "group_id", "group_size")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest ``doc_id`` (nulls last); of equal ids, one row."""
    name = "__text_hash"
    while name in docs.columns:
        name += "_"
    found = _grouped(docs, radius, id_col, text_col)
    rows = found.groupBy("doc_id", "text_hash").agg(F.any_value("root").alias("root"), F.count("*").alias("copies"))
    rows = stored(rows, "near")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("k"))
    kept = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_hash") == F.col("k.text_hash"))
    marks = stored(rows.join(best, "root").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), "copies", kept.alias("kept")), "marks")
    drop, repeated = marks.where("not kept").select("__d", "__h"), marks.where("kept and copies > 1").select("__d", "__h")
    again = repeated.limit(1).count()
    out = docs.withColumn(name, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("__d")) & (F.col(name) == F.col("__h"))
    out = out.join(maybe_broadcast(drop), same, "left_anti")
    if again:
        side = maybe_broadcast(repeated)
        out = out.join(side, same, "left_anti").unionByName(out.join(side, same, "left_semi").dropDuplicates([id_col, name]))
    return out.drop(name)
