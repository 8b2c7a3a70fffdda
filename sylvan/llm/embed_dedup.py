"""Near-duplicate embeddings: vectors linked by a cosine that reaches a threshold, by PCA-ordered tiled comparison.

Equal vectors are one (with the number of its copies) before anything is compared. Vectors are normed and rotated to their
principal axes, strongest first (second moments of all distinct vectors). Two vectors at cosine t or more lie within
r = sqrt(2 - 2t), so on a grid of width r over the two leading axes only neighbouring cells can hold links; cells are cut
into tiles of up to about ``TILE`` rows of 64 dimensions. A tile is sent, as the table's own numbers, to each tile before
it that is near (its home), and stays home once for every ``GUESTS`` tiles that visit it, so a group's memory is bounded
whatever the cell. A comparison adds up the leading dimensions first; the rest of a product is at most the product of the
two suffix norms, so pairs whose sum and bound stay below the threshold are dropped, and a block of pairs without a survivor
stops there. Sums that single precision can't tell from the threshold are settled in double precision.

The result has a row for every vector, with its class (the smallest id of all that links join it to, directly or over
others) and the number of its links; groups send links on as counts and one edge a vector, never as pairs.

Defined cases: a vector that is null, empty, of another length than the commonest (of equally common the smallest), zero,
or with a null or not finite number has no direction: no link, and its own id as class. Vectors of any finite size have one.
Repeated rows are vectors of their own that link each other; equal ids too. A null id is carried, and is a class id only
where no vector of the class has another. An empty table has no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.llm.common import maybe_broadcast, stored
from sylvan.llm.minhash import components

THRESHOLD, TILE, BLOCK, GUESTS = 0.9, 8192, 1024, 8
#: Dimensions after which pairs are dropped.
STEPS = (16, 32)
#: Of the moments, so many partial sums reach the driver (width squared numbers each).
_SUMS = 4


def unit(column: pa.Array, width: int) -> np.ndarray:
    """Rows of norm 1; scaled first, so that no square over- or underflows."""
    x = np.asarray(column.flatten()).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column(0), width)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _added(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _cells(axes: np.ndarray, cell: float):
    width = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column(2), width) @ axes[:, :2]
                a, b = (np.floor(x[:, d] / cell).astype(np.int32) if d < width else np.zeros(len(x), np.int32) for d in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a), pa.array(b)], [*batch.schema.names, "a", "b"])

    return run


def linked_blocks(x: np.ndarray, y: np.ndarray, exact_x: np.ndarray, exact_y: np.ndarray, threshold: float, same: bool, steps: tuple[int, ...] = STEPS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in x, in y) of all pairs that reach ``threshold``, a block at a time; of one set with itself only the upper
    half. ``x`` and ``y`` are in single precision, leading dimensions first; the exact ones settle what those can't."""
    width = x.shape[1]
    steps = tuple(s for s in steps if s < width) or (width,)
    rest = {s: (np.sqrt((x[:, s:] ** 2).sum(axis=1)), np.sqrt((y[:, s:] ** 2).sum(axis=1))) for s in steps}
    error = 1e-7 * width + 1e-6
    least, first = threshold - error, steps[0]
    for i in range(0, len(x), BLOCK):
        for j in range(i if same else 0, len(y), BLOCK):
            part = x[i : i + BLOCK, :first] @ y[j : j + BLOCK, :first].T
            alive = part + np.multiply.outer(rest[first][0][i : i + BLOCK], rest[first][1][j : j + BLOCK]) >= least
            n = np.count_nonzero(alive)
            if not n:
                continue
            if n > alive.size // 16:
                part = part + x[i : i + BLOCK, first:] @ y[j : j + BLOCK, first:].T
                alive = part >= least
            p, q = np.nonzero(alive)
            if same and i == j:
                p, q = p[p < q], q[p < q]
            sums = part[p, q]
            p, q = p + i, q + j
            if n <= alive.size // 16:
                for begin, end in zip(steps, (*steps[1:], width), strict=True):
                    sums = sums + np.einsum("ij,ij->i", x[p, begin:end], y[q, begin:end])
                    stay = sums + (rest[end][0][p] * rest[end][1][q] if end in rest else 0) >= least
                    p, q, sums = p[stay], q[stay], sums[stay]
                    if not len(p):
                        break
            close = np.flatnonzero(sums < threshold + error)
            if len(close):
                keep = np.ones(len(p), bool)
                for k in range(0, len(close), 50_000):
                    c = close[k : k + 50_000]
                    keep[c] = np.einsum("ij,ij->i", exact_x[p[c]], exact_y[q[c]]) >= threshold
                p, q = p[keep], q[keep]
            if len(p):
                yield p, q


def unite(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``root`` (each place's smallest known partner) after joining the places p and q."""
    while True:
        while (root[root] != root).any():
            root = root[root]
        low, high = np.minimum(root[p], root[q]), np.maximum(root[p], root[q])
        apart = low < high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])


def _compare(axes: np.ndarray, threshold: float):
    width = len(axes)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        order = np.argsort(np.asarray(group.column("nid")), kind="stable")
        group = group.take(pa.array(order))
        nid, copies, home = (np.asarray(group.column(c)) for c in ("nid", "copies", "home"))
        exact = unit(group.column("embedding").combine_chunks(), width)
        turned = (exact @ axes).astype(np.float32)
        own, guests = np.flatnonzero(home), np.flatnonzero(~home)
        links, root = np.zeros(len(nid), np.int64), np.arange(len(nid))
        parts = [(own, own, True)] if key[3].as_py() == 0 else []
        for a, b, same in (*parts, (own, guests, False)):
            for p, q in linked_blocks(turned[a], turned[b], exact[a], exact[b], threshold, same):
                p, q = a[p], b[q]
                links += np.bincount(p, copies[q], len(nid)).astype(np.int64) + np.bincount(q, copies[p], len(nid)).astype(np.int64)
                root = unite(root, p, q)
        some = np.flatnonzero(links)
        return pa.table([pa.array(nid[some]), pa.array(links[some]), pa.array(nid[root[some]])], ["nid", "links", "root"])

    return run


def _tiles(cells: list[tuple[int, int, int]], tile: int) -> list[tuple]:
    """(a, b, tiles, homes) of each cell of (a, b, rows): ``homes`` has, for the cell itself and every near one before it,
    (a, b, tiles, offset): the number of its tiles and of the guests its first tile has from cells before this."""
    count = {(a, b): -(-n // tile) for a, b, n in cells}
    homes: dict[tuple, list] = {c: [] for c in count}
    total = {}
    for (a, b), own in sorted(count.items()):
        homes[a, b].append((a, b, own, 0))
        offset = own - 1
        for c in sorted((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if c > (a, b) and c in count:
                homes[c].append((a, b, own, offset))
                offset += count[c]
        total[a, b] = offset
    return [(a, b, n, total[a, b], homes[a, b]) for (a, b), n in count.items()]


def near_classes(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(vec_id, class_id, links) of every row: the number of other rows with cosine ``threshold`` or more, and the smallest
    id of the rows that such links join to it."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    if not isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    common = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if common is None:
        return rows.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    width = common["w"]
    sound = F.coalesce((F.size("embedding") == width) & finite, F.lit(False))
    same = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    distinct = rows.where(sound).groupBy(*same).agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    distinct = stored(distinct.select(F.monotonically_increasing_id().alias("nid"), "*"), "distinct")

    parts = distinct.select("embedding").mapInArrow(_moments(width), "sums binary").repartition(_SUMS).mapInArrow(_added(width), "sums binary").collect()
    axes = np.linalg.eigh(sum(np.frombuffer(p["sums"]) for p in parts).reshape(width, width))[1][:, ::-1].copy()
    cell = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + 1e-6
    kinds = distinct.schema
    placed = T.StructType([kinds["nid"], kinds["copies"], kinds["embedding"], T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    placed = stored(distinct.select("nid", "copies", "embedding").mapInArrow(_cells(axes, cell), placed), "placed")

    cells = [(r["a"], r["b"], r["count"]) for r in placed.groupBy("a", "b").count().collect()]  # at most (2 / r + 1)^2 rows
    known = "a int, b int, tiles long, guests long, homes array<struct<a2: int, b2: int, tiles2: long, offset: long>>"
    table = spark.createDataFrame(_tiles(cells, max(64, tile * 64 // max(width, 64))), known)
    tiled = placed.join(F.broadcast(table), ["a", "b"]).withColumn("tile", F.pmod(F.xxhash64("nid"), F.col("tiles")))
    body = ["nid", "copies", "embedding"]
    chunks = F.greatest(F.ceil((F.col("guests") - F.col("tile")) / F.lit(GUESTS)), F.lit(1)).cast("long")
    at_home = tiled.select("a", "b", "tile", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), F.lit(True).alias("home"), *body)
    visits = tiled.select("a", "b", F.col("tile").alias("own"), F.explode("homes").alias("h"), *body)
    itself = (F.col("h.a2") == F.col("a")) & (F.col("h.b2") == F.col("b"))
    last = F.when(itself, F.col("own")).otherwise(F.col("h.tiles2")) - 1
    visits = visits.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("tile"))
    place = F.when(itself, F.col("own") - F.col("tile") - 1).otherwise(F.col("h.offset") - F.col("tile") + F.col("own"))
    visits = visits.select(F.col("h.a2").alias("a"), F.col("h.b2").alias("b"), "tile", F.floor(place / GUESTS).cast("long").alias("chunk"), F.lit(False).alias("home"), *body)
    found = at_home.unionByName(visits).groupBy("a", "b", "tile", "chunk").applyInArrow(_compare(axes, threshold), "nid long, links long, root long")
    found = stored(found, "links")

    links = found.groupBy("nid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("nid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "nid")
    named = distinct.select("nid", "h1", "h2", "copies", "least").join(links, "nid", "left").join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    named = stored(named.select("root", "h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "named")
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = named.join(classes, "root").select("h1", "h2", "class_id", "links")
    linked = rows.where(sound).select("vec_id", *same).join(maybe_broadcast(stored(named, "classes")), ["h1", "h2"]).select("vec_id", "class_id", "links")
    return linked.unionByName(rows.where(~sound).select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("links")))
