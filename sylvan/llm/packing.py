"""Packing of documents into sequences of at most ``CAPACITY`` characters by best-two-fit.

Documents are spread by a hash of their id and text over shards of about ``SHARD_CHARS`` characters, as many as the corpus
needs, and each shard is packed on its own: a bin is filled greedily with the longest piece that fits its gap; then its
smallest piece gives way to two unpacked pieces that together fill the widened gap more tightly, if there are any (those
whose sum is largest). A text longer than a bin is cut: its full parts are bins of their own, its rest is packed as a
piece. Each piece but a bin's first costs ``len(SEPARATOR)`` more. Texts travel once, with the one shuffle by shard.

Defined cases: null and empty texts are in no bin; texts of any length are packed whole; ids may be of any type that can be
ordered (numbers, strings, dates), and a null id is carried as null; repeated rows are packed as often as they occur; equal
lengths go by id, then text; an empty table has no bins; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, SHARD_CHARS, SEPARATOR = 8192, 16_000_000, "\n\n"


class Pool:
    """Unpacked pieces by size; which sizes there are is one integer's bits, read from either end."""

    def __init__(self, most: int):
        self.most, self.bits, self.mirror = most, 0, 0
        self.by_size: dict[int, deque] = defaultdict(deque)

    def put(self, size: int, piece: int, first: bool = False) -> None:
        queue = self.by_size[size]
        queue.appendleft(piece) if first else queue.append(piece)
        self.bits |= 1 << size
        self.mirror |= 1 << (self.most - size)

    def take(self, size: int) -> int:
        queue = self.by_size[size]
        piece = queue.popleft()
        if not queue:
            self.bits ^= 1 << size
            self.mirror ^= 1 << (self.most - size)
        return piece

    def fitting(self, gap: int) -> int:
        """The largest size up to ``gap``; 0 if there is none."""
        return max((self.bits & ((2 << gap) - 1)).bit_length() - 1, 0)

    def pair(self, gap: int, above: int) -> tuple[int, int] | None:
        """Two sizes with the largest sum up to ``gap`` and over ``above``; of such, those with the largest piece."""
        for total in range(gap, above, -1):
            shift = self.most - total
            both = self.bits & (self.mirror >> shift if shift >= 0 else self.mirror << -shift)
            if total % 2 == 0 and len(self.by_size.get(total // 2, ())) < 2:
                both &= ~(1 << (total // 2))
            if both:
                a = both.bit_length() - 1
                return a, total - a
        return None


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices into ``sizes`` (each from 1 to ``capacity``)."""
    pool = Pool(capacity)
    for i, n in enumerate(sizes):
        pool.put(n, i)
    bins = []
    while pool.bits:
        gap, own = capacity, []
        while n := pool.fitting(gap):
            own.append(pool.take(n))
            gap -= n
        small = sizes[own[-1]]
        if gap and (two := pool.pair(gap + small, small)):
            out = own.pop()
            own += [pool.take(n) for n in two]
            pool.put(small, out, first=True)
        bins.append(own)
    return bins


def pack_texts(rows: list[tuple], capacity: int = CAPACITY, separator: str = SEPARATOR) -> list[tuple[list, list[int], list[int], str]]:
    """Bins of rows (id, text): (ids, starts, lengths, text)."""
    rows = sorted((r for r in rows if r[1]), key=lambda r: (len(r[1]), r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    pieces = [(k, at, min(capacity, len(t) - at)) for k, (_, t) in enumerate(rows) for at in range(0, len(t), capacity)]
    cost = len(separator)
    return [
        ([rows[pieces[i][0]][0] for i in own], [pieces[i][1] for i in own], [pieces[i][2] for i in own], separator.join(rows[pieces[i][0]][1][pieces[i][1] : pieces[i][1] + pieces[i][2]] for i in own))
        for own in best_two_fit([n + cost for _, _, n in pieces], capacity + cost)
    ]


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_chars: int = SHARD_CHARS, separator: str = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, bin, doc_ids, starts, lengths, used, text): one row a bin, ``text`` the pieces joined by ``separator``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    shards = -(-total // shard_chars) or 1
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        bins = pack_texts(list(zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist(), strict=True)), capacity, separator)
        return pa.table([
            pa.array([shard] * len(bins), pa.int64()), pa.array(range(len(bins)), pa.int64()), pa.array([b[0] for b in bins], pa.list_(group.schema.field("doc_id").type)), pa.array([b[1] for b in bins], pa.list_(pa.int32())),
            pa.array([b[2] for b in bins], pa.list_(pa.int32())), pa.array([len(b[3]) for b in bins], pa.int64()), pa.array([b[3] for b in bins], pa.string()),
        ], ["shard", "bin", "doc_ids", "starts", "lengths", "used", "text"])

    spread = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    return spread.groupBy("shard").applyInArrow(pack, f"shard long, bin long, doc_ids array<{kind}>, starts array<int>, lengths array<int>, used long, text string")
