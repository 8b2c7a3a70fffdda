"""Shared helpers: the shared folder for cut lineage, size-checked broadcasts, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators.lineage import cut, discard, scratch_dir, shared_dir, small_batches

__all__ = ["BATCH_CHARS", "BROADCAST_BYTES", "discard", "maybe_broadcast", "scratch_dir", "shared_dir", "small_batches", "stored", "text_batches"]

#: A side is broadcast up to so many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Characters of text that one Python batch holds at most (a single longer text is a batch of its own).
BATCH_CHARS = 8_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing. The table
    goes with :func:`discard`, at the latest when the driver ends."""
    return cut(df, name)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows are estimated, from their number and the width of its longest strings and arrays, to
    take at most ``limit`` bytes, else as it is (the join then shuffles). Reads ``df`` once: give a stored table."""
    long = [F.coalesce(F.max(F.octet_length(c) if t in ("string", "binary") else 16 * F.size(c)), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary") or t.startswith("array")]
    n, *sizes = df.agg(F.count("*"), *long).first()
    return F.broadcast(df) if n * (sum(sizes) + 16 * len(df.columns)) <= limit else df


def text_batches(batches: Iterator[pa.RecordBatch], text: int, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds more than ``most`` bytes in column ``text``, unless it is one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
