"""Row numbers of groups of any size: by range over all tasks, not a group a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvan.operators.lineage import cut

#: Groups and tasks (a row each) up to which their offsets are broadcast.
HEADS = 100_000


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "ord") -> DataFrame:
    """``df`` with ``name``, the number from 1 of each row among those of equal ``by`` in the order of ``order``, nulls first.

    Rows are sorted over all tasks and written as a table; a row's number is its place in its task, plus the rows of its
    group in the tasks before. A group is never brought together."""
    keys = [*by, *order]
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    heads = rows.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = cut(heads.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__p"), (F.col("__first") - before - 1).alias("__less")), "heads")
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), by, F.col("__part") == F.col("__p"))
    return rows.join(F.broadcast(heads) if heads.count() <= HEADS else heads, same).select(*df.columns, (F.col("__at") - F.col("__less")).alias(name))
