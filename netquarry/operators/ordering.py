"""Places in an order, and values carried along one, without bringing all rows to one task.

Rows are dealt out by ranges of the order and sorted within each; what a part must know of
those before it are a few numbers a part: how many rows they have, and their last values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.sources.landing import landed

#: Rows of a part are numbered in the lower bits of their id.
WITHIN = 33


def parted(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` written in parts that follow each other in the order, with __part, and __row within it from 0."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = landed(rows, "in-order")
    return rows.withColumns({"__part": F.shiftright("__id", WITHIN).cast("int"), "__row": F.col("__id").bitwiseAND(F.lit((1 << WITHIN) - 1))}).drop("__id")


def with_place(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` plus each row's place in the order, from 1. Rows that tie get places next to each other, in any order."""
    rows = parted(df, *order)
    before, seen = [], 0
    for r in rows.groupBy("__part").count().orderBy("__part").collect():  # a row a part
        before.append((r["__part"], seen))
        seen += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before long")
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__row") + 1).drop("__part", "__row", "__before")


def carried(df: DataFrame, order: Column, *columns: str) -> DataFrame:
    """``df`` with each of the columns as it was last not null, up to the row itself; null before the first such row."""
    rows = parted(df, order)
    last = rows.groupBy("__part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__row"))).alias(c) for c in columns])
    now, before = [None] * len(columns), []
    for r in last.orderBy("__part").collect():  # a row a part
        before.append((r["__part"], *now))
        now = [r[c] if r[c] is not None else old for c, old in zip(columns, now, strict=True)]
    kinds = ", ".join(f"__{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    rows = rows.join(F.broadcast(df.sparkSession.createDataFrame(before, f"__part int, {kinds}")), "__part")
    so_far = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"__{c}")) for c in columns}
    return rows.select(*[filled[c].alias(c) if c in columns else c for c in df.columns])
