"""What several operators share: shared-folder tables, hot-key joins, Arrow blocks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key of at least so many rows is "hot", if it is also a HOT_KEYS-th of all: there are HOT_KEYS of them at most.
HOT_ROWS, HOT_KEYS = 500, 2_000
#: Parts that the rows of a hot key are dealt to in a join.
HOT_PARTS = 64


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is missing (a local session, as in tests) a temporary
    folder of this machine is set in its place; a cluster without it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="netquarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys of at least HOT_ROWS rows and a HOT_KEYS-th of all; never more than HOT_KEYS values."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= HOT_ROWS)
    total = df.count()
    return [r[0] for r in counts.where(F.col("count") * HOT_KEYS >= total).collect()] if total >= HOT_ROWS else []


def join_hot(df: DataFrame, table: DataFrame, key: str, deal_by: str) -> DataFrame:
    """Left join of ``table`` (one row a key) on ``key``; rows of a hot key are dealt to HOT_PARTS parts by ``deal_by``.

    Rows of a null key aren't shuffled. ``df`` should be a written table, as it is read
    three times.
    """
    some, none = df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())
    hot = hot_keys(df, key)
    if hot:
        parts = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
        deal = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(deal_by), F.lit(HOT_PARTS)).cast("int")).otherwise(F.lit(0))
        joined = some.withColumn("__deal", deal).join(table.withColumn("__deal", F.explode(parts)), [key, "__deal"], "left").drop("__deal")
    else:
        joined = some.join(table, key, "left")
    return joined.unionByName(none, allowMissingColumns=True)


def with_group_min(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df`` plus the smallest ``value`` of each ``key``; null keys get null.

    ``df`` should be a written table, as it is read several times. Minima are combined
    before the shuffle; in the join back, rows of a hot key are dealt to HOT_PARTS parts.
    """
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(out))
    return join_hot(df, least, key, value)


def release() -> None:
    """Give freed memory back to the system: Python workers are used again, and would keep the most they ever needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library of Linux; others have none
    if trim:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` (string or binary) holds about ``most`` bytes in each, one row at least; freed memory goes back at the end."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
    release()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once, for sessions whose workers can't import it."""
    import io
    import os
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_netquarry_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if not name.endswith(".pyc"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="netquarry-"), "netquarry.zip")
    with open(path, "wb") as file:
        file.write(data.getvalue())
    context.addPyFile(path)
    context._netquarry_shipped = True
