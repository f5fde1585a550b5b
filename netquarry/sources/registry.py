"""Building the table of hardware address prefixes from the registries' CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.functions.names import clean_vendor

COLUMNS = "registry string, assignment string, organization string, address string"


def read_registry(spark: SparkSession, path: str, order: int) -> DataFrame:
    """Rows of one file; ``order`` is its place among the files, later ones win."""
    rows = spark.read.schema(COLUMNS).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return rows.where(F.coalesce("registry", F.lit("")) != "Registry").withColumn("order", F.lit(order))


def prefixes(rows: DataFrame) -> DataFrame:
    """prefix and vendor: cleaned names, without rows of the registrar itself; per prefix the last file's."""
    named = rows.select(F.upper(F.trim("assignment")).alias("prefix"), clean_vendor(F.coalesce("organization", F.lit(""))).alias("vendor"), "order")
    named = named.where((F.coalesce("prefix", F.lit("")) != "") & (F.col("vendor") != "") & ~F.lower("vendor").contains("ieee registration authority"))
    last = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("order"), "vendor"))
    return named.withColumn("k", last).where("k = 1").select("prefix", "vendor")


def build(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files in order, largest blocks first."""
    found = [read_registry(spark, path, k) for k, path in enumerate(paths)]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return prefixes(out)
