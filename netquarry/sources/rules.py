"""Rule tables: tab-separated rows that turn observed texts, ports and prefixes into conclusions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DATA = Path(__file__).resolve().parent.parent / "data"

TEXT_RULES = "rule_table string, rule int, match string, conclusion string, weight double, spec int"
PORT_RULES = "port bigint, conclusion string, weight double, note string"
PROTO_RULES = "app_proto string, conclusion string, weight double"
PREFIXES = "prefix string, vendor string"


def read_rows(text: str, columns: int) -> list[list[str]]:
    """Rows of at least so many fields, each trimmed; comments and empty lines are left out."""
    rows = [[f.strip() for f in line.split("\t")] for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    return [r for r in rows if len(r) >= columns]


def _weight(text: str) -> float:
    """A row whose weight is no number stays, but has no effect."""
    try:
        return float(text)
    except ValueError:
        return 0.0


def _spec(row: list[str], at: int) -> int:
    return int(row[at]) if len(row) > at and row[at].isdigit() and int(row[at]) > 0 else 1


def text_rules(spark: SparkSession, text: str | None = None) -> DataFrame:
    """Rules on texts; ``rule`` is a row's place in its own table, which decides between rows that conclude the same."""
    rows, seen = [], {}
    for r in read_rows(text if text is not None else (DATA / "fingerprints.tsv").read_text("utf-8"), 4):
        seen[r[0]] = seen.get(r[0], -1) + 1
        rows.append((r[0], seen[r[0]], r[1].lower(), r[2], _weight(r[3]), _spec(r, 4)))
    return spark.createDataFrame(rows, TEXT_RULES)


def port_rules(spark: SparkSession, text: str | None = None) -> DataFrame:
    rows = read_rows(text if text is not None else (DATA / "ports.tsv").read_text("utf-8"), 3)
    return spark.createDataFrame([(int(r[0]), r[1], _weight(r[2]), r[3] if len(r) > 3 else "") for r in rows if r[0].isdigit()], PORT_RULES)


def proto_rules(spark: SparkSession, text: str | None = None) -> DataFrame:
    rows = read_rows(text if text is not None else (DATA / "app_proto.tsv").read_text("utf-8"), 3)
    return spark.createDataFrame([(r[0].lower(), r[1], _weight(r[2])) for r in rows], PROTO_RULES)


def ja4_rules(spark: SparkSession, text: str = "") -> DataFrame:
    """Rules on the starts of JA4 fingerprints, case and all; none are shipped."""
    return spark.createDataFrame([(k, r[0], r[1], _weight(r[2]), _spec(r, 3)) for k, r in enumerate(read_rows(text, 3))], "rule int, match string, conclusion string, weight double, spec int")


def curated_prefixes(spark: SparkSession, text: str | None = None) -> DataFrame:
    """Prefixes of any even number of hex digits, which go before the registry's."""
    rows = read_rows(text if text is not None else (DATA / "oui_override.tsv").read_text("utf-8"), 2)
    return spark.createDataFrame([(r[0].upper(), r[1]) for r in rows], PREFIXES)


def no_registry(spark: SparkSession) -> DataFrame:
    """The registry of hardware address prefixes isn't shipped; see sources.registry for building it."""
    return spark.createDataFrame([], PREFIXES)
