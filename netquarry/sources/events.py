"""Newline-delimited JSON records: reading, strict parsing, and the typed columns that handlers use."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions import access, net
from netquarry.sources import payloads

#: Longer lines aren't records.
LINE_BYTES = 16 << 20
#: What may stand around a record.
SPACE = " \t\n\x0b\f\r"


def expand(spark: SparkSession, inputs: list[str]) -> list[str]:
    """Paths of the inputs: files, patterns, and for folders their eve*.json* files in order of name.

    Raises FileNotFoundError for an input that matches nothing.
    """
    files = spark._jvm.org.apache.hadoop.fs
    conf, out = spark._jsc.hadoopConfiguration(), []
    for item in inputs:
        path = files.Path(item)
        store = path.getFileSystem(conf)
        if store.exists(path) and store.getFileStatus(path).isDirectory():
            path = files.Path(path, "eve*.json*")
        found = store.globStatus(path)
        names = sorted(s.getPath().toString() for s in (found or []) if not s.isDirectory())
        if not names:
            raise FileNotFoundError(f"nothing matches {item}")
        out += names
    return out


def read_lines(spark: SparkSession, paths: list[str], by_time: bool = False) -> DataFrame:
    """line and seq, the order of arrival: by the file's place (or its time of change), then the line's place in it.

    Files that end in .gz are unpacked. seq only orders lines; it isn't dense.
    """
    rows = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    order = F.struct("changed", "file", "block", "place") if by_time else F.struct("file", "block", "place")
    return rows.select("line", order.alias("seq"))


def _items(line: Column) -> Column:
    """The records that stand in a line, as VARIANTs: one of a line that is one JSON object and nothing else. A line ``null`` is an empty record."""
    # trimming goes through a line letter by letter: only where there is something to trim
    bare = F.when(line.startswith("{") & line.endswith("}"), line).otherwise(F.btrim(line, F.lit(SPACE)))
    whole = F.try_parse_json(F.concat(F.lit('{"x":['), bare, F.lit("]}")))
    items = F.try_variant_get(whole, "$.x", "array<variant>")
    return F.when(bare == "null", F.array(F.parse_json(F.lit("{}")))).when((F.octet_length(bare) <= LINE_BYTES) & bare.startswith("{"), items)


def records(lines: DataFrame) -> DataFrame:
    """record, seq of the lines that aren't blank; record is null for those that can't be read.

    Repeated keys in an object count as the last of them.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # as an item of a list: what is asked of the records, such as how many they are, then isn't worked out where the line would be parsed once more
    rows = lines.where(F.col("line").startswith("{") | F.col("line").rlike(r"\S")).select(F.explode_outer(F.array(_items(F.col("line")))).alias("__items"), "seq")
    return rows.select(F.when(F.size("__items") == 1, F.get("__items", F.lit(0))).alias("record"), "seq")


def line_counts(records_: DataFrame) -> DataFrame:
    """total and skipped lines."""
    return records_.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("record").isNull()).alias("skipped"))


def events(records_: DataFrame) -> DataFrame:
    """Typed events: the columns that every handler needs, and a struct for each kind of payload (see sources.payloads)."""
    v, head = F.col("record"), lambda name: F.col(f"__head.{name}")
    texts = {"event_type", "timestamp", "src_ip", "dest_ip", "app_proto", "proto"}
    text = lambda name: F.coalesce(head(name).cast("string"), F.lit(""))
    rows = records_.where(v.isNotNull()).select("seq", v, F.try_variant_get(v, "$", access.tree([*texts, "dest_port", "vlan"], texts)).alias("__head"))
    rows = rows.select(
        "seq",
        v,
        text("event_type").alias("event_type"),
        access.timestamp(text("timestamp")).alias("ts"),
        text("src_ip").alias("src_ip"),
        text("dest_ip").alias("dest_ip"),
        text("app_proto").alias("app_proto"),
        access.number_of(head("dest_port")).alias("dest_port"),
        F.lower(text("proto")).alias("proto"),
        access.vlans_of(head("vlan")).alias("vlans"),
    )
    rows = rows.withColumns({"src_private": net.is_private(F.col("src_ip")), "dest_private": net.is_private(F.col("dest_ip")), **payloads.raw()}).drop("record")
    return rows.withColumns(payloads.columns()).drop(*payloads.raw())


def in_window(rows: DataFrame, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
    """Events from since to until, both included; those without a time stay."""
    keep = F.lit(True)
    if since is not None:
        keep = keep & (F.col("ts") >= F.lit(since))
    if until is not None:
        keep = keep & (F.col("ts") <= F.lit(until))
    return rows.where(F.col("ts").isNull() | keep)


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def span(text: str) -> dt.timedelta:
    """``7d``, or hours, minutes and seconds such as ``1h30m``; ValueError for what isn't a span."""
    if re.fullmatch(r"[+-]?\d+d", text):
        return dt.timedelta(days=int(text[:-1]))
    sign, body = (-1, text[1:]) if text.startswith("-") else (1, text)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", body)
    if not parts or "".join(a + b for a, b in parts) != body:
        raise ValueError(f"{text!r} is no span such as 24h or 7d")
    return dt.timedelta(seconds=sign * sum(float(a) * _UNITS[b] for a, b in parts))


def window(now: dt.datetime, last: str = "", since: str = "", until: str = "") -> tuple[dt.datetime | None, dt.datetime | None]:
    """The window that the options ask for; ``last`` goes before the others, a bare end date means its whole day."""
    if last:
        length = span(last)
        if length <= dt.timedelta(0):
            raise ValueError("the span must be over 0")
        return now - length, now

    def moment(text: str, end: bool) -> dt.datetime:
        for shape in ("%Y-%m-%d", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S"):
            try:
                found = dt.datetime.strptime(text, shape).replace(tzinfo=now.tzinfo)
            except ValueError:
                continue
            return found + dt.timedelta(days=1, microseconds=-1) if end and shape == "%Y-%m-%d" else found
        raise ValueError(f"{text!r} is no date such as 2026-07-30 or 2026-07-30T09:00")

    return (moment(since, False) if since else None), (moment(until, True) if until else None)


def retention(text: str) -> dt.timedelta | None:
    """How long a watcher keeps what it saw; None for ever."""
    return None if text in ("", "0") else span(text)
