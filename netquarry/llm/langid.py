"""Operator 2: language identification by fusing evidence with Bayes' rule.

Text gives each language a likelihood (byte trigrams). The language that the markup
declares and the address's suffix (top-level domain, or a path part that is a language
code) are further evidence, with likelihoods counted over the corpus. The prior is the
host's: its texts' languages, smoothed towards those of its parent domain, and these
towards those of all hosts; all three by grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, join_hot, written

#: Labelled rows that are fitted, dealt evenly over the languages, but so many of each language at least.
MAX_LABELLED, LEAST_LABELLED = 6_000, 200
BITS = 14
#: Up to so many values of a kind of evidence (and likelihoods in all) are looked up in a literal map, more by a join.
MAP_VALUES, MAP_LITERALS = 500, 32_000
#: Overlapping trigrams repeat evidence; a text counts as a third of its trigrams, and as EVIDENCE at most.
SHARE, EVIDENCE = 1 / 3, 200.0
#: Texts counted towards a parent's shares in a host's prior, and towards all hosts' in a parent's.
HOST_WEIGHT, PARENT_WEIGHT = 10.0, 50.0
#: Letters in lower case, bytes over 127 as they are, all else a space.
TABLE = np.array([b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], dtype=np.uint8)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts, and which text each is from; those of white space alone are left out."""
    data = [(t or "").encode() for t in texts]
    row = TABLE[np.frombuffer(b"  ".join([b"", *data, b""]), np.uint8)].astype(np.uint32)
    if len(row) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    key = row[:-2] << 16 | row[1:-1] << 8 | row[2:]
    ends = np.cumsum([len(d) + 2 for d in data])
    text = np.repeat(np.arange(len(data)), np.diff(np.r_[0, ends]))[: len(key)]
    some = row[1:-1] != 32
    return ((key[some] * np.uint32(2654435761)) >> np.uint32(32 - BITS)), text[some]


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # of each bucket in each language
    usual: np.ndarray  # mean log-likelihood of a trigram of each language's own texts


def fit(df: DataFrame, label_col: str, text_col: str = "text", id_col: str = "doc_id", most: int = MAX_LABELLED) -> Model:
    """Trigram likelihoods of every label of which a text has letters; counts are summed on the executors.

    Each label gives its rows of the smallest hash in each of ``most`` / labels cells (at least
    LEAST_LABELLED), so rare ones are fitted as well. The model holds 64 KB a language.
    With no labelled rows there are no languages, and identify() rejects everything.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("label is not null and text is not null")
    names = [r[0] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").collect()]
    place = {x: k for k, x in enumerate(names)}
    rows = rows.where(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7f]")).withColumn("hash", F.xxhash64("id", "text"))
    cells = max(LEAST_LABELLED, most // max(1, len(names)))
    chosen = rows.groupBy("label", F.pmod("hash", F.lit(cells)).alias("cell")).agg(F.min("hash").alias("hash")).drop("cell")
    sample = rows.join(F.broadcast(chosen), ["label", "hash"]).groupBy("label", "hash").agg(F.min("text").alias("text"))  # copies count once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 20):
            label = np.array([place[x] for x in block.column("label").to_pylist()], np.int64)
            bucket, text = trigrams(block.column("text").to_pylist())
            key, n = np.unique(label[text] << BITS | bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> BITS), pa.array(key & ((1 << BITS) - 1)), pa.array(n)], names=["k", "bucket", "n"])

    total = np.zeros((len(names), 1 << BITS))
    if names:
        found = sample.mapInArrow(count, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2^14 a language
        total[found.column("k").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    keep = [k for k in range(len(names)) if total[k].sum()]
    total = total[keep]
    shares = (total + 0.5) / (total.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS)) if len(keep) else total
    logs = np.log(shares) if len(keep) else total
    usual = (total * logs).sum(axis=1) / total.sum(axis=1) if len(keep) else np.zeros(0)
    return Model([names[k] for k in keep], np.ascontiguousarray(logs.T, dtype=np.float32), usual)


def with_likelihoods(df: DataFrame, model: Model, text_col: str) -> DataFrame:
    """All columns and rows, plus ``__text``: struct of n (trigrams) and mean (log-likelihood of a trigram by language)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("n", pa.int64()), ("mean", pa.list_(pa.float64()))])

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        values, m = texts.to_pylist(), shared.value
        start = size = 0
        for i, text in enumerate([*values, None]):
            if i == len(values) or (size and size + len(text or "") > 1 << 20):
                bucket, at = trigrams(values[start:i])
                n = np.bincount(at, minlength=i - start)
                sums = np.stack([np.bincount(at, weights=m.logs[bucket, k], minlength=i - start) for k in range(len(m.languages))], axis=1) if m.languages else np.zeros((i - start, 0))
                rows += [{"n": c, "mean": x} for c, x in zip(n.tolist(), (sums / np.maximum(1, n)[:, None]).tolist(), strict=True)]
                start, size = i, 0
            size += len(text or "")
        return pa.array(rows, kind)

    return df.withColumn("__text", F.arrow_udf(run, "struct<n:bigint, mean:array<double>>").asNondeterministic()(F.col(text_col)))


def declared_in_markup(html: Column) -> Column:
    """The first part of the html element's lang attribute, in lower case; null for none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def suffix_of(url: Column) -> Column:
    """A path part of two letters if the address has one, else the host's top-level domain."""
    part = F.nullif(F.lower(F.regexp_extract(url, r"^[^:]+://[^/?#]*(?:/[^/?#]+)*?/([A-Za-z]{2})(?:[/?#]|$)", 1)), F.lit(""))
    return F.coalesce(part, F.nullif(F.regexp_extract(host_of(url), r"\.([a-z]+)$", 1), F.lit("")))


def parent_of(host: Column) -> Column:
    """The host's last two labels."""
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def _counts(rows: DataFrame, key: str, size: int, out: str) -> DataFrame:
    """Per key, how many texts are of each language (array), combined before the shuffle."""
    per = [F.count_if(F.col("best") == k).cast("double") for k in range(size)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*per).alias(out))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, least: float = 0.5, drop: float = 1.5) -> DataFrame:
    """``id_col``, language, posterior, text_language, n_trigrams and kept of each row.

    kept: the text has letters, fits its language about as well as that language's own
    texts do (at most ``drop`` nats a trigram worse), and the posterior is at least
    ``least``. Where the declared language has no model, neither says anything about that
    language: letters are enough. Null and empty texts, and texts without letters, have no text evidence;
    they get the language that the rest points to and aren't kept. Missing evidence (null)
    is neutral. Ties go to the language that comes first by frequency, then name. Equal
    rows give equal rows; without languages, language is null and nothing is kept.
    """
    size = len(model.languages)
    null = F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[(c if c is not None else null).alias(n) for n, c in (("declared", declared), ("suffix", suffix), ("host", host))])
    if not size:
        return rows.select(F.col("id").alias(id_col), null.alias("language"), F.lit(0.0).alias("posterior"), null.alias("text_language"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("kept"))
    rows = with_likelihoods(rows, model, "text").drop("text").withColumn("parent", parent_of(F.col("host")))
    weight = F.least(F.col("__text.n") * F.lit(SHARE), F.lit(EVIDENCE))
    top = F.array_max("__text.mean")
    best = F.when(F.col("__text.n") > 0, F.array_position("__text.mean", top).cast("int") - 1)
    rows = written(rows.select("id", "declared", "suffix", "host", "parent", F.col("__text.n").alias("n"), F.col("__text.mean").alias("mean"), best.alias("best"), F.when(F.col("__text.n") > 0, F.transform("__text.mean", lambda x: x * weight)).otherwise(F.array(*[F.lit(0.0)] * size)).alias("logs")), "language-evidence")
    totals = np.array([int(x or 0) for x in rows.agg(*[F.count_if(F.col("best") == k) for k in range(size)]).first()], dtype=float)
    overall = ((totals + 1.0) / (totals.sum() + size)).tolist()
    lit = lambda values: F.array(*[F.lit(float(v)) for v in values])

    def smoothed(counts: str, above: Column, pull: float) -> Column:
        seen = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.col(counts).isNull(), above).otherwise(F.zip_with(counts, above, lambda n, p: (n + pull * p) / (seen + pull)))

    parents = _counts(rows, "parent", size, "n_parent").select("parent", smoothed("n_parent", lit(overall), PARENT_WEIGHT).alias("p_parent"))
    hosts = _counts(rows, "host", size, "n_host").withColumn("parent", parent_of(F.col("host"))).join(parents, "parent", "left").select("host", smoothed("n_host", F.coalesce("p_parent", lit(overall)), HOST_WEIGHT).alias("prior"))
    rows = join_hot(rows, hosts, "host", "id")
    fused = F.zip_with("logs", F.coalesce("prior", lit(overall)), lambda a, p: a + F.log(p))
    for key in ("declared", "suffix"):
        # P(value | language) with add-one smoothing over all values that occur
        counts = written(_counts(rows, key, size, "n"), "language-values")
        n_values = counts.count()
        if not n_values:
            continue
        odds = lambda n: F.transform(F.zip_with(n, lit(totals), lambda c, t: (c + 1.0) / (t + F.lit(n_values + 1.0))), lambda p: F.log(p))
        if n_values <= MAP_VALUES and n_values * size <= MAP_LITERALS:
            table = F.create_map(*[x for name, logs in counts.select(key, odds("n")).collect() for x in (F.lit(name), lit(logs))])
            found = F.try_element_at(table, F.col(key))
        else:  # too many for a literal: the same by a join
            rows = join_hot(written(rows, "language-evidence"), counts.select(key, odds("n").alias(f"{key}_logs")), key, "id")
            found = F.col(f"{key}_logs")
        fused = F.zip_with(fused, F.coalesce(found, lit([0.0] * size)), lambda a, b: a + b)
    rows = rows.withColumn("fused", fused).withColumn("peak", F.array_max("fused")).withColumn("found", F.array_position("fused", F.col("peak")).cast("int"))
    names, usual = F.array(*[F.lit(x) for x in model.languages]), lit(model.usual)
    fits = F.element_at("mean", F.col("found")) >= F.element_at(usual, F.col("found")) - drop
    posterior = 1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("peak")))
    other = F.coalesce(~F.array_contains(names, F.col("declared")), F.lit(False))
    return rows.select(
        F.col("id").alias(id_col),
        F.element_at(names, F.col("found")).alias("language"),
        posterior.alias("posterior"),
        F.when(F.col("n") > 0, F.element_at(names, F.col("best") + 1)).alias("text_language"),
        F.col("n").alias("n_trigrams"),
        ((F.col("n") > 0) & (other | (fits & (posterior >= least)))).alias("kept"),
    )


def identify_documents(documents: DataFrame) -> DataFrame:
    """``documents``: lang is what is declared, source is the host; there is no address."""
    return identify(documents, fit(documents, "lang"), declared=F.col("lang"), host=F.col("source"))


def identify_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """``pages``: text without tags, the html element's lang, the address's suffix and host; fitted on documents."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&#?\w+;", " ")
    rows = pages.select("page_id", text.alias("text"), declared_in_markup(F.col("html")).alias("declared"), suffix_of(F.col("url")).alias("suffix"), host_of(F.col("url")).alias("host"))
    return identify(rows, fit(documents, "lang"), "page_id", "text", F.col("declared"), F.col("suffix"), F.col("host"))
