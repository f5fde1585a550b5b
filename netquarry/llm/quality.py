"""Operator 3: quality rules, with repetition measured on a suffix array of each text's words.

Neighbours in suffix order share the longest prefixes, so the common prefixes of
neighbours bound the intervals of suffixes that repeat a substring. Their spans are
united; a text fails if too large a share of its words is covered, or if one repeat
is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .suffixes import covered, repeat_lengths

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def block_repeats(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's longest repeat in its own text, over the words of all texts end to end; and where texts end.

    One suffix array serves the block: a word's symbol holds its text too, so nothing repeats across texts.
    """
    ends = np.cumsum([len(words) for words in texts])
    ids: dict[bytes, int] = {}
    new = ids.setdefault
    codes = np.array([new(word, len(ids)) for words in texts for word in words], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
    return repeat_lengths(text * max(1, len(ids)) + codes), ends


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5, span_words: int = 8) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_span_words, longest_repeat (all long).

    n_repeat_words: words inside ``window``-word runs found twice or more in the text.
    n_span_words: words covered by repeats of ``span_words`` words or more; longest_repeat:
    words of the longest repeat (copies may overlap). Null and empty texts have zeros
    throughout; equal rows give equal rows; whole texts are read, whatever their length.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_span_words", "longest_repeat"]
    schema = pa.schema([(id_col, pa.int64()), *[(n, pa.int64()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 2 << 20):
            texts = [t or "" for t in block.column("text").to_pylist()]
            words = [t.encode().split() for t in texts]
            longest, ends = block_repeats(words)
            text = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))

            def spans(least: int, longest=longest, ends=ends, text=text) -> np.ndarray:
                """Words of each text inside repeats of at least so many words."""
                at = np.flatnonzero(longest >= least)
                inside = covered(at, longest[at], len(longest))
                return np.bincount(text[inside], minlength=len(ends))

            peak = np.zeros(len(texts), np.int64)
            np.maximum.at(peak, text, longest)
            lines = [[x for x in t.split("\n") if x.strip(WHITE)] for t in texts]
            columns = [
                [len(w) for w in words],
                [len(t) - sum(map(t.count, WHITE)) for t in texts],
                [sum(map(t.count, SYMBOLS)) for t in texts],
                [len(x) - len(set(x)) for x in lines],
                spans(window),
                spans(span_words),
                peak,
            ]
            yield pa.RecordBatch.from_arrays([block.column("id").cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], schema=schema)

    kinds = ", ".join(f"{n} long" for n in [id_col, *names])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)


def judge(measured: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, max_span_percent: int = 15, max_longest: int = 60) -> DataFrame:
    """Adds base_failed and kept: kept if the base passes, repeats of a length cover few enough words, and none is too long."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    good = (100 * F.col("n_span_words") <= max_span_percent * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & good)


def rules(documents: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of each row of ``documents``."""
    return judge(measure(documents))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines
  FROM w
), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g5 AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM p WHERE i + 4 <= len(ws)),
r5 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g5) WHERE n > 1),
c5 AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r5, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
g8 AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM p WHERE i + 7 <= len(ws)),
r8 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g8) WHERE n > 1),
c8 AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r8, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
g61 AS (SELECT doc_id, i, array_to_string(ws[i:i+60], ' ') AS g FROM p JOIN c8 USING (doc_id) WHERE i + 60 <= len(ws)),
c61 AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, count(*) AS n FROM g61 GROUP BY doc_id, g) WHERE n > 1),
m AS (
  SELECT base.*, coalesce(c5.n, 0)::BIGINT AS n_repeat_words, coalesce(c8.n, 0)::BIGINT AS n_span_words, c61.doc_id IS NOT NULL AS too_long
  FROM base LEFT JOIN c5 USING (doc_id) LEFT JOIN c8 USING (doc_id) LEFT JOIN c61 ON c61.doc_id = base.doc_id
), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_span_words, base_failed,
  NOT base_failed AND 100 * n_span_words <= 15 * n_words AND NOT too_long AS kept
FROM f
"""
