import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; extra columns of these names must not matter.
CLASHING = ("id", "n", "h", "kept", "rep", "shard", "spans", "parts", "digest", "leader", "score", "count", "tie", "body", "row", "component_id", "contamination")


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Echo", "fox", "golf", "hotel", "india", "jay", "kilo", "lima"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty, short, very long, repeated, copied and nearly copied texts."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = words(rng, 30)
    out = [None, "", "   \n\t ", "one", "one two", "One TWO", base, base, base.upper(), " ".join(near), passage + " " + words(rng, 40), words(rng, 50) + " " + passage, "Ünïcödé 日本語 " * 30, "日本" + passage, base[:200], "a b c d e " * 40, words(rng, 5000), "line one\nline two\nline one\n\nline one"]
    out += [words(rng, rng.randrange(1, 80)) for _ in range(40)]
    out.append(out[-1] + " more words here")
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    langs, sources = ["en", "de", None], ["a.org", "b.org", None]
    rows = [(k * 7 % 101, t, langs[k % 3], sources[k % 3], len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing():
    """Adds columns with names that operators use inside."""
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
