"""Operators 2, 3, 5, 7, 8 and 9 against brute force, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netquarry.llm import decontam, jaccard, langid, quality, suffix_dedup, suffixes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality(docs, clashing, empty):
    got = {r["doc_id"]: r for r in quality.rules(clashing(docs)).collect()}
    for r in docs.collect():
        text, g = r["text"] or "", got[r["doc_id"]]
        w = WORD.findall(text)
        spans = {}
        for size in (5, 8, 61):
            runs = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
            seen = Counter(runs)
            spans[size] = {i + k for i, x in enumerate(runs) if seen[x] > 1 for k in range(size)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (g["n_words"], g["word_chars"], g["n_symbols"]) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (g["n_dup_lines"], g["n_repeat_words"], g["n_span_words"]) == (len(lines) - len(set(lines)), len(spans[5]), len(spans[8]))
        failed = len(w) < 10 or 100 * len(spans[5]) > 20 * len(w)
        assert g["base_failed"] == failed and g["kept"] == (not failed and 100 * len(spans[8]) <= 15 * len(w) and not spans[61])
    assert quality.rules(empty).isEmpty()


def test_suffix_dedup(spark, docs, clashing, empty):
    want = suffix_dedup.brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, suffix_dedup.report(spark, clashing(docs)).collect())) == sorted(want)
    assert any(r[2] for r in want)
    assert suffix_dedup.report(spark, empty).isEmpty()
    out = suffix_dedup.deduplicated(clashing(docs))
    assert set(out.columns) == set(clashing(docs).columns) and out.count() == docs.count()
    twice = docs.unionByName(docs)  # rows of one id don't shorten each other
    assert sorted(map(tuple, suffix_dedup.report(spark, twice).distinct().collect())) == sorted(want)


def test_previous_factors():
    """The longest previous factor of each suffix, against a comparison of all pairs."""
    rng = random.Random(4)
    for _ in range(200):
        row, owner = [rng.randrange(3) for _ in range(rng.randrange(1, 40))], []
        owner = [rng.randrange(4) for _ in row]
        order, _, levels = suffixes.suffix_array(np.array(row))
        shared = [0, *suffixes.common_prefix(order[:-1], order[1:], levels).tolist()]
        got = dict(zip(order.tolist(), suffixes.previous_factors([owner[i] for i in order], shared), strict=True))

        def match(i, j, row=row):
            n = 0
            while max(i, j) + n < len(row) and row[i + n] == row[j + n]:
                n += 1
            return n

        assert got == {i: max((match(i, j) for j in range(len(row)) if owner[j] < owner[i]), default=0) for i in range(len(row))}


@pytest.mark.parametrize("length", [50, 120])
def test_met_factors(length):
    """The factors of rows that meet, against a comparison of all rows; zero bytes are no ends."""
    rng = random.Random(6)
    left, wide = length - suffix_dedup.GRAM, 2 * length - suffix_dedup.GRAM
    rows = []
    for k in range(60):
        base = bytearray(b"ab" * wide)[:wide] if k % 2 else bytearray(bytes(wide))
        for _ in range(rng.randrange(3)):
            base[rng.randrange(wide)] = rng.randrange(3)
        low, high = sorted((rng.randrange(left + 1), rng.randrange(left + 1)))
        rows.append((7, rng.randrange(9), (low, high), bytes(x if low <= i < high + length else 0 for i, x in enumerate(base))))
    short, ids, edge, around = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.uint8), np.array([list(r[3]) for r in rows], np.uint8))
    got = suffix_dedup.met_factors(short, ids, edge, around, length)
    inside = [r[3][r[2][0] : r[2][1] + length] for r in rows]
    for (_, i, (low, high), data), factors in zip(rows, got.tolist(), strict=True):
        for p in range(left + 1):
            own = data[p : high + length]
            most = max((n for j, text in zip(ids.tolist(), inside, strict=True) if j < i for n in range(length, len(own) + 1) if own[:n] in text), default=0)
            assert factors[p] == (most if low <= p <= high else 0)


def test_suffix_dedup_of_long_texts_and_odd_names(spark):
    """A text is taken in stretches with the same anchors; columns of any name and type stay."""
    rng = random.Random(8)
    text = bytes(rng.choice(b"abc") for _ in range(9_000)) + b"x" * 900
    table = pa.table({"id": [3, 1, 2], "body": [b"short", text, b"y" * 300]})
    whole, parts = (suffix_dedup.Shard(table).anchors(50, n) for n in (1 << 19, 256))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and len(whole[0]) > 100
    df = spark.createDataFrame([(1, "z" * 80, "d", ([1], {"k": 2.5})), (2, "z" * 80, None, None)], "doc_id long, text string, `crawl-date` string, `a.b``c` struct<x:array<int>,y:map<string,double>>")
    got = {r["doc_id"]: (r["text"], r["crawl-date"], r["a.b`c"]) for r in suffix_dedup.deduplicated(df).collect()}
    assert got == {1: ("z" * 80, "d", ([1], {"k": 2.5})), 2: ("", None, None)}


def test_suffix_dedup_keeps_characters(spark):
    """Replacement characters of the text stay; a character that is cut goes whole, and none is made of two cut ones."""
    same = "0123456789" * 5 + "abc"
    rows = [(1, "\ufffd clean \ufffd"), (2, same), (3, f"\ufffdé{same}é\ufffd"), (4, "x" * 60 + "\u00e9"), (5, "x" * 60 + "\u00e8 \ufffd")]
    rows += [(6, "日" * 20 + "月"), (7, "a" + "日" * 20 + "本\ufffd")]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    got = {r[0]: (r[1], r[2]) for r in suffix_dedup.deduplicated(df).collect()}
    want = {1: "\ufffd clean \ufffd", 2: same, 3: "\ufffdéé\ufffd", 4: "x" * 60 + "é", 5: " \ufffd", 6: "日" * 20 + "月", 7: "a\ufffd"}
    assert got == {k: (v, len(v)) for k, v in want.items()}


@pytest.mark.parametrize("many", [0, 30])
def test_suffix_dedup_of_frequent_passages(spark, docs, many, monkeypatch):
    """What stands around an anchor of a passage in most documents doesn't meet in one task; the results are the same."""
    rng = random.Random(5)
    passage = "this sentence, of a hundred bytes, is in most of the documents and other words stand around it there"
    odd = [passage[20:80] + "\0" * 70 + "é" * 40, "ab" * 90 + passage, "ab" * 60, passage + passage]
    rows = [(k * 37 % 331, f"{rng.random()} {passage} {rng.random()} {passage[:60]}{k}") for k in range(300)]
    rows += [(1000 + k // 2, t) for k, t in enumerate(odd * 2)] + [(2000 + r["doc_id"], r["text"]) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = pa.table({"id": [r[0] for r in rows], "body": [(r[1] or "").encode() for r in rows]})
    shard = suffix_dedup.Shard(table)
    place, _, doc, _ = shard.anchors(50)
    strings = suffix_dedup.frequent_strings(shard, place, doc, 50, 8)
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 5000)
    assert sorted(strings) == sorted(suffix_dedup.frequent_strings(shard, place, doc, 50, 8)) and len(strings) == 9
    met, send = [], suffix_dedup.earlier_spans
    monkeypatch.setattr(suffix_dedup, "earlier_spans", lambda sent, length: (met.append(sent), send(sent, length))[1])
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    out = suffix_dedup.repeats_removed(df, many=many).select("row.doc_id", "n_bytes", "spans", F.sha2("kept", 256)).collect()
    got = [(r[0], r[1], sum(s["end"] - s["start"] for s in r[2]), len(r[2]), r[3]) for r in out]
    assert sorted(got) == sorted(suffix_dedup.brute_force(rows))
    around = Counter(h for r in met[0].where("bucket >= 0").collect() for h in suffix_dedup.unpack(bytes(r["data"]))[0].tolist())
    assert max(around.values(), default=0) <= many


def groups(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().translate(jaccard.LOWER).split()
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets.items())


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard(docs, clashing, empty, k, percent):
    want = groups([(r["doc_id"], r["text"]) for r in docs.collect()], k, percent)
    assert sorted(map(tuple, jaccard.similar(clashing(docs), k, percent).collect())) == want
    assert jaccard.similar(empty, k, percent).isEmpty()


def test_jaccard_of_many_near_copies(spark):
    import random

    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w[: rng.randrange(60, 81)])))
    rows += [(i + 1000, rows[3][1]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, jaccard.similar(df, 3, 90).collect())) == groups(rows, 3, 90)


def test_jaccard_of_repeated_ids(spark):
    """An id with two texts has the links of both."""
    rows = [(7, "a b c d e f g h i j"), (7, "p q r s t u v w x y"), (3, "a b c d e f g h i k"), (5, "p q r s t u v w x z"), (9, "p q r s t u v w x y")]
    got = {tuple(r)[::2] for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    assert got == {(7, 3), (3, 3), (5, 3), (9, 3)}


@pytest.mark.parametrize("frequent", [2, 2_000])
def test_jaccard_pairs_are_compared_once(spark, monkeypatch, frequent):
    """Each pair is looked at under one leader, however many it has in common; also where shingles are frequent."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(3)
    rows = [(k, " ".join(f"{w}{rng.randrange(20) if rng.random() < 0.1 else 0}" for w in ("abcdefghijklmnopqrst", "ABCDEFGHIJKLMNOPQRST!")[k % 2])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    meetings, real = [], jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda m, *rest: (meetings.append(m), real(m, *rest))[1])
    assert sorted(map(tuple, jaccard.similar(df, 2, 60).collect())) == groups(rows, 2, 60)
    found, sets = {}, {i: s for i, s in zip([r[0] for r in rows], jaccard.shingle_sets([r[1] for r in rows], 2)[0], strict=True)}
    for r in meetings[0].collect():
        found.setdefault((r["leader"], r["b1"], r["b2"]), []).append(r)
    pairs = []
    for members in found.values():
        compared = []
        m = {"leader": [r["leader"] for r in members], "leaders": [r["leaders"] for r in members]}
        own = [sets[r["id"]] for r in members]
        parts = np.frombuffer(b"".join(map(jaccard.part_counts, own)), np.uint8).reshape(-1, jaccard.PARTS)
        jaccard.linked(own, parts, np.array([r["b"] for r in members]), jaccard.Fraction(60, 100), True, jaccard.earlier_leaders(m), compared)
        pairs += [tuple(sorted((members[i]["id"], members[j]["id"]))) for i, j in compared]
    assert len(pairs) == len(set(pairs)) and any(len(r["leaders"]) > 1 for m in found.values() for r in m)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7), (5, 4)], "u long, v long")
    got = {r[0]: r[1] for r in jaccard.components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def items_of(benchmark):
    out = {}
    for i, text in benchmark:
        w = decontam.words_of(text)
        size = min(10, len(w))
        out.setdefault(i, set()).update(tuple(w[k : k + size]) for k in range(len(w) - size + 1) if w)
    return out


def test_decontamination(spark, docs, clashing, empty, texts):
    some = texts[10].split()
    benchmark = [(1, " ".join(some[:14])), (2, " ".join(some[3:20]).upper() + "!"), (3, "one"), (4, ""), (5, None), (6, "never seen at all here"), (10, " ".join(some[:14])), (1, " ".join(texts[16].split()[4000:4020]))]
    table = spark.createDataFrame(benchmark, "item_id long, text string")
    windows = items_of(benchmark)
    got = {r["doc_id"]: r for r in decontam.report(clashing(docs), table).collect()}
    for r in docs.collect():
        w, hit, found = decontam.words_of(r["text"]), set(), set()
        for item, own in windows.items():
            for x in own:
                for p in range(len(w) - len(x) + 1):
                    if tuple(w[p : p + len(x)]) == x:
                        hit |= set(range(p, p + len(x)))
                        found.add(str(item))
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert g["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert any(r["contaminated"] for r in got.values())
    blocks = decontam.with_matches(docs, table, block_bytes=40).select("doc_id", F.size("contamination.matches").alias("n"))
    whole = decontam.with_matches(docs, table).select("doc_id", F.size("contamination.matches").alias("n"))
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.collect()))
    assert decontam.removed(clashing(docs), table).count() == sum(not r["contaminated"] for r in got.values())
    assert decontam.report(empty, table).isEmpty()
    assert decontam.report(docs, table.limit(0)).where("contaminated").isEmpty()
    named = table.withColumn("item_id", F.concat(F.lit("item-"), F.col("item_id")))
    assert decontam.report(docs, named).where("contaminated").count() == sum(r["contaminated"] for r in got.values())
    with pytest.raises(ValueError):
        decontam.with_matches(docs.withColumn("Contamination", F.lit(1)), table)


def test_longest_matches():
    """Places and lengths of verbatim matches, against a comparison of all places."""
    rng = random.Random(11)
    word = lambda: rng.choice("abcdef")
    for _ in range(40):
        items = [(str(k), " ".join(word() for _ in range(rng.randrange(1, 9)))) for k in range(4)]
        texts = [" ".join(rng.choice("abcdefxyz") for _ in range(rng.randrange(40))) for _ in range(5)] + [None]
        counts, got = decontam.find_matches(texts, decontam.Queries(items, 4))
        for text, n, found in zip(texts, counts, got, strict=True):
            d, want = decontam.words_of(text), []
            assert n == len(d)
            for name, item in items:
                q = decontam.words_of(item)
                for p in range(len(d)):
                    for i in range(len(q)):
                        length = 0
                        while p + length < len(d) and i + length < len(q) and d[p + length] == q[i + length]:
                            length += 1
                        if length >= min(4, len(q)) and not (p and i and d[p - 1] == q[i - 1]):
                            want.append((name, p, i, length))
            assert found == sorted(want)


def test_language(spark, docs, clashing, empty):
    out = langid.identify_documents(clashing(docs)).collect()
    assert len(out) == docs.count()
    assert not any(r["kept"] for r in out if r["n_trigrams"] == 0)
    assert langid.identify_documents(empty).isEmpty()
    nothing = langid.identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r["language"] is None and not r["kept"] for r in nothing)


def test_language_held_out(spark):
    """Declared languages of rows that the model isn't fitted on are found again from text alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND length(text) > 200")
    model = langid.fit(docs.where("doc_id % 2 = 0"), "lang")
    rows = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert rows.agg(F.avg((F.col("text_language") == F.col("lang")).cast("double"))).first()[0] > 0.9


def test_rare_languages(spark):
    """Each label is fitted, beyond 64 and with few rows; a declared language without a model doesn't reject a text."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(rng.choices(letters, k=6)) for _ in range(40)] for k in range(70)}
    text = lambda x: " ".join(rng.choices(words[x], k=60))
    rows = [(x, text(x)) for x in words for _ in range(120 if x == "l00" else 3)]
    df = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(rows)] + [(None, "12 34", "digits"), (None, text("l01"), "l01")], "doc_id long, text string, lang string")
    model = langid.fit(df, "lang", most=50)
    assert set(model.languages) == set(words)
    new = [(k, text(x), x) for k, x in enumerate(words)]
    got = langid.identify(spark.createDataFrame(new, "doc_id long, text string, lang string"), model, declared=F.col("lang")).collect()
    assert {r["doc_id"]: r["language"] for r in got} == {k: x for k, _, x in new} and all(r["kept"] for r in got)
    odd = [(1, "".join(map(chr, range(0x4E00, 0x4F00))), "zz"), (2, "".join(map(chr, range(0x4E00, 0x4F00))), "l00"), (3, "12 34", "zz"), (4, "".join(map(chr, range(0x4E00, 0x4F00))), None)]
    got = langid.identify(spark.createDataFrame(odd, "doc_id long, text string, lang string"), model, declared=F.col("lang")).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {1: True, 2: False, 3: False, 4: False}


@pytest.mark.parametrize("values", [langid.MAP_VALUES, 0])
def test_fusion_by_brute_force(spark, monkeypatch, values):
    """Posteriors from text, declared language, suffix and smoothed host prior, worked out row by row; by a map or by joins."""
    monkeypatch.setattr(langid, "MAP_VALUES", values)
    rng = random.Random(10)
    words = {x: ["".join(rng.choices(a, k=5)) for _ in range(30)] for x, a in (("aa", "abcdef"), ("bb", "efghij"), ("cc", "ijklmn"))}
    rows = []
    for k in range(90):
        x = rng.choice(list(words))
        text = rng.choice([" ".join(rng.choices(words[x], k=rng.randrange(1, 20))), "12 34", None])
        rows.append((k, text, rng.choice([x, x, "zz", None]), rng.choice([x[0], "org", None]), rng.choice(["a.x.org", "b.x.org", "c.net", None]), x))
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string, lang string")
    model = langid.fit(df, "lang")
    got = {r["doc_id"]: r for r in langid.identify(df, model, declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host")).collect()}
    text = {r["doc_id"]: r["__text"] for r in langid.with_likelihoods(df.select("doc_id", "text"), model, "text").collect()}
    size = len(model.languages)
    best = {i: int(np.argmax(x["mean"])) if x["n"] else None for i, x in text.items()}
    totals = np.bincount([b for b in best.values() if b is not None], minlength=size)
    overall = (totals + 1) / (totals.sum() + size)
    parent = {"a.x.org": "x.org", "b.x.org": "x.org", "c.net": "c.net"}

    def shares(keep, above, pull):
        n = np.bincount([best[r[0]] for r in rows if keep(r) and best[r[0]] is not None], minlength=size)
        return (n + pull * above) / (n.sum() + pull)

    for r in rows:
        i, n = r[0], text[r[0]]["n"]
        score = np.array(text[i]["mean"]) * min(n / 3, langid.EVIDENCE) if n else np.zeros(size)
        prior = overall
        if r[4]:
            up = shares(lambda x, h=r[4]: x[4] and parent[x[4]] == parent[h], overall, langid.PARENT_WEIGHT)
            prior = shares(lambda x, h=r[4]: x[4] == h, up, langid.HOST_WEIGHT)
        score = score + np.log(prior)
        for column in (2, 3):
            if r[column]:
                every = {x[column] for x in rows if x[column]}
                seen = np.bincount([best[x[0]] for x in rows if x[column] == r[column] and best[x[0]] is not None], minlength=size)
                score = score + np.log((seen + 1) / (totals + len(every) + 1))
        assert got[i]["language"] == model.languages[int(np.argmax(score))]
        assert abs(got[i]["posterior"] - 1 / np.exp(score - score.max()).sum()) < 1e-6


def test_addresses_and_markup(spark):
    rows = [("https://Www.Beispiel.de/a", '<HTML class=x lang="de-AT">'), ("http://u@x.org:80/fr/page?q", "<html>"), ("bad", None), (None, "<html lang=en>")]
    df = spark.createDataFrame(rows, "url string, html string")
    got = df.select(langid.host_of(F.col("url")), langid.suffix_of(F.col("url")), langid.declared_in_markup(F.col("html"))).collect()
    assert [tuple(r) for r in got] == [("www.beispiel.de", "de", "de"), ("x.org", "fr", None), (None, None, None), (None, None, "en")]


def brute_segments(values):
    """All maximal segments by their definition: the best first, then the rest on both sides of it."""
    if not any(v > 0 for v in values):
        return []
    best = max(((sum(values[i:j]), -(j - i), -i, i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)))
    _, _, _, i, j = best
    return [*brute_segments(values[:i]), (i, j), *[(a + j, b + j) for a, b in brute_segments(values[j:])]]


def test_segments():
    import random

    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        values = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 1000 for _ in range(rng.randrange(1, 14))]
        row = np.array(values)
        assert [(a, b) for a, b, _ in toxicity.segments(row, np.flatnonzero(row > 0))] == brute_segments(values)


def test_toxicity(spark, docs, clashing, empty):
    labels = spark.createDataFrame([(r["doc_id"], int(k % 3 == 0), None if k % 7 == 0 else int(k % 4 == 0)) for k, r in enumerate(docs.collect())], "doc_id long, quality int, toxic int")
    out = toxicity.report(spark, clashing(docs), labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert toxicity.report(spark, empty, labels).isEmpty()
    none = toxicity.report(spark, docs, labels.limit(0)).collect()
    assert not any(r["predicted"] for r in none)


def test_toxicity_held_out(spark):
    """Of the rows held out, toxic ones are caught and others left alone, in each language."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").where("toxic IS NOT NULL")
    rows = toxicity.report(spark, docs.join(labels, "doc_id", "left_semi"), labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    got = rows.groupBy("lang", "toxic").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).collect()
    assert len(got) == 8 and all(r[2] > 0.9 for r in got), got


def test_toxicity_of_odd_rows(spark):
    """Copies of a text don't make its words toxic; ties and repeated rows; a null id; a column of the result's name."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    common = [word() for _ in range(300)]
    text = lambda bad=(): " ".join(rng.sample([*rng.choices(common, k=40), *bad], 40 + len(bad)))
    copied = " ".join(word() for _ in range(40))
    rows = [(k, text(("scumbag", "dimwit", "lout") if k % 4 == 0 else ()), int(k % 4 == 0)) for k in range(600)]
    rows += [(k, f"{copied} scumbag {text()} dimwit", 1) for k in range(600, 640)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, copied), (9001, copied), (9001, copied), (9002, None), (9003, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.report(spark, docs, labels).collect()
    assert len(got) == docs.count() and all(r["held_out"] is not None for r in got)
    of = {r["doc_id"]: r for r in got}
    assert all(of[i]["predicted"] == x for i, _, x in rows) and not of[9001]["predicted"] and not of[None]["held_out"]
    assert len({r["score"] for r in got if r["doc_id"] in (None, 9001)}) == 1 and of[9002]["score"] == of[9003]["score"] <= min(r["score"] for r in got)
    with pytest.raises(ValueError):
        toxicity.with_toxicity(docs.withColumn("toxicity", F.lit(1)), toxicity.Model())


def test_log_odds_by_brute_force(spark):
    """Contexts and log-odds of a small sample, worked out by hand."""
    rows = [("a b a b", 0, False), ("a b", 1, False), ("c b d", 1, False), (None, 0, False)]
    sample = spark.createDataFrame(rows, "text string, toxic int, calibrates boolean")
    before = {(t, w, b) for text, t, _ in rows for w, b in zip((text or "").split(), ["", *(text or "").split()], strict=False)}
    want = {w: tuple(sum(1 for t, v, _ in before if (t, v) == (k, w)) for k in (0, 1)) for _, w, _ in before}
    counts = toxicity._contexts(sample)
    assert {r["word"]: (r["n0"], r["n1"]) for r in counts.collect()} == want
    rng = random.Random(7)
    table = [(f"w{k}", rng.choice([5, 400, 3_000]), rng.choice([5, 400, 3_000])) for k in range(60)]
    total = [sum(r[j] for r in table) for j in (1, 2)]
    made = {}
    for w, a, b in table:
        prior = toxicity.PRIOR_WORDS * (a + b) / sum(total) + toxicity.PRIOR_EACH
        odds = [math.log((c + prior) / (t + toxicity.PRIOR_WORDS - c - prior)) for c, t in zip((a, b), total, strict=True)]
        z = (odds[1] - odds[0]) / math.sqrt(1 / (a + prior) + 1 / (b + prior))
        if abs(z) >= toxicity.MIN_Z and abs(odds[1] - odds[0]) >= toxicity.MIN_ODDS:
            made[w] = (odds[1] - odds[0], z)
    got = {r["word"]: (r["s"], r["z"]) for r in toxicity._log_odds(spark.createDataFrame(table, "word string, n0 long, n1 long"), *total).collect()}
    assert got.keys() == made.keys() and made and all(np.allclose(got[w], made[w]) for w in made)


def test_calibration_by_brute_force():
    """The curve's weights are where the weighted likelihood, with its ridge, has no slope."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.5, 0.7] + rng.normal(size=300) > 1.5).astype(int)
    w = toxicity._logistic(x, y)

    def loss(w):
        p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
        share = np.where(y > 0, math.sqrt(len(y) / (2 * y.sum())), math.sqrt(len(y) / (2 * (1 - y).sum())))
        return -(share * np.log(np.where(y > 0, p, 1 - p))).sum() + 0.005 * (np.array(w) ** 2).sum()

    best = loss(np.array(w))
    assert all(loss(np.array(w) + step) >= best - 1e-9 for step in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3)


def test_fit_is_the_mean_and_the_root(spark):
    """The extreme-value law: lambda is the root over harmless words, log K the mean of harmless best scores less Euler's constant."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    kept = [(r["text"], r["toxic"]) for r in toxicity._labelled(docs, labels, toxicity.MAX_LABELLED).where("calibrates").collect()]
    scores = toxicity.WordScores(model)
    best = []
    for text, toxic in kept:
        n, found = toxicity.passages(text, scores)
        if not toxic and found:
            best.append(max(s for _, _, s in found) + model.log_k)
    assert abs(np.mean([x for x in best if x > -10]) - 0.5772 - model.log_k) < 0.05
    counts = toxicity._contexts(toxicity._labelled(docs, labels, toxicity.MAX_LABELLED).where("not calibrates")).collect()
    total = sum(r["n0"] for r in counts)
    shares = [(r["n0"] / total, model.scores[r["word"].encode()][0]) for r in counts if r["word"].encode() in model.scores]
    chance = (1 - sum(p for p, _ in shares)) * math.exp(model.rate * model.drift) + sum(p * math.exp(model.rate * s) for p, s in shares)
    assert abs(chance - 1) < 1e-6


def test_languages_of_pages(spark, clashing):
    """Every page once, by text without tags, markup, address and host; odd pages too; as the operator gives for what was taken out of them."""
    rng = random.Random(14)
    words = {x: ["".join(rng.choices(a, k=5)) for _ in range(30)] for x, a in (("en", "abcdef"), ("de", "efghij"))}
    text = lambda x: " ".join(rng.choices(words[x], k=40))
    docs = spark.createDataFrame([(k, text(x), x) for k in range(60) for x in ("en", "de")], "doc_id long, text string, lang string")
    kinds = [("http://a.org/x", "<html lang='de'><script>var en</script><p>{}&nbsp;</p>", "de"), ("https://u@b.net/en/y?z", "<HTML data-x=1 lang=EN><!-- de --><b>{}</b>", "en"), ("http://c.de", "{}", "de")]
    rows = [(k, url, html.format(text(x)), x) for k in range(30) for url, html, x in [kinds[k % 3]]] + [(90, None, None, ""), (91, "x", "", ""), (91, "x", "", ""), (None, "http://a.org", "<p>1 2</p>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = langid.identify_pages(clashing(pages), docs).collect()
    assert len(got) == len(rows)
    of = {r["page_id"]: r for r in got}
    assert all(of[i]["language"] == x and of[i]["kept"] and of[i]["text_language"] == x for i, _, _, x in rows[:30])
    assert not any(of[i]["kept"] or of[i]["n_trigrams"] for i in (90, 91, None))
    taken = [(i, re.sub(r"(?s)<[^>]*>|&#?\w+;", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html or "")), d, s, h) for (i, _, html, _), (d, s, h) in zip(rows, [(("de", "org", "a.org"), ("en", "en", "b.net"), (None, "de", "c.de"))[k % 3] for k in range(30)] + [(None, None, None)] * 3 + [(None, "org", "a.org")], strict=True)]
    same = langid.identify(spark.createDataFrame(taken, "page_id long, text string, d string, s string, h string"), langid.fit(docs, "lang"), "page_id", "text", F.col("d"), F.col("s"), F.col("h")).collect()
    near = lambda rows: sorted((str(r["page_id"]), r["language"], round(r["posterior"], 9), str(r["text_language"]), r["n_trigrams"], r["kept"]) for r in rows)
    assert near(same) == near(got)
    assert langid.identify_pages(pages.limit(0), docs).isEmpty()
