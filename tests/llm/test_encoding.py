"""Operators 1 and 10 against the libraries' own encoders."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from netquarry.llm import bpe, token_store
from netquarry.llm.queries import PATTERN, RANKS, TOKENIZER


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  two  spaces ", "\n\n x", "tab\tx", "<|endoftext|>", "it's I'LL we're", "12345 67890", "é́", "a b", "　x y", "😀 ok", "x" * 3000, "abc " * 500, " lead", "trail ", "a\r\nb", "\x1c y", "ſs 'ſ"]


@pytest.mark.parametrize("cuts_at_space", [False, True])
def test_ids_of_odd_texts(encoding, cuts_at_space):
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(ODD, RANKS, PATTERN, cuts_at_space)]
    assert got == [encoding.encode_ordinary(t) for t in ODD]
    assert [bpe.decode_ids(np.array(i, "<u4").tobytes(), RANKS).decode() for i in got] == ODD


def test_pattern_that_joins_line_ends(tmp_path):
    """A pattern and vocabulary with tokens across a line end: texts aren't cut there unless the caller says so."""
    ranks = {bytes([b]): b for b in range(256)} | {b".\n": 256}
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(k).decode()} {v}\n" for k, v in ranks.items()))
    pattern = r"\p{L}+|[^\s\p{L}]+[\r\n]*|\s+"
    want = tiktoken.Encoding("joined", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["a.\nb", "end.\n", "x .\n y"]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(texts, str(tmp_path / "ranks"), pattern)]
    assert got == [want.encode_ordinary(t) for t in texts] and any(256 in x for x in got)


def test_encode_table(spark, docs, encoding, clashing, empty):
    got = {(r[0], r[1], r[2], r[3]) for r in bpe.digests(clashing(docs), RANKS, PATTERN, cuts_at_space=True).collect()}
    want = set()
    for r in docs.collect():
        ids = encoding.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == want
    assert bpe.digests(empty, RANKS, PATTERN).isEmpty()
    back = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS)
    assert {(r[0], bytes(r[1]).decode()) for r in back.collect()} == {(r["doc_id"], r["text"] or "") for r in docs.collect()}


def test_token_store(spark, docs, clashing, empty):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store.summary(spark, clashing(docs), TOKENIZER).collect())) == want
    small = token_store.read_store(token_store.write_store(docs, TOKENIZER, shard_tokens=500, task_bytes=4000))
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in small.collect()) == [w[:3] for w in want]
    assert token_store.summary(spark, empty, TOKENIZER).isEmpty()
    checked = token_store.read_store(token_store.write_store(docs, TOKENIZER, shard_tokens=500), 2)
    assert checked.count() == len(want)
    twice = docs.unionByName(docs)
    assert token_store.summary(spark, twice, TOKENIZER).count() == 2 * len(want)


def test_token_store_of_added_tokens(spark):
    """Texts with a special token's string get the ids that the tokenizer as loaded gives."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*ODD, "a<|endoftext|>b", "one two\nx <|endoftext|>\n<|endoftext|> y", "<|endoftext", "|> <|endoftext|><|endoftext|>", "a b"]
    want, start = [], 0
    for k, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, token_store.summary(spark, df, TOKENIZER).collect())) == want


def test_units_are_encoded_once():
    """Words that were met before are looked up, whatever white space stands around them; kept units don't change ids."""
    t, table = Tokenizer.from_file(TOKENIZER), token_store._table.__wrapped__(TOKENIZER)
    given, encode, whole = [], table.encode, table.whole
    table.encode = lambda units: given.extend(units.to_pylist()) or encode(units)
    table.whole = lambda texts: given.extend(texts) or whole(texts)

    def check(texts):
        ids, counts = table.packed(pa.array(texts), 2)
        want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))

    check(["zwölf blue, größe green\nred"])
    assert sorted(x.decode() for x in given) == ["\nred", "\nzwölf", " blue", " green", " größe"]
    given.clear()
    check(["zwölf green, blue! größe.", "red größe,\nred blue", "zwölf"])
    assert given == []
    check(["zwölf\t blue  green\r\nred größe", "red\n\nzwölf \u3000 green? "])
    assert not {b" blue", b" green", b" gr\xc3\xb6\xc3\x9fe", b"\nred"} & {*given}
    rng, bits = random.Random(5), [*ODD, *"a ß × ÷ é ª . , ! 's ' - 12 ² 日本 “ ¿ _ ſ Ġ".split(), *" \n\t\x0b\x1c\x85\xa0\u2003\u2028\u200b\u3000", " ", " ", "  ", "\n\n"]
    for most in (1_000_000, 30):
        table.most = most
        for _ in range(4):
            check([None, *("".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(150))])
    assert len(table.units) < 3_000 and max(map(len, table.units.to_pylist())) <= table.LONGEST
    small = pa.chunked_array([["b c", "a"]], pa.large_string()).chunk(0)
    assert table.packed(small.slice(1), 2)[0].tolist() == [*t.encode("a", add_special_tokens=False).ids, 2]


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (1000, 3), (5000, 50_000), (513, 70_000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        m, docs, lengths = token_store.from_bytes(token_store.to_bytes(token_store.WaveletMatrix.of(ids), [1, None], [n, 0]))
        assert docs == [1, None] and lengths.tolist() == [n, 0]
        assert m.ids().tolist() == ids.tolist()
        places = rng.integers(0, n, 20) if n else []
        assert m.access(places).tolist() == [int(ids[p]) for p in places]
        for token in {*ids[:5].tolist(), top + 1}:
            assert m.occurrences(token) == np.flatnonzero(ids == token).tolist()
            assert m.count(token, n // 2) == int((ids[: n // 2] == token).sum())
    m = token_store.WaveletMatrix.of(np.array([5, 2, 7, 2], np.uint32))
    token_store.check_ends(m, m.ids(), np.array([2, 4]), 2)
    with pytest.raises(ValueError):
        token_store.check_ends(m, m.ids(), np.array([1, 4]), 2)
    with pytest.raises(ValueError):
        token_store.from_bytes(b"nothing of the kind")
