from __future__ import annotations

import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from standscan.llm import queries, wavelet

WORDS = public_tokenizers.path("word_bpe_49k.json")


class Held(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def shard_of(ids, planes=16):
    documents = pa.table({"id": pa.array([1], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64())})
    return wavelet.Shard(Held(wavelet.pack(np.asarray(ids, "<u2"), planes, documents)))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 4095, 32767, 32768, 32769, 65536, 100_001])
@pytest.mark.parametrize("top", [1, 3, 49408])
def test_shard_matches_the_plain_array(n, top):
    ids = np.minimum(np.random.default_rng(n + top).geometric(0.01, n) - 1, top - 1) if top > 3 else np.random.default_rng(n).integers(0, top, n)
    shard = shard_of(ids)
    assert (shard.decode() == ids).all() and shard.n == n
    places = np.unique(np.linspace(0, n - 1, 50).astype(int)) if n else np.empty(0, int)
    assert shard.access(places).tolist() == ids[places].tolist()
    for token in [0, 1, 2, 77, 49407, 65536, -1, *ids[:3].tolist()]:
        where = np.flatnonzero(ids == token)
        assert shard.count(token) == len(where)
        assert shard.occurrences(token).tolist() == where.tolist()
        for end in (0, n // 3, n // 2, n):
            assert shard.rank(token, end) == (where < end).sum()
        assert shard.count(token, n // 4, n // 2) == ((where >= n // 4) & (where < n // 2)).sum()
    with pytest.raises(IndexError):
        shard.access([n])


def test_blocks_are_read_one_by_one_and_shrink(monkeypatch):
    ids = np.random.default_rng(1).geometric(0.02, 300_000) % 49408
    raw = wavelet.pack(ids.astype("<u2"), 16, pa.table({"id": [1], "n_tokens": [len(ids)]}))
    assert len(raw) < 0.6 * 2 * len(ids)
    shard = wavelet.Shard(Held(raw))
    read = []
    inner = shard._read
    monkeypatch.setattr(shard, "_read", lambda at, length: read.append(length) or inner(at, length))
    shard.access([123_456])
    assert len(read) <= 16 * 2 and max(read) <= wavelet.BLOCK // 8
    with pytest.raises(ValueError):
        wavelet.Shard(Held(raw[:-1]))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS), wavelet.PieceEncoder(WORDS, 50)


odd = st.text(st.sampled_from(list("aAéÉ̈Σσς \t\n\r\x0b\x0c\x1c\x85\xa0  　İıß'sT1９·<|>endoftext‍\U0001f600\x00ﬁ`")), max_size=60)


@given(st.lists(st.one_of(odd, st.text(max_size=40), st.just("x<|endoftext|> a"), st.just("y" * 200), st.text(st.sampled_from(list("AbCsÀÿßéÉ×÷µªºŸĳſ.,;:!?'<|>`~[]{}@ ")), max_size=30)), max_size=4))
@settings(max_examples=300, deadline=None)
def test_pieces_equal_whole_texts(library, texts):
    tool, encoder = library
    got = [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode([t.encode("utf-8", "replace") for t in texts])]
    assert got == [tool.encode(t.encode("utf-8", "replace").decode(), add_special_tokens=False).ids for t in texts]


def test_every_letter_and_mark_after_words(library):
    tool, encoder = library
    for c in [*range(1, 0x250), 0x1E9E, 0x3A3, 0x130, 0x212A]:
        texts = [f"{chr(c)}", f"ab{chr(c)}cd", f"Ab{chr(c)}", f"{chr(c)}{chr(c)}Ab, {chr(c)}."]
        got = [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode([t.encode() for t in texts])]
        assert got == [tool.encode(t, add_special_tokens=False).ids for t in texts], hex(c)


def test_a_word_with_other_marks_and_cases_is_encoded_once():
    tool, encoder = Tokenizer.from_file(WORDS), wavelet.PieceEncoder(WORDS)

    class Counted:
        words, model = [], encoder.model

        def tokenize(self, word):
            self.words.append(word)
            return self.model.tokenize(word)

    encoder.model = Counted()
    texts = [b"Vrimbel vrimbel,\tVRIMBEL. ", None, b"", b"\n", "vrimbel!! Öxelär öxelär; \xff".encode("latin-1"), " Öxelär öxelär; vrimbel".encode(), b"z" * 100 + b" " + b"z" * 100]
    got = [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(pa.array([b"cut", *texts], pa.binary()).slice(1))]
    assert got == [tool.encode((t or b"").decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
    assert len(Counted.words) == len(set(Counted.words)) == 3 and not any(len(p) > 64 for p in [*encoder.young, *encoder.words])


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool, encoder = Tokenizer.from_file(path), wavelet.PieceEncoder(path)
    assert not encoder.by_words
    for t in ("two  words\n here", ""):
        assert np.frombuffer(encoder.encode([t.encode()])[0], encoder.dtype).tolist() == tool.encode(t, add_special_tokens=False).ids


def brute(rows, end=2):
    """``(id, start, n_tokens, crc)`` by the library over whole texts, one after another."""
    tool, at, out = Tokenizer.from_file(WORDS), 0, []
    for key, text in rows:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, end]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_library_on_the_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.queries()["op11_wavelet_shards"](spark, "/root/testdata/sf0.01").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("shard_tokens", [1, 40, 1 << 20])
def test_odd_rows_and_small_shards(spark, shard_tokens):
    texts = [(3, "b b b"), (None, "nobody"), (3, "b b b"), (2, None), (1, ""), (5, " \n\t"), (4, "word " * 30_000), (7, "z" * 5000), (3, "b c"), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"start": F.lit("x"), "k": F.lit(1), "ids": F.lit(2)})
    manifest = wavelet.write_shards(df, WORDS, 2, shard_tokens=shard_tokens)
    got = wavelet.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    got = sorted((tuple(r) for r in got), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 2, 3, 3, 3, 4, 5, 7]
    assert got[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted([(r[0], r[2], r[3]) for r in got], key=key) == sorted([(r[0], r[2], r[3]) for r in brute(texts)], key=key)
    if shard_tokens == 1:
        assert manifest.count() == len(texts)


def test_empty_table_and_other_ids(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "x")], "name string, body string")
    manifest = wavelet.write_shards(df, WORDS, 2, "name", "body")
    assert [r[0] for r in wavelet.read_tokens(manifest, "name").orderBy("start").collect()] == ["a", "b"]
    none = wavelet.write_shards(df.limit(0), WORDS, 2, "name", "body")
    assert none.count() == 0 and wavelet.read_tokens(none, "name").count() == 0 and wavelet.count_tokens(none, [2]).count() == 0


def test_counts_and_places_over_shards(spark):
    rows = [(i, "alpha beta " * (i % 5) + ("gamma" if i % 3 else "")) for i in range(200)]
    manifest = wavelet.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 2, shard_tokens=100)
    assert manifest.count() > 4
    tool = Tokenizer.from_file(WORDS)
    ids = [[*tool.encode(t, add_special_tokens=False).ids, 2] for _, t in rows]
    beta, gamma = tool.encode(" beta").ids[0], tool.encode("gamma").ids[0]
    asked = [2, beta, gamma, 40_000]
    assert {r["token"]: r["n"] for r in wavelet.count_tokens(manifest, asked).collect()} == {t: sum(x.count(t) for x in ids) for t in asked}
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    want = sorted((d, p, int(starts[d]) + p) for d, x in enumerate(ids) for p, t in enumerate(x) if t == beta)
    assert sorted(map(tuple, wavelet.find_token(manifest, beta).collect())) == want
