from __future__ import annotations

import io
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
pytest.importorskip("standscan.llm")

from standscan.llm import bpe, classifier, jaccard, langid, licenses, mixing, quality_rules, topk, url_filter, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, key string"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with results."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src0", None, 0.0, "x", "y") for i, t in zip(ids, texts, strict=True)], DOCS)


# ---------------------------------------------------------------- 1 WARC


def test_warc_round_trip_and_revisits(spark):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://b/ c", None), (4, "u", ""), (5, "u", "é" * 50_000), (None, "u", "same"), (7, "u", "single")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.read_archives(warc.write_archives(df))
    assert records.where("gap_reason is not null").count() == 0
    got = {r["page_id"]: r for r in warc.summary(records).collect()}
    assert len(got) == 7
    assert (got[1]["record_type"], got[1]["refers_to"], got[1]["payload_bytes"]) == ("revisit", 2, 4)
    assert got[2]["record_type"] == got[4]["record_type"] == "response"
    assert got[3]["refers_to"] == 4 and got[None]["refers_to"] == 2 and got[5]["payload_bytes"] == 100_000
    assert got[7]["payload_digest"] == warc.base32_sha1(b"single")
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def archive(n=6, packed=True):
    import gzip

    return [gzip.compress(r) if packed else r for r in (warc.record_bytes(i, f"http://x/{i}", b"payload %d " % i * 200, None, False) for i in range(n))]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_after_damage(packed):
    members = archive(packed=packed)
    raw = bytearray(b"".join(members))
    at = len(members[0]) + len(members[1])
    raw[at + len(members[2]) // 2] ^= 0x55  # inside the third member
    raw = bytes(raw[:-7])  # the last one is cut short
    out = list(warc.salvage(io.BytesIO(raw), len(raw)))
    ids = [int(re.search(r"page:(\d+)", o[3]["warc-record-id"])[1]) for o in out if o[2] is None]
    gaps = [(o[0], o[1]) for o in out if o[2]]
    assert ids == [0, 1, 3, 4]
    assert gaps == [(at, len(members[2])), (len(raw) - len(members[5]) + 7, len(members[5]) - 7)]
    assert sum(o[1] for o in out) == len(raw)


def test_salvage_of_junk():
    assert [o[:2] for o in warc.salvage(io.BytesIO(b"junk"), 4)] == [(0, 4)]
    assert list(warc.salvage(io.BytesIO(b""), 0)) == []


def test_warc_headers_of_any_length(spark):
    df = spark.createDataFrame([(1, "\n" * 30_000, "a"), (2, "x" * 3_000_000, "b"), (3, "u", "c")], "page_id long, url string, html string")
    records = warc.read_archives(warc.write_archives(df))
    assert sorted(r["page_id"] for r in warc.summary(records).collect()) == [1, 2, 3]
    raw = warc.record_bytes(1, " " * 30_000, b"a", None, False) + archive(1, packed=False)[0]
    assert [o[2] for o in warc.salvage(io.BytesIO(raw), len(raw))] == [None, None]


def test_archives_are_dealt_to_many_tasks(spark, tmp_path):
    members = archive()
    for i in range(9):  # in each, one record is damaged and one has a wrong HTTP length
        odd = warc.record_bytes(100, "u", b"payload", None, False).replace(b"Content-Length: 7", b"Content-Length: 9")
        odd = odd.replace(re.search(rb"WARC-Block-Digest: [^\r]*\r\n", odd)[0], b"")
        (tmp_path / f"{i}.warc").write_bytes(members[0] + members[1][:40] + b"junk" + members[2] + odd)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{i}.warc", 1 << 40, 0) for i in range(9)] * 2 + [(None, 1, 0)], "path string, bytes bigint, offset int")
    records = warc.read_archives(paths)
    assert records.rdd.getNumPartitions() == 9
    assert {(r["n"], r["g"]) for r in records.groupBy("path").agg(F.count("*").alias("n"), F.count("gap_reason").alias("g")).collect()} == {(4, 1)}
    assert sum(r["length"] for r in records.collect()) == sum(f.stat().st_size for f in tmp_path.iterdir())
    assert {r["payload_bytes"] for r in warc.summary(records).where("page_id = 100").collect()} == {7}


def test_salvage_of_members_with_many_records():
    import gzip

    plain = archive(packed=False)
    ids = lambda out: [int(re.search(r"page:(\d+)", o[3]["warc-record-id"])[1]) for o in out if o[2] is None]
    read = lambda raw: list(warc.salvage(io.BytesIO(raw), len(raw)))
    one = gzip.compress(b"".join(plain))
    out = read(one)
    assert ids(out) == list(range(6)) and sum(o[1] for o in out) == len(one) and {o[0] for o in out} == {0}
    bad = plain[1].replace(b"payload 1", b"PAYLOAD 1", 1)  # its digest fails, the member's checksum holds
    mixed = gzip.compress(plain[0] + bad + plain[2]) + gzip.compress(plain[3]) + plain[4] + gzip.compress(b"")
    out = read(mixed)
    assert ids(out) == [0, 2, 3, 4] and [o[2] for o in out if o[2]] == ["block digest differs", "no version line"] and sum(o[1] for o in out) == len(mixed)
    random = [warc.record_bytes(i, "u", np.random.default_rng(i).bytes(5000), None, False) for i in range(4)]
    cut = gzip.compress(b"".join(random))[:-3000]
    out = read(cut)
    assert ids(out) == [0, 1, 2] and out[-1][:3] == (0, len(cut), warc.CUT)


# ---------------------------------------------------------------- 2 BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.machine.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120))
def test_bpe_equals_library(coder, reference, text):
    ids = coder.encode(text)
    assert ids == reference.encode_ordinary(text)
    decoder = bpe.StreamDecoder(coder.machine.tokens)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text


def test_bpe_long_pieces_and_small_memo(coder, reference):
    machine = bpe.Encoder(coder.machine.ranks, P.PATTERN, max_pieces=3)
    machine.machine.max_pairs = 5
    for text in ("a" * 5000, "supercalifragilistic" * 90, " " * 700 + "x", "don't we'll 日本語 😀" * 9):
        assert machine.encode(text) == reference.encode_ordinary(text)
        raw = text.encode()
        want = machine.machine.encode_piece(raw)
        for chunk in (1, 2, 7, 40):  # the lookahead after which tokens are emitted
            assert machine.machine.encode_piece(raw, chunk) == want


def test_round_trip_equals_library(spark, reference):
    import hashlib

    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] if Path("/root/testdata/sf0.001").exists() else []
    texts += [None, "", "a\x1cb  \n\n c", "é" * 30_000, "日本語 😀👩‍👩‍👧 don't", "x y", "x y"]
    got = {r["doc_id"]: r for r in bpe.round_trip(docs(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(t or "" for t in texts):
        ids = reference.encode_ordinary(text)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=24))
def test_decoder_on_any_bytes(raw):
    decoder = bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
    got = decoder.feed(list(raw)) + decoder.finish()
    assert got.replace("�", "") == raw.decode("utf-8", "ignore")


def test_bpe_frames(spark, coder):
    df = docs(spark, ["Hello world", None, "", "x" * 20_000])
    out = bpe.decode(bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "Hello world", 1: "", 2: "", 3: "x" * 20_000}
    assert bpe.round_trip(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# ---------------------------------------------------------------- 3 language, 7 classifier

WORDS = {"en": "the and of with from house river stone which under", "de": "der und von mit aus haus fluss stein welche unter"}


def sentences(lang, n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[lang].split(), 30)) for _ in range(n)]


def test_language_held_out(spark):
    rows = [(i, t, lang) for lang in WORDS for i, t in enumerate(sentences(lang, 40, len(lang) + ord(lang[0])))]
    df = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 2 = 0"))
    got = langid.predict(df.where("doc_id % 2 = 1").join(df.select("doc_id", F.col("lang").alias("want")), "doc_id"), model, extra={"want": F.col("want")}).collect()
    assert np.mean([r["lang_pred"] == r["want"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(spark, [None, "", "123 !", "x"]), model).collect()}
    assert odd[0] == odd[1] == odd[2] == "und" and odd[3] in WORDS
    assert langid.predict(docs(spark, ["abc"]), langid.fit(df.limit(0))).first()["lang_pred"] == "und"


def test_language_of_long_repeated_and_tied_texts(spark):
    train = [(i, t, lang) for lang in WORDS for i, t in enumerate(sentences(lang, 30, 3 + len(lang) + ord(lang[0])))]
    late = " ".join(sentences("de", 1, 5)) + " zebra" * 9000 + " quagga" * 3000  # all of a long text may be learned from
    df = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(train)], "doc_id long, text string, lang string")
    one = langid.fit(spark.createDataFrame([(1, late, "de")], df.schema))
    assert b"zebra" in one.content["de"] and b"quagga" in one.content["de"] and len(one.content["de"]) <= 17 << 10
    model = langid.fit(df)
    long = " ".join(sentences("en", 3000, 1))
    got = langid.predict(docs(spark, [long, long, "a", None, sentences("de", 1, 9)[0]]), model).collect()
    assert [r["lang_pred"] for r in got][:2] == ["en", "en"] and got[0]["score"] == got[1]["score"] and got[4]["lang_pred"] == "de"
    assert not got[0]["rejected"] and got[3]["rejected"]
    same = langid.fit(df.withColumn("text", F.lit("one text for all of them")))
    tied = langid.predict(docs(spark, ["another text"]), same).first()
    assert tied["lang_pred"] == "de" and tied["rejected"]


def test_classifier_held_out(spark):
    rng = np.random.default_rng(0)
    good, bad = "calm river stone house tree".split(), "### buy $$$ now !!!".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, 40)), i % 2) for i in range(200)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows if i < 120] + [(None, 1), (3, 7)], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in classifier.score(df, classifier.fit(df, lab)).collect()}
    assert np.mean([got[i] == y for i, _, y in rows if i >= 120]) > 0.97
    untrained = classifier.fit(df, lab.limit(0))
    assert {r["score"] for r in classifier.score(docs(spark, [None, "", "a b"]), untrained).collect()} == {0.5}


# ---------------------------------------------------------------- 4 rules


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_match_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", " \n\t ", "a", "é 😀 #x\n\nsame\nsame\n same"] + [" ".join(rng.choice(list("abc"), n)) for n in (4, 5, 6, 9, 30, 200)]
    texts += ["one two three four five six " * 3, "word\x1cword x"]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_rules(t)
    judged = quality_rules.judge(docs(spark, texts), keep=("text", "key")).where("kept")
    assert judged.count() == sum(r["kept"] for r in got.values())
    assert quality_rules.judge(docs(spark, ["x"]).limit(0)).count() == 0


# ---------------------------------------------------------------- 5 urls


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.com/de/", "http://xexample.com/de/", "ftp://a.org/fr/1#z", None, "nothing", "http://net", "http://net/", "http://example.net/de/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame([*url_filter.RULES, (None, "block"), ("net/", "block")], "rule string, verdict string")
    want = ["allow", "block", "allow", "allow", "allow", "allow", "allow", "block", "block"]
    got = {r["page_id"]: r for r in url_filter.judge(df, rules).collect()}
    assert [got[i]["verdict"] for i in range(len(urls))] == want and got[0]["rule"] == "example.net/en/"
    sharded = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules, shard_bytes=20).collect()}
    assert [sharded[i] for i in range(len(urls))] == want and len(url_filter.write_index(url_filter.clean_rules(rules), 20)) > 1
    assert url_filter.judge(df, rules.limit(0)).where("verdict <> 'allow'").count() == 0


def test_urls_of_long_hosts_and_other_letters(spark):
    import time

    long = "a." * 100_000 + "example.com"
    df = spark.createDataFrame([(1, f"http://{long}/de/x"), (2, "http://www.É.org/"), (3, "http://é.org/"), (4, "http://A.b.C.d/"), (5, "http://b.c.d/"), (6, "http://c.d"), (7, "http://.net/")], "page_id long, url string")
    rules = spark.createDataFrame([*url_filter.RULES, ("É.org/", "block"), ("B.c.D", "block"), ("/x", "block"), ("c.d/", "allow")], "rule string, verdict string")
    began = time.perf_counter()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    assert time.perf_counter() - began < 30
    assert got == {1: ("example.com/de/", "block"), 2: ("É.org/", "block"), 3: (None, "allow"), 4: ("b.c.d/", "block"), 5: ("b.c.d/", "block"), 6: (None, "allow"), 7: ("net/", "block")}


def test_digest_collision_is_confirmed(tmp_path):
    path = tmp_path / "x.idx"
    strings = [b"aa/", b"bb/"]
    with open(path, "wb") as f:
        f.write(struct.pack(url_filter.HEAD, 2, 6, 0, 0) + np.array([5, 5], "<i8").tobytes() + np.array([0, 3, 6], "<i8").tobytes() + b"\x00\x01" + b"".join(strings))
    index = url_filter.DigestIndex(str(path))
    assert index.probe(np.array([5, 5, 5, 6]), lambda c: ["bb/", "cc/", "aa/", "bb/"][c]) == [(0, 1), (2, 0)]


# ---------------------------------------------------------------- 6 mixing


def test_rake_meets_marginals():
    rng = np.random.default_rng(2)
    index = [rng.integers(0, n, 200) for n in (5, 3, 4)]
    tokens = rng.uniform(50, 200, 200)
    shares = [np.full(n, 1 / n) for n in (5, 3, 4)]
    factors, errors, _ = mixing.rake(index, tokens, shares, 0.3 * tokens.sum())
    p = np.minimum(1, np.prod([f[i] for f, i in zip(factors, index, strict=True)], axis=0))
    assert max(e.max() for e in errors) < 1e-3 and abs((p * tokens).sum() / tokens.sum() - 0.3) < 1e-3
    assert np.allclose(np.bincount(index[0], p * tokens), 0.06 * tokens.sum(), rtol=1e-2)


def test_mix_frames(spark):
    rows = [(i, "w " * (1 + i % 7), ("en", "de", None)[i % 3], f"s{i % 4}") for i in range(3000)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, keep_share=0.4).toPandas()
    assert len(out) == 3001 and out["probability"].between(0, 1).all()
    assert abs((out["n_tokens"] * out["sampled"]).sum() / out["n_tokens"].sum() - 0.4) < 0.05
    assert mixing.sample(df, keep_share=0.4).count() == out["sampled"].sum()
    assert mixing.mix(df.limit(0)).count() == 0
    few = mixing.make_plan(df.selectExpr("source", "lang", "'t' topic", "cast(1 as bigint) n_tokens"), max_categories=(2, 2, 2))
    assert mixing.REST in few.factors["source"]


def test_mix_of_many_categories(spark):
    df = spark.range(4000).selectExpr("concat('s', id % 2000) source", "'en' lang", "'t' topic", "cast(10 as bigint) n_tokens")
    plan = mixing.make_plan(df)
    chance = [f * plan.factors["lang"]["en"] * plan.factors["topic"]["t"] for f in plan.factors["source"].values()]
    assert len(chance) == 2000 and np.allclose(chance, 0.5, rtol=1e-3)
    given = mixing.make_plan(df, {"source": {f"s{i}": 1.0 for i in range(2000)}}, max_categories=(10, 128, 32))
    rest = given.factors["source"][mixing.REST] * given.factors["lang"]["en"] * given.factors["topic"]["t"]
    assert abs(rest - 0.5) < 1e-3
    tempered = mixing.make_plan(df, max_categories=(10, 128, 32))
    assert abs(tempered.factors["source"][mixing.REST] * tempered.factors["lang"]["en"] * tempered.factors["topic"]["t"] - 0.5) < 1e-3


def test_mix_ties_copies_topics_and_unmet_targets(spark):
    rows = [(7, "w w", "en", "a", "t1", 1), (7, "w w", "en", "a", "t1", 1), (8, "w " * 200_000, "de", "b", None, 2), (9, "", "en", "a", "t2", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, probability int")
    out = mixing.mix(df, topic="topic").collect()
    assert sorted(r["n_tokens"] for r in out) == [0, 2, 2, 200_000] and {r["topic"] for r in out} == {"t1", "t2", None}
    assert len({r["sampled"] for r in out if r["doc_id"] == 7}) == 1
    assert mixing.sample(df, topic="topic").columns == df.columns
    weighted = spark.createDataFrame([("a", "en", "x", 100), ("b", "de", "x", 100)], "source string, lang string, topic string, n_tokens bigint")
    clash = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}  # each source has one language
    with pytest.warns(UserWarning, match="not met"):
        plan = mixing.make_plan(weighted, clash, keep_share=0.3)
    assert plan.worst_error > 0.02 and (plan.unmet["source"] or plan.unmet["lang"])
    with pytest.raises(ValueError, match="not met"):
        mixing.make_plan(weighted, clash, keep_share=0.3, strict=True)


# ---------------------------------------------------------------- 8 licences


def test_licences(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.py", "plain text"),
        (3, "a/b/y.py", "First.\nLicensed under the Apache License, Version 2.0.\nMore."),
        (4, "c/z.py", "nothing here"),
        (5, None, "This work is licensed under the GNU General Public License, version 3."),
        (6, "a/b/d/COPYING", None),
        (7, "a/b/d/e.txt", "the license of the river is a word among many others in this long sentence about rivers and stones"),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scan(df).collect()}
    assert got[1] == ("mit", "mit", None) and got[2] == (None, "mit", "a") and got[3] == ("apache-2.0", "apache-2.0", None)
    assert got[4] == (None, None, None) and got[5] == ("gpl-3.0", "gpl-3.0", None) and got[6] == (None, "mit", "a") and got[7] == (None, "mit", "a")
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.corpus_paths(docs(spark, ["x", "y"], [10_000, 10_001])).select("path").collect()[1][0] == "c1/b100/src0/10001.txt"


GPL_NOTICE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_licences_of_headers_and_whole_files(spark):
    texts = dict(licenses.FULL_TEXTS)
    wrapped = "#!/bin/sh\n# A tool for rivers and stones\n#\n# " + GPL_NOTICE.replace("\n", "\n# ") + "\n\necho river\n" + "make stone of the river with the house\n" * 40
    embedded = "the river runs under the stone\n" * 30 + "\n".join(" * " + x for x in texts["mit"].splitlines()) + "\nint main() { return 0; }\n" * 30
    files = [(1, "a/x.sh", wrapped), (2, "b/y.c", embedded), (3, "b/z.c", GPL_NOTICE.replace("\n", " ")), (4, "d/n.txt", "a licence to the river and the stone " * 300)]
    files += [(10 + i, f"{lic}/LICENSE", text) for i, (lic, text) in enumerate(texts.items())]
    files += [(100 + i, f"e/{i}.txt", f"the house and the stone of river {i} are made of a thing with that") for i in range(60)]
    got = {r["doc_id"]: r["own_license"] for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("gpl-3.0", "mit", "gpl-3.0", None)
    assert [got[10 + i] for i in range(len(texts))] == list(texts) and not any(got[100 + i] for i in range(60))


def test_candidate_texts_are_counted_once(spark):
    candidates = spark.createDataFrame([(1, 0, ["licensed", "under", "the", "mit", "license"])], "ss_row long, ss_part int, ss_terms array<string>")
    found = licenses.score_texts(candidates, spark.createDataFrame([("the", 3)], "term string, df long"), 10, 0.6)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # the counts are read, not made again for each use
    assert [r["license"] for r in found.collect()] == ["mit"]


def test_texts_without_parts_of_markers_have_no_marker(spark):
    words = ["license", "LİCENSE", "Licence", "licen", "COPYRIGHT", "copy right", "SPDX", "Public Domain", "public\n# domain", "publicdomain", "hereby  granted", "Redistribution--AND*use", "ALL rıghts reserved", "all\nrights é reserved", "all rights", "ſpdx", ""]
    df = spark.createDataFrame([(w,) for w in words] + [(f"éÉ {w} ß",) for w in words], "t string")
    marks = [F.col("t").rlike(m) for m in (licenses.MARKER, licenses.MARKER_ACROSS_LINES)]
    assert df.where((marks[0] | marks[1]) & ~licenses._may_have_marker(F.col("t"))).count() == 0 and df.where(~licenses._may_have_marker(F.col("t"))).count() > 8
    terms = df.select(F.array_join(licenses._split_terms(F.col("t")), " ").alias("t"))
    assert terms.where(F.col("t").rlike(licenses.MARKER) != F.col("t").rlike(licenses.MARKER_OF_TERMS)).count() == 0


def test_licence_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), (["x"],)], "t array<string>").select(F.sort_array("t").alias("t")).select(licenses._counts(F.col("t")).alias("c"))
    assert [[tuple(p) for p in r["c"]] for r in df.collect()] == [[("a", 1), ("b", 2)], [("x", 1)]]


# ---------------------------------------------------------------- 9 top-k


@pytest.mark.parametrize("huge", [False, True])
def test_topk_matches_brute_force(spark, huge):
    rng = np.random.default_rng(3)
    x = (rng.normal(0, 1, (400, 8)).round(1) * (1e4 if huge else 1)).astype("f4").astype("f8")
    vectors = [(i, r) for i, r in enumerate(x)] + [(100, x[100]), (200, -x[200]), (200, x[7] * 3)]  # repeated ids, with equal and other vectors
    rows = [(i, r.tolist(), 0) for i, r in vectors]
    rows += [(500, None, 0), (600, [1.0, None], 0), (700, [float("nan")] * 8, 0), (None, [1.0] * 8, 0), (800, [], 0), (900, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.search(topk.build_index(df, shard_rows=64), df.where("vec_id % 100 = 0"), k=10, block_rows=2).collect())
    ids, ints = [i for i, _ in vectors], np.floor(1024 * np.array([r for _, r in vectors])).astype("i8")
    want = []
    for n, q in enumerate(ids):
        if q % 100 == 0:
            scores = ints @ ints[n]
            order = sorted((m for m in range(len(ids)) if m != n), key=lambda m: (-scores[m], ids[m]))[:10]
            want += [(q, rank, ids[m], int(scores[m])) for rank, m in enumerate(order, 1)]
    assert got == sorted(want)
    assert topk.search(topk.build_index(df.limit(0)), df).count() == 0
    assert topk.search(topk.build_index(df), df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e5, 1e6, 1e13])
def test_topk_of_large_components(spark, size):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (120, 4))
    x[::7, 2] *= size
    x[100] = [0.5, 0.25, 1e-3, 1.0]  # a query of small numbers, so that scores are longs
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    index = topk.build_index(df, shard_rows=32)
    out = topk.search(index, df.where("vec_id = 100"), k=10).collect()
    ints = [[int(v) for v in np.floor(1024 * r)] for r in x]
    scores = [sum(a * b for a, b in zip(ints[100], r, strict=True)) for r in ints]
    want = sorted((i for i in range(120) if i != 100), key=lambda i: (-scores[i], i))[:10]
    assert [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"])] == [(i, scores[i]) for i in want]


def test_topk_of_a_query_whose_own_score_is_no_long(spark):
    df = spark.createDataFrame([(1, [1e13, 0.0]), (2, [0.0, 1.0]), (3, [1e-3, 1.0])], "vec_id long, embedding array<double>")
    out = topk.search(topk.build_index(df), df.where("vec_id = 1")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 3, 10**13 * 1024), (2, 2, 0)]
    with pytest.raises(Exception, match="no 64-bit integer"):
        topk.search(topk.build_index(df.union(df.where("vec_id = 1"))), df.where("vec_id = 1")).collect()


def test_topk_beyond_64_bit_sums():
    rows = np.array([[1 << 62, 1 << 62, 1], [-(1 << 62), 1 << 62, 5], [1, 2, 3]], "i8")
    ids, scores = topk.Shard(np.arange(3), rows).search(np.array([4, -4, 1], "i8"), 1, None, 1)
    assert (ids.tolist(), scores.tolist()) == ([0], [1])
    with pytest.raises(OverflowError):
        topk.Shard(np.arange(3), rows).search(np.array([4, 4, 1], "i8"), 1, None, 1)


# ---------------------------------------------------------------- 10 Jaccard join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary, 120)) for _ in range(30)]
    for base in range(6):
        for _ in range(20):  # a family of near copies larger than a block with the next line
            w = texts[base].split()
            w[rng.integers(0, 120)] = "changed" + str(rng.integers(0, 9))
            texts.append(" ".join(w))
    texts += [texts[0]] * 80 + [None, "", " ", "one two", "one two", "one  two"]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    s, n = [shingles(t) for t in texts], len(texts)
    links = [[j for j in range(n) if j != i and s[i] and s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *[root[j] for j in links[i]]]) for i in range(n)]
        if new == root:
            break
        root = new
    assert got == {i: (root[i], len(links[i])) for i in range(n)}
    kept = [r["doc_id"] for r in jaccard.one_per_class(docs(spark, texts)).collect()]
    assert sorted(kept) == sorted({root[i] for i in range(n)})


def test_tries_tie_all_texts_below_a_node(spark):
    """Over many small partitions the ties give the groups of equal prefixes, whatever their sizes."""
    rng = np.random.default_rng(5)
    paths = np.concatenate([rng.integers(-(1 << 62), 1 << 62, 300), (7 << 40) + rng.integers(0, 1 << 30, 500), np.full(400, -5)])
    rows = [(bytes([i // 256, i % 256]), [int(p), int(q)]) for i, (p, q) in enumerate(zip(paths, rng.permutation(paths), strict=True))]
    df = spark.createDataFrame(rows, "ss_key binary, ss_sig array<bigint>").union(spark.createDataFrame([(b"none", None)], "ss_key binary, ss_sig array<bigint>"))
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [tuple(r) for r in jaccard._trie_edges(df, 3).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    nodes = [r["n"] for r in df.select(F.xxhash64("ss_key").alias("n")).collect()][: len(rows)]

    def classes(pairs):
        root = {n: n for n in nodes}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for n in nodes:
            groups.setdefault(find(n), set()).add(n)
        return sorted(map(sorted, groups.values()))

    first = {}
    want = [(n, first.setdefault((tree, sig[tree] >> 40), n)) for tree in range(2) for n, (_, sig) in zip(nodes, rows, strict=True)]
    assert classes(edges) == classes(want)


def test_jaccard_edges(spark):
    same = docs(spark, ["a b c d e f"] * 4, [7, 7, None, 9])
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(same).collect()} == {(7, 7, 3), (None, 7, 3), (9, 7, 3)}
    assert [r["doc_id"] for r in jaccard.one_per_class(same).collect()] == [7]
    assert jaccard.near_duplicates(same.limit(0)).count() == 0
    assert jaccard.forest_recall(0.8, jaccard.prefix_depth(0.8, 0.999)) >= 0.999


@pytest.mark.parametrize("slots", [1, 64, 1 << 26])
def test_full_key_filter_loses_nothing(spark, monkeypatch, slots):
    monkeypatch.setattr(jaccard, "SLOTS", slots)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join([*words, "x"]), "a b c d e f", "a b c d e f", "alone in the wide world here", None, " "]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 1), 3: (2, 1), 4: (4, 0), 5: (5, 0), 6: (6, 0)}
    assert sorted(r["doc_id"] for r in jaccard.one_per_class(docs(spark, texts)).collect()) == [0, 2, 4, 5, 6]


def test_blocks_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 3)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 40, 2)]
    got = jaccard.near_duplicates(docs(spark, texts)).toPandas()
    s = [shingles(t) for t in texts]
    want = [sum(1 for j in range(20) if j != i and len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8) for i in range(20)]
    assert got.sort_values("doc_id")["n_links"].tolist() == want


# ---------------------------------------------------------------- pipeline and contracts


def test_folds_are_crc32(spark):
    from standscan.llm.queries import fold

    got = {r["id"]: r["f"] for r in spark.range(50).withColumn("f", fold("id", 3)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("needs the test tables")
    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    df, ids = all_docs, {r["doc_id"] for r in all_docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(cp.STAGES):
        df = cp.materialise(stage(spark, df, sf), "test-stage")
        left = {r["doc_id"] for r in df.select("doc_id").collect()}
        assert left <= ids and (k == 4 or df.columns == all_docs.columns)
        ids = left
    assert {r["doc_id"] for r in cp.run(spark, sf).collect()} == ids


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, an empty table, repeated rows and clashing columns pass through the filtering stages."""
    import corpus_pipeline as cp

    calm = "the river is under the stone house and the tree with a wide path of green grass by it that was here for long"
    df = docs(spark, [calm, calm, None, "", "## buy", calm + " again and more"], [1, 1, 2, None, 4, None])
    df.select("doc_id", F.lit(1).alias("quality")).where("doc_id is not null").distinct().write.parquet(str(tmp_path / "labels.parquet"))
    for given, most in ((df, 6), (df.limit(0), 0)):
        left = given
        for _, stage in cp.STAGES[:-1]:
            left = cp.materialise(stage(spark, left, str(tmp_path)), "test-odd")
            assert left.columns == df.columns and left.count() <= most
        assert cp.STAGES[-1][1](spark, left, str(tmp_path)).columns[0] == "doc_id"
