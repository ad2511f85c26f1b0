from __future__ import annotations

import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from standscan.llm import merkle, queries

NAMES = ("doc_id", "text", "lang", "source", "n_chars")
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    """All levels, the leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps_of(levels, i):
    for level in levels[:-1]:
        run = i // 8 * 8
        yield level[run:i], level[i + 1 : run + 8]
        i //= 8


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """The manifest by plain lists, with the whole tree in memory."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = [tree([m[2] for m in sorted(by_lang[g], key=lambda m: m[:3])]) for g in langs]
    top = tree([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for number, (g, levels) in enumerate(zip(langs, trees, strict=True)):
        for i, (_, _, leaf, row) in enumerate(sorted(by_lang[g], key=lambda m: m[:3])):
            steps = [*steps_of(levels, i), *steps_of(top, number)]
            folded = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                folded = leaf_of(row[0], lower(row[1]), *row[2:])
            for left, right in steps:
                folded = h(*left, folded, *right)
            out.append((row[0], leaf, levels[-1][0], root, h(*(d for a, b in steps for d in a + b)), folded, folded == root))
    return sorted(out, key=lambda r: tuple(map(str, r)))


def manifest(df, **more):
    tamper = F.coalesce(queries.fold("doc_id", 3) == 0, F.lit(False))
    got = merkle.manifest(df, tampered={"text": merkle.lowered("text")}, tamper=tamper, **more)
    return sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=lambda r: tuple(map(str, r)))


def rows_of(sizes):
    out = []
    for lang, n in sizes:
        out += [(len(out) * 7 % 1000 + len(out), f"Text {i} ÀB" if i % 4 else f"calm {i}", lang, "s" if i % 3 else None, i) for i in range(n)]
    return out


@pytest.mark.parametrize("sizes", [[("en", 1)], [("en", 8)], [("en", 9), ("de", 1)], [(None, 2), ("en", 64), ("é", 65), ("zz", 1)], [(f"l{k:02}", 1 + k % 3) for k in range(70)], [("en", 520), ("a", 73)]])
def test_matches_brute_force(spark, sizes):
    rows = rows_of(sizes)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert manifest(df) == brute(rows)


def test_odd_rows_and_clashing_columns(spark):
    rows = [
        (None, None, None, None, None), (None, "A", None, "", None), (5, "Same Row", "en", "x", 8), (5, "Same Row", "en", "x", 8), (5, "Same Row", "en", "y", 8),
        (-3, "", "en", "x", 0), (1 << 60, "LONG " * 100_000, "en", "x", None), (7, "tie", "", "x", 1), (7, "tie", "", "x", 1), (6, None, "de", None, 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = df.withColumns({c: F.lit("odd") for c in ("k", "g", "gid", "leaf", "shown", "at", "u", "root", "path", "n", "ss_part")})
    assert manifest(clash) == brute(rows)
    assert merkle.manifest(df.limit(0)).count() == 0
    assert merkle.manifest(df).where("not verified").count() == 0


def test_paths_prove_rows_on_their_own(spark):
    rows = rows_of([("en", 80), ("de", 3), ("fr", 1)])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for r in merkle.manifest(df, paths=True).collect():
        path = [(p["place"], [bytes(s) for s in p["siblings"]]) for p in r["path"]]
        assert merkle.fold(bytes.fromhex(r["leaf"]), path).hex() == r["root"] and r["verified"]
        assert merkle.fold(bytes(32), path).hex() != r["root"]


def test_many_tasks_and_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TASK_VERTICES", 5)
    rows = rows_of([("en", 600), ("de", 9)])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest(df) == brute(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force_and_sql(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    rows = [tuple(r) for r in spark.read.parquet(path).select(*NAMES).collect()]
    got = queries.queries()["op13_merkle_manifest"](spark, f"/root/testdata/{sf}").select(*COLUMNS).collect()
    got = sorted(map(tuple, got), key=lambda r: tuple(map(str, r)))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    assert sorted(con.execute(f"select {', '.join(COLUMNS)} from ({merkle.ORACLE_SQL})").fetchall(), key=lambda r: tuple(map(str, r))) == got


def test_sql_of_odd_rows():
    rows = [(None, None, None, None, None), (0, "A b", None, "", None), (3, None, "en", "x", 8), (12, "É Z", "en", "y", 8), *rows_of([("en", 30), ("de", 9)])]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(f"select {', '.join(COLUMNS)} from ({merkle.ORACLE_SQL})").fetchall(), key=lambda r: tuple(map(str, r))) == brute(rows)
