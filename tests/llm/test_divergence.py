from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from standscan.llm import divergence, queries

find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in find(text or "")]


def brute(rows, top=200):
    """Part, item, value and rank by plain dictionaries of Python's integers."""
    docs = [(lang or "", source or "", Counter(terms_of(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in mine for t in d[2]).items() if n >= 3}
        groups = {}
        for _, source, found in mine:
            own = groups.setdefault(source, Counter())
            own.update({t: n for t, n in found.items() if t in kept})
        whole = sum(groups.values(), Counter())
        v = len(kept)
        share = lambda counts, t: 1 + 1_000_000_000 * (counts[t] + 1) // (sum(counts.values()) + v)  # noqa: E731, B023
        p = {g: {t: share(c, t) for t in kept} for g, c in [*groups.items(), (None, whole)]}
        f = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // p[b][t]  # noqa: E731, B023
        for g in groups:
            pairs = [(o, sum(f(g, o, t) for t in kept)) for o in groups if o != g]
            best = [(t, f(g, None, t)) for t in kept if groups[g][t] and p[g][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", best)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, g, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def audit(df, **more):
    return sorted(tuple(r) for r in divergence.audit(df, **more).select(*COLUMNS).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def made(n_sources, n, seed, lang="en"):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "ÉTA", "éta", "the", "of", "x1y", "日本"] + [f"w{chr(97 + i)}" for i in range(20)]
    return [(" ".join(rng.choice(words, rng.integers(0, 30))) + "!" * int(rng.integers(0, 3)), lang, f"s{int(i)}") for i in rng.integers(0, n_sources, n)]


@pytest.mark.parametrize("n_sources", [1, 2, 3, 6, 7])
@pytest.mark.parametrize("settings", [{}, {"slice_terms": 5, "rounds": 1}])
def test_matches_brute_force(spark, n_sources, settings):
    rows = made(n_sources, 60, n_sources) + made(4, 30, 9, "de")
    assert audit(frame(spark, rows).repartition(3), **settings) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None), ("", "", "a"), (None, "en", "a"), ("one two", "en", "b"), ("one two", "en", "b"), ("one two", "en", "b"), ("two TWO tWo ", "en", "c"), ("123 ,. \n", "en", "d"),
        ("solo", "fr", None), ("solo solo", "fr", None), ("long " * 60_000 + "one", "en", "c"), ("long long", "en", "b"), ("long\x00one\x7fa_b", "en", "c"), ("rare", "it", "x"), ("other", "it", "y"),
    ]
    df = frame(spark, rows).withColumns({c: F.lit("odd") for c in ("t", "term", "n", "docs", "slice", "seat", "item", "value", "part", "rank", "total")})
    got = audit(df, slice_terms=2)
    assert got == brute(rows)
    assert ("it", "x", "pair", "y", 0, 1) in got
    assert divergence.audit(df.limit(0)).count() == 0


def test_counting_in_small_portions(spark):
    rows = made(3, 80, 5)
    got = {tuple(r[:3]): (r[3], r[4]) for r in divergence.term_counts(frame(spark, rows), held=7).collect()}
    want, docs = Counter(), Counter()
    for text, lang, source in rows:
        found = Counter(terms_of(text))
        want.update({(lang, source, t): n for t, n in found.items()})
        docs.update([(lang, source, t) for t in found] + [(lang, source, None)])
    assert {k: v for k, v in got.items() if k[2] is not None} == {k: (want[k], docs[k]) for k in want}
    assert {k: v[1] for k, v in got.items() if k[2] is None} == {k: n for k, n in docs.items() if k[2] is None}


def test_shares_of_large_counts():
    for total in (1, 2, 999, 10**9, 2**53 - 1):
        counts = np.array(sorted({0, total // 3, total // 2, total - 1}), "i8")
        assert divergence.share(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]
    p = np.array([10**9 + 1, 1, 5], "i8")
    assert divergence.gain(p, p[::-1].copy()).tolist() == [(a - b) ** 2 // b for a, b in zip(p.tolist(), p.tolist()[::-1], strict=True)]


@pytest.mark.parametrize("n", range(2, 12))
def test_every_pair_meets_once(spark, n):
    ring = n - 1 + n % 2
    df = spark.range(n).select(F.col("id").cast("int").alias("a")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(ring - 1))))
    met = df.select("a", "r", divergence.opponent(F.col("a"), F.lit(n), F.col("r")).alias("b")).where("b is not null").collect()
    assert sorted((x["a"], x["b"]) for x in met) == sorted((a, b) for a in range(n) for b in range(n) if a != b)
    assert {(x["a"], x["r"]) for x in met} >= {(x["b"], x["r"]) for x in met}


def test_cells_stay_in_their_partitions(spark):
    """A round exchanges the travelling vectors; the resident cells are read where they lie."""
    groups, cells = divergence.make_cells(divergence.term_counts(frame(spark, made(5, 60, 1))))
    seated = cells.select("lang", "slice", "seat").repartition(4, "lang", "slice", "seat").persist()
    guests = cells.select("lang", "slice", "seat", F.lit(1).alias("x"))
    plan = seated.join(guests.hint("merge"), ["lang", "slice", "seat"])._jdf.queryExecution().executedPlan().toString()
    seated.unpersist()
    initial = plan.split("InMemoryRelation")[0]
    assert initial.count("Exchange hashpartitioning") == 1


def test_query_equals_sql_and_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = sorted(tuple(r) for r in queries.queries()["op12_source_divergence"](spark, "/root/testdata/sf0.01").select(*COLUMNS).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    assert sorted(con.execute(f"select {', '.join(COLUMNS)} from ({divergence.ORACLE_SQL})").fetchall()) == got
    assert got == brute([tuple(r) for r in spark.read.parquet(path).select("text", "lang", "source").collect()])
