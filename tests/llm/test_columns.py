"""Columns of any name pass through the pipeline's filtering stages with their values."""

from __future__ import annotations

import pathlib
import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
import standscan.llm as llm

CALM = "the river is under the stone house and the tree with a wide path of green grass by it that was here for long"


def working_names():
    """The working names in the sources, and some names of results."""
    found = set()
    for folder in (pathlib.Path(llm.__file__).parent, pathlib.Path(llm.__file__).parent.parent / "operators"):
        for path in folder.glob("*.py"):
            found |= set(re.findall(r"\bss_\w+", path.read_text()))
    for known in ("ss_k", "ss_key", "ss_page", "ss_bits", "ss_rep", "ss_twice", "ss_p", "ss_k0", "ss_id", "node", "head", "key", "links", "component", "quality", "score", "predicted", "topic", "n_tokens", "probability", "kept", "n_words", "k", "t", "o", "y"):
        found.add(known)
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars"})


def test_clashing_columns_keep_their_values(spark, tmp_path):
    names = [*working_names(), "a.b", "back`tick", "two words", "c0", "c7"]
    assert len(names) > 60
    texts = [CALM, CALM, CALM + " again and more", "another stone under a wide green tree is by the river that was the long path of a house", None, "## buy"]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *[F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")).alias(n) for k, n in enumerate(names)])
    spark.createDataFrame([(0, 1), (1, 1), (3, 1), (5, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in cp.STAGES[1:4]:
        left = stage(spark, df, str(tmp_path))
        assert left.columns == df.columns, name
        got = [r.asDict() for r in left.collect()]
        assert got, name
        for r in got:
            assert r["text"] == texts[r["doc_id"]]
            assert all(r[n] == f"{k}:{r['doc_id']}" for k, n in enumerate(names)), name
    scored = cp.STAGES[0][1](spark, df, str(tmp_path))
    assert scored.columns == df.columns
    for r in scored.collect():
        assert all(r[n] == f"{k}:{r['doc_id']}" for k, n in enumerate(names))
    kept = {r["doc_id"] for r in cp.STAGES[2][1](spark, df, str(tmp_path)).select("doc_id").collect()}
    assert 3 in kept and 4 in kept and 5 in kept and len(kept & {0, 1}) == 1
