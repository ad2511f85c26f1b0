"""A corpus pipeline of five operators: classify, rule out, deduplicate, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns the next one's documents. Stages are
written as Parquet in between, which cuts the lineage.

Defined results, for all stages: an empty table gives an empty one. Extra columns of the
documents are carried along, whatever their names, up to the last stage. Repeated rows are
judged alike; the join keeps one of them. Null and empty texts are scored by the classifier's
bias, fail the rules and so end there. Rows with a null id are judged by their text. Texts of
any length are used whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standscan.llm import bpe, classifier, jaccard, mixing, quality_rules
from standscan.llm.batches import small_batches
from standscan.llm.columns import numbered, restored
from standscan.llm.queries import VOCABULARY, fold
from standscan.session import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier scores below its cut."""
    small_batches(spark)
    model = classifier.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    named, own = numbered(docs)
    rest = {n: F.col(n) for c, n in own.items() if c != "doc_id"}
    scored = classifier.score(named, model, id_col=own["doc_id"], text=own["text"], extra=rest)
    return restored(scored.where("predicted = 1"), own)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rule table rejects."""
    named, own = numbered(docs)
    judged = quality_rules.judge(named, id_col=own["doc_id"], text=own["text"], keep=tuple(n for c, n in own.items() if c != "doc_id"))
    return restored(judged.where("kept"), own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    small_batches(spark)
    return jaccard.one_per_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents to the tempered weights of sources, languages and topics."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining documents, and their digests after decoding."""
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mix),
    ("byte-level BPE", encode),
]

#: The stages hash, train and rake; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
