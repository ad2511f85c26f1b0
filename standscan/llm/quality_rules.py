"""Quality rules: one threshold table compiled into one Spark projection.

Every statistic is a built-in expression over one row, so the operator is a narrow
map over the scan: no shuffle, no Python, no state between rows.

Defined results: a null or empty text has no words and fails the base rule; a text of
white space alone likewise. Ratios of a text without words are 0. Extra columns of the
input are never read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]"
SEPARATOR = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a and are as at be by for from have he in is it not of on or that the this to was were which with you "
    "das dem den der des die ein eine ist mit nicht und von zu auf im sich als auch "
    "avec ce dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "al como con del el es las lo los no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text whose ``metric`` lies in ``[low, high]``; None leaves that end open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: metric -> SQL over the statistics columns.
METRICS = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "stop_word_ratio": "n_stop / greatest(n_words, 1)",
}

#: The production table.
RULES = (
    Rule("enough_words", "n_words", low=10),
    Rule("word_length", "mean_word_chars", low=2, high=12),
    Rule("few_symbols", "symbol_ratio", high=0.2),
    Rule("not_shouted", "upper_ratio", high=0.4),
    Rule("few_repeated_lines", "dup_line_ratio", high=0.3),
    Rule("has_stop_words", "stop_word_ratio", low=0.04),
)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The conjunction of all rules as one boolean column over the statistics."""
    verdict = F.lit(True)
    for rule in rules:
        value = F.expr(METRICS[rule.metric]).cast("double")
        if rule.low is not None:
            verdict = verdict & (value >= F.lit(float(rule.low)))
        if rule.high is not None:
            verdict = verdict & (value <= F.lit(float(rule.high)))
    return verdict


def _repeated_words() -> Column:
    """Words covered by windows that occur twice or more, from the sorted window hashes.

    ``ss_order`` holds (hash, position) sorted; a window repeats if a neighbour in that
    order has the same hash and the same words. Covered words are then counted from the
    gaps between the sorted positions.
    """
    same = lambda a, b: (a.k == b.k) & (F.slice("ss_w", a.i + 1, WINDOW) == F.slice("ss_w", b.i + 1, WINDOW))
    hits = F.filter(
        "ss_order",
        lambda x, j: F.coalesce(same(x, F.get(F.col("ss_order"), j - 1)), F.lit(False))
        | F.coalesce(same(x, F.get(F.col("ss_order"), j + 1)), F.lit(False)),
    )
    return F.array_sort(F.transform(hits, lambda x: x.i))


def add_statistics(texts: DataFrame, text: str = "text") -> DataFrame:
    """Append the base statistics to ``texts``, with working columns prefixed ``ss_``."""
    df = texts.withColumn("ss_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("ss_w", F.array_remove(F.split("ss_t", SEPARATOR), ""))
    df = df.withColumn("ss_lines", F.filter(F.split("ss_t", "\n"), lambda s: s.rlike(WORD)))
    n = F.size("ss_w")
    df = df.withColumn(
        "ss_h",
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("ss_w"), i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        "ss_order",
        F.when(
            F.size(F.array_distinct("ss_h")) < F.size("ss_h"),
            F.array_sort(F.transform("ss_h", lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<k:bigint,i:int>>")),
    )
    df = df.withColumn("ss_p", _repeated_words())
    covered = F.aggregate(
        F.transform("ss_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("ss_p"), j + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    joined = F.array_join("ss_w", "")
    return df.withColumns(
        {
            "n_words": n.cast("bigint"),
            "word_chars": F.char_length(joined).cast("bigint"),
            "n_symbols": F.regexp_count("ss_t", F.lit(SYMBOLS)).cast("bigint"),
            "n_dup_lines": (F.size("ss_lines") - F.size(F.array_distinct("ss_lines"))).cast("bigint"),
            "n_repeat_words": covered,
            "n_lines": F.size("ss_lines").cast("bigint"),
            "n_upper": F.char_length(F.regexp_replace(joined, r"[^\p{Lu}]+", "")).cast("bigint"),
            "n_stop": F.size(F.filter("ss_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint"),
        }
    )


def judge(texts: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id, the statistics, ``base_failed`` and ``kept``.

    ``keep`` names further input columns to carry along.
    """
    own = "ss_text"
    df = texts.select(F.col(id_col).alias("ss_id"), F.col(text).alias(own), *[F.col(c).alias(f"ss_in_{i}") for i, c in enumerate(keep)])
    df = add_statistics(df, own)
    # Always true, but not deterministic: it keeps a later filter on ``kept`` from being pushed
    # below the projections, where the nested statistics would be written out many times over.
    fence = F.monotonically_increasing_id() >= 0
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.select(
        F.col("ss_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & compile_rules(rules) & fence).alias("kept"),
        *[F.col(f"ss_in_{i}").alias(c) for i, c in enumerate(keep)],
    )


def _sql_verdict(rules: tuple[Rule, ...]) -> str:
    parts = []
    for rule in rules:
        value = f"cast({METRICS[rule.metric]} as double)"
        parts += [f"{value} >= {rule.low}"] * (rule.low is not None) + [f"{value} <= {rule.high}"] * (rule.high is not None)
    return " and ".join(parts)


#: The same result in DuckDB SQL.
ORACLE_SQL = rf"""
with a as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
win as (
  select doc_id, i, array_to_string(w[i:i+4], ' ') as k
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from a)),
hit as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from win) where c > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from hit) group by doc_id),
s as (
  select a.doc_id, len(w)::bigint as n_words,
         length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(rep.n, 0)::bigint as n_repeat_words,
         len(ls)::bigint as n_lines,
         length(regexp_replace(array_to_string(w, ''), '[^\p{{Lu}}]+', '', 'g'))::bigint as n_upper,
         len(list_filter(w, lambda x: lower(x) in ({", ".join(f"'{w}'" for w in STOP_WORDS)})))::bigint as n_stop
  from a left join rep using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and {_sql_verdict(RULES)}) as kept
from s
"""
