"""Mixing sources to target weights by iterative proportional fitting.

Token counts are aggregated to cells (source, language, topic). Factors for each source,
language and topic are raked until the expected sampled tokens meet the three target
marginals: the probability of a cell is ``min(1, a[source] * b[language] * c[topic])``.
Every document is then kept with the probability of its cell, by comparing a hash of its id
with it, so the same documents are drawn again on each run.

Only the aggregated cells reach the driver, all of them: every category is raked by itself.
A caller may give ``max_categories``; then each dimension has that many named categories,
those with the most tokens, and the rest share one category ``(rest)`` whose target is the
sum of theirs.

Defined results: null categories are the category ``(null)``. Texts without tokens take
the probability of their cell. Null ids are drawn by the hash of the text. An empty table
gives an empty result. A target that a category cannot fill is lowered to what it has and
the excess goes to the others in proportion.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standscan.llm.columns import numbered, restored
from standscan.session import materialise

NULL, REST = "(null)", "(rest)"
DIMENSIONS = ("source", "lang", "topic")
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Plan:
    """Raked factors by dimension and category, and how far the marginals are met."""

    factors: dict[str, dict[str, float]]
    worst_error: float
    rounds: int
    unmet: dict[str, dict[str, float]] = field(default_factory=dict)


def token_count(text: str = "text") -> Column:
    """White-space words of a text."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def topic_of(text: str = "text") -> Column:
    """A coarse topic from markers in the whole text, for tables without a topic column.

    A cheap test of a character that the marker needs goes before each pattern.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has = lambda part: F.contains(t, F.lit(part))
    return (
        F.when(t.rlike(r"(?i)\blicen[sc]ed?\b|\bcopyright\b"), "legal")
        .when(has("@") & t.rlike(r"[\w.]@[\w.]") | has("(") & t.rlike(r"\(\d{3}\) \d{3}-\d{4}") | has(".") & t.rlike(r"\b\d{1,3}(\.\d{1,3}){3}\b"), "contact")
        .when((has("=") | has(":")) & t.rlike(r"(?i)\b(token|key|secret|password) ?[=:]"), "technical")
        .otherwise("general")
    )


def _fill(shares: np.ndarray, room: np.ndarray, budget: float) -> np.ndarray:
    """Targets of ``shares * budget``, none above its room, the excess spread over the others."""
    target = np.zeros(len(shares))
    free = shares > 0
    left = min(budget, float(room[free].sum()))
    while left > 1e-9 * max(budget, 1) and free.any():
        add = left * shares[free] / shares[free].sum()
        target[free] = np.minimum(target[free] + add, room[free])
        free &= target < room * (1 - 1e-12)
        left = min(budget, float(room[shares > 0].sum())) - target.sum()
    return target


def rake(index: list[np.ndarray], tokens: np.ndarray, shares: list[np.ndarray], budget: float, max_rounds: int = 500, tolerance: float = 1e-6) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Factors and relative errors of the marginals for each dimension, and the rounds taken."""
    targets = [_fill(s, np.bincount(i, tokens, len(s)), budget) for i, s in zip(index, shares, strict=True)]
    factors = [np.ones(len(s)) for s in shares]
    factors[0] *= budget / max(float(tokens.sum()), 1.0)
    chance = lambda: np.minimum(1.0, np.prod([f[i] for f, i in zip(factors, index, strict=True)], axis=0))
    errors, rounds = [np.zeros(len(w)) for w in targets], 0
    for rounds in range(1, max_rounds + 1):
        for f, i, want in zip(factors, index, targets, strict=True):
            have = np.bincount(i, tokens * chance(), len(f))
            f *= np.clip(np.divide(want, have, out=np.ones_like(want), where=have > 0), 0, 1e6)
            np.clip(f, 0, 1e9, out=f)
        p = chance()
        errors = [np.abs(np.bincount(i, tokens * p, len(w)) - w) / np.maximum(w, 1.0) for i, w in zip(index, targets, strict=True)]
        if max(float(e.max(initial=0.0)) for e in errors) < tolerance:
            break
    return factors, errors, rounds


def _named(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(NULL))


def make_plan(weighted: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.5, keep_share: float = 0.5, max_categories: tuple[int, int, int] | None = None, max_error: float = 0.02, strict: bool = False) -> Plan:
    """Rake a table (source, lang, topic, n_tokens).

    ``targets`` gives shares by dimension and category; a dimension without them takes the
    observed shares to the power ``temper``. ``keep_share`` of all tokens are to be drawn.
    Marginals that stay more than ``max_error`` from their targets, as some targets exclude
    each other, are named in a warning, or in a ValueError if ``strict``.
    """
    targets = targets or {}
    cells = weighted.select(*[_named(d).alias(d) for d in DIMENSIONS], "n_tokens").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n"))
    rest = dict.fromkeys(DIMENSIONS, 0.0)
    for d, most in zip(DIMENSIONS, max_categories or (), strict=False):
        totals = cells.groupBy(d).agg(F.sum("n").alias("ss_n"))
        top = totals.orderBy(F.desc("ss_n"), d).limit(most).select(d, F.lit(True).alias("ss_in"))
        merged = totals.join(F.broadcast(top), d, "left_anti")
        if targets.get(d):
            rest[d] = sum(targets[d][r[d]] for r in merged.where(F.col(d).isin(list(targets[d]))).select(d).collect())
        else:
            rest[d] = merged.agg(F.sum(F.pow(F.col("ss_n").cast("double"), F.lit(temper)))).first()[0] or 0.0
        cells = cells.join(F.broadcast(top), d, "left").withColumn(d, F.when(F.col("ss_in"), F.col(d)).otherwise(REST)).drop("ss_in")
    rows = cells.groupBy(*DIMENSIONS).agg(F.sum("n").alias("n")).toPandas()
    tokens = rows["n"].to_numpy("f8")
    names, index, shares = [], [], []
    for d in DIMENSIONS:
        cats, i = np.unique(rows[d].to_numpy(str) if len(rows) else np.empty(0, "U1"), return_inverse=True)
        have = np.bincount(i, tokens, len(cats))
        given = targets.get(d)
        s = np.array([given.get(c, 0.0) for c in cats]) if given else np.power(have, temper)
        if rest[d]:
            s[cats == REST] = rest[d]
        names.append(cats.tolist())
        index.append(i)
        shares.append(s / s.sum() if s.sum() > 0 else s)
    if not len(rows):
        return Plan({d: {} for d in DIMENSIONS}, 0.0, 0)
    factors, errors, rounds = rake(index, tokens, shares, keep_share * float(tokens.sum()))
    unmet = {d: {c: float(e[k]) for k, c in enumerate(n) if e[k] > max_error} for d, n, e in zip(DIMENSIONS, names, errors, strict=True)}
    if any(unmet.values()):
        said = "targets not met, as relative errors: " + ", ".join(f"{d} {c} {e:.3f}" for d in DIMENSIONS for c, e in sorted(unmet[d].items(), key=lambda x: -x[1])[:5])
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    worst = max(float(e.max(initial=0.0)) for e in errors)
    return Plan({d: dict(zip(n, f.tolist(), strict=True)) for d, n, f in zip(DIMENSIONS, names, factors, strict=True)}, worst, rounds, unmet)


def probability(df: DataFrame, plan: Plan, columns: dict[str, Column], out: str) -> DataFrame:
    """Append the calibrated probability, from one small factor table per dimension."""
    spark = df.sparkSession
    for k, d in enumerate(DIMENSIONS):
        rows = [(c, float(v)) for c, v in plan.factors[d].items()]
        table = spark.createDataFrame(rows, f"ss_c{k} string, ss_f{k} double")
        rest = plan.factors[d].get(REST, 0.0)
        df = df.withColumn(f"ss_k{k}", F.coalesce(columns[d].cast("string"), F.lit(NULL)))
        df = df.join(F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table, F.col(f"ss_k{k}") == F.col(f"ss_c{k}"), "left").withColumn(f"ss_f{k}", F.coalesce(f"ss_f{k}", F.lit(rest)))
    p = F.least(F.lit(1.0), F.col("ss_f0") * F.col("ss_f1") * F.col("ss_f2"))
    return df.withColumn(out, p).drop(*[f"ss_{x}{k}" for x in "ckf" for k in range(len(DIMENSIONS))])


def draw(id_col: str, text: str, seed: int) -> Column:
    """A number in [0, 1) fixed by the row's id (by its text if the id is null)."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text), F.lit(""))))
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _topic(text: str, topic: str | None) -> Column:
    return topic_of(text) if topic is None else F.col(topic)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.5, keep_share: float = 0.5, seed: int = 17, id_col: str = "doc_id", text: str = "text", topic: str | None = None, strict: bool = False) -> DataFrame:
    """``(id, source, lang, topic, n_tokens, probability, sampled)`` for every row.

    ``topic`` names a column of topics; without one the topics are those of :func:`topic_of`.
    """
    own = docs.select(
        F.col(id_col).alias(id_col), "source", "lang", _topic(text, topic).alias("topic"), token_count(text).alias("n_tokens"), draw(id_col, text, seed).alias("ss_u")
    )
    own = materialise(own, "mixing-weights")
    plan = make_plan(own, targets, temper, keep_share, strict=strict)
    out = probability(own, plan, {d: F.col(d) for d in DIMENSIONS}, "probability")
    return out.withColumn("sampled", F.col("ss_u") < F.col("probability")).drop("ss_u")


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.5, keep_share: float = 0.5, seed: int = 17, id_col: str = "doc_id", text: str = "text", topic: str | None = None, strict: bool = False) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns, whatever their names."""
    docs, own = numbered(docs)
    id_col, text = own[id_col], own[text]
    columns = {"source": F.col(own["source"]), "lang": F.col(own["lang"]), "topic": _topic(text, own[topic] if topic else None)}
    plan = make_plan(docs.select(*[c.alias(d) for d, c in columns.items()], token_count(text).alias("n_tokens")), targets, temper, keep_share, strict=strict)
    out = probability(docs, plan, columns, "ss_p")
    return restored(out.where(draw(id_col, text, seed) < F.col("ss_p")), own)
