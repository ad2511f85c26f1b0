"""How far the sources of each language differ in their terms: chi-square terms, exactly, by a systolic rotation.

1. Terms are counted in tasks, each with a bounded table that is passed on when full, so that a
   hot group or term is aggregated before its shuffle. A language keeps the terms in at least
   ``min_docs`` of its documents.
2. The kept terms of a language are dealt by hash into slices of about ``slice_terms`` and numbered
   within. A cell is one (language, source) group in one slice: its counts become a compressed
   vector of the numbers and counts, and its best terms against the language are taken
   by a local heap of ``top_terms``. No task holds more than a slice of a group.
3. Cells are hash-partitioned by language, slice and seat, the group's number in its language,
   and stay where they are. In the rounds of a round-robin tournament each group meets every
   other one once: in round r, i meets j where i + j = r modulo the number of seats less one, and
   the last seat meets the one that would meet itself; an odd number of groups leaves a bye.
   One vector of each pair travels to the other's partition, alternately the lower and the upper
   seat, so a vector goes round all the others in the end. A meeting evaluates both directions.
   Rounds are independent jobs over written tables, ``rounds`` at a time: a lost executor
   costs one of them, not the history of a vector's travel.
4. The sums of the slices and the heaps' rows, at most ``top_terms`` a cell, are ranked by windows.

All arithmetic is on 64-bit integers: ``p = 1 + floor(1e9 * (count + 1) / (N + V))`` is divided in
three steps, so it is exact for N + V below 2**53, and ``(p - q) ** 2`` is below 2**60. A term that
neither group has adds the same value as every other one; these are counted, not listed.

Defined results: null text, language and source are ''. Terms are runs of ASCII letters and of
characters beyond ASCII; A to Z alone are lower-cased. Every occurring group has its ranks
among the sources of its language, also without terms (N = 0); if a language keeps no term, V
is 0 and all values are 0. A language of one source has no pairs. Ties are ranked by the item's
UTF-8 bytes. Repeated rows are documents of their own. Texts of any length are used whole. An
empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standscan.llm.batches import slices
from standscan.session import materialise, new_path

SCALE = 1_000_000_000
#: Bytes that end a term become spaces, A to Z become a to z; all bytes beyond ASCII stay.
SPELLING = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
MIN_DOCS, TOP_TERMS, SLICE_TERMS, ROUNDS, HELD = 3, 200, 1 << 14, 4, 400_000


# ---------------------------------------------------------------- counting


def _counter(held: int):
    """Partial ``(lang, source, term, n, docs)`` of a task, in portions of about ``held`` terms; null terms carry documents.

    A term's two counts are one integer, the documents above the occurrences.
    """
    one, mask = 1 << 40, (1 << 40) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[tuple, dict] = defaultdict(dict)
        size = 0

        def portion() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in counts.items():
                terms, values = list(own), list(own.values())
                for at in range(0, len(terms), 1 << 14):
                    part, both = terms[at : at + (1 << 14)], values[at : at + (1 << 14)]
                    columns = [pa.repeat(lang, len(part)), pa.repeat(source, len(part)), pa.array(part, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([v & mask for v in both], pa.int64()), pa.array([v >> 40 for v in both], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "t")), strict=True):
                own = counts[lang, source]
                get, before = own.get, len(own)
                for term, n in Counter(text.translate(SPELLING).split()).items():
                    own[term] = get(term, 0) + n + one
                own[None] = get(None, 0) + 1 + one
                size += len(own) - before
                if size >= held:
                    yield from portion()
                    counts.clear()
                    size = 0
        yield from portion()

    return run


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held: int = HELD) -> DataFrame:
    """``(lang, source, term, n, docs)``; the row of a null term has the number of the group's documents."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).cast("binary").alias("t"))
    parts = rows.mapInArrow(_counter(held), "lang string, source string, term binary, n bigint, docs bigint")
    return parts.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "docs").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- arithmetic


def share(count: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(1e9 * (count + 1) / total)`` of 64-bit integers, in three steps of a thousand."""
    rest, out = count + 1, np.zeros(len(count), "i8")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest %= total
    return out + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pack(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(numbers, prepend=0).astype("<u4").tobytes() + counts.astype("<i8").tobytes())


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(raw)
    n = len(body) // 12
    return np.cumsum(np.frombuffer(body, "<u4", n), dtype="i8"), np.frombuffer(body, "<i8", n, 4 * n)


def meeting(a: bytes, b: bytes, total_a: int, total_b: int, width: int) -> tuple[int, int]:
    """The sums of ``gain(p, q)`` over the ``width`` terms of a slice, from a to b and from b to a."""
    if not width:
        return 0, 0
    (numbers_a, counts_a), (numbers_b, counts_b) = _unpack(a), _unpack(b)
    both = np.union1d(numbers_a, numbers_b)
    spread = [np.zeros(len(both) + 1, "i8"), np.zeros(len(both) + 1, "i8")]  # the last one: a term of neither
    spread[0][np.searchsorted(both, numbers_a)] = counts_a
    spread[1][np.searchsorted(both, numbers_b)] = counts_b
    p, q = share(spread[0], total_a), share(spread[1], total_b)
    there, back = gain(p, q), gain(q, p)
    neither = width - len(both)
    return int(there[:-1].sum()) + neither * int(there[-1]), int(back[:-1].sum()) + neither * int(back[-1])


# ---------------------------------------------------------------- cells


CELLS = "lang string, seat int, slice int, width bigint, total bigint, vector binary, best array<struct<term: string, value: bigint>>"


def _cell_maker(top_terms: int):
    """A cell's vector, and its best terms against the language by a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            out = []
            lists = batch.column("terms")
            for i, row in enumerate(batch.drop_columns(["terms"]).to_pylist()):
                listed = lists[i].values if lists[i].is_valid else None
                best, numbers, counts = [], np.empty(0, "i8"), np.empty(0, "i8")
                if listed is not None:
                    numbers, counts, overall = (listed.field(c).to_numpy().astype("i8") for c in ("number", "n", "overall"))
                    p, q = share(counts, row["total"]), share(overall, row["lang_total"])
                    value, fit = gain(p, q), np.flatnonzero((p > q) & (counts > 0))
                    if len(fit) > top_terms:  # those below the last place are not looked at; all that tie for it are
                        fit = fit[value[fit] >= np.partition(value[fit], -top_terms)[-top_terms]]
                    words = listed.field("term").take(pa.array(fit)).to_pylist()
                    found = ((-int(v), t.encode()) for v, t in zip(value[fit], words, strict=True))
                    best = [{"term": t.decode(), "value": -v} for v, t in heapq.nsmallest(top_terms, found)]
                    order = np.argsort(numbers)
                    numbers, counts = numbers[order], counts[order]
                out.append({k: row[k] for k in ("lang", "seat", "slice", "width", "total")} | {"vector": _pack(numbers, counts), "best": best})
            yield pa.RecordBatch.from_pylist(out, CELL_SCHEMA)

    return run


CELL_SCHEMA = pa.schema(
    [("lang", pa.string()), ("seat", pa.int32()), ("slice", pa.int32()), ("width", pa.int64()), ("total", pa.int64()), ("vector", pa.binary()), ("best", pa.list_(pa.struct([("term", pa.string()), ("value", pa.int64())])))]
)


def make_cells(counts: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, slice_terms: int = SLICE_TERMS) -> tuple[DataFrame, DataFrame]:
    """``(groups, cells)`` of the counted terms: the seats of the groups, and their slices."""
    counts = materialise(counts, "divergence-counts")
    by_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("overall"), F.sum("docs").alias("docs"))
    kept = materialise(by_term.where(F.col("docs") >= min_docs).select("lang", "term", "overall"), "divergence-kept")
    langs = materialise(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("overall").alias("n")), "divergence-langs")
    sliced = kept.join(langs, "lang").select("lang", "term", "overall", (F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / slice_terms))).cast("int").alias("slice"))
    number = F.row_number().over(W.partitionBy("lang", "slice").orderBy("term")) - 1
    terms = materialise(sliced.withColumn("number", number), "divergence-terms")
    widths = terms.groupBy("lang", "slice").agg(F.count("*").alias("width"))
    mine = counts.where("term is not null").select("lang", "source", "term", "n").join(terms, ["lang", "term"])
    listed = mine.groupBy("lang", "source", "slice").agg(F.sum("n").alias("slice_n"), F.collect_list(F.struct("number", "term", "n", "overall")).alias("terms"))
    listed = materialise(listed, "divergence-listed")
    sums = listed.groupBy("lang", "source").agg(F.sum("slice_n").alias("n"))
    seat = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs.select("lang", "v", F.col("n").alias("lang_n")), "lang", "left")
    none = F.lit(0).cast("bigint")
    total = F.coalesce("n", none) + F.coalesce("v", none)
    groups = materialise(groups.select("lang", "source", seat.alias("seat"), total.alias("total"), (F.coalesce("lang_n", none) + F.coalesce("v", none)).alias("lang_total")), "divergence-groups")
    # A language without kept terms has one slice of no width, so that its groups meet as well.
    frame = groups.join(widths, "lang", "left").withColumns({"slice": F.coalesce("slice", F.lit(0)), "width": F.coalesce("width", none)})
    rows = frame.join(listed, ["lang", "source", "slice"], "left").select("lang", "seat", "slice", "width", "total", "lang_total", "terms")
    return groups, materialise(rows.mapInArrow(_cell_maker(top_terms), CELLS), "divergence-cells")


# ---------------------------------------------------------------- tournament


def opponent(seat: Column, seats: Column, rnd: Column) -> Column:
    """Whom a seat meets in a round of the tournament; null for a bye.

    ``ring`` seats, an odd number, rotate; with an even number of groups the last one meets
    the seat that would meet itself.
    """
    ring = seats - 1 + seats % 2
    facing = F.pmod(rnd - seat, ring)
    fixed = F.when(seats % 2 == 0, ring)
    alone = F.pmod(rnd * F.floor((ring + 1) / 2), ring)  # twice this seat is the round, modulo the ring
    return F.when(seat >= ring, alone).otherwise(F.when(facing == seat, fixed).otherwise(facing)).cast("int")


def _host(seat: Column, other: Column) -> Column:
    """The seat of the pair whose cell stays: the lower one if the seats' sum is even, else the upper one."""
    return F.when((seat + other) % 2 == 0, F.least(seat, other)).otherwise(F.greatest(seat, other))


SUMS = "lang string, here int, there int, here_value bigint, there_value bigint"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        rows = batch.to_pylist()
        values = [meeting(r["vector"], r["guest"], r["total"], r["guest_total"], r["width"]) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("seat"), batch.column("guest_seat"), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())],
            names=["lang", "here", "there", "here_value", "there_value"],
        )


def tournament(groups: DataFrame, cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(lang, seat, other, value)`` of every ordered pair of seats of a language."""
    spark = cells.sparkSession
    sizes = groups.groupBy("lang").agg(F.max("seat").alias("last")).select("lang", (F.col("last") + 1).alias("seats"))
    most = sizes.agg(F.max("seats")).first()[0] or 0
    path = new_path(spark, "divergence-rounds")
    spark.createDataFrame([], SUMS).write.parquet(path)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, so that the partitioning is known and no round deals the cells anew
    seated = cells.select("lang", "slice", "seat", "width", "total", "vector").repartition(tasks, "lang", "slice", "seat").persist(StorageLevel.DISK_ONLY)
    travellers = cells.select("lang", "slice", "seat", "total", "vector").join(sizes.where("seats > 1"), "lang")
    count = most - 1 + most % 2 if most > 1 else 0
    for first in range(0, count, rounds):
        turn = F.explode(F.sequence(F.lit(first), F.lit(min(first + rounds, count) - 1)))
        met = travellers.withColumn("round", turn).where(F.col("round") < F.col("seats") - 1 + F.col("seats") % 2)
        met = met.withColumn("other", opponent(F.col("seat"), F.col("seats"), F.col("round"))).where(_host(F.col("seat"), F.col("other")) == F.col("other"))
        guests = met.select("lang", "slice", F.col("other").alias("seat"), F.col("seat").alias("guest_seat"), F.col("total").alias("guest_total"), F.col("vector").alias("guest"))
        pairs = seated.join(guests.hint("merge"), ["lang", "slice", "seat"]).select("lang", "seat", "guest_seat", "width", "total", "guest_total", "vector", "guest")
        pairs.mapInArrow(_meet, SUMS).groupBy("lang", "here", "there").agg(F.sum("here_value").alias("here_value"), F.sum("there_value").alias("there_value")).write.mode("append").parquet(path)
    seated.unpersist()
    done = spark.read.schema(SUMS).parquet(path)
    there = done.select("lang", F.col("here").alias("seat"), F.col("there").alias("other"), F.col("here_value").alias("value"))
    back = done.select("lang", F.col("there").alias("seat"), F.col("here").alias("other"), F.col("there_value").alias("value"))
    return there.unionByName(back)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, slice_terms: int = SLICE_TERMS, rounds: int = ROUNDS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: other sources by divergence, and the terms that set a source apart."""
    groups, cells = make_cells(term_counts(docs, text, lang, source), min_docs, top_terms, slice_terms)
    met = tournament(groups, cells, rounds)
    names = groups.select("lang", "seat", "source")
    items = names.select("lang", F.col("seat").alias("other"), F.col("source").alias("item"))
    pairs = met.join(names, ["lang", "seat"]).join(items, ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    found = cells.select("lang", "seat", F.explode("best").alias("b")).join(names, ["lang", "seat"])
    terms = found.select("lang", "source", F.lit("term").alias("part"), F.col("b.term").alias("item"), F.col("b.value").alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= top_terms))


#: The same result in DuckDB SQL.
ORACLE_SQL = r"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*)::hugeint as n from w group by lang, term having count(distinct i) >= 3),
langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by lang),
own as (select lang, source, term, count(*)::hugeint as n from w semi join kept using (lang, term) group by lang, source, term),
groups as (select lang, source, coalesce(langs.v, 0) as v, coalesce(s.n, 0)::hugeint as n
           from (select distinct lang, source from d) left join langs using (lang)
           left join (select lang, source, sum(n) as n from own group by lang, source) s using (lang, source)),
p as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n, 1 + (1000000000 * (coalesce(o.n, 0) + 1)) // (g.n + g.v) as p
      from groups g join kept k using (lang) left join own o using (lang, source, term)),
pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
         from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pair.value, 0)::bigint as value
          from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
q as (select lang, term, 1 + (1000000000 * (kept.n + 1)) // (langs.n + langs.v) as q from kept join langs using (lang)),
terms as (select p.lang, p.source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p join q using (lang, term) where p.n > 0 and p > q)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from pairs
union all
select * from (select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from terms) where rank <= 200
"""
