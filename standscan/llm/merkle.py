"""A Merkle manifest of a table: a tree of digests per group, one root over the groups, a proof per row.

Leaves are SHA-256 digests of a row's fields, made by Spark's own functions. The leaves of a
group are numbered in the order of their ids over range partitions, so a large group is spread
over tasks. The trees are built and checked by supersteps over RDDs of vertices. A vertex is known
by its group, its place at its level of the group's tree, and how many the level has:

- Upward, each vertex sends its parent its place and digest. Parents have at most ``FAN`` children
  each; once the messages have come together, a parent is complete, hashes them in order and is a
  vertex of the next superstep. A vertex alone at its level is its group's subroot; the
  subroots are the lowest vertices of the upper tree, whose last one is the root.
- Downward, each parent sends its children the path above it, with their siblings in front.
  The last to receive one are the runs of leaves, which fold each row's leaf, tampered or
  not, up the path and compare what comes out with the root.

Leaves meet in their runs once, upward; paths travel down to the runs only, an eighth of
the rows. A superstep's result is checkpointed in the shared folder, so a lost executor costs a
superstep and lineage stays short. The driver sees two numbers: rows and groups of the table.

Defined results: null fields count as ``-``, others as the number of their UTF-8 bytes, ``:``
and the value. A null group comes before all others, which are ordered by their UTF-8 bytes. A
null id comes first; rows that share an id are ordered by their leaves, and equal rows are
leaves of their own. A lone row's leaf is its group's subroot, and a lone group's subroot is the
root. A proof without siblings is the digest of nothing. Texts of any length are used whole. An
empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

from pyspark import RDD, StorageLevel
from pyspark.shuffle import Aggregator, ExternalMerger
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standscan.operators.order import running_total
from standscan.session import materialise, shared_dir

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TASK_VERTICES = 20_000
UPPER = -1  # the group of the upper tree's vertices


# ---------------------------------------------------------------- leaves


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields, each with its size in front."""
    texts = [c.cast("string") for c in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256))


def lowered(col: str) -> Column:
    """The column with A to Z alone in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(col), upper, upper.lower())


def numbered_leaves(docs: DataFrame, id_col: str, group: str, fields: Sequence[str], tampered: dict[str, Column], tamper: Column) -> tuple[DataFrame, DataFrame]:
    """``(k, gid, place, n, leaf, shown)`` of every row, ``shown`` being the leaf to verify, and the groups."""
    made = leaf([F.col(c) for c in fields])
    shown = F.when(tamper, leaf([tampered.get(c, F.col(c)) for c in fields])).otherwise(made)
    # The number tells equal rows apart, so that they may be dealt to several tasks; it is fixed by the written table.
    rows = docs.select(F.col(id_col).alias("k"), F.col(group).alias("g"), made.alias("leaf"), shown.alias("shown"), F.monotonically_increasing_id().alias("u"))
    rows = materialise(running_total(materialise(rows, "merkle-leaves"), ("g", "k", "leaf", "u"), F.lit(1).cast("bigint"), "at"), "merkle-order")
    sizes = rows.groupBy("g").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # One row a group.
    groups = materialise(sizes.withColumn("gid", F.row_number().over(W.orderBy(F.col("g").asc_nulls_first())) - 1), "merkle-groups")
    joined = rows.join(groups.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")))
    return joined.select("k", "gid", (F.col("at") - F.col("first")).alias("place"), "n", "leaf", "shown"), groups


# ---------------------------------------------------------------- supersteps


def digest(parts: Sequence[bytes]) -> bytes:
    """A parent's digest: SHA-256 of its children's, written in hexadecimal."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def _above(n: int) -> int:
    return -(-n // FAN)


class Supersteps:
    """Pregel-style rounds over vertices ``((group, place, number at the level), state)``."""

    def __init__(self, spark: SparkSession, most_tasks: int) -> None:
        self.most_tasks = most_tasks
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_dir(spark))

    def tasks(self, vertices: int) -> int:
        return max(1, min(self.most_tasks, -(-vertices // TASK_VERTICES)))

    @staticmethod
    def kept(rdd: RDD) -> RDD:
        """Run a superstep and checkpoint its result; the copy on the executors' disks serves the checkpoint only."""
        rdd.persist(StorageLevel.DISK_ONLY)
        rdd.checkpoint()
        rdd.count()
        rdd.unpersist()
        return rdd

    @staticmethod
    def gathered(messages: RDD, tasks: int) -> RDD:
        """``(receiver, [messages])``, in as many tasks as stated; a task's messages spill to disk beyond a few hundred MB."""

        def collect(part: Iterator[tuple]) -> Iterator[tuple]:
            merger = ExternalMerger(Aggregator(lambda m: [m], lambda held, m: held.append(m) or held, lambda held, more: held + more), 256)
            merger.mergeValues(part)
            return merger.items()

        return messages.partitionBy(tasks).coalesce(tasks).mapPartitions(collect)

    def met(self, vertices: RDD, states: RDD, tasks: int) -> RDD:
        """``(key, (vertex, state))`` of the vertices, one message each from both sides."""
        both = vertices.mapValues(lambda v: (0, v)).union(states.mapValues(lambda s: (1, s)))
        return self.gathered(both, tasks).filter(lambda x: len(x[1]) == 2).mapValues(lambda m: tuple(x[1] for x in sorted(m, key=lambda x: x[0])))

    def climb(self, vertices: RDD, rows: int, largest: int) -> tuple[list[RDD], list[RDD]]:
        """``(families, tops)`` by level: ``(parent's key, (n, children's digests))``, and the vertices alone at a level.

        ``rows`` vertices in all, of at most ``largest`` a group.
        """
        families, tops = [], []
        while largest > 1:
            tops.append(vertices.filter(lambda v: v[0][2] == 1))
            sent = vertices.filter(lambda v: v[0][2] > 1).map(lambda v: ((v[0][0], v[0][1] // FAN, _above(v[0][2])), (v[0][1], v[0][2], v[1])))
            rows, largest = _above(rows) + 1, _above(largest)
            together = self.gathered(sent, self.tasks(rows)).mapValues(sorted).mapValues(lambda c: (c[0][1], [x[2] for x in c]))
            families.append(self.kept(together))
            vertices = families[-1].mapValues(lambda family: digest(family[1]))
        return families, [*tops, vertices]

    def descend(self, families: list[RDD], starts: list[RDD]) -> RDD:
        """``(key, state)`` of the lowest vertices, from the ``starts``, the states of the tops by level.

        A state is ``(path, rest)``. A path's steps, from below, are ``(place in the run, siblings)``.
        """

        def send(message: tuple) -> Iterator[tuple]:
            (group, place, _), ((n, digests), (path, rest)) = message
            for at in range(len(digests)):
                yield (group, place * FAN + at, n), (((at, tuple(digests[:at] + digests[at + 1 :])), *path), rest)

        states = starts[-1]
        for below, start in zip(reversed(families), reversed(starts[:-1]), strict=True):
            tasks = below.getNumPartitions()
            states = self.kept(self.met(below, states, tasks).flatMap(send).union(start))
        return states


def fold(shown: bytes, path: Sequence[tuple[int, Sequence[bytes]]]) -> bytes:
    """The root that a leaf's digest leads to, up a path of ``(place, siblings)``."""
    for at, siblings in path:
        shown = digest([*siblings[:at], shown, *siblings[at:]])
    return shown


def _verify(message: tuple) -> Iterator[tuple]:
    """A run's rows, judged: ``(k, leaf, subroot, root, proof, folded, verified, path)``."""
    (lone, members), (path, (subroot, root)) = message
    digests = [m[1] for m in members]
    above = "".join(s.hex() for _, siblings in path for s in siblings)
    whole = fold(digests[0] if lone else digest(digests), path)
    for at, (_, own, shown, k) in enumerate(members):
        siblings = digests[:at] + digests[at + 1 :]
        steps = path if lone else ((at, tuple(siblings)), *path)
        folded = whole if shown == own else fold(shown, steps)
        proof = sha256(("".join(s.hex() for s in siblings) + above).encode()).digest()
        yield k, own, subroot, root, proof, folded, folded == root, steps


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group: str = "lang",
    fields: Sequence[str] = FIELDS,
    tampered: dict[str, Column] | None = None,
    tamper: Column | None = None,
    paths: bool = False,
) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row, digests in hexadecimal.

    Rows that ``tamper`` marks are verified with the fields that ``tampered`` replaces. ``paths``
    adds the proofs themselves, steps of ``(place, siblings)`` from the leaf to the root.
    """
    spark = docs.sparkSession
    rows, groups = numbered_leaves(docs, id_col, group, fields, tampered or {}, F.lit(False) if tamper is None else tamper)
    sizes = groups.agg(F.count("*").alias("g"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    kind = docs.schema[id_col].dataType
    steps = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("siblings", T.ArrayType(T.BinaryType()))]))
    binary = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType([T.StructField("k", kind), *[T.StructField(c, T.BinaryType()) for c in binary], T.StructField("verified", T.BooleanType()), *([T.StructField("path", steps)] if paths else [])])
    if not sizes["g"]:
        judged = spark.createDataFrame([], schema)
    else:
        run = Supersteps(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
        total, number, most = sizes["rows"], sizes["g"], sizes["most"]
        # The first superstep: leaves, with what is to be verified, meet in runs.
        sent = rows.rdd.map(lambda r: ((r["gid"], r["place"] // FAN, _above(r["n"])), (r["place"], bytes(r["leaf"]), bytes(r["shown"]), r["k"], r["n"] == 1)))
        runs = run.gathered(sent, run.tasks(total)).mapValues(lambda m: sorted(m, key=lambda x: x[0])).mapValues(lambda m: (m[0][4], [x[:4] for x in m]))
        runs = run.kept(runs)
        own = runs.mapValues(lambda r: r[1][0][1] if r[0] else digest([m[1] for m in r[1]]))
        families, tops = run.climb(own, _above(total) + number, _above(most))
        # The upper tree's lowest vertices are the subroots, whatever the height of their trees.
        subroots = [top.map(lambda v: ((UPPER, v[0][0], number), v[1])) for top in tops]
        upper, ends = run.climb(run.kept(spark.sparkContext.union(subroots)), number, number)
        ends = [end.map(lambda v: (v[0], ((), v[1]))) for end in ends]
        above = run.descend(upper, ends).map(lambda v: (v[0][1], v[1]))
        tagged = spark.sparkContext.union([top.map(lambda v, level=level: (v[0][0], (level, v[0], v[1]))) for level, top in enumerate(tops)])
        # By group: (level of its top, key of the top, (path above, (subroot, root))).
        begun = run.kept(run.met(tagged, above, run.tasks(number)).mapValues(lambda x: (x[0][0], x[0][1], (x[1][0], (x[0][2], x[1][1])))).values())
        starts = [begun.filter(lambda x, level=level: x[0] == level).map(lambda x: x[1:]) for level in range(len(tops))]
        states = run.descend(families, starts)
        cut = None if paths else -1
        judged = spark.createDataFrame(run.met(runs, states, runs.getNumPartitions()).values().flatMap(_verify).map(lambda r: r[:cut]), schema, verifySchema=False)
        judged = materialise(judged, "merkle-judged")
    named = [F.col("k").alias(id_col), *[F.lower(F.hex(c)).alias(c) for c in binary], "verified", *(["path"] if paths else [])]
    return judged.select(*named)


#: The same result in DuckDB SQL: trees, siblings and folds level by level, and the checksum bit by bit.
ORACLE_SQL = r"""
with recursive d as (
  select *, dense_rank() over (order by lang nulls first) - 1 as g,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
           lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda t, z: xor(t >> 1, 3988292384 * (t & 1)))), 4294967295) % 3 = 0 as tamper
  from documents),
e as (select doc_id, g, tamper,
  coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
  text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from d),
f as (select doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
             sha256(head || coalesce(strlen(case when tamper then low else text end) || ':' || case when tamper then low else text end, '-')) as shown from e),
l as (select *, row_number() over () as r, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from f),
up as (select g, 0 as level, i, n, leaf as h from l
       union all
       select g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from up where n > 1 group by g, level, i // 8, n),
s as (select g, h as subroot from up where n = 1),
top as (select 0 as level, g as i, (select count(*) from s) as n, subroot as h from s
        union all
        select level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from top where n > 1 group by level, i // 8, n),
u as (select g, level, i,
        coalesce(string_agg(h, '') over (partition by g, level, i // 8 order by i rows between unbounded preceding and 1 preceding), '') as a,
        coalesce(string_agg(h, '') over (partition by g, level, i // 8 order by i rows between 1 following and unbounded following), '') as b from up where n > 1),
v as (select level, i,
        coalesce(string_agg(h, '') over (partition by level, i // 8 order by i rows between unbounded preceding and 1 preceding), '') as a,
        coalesce(string_agg(h, '') over (partition by level, i // 8 order by i rows between 1 following and unbounded following), '') as b from top where n > 1),
low as (select r, g, 0 as level, i, shown as h, '' as p from l
        union all
        select r, low.g, low.level + 1, low.i // 8, sha256(a || h || b), p || a || b from low join u on u.g = low.g and u.level = low.level and u.i = low.i),
lows as (select r, g, arg_max(h, level) as h, arg_max(p, level) as p from low group by r, g),
high as (select r, 0 as level, g as i, h, p from lows
         union all
         select r, high.level + 1, high.i // 8, sha256(a || h || b), p || a || b from high join v on v.level = high.level and v.i = high.i),
highs as (select r, arg_max(h, level) as h, arg_max(p, level) as p from high group by r)
select doc_id, leaf, subroot, root, sha256(p) as proof_sha256, highs.h as folded_root, highs.h = root as verified
from l join s using (g) join highs using (r), (select h as root from top where n = 1)
"""
