"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors become integers ``floor(scale * x)``. The rows are packed, partition by partition,
into shards, which are written with their postings: in a shard each dimension's values are
quantised to ``LEVELS`` steps, and the rows at one step of one dimension form a posting
segment. For a query, a segment's impact is the least gain over the dimension's worst value
that its rows surely have. Segments are taken in descending impact, each adding its impact to
its rows' accumulators. The accumulator is a lower bound of a row's gain, and accumulator plus
what the unread segments and the quantisation can still add is an upper bound. Rows whose
upper bound reaches the k-th best lower bound are the possible members; reading stops when
these are few or nothing is left, and all of them are rescored exactly. So no true member can
be missed.

Query vectors are packed into blocks and written to the shared folder. The index is scanned
once: a task takes a few shards at a time and runs the blocks, read one by one, over them, so
neither postings nor queries are shuffled; only each shard's best rows are. These are merged
by a ranking window, which Spark trims before its shuffle.

Defined results: vectors that are null, empty or hold null or non-finite components, and
rows with a null id, take no part. Vectors are compared with those of the same length only.
Every row but the query's own is its candidate, also one that repeats its id or its vector;
repeated ids are separate rows, as queries and as candidates. Ties go to the smaller id. Shards and queries whose sums doubles
may not hold exactly are scored in 64-bit integers, and beyond these in Python's. A scaled
component or a resulting score that is no 64-bit integer is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standscan.session import materialise, written_path

LIMIT = 1 << 26  # blocks with no component beyond it are packed as 32-bit integers
TOP = (1 << 63) - 1
FAST = 1 << 52  # sums of doubles below it are exact
LEVELS = 64
RESCORED = 8  # reading stops once so small a share of a shard is left to rescore
HELD = 64 << 20  # bytes of shards that a task holds at a time
PACKED = "block string, dims int, ids binary, rows binary, postings binary, ends binary"


def _clean(vectors: DataFrame, id_col: str, vec: str, scale: int) -> DataFrame:
    v = F.col(vec)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    ints = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < F.lit(2.0**63), F.floor(scaled(x)).cast("bigint")).otherwise(F.raise_error(F.lit("a scaled component is no 64-bit integer")).cast("bigint")))
    return vectors.where(fine).select(F.col(id_col).cast("bigint").alias("k"), ints.alias("v"))


def _largest(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


def _unpack(ids: bytes, rows: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids) // 8
    return np.frombuffer(ids, "<i8"), np.frombuffer(rows, f"<i{len(rows) // (n * dims)}").reshape(n, dims)


def _segments(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Row numbers in the order of each dimension's steps, and where the steps end."""
    low, width = _steps(rows)
    step = ((rows - low) // width).astype("i2")
    ends = np.stack([np.searchsorted(np.sort(step[:, d]), np.arange(LEVELS + 1)) for d in range(rows.shape[1])])
    return np.argsort(step, axis=0, kind="stable").T.astype("<u2").tobytes(), ends.astype("<u2").tobytes()


def _steps(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least value and the width of a step, by dimension."""
    low = rows.min(axis=0).astype("i8")
    return low, (rows.max(axis=0).astype("i8") - low) // LEVELS + 1


def _packer(rows_per_pack: int, indexed: bool):
    """Pack the rows of a partition, by vector length, into binary blocks; with postings if ``indexed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        held: dict[int, list] = {}

        def flush(dims: int) -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held[dims]])
            rows = np.concatenate([h[1] for h in held[dims]])
            held[dims] = []
            postings, ends = _segments(rows) if indexed and _largest(rows) * dims < FAST else (b"", b"")
            if _largest(rows) <= LIMIT:
                rows = rows.astype("<i4")
            return pa.RecordBatch.from_pydict(
                {"block": [uuid4().hex], "dims": pa.array([dims], pa.int32()), "ids": [ids.tobytes()], "rows": [rows.tobytes()], "postings": [postings], "ends": [ends]}
            )

        for batch in batches:
            ids, lists = batch.column("k").to_numpy(zero_copy_only=False), batch.column("v")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8")
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dims in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dims)
                matrix = flat[starts[mine][:, None] + np.arange(dims)]
                at = 0
                while at < len(mine):
                    room = rows_per_pack - sum(len(h[0]) for h in held.setdefault(dims, []))
                    part = slice(at, at + room)
                    held[dims].append((ids[mine[part]].astype("<i8"), matrix[part]))
                    at += room
                    if sum(len(h[0]) for h in held[dims]) == rows_per_pack:
                        yield flush(dims)
        for dims in [d for d, h in held.items() if h]:
            yield flush(dims)

    return run


class Shard:
    """The impact-ordered segments of up to a few thousand vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, postings: bytes = b"", ends: bytes = b"") -> None:
        self.ids, self.rows = ids, rows
        n, dims = rows.shape
        self.size = _largest(rows) * dims
        if self.size >= FAST:  # never searched by segments
            return
        self.floats = rows.astype("f8")
        if not postings:
            postings, ends = _segments(rows)
        self.low, self.width = _steps(rows)
        self.high = rows.max(axis=0).astype("i8")
        self.postings = np.frombuffer(postings, "<u2")
        ends = np.frombuffer(ends, "<u2").reshape(dims, LEVELS + 1).astype("i8")
        self.dim, self.step = np.nonzero(np.diff(ends, axis=1))
        self.start = self.dim * n + ends[self.dim, self.step]
        self.count = ends[self.dim, self.step + 1] - ends[self.dim, self.step]
        self.seg_low = self.low[self.dim] + self.step * self.width[self.dim]
        self.seg_high = np.minimum(self.seg_low + self.width[self.dim] - 1, self.high[self.dim])

    def _gain(self, segments: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """What the postings of these segments add to each row's accumulator."""
        count = self.count[segments]
        stops = np.cumsum(count)
        at = np.arange(int(stops[-1])) + np.repeat(self.start[segments] - stops + count, count)
        return np.bincount(self.postings[at], np.repeat(impact[segments].astype("f8"), count), len(self.ids)).astype("i8")

    def search(self, query: np.ndarray, k: int, floor: int | None, enough: int, own_id: int | None = None, rounds: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, scores)`` of this shard's k best rows that score at least ``floor``.

        The score of the query with itself may be beyond a long; it then counts as the largest.
        """
        q = query.astype("i8")
        possible = np.arange(len(self.ids))
        bound = self.size * _largest(q)
        if bound < FAST and self.size < FAST:
            size = np.abs(q)
            up = q[self.dim] >= 0
            impact = size[self.dim] * np.where(up, self.seg_low - self.low[self.dim], self.high[self.dim] - self.seg_high)
            base = int(np.minimum(q * self.low, q * self.high).sum())
            inside = int((size * (self.width - 1)).sum())
            order = np.argsort(-impact, kind="stable")
            order = order[: np.count_nonzero(impact)]  # segments without impact add nothing
            left = self._unread(self.dim[order], impact[order], len(q))
            cuts = np.unique(np.searchsorted(np.cumsum(self.count[order]), np.linspace(0, int(self.count[order].sum()), rounds + 1)[1:], side="left") + 1)
            gained, at = np.zeros(len(self.ids), "i8"), 0
            for cut in cuts.clip(max=len(order)).tolist() if len(order) else []:
                if cut > at:
                    gained += self._gain(order[at:cut], impact)
                    at = cut
                best = int(np.partition(gained, -k)[-k]) if len(gained) >= k else -(1 << 62)
                if floor is not None:
                    best = max(best, floor - base)
                possible = np.flatnonzero(gained >= best - inside - int(left[at]))
                if len(possible) <= enough:
                    break
            scores = (self.floats[possible] @ q.astype("f8")).astype("i8")
        elif bound < 1 << 63:  # too large for doubles: every row is a possible member
            scores = self.rows[possible].astype("i8") @ q
        else:
            scores = self.rows[possible].astype(object) @ q.astype(object)
        ids = self.ids[possible]
        if floor is not None:
            ids, scores = ids[scores >= floor], scores[scores >= floor]
        if scores.dtype == object:
            scores[(ids == own_id) & (scores == sum(v * v for v in q.tolist())) & (scores > TOP)] = TOP
            top = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], "i8")
            if any(not -(1 << 63) <= s < 1 << 63 for s in scores[top]):
                raise OverflowError("a score is no 64-bit integer")
            return ids[top], scores[top].astype("i8")
        top = np.lexsort((ids, -scores))[:k]
        return ids[top], scores[top]

    @staticmethod
    def _unread(dims: np.ndarray, impacts: np.ndarray, n: int) -> np.ndarray:
        """After each number of segments read: the sum over dimensions of the largest unread impact.

        Impacts descend, so reading a segment lowers its dimension's largest unread impact to
        that of the next segment of the dimension.
        """
        by_dim = np.argsort(dims, kind="stable")
        following = np.zeros(len(dims), "i8")
        same = dims[by_dim][1:] == dims[by_dim][:-1]
        following[by_dim[:-1][same]] = impacts[by_dim[1:][same]]
        first = np.ones(len(dims), bool)
        first[by_dim[1:][same]] = False
        return int(impacts[first].sum()) - np.concatenate([[0], np.cumsum(impacts - following)])


FOUND = pa.schema([("block", pa.string()), ("place", pa.int32()), ("query_id", pa.int64()), ("own", pa.bool_()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _own(ids: np.ndarray, scores: np.ndarray, q_id: int, q: np.ndarray) -> np.ndarray:
    """Which rows may be the query's own: those of its id and of its score with itself."""
    mine = ids == q_id
    if mine.any():
        mine &= scores == min(TOP, sum(v * v for v in q.tolist()))
    return mine


def _searcher(k: int, blocks: str):
    """Search the shards of a partition for the query blocks of the written table ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(blocks)
        table = ds.dataset(base, filesystem=fs, format="parquet")
        best: dict[tuple[str, int], list[int]] = {}  # the best scores that this task has seen, by query

        def searched(shards: list[tuple[int, Shard]]) -> Iterator[pa.RecordBatch]:
            for block in (row for b in table.to_batches(batch_size=1, columns=["block", "dims", "ids", "rows"]) for row in b.to_pylist()):
                found = []
                q_ids, queries = _unpack(block["ids"], block["rows"], block["dims"])
                for place, (q_id, q) in enumerate(zip(q_ids.tolist(), queries, strict=True)):
                    for dims, shard in shards:
                        if dims == block["dims"]:
                            key = block["block"], place
                            seen = best.get(key, [])
                            ids, got = shard.search(q, k, seen[-1] if len(seen) == k else None, max(4 * k, len(shard.ids) // RESCORED), q_id)
                            best[key] = sorted([*seen, *got.tolist()], reverse=True)[:k]
                            found.append((np.full(len(ids), place, "i4"), np.full(len(ids), q_id, "i8"), _own(ids, got, q_id, q), ids, got))
                if found:
                    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([block["block"]] * len(columns[0]), pa.string()), *map(pa.array, columns)], schema=FOUND)

        shards, size = [], 0
        for row in (r for batch in batches for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
            shards.append((row["dims"], Shard(*_unpack(row["ids"], row["rows"], row["dims"]), row["postings"], row["ends"])))
            size += 4 * len(row["rows"])
            if size >= HELD:
                yield from searched(shards)
                shards, size = [], 0
        if shards:
            yield from searched(shards)

    return run


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", scale: int = 1024, shard_rows: int = 4096) -> DataFrame:
    """The packed shards with their postings, written to the shared folder: a narrow map over the scan."""
    if not 0 < shard_rows < 1 << 16:
        raise ValueError("a shard has 1 to 65,535 rows")
    return materialise(_clean(vectors, id_col, vec, scale).mapInArrow(_packer(shard_rows, True), PACKED), "topk-index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec: str = "embedding", scale: int = 1024, block_rows: int = 512) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the exact k best of the index for every query row.

    One more than k rows are searched for, as the query's own row is left out at the end.
    """
    blocks = materialise(_clean(queries, id_col, vec, scale).mapInArrow(_packer(block_rows, False), PACKED), "topk-queries")
    found = index.mapInArrow(_searcher(k + 1, written_path(blocks)), "block string, place int, query_id bigint, own boolean, vec_id bigint, score bigint")
    query = W.partitionBy("block", "place")
    order = query.orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    ranked = ranked.withColumn("ss_own", F.min(F.when(F.col("own"), F.col("rank"))).over(query)).where(~F.col("rank").eqNullSafe(F.col("ss_own")))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") > F.col("ss_own"), F.col("rank") - 1).otherwise(F.col("rank")))
    beyond = F.raise_error(F.lit("a score is no 64-bit integer")).cast("bigint")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.when(F.col("own") & (F.col("score") == TOP), beyond).otherwise(F.col("score")).alias("score"))


#: The same result of the registered query in DuckDB SQL.
ORACLE_SQL = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.n, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q, v c where q.vec_id % 100 = 0 and c.n <> q.n and len(q.e) = len(c.e)),
r as (select query_id, row_number() over (partition by n order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
