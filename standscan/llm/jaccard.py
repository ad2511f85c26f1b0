"""N-gram Jaccard self-join of texts by a MinHash LSH forest with exact verification.

1. Texts are grouped to classes of equal texts by SHA-256. Each class has a forest
   signature: ``trees`` sequences of ``depth`` min-hashes of its word shingles, a byte each,
   so that one 64-bit integer is a path from a tree's root to its leaf.
2. The paths of every tree are sorted, which makes the tree a prefix trie: the texts below a
   trie node are neighbours in the order, and the longest common prefix of neighbours tells
   where nodes begin. The order is a range partitioning by tree, path and text, so a node of
   any size is spread over tasks. The matched prefix starts at the full depth and is shortened
   until the chance to meet a pair at the threshold, ``1 - (1 - s**d) ** trees``, reaches
   ``recall``. Stopping earlier for what a text has met so far would lose pairs at the
   threshold, so the target alone decides. Each text is tied to the first one below its node,
   so a node of m classes gives m - 1 candidate edges, and its pairs are never listed.
3. Connected candidates form families. A family is cut into blocks bounded in texts and
   bytes; each pair of blocks is one task group, which verifies its pairs exactly on whole
   shingle sets and returns only link counts and a spanning forest of the links.
4. Components of the verified links are the near-duplicate classes.

Words are maximal runs without ASCII white space, compared as they are. A text of fewer
than ``width`` words is one shingle of all its words; one without words has no shingle,
no link, and is a class of its own. The result has one row per input row: ``class_id`` is
the smallest id of its class (null only if all its ids are null), ``n_links`` the number
of other rows whose similarity is at least the threshold, equal texts included. Repeated
rows count as rows. Texts of any length are used whole. An empty table gives an empty one;
extra columns are not read, and :func:`one_per_class` carries them along whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standscan.llm.batches import slices
from standscan.llm.columns import numbered, restored
from standscan.operators.components import connected_components
from standscan.session import materialise

find_words = re.compile(r"[^\x20\x09-\x0D]+").findall
TREES, DEPTH, WIDTH, THRESHOLD, RECALL = 20, 8, 5, 0.8, 0.999
BLOCK_TEXTS, BLOCK_BYTES = 64, 8 << 20
SLOTS, PAGE = 1 << 26, 1 << 15  # bits of a key filter, 8 MB in all, and bits of one of its rows


def forest_recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that two sets of this similarity share a prefix of ``depth`` in some tree."""
    return 1.0 - (1.0 - similarity**depth) ** trees


def prefix_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shorten the matched prefix from ``depth`` until the target recall is reached."""
    while depth > 1 and forest_recall(threshold, depth, trees) < recall:
        depth -= 1
    return depth


class Signer:
    """Forest signatures: per tree, the low bytes of ``DEPTH`` min-hashes, the first on top."""

    def __init__(self, width: int, max_words: int = 100_000) -> None:
        rng = np.random.default_rng(2024)
        self.width, self.max_words = width, max_words
        self.a = (rng.integers(0, 1 << 32, TREES * DEPTH, dtype="u8") | np.uint64(1)).astype("u4")[:, None]
        self.b = rng.integers(0, 1 << 32, TREES * DEPTH, dtype="u8").astype("u4")[:, None]
        self.known: dict[str, int] = {}

    def _new(self, word: str) -> int:
        if len(self.known) >= self.max_words:
            self.known.clear()
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self.known[word] = value
        return value

    def sign(self, text: str | None) -> list[int] | None:
        words = find_words(text or "")
        if not words:
            return None
        get, new = self.known.get, self._new
        h = np.array([get(w) or new(w) for w in words], dtype="u8")
        n = max(1, len(h) - self.width + 1)
        mixed = np.zeros(n, "u8")
        with np.errstate(over="ignore"):
            for k in range(min(self.width, len(h))):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
                mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            x = np.unique((mixed >> np.uint64(32)).astype("u4"))
            low = np.full((TREES * DEPTH, 1), 0xFFFFFFFF, "u4")
            for at in range(0, len(x), 2048):
                low = np.minimum(low, (self.a * x[at : at + 2048] + self.b).min(axis=1, keepdims=True))
        return low[:, 0].astype("u1").view(">i8").tolist()


def sign_rows(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """``(ss_id, ss_key, ss_sig, ss_bytes)`` of every row: id, digest of the text, signature and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(width)
        for batch in slices(batches):
            sigs = [signer.sign(t) for t in batch.column("ss_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("ss_id"), batch.column("ss_key"), pa.array(sigs, pa.list_(pa.int64())), batch.column("ss_bytes")], names=["ss_id", "ss_key", "ss_sig", "ss_bytes"])

    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(id_col).alias("ss_id"), text_key(text).alias("ss_key"), F.octet_length(t).cast("bigint").alias("ss_bytes"), t.alias("ss_t"))
    return df.mapInArrow(run, f"ss_id {dict(df.dtypes)['ss_id']}, ss_key binary, ss_sig array<bigint>, ss_bytes bigint")


def text_key(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _probe(rows: DataFrame, key: str, keys: DataFrame, how: str) -> DataFrame:
    """The rows whose ``key`` may be among ``keys.ss_key`` (leftsemi), or surely is not (leftanti).

    The keys' hashes set bits of a map of ``SLOTS`` bits, which is broadcast: at most 8 MB,
    however many keys. A shared bit only lets a row pass that the exact join then settles, so
    the map saves shuffled texts and decides nothing; a full one saves nothing.
    """
    slot = lambda k: F.pmod(F.xxhash64(F.lit(11), k), F.lit(SLOTS))
    page = lambda k: F.floor(slot(k) / PAGE)
    at = keys.select(page("ss_key").alias("ss_page"), F.pmod(slot("ss_key"), F.lit(PAGE)).alias("ss_at"))
    bits = at.repartition("ss_page").groupBy("ss_page").agg(F.bitmap_construct_agg("ss_at").alias("ss_bits"))
    own = F.pmod(slot(key), F.lit(PAGE))
    byte = F.conv(F.hex(F.substring(F.col("ss_bits"), (F.floor(own / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), (page(key) == F.col("ss_page")) & (F.getbit(byte, F.pmod(own, F.lit(8)).cast("int")) == 1), how)


def _unique_shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, shingle number)`` of all distinct shingles, numbered exactly."""
    numbers: dict[str, int] = {}
    owners, grams = [], []
    for at, text in enumerate(texts):
        w = np.array([numbers.setdefault(x, len(numbers) + 1) for x in find_words(text)], dtype="i8")
        if len(w):
            if len(w) < width:
                w = np.concatenate([w, np.zeros(width - len(w), "i8")])
            grams.append(np.lib.stride_tricks.sliding_window_view(w, width))
            owners.append(np.full(len(grams[-1]), at))
    if not grams:
        return np.empty(0, "i8"), np.empty(0, "i8")
    owner, windows = np.concatenate(owners), np.concatenate(grams)
    code = windows[:, 0]
    for k in range(1, width):
        _, code = np.unique(code * (len(numbers) + 1) + windows[:, k], return_inverse=True)
    both = np.unique(owner * (int(code.max()) + 1) + code)
    return both // (int(code.max()) + 1), both % (int(code.max()) + 1)


def similarities(texts: list[str], width: int) -> np.ndarray:
    """The exact Jaccard similarity of all pairs of a bounded block of texts."""
    n = len(texts)
    owner, code = _unique_shingles(texts, width)
    sizes = np.bincount(owner, minlength=n).astype("f8")
    counts = np.bincount(code)
    shared = counts[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    both = np.zeros((n, n))
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [at, at + 4096])
        dense = np.zeros((n, 4096), "f4")
        dense[owner[a:b], code[a:b] - at] = 1
        both += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - both
    return np.divide(both, union, out=np.zeros((n, n)), where=union > 0)


LINKS = pa.schema([("key", pa.binary()), ("other", pa.binary()), ("links", pa.int64())])


def _verifier(width: int, threshold: float):
    """Links within one block, or between two, as counts and a spanning forest."""

    def run(group: pa.Table) -> pa.Table:
        blocks = group.to_pylist()
        members, side = [], []
        for number, block in enumerate(blocks):
            members += block["members"]
            side += [number] * len(block["members"])
        if len(blocks) == 1 and blocks[0]["lo"] != blocks[0]["hi"]:
            return LINKS.empty_table()
        n = len(members)
        linked = similarities([m["text"] for m in members], width) >= threshold
        np.fill_diagonal(linked, False)
        side = np.array(side)
        if len(blocks) > 1:
            linked &= side[:, None] != side[None, :]
        copies = np.array([m["copies"] for m in members], dtype="i8")
        links = linked @ copies
        root = np.arange(n)
        forest = []
        for i in range(n):
            for j in np.flatnonzero(linked[i, i + 1 :]) + i + 1:
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    forest.append((members[i]["key"], members[j]["key"], 0))
        rows = [(m["key"], None, int(c)) for m, c in zip(members, links, strict=True) if c] + forest
        return pa.Table.from_pylist([dict(zip(LINKS.names, r, strict=True)) for r in rows], LINKS)

    return run


RUNS = pa.schema([("node", pa.int64()), ("head", pa.int64()), ("part", pa.int32()), ("side", pa.int32()), ("tree", pa.int32()), ("path", pa.int64())])


def _walk_tries(depth: int):
    """Ties of sorted ``(tree, path, node)`` rows to the first row below their trie node.

    Besides, the first and the last row of the partition, without a head, for the ties across
    partitions.
    """

    def rows(node, head, part, side, tree, path) -> pa.RecordBatch:
        n = len(node)
        fixed = lambda v: pa.array(np.full(n, v, "i4"))
        heads = pa.nulls(n, pa.int64()) if head is None else pa.array(head)
        return pa.RecordBatch.from_arrays([pa.array(node), heads, fixed(part), fixed(side), pa.array(tree), pa.array(path)], schema=RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, head = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            tree, path, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "path", "node"))
            if not len(node):
                continue
            if last is None:
                yield rows(node[:1], None, part, 0, tree[:1], path[:1])
            before_tree, before_path = np.append(last[0] if last else -1, tree[:-1]), np.append(last[1] if last else 0, path[:-1])
            below = (tree == before_tree) & ((path ^ before_path).view("u8") >> np.uint64(64 - 8 * depth) == 0)
            begins = np.where(below, -1, np.arange(len(node)))
            begins = np.maximum.accumulate(begins)
            heads = np.where(begins >= 0, node[begins], head)
            tied = np.flatnonzero(heads != node)
            yield rows(node[tied], heads[tied], part, 2, tree[tied], path[tied])
            last, head = (tree[-1], path[-1], node[-1]), heads[-1]
        if last is not None:
            yield rows(np.array([last[2]]), None, part, 1, np.array([last[0]], "i4"), np.array([last[1]]))

    return run


def _trie_edges(classes: DataFrame, depth: int) -> DataFrame:
    """``(node, head)``: candidate edges of all trees, without texts alone below their node."""
    paths = classes.where("ss_sig is not null").select(F.xxhash64("ss_key").alias("node"), F.posexplode("ss_sig").alias("tree", "path"))
    order = ("tree", "path", "node")
    kind = "node bigint, head bigint, part int, side int, tree int, path bigint"
    found = materialise(paths.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk_tries(depth), kind), "jaccard-runs")
    # Two rows of each partition, in the order of the partitions: a table as long as their number.
    by_part = W.orderBy("part", "side")
    ends = found.where("head is null").select("*", *[F.lag(c).over(by_part).alias(f"b_{c}") for c in ("node", "tree", "path")])
    same = (F.col("tree") == F.col("b_tree")) & (F.shiftrightunsigned(F.col("path").bitwiseXOR(F.col("b_path")), 64 - 8 * depth) == 0)
    across = ends.where((F.col("side") == 0) & same & (F.col("node") != F.col("b_node"))).select("node", F.col("b_node").alias("head"))
    return found.where("head is not null").select("node", "head").unionByName(across)


def _families(classes: DataFrame, depth: int) -> DataFrame:
    """``(ss_key, ss_family)`` of the classes that share a trie node with another one."""
    node = F.xxhash64("ss_key")
    families = connected_components(_trie_edges(classes, depth), "node", "head")
    out = classes.select("ss_key", node.alias("node"), "ss_rep", "ss_copies", "ss_bytes").join(families, "node").select("ss_key", "ss_rep", "ss_copies", "ss_bytes", F.col("component").alias("ss_family"))
    return materialise(out, "jaccard-families")


def _verified(docs: DataFrame, families: DataFrame, id_col: str, text: str, width: int, threshold: float) -> DataFrame:
    """Link counts and forest edges of all families, verified on whole texts."""
    sizes = families.groupBy("ss_family").agg(F.count("*").alias("m"), F.sum("ss_bytes").alias("b"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK_TEXTS), F.ceil(F.col("b") / BLOCK_BYTES)).cast("int")
    sizes = materialise(sizes.select("ss_family", parts.alias("parts")), "jaccard-sizes")
    members = materialise(
        families.join(sizes, "ss_family").select(
            "ss_key", "ss_rep", "ss_copies", "ss_family", "parts", F.pmod(F.xxhash64(F.lit(7), "ss_key"), F.col("parts")).cast("int").alias("part")
        ),
        "jaccard-members",
    )
    rows = docs.select(F.col(id_col).alias("ss_id"), text_key(text).alias("ss_k"), F.coalesce(F.col(text), F.lit("")).alias("ss_t"))
    # The texts are always fetched by a sort-merge join, so that the plan and its share of disk are alike at every size.
    fetched = _probe(rows, "ss_k", members, "leftsemi").join(members.hint("merge"), (F.col("ss_k") == F.col("ss_key")) & F.col("ss_id").eqNullSafe(F.col("ss_rep")))
    whole = fetched.groupBy("ss_key", "ss_family", "parts", "part", "ss_copies").agg(F.first("ss_t").alias("ss_t"))
    blocks = whole.groupBy("ss_family", "part").agg(
        F.first("parts").alias("parts"), F.collect_list(F.struct(F.col("ss_key").alias("key"), F.col("ss_copies").alias("copies"), F.col("ss_t").alias("text"))).alias("members")
    )
    meeting = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "ss_family", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "members"
    )
    return meeting.groupBy("ss_family", "lo", "hi").applyInArrow(_verifier(width, threshold), "key binary, other binary, links bigint")


def link_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """``(rows, classes)``: the signed rows, and per distinct text its component and links.

    ``classes`` has ss_key, ss_rep, ss_copies, ss_root, ss_links and ss_class.
    """
    signed = materialise(sign_rows(docs, id_col, text, width), "jaccard-rows")
    classes = materialise(
        signed.groupBy("ss_key").agg(F.min("ss_id").alias("ss_rep"), F.count("*").alias("ss_copies"), F.max("ss_bytes").alias("ss_bytes"), F.first("ss_sig").alias("ss_sig")), "jaccard-classes"
    )
    families = _families(classes, prefix_depth(threshold, recall))
    found = materialise(_verified(docs, families, id_col, text, width, threshold), "jaccard-links")
    counts = materialise(found.where("other is null").groupBy("key").agg(F.sum("links").alias("links")), "jaccard-counts")
    parts = connected_components(found.where("other is not null"), "key", "other")
    joined = (
        classes.join(counts, F.col("ss_key") == counts["key"], "left")
        .join(parts, F.col("ss_key") == F.col("node"), "left")
        .select(
            "ss_key",
            "ss_rep",
            "ss_copies",
            F.coalesce("component", "ss_key").alias("ss_root"),
            F.when(F.col("ss_sig").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("ss_copies") - 1).cast("bigint").alias("ss_links"),
            F.col("ss_sig").isNull().alias("ss_empty"),
        )
    )
    joined = materialise(joined, "jaccard-joined")
    roots = materialise(joined.groupBy("ss_root").agg(F.min("ss_rep").alias("ss_class")), "jaccard-roots")
    return signed.select("ss_id", "ss_key"), materialise(joined.join(roots, "ss_root"), "jaccard-final")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``(id, class_id, n_links)`` for every row."""
    rows, classes = link_classes(docs, id_col, text, width, threshold, recall)
    return rows.join(classes, "ss_key").select(
        F.col("ss_id").alias(id_col), F.when(F.col("ss_empty"), F.col("ss_id")).otherwise(F.col("ss_class")).alias("class_id"), F.col("ss_links").alias("n_links")
    )


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` with one row of each class: the smallest id, then the smallest digest.

    Rows without words are kept, as they are in no class. A null id counts as the largest.
    Columns may have any names.
    """
    docs, own = numbered(docs)
    id_col, text = own[id_col], own[text]
    rows, classes = link_classes(docs, id_col, text, width, threshold, recall)
    pick = F.min(F.struct(F.col("ss_rep").isNull().alias("last"), F.col("ss_rep").alias("rep"), F.col("ss_key").alias("key"))).alias("p")
    chosen = classes.where("not ss_empty").groupBy("ss_root").agg(pick).select(F.col("p.key").alias("ss_key"), F.col("p.rep").alias("ss_rep"))
    twice = rows.groupBy("ss_key", "ss_id").agg(F.count("*").alias("n")).where("n > 1").select("ss_key", F.col("ss_id").alias("ss_rep2"))
    chosen = chosen.join(twice, (chosen["ss_key"] == twice["ss_key"]) & chosen["ss_rep"].eqNullSafe(F.col("ss_rep2")), "left").select(chosen["ss_key"], "ss_rep", twice["ss_key"].isNotNull().alias("ss_twice"))
    chosen = materialise(chosen, "jaccard-chosen")
    crowded = classes.where("not ss_empty").groupBy("ss_root").agg(F.sum("ss_copies").alias("n")).where("n > 1").select("ss_root")
    contested = materialise(classes.join(crowded, "ss_root").select("ss_key"), "jaccard-contested")
    words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.where(words).withColumn("ss_k", text_key(text))
    alone = _probe(keyed, "ss_k", contested, "leftanti").select(*docs.columns)
    kept = _probe(keyed, "ss_k", contested, "leftsemi").join(chosen, (F.col("ss_k") == F.col("ss_key")) & F.col(id_col).eqNullSafe(F.col("ss_rep")))
    single = kept.where("not ss_twice").select(*docs.columns)
    repeated = kept.where("ss_twice").dropDuplicates(["ss_k"]).select(*docs.columns)
    return restored(alone.unionByName(single).unionByName(repeated).unionByName(docs.where(~words)), own)
