"""URL filters: a sorted array of rule digests, probed by vectorised binary search.

A rule is ``host[/path]``. It fits its host and every subdomain of it, when the path of
the url starts with the path of the rule. Of the rules that fit, the longest (host plus
path, then the longer host) wins.

The index is an array of the 64-bit xxhash of every rule in ascending order, with the full
rule strings. It is cut by a range partitioning into files of some ``shard_bytes``, which
tasks write to the shared folder; the driver only sees one row per file. Probing tasks
memory-map the files, look up whole batches of candidate digests with ``searchsorted`` and
confirm each hit against the stored string, so that a collision cannot decide a verdict. A
file in a remote store is copied to the task's temporary folder while the task runs.

Defined results: a null url, or one without ``://``, has an empty host and path and no
rule. An empty rule table leaves every url with the default verdict. Null rules and rules
without a host are ignored; of repeated rules with unlike verdicts, block wins. Hosts of rules
and urls are lower-cased from A to Z only. Urls of any length are judged: only the host
suffixes and path lengths that some rule has become candidates.
"""

from __future__ import annotations

import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standscan.llm.batches import slices
from standscan.session import materialise, new_path

HEAD = "<4q"
VERDICTS = ("allow", "block")
FILES = "path string, n bigint, low bigint, high bigint"


def _lower(host: str) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(urls: DataFrame, id_col: str, url: str) -> DataFrame:
    """``(ss_id, host, path)`` by string functions alone."""
    rest = F.coalesce(F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")), F.lit(""))
    df = urls.select(F.col(id_col).alias("ss_id"), rest.alias("ss_rest"))
    host = F.regexp_extract("ss_rest", r"\A[^/?#]*", 0)
    df = df.withColumn("ss_host", host).withColumn("ss_tail", F.expr("substring(ss_rest, char_length(ss_host) + 1)"))
    return df.select(
        "ss_id",
        _lower("ss_host").alias("host"),
        F.regexp_extract("ss_tail", r"\A[^?#]*", 0).alias("path"),
    )


def clean_rules(rules: DataFrame) -> DataFrame:
    """Distinct ``(host, path, verdict, digest)`` of a table (rule, verdict)."""
    rule = F.col("rule")
    at = F.instr(rule, "/")
    parted = rules.where(rule.isNotNull() & F.col("verdict").isin(*VERDICTS)).select(
        F.when(at > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(rule).alias("host"),
        F.when(at > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("/")).alias("path"),
        "verdict",
    )
    hosts = parted.where("host <> ''").select(_lower("host").alias("host"), "path", "verdict")
    return hosts.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("digest", F.xxhash64(F.concat("host", "path")))


def labels_of(host: str = "host") -> Column:
    """How many labels a host has."""
    return F.char_length(host) - F.char_length(F.replace(F.col(host), F.lit("."))) + 1


def shapes(rules: DataFrame) -> dict[int, list[int]]:
    """The path lengths of the rules by their hosts' numbers of labels: no more than the longest rule has characters, each."""
    found: dict[int, list[int]] = {}
    for r in rules.select(labels_of().alias("labels"), F.char_length("path").alias("chars")).distinct().collect():
        found.setdefault(r["labels"], []).append(r["chars"])
    return {n: sorted(c) for n, c in sorted(found.items())}


def candidates(split: DataFrame, wanted: dict[int, list[int]]) -> DataFrame:
    """Append ``ss_keys``: for each host suffix and path prefix of a size that some rule has, the full string."""
    none = F.array().cast("array<struct<s:string,n:int>>")

    def of_labels(n: int, lengths: list[int]) -> Column:
        suffix = F.substring_index("host", ".", -n)
        fits = F.filter(F.array(*map(F.lit, lengths)), lambda c: c <= F.char_length("path"))
        made = F.transform(fits, lambda c: F.struct(F.concat(suffix, F.substring(F.col("path"), F.lit(1), c)).alias("s"), F.char_length(suffix).alias("n")))
        return F.when((F.col("host") != "") & (F.col("ss_labels") >= n), made).otherwise(none)

    keys = F.concat(none, *[of_labels(n, lengths) for n, lengths in wanted.items()])
    return split.withColumn("ss_labels", labels_of()).withColumn("ss_keys", keys).drop("ss_labels")


def _file_writer(folder: str):
    """Write the sorted rules of a partition as one index file, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, sizes, verdicts = [], [], []
        with tempfile.TemporaryFile() as strings:
            for batch in batches:
                raw = [x.encode() for x in batch.column("s").to_pylist()]
                strings.write(b"".join(raw))
                digests.append(batch.column("digest").to_numpy(zero_copy_only=False).astype("<i8"))
                sizes.append(np.array([len(x) for x in raw], "<i8"))
                verdicts.append(np.array([VERDICTS.index(v) for v in batch.column("verdict").to_pylist()], "u1"))
            if sum(map(len, digests)):
                all_digests = np.concatenate(digests)
                ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
                fs, base = pafs.FileSystem.from_uri(folder)
                fs.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.idx"  # a repeated task writes another file
                strings.seek(0)
                with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    for part in (struct.pack(HEAD, len(all_digests), int(ends[-1]), 0, 0), all_digests.tobytes(), ends.tobytes(), np.concatenate(verdicts).tobytes()):
                        out.write(part)
                    while piece := strings.read(1 << 20):
                        out.write(piece)
                low, high = int(all_digests[0]), int(all_digests[-1])
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": [len(all_digests)], "low": [low], "high": [high]})

    return run


def write_index(rules: DataFrame, shard_bytes: int) -> list[tuple[str, int, int]]:
    """Write the sorted array and return ``(path, lowest, highest digest)`` of its files."""
    need = rules.agg(F.count("*").alias("n"), F.sum(F.octet_length("host") + F.octet_length("path")).alias("b")).first()
    files = max(1, -(-(17 * need["n"] + (need["b"] or 0)) // shard_bytes))
    folder = new_path(rules.sparkSession, "urls")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    sorted_rules = rules.select("digest", F.concat("host", "path").alias("s"), "verdict").repartitionByRange(files, "digest").sortWithinPartitions("digest", "s")
    written = materialise(sorted_rules.mapInArrow(_file_writer(folder), FILES), "url-files")
    return [(r["path"], r["low"], r["high"]) for r in written.orderBy("low").collect()]


class DigestIndex:
    """A memory-mapped rule file."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype="u1", mode="r")
        self.n, size, _, _ = struct.unpack(HEAD, raw[: struct.calcsize(HEAD)].tobytes())
        at = struct.calcsize(HEAD)
        self.digests = raw[at : at + 8 * self.n].view("<i8")
        at += 8 * self.n
        self.ends = raw[at : at + 8 * (self.n + 1)].view("<i8")
        at += 8 * (self.n + 1)
        self.verdicts = raw[at : at + self.n]
        self.strings = raw[at + self.n : at + self.n + size]

    def string(self, i: int) -> str:
        return self.strings[self.ends[i] : self.ends[i + 1]].tobytes().decode()

    def probe(self, digests: np.ndarray, key_of) -> list[tuple[int, int]]:
        """``(place of the candidate, rule number)`` of confirmed hits."""
        if not self.n or not len(digests):
            return []
        at = np.searchsorted(self.digests, digests)
        some = np.flatnonzero(self.digests[np.minimum(at, self.n - 1)] == digests)
        found = []
        for c in some.tolist():
            key, i = key_of(c), int(at[c])
            while i < self.n and self.digests[i] == digests[c]:
                if self.string(i) == key:
                    found.append((c, i))
                    break
                i += 1
        return found


class Files:
    """The index files of a task, opened when a batch first needs them."""

    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        self.files = files
        self.open: dict[str, DigestIndex] = {}
        self.folder: str | None = None

    def _index(self, path: str) -> DigestIndex:
        if path not in self.open:
            fs, inner = pafs.FileSystem.from_uri(path)
            if not isinstance(fs, pafs.LocalFileSystem):
                self.folder = self.folder or tempfile.mkdtemp(prefix="spark-urls-")
                local = os.path.join(self.folder, os.path.basename(inner))
                with fs.open_input_stream(inner, compression=None) as source, open(local, "wb") as out:
                    shutil.copyfileobj(source, out, 1 << 20)
                inner = local
            self.open[path] = DigestIndex(inner)
        return self.open[path]

    def probe(self, digests: np.ndarray, key_of) -> Iterator[tuple[int, DigestIndex, int]]:
        """``(place of the candidate, index, rule number)`` of confirmed hits, over all files."""
        for path, low, high in self.files:
            mine = np.flatnonzero((digests >= low) & (digests <= high))
            if len(mine):
                index = self._index(path)
                for c, i in index.probe(digests[mine], lambda c, m=mine: key_of(int(m[c]))):
                    yield int(mine[c]), index, i

    def close(self) -> None:
        self.open.clear()
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def _probe_batches(files: list[tuple[str, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = Files(files)
        try:
            for batch in slices(batches, 4096):
                keys, digests = batch.column("ss_keys"), batch.column("ss_digests")
                flat, hashes = keys.flatten(), digests.flatten().to_numpy(zero_copy_only=False)
                strings, hosts = flat.field("s"), flat.field("n")
                counts = pa.compute.fill_null(pa.compute.list_value_length(keys), 0).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(counts)), counts)
                best: dict[int, tuple] = {}
                for c, index, i in indexes.probe(hashes, lambda c, s=strings: s[c].as_py()):
                    rule = strings[c].as_py()
                    rank = (len(rule), hosts[c].as_py(), rule, VERDICTS[index.verdicts[i]])
                    if rank > best.get(int(owner[c]), (-1,)):
                        best[int(owner[c])] = rank
                picked = [best.get(k, (0, 0, None, None)) for k in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ss_id"), batch.column("host"), batch.column("path"), pa.array([p[2] for p in picked], pa.string()), pa.array([p[3] for p in picked], pa.string())],
                    names=["ss_id", "host", "path", "rule", "verdict"],
                )
        finally:
            indexes.close()

    return run


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow", shard_bytes: int = 256 << 20) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``urls``."""
    ruled = materialise(clean_rules(rules), "url-rules")
    keyed = candidates(split_url(urls, id_col, url), shapes(ruled))
    keyed = keyed.withColumn("ss_digests", F.transform("ss_keys", lambda k: F.xxhash64(k.s)))
    kind = dict(keyed.dtypes)["ss_id"]
    judged = keyed.mapInArrow(_probe_batches(write_index(ruled, shard_bytes)), f"ss_id {kind}, host string, path string, rule string, verdict string")
    return judged.select(F.col("ss_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The production rules of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

ORACLE_SQL = r"""
with s as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
h as (select page_id, r, regexp_extract(r, '^[^/?#]*') as h0 from s),
p as (select page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(r, length(h0) + 1), '^[^?#]*') as path from h),
rules(host, path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (
  select p.page_id, p.host, p.path, rules.host || rules.path as rule, rules.verdict,
         row_number() over (partition by p.page_id order by length(rules.host || rules.path) desc nulls last) as k
  from p left join rules on (p.host = rules.host or ends_with(p.host, '.' || rules.host)) and starts_with(p.path, rules.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where k = 1
"""
