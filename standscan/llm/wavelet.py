"""Token ids of documents in compressed files, a wavelet matrix each, with rank and select.

Documents are range-partitioned and sorted by id. A task encodes its documents, appends the end
id to each, and writes shards of whole documents: a shard is closed by the document that takes
it to ``shard_tokens`` ids. The manifest, a written table with a row a shard, tells where the
ids of each begin among those of all documents. A lost task writes new files under new names;
those of its first attempt are in no manifest.

A file holds one bit-plane for each bit of an id, the highest first. Each plane lists its bits
in the order that the planes above leave: the ids whose bit is 0 come first, in their old order,
then those whose bit is 1. Planes are cut into blocks of ``BLOCK`` bits, compressed one by one,
and a directory has each block's place and the ones before it, so that a rank reads one block::

    WAVELET1 | blocks, plane by plane | documents: Arrow stream (id, n_tokens)
             | directory: zeros of each plane, ends of all blocks, ones before all blocks
             | tail: ids, planes, start and size of the documents and of the directory, WAVELET1

Blocks and directory are zstandard frames; a block that would not shrink is stored as it is. From
one file :class:`Shard` gives the id at a place (:meth:`Shard.access`), the occurrences of an id up
to a place (:meth:`Shard.rank`) or in a range (:meth:`Shard.count`), their places
(:meth:`Shard.occurrences`), all in a read per plane and block, and all ids (:meth:`Shard.decode`).

Texts are encoded by the tokenizers library. With a tokenizer whose normalisation, splitting and
merges never cross ASCII white space, pieces between it are encoded once a worker and remembered,
so the ids are those of the whole text. Invalid UTF-8 is read as U+FFFD.

Defined results: null and empty texts, and those of white space, have the end id alone. A null
id comes before all others; rows that share an id are ordered by a hash of their texts, then by
their texts; repeated rows are documents of their own. Texts of any length are used whole, and
one document may be a shard beyond the bound. An empty table has no shard and no row. Extra
columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
from array import array
from codecs import charmap_decode
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standscan.llm.batches import slices
from standscan.session import materialise, new_path

MAGIC = b"WAVELET1"
TAIL = struct.Struct("<6Q8s")
BLOCK = 1 << 15  # bits
SHARD_TOKENS = 8 << 20
HELD_BLOCKS = 1 << 12
MANIFEST = "part int, seq int, path string, documents bigint, tokens bigint, bytes bigint"


# ---------------------------------------------------------------- one file


def pack(ids: np.ndarray, planes: int, documents: pa.Table) -> bytes:
    """The file of ``ids``, which must be below ``2 ** planes``."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    n, step = len(ids), BLOCK // 8
    blocks = -(-n // BLOCK)
    parts, at = [MAGIC], len(MAGIC)
    zeros, ends, ones = np.zeros(planes, "<i8"), np.zeros((planes, blocks), "<i8"), np.zeros((planes, blocks + 1), "<i8")
    for row, k in enumerate(reversed(range(planes))):
        bit = (ids & ids.dtype.type(1 << k)) != 0
        packed = np.packbits(bit)
        starts = np.arange(0, len(packed), step)
        ones[row, 1:] = np.cumsum(np.add.reduceat(np.bitwise_count(packed), starts, dtype="i8")) if n else []
        zeros[row] = n - ones[row, -1]
        for b, first in enumerate(starts):
            raw = packed[first : first + step].tobytes()
            small = squeeze(raw)
            parts.append(small if len(small) < len(raw) else raw)
            at += len(parts[-1])
            ends[row, b] = at
        ids = np.concatenate([np.compress(~bit, ids), np.compress(bit, ids)])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(documents)
    listed = sink.getvalue().to_pybytes()
    directory = squeeze(zeros.tobytes() + ends.tobytes() + ones.tobytes())
    tail = TAIL.pack(n, planes, at, len(listed), at + len(listed), len(directory), MAGIC)
    return b"".join([*parts, listed, directory, tail])


class Shard:
    """One file, of which the directory is read at once and blocks as they are asked for."""

    def __init__(self, handle) -> None:
        self.handle = handle
        size = handle.size()
        if size < TAIL.size:
            raise ValueError("not a wavelet shard")
        self.n, self.planes, self._docs_at, self._docs_size, at, length, magic = TAIL.unpack(self._read(size - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self._open = zstandard.ZstdDecompressor()
        raw = np.frombuffer(self._open.decompress(self._read(at, length)), "<i8")
        self.blocks, p = -(-self.n // BLOCK), self.planes
        self.zeros = raw[:p]
        self._ends = raw[p : p + p * self.blocks]
        self._ones = raw[p + p * self.blocks :].reshape(p, self.blocks + 1)
        self._held: dict[int, np.ndarray] = {}

    def _read(self, at: int, length: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(length)

    def _expand(self, stored: bytes, b: int) -> bytes:
        size = -(-(min(BLOCK, self.n - b * BLOCK)) // 8)
        return stored if len(stored) == size else self._open.decompress(stored, max_output_size=size)

    def _block(self, plane: int, b: int) -> np.ndarray:
        key = plane * self.blocks + b
        if key not in self._held:
            if len(self._held) >= HELD_BLOCKS:
                self._held.clear()
            first = int(self._ends[key - 1]) if key else len(MAGIC)
            self._held[key] = np.frombuffer(self._expand(self._read(first, int(self._ends[key]) - first), b), "u1")
        return self._held[key]

    def _plane(self, plane: int) -> np.ndarray:
        first, last = plane * self.blocks, (plane + 1) * self.blocks
        begin = int(self._ends[first - 1]) if first else len(MAGIC)
        body, ends = self._read(begin, int(self._ends[last - 1]) - begin), self._ends[first:last] - begin
        raw = b"".join(self._expand(body[a:z], b) for b, (a, z) in enumerate(zip([0, *ends[:-1]], ends, strict=True)))
        return np.unpackbits(np.frombuffer(raw, "u1"), count=self.n).astype(bool)

    def documents(self) -> pa.Table:
        """``(id, n_tokens)`` of the documents in their order."""
        return pa.ipc.open_stream(self._read(self._docs_at, self._docs_size)).read_all()

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane tells how the order below it came about."""
        ids = np.zeros(self.n, "u2" if self.planes <= 16 else "u4")
        for plane in reversed(range(self.planes)) if self.n else ():
            bit = self._plane(plane)
            above, z = np.empty_like(ids), int(self.zeros[plane])
            above[~bit] = ids[:z]
            above[bit] = ids[z:] | ids.dtype.type(1 << (self.planes - 1 - plane))
            ids = above
        return ids

    def _ones_before(self, plane: int, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), "i8")
        block = at // BLOCK
        for b in np.unique(block):
            here = block == b
            out[here] = self._ones[plane, b]
            inner = at[here] - b * BLOCK
            if b < self.blocks and inner.any():
                packed = self._block(plane, int(b))
                counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype="i8")])
                rest = np.append(packed, 0)[inner // 8] >> (8 - inner % 8)
                out[here] += counts[inner // 8] + np.bitwise_count(rest.astype("u1"))
        return out

    def _below(self, plane: int, at: np.ndarray, bit: np.ndarray | bool) -> np.ndarray:
        """Where the next plane has what comes after ``at`` places of this one and has this bit."""
        ones = self._ones_before(plane, at)
        return np.where(bit, self.zeros[plane] + ones, at - ones)

    def access(self, places: Sequence[int]) -> np.ndarray:
        """The ids at these places."""
        at = np.asarray(places, "i8")
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("a place beyond the shard")
        ids = np.zeros(len(at), "i8")
        for plane in range(self.planes):
            bit = self._ones_before(plane, at + 1) > self._ones_before(plane, at)
            ids = 2 * ids + bit
            at = self._below(plane, at, bit)
        return ids

    def _range(self, token: int, start: int, end: int) -> np.ndarray:
        bounds = np.array([start, end], "i8")
        if token < 0 or token >> self.planes or not self.n:
            return np.zeros(2, "i8")
        for plane in range(self.planes):
            bounds = self._below(plane, bounds, bool(token >> (self.planes - 1 - plane) & 1))
        return bounds

    def rank(self, token: int, end: int) -> int:
        """How often the id occurs before the place ``end``."""
        return self.count(token, 0, end)

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often the id occurs from ``start`` up to, and without, ``end``."""
        low, high = self._range(token, start, self.n if end is None else end)
        return int(high - low)

    def _select(self, plane: int, bit: bool, number: np.ndarray) -> np.ndarray:
        """The places of the ones (or zeros) of these numbers, from 0."""
        ones = self._ones[plane]
        before = ones if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK, self.n) - ones
        block = np.searchsorted(before, number, side="right") - 1
        out = np.empty(len(number), "i8")
        for b in np.unique(block):
            here = block == b
            bits = np.unpackbits(self._block(plane, int(b)), count=min(BLOCK, self.n - int(b) * BLOCK))
            out[here] = b * BLOCK + np.flatnonzero(bits == bit)[number[here] - before[b]]
        return out

    def occurrences(self, token: int) -> np.ndarray:
        """All places of the id, ascending: its run below the last plane, selected back up plane by plane."""
        low, high = self._range(token, 0, self.n)
        at = np.arange(low, high)
        for plane in reversed(range(self.planes)) if len(at) else ():
            bit = bool(token >> (self.planes - 1 - plane) & 1)
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at


def open_shard(path: str) -> Shard:
    fs, inner = pafs.FileSystem.from_uri(path)
    return Shard(fs.open_input_file(inner))


# ---------------------------------------------------------------- encoding

# The normaliser and splitter of tokenizers whose words never cross white space.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Letters of ASCII and Latin-1, whose forms NFC keeps, and the ASCII marks but the apostrophe.
LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
LONG = 64  # bytes; longer pieces and words are not remembered


class _Pieces(dict):
    """Ids by piece; long pieces are not kept."""

    def __init__(self, encoder: PieceEncoder) -> None:
        self.encoder = encoder

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.encoder.piece(piece)
        if len(piece) <= LONG:
            self[piece] = ids
        return ids


class PieceEncoder:
    """Ids of whole texts as bytes, through the library once for each piece between ASCII white space.

    This holds for tokenizers of the form ``BY_WORDS`` alone; with any other one, texts go to the
    library whole. Pieces of up to 64 bytes are remembered in two generations of at most
    ``max_pieces`` each; when the young one is full, what was not met in it is forgotten. A piece of
    Latin-1 letters and ASCII marks after them is one word to normaliser and splitter: its letters in
    lower case go to the library's model without these, its marks through the whole tokenizer. Lower-case
    words are remembered in the same way, as a word comes with several marks and cases.
    """

    def __init__(self, vocabulary: str, max_pieces: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tool = Tokenizer.from_file(vocabulary)
        told = json.loads(self.tool.to_str())
        self.by_words = told["model"]["type"] == "BPE" and {k: told[k] for k in BY_WORDS} == BY_WORDS
        self.model = self.tool.model
        self.planes = max(1, (self.tool.get_vocab_size() - 1).bit_length())
        self.dtype = np.dtype("u2" if self.planes <= 16 else "u4")
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        pairs = [as_bytes(chr(c))[0][0] for c in range(0xC0, 0x100)]  # two bytes each, the first is 0xC3
        self.spelt = "".join(map(chr, range(0x80))) + "".join(p[1] for p in pairs) + "".ljust(3) + pairs[0][0]
        self.max_pieces = max_pieces
        self.marks: dict[str, bytes] = {"": b""}
        self.young = _Pieces(self)
        self.old: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def _whole(self, pieces: list[str]) -> list[bytes]:
        coded = self.tool.encode_batch_fast(pieces, add_special_tokens=False)
        return [self._packed(c.ids) for c in coded]

    def piece(self, piece: bytes) -> bytes:
        """The ids of a piece that the young generation lacks."""
        ids = self.old.get(piece)
        if ids is not None:
            return ids
        shown = piece.decode("utf-8", "replace")
        word = shown.rstrip(MARKS)
        if not (word.isalpha() if word.isascii() else LETTERS(word)):
            return self._whole([shown])[0]
        marks, word = shown[len(word) :], word.lower()
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            self.marks[marks] = self._whole([marks])[0]
        ids = self.words.get(word)
        if ids is None:
            ids = self._word(word)
        return ids + self.marks[marks]

    def _word(self, word: str) -> bytes:
        """The ids of a word of lower-case letters that the young generation lacks."""
        ids = self.old_words.get(word)
        if ids is None:
            spelt = word if word.isascii() else charmap_decode(word.encode(), "strict", self.spelt)[0]
            ids = self._packed([t.id for t in self.model.tokenize(spelt)])
        if len(word) <= LONG:
            self.words[word] = ids
        return ids

    def encode(self, texts: pa.Array | list[bytes | None]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        if not self.by_words:
            return self._whole([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()])
        if len(self.young) > self.max_pieces:
            self.old, self.young = self.young, _Pieces(self)
        if len(self.words) > self.max_pieces:
            self.old_words, self.words = self.words, {}
        # Equal pieces of these texts are looked up once; the kernel only looks for ASCII bytes.
        split = pc.ascii_split_whitespace(pc.fill_null(texts, b"").view(pa.string()))
        pieces = split.flatten().view(pa.binary()).dictionary_encode()
        coded = pa.array(map(self.young.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary()).take(pieces.indices)
        ids, ends = memoryview(coded.buffers()[2] or b""), np.frombuffer(coded.buffers()[1], "<i8")
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        cut = ends[offsets] if len(coded) else offsets
        return [ids[a:z].tobytes() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


@functools.lru_cache(1)
def _encoder(vocabulary: str) -> PieceEncoder:
    """A worker's encoder, for all its tasks."""
    return PieceEncoder(vocabulary)


def _writer(folder: str, vocabulary: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        encoder = _encoder(vocabulary)
        if end_id >> encoder.planes:
            raise ValueError("the end id is beyond the vocabulary")
        end = np.array([end_id], encoder.dtype).tobytes()
        part, done, keys, ids, counts = TaskContext.get().partitionId(), [], [], [], []

        def close() -> None:
            documents = pa.table({"id": pa.chunked_array(keys), "n_tokens": pa.array(counts, pa.int64())})
            path = f"{folder}/{uuid.uuid4().hex}.wavelet"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}", compression=None) as out:
                raw = pack(np.frombuffer(b"".join(ids), encoder.dtype), encoder.planes, documents)
                out.write(raw)
            done.append((part, len(done), path, len(counts), sum(counts), len(raw)))
            keys.clear(), ids.clear(), counts.clear()

        held = 0
        for batch in slices(batches):
            first = 0
            for at, coded in enumerate(encoder.encode(batch.column("t"))):
                ids.append(coded + end)
                counts.append(len(ids[-1]) // encoder.dtype.itemsize)
                held += counts[-1]
                if held >= shard_tokens:
                    keys.append(batch.column("k").slice(first, at + 1 - first))
                    close()
                    first, held = at + 1, 0
            if first < batch.num_rows:
                keys.append(batch.column("k").slice(first))
        if counts:
            close()
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)], names=names)

    return run


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all rows into shards in ascending order of ids; returns the manifest.

    ``vocabulary`` is a file of the tokenizers library. The manifest has path, documents,
    tokens, bytes and ``start``, the ids in all shards before.
    """
    folder = new_path(docs.sparkSession, "wavelet")
    folder = folder if "://" in folder else "file://" + folder
    rows = docs.select(F.col(id_col).alias("k"), F.col(text).cast("string").cast("binary").alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    made = materialise(ordered.mapInArrow(_writer(folder, vocabulary, end_id, shard_tokens), MANIFEST), "wavelet-shards")
    # One row a shard of some ten million ids.
    before = F.sum("tokens").over(W.orderBy("part", "seq")) - F.col("tokens")
    out = materialise(made.select("path", "documents", "tokens", "bytes", before.alias("start")), "wavelet-manifest")
    out._standscan_id = dict(rows.dtypes)["k"]
    return out


# ---------------------------------------------------------------- reading


def _dealt(manifest: DataFrame, task_bytes: int) -> DataFrame:
    total = manifest.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    tasks = max(2 * manifest.sparkSession.sparkContext.defaultParallelism, -(-(total["b"] or 0) // task_bytes))
    return manifest.select("start", "path").repartitionByRange(max(1, min(total["n"], tasks)), "start")


def _over_shards(manifest: DataFrame, work, schema: str, task_bytes: int) -> DataFrame:
    """``work(shard, start)`` yields batches for each file; files are dealt to tasks in runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = open_shard(row["path"])
                with shard.handle:
                    yield from work(shard, row["start"])

    return _dealt(manifest, task_bytes).mapInArrow(run, schema)


def read_tokens(manifest: DataFrame, id_col: str = "doc_id", id_type: str | None = None, task_bytes: int = 64 << 20) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of every document; ``ids`` is little-endian, 32 bits an id."""
    kind = id_type or getattr(manifest, "_standscan_id", "bigint")

    def work(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        listed = shard.documents().combine_chunks()
        ends = np.concatenate([[0], np.cumsum(listed["n_tokens"].to_numpy())])
        ids = shard.decode()
        for first in range(0, listed.num_rows, 256):
            last = min(first + 256, listed.num_rows)
            cut = ends[first : last + 1]
            whole = pa.array([ids[a:z].astype("<u4").tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            keys = listed["id"].slice(first, last - first).combine_chunks()
            columns = [keys, pa.array(start + cut[:-1]), pa.array(np.diff(cut)), whole]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "start", "n_tokens", "ids"])

    out = _over_shards(manifest, work, f"k {kind}, start bigint, n_tokens bigint, ids binary", task_bytes)
    return out.select(F.col("k").alias(id_col), "start", "n_tokens", "ids")


def count_tokens(manifest: DataFrame, tokens: Sequence[int], task_bytes: int = 64 << 20) -> DataFrame:
    """``(token, n)``: how often each of the given ids occurs in all shards, by ranks alone."""
    asked = sorted(set(tokens))

    def work(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"token": pa.array(asked, pa.int64()), "n": pa.array([shard.count(t) for t in asked], pa.int64())})

    return _over_shards(manifest, work, "token bigint, n bigint", task_bytes).groupBy("token").agg(F.sum("n").alias("n"))


def find_token(manifest: DataFrame, token: int, id_col: str = "doc_id", id_type: str | None = None, task_bytes: int = 64 << 20) -> DataFrame:
    """``(id, place, at)`` of every occurrence of an id: its place in the document and among all ids."""
    kind = id_type or getattr(manifest, "_standscan_id", "bigint")

    def work(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        places = shard.occurrences(token)
        listed = shard.documents().combine_chunks()
        begins = np.concatenate([[0], np.cumsum(listed["n_tokens"].to_numpy())])
        for first in range(0, len(places), 1 << 16):
            at = places[first : first + (1 << 16)]
            owner = np.searchsorted(begins, at, side="right") - 1
            keys = listed["id"].combine_chunks().take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([keys, pa.array(at - begins[owner]), pa.array(start + at)], names=["k", "place", "at"])

    out = _over_shards(manifest, work, f"k {kind}, place bigint, at bigint", task_bytes)
    return out.select(F.col("k").alias(id_col), "place", "at")
