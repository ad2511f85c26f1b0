"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

The transducer reads bytes and emits token ids. Its nondeterministic form walks a trie of
the vocabulary, beginning a walk at every byte; where a walk meets a token's end, it may
emit the token if the one before it is such that the merges would leave the pair apart. A
sequence of tokens is the merges' result exactly when each neighbouring pair is such a pair,
so exactly one token of the right sequence ends at each byte of a prefix. The deterministic
form tracks the set of live walks; its states and arcs are made when first met and kept. An
arc carries the tokens that end there, longest first, and a register holds the token that
ended at each recent byte; memoised pair tests pick the right one. States of live walks are
suffixes of each other, so there are no more of them than trie nodes. Tokens are emitted
once all live walks agree on them, at the latest after a lookahead of ``chunk`` bytes and the
longest token. All memos are bounded, and all are dropped when the task ends.

Defined results: a null or empty text has no ids. Texts of any length are read whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standscan.llm.batches import slices


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Bytes in, token ids out. One instance per task; not shared between threads.

    A state is a dict of its arcs, byte -> (next state, ((token, length), ...) that may end
    here), with the trie nodes of its live walks under the key -1, the longest walk first.
    """

    def __init__(self, ranks: dict[bytes, int], max_pairs: int = 250_000) -> None:
        self.ranks = ranks
        self.max_pairs = max_pairs
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.kids: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.depth: list[int] = [0]
        leaf: dict[int, int] = {}  # shared by the nodes without arcs
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.kids[node].get(b)
                if nxt is None:
                    if self.kids[node] is leaf:
                        self.kids[node] = {}
                    nxt = self.kids[node][b] = len(self.kids)
                    self.kids.append(leaf)
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.ends[node] = rank
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.start: dict = {-1: (0,)}
        self.made: dict[tuple[int, ...], dict] = {(0,): self.start}

    def merges(self, piece: bytes) -> list[int]:
        """The defining merge loop, used on the two tokens of a pair."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int) -> tuple[list, list] | None:
        """The first and the last part of ``token`` while its merges run: (part, from rank, to rank).

        None if its merges don't give the token back in ascending order of rank; pairs
        with such a token are then settled by :meth:`merges`.
        """
        if token not in self.spines:
            parts = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            first, last, at = [[parts[0], -1, 1 << 60]], [[parts[-1], -1, 1 << 60]], -1
            while len(parts) > 1:
                rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 60 or rank < at:
                    break
                at = rank
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                for side, end in ((first, 0), (last, -1)):
                    if side[-1][0] != parts[end]:
                        side[-1][2] = at
                        side.append([parts[end], at, 1 << 60])
            self.spines[token] = (first, last) if len(parts) == 1 else None
        return self.spines[token]

    def apart(self, left: int, right: int) -> bool:
        """Would the merges leave this pair as it is?

        They would not if some last part of the left token and some first part of the right
        one exist together while the merge of the two is the next in rank. Of equal ranks
        the leftmost merge goes first.
        """
        key = left + 1 << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            a, b = self._edges(left) if left >= 0 else ((), ()), self._edges(right)
            if a is None or b is None:
                pair = [right] if left < 0 else [left, right]
                found = self.merges(b"".join(self.tokens[t] for t in pair)) == pair
            else:
                get = self.ranks.get
                found = True
                for x, x_from, x_to in a[1]:
                    for y, y_from, y_to in b[0]:
                        rank = get(x + y)
                        if rank is not None:
                            rank = max(rank, x_from, y_from)
                            if rank < x_to and rank <= y_to:
                                found = False
            self.pairs[key] = found
        return found

    def _step(self, state: dict, byte: int) -> tuple[dict, tuple]:
        """Make the arc of ``state`` for ``byte``."""
        walks, ended = [], []
        for node in state[-1]:
            at = self.kids[node].get(byte)
            if at is not None:
                if self.kids[at]:
                    walks.append(at)
                if self.ends[at] >= 0:
                    ended.append((self.ends[at], self.depth[at]))
        key = (*walks, 0)
        if key not in self.made:
            self.made[key] = {-1: key}
        state[byte] = arc = (self.made[key], tuple(ended))
        return arc

    def _back(self, last: list[int], at: int) -> list[int]:
        """The tokens up to place ``at``, from the token that ends at each place."""
        sizes, ids = self.sizes, []
        while at:
            ids.append(token := last[at])
            at -= sizes[token]
        ids.reverse()
        return ids

    def _settled(self, state: dict, last: list[int]) -> int:
        """The latest place where a token ends in every live walk."""
        places = {len(last) - 1 - self.depth[node] for node in state[-1]}
        while len(places) > 1:
            places.remove(far := max(places))
            places.add(far - self.sizes[last[far]])
        return places.pop()

    def encode_piece(self, piece: bytes, chunk: int = 1024) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, known, ids, last = self.start, self.pairs.get, [], [-1]
        for at in range(0, len(piece), chunk):
            for b in piece[at : at + chunk]:
                state, ended = state.get(b) or self._step(state, b)
                place = len(last)
                for token, size in ended:
                    before = last[place - size]
                    fits = known(before + 1 << 32 | token)
                    if fits or fits is None and self.apart(before, token):
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary does not cover every byte")
            if at + chunk < len(piece):
                cut = self._settled(state, last)
                ids += self._back(last, cut)
                del last[:cut]
        return ids + self._back(last, len(last) - 1)


NARROW = 0x250  # below it, stdlib patterns with classes written out are twice as fast


def _splitters(pattern: str):
    """``pattern`` for any text, and for texts of characters below ``NARROW``.

    White space means the Unicode property, as in the pattern's home language, which
    leaves out the ASCII separators that Python's own class takes in.
    """
    full = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")

    def ranges(name: str) -> str:
        inside = regex.compile(rf"\p{{{name}}}").match
        return "".join(f"\\u{c:04x}" for c in range(NARROW) if inside(chr(c)))

    narrow = re.sub(r"\\P\{(\w+)\}", lambda m: f"[^{ranges(m[1])}]", full)
    narrow = re.sub(r"\[\^[^\]]*\\p[^\]]*\]", lambda m: re.sub(r"\\p\{(\w+)\}", lambda n: ranges(n[1]), m[0]), narrow)
    narrow = re.sub(r"\\p\{(\w+)\}", lambda m: f"[{ranges(m[1])}]", narrow)
    return regex.compile(full).findall, re.compile(narrow).findall


class Encoder:
    """Splits a text by the pattern and runs the transducer on each match."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 120_000) -> None:
        self.machine = Transducer(ranks)
        self.split_any, self.split_narrow = _splitters(pattern)
        self.wide = re.compile(f"[^\\x00-\\u{NARROW - 1:04x}]").search
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _new(self, piece: str) -> bytes:
        """A piece missed by the memo of recent pieces; two generations bound that memo."""
        ids = self.older.get(piece)
        if ids is None:
            coded = self.machine.encode_piece(piece.encode("utf-8", "surrogatepass"))
            ids = pack(f"<{len(coded)}I", *coded)
        if len(piece) <= 64:
            if len(self.known) >= self.max_pieces:
                self.older, self.known = self.known, {}
            self.known[piece] = ids
        return ids

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        new, out = self._new, []
        pieces = self.split_any(text) if self.wide(text) else self.split_narrow(text)
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            ids = list(map(self.known.get, part))
            if None in ids:
                ids = [new(p) if i is None else i for i, p in zip(ids, part, strict=True)]
            out += ids
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()


class StreamDecoder:
    """Ids to text, chunk by chunk, by a state machine over UTF-8.

    The state is the incomplete character at the end of what was read: at most three
    bytes. Arcs ``(state, token) -> (text, state)`` are made when first met. A token of whole
    characters leads from the empty state back to it, so a run of such tokens is joined at
    once; the machine steps through the others. A byte that cannot continue gives U+FFFD, as
    does an incomplete character at the end.
    """

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.arcs: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.state = b""
        self.texts = [""] * (max(tokens, default=-1) + 1)
        self.whole = np.zeros(len(self.texts), bool)
        for token, raw in tokens.items():
            try:
                self.texts[token] = raw.decode("utf-8")
                self.whole[token] = True
            except UnicodeDecodeError:
                pass

    @staticmethod
    def _need(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0

    @staticmethod
    def _fits(held: bytes, byte: int) -> bool:
        """May ``byte`` continue the character begun by ``held``?"""
        low, high = 0x80, 0xBF
        if len(held) == 1:
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(held[0], low)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(held[0], high)
        return low <= byte <= high

    def _arc(self, state: bytes, token: int) -> tuple[str, bytes]:
        out, held = [], state
        for b in self.tokens[token]:
            if held and not self._fits(held, b):
                out.append("�")
                held = b""
            if not held and not self._need(b):
                out.append("�")
                continue
            held += bytes((b,))
            if len(held) == self._need(held[0]):
                out.append(held.decode("utf-8"))
                held = b""
        arc = ("".join(out), held)
        if len(self.arcs) < 4096:
            self.arcs.setdefault(state, {})[token] = arc
        return arc

    def feed(self, ids: Iterable[int]) -> str:
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), dtype="i8")
        broken = np.flatnonzero(~self.whole[ids])
        if not self.state and not len(broken):
            return "".join(map(self.texts.__getitem__, ids.tolist()))
        ids, out, at = ids.tolist(), [], 0
        for stop in [*broken.tolist(), len(ids)]:
            while self.state and at < stop:
                out.append(self._move(ids[at]))
                at += 1
            out += map(self.texts.__getitem__, ids[at:stop])
            if stop < len(ids):
                out.append(self._move(ids[stop]))
            at = stop + 1
        return "".join(out)

    def _move(self, token: int) -> str:
        text, self.state = self.arcs.get(self.state, {}).get(token) or self._arc(self.state, token)
        return text

    def finish(self) -> str:
        left, self.state = self.state, b""
        return "�" if left else ""


def _tools(path: str, pattern: str) -> tuple[Encoder, StreamDecoder]:
    """Made by every task for itself, so that a reused worker keeps no memory of them."""
    encoder = Encoder(read_ranks(path), pattern)
    return encoder, StreamDecoder(encoder.machine.tokens)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, ids)`` with the token ids of every whole text as ``array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _tools(vocabulary, pattern)
        for batch in slices(batches):
            raw = [encoder.encode_bytes(t) for t in batch.column("t").to_pylist()]
            ends = np.cumsum([0, *[len(r) // 4 for r in raw]], dtype="i4")
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("k"), ids], names=["k", "ids"])

    df = docs.select(F.col(id_col).alias("k"), F.col(text).alias("t"))
    return df.mapInArrow(run, f"k {dict(df.dtypes)['k']}, ids array<int>").select(F.col("k").alias(id_col), "ids")


def decode(coded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids: str = "ids", chunk: int = 4096) -> DataFrame:
    """``(id, text)`` from ``(id, ids)``, fed to the state machine in chunks; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _tools(vocabulary, pattern)
        for batch in slices(batches):
            texts = []
            for row in batch.column("i"):
                values = [] if row.as_py() is None else row.values.to_numpy(zero_copy_only=False)
                texts.append("".join([decoder.feed(values[k : k + chunk]) for k in range(0, len(values), chunk)]) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(texts, pa.string())], names=["k", "text"])

    df = coded.select(F.col(id_col).alias("k"), F.col(ids).alias("i"))
    return df.mapInArrow(run, f"k {dict(df.dtypes)['k']}, text string").select(F.col("k").alias(id_col), "text")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encode and decode in one pass over each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(vocabulary, pattern)
        for batch in slices(batches):
            counts, coded, decoded = [], [], []
            for t in batch.column("t").to_pylist():
                raw = encoder.encode_bytes(t)
                ids = np.frombuffer(raw, dtype="<u4")
                back = decoder.feed(ids) + decoder.finish()
                counts.append(len(ids))
                coded.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=["k", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    df = docs.select(F.col(id_col).alias("k"), F.col(text).alias("t"))
    out = df.mapInArrow(run, f"k {dict(df.dtypes)['k']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.select(F.col("k").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
