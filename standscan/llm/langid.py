"""Language identification by compression.

Per language, a raw-content zstandard dictionary is filled with training texts in an
order fixed by a hash of their ids, in lower case. A text is cut into blocks, each block is
compressed once with every dictionary, and the language with the fewest bytes in total
is chosen. The margin between the best two, as a share of the best, is the evidence;
``rejected`` marks margins below ``min_margin``.

The fit reads about ``rows_per_lang`` labelled rows of each language, at most twice that
in all. Of a long text it takes ``row_pieces`` pieces of ``PIECE`` characters, chosen by a hash
from the whole text. It fills at most ``dict_bytes`` per language and ``max_total_bytes`` in
all, which bounds what the driver holds and broadcasts.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is
rejected; so is every text if nothing could be learned. Equal sizes go to the language
with more training rows, then the first in alphabetical order. Every text is read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standscan.llm.batches import slices

UNKNOWN = "und"
PIECE = 1024


@dataclass(frozen=True)
class Model:
    """Dictionary content by language, most rows first, and how texts are cut and compressed."""

    content: dict[str, bytes]
    block: int = 4096
    level: int = 6


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = 120, row_pieces: int = 16, dict_bytes: int = 96 << 10, max_total_bytes: int = 32 << 20) -> Model:
    """Learn the dictionaries from rows with a language and a text."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")
    )
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return Model({})
    each = min(dict_bytes, max_total_bytes // len(counts))
    share = F.coalesce(*[F.when(F.col("l") == k, F.lit(min(1.0, rows_per_lang / n))) for k, n in counts.items()])
    order = F.abs(F.xxhash64("k")) / F.lit(float(1 << 63))
    picked = rows.withColumn("o", order).where(F.col("o") < share).select("l", "o", F.lower(_spread("k", "t", row_pieces)).alias("t"))
    content: dict[str, bytearray] = {k: bytearray() for k in counts}
    for row in picked.orderBy("o", "l").limit(2 * rows_per_lang * len(counts)).toLocalIterator():
        if len(content[row["l"]]) < each:
            content[row["l"]] += row["t"].encode("utf-8", "replace") + b"\n"
    return Model({k: bytes(content[k][:each]) for k in sorted(counts, key=lambda k: (-counts[k], k)) if content[k]})


def _spread(key: str, text: str, pieces: int) -> Column:
    """The text itself, or ``pieces`` of its pieces in their order, picked by a hash over all of them."""
    n = F.ceil(F.char_length(text) / PIECE).cast("int")
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(key, i).alias("h"), i.alias("i"))))
    chosen = F.array_sort(F.transform(F.slice(drawn, 1, pieces), lambda x: x["i"]))
    return F.when(n <= pieces, F.col(text)).otherwise(F.array_join(F.transform(chosen, lambda i: F.substring(F.col(text), i * PIECE + 1, F.lit(PIECE))), ""))


class Classifier:
    """One per task; holds the digested dictionaries."""

    def __init__(self, model: Model) -> None:
        self.names = list(model.content)
        self.block = model.block
        self.coders = [
            zstandard.ZstdCompressor(
                level=model.level,
                dict_data=zstandard.ZstdCompressionDict(model.content[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_content_size=False,
                write_dict_id=False,
            )
            for k in self.names
        ]
        self.letter = regex.compile(r"\p{L}").search

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8", "replace")
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return [sum([len(c.compress(b)) for b in blocks]) for c in self.coders]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """``(language, score, margin)``."""
        if text is None or not self.names or not self.letter(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(sizes) == 1:
            return self.names[0], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / max(sizes[best], 1)
        score = 1.0 / sum(math.exp(-min(60.0, (s - sizes[best]) / max(sizes[best], 1) * 40.0)) for s in sizes)
        return self.names[best], score, margin


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", min_margin: float = 0.02, extra: dict[str, Column] | None = None) -> DataFrame:
    """``(id, *extra, lang_pred, score, margin, rejected)`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(sent.value)
        for batch in slices(batches):
            judged = [classifier.judge(t) for t in batch.column("t").to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept,
                    pa.array([j[0] for j in judged], pa.string()),
                    pa.array([j[1] for j in judged], pa.float64()),
                    pa.array([j[2] for j in judged], pa.float64()),
                    pa.array([j[0] == UNKNOWN or j[2] < min_margin for j in judged], pa.bool_()),
                ],
                names=[*names, "p", "s", "m", "r"],
            )

    names = ["k", *[f"x{i}" for i in range(len(extra))]]
    df = docs.select(F.col(id_col).alias("k"), *[c.alias(f"x{i}") for i, c in enumerate(extra.values())], F.col(text).alias("t"))
    kinds = ", ".join(f"{n} {t}" for n, t in df.dtypes[:-1])
    out = df.mapInArrow(run, f"{kinds}, p string, s double, m double, r boolean")
    return out.select(
        F.col("k").alias(id_col), *[F.col(f"x{i}").alias(n) for i, n in enumerate(extra)], F.col("p").alias("lang_pred"), F.col("s").alias("score"), F.col("m").alias("margin"), F.col("r").alias("rejected")
    )
