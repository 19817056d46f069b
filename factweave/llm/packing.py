"""Vector best-fit packing of tokenized documents into sequences.

A bin has three capacities: tokens, documents (pieces) and attention cost (the sum of squared
lengths).  Pieces are placed longest first; each goes to the open bin that scores best, by the
least weighted norm of what is left or the largest weighted dot product of demand and residual,
among those with room under every constraint; if none has, a bin is opened.

What a piece asks for depends on its length alone, so equal lengths form classes and bins with
equal residuals form groups, and the whole plan follows from how many pieces there are of each
length: at most ``max_tokens`` numbers.  The driver plans on those; the plan says which ranks of
a length go to which bins, and its size is bounded by the capacities, not by the input.  Each
piece's rank among its length is counted in shards of the ids, so no length is ever in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions
from .words import chunks, text_bytes

_TOKENIZERS: dict = {}


_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,]?)").fullmatch
_PLAIN_LETTERS = [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]


class WordTokenizer(dict):
    """Ids of whole texts by a lower-case vocabulary whose pre-tokenizer never crosses white
    space and parts letters from what follows them.

    A memo of the words between ASCII white space: each is encoded when first asked for and
    kept as little-endian bytes; it is emptied at ``max_words``, which bounds memory only.
    Plain words, which are lower-case Latin letters and perhaps a full stop or comma, need no
    normalizer and go to the merges directly; all others go through the whole tokenizer."""

    def __init__(self, path: str, max_words: int = 100_000) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner, self.max_words = Tokenizer.from_file(path), max_words
        self.merge = self.inner.model.tokenize
        split = self.inner.pre_tokenizer.pre_tokenize_str
        self.letters = {c: split(chr(c))[0][0] for c in _PLAIN_LETTERS}
        if [x for x, _ in split("ab.")] != ["ab", split(".")[0][0]]:
            raise ValueError("the vocabulary's pre-tokenizer doesn't part letters from stops")
        self.stops = {x: self._ids(self.merge(split(x)[0][0])) if x else b"" for x in ("", ".", ",")}

    @staticmethod
    def _ids(tokens) -> bytes:
        return array("I", [t.id for t in tokens]).tobytes()

    def __missing__(self, raw: bytes) -> bytes:
        if len(self) >= self.max_words:
            self.clear()
        word = raw.decode("utf-8", "replace")
        plain = _PLAIN(word)
        if plain is None:
            ids = array("I", self.inner.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            ids = self._ids(self.merge(plain[1].translate(self.letters))) + self.stops[plain[2]]
        self[raw] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        # only its special tokens' strings are more than their lower case to the vocabulary
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def plan(
    counts: np.ndarray,
    max_tokens: int,
    max_docs: int,
    max_attention: int,
    score: str = "residual",
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
) -> np.ndarray:
    """Steps (length, first rank, pieces, first bin, pieces per bin, offset) for ``counts[L]``
    pieces of each length L.  Within a step, piece j goes to bin ``first + j // per_bin`` at
    ``offset + (j % per_bin) * L``."""
    caps = np.array([max_tokens, max_docs, max_attention], dtype=np.float64)
    w = np.array(weights)
    left = np.zeros((0, 3), dtype=np.int64)
    bins = np.zeros(0, dtype=np.int64)
    first = np.zeros(0, dtype=np.int64)
    steps: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    for length in range(len(counts) - 1, 0, -1):
        todo, rank = int(counts[length]), 0
        if not todo:
            continue
        demand = np.array([length, 1, length * length], dtype=np.int64)
        fits = np.flatnonzero((left >= demand).all(axis=1))
        rest = (left[fits] - demand) / caps
        if score == "residual":
            by = np.argsort((w * rest**2).sum(axis=1), kind="stable")
        else:
            by = np.argsort(-(w * (demand / caps) * (left[fits] / caps)).sum(axis=1), kind="stable")
        made: list[tuple[np.ndarray, int, int]] = []
        for g in fits[by]:
            if not todo:
                break
            per = int((left[g] // demand).min())
            take = min(todo, per * int(bins[g]))
            full, odd = divmod(take, per)
            steps.append((length, rank, take, int(first[g]), per, max_tokens - int(left[g][0])))
            rank, todo = rank + take, todo - take
            before, start, n = left[g].copy(), int(first[g]), int(bins[g])
            used = full + bool(odd)
            if full:
                made.append((before - per * demand, full, start))
            if odd:
                made.append((before - odd * demand, 1, start + full))
            bins[g], first[g] = n - used, start + used
        if todo:
            per = int((caps.astype(np.int64) // demand).min())
            if per < 1:
                raise ValueError(f"a piece of {length} tokens fits no empty bin")
            full, odd = divmod(todo, per)
            steps.append((length, rank, todo, opened, per, 0))
            if full:
                made.append((caps.astype(np.int64) - per * demand, full, opened))
            if odd:
                made.append((caps.astype(np.int64) - odd * demand, 1, opened + full))
            opened += full + bool(odd)
        if made:
            left = np.concatenate([left, np.stack([m[0] for m in made])])
            bins = np.concatenate([bins, np.array([m[1] for m in made], dtype=np.int64)])
            first = np.concatenate([first, np.array([m[2] for m in made], dtype=np.int64)])
        alive = (bins > 0) & (left > 0).all(axis=1)
        left, bins, first = left[alive], bins[alive], first[alive]
    return np.array(steps, dtype=np.int64).reshape(-1, 6)


def tokenize(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, max_tokens: int, end_id: int) -> DataFrame:
    """The pieces of every document: (id, piece, start, length, ids_crc32)."""
    schema = docs.select(id_col).schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        schema = schema.add(name, kind)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encode = tokenizer(vocabulary).encode
        for batch in batches:
            for part in chunks(batch, text_col):
                at, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(text_bytes(part, text_col)):
                    ids = encode(text) + end
                    for p, lo in enumerate(range(0, len(ids), 4 * max_tokens)):
                        own = ids[lo : lo + 4 * max_tokens]
                        at.append(i)
                        piece.append(p)
                        start.append(lo // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=schema.names,
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 4096,
    max_docs: int | None = None,
    max_attention: int | None = None,
    end_id: int = 1,
    score: str = "residual",
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A document's ids are its text's, without special tokens, and ``end_id``; only documents of
    over ``max_tokens`` ids are cut.  A null or empty text is the end id alone.  Without
    ``max_docs`` and ``max_attention`` these bind no more than the tokens do.  Rows are packed
    one by one, so repeated rows and null ids are packed as often as they occur.
    """
    spark = docs.sparkSession
    max_docs = max_tokens if max_docs is None else max_docs
    max_attention = max_tokens * max_tokens if max_attention is None else max_attention
    shards = partitions(spark)
    pieces = tokenize(docs, vocabulary, id_col, text_col, max_tokens, end_id)
    pieces = materialize(
        pieces.withColumn("shard", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(shards * 4)).cast("int")), "pieces"
    )
    per_shard = pieces.groupBy("shard", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(max_tokens + 1, dtype=np.int64)
    for r in per_shard.groupBy("length").agg(F.sum("n").alias("n")).collect():  # max_tokens rows at most
        counts[r["length"]] = r["n"]
    steps = spark.sparkContext.broadcast(plan(counts, max_tokens, max_docs, max_attention, score, weights))
    base = per_shard.select(
        "shard", "length",
        F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    within = Window.partitionBy("shard", "length").orderBy(id_col, "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("row", F.row_number().over(within))
        .join(base, ["shard", "length"])
        .select(id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("row") - 1).alias("rank"))
    )
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        s = steps.value
        bounds = np.searchsorted(-s[:, 0], -np.arange(max_tokens + 2), side="left")  # lengths descend
        ends = np.searchsorted(-s[:, 0], -np.arange(max_tokens + 2), side="right")
        for batch in batches:
            length = batch.column(3).to_numpy().astype(np.int64)
            rank = batch.column(5).to_numpy().astype(np.int64)
            step = np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                step[at] = bounds[n] + np.searchsorted(s[bounds[n] : ends[n], 1], rank[at], side="right") - 1
            j = rank - s[step, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(s[step, 3] + j // s[step, 4]), pa.array(s[step, 5] + (j % s[step, 4]) * length)],
                names=schema.names,
            )

    return ranked.mapInArrow(place, schema)
