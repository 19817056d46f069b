"""Deduplication of repeated byte strings with a sparse enhanced suffix array.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is found, across
and within documents, and can be cut.

1. Anchors.  Of the k-byte strings within each window of ``length`` bytes, the one of least hash
   (leftmost of equals) owns the window.  The choice depends on the window's bytes alone, so
   equal windows are owned at the same offset, and only suffixes that start at an anchor need
   comparing: about one in ``(length - k) / 2`` positions.
2. Anchors whose k bytes occur once can't own a repeat and are dropped.
3. The other anchors' suffixes, as long as their windows reach, are sorted within each anchor
   string: an enhanced suffix array with the LCP of neighbours.  A stack scan gives its LCP
   intervals.  In each, members are ordered by what stands before them, read backwards; where
   these left extensions differ, members fall into classes, and those of a class with two
   members or more form a maximal repeat: every member, not only neighbours, gets the span of
   its left extension plus the interval's LCP if that is ``length`` or more.
4. The spans of a document are united.

Anchor strings with over ``max_group`` occurrences aren't sorted in one task: each window they
own is counted by a 128-bit digest instead, with partial sums, which is exact for any number.
The text is shuffled once; both uses read the same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions
from .words import BYTE, U64, chunks, joined, mix, text_bytes

K = 64
_STEPS = mix(np.arange(31, 37, dtype=U64)) | U64(1)


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: text, place, windows it owns (bytes before it of the first and the last
    window's start), and the hash of its K bytes."""
    data, starts = joined(texts)
    empty = np.zeros(0, dtype=np.int64)
    n = len(data)
    if n < length:
        return empty, empty, empty, empty, empty.view(U64)
    h, width = BYTE[data], 1
    for step in _STEPS:
        h = h[:-width] * step + h[width:]
        width *= 2
    h = mix(h)  # of the K bytes from each position on
    key = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    span, have = length - K + 1, 1
    while have * 2 <= span:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if span > have:
        key = np.minimum(key[: len(key) - (span - have)], key[span - have :])
    owner = (key & U64(0xFFFFFFFF)).astype(np.int64)  # of the window that starts here
    valid = np.zeros(n + 1, dtype=np.int64)
    last = starts[1:] - 1 - length  # last window of each text
    fits = last >= starts[:-1]
    valid[starts[:-1][fits]] += 1
    valid[last[fits] + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid)[: len(owner)])
    if not len(at):
        return empty, empty, empty, empty, empty.view(U64)
    own = owner[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = own[1:] != own[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    x = own[head]
    doc = np.searchsorted(starts, x, side="right") - 1
    return doc, x - starts[doc], x - at[head], x - at[tail], h[x]


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(v) for v in values], dtype=np.int64)
    flat = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), dtype=np.uint8)
    return flat.reshape(len(values), width), size


def _common(matrix: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    out = np.empty(len(a), dtype=np.int64)
    for lo in range(0, len(a), 20_000):
        x, y = a[lo : lo + 20_000], b[lo : lo + 20_000]
        differ = matrix[x] != matrix[y]
        first = differ.argmax(axis=1)
        first[~differ[np.arange(len(x)), first]] = matrix.shape[1]
        out[lo : lo + 20_000] = np.minimum(first, np.minimum(size[x], size[y]))
    return out


def lcp_intervals(lcp: list[int], least: int) -> tuple[list[int], list[int], list[int]]:
    """LCP intervals of ``least`` or more by a stack scan: values, first and last suffix.
    ``lcp[i]`` belongs to suffixes i - 1 and i; ``lcp[0]`` is 0."""
    value, left, right = [], [], []
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*lcp, 0]):
        start = i - 1
        while stack and stack[-1][0] > v:
            top, start = stack.pop()
            value.append(top)
            left.append(start)
            right.append(i - 1)
        if v >= least and (not stack or stack[-1][0] < v):
            stack.append((v, start))
    return value, left, right


def repeats(group: np.ndarray, right: list[bytes], left: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes sorted by (group, right): how far each one's repeats of ``length`` or more
    reach before and after it; -1 where there is none.  ``left`` is read backwards."""
    n = len(group)
    before, after = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    if n < 2:
        return before, after
    rights, r_size = _matrix(right, length)
    lefts, l_size = _matrix(left, length - K)
    lcp = np.zeros(n, dtype=np.int64)
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    lcp[same] = _common(rights, r_size, same - 1, same)
    value, lo, hi = (np.array(v, dtype=np.int64) for v in lcp_intervals(lcp.tolist(), K))
    # order of the left extensions within the groups
    order = np.array(sorted(range(n), key=lambda i: left[i]), dtype=np.int64)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    sizes = hi - lo + 1
    done = 0
    while done < len(value):
        upto = max(done + 1, int(np.searchsorted(np.cumsum(sizes[done:]), 300_000)) + done)
        part = np.arange(done, min(upto, len(value)))
        done = int(part[-1]) + 1
        which = np.repeat(part, sizes[part])
        member = np.arange(len(which)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part]) + lo[which]
        by = np.lexsort((rank[member], which))
        which, member = which[by], member[by]
        near = np.flatnonzero(which[1:] == which[:-1]) + 1
        common = np.zeros(len(which) + 1, dtype=np.int64)
        common[near] = _common(lefts, l_size, member[near - 1], member[near])
        best = np.maximum(common[:-1], common[1:])  # with either neighbour in left order
        ok = best + value[which] >= length
        np.maximum.at(before, member[ok], best[ok])
        np.maximum.at(after, member[ok], value[which[ok]])
    return before, after


def _whole_groups(batches):
    """Tables that hold all rows of each value of the first column they have."""
    rest: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if rest and rest[0].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        if len(cut):
            yield pa.Table.from_batches([*rest, batch.slice(0, cut[-1])])
            rest = [batch.slice(cut[-1])]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, max_group: int = 50_000, with_kept: bool = False) -> DataFrame:
    """``(id, n_bytes, spans, n_removed, n_spans, kept_sha256[, kept])``, one row per input row.

    ``spans`` are the maximal runs of bytes (start, end) covered by strings of ``length`` bytes
    that start at two places or more in the input.  Texts are UTF-8 bytes; null counts as empty;
    texts shorter than ``length`` have no spans.  Repeated rows are copies of each other, so all
    of their long texts is covered; nothing stays of either.  They are read once, with their
    number, so any number of them costs no more than one and as many result rows.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    # a row is named by 128 bits of its id and text
    key = ["rk", "rk2"]
    names = [F.xxhash64(id_col, text_col).alias("rk"), F.xxhash64(F.lit(1), text_col, id_col).alias("rk2")]
    source = docs.select(F.col(id_col).alias("id"), *names, F.col(text_col).alias("text"))

    def find(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, x, far, near, h = anchors(text_bytes(part, "text"), length)
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), part.column(0).take(doc), part.column(1).take(doc), pa.array(x.astype(np.int32)), pa.array((far * 65536 + near).astype(np.int32))],
                    names=["f", *key, "x", "ext"],
                )

    found = source.select(*key, "text").mapInArrow(find, "f long, rk long, rk2 long, x int, ext int")
    shared = materialize(found.groupBy("f").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    hot = shared.where(F.col("n") > max_group).limit(1).count() > 0
    placed = (
        found.join(shared.select("f", (F.col("n") > max_group).alias("hot")), "f")
        .groupBy(*key, "hot")
        .agg(F.collect_set(F.struct("x", "ext", "f")).alias("at"))  # repeated rows have the same
    )
    # one row for rows that repeat id and text, combined before the text is shuffled
    base = source.groupBy(*key).agg(F.any_value("id").alias("id"), F.any_value("text").alias("text"), F.count("*").alias("rows"))

    def contexts(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = text_bytes(part, "text")
                at = part.column(4)
                flat, n = at.flatten(), np.diff(at.offsets.to_numpy())
                doc = np.repeat(np.arange(len(texts)), n)
                x, ext, f = (flat.field(i).to_numpy() for i in range(3))
                rights, lefts = [], []
                for d, p, e in zip(doc.tolist(), x.tolist(), ext.tolist(), strict=True):
                    text = texts[d]
                    rights.append(text[p : p - (e & 65535) + length])
                    lefts.append(text[p - (e >> 16) : p][::-1])
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f), part.column(1).take(doc), part.column(2).take(doc), pa.array(x), pa.array(rights, pa.binary()), pa.array(lefts, pa.binary())],
                    names=["f", *key, "x", "right_ext", "left_ext"],
                )

    def scan(batches):
        for table in _whole_groups(batches):
            table = table.combine_chunks()
            before, after = repeats(
                table.column("f").to_numpy(), table.column("right_ext").to_pylist(), table.column("left_ext").to_pylist(), length
            )
            at = np.flatnonzero(after >= 0)
            x = table.column("x").to_numpy().astype(np.int64)[at]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(table.column(k).to_numpy()[at]) for k in key), pa.array(x - before[at]), pa.array(x + after[at])], names=[*key, "start", "end"]
            )

    columns = ["id", *key, "text", "at", "rows"]
    spans = (
        base.join(placed.where("not hot"), key)
        .select(*columns)
        .mapInArrow(contexts, "f long, rk long, rk2 long, x int, right_ext binary, left_ext binary")
        .repartition(parts, "f")
        .sortWithinPartitions("f", "right_ext")
        .mapInArrow(scan, "rk long, rk2 long, start long, end long")
    )
    if hot:

        def windows(batches):
            for batch in batches:
                for part in chunks(batch, "text"):
                    texts = text_bytes(part, "text")
                    start, a, b, own = [], [], [], []
                    for i, at in enumerate(part.column(4).to_pylist()):
                        for one in at:
                            far, near = one["ext"] >> 16, one["ext"] & 65535
                            for p in range(one["x"] - far, one["x"] - near + 1):
                                digest = hashlib.blake2b(texts[i][p : p + length], digest_size=16).digest()
                                own.append(i)
                                start.append(p)
                                a.append(int.from_bytes(digest[:8], "little", signed=True))
                                b.append(int.from_bytes(digest[8:], "little", signed=True))
                    own = pa.array(own, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1).take(own), part.column(2).take(own), pa.array(start, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                        names=[*key, "start", "a", "b"],
                    )

        each = base.join(placed.where("hot"), key).select(*columns).mapInArrow(windows, "rk long, rk2 long, start long, a long, b long")
        again = each.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
        spans = spans.unionByName(
            each.join(again, ["a", "b"], "left_semi").select(*key, "start", (F.col("start") + length).alias("end"))
        )
    gathered = spans.groupBy(*key).agg(F.collect_list(F.struct("start", "end")).alias("at"))

    def cut(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                texts, at, rows = text_bytes(part, "text"), part.column(4).to_pylist(), part.column(5).to_pylist()
                out_spans, removed, n_spans, digests, kept = [], [], [], [], []
                for text, own, n in zip(texts, at, rows, strict=True):
                    found = sorted((o["start"], o["end"]) for o in own or ())
                    if n > 1 and len(text) >= length:
                        found = [(0, len(text))]
                    merged: list[list[int]] = []
                    for s, e in found:
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    rest, last = [], 0
                    for s, e in merged:
                        rest.append(text[last:s])
                        last = e
                    rest.append(text[last:])
                    body = b"".join(rest)
                    out_spans.append([{"start": s, "end": e} for s, e in merged])
                    removed.append(len(text) - len(body))
                    n_spans.append(len(merged))
                    digests.append(hashlib.sha256(body).hexdigest())
                    kept.append(body)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                arrays = [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(out_spans, kind), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
                if with_kept:
                    arrays.append(pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays([*arrays, part.column(1), part.column(5)], names=schema.names)

    schema = docs.select(id_col).schema
    for name, kind in (("n_bytes", "long"), ("spans", "array<struct<start:bigint,end:bigint>>"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        schema = schema.add(name, _type(kind))
    if with_kept:
        schema = schema.add("kept", "binary")
    columns_out = schema.names
    schema = schema.add("suffix_row_key", "long").add("suffix_rows", "long")
    found = base.join(gathered, key, "left").select(*columns).mapInArrow(cut, schema)
    # as many rows as came in: a thousand at a time, dealt over tasks
    most = F.lit(1000).cast("long")
    every = found.withColumn("suffix_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("suffix_rows") - 1) / most))))
    every = every.repartition(parts, "suffix_row_key", "suffix_part")
    return every.withColumn("suffix_part", F.explode(F.sequence(F.col("suffix_part") * most, F.least("suffix_rows", (F.col("suffix_part") + 1) * most) - 1))).select(*columns_out)


def _type(ddl: str):
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    if ddl.startswith("array"):
        return ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    return LongType() if ddl == "long" else StringType()
