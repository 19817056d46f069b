"""Product codes of vectors by Lloyd rounds with Elkan's bounds, in integers throughout.

A vector's components are scaled to integers and cut into equal parts; each part position has a
codebook.  The table of vectors carries, per part, the entry it is assigned to, an upper bound of
the distance to it and one lower bound per entry, and is written anew in each round:

* An entry's movement is added to the upper bound and taken from the lower bound, so both hold
  without a distance being computed.
* An entry is passed over if its lower bound, or half its distance from the assigned entry, lies
  strictly above the upper bound: it is then strictly farther and cannot even tie.
* Every other entry is compared by its exact squared distance, then by index.

Bounds are integers, rounded to their safe side, in ``1 / SCALE`` of a component's unit; a lower
bound is one byte, counted in steps that the first codebook's extent gives.

Scale: a round reads and writes the vectors once, without a shuffle; tasks send sums per part and
entry, combined by Spark.  Codebooks, of ``entries`` times the dimension in size, are all that
reaches the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import discard, lookup, materialize

#: Components from this size on (before they are scaled) don't fit the squared distances.
LIMIT = 1 << 18
SCALE = 4


def _lower(d2: np.ndarray) -> np.ndarray:
    """At most the root of a squared distance, in bound units."""
    return np.maximum(np.floor(np.sqrt(d2.astype(np.float64)) * SCALE).astype(np.int64) - 1, 0)


def _upper(d2: np.ndarray) -> np.ndarray:
    """At least the root of a squared distance, in bound units."""
    return np.ceil(np.sqrt(d2.astype(np.float64)) * SCALE).astype(np.int64) + 1


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def reassign(x: np.ndarray, book: np.ndarray, assigned: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One part of many vectors: the nearest entry and new bounds of each, and how many distances
    were computed.  ``lower`` has a column per entry; bounds must hold for ``book``."""
    half = _lower(squared(book[:, None, :], book[None, :, :]))  # twice the bound, against twice the upper one
    others = np.arange(len(book)) != assigned[:, None]
    # strictly: what may tie is compared
    open_ = np.flatnonzero((others & (lower <= upper[:, None]) & (half[assigned] <= 2 * upper[:, None])).any(axis=1))
    best, upper, lower = assigned.copy(), upper.copy(), lower.copy()
    if not len(open_):
        return best, upper, lower, 0
    own, far, near, part = assigned[open_], upper[open_], lower[open_], x[open_]
    best_d = squared(part, book[own])
    far = _upper(best_d)
    near[np.arange(len(own)), own] = _lower(best_d)
    done = len(own)
    for c in range(len(book)):
        at = np.flatnonzero((near[:, c] <= far) & (half[own, c] <= 2 * far) & (own != c))
        if not len(at):
            continue
        d = squared(part[at], book[c])
        done += len(at)
        near[at, c] = _lower(d)
        better = (d < best_d[at]) | ((d == best_d[at]) & (c < own[at]))
        at, d = at[better], d[better]
        own[at], best_d[at], far[at] = c, d, _upper(d)
    best[open_], upper[open_], lower[open_] = own, far, near
    return best, upper, lower, done


def _step(book: np.ndarray) -> int:
    """The unit of a byte's lower bounds: the codebook's extent has 128 of them."""
    return max(1, int(_upper(squared(book[:, None, :], book[None, :, :]).max())) // 128)


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    factor: int = 256,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``(id, code, error, label_error, codebooks_sha256)``, one row per kept vector, and the
    codebooks, one array of entries per part.

    Rows go whose vector is null, empty, or holds a null, NaN, infinite or, in absolute value, from
    ``LIMIT`` on too large component; so do vectors that are not as long as that of the smallest
    id.  Each component is ``floor(factor * x)``; vectors are padded with zeros to equal parts.
    Codebooks start from the ``entries`` smallest ids (null ids last, rows of one id by their
    vectors; fewer rows give fewer entries), and equal entries stay apart, of which the first one
    serves.  Each round assigns every part to its nearest entry, ties to the lower index, and moves
    each used entry to the floor of its parts' mean.  ``code`` is two hexadecimal digits per part
    after a last assignment, ``error`` the sum of squared distances, ``label_error`` its sum over
    the rows of one label, null labels together (null if it exceeds 64 bits).  Repeated rows count
    each.  An empty table gives an empty result and codebooks without entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hexadecimal digits")
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < LIMIT))
    )
    ints = kept.select("id", "label", F.transform("v", lambda x: F.floor(x * factor).cast("long")).alias("v"))
    first = ints.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        out = kept.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return out, [np.zeros((0, 0), dtype=np.int64)] * parts
    dim = len(first[0]["v"])
    width = -(-dim // parts)
    ints = ints.where(F.size("v") == dim)
    start = ints.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    whole = np.zeros((len(start), parts * width), dtype=np.int64)
    whole[:, :dim] = [r["v"] for r in start]
    books = [b.copy() for b in whole.reshape(len(start), parts, width).transpose(1, 0, 2)]
    steps = [_step(b) for b in books]
    moved = [np.zeros(len(start), dtype=np.int64) for _ in books]
    n = len(start)

    def assign(books: list, moved: list, fresh: bool, last: bool):
        """A round over batches of ``(id, label, v[, codes, upper, lower])``: the vectors with their
        bounds and errors, and at the end of a task its sums as rows of part and entry."""
        no_bound = np.int64(1) << np.int64(60)

        def run(batches):
            sums = np.zeros((parts, n, width), dtype=np.int64)
            counts = np.zeros((parts, n), dtype=np.int64)
            for many in batches:
                for at in range(0, many.num_rows, 2000):
                    batch = many.slice(at, 2000)
                    rows = batch.num_rows
                    x = np.zeros((rows, parts * width), dtype=np.int64)
                    x[:, :dim] = batch.column(2).flatten().to_numpy().reshape(rows, dim)
                    x = x.reshape(rows, parts, width)
                    codes = np.zeros((rows, parts), dtype=np.uint8)
                    upper = np.full((rows, parts), no_bound)
                    lower = np.zeros((rows, parts, n), dtype=np.uint8)
                    error = np.zeros(rows, dtype=np.int64)
                    if not fresh:
                        had = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=t) for c, t in ((3, np.uint8), (4, np.int64), (5, np.uint8))]
                        codes, upper, lower = had[0].reshape(rows, parts), had[1].reshape(rows, parts), had[2].reshape(rows, parts, n)
                    new = []
                    for p in range(parts):
                        old = codes[:, p].astype(np.int64)
                        far, near = upper[:, p], lower[:, p].astype(np.int64) * steps[p]
                        best, far, near, _ = reassign(x[:, p], books[p], old, far + moved[p][old], np.maximum(near - moved[p], 0))
                        if last:
                            error += squared(x[:, p], books[p][best])
                        np.add.at(sums[p], best, x[:, p])
                        counts[p] += np.bincount(best, minlength=n)
                        new.append((best.astype(np.uint8), far, np.minimum(near // steps[p], 255).astype(np.uint8)))
                    packed = [np.stack([one[i] for one in new], axis=1) for i in range(3)]
                    as_bytes = [pa.array([r.tobytes() for r in one], pa.binary()) for one in packed]
                    none = [pa.nulls(rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *as_bytes, pa.array(error), *none], names=names)
            p, e = np.nonzero(counts)
            none = [pa.nulls(len(p), t) for t in (id_type, label_type, pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64())]
            made = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, *made], names=names)

        return run

    id_type, label_type = (to_arrow_type(ints.schema[c].dataType) for c in ("id", "label"))
    schema = StructType(list(ints.schema.fields))
    for name, kind in (("codes", "binary"), ("upper", "binary"), ("lower", "binary"), ("error", "long"), ("part", "integer"), ("entry", "integer"), ("n", "long")):
        schema = schema.add(name, kind)
    schema = schema.add("sums", ArrayType(LongType()))
    names = schema.names
    state, rows = None, ints
    for i in range(rounds + 1):
        made = materialize(rows.mapInArrow(assign(books, moved, state is None, i == rounds), schema), f"vector-round-{i}")
        if state is not None:
            discard(state)
        state = made
        rows = state.where("part is null").select("id", "label", "v", "codes", "upper", "lower")
        if i == rounds:
            break
        sums = state.where("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
        before = [b.copy() for b in books]
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
            books[r["part"]][r["entry"], r["at"]] = r["x"] // r["n"]
        moved = [_upper(squared(a, b)) * (a != b).any(axis=1) for a, b in zip(before, books, strict=True)]

    told = ",".join(str(x) for b in books for x in b.ravel().tolist())
    coded = state.where("part is null").select("id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    errors = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    found = lookup(coded, materialize(errors, "label-errors"), "label", "n")
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(hashlib.sha256(told.encode()).hexdigest()).alias("codebooks_sha256")), books
