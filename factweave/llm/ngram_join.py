"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix
filters; candidates are verified once per pair, and linked documents form components.

1. Each document becomes the set of its distinct word n-grams (64-bit hashes).  Documents with
   one set form a class; classes are joined from then on.
2. N-grams are ordered rare first.  The order needs frequencies only as a consistent ranking,
   so they are counted in ``1 << freq_bits`` hash buckets over all documents: a table of fixed
   size.  Two sets that reach the threshold share an n-gram within their prefixes.
3. Postings of prefix n-grams that occur at least twice are grouped by n-gram.  In such a list
   the length filter, the positional filter (the n-gram taken as the first shared one) and the
   suffix filter (sets are dealt to 256 cells by hash; the cell counts bound the symmetric
   difference from below) leave hardly any pair that isn't linked.
4. A list yields, for each class, its first surviving partner and the nearest by
   cells, and over all lists a class
   keeps two partners (it may be one of others'): never all pairs.  Those pairs are verified on whole sets,
   components are formed, and the same is done once more with partners in other components.  Then every surviving
   pair of a list whose classes are still in different components is verified too, so no link
   that could join two components is missed, and pairs inside a component need no check.

Skew: lists longer than ``list_rows`` are dealt into blocks (by hash in step one, as pairs of
blocks in step two); stars around one class are dealt over tasks by degree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, partitions
from .words import U64, chunks, joined, mix, text_bytes, word_hashes, word_spans

CELLS = 256
SHIFTS = 32


def ngram_sets(texts: list[bytes], k: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, and the bounds of each text in them.

    Fewer words than ``k`` count as one n-gram of all words; no words give an empty set.  With
    ``rank``, a permutation of the hashes' leading bits, n-grams are sorted by that rank, then
    hash; they come out with the rank in place of those bits, which names them as well."""
    data, starts = joined(texts)
    first, last, at = word_spans(data, starts)
    words = word_hashes(data, first, last)
    n = np.diff(at)
    out_n = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(out_n, out=bounds[1:])
    begin = np.repeat(at[:-1] - bounds[:-1], out_n) + np.arange(bounds[-1])
    steps = mix(np.arange(11, 11 + k, dtype=U64)) | U64(1)
    padded = np.append(words, np.zeros(k, dtype=U64))
    rolled = np.zeros(len(words), dtype=U64)
    for j in range(k):
        rolled += mix(padded[j : j + len(words)] * steps[j])
    grams = rolled[begin] if len(begin) else np.zeros(0, dtype=U64)
    for i in np.flatnonzero((n > 0) & (n < k)):  # all words of a short text
        whole = mix(words[at[i] : at[i + 1]] * steps[: n[i]]).sum(dtype=U64)
        grams[bounds[i]] = whole + U64(k - n[i])
    grams = mix(grams)
    if rank is not None:
        shift = U64(64 - int(len(rank) - 1).bit_length())
        grams = (rank[(grams >> shift).astype(np.int64)] << shift) | (grams & ((U64(1) << shift) - U64(1)))
    new = np.ones(len(grams), dtype=bool)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        grams[lo:hi].sort()
    new[1:] = grams[1:] != grams[:-1]
    new[bounds[:-1][out_n > 0]] = True
    total = np.zeros(len(grams) + 1, dtype=np.int64)
    np.cumsum(new, out=total[1:])
    return grams[new], total[bounds]


def _classes(grams: np.ndarray, bounds: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit name of each set.  ``back`` undoes the ranks of ``ngram_sets``."""
    if back is not None:
        shift = U64(64 - int(len(back) - 1).bit_length())
        grams = (back[(grams >> shift).astype(np.int64)] << shift) | (grams & ((U64(1) << shift) - U64(1)))
    n = np.diff(bounds)
    out = mix(n.astype(U64) + U64(77))
    full = np.flatnonzero(n)
    if len(full):
        sums = np.add.reduceat(mix(grams ^ U64(0xA5A5A5A55A5A5A5A)), bounds[:-1][full])
        out[full] = mix(out[full] + sums)
    return out.view(np.int64)


def _cells(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many n-grams of each set fall in each cell, at most 255 (which keeps the bound valid)."""
    n = np.diff(bounds)
    at = np.repeat(np.arange(len(n)), n) * CELLS + (grams & U64(CELLS - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=len(n) * CELLS), 255).astype(np.uint8).reshape(-1, CELLS)


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(n > 0, n - (n * num + den - 1) // den + 1, 0)


def least_overlap(a, b, num: int, den: int):
    """The smallest intersection at which sets of these sizes are linked."""
    return (num * (a + b) + den + num - 1) // (den + num)


def apart(a, b, i, j, cells_a, cells_b, num: int, den: int) -> np.ndarray:
    """For arrays of pairs: -1 where the length, positional or suffix filter excludes a link,
    else the least possible symmetric difference by cells, in thousandths of both sizes."""
    a, b = np.broadcast_arrays(a, b)
    need = least_overlap(a, b, num, den)
    ok = (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (1 + np.minimum(a - i - 1, b - j - 1) >= need)
    out = np.full(len(ok), -1, dtype=np.int64)
    at = np.flatnonzero(ok)
    if len(at):
        ca = cells_a if cells_a.ndim == 1 else cells_a[at]
        least = np.abs(ca.astype(np.int16) - cells_b[at]).sum(axis=1, dtype=np.int64)
        size = a[at] + b[at]
        fits = least <= size - 2 * need[at]
        out[at[fits]] = 1000 * least[fits] // size[fits]
    return out


def _lists(batches, keys: int):
    """Column arrays of whole runs of equal values in the first ``keys`` columns, in order."""
    rest: list = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        differs = np.zeros(batch.num_rows, dtype=bool)
        for c in key:
            differs[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(differs)
        if rest and any(rest[0].column(c)[0].as_py() != key[c][0] for c in range(keys)):
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = []
        if len(cut):
            rest.append(batch.slice(0, cut[-1]))
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = [batch.slice(cut[-1])]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _num(table: pa.Table, c: str) -> np.ndarray:
    return table.column(c).to_numpy()


def _pairs_of_lists(batches, num: int, den: int, all_pairs: bool):
    """Surviving pairs (a, b, apart) of two components in each list.  With ``all_pairs`` every
    pair, named once (and, for a list dealt in two blocks, across the blocks).  Else for each
    class its first and its nearest partner; in a long list, the nearest of ``SHIFTS`` others in
    an order that changes from list to list, so over its lists a class meets many."""
    keys = 3
    for table in _lists(batches, keys):
        gram = _num(table, "gram")
        n, pos, cls = _num(table, "n").astype(np.int64), _num(table, "pos").astype(np.int64), _num(table, "cls")
        cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), dtype=np.uint8).reshape(-1, CELLS)
        comp, side = _num(table, "component"), _num(table, "side")
        differs = np.zeros(len(n), dtype=bool)
        for c in range(keys):
            key = table.column(c).to_numpy()
            differs[1:] |= key[1:] != key[:-1]
        begin = np.append(0, np.flatnonzero(differs))
        size = np.diff(np.append(begin, len(n)))

        def meet(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ok = (comp[x] != comp[y]) & ((side[x] != side[y]) | (side[x] == 2))
            x, y = x[ok], y[ok]
            far = apart(n[x], n[y], pos[x], pos[y], cells[x], cells[y], num, den)
            return x[far >= 0], y[far >= 0], far[far >= 0]

        out: list = []
        short = np.flatnonzero((size >= 2) & (size <= 24))
        if len(short):  # short lists together
            m = size[short]
            combos = m * (m - 1) // 2
            total = int(combos.sum())
            lst = np.repeat(np.arange(len(short)), combos)
            within = np.arange(total) - np.repeat(np.cumsum(combos) - combos, combos)
            # pair number -> (x, y) with x < y, by y
            y = ((1 + np.sqrt(1 + 8 * within.astype(np.float64))) / 2).astype(np.int64)
            y -= (y * (y - 1) // 2 > within).astype(np.int64)
            x = within - y * (y - 1) // 2
            ax, ay = begin[short][lst] + x, begin[short][lst] + y
            for lo in range(0, total, 50_000):
                px, py, far = meet(ax[lo : lo + 50_000], ay[lo : lo + 50_000])
                if all_pairs:
                    out.append((cls[px], cls[py], far))
                elif len(py):
                    _, one = np.unique(py, return_index=True)  # pairs come by y, then x
                    out.append((cls[px[one]], cls[py[one]], far[one]))
                    one = _least(py, far)
                    out.append((cls[px[one]], cls[py[one]], far[one]))
                if all_pairs and sum(len(o[0]) for o in out) > 200_000:
                    yield _batch(out)
                    out = []
        for g in np.flatnonzero(size > 24):
            rows = np.arange(begin[g], begin[g] + size[g])
            if not all_pairs:
                rows = rows[np.argsort(mix((cls[rows] ^ gram[begin[g]]).view(U64)))]
                got = [meet(rows[d:], rows[:-d]) for d in range(1, min(SHIFTS, len(rows) - 1) + 1)]
                px, py, far = (np.concatenate([o[i] for o in got]) for i in range(3))
                if len(px):
                    one = _least(px, far)
                    out.append((cls[py[one]], cls[px[one]], far[one]))
                continue
            step = max(1, 20_000 // len(rows))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                px, py = np.repeat(some, len(rows)), np.tile(rows, len(some))
                px, py, far = meet(px[px < py], py[px < py])
                out.append((cls[px], cls[py], far))
                if sum(len(o[0]) for o in out) > 200_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)


def _least(key: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Of each key, where its least distance is."""
    by = np.lexsort((far, key))
    return by[np.append(True, key[by][1:] != key[by][:-1])] if len(by) else by


def _batch(out: list) -> pa.RecordBatch:
    """Distinct pairs with the smaller name first."""
    a, b, far = (np.concatenate([o[i] for o in out]) for i in range(3))
    a, b = np.minimum(a, b), np.maximum(a, b)
    by = np.lexsort((far, b, a))
    a, b, far = a[by], b[by], far[by]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(far[new].astype(np.int32))], names=["a", "b", "far"])


def _verify(batches, num: int, den: int):
    """Stars come as (a, salt, own, b, grams) with the centre first: its links."""
    centre, name = None, None
    for batch in batches:
        a, salt = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        own, b, grams = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
        found_a, found_b = [], []
        for i in range(batch.num_rows):
            values = np.frombuffer(grams[i].as_buffer(), dtype=U64)
            if own[i] == 0:
                centre, name = values.copy(), (a[i], salt[i])
            elif name == (a[i], salt[i]):
                shared = len(np.intersect1d(centre, values, assume_unique=True))
                if den * shared >= num * (len(centre) + len(values) - shared):
                    found_a.append(a[i])
                    found_b.append(b[i])
        yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: tuple[int, int] = (80, 100),
    freq_bits: int = 16,
    list_rows: int = 2000,
    star_rows: int = 2000,
    broadcast_ids: int = 2_000_000,
) -> DataFrame:
    """``(id, row_key, n_shingles, component_id, kept)``, one row per input row.

    Texts are lower-cased A-Z and cut into words at space and tab to carriage return.  Two
    documents are linked if the Jaccard similarity of their sets is at least ``threshold``;
    ``component_id`` is the smallest id that links lead to, the own one included.  A null,
    empty or wordless text has an empty set and links with nothing: its component is its own
    id.  Null ids are never the smallest; a component of null ids only has a null id.
    ``kept`` marks the row of the smallest id of each component, and every row without words.
    ``row_key`` tells rows apart whose ids repeat.  Of documents with one and the same set the row
    of the smallest id, then of the smallest ``row_key``, stands for them; rows that repeat both id
    and text have one ``row_key`` and are all marked as kept if one is.
    """
    num, den = threshold
    spark = docs.sparkSession
    n_buckets = 1 << freq_bits
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))

    # 1. sets: names, cells, and n-gram counts in buckets
    def describe(batches):
        counts = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                grams, bounds = ngram_sets(text_bytes(part, "text", lower=True), k)
                counts += np.bincount((grams >> U64(64 - freq_bits)).astype(np.int64), minlength=n_buckets)
                n = np.diff(bounds)
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(_classes(grams, bounds)),
                     pa.array([c.tobytes() for c in _cells(grams, bounds)], pa.binary()),
                     pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())],
                    names=names,
                )
        at = np.flatnonzero(counts)
        none = [pa.nulls(len(at), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at.astype(np.int32)), pa.array(counts[at])], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    names = ["id", "row_key", "n", "cls", "cells", "bucket", "count"]
    schema = source.select("id").schema
    for name, kind in zip(names[1:], ("long", "long", "long", "binary", "integer", "long"), strict=True):
        schema = schema.add(name, kind)
    described = materialize(source.mapInArrow(describe, schema), "ngram-sets")
    sets = described.where("bucket is null").select("id", "row_key", "n", "cls", "cells")
    freq = np.zeros(n_buckets, dtype=np.int64)
    for r in described.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("count")).collect():
        freq[r["bucket"]] = r["count"]
    rarest = np.argsort(freq, kind="stable").astype(U64)  # bucket of each rank
    rank = np.empty(n_buckets, dtype=U64)
    rank[rarest.astype(np.int64)] = np.arange(n_buckets, dtype=U64)
    shared_rank = spark.sparkContext.broadcast((rank, rarest))  # n_buckets numbers each
    classes = sets.where("n > 0").groupBy("cls").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")).alias("least"), F.min("row_key").alias("row_key"), F.min("n").alias("n"), F.min("cells").alias("cells")
    )

    # 2. postings of prefix n-grams, kept where at least two rows have the n-gram
    def postings(batches):
        own, back = shared_rank.value
        for batch in batches:
            for part in chunks(batch, "text"):
                grams, bounds = ngram_sets(text_bytes(part, "text", lower=True), k, own)
                n = np.diff(bounds)
                pos = np.arange(len(grams)) - np.repeat(bounds[:-1], n)
                keep = pos < np.repeat(prefix_length(n, num, den), n)
                cls = np.repeat(_classes(grams, bounds, back), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[keep].view(np.int64)), pa.array(cls[keep]), pa.array(np.repeat(n, n)[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))],
                    names=["gram", "cls", "n", "pos"],
                )

    posted = source.select("text").mapInArrow(postings, "gram long, cls long, n int, pos int")
    twice = posted.groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1").select("gram")
    lists = posted.join(twice, "gram", "left_semi").groupBy("gram", "cls").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    lists = materialize(lists, "ngram-lists")
    sizes = lists.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    cells = classes.select("cls", "cells")

    lists = lists.join(sizes, "gram").select(lists.columns)

    def candidates(components: DataFrame | None, all_pairs: bool) -> DataFrame:
        """Pairs of lists whose classes are not all in one component yet.  A long list is dealt
        into blocks by hash; for ``all_pairs`` each block meets each other one."""
        where = lists.withColumn("component", F.col("cls"))
        if components is not None:
            where = lists.join(components.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", F.col("cls")))
        mixed = where.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo < hi")
        blocks = F.ceil(F.col("m") / list_rows).cast("int")
        dealt = where.join(mixed.select("gram", blocks.alias("blocks")), "gram").withColumn(
            "own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("cls", "gram"), F.col("blocks")).cast("int")).otherwise(0)
        )
        # in one block all pairs count (side 2); of two blocks only pairs across (sides 0 and 1)
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if all_pairs else F.col("own")
        dealt = dealt.withColumn("other", other).withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
        dealt = (
            dealt.join(cells, "cls")
            .select("gram", F.least("own", "other").alias("block"), F.greatest("own", "other").alias("block2"), "n", "cls", "pos", "cells", "component", "side")
            .repartition(partitions(spark), "gram", "block", "block2")
            .sortWithinPartitions("gram", "block", "block2", "n", "cls")
        )
        return dealt.mapInArrow(lambda b: _pairs_of_lists(b, num, den, all_pairs), "a long, b long, far int")

    # 3. a forest of candidates, twice: partners in other components, two for a class, which has
    # some in each of many lists
    checked = links = components = None
    for turn in (1, 2):
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        first = (
            candidates(components, False).select("far", F.explode(ways).alias("p")).select("p.a", "p.b", "far")
            .groupBy("b").agg(F.min("a").alias("lo"), F.min_by("a", F.struct("far", "a")).alias("near"))
            .select(F.explode(F.array_distinct(F.array("lo", "near"))).alias("a"), "b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        pairs = materialize(first, f"candidates-{turn}")
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        found = _checked(source, classes, pairs, k, num, den, star_rows, broadcast_ids, f"links-{turn}")
        checked = pairs if checked is None else checked.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        components = connected_components(links)

    # 4. whatever could still join two components; a pair is in many lists, so it is made
    # distinct before it is compared with those checked already
    more = materialize(candidates(components, True).select("a", "b").distinct(), "candidates-3").join(checked, ["a", "b"], "left_anti")
    if more.limit(1).count():
        found = _checked(source, classes, more, k, num, den, star_rows, broadcast_ids, "links-3")
        if found.limit(1).count():
            components = connected_components(links.unionByName(found))

    # 5. ids
    named = classes.select("cls", "least").join(components.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", F.col("cls"))
    )
    least = named.groupBy("component").agg(F.min("least").alias("least_of_all"))
    named = named.join(least, "component").select(F.col("cls").alias("join_cls"), "least_of_all")
    return (
        sets.withColumn("join_cls", F.when(F.col("n") > 0, F.col("cls")))
        .join(named, "join_cls", "left")
        .select(
            F.col("id").alias(id_col), "row_key", F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("least_of_all.id")).otherwise(F.col("id")).alias("component_id"),
            F.when(F.col("n") > 0, F.col("least_of_all.row_key") == F.col("row_key")).otherwise(True).alias("kept"),
        )
    )


def _checked(source: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, num: int, den: int, star_rows: int, broadcast_ids: int, name: str) -> DataFrame:
    """The pairs whose sets reach the threshold.  Each pair is checked once, in a star around
    its first class; a star of high degree is dealt over tasks."""
    spark = source.sparkSession
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / star_rows).cast("int").alias("salts"))
    centres = degree.select(F.col("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("own"), F.col("a").alias("b"))
    leaves = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("own"), "b")
    stars = centres.unionByName(leaves)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    rows = materialize(classes.select("cls", "row_key").join(wanted, "cls", "left_semi"), f"{name}-rows")
    ids = rows.select("row_key")
    if rows.count() <= broadcast_ids:  # else the ids are shuffled with the texts
        ids = F.broadcast(ids)
    texts = source.select("row_key", "text").join(ids, "row_key", "left_semi")

    def grams_of(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                grams, bounds = ngram_sets(text_bytes(part, "text", lower=True), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_classes(grams, bounds)), pa.array([grams[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
                    names=["b", "grams"],
                )

    grams = texts.mapInArrow(grams_of, "b long, grams binary").dropDuplicates(["b"])
    return materialize(
        stars.join(grams, "b")
        .select("a", "salt", "own", "b", "grams")
        .repartition(partitions(spark), "a", "salt")
        .sortWithinPartitions("a", "salt", "own", "b")
        .mapInArrow(lambda b: _verify(b, num, den), "a long, b long"),
        name,
    )
