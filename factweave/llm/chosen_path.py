"""Near-duplicate detection by a chosen-path set similarity join over minwise signatures.

1. Each document becomes the set of its distinct word n-grams.  Documents with one set form a
   class, named by 64 bits; a class has ``coords`` minwise values (its signature) and a sketch: 768
   bits, of which each n-gram turns one over, and a byte of each minwise value.
2. ``trees`` independent trees branch the classes by one value at the root: a class goes to the
   node of that value.  Two sets of similarity s share a child for a value with probability s.
3. Nodes of at most ``node_rows`` classes are compared exhaustively.  Larger ones branch further by
   values that the node's own path chooses, two at first, 1/threshold on average from the fourth
   level on, so a pair at the threshold is expected to keep meeting while less similar ones part.
4. A pair survives where sizes and sketches don't rule the threshold out: bits that differ are at
   most the n-grams that do, so they never rule out a link.  Survivors are confirmed on their full sets, each once.

A group of near copies never parts, so no pair of one component is compared again.  In a turn
a class keeps two partners over all nodes, the one of least name and the nearest by sketch (in a
large node, of those beside it in the order of two values that the node chooses); these form
components.  The next turn does the same across components, where only nodes that hold several
count, of small ones only classes that met a survivor.  A node is small if at most ``node_rows``
of its classes are outside its largest component: these few are compared with all.  Large ones
branch, and their children take part in the turn after.  When none is left to branch, every
survivor across components is confirmed; nodes still too large at the last level are then
compared in pairs of blocks, so nothing is given up.

A pair at a threshold of 0.8 misses all of 12 roots with probability 4e-9, the bytes with 1e-6.

Skew: nodes are dealt into blocks of ``block_rows``, stars of pairs around one class over tasks by
degree; classes count copies once.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import connected_components, discard, materialize, partitions
from .ngram_join import ngram_sets
from .words import U64, chunks, mix, text_bytes

#: Partners that a class of a large node is compared with.
SHIFTS = 16
#: 64-bit words of a sketch that hold the bits of the set.
WORDS = 12


def set_names(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits for each set: a sum over its n-grams, and its size."""
    n = np.diff(bounds)
    out = n.astype(U64)
    full = np.flatnonzero(n)
    if len(full):
        out[full] += np.add.reduceat(mix(grams ^ U64(0xA5A5A5A55A5A5A5A)), bounds[:-1][full])
    return mix(out + U64(1)).view(np.int64)


def signatures(grams: np.ndarray, bounds: np.ndarray, coords: int) -> np.ndarray:
    """``coords`` minwise values of each set, 32 bits each (0 for an empty one)."""
    n = np.diff(bounds)
    out = np.zeros((len(n), coords), dtype=np.uint32)
    full = np.flatnonzero(n)
    if len(full):
        odd = mix(np.arange(101, 101 + coords, dtype=U64)) | U64(1)
        for i in range(coords):
            out[full, i] = mix(np.minimum.reduceat(grams * odd[i], bounds[:-1][full])) >> U64(32)
    return out


def sketches(grams: np.ndarray, bounds: np.ndarray, sig: np.ndarray) -> list[bytes]:
    """``WORDS`` times 64 bits, of which each n-gram turns one over, and a byte of each minwise value."""
    n, width, out = np.diff(bounds), 64 * WORDS, []
    for at in range(0, len(n), 1000):
        own = n[at : at + 1000]
        bit = (mix(grams[bounds[at] : bounds[at + len(own)]] ^ U64(0x3C3C5A5A96A51E87)) % U64(width)).astype(np.int64)
        turned = np.bincount(np.repeat(np.arange(len(own)), own) * width + bit, minlength=len(own) * width) & 1
        packed = np.packbits(turned.astype(np.uint8).reshape(-1, width), axis=1)
        out += [r.tobytes() for r in np.hstack([packed, (sig[at : at + len(own)] & np.uint32(255)).astype(np.uint8)])]
    return out


def least_matches(coords: int, num: int, den: int, missed: float = 1e-6) -> int:
    """So many of ``coords`` values agree at the threshold but for a share ``missed`` of pairs."""
    t, below = num / den, 0.0
    for m in range(coords + 1):
        below += comb(coords, m) * t**m * (1 - t) ** (coords - m)
        if below > missed:
            return m
    return coords


def _whole(batches, keys: int):
    """Tables that hold all rows of the groups (equal first ``keys`` columns, in order) they hold."""
    rest: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        differs = np.zeros(batch.num_rows, dtype=bool)
        differs[0] = bool(rest) and any(rest[-1].column(c)[-1].as_py() != key[c][0] for c in range(keys))
        for c in key:
            differs[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(differs)
        if len(cut):
            if rest or cut[-1]:
                yield pa.Table.from_batches([*rest, batch.slice(0, cut[-1])]).combine_chunks()
            rest = [batch.slice(cut[-1])]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _meet(batches, coords: int, num: int, den: int, least: int, every: bool, most: int = 200_000):
    """Surviving pairs of two components, by groups (node, block, block2): with ``every`` all of them, else of
    each class (node, cls, large) the least partner, the nearest one and how far that is.

    Rows of ``large`` groups meet the ``SHIFTS`` before them in the group's order, others all those of near
    sizes (they come by size).  Sides: 0 and 1 meet the other side; 2 meets all; 3, the few outside the
    largest component, come with each block of side 1 and meet one another in block 0."""
    for table in _whole(batches, 3):
        col = {c: table.column(c).to_numpy() for c in ("node", "block", "block2", "cls", "component", "n", "side")}
        cls, comp, n, side, block = (col[c] for c in ("cls", "component", "n", "side", "block"))
        large = table.column("large").to_numpy(zero_copy_only=False).astype(bool)
        own = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, 8 * WORDS + coords)
        bits = [np.ascontiguousarray(own[:, 8 * w : 8 * w + 8]).view(U64).ravel() for w in range(WORDS)]
        low = np.ascontiguousarray(own[:, 8 * WORDS :])
        differs = np.zeros(len(n), dtype=bool)
        for c in ("node", "block", "block2"):
            differs[1:] |= col[c][1:] != col[c][:-1]
        group, row = np.cumsum(differs), np.arange(len(n))
        order = (group << 40) + np.where(large, 0, n)  # rows of a group that isn't large come by size
        begin = np.append(0, np.flatnonzero(differs))[group]
        from_row = np.where(large, np.maximum(begin, row - SHIFTS), np.searchsorted(order, (group << 40) + (n * num + den - 1) // den))
        from_row = np.minimum(from_row, row)
        ends = np.cumsum(row - from_row)
        least_partner = np.full(len(n), np.iinfo(np.int64).max)
        nearest, far = np.zeros(len(n), dtype=np.int64), np.full(len(n), np.inf)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            c = (row - from_row)[at:to]
            y = np.repeat(row[at:to], c)
            x = from_row[y] + np.arange(len(y)) - np.repeat(np.cumsum(c) - c, c)
            at = to
            met = (side[x] != side[y]) | (side[x] == 2) | (side[x] == 3) & (block[x] == 0)
            ok = met & (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num)
            x, y = x[ok], y[ok]
            apart = (n[x] + n[y]) * (den - num) // (den + num)  # most n-grams that only one may have
            d = np.zeros(len(x), dtype=np.int64)
            for w in range(WORDS):
                d += np.bitwise_count(bits[w][x] ^ bits[w][y])
                if w % 3 == 2:
                    ok = d <= apart
                    x, y, d, apart = x[ok], y[ok], d[ok], apart[ok]
            ok = (low[x] == low[y]).sum(axis=1) >= least
            x, y, d = x[ok], y[ok], d[ok]
            if not len(x):
                continue
            if every:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[x], cls[y])), pa.array(np.maximum(cls[x], cls[y]))], names=["a", "b"])
                continue
            mine, other = np.append(x, y), np.append(y, x)
            np.minimum.at(least_partner, mine, cls[other])
            share = np.tile(d / (n[x] + n[y]), 2)
            by = np.lexsort((cls[other], share, mine))
            by = by[np.append(True, mine[by][1:] != mine[by][:-1])]
            by = by[share[by] < far[mine[by]]]
            far[mine[by]], nearest[mine[by]] = share[by], cls[other[by]]
        if not every:
            some = np.flatnonzero(far < np.inf)
            columns = (col["node"], cls, large, least_partner, nearest, far)
            yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in columns], names=["node", "cls", "large", "lo", "near", "far"])


def _confirm(batches, num: int, den: int):
    """Stars come as ``(a, salt, own, b, grams)``, the centre first: its links."""
    centre, name = None, None
    for batch in batches:
        a, salt, own, b, grams = (batch.column(i).to_pylist() if i < 4 else batch.column(i) for i in range(5))
        found = []
        for i in range(batch.num_rows):
            values = np.frombuffer(grams[i].as_buffer(), dtype=U64)
            if own[i] == 0:
                centre, name = values.copy(), (a[i], salt[i])
            elif name == (a[i], salt[i]):
                shared = len(np.intersect1d(centre, values, assume_unique=True))
                if den * shared >= num * (len(centre) + len(values) - shared):
                    found.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in found], pa.int64()) for c in (a, b)], names=["a", "b"])


def chosen_path_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: tuple[int, int] = (80, 100),
    trees: int = 12,
    coords: int = 32,
    node_rows: int = 2000,
    block_rows: int = 2000,
    levels: int = 12,
    star_rows: int = 2000,
    broadcast_ids: int = 2_000_000,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per input row.

    Texts are lower-cased A-Z and cut into words at space and tab to carriage return; fewer words
    than ``k`` are one n-gram.  Two documents are linked if the Jaccard similarity of their sets is
    at least ``threshold``, confirmed on the whole sets.  ``component_id`` is the smallest id that
    links lead to, the own one included.  A null, empty or wordless text has an empty set and
    links with nothing: its component is its own id.  Null ids are never the smallest; a component
    of null ids only has a null id.  ``kept`` marks rows whose id is their component's: of rows
    that repeat that id, each.  Very long texts are read whole.  An empty table gives an empty result.
    """
    num, den = threshold
    spark = docs.sparkSession
    parts = partitions(spark)
    key = ["rk", "rk2"]  # 128 bits of id and text
    names = [F.xxhash64(id_col, text_col).alias("rk"), F.xxhash64(F.lit(1), text_col, id_col).alias("rk2")]
    source = docs.select(F.col(id_col).alias("id"), *names, F.col(text_col).alias("text"))

    # 1. sets, their names, signatures and sketches
    def describe(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                grams, bounds = ngram_sets(text_bytes(part, "text", lower=True), k)
                sig = signatures(grams, bounds, coords)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(np.diff(bounds)), pa.array(set_names(grams, bounds)),
                     pa.ListArray.from_arrays(np.arange(0, sig.size + 1, coords, dtype=np.int32), pa.array(sig.ravel().view(np.int32))),
                     pa.array(sketches(grams, bounds, sig), pa.binary())],
                    names=set_schema.names,
                )

    set_schema = StructType(list(source.select("id", *key).schema.fields)).add("n", "long").add("cls", "long").add("sig", ArrayType(IntegerType())).add("sketch", "binary")
    sets = materialize(source.mapInArrow(describe, set_schema), "path-sets")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", *key)).alias("least")
    classes = materialize(sets.where("n > 0").groupBy("cls").agg(least, F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("sketch").alias("sketch")), "path-classes")
    cut = least_matches(coords, num, den)

    def chosen(i: int) -> Column:
        """The value of the signature that the node chooses, of several the ``i``-th."""
        return F.get("sig", F.pmod(F.xxhash64("node", F.lit(i)), F.lit(coords)).cast("int"))

    def dealt(placed: DataFrame, components: DataFrame) -> DataFrame:
        """``placed(node, cls)`` with components, of nodes that hold two or more: their size, the largest
        one (``top``) and whether more than ``node_rows`` classes are outside it (``large``)."""
        where = placed.join(components.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        held = where.groupBy("node", "component").agg(F.count("*").alias("c"))
        spans = held.groupBy("node").agg(F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("t")).where("m > t.c")
        return where.join(spans.select("node", "m", F.col("t.component").alias("top"), (F.col("m") - F.col("t.c") > node_rows).alias("large")), "node")

    def met(rows: DataFrame, every: bool, name: str) -> DataFrame:
        """What the rows (node, cls, component, n, sig, sketch, m, top, large) of each node meet."""
        blocks = F.when(F.col("m") > block_rows, F.ceil(F.col("m") / block_rows)).otherwise(1).cast("int")
        rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls", "node"), F.col("blocks")).cast("int"))
        # the few outside the largest component meet each block; in the end each block of a large node each other one
        outside = ~F.col("large") & F.coalesce(F.col("component") != F.col("top"), F.lit(False))
        each = F.sequence(F.lit(0), F.col("blocks") - 1)
        rows = rows.withColumn("other", F.explode(F.when(outside | F.col("large") & F.lit(every), each).otherwise(F.array("own"))))
        rows = rows.withColumn("own", F.when(outside, F.col("other")).otherwise(F.col("own")))
        side = (
            F.when(outside, 3).when(~F.col("large") & F.col("top").isNotNull(), 1)
            .when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        )
        # a large node's own order, in which near copies are likely neighbours
        beside = F.col("large") & F.lit(not every)
        order = F.when(beside, chosen(4).cast("long") * (1 << 32) + chosen(5).cast("long")).otherwise(0)
        rows = (
            rows.select(
                "node", F.least("own", "other").alias("block"), F.greatest("own", "other").alias("block2"), order.alias("order"),
                "n", "cls", "component", side.alias("side"), beside.alias("large"), "sketch",
            )
            .repartition(parts, "node", "block", "block2")
            .sortWithinPartitions("node", "block", "block2", "order", "n", "cls")
        )
        schema = "a long, b long" if every else "node long, cls long, large boolean, lo long, near long, far double"
        found = rows.mapInArrow(lambda b: _meet(b, coords, num, den, cut, every), schema)
        return materialize(found.distinct() if every else found, name)

    def partners(found: DataFrame) -> DataFrame:
        """Two pairs at most for each class."""
        two = found.groupBy("cls").agg(F.min("lo").alias("lo"), F.min_by("near", F.struct("far", "near")).alias("near"))
        two = two.select("cls", F.explode(F.array_distinct(F.array("lo", "near"))).alias("other"))
        return two.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        return _links(source, classes, pairs, k, num, den, star_rows, broadcast_ids, parts, name)

    # 2. the roots of all trees, two partners a class
    values = classes.select("cls", "n", "sig", "sketch", F.posexplode(F.slice("sig", 1, trees)).alias("tree", "value"))
    roots = values.withColumn("node", F.xxhash64("tree", "value")).drop("tree", "value")
    heavy = materialize(roots.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") > node_rows), "path-heavy")
    own = F.broadcast(heavy) if heavy.count() <= broadcast_ids else heavy
    sized = roots.join(own, "node", "left").withColumn("large", F.col("m").isNotNull()).withColumn("m", F.coalesce("m", F.lit(1)))
    found = met(sized.withColumn("component", F.col("cls")).withColumn("top", F.lit(None).cast("long")), False, "path-met")
    checked = materialize(partners(found), "path-pairs")
    components = connected_components(confirmed(checked, "path-links"))
    placed = found.where("not large").select("node", "cls").unionByName(roots.join(own, "node").select("node", "cls"))

    # 3. partners in other components, level by level as large nodes branch; in the end all that survive
    level, every = 0, False
    while True:
        held = materialize(dealt(placed, components), f"path-held-{level}")
        found = met(held.join(classes.select("cls", "n", "sig", "sketch"), "cls"), every, f"path-met-{level}")
        # written, so that the plan of what was checked doesn't hold those of all levels before
        new = materialize((found if every else partners(found)).join(checked, ["a", "b"], "left_anti"), f"path-new-{level}")
        if new.limit(1).count():
            linked = confirmed(new, f"path-links-{level}")
            checked = checked.unionByName(new)
            if linked.limit(1).count():
                components = _joined(components, linked, f"path-components-{level}")
        if every:
            break
        large = held.where("large").select("node", "cls")
        every = level == levels or not large.limit(1).count()
        if not every:
            ways = F.array(*(F.pmod(F.xxhash64("node", F.lit(i)), F.lit(coords)).cast("int") for i in (1, 2)))
            if level >= 3:  # 1/threshold on average
                extra = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(num)) < den - num
                ways = F.when(extra, ways).otherwise(F.slice(ways, 1, 1))
            ways = large.join(classes.select("cls", "sig"), "cls").select("node", "cls", "sig", F.explode(F.array_distinct(ways)).alias("i"))
            large = ways.select(F.xxhash64("node", "i", F.get("sig", F.col("i"))).alias("node"), "cls")
        placed, level = found.where("not large").select("node", "cls").unionByName(large), level + 1

    # 4. ids
    named = classes.select("cls", "least").join(components.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    named = named.join(smallest, "component").select(F.col("cls").alias("join_cls"), F.col("smallest.id").alias("smallest"))
    return (
        sets.withColumn("join_cls", F.when(F.col("n") > 0, F.col("cls")))
        .join(named, "join_cls", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("id")).alias("component_id"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


def _joined(components: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``components(node, component)`` after more links (a, b): components of components."""
    of = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    edges = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")).distinct()
    roots = connected_components(edges)
    moved = components.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    moved = moved.select("node", F.coalesce("root", "component").alias("component"))
    return materialize(moved.unionByName(roots.join(components.select("node"), "node", "left_anti")), name)


def _links(source: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, num: int, den: int, star_rows: int, broadcast_ids: int, parts: int, name: str) -> DataFrame:
    """The pairs whose full sets reach the threshold, each checked once, in a star around its first
    class; a star of high degree is dealt over tasks."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / star_rows).cast("int").alias("salts"))
    centres = degree.select(F.col("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("own"), F.col("a").alias("b"))
    leaves = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("own"), "b")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    ids = materialize(classes.join(wanted, "cls", "left_semi").select("least.rk", "least.rk2", "cls"), f"{name}-rows")
    own = F.broadcast(ids) if ids.count() <= broadcast_ids else ids  # else they are shuffled with the texts
    texts = source.select("rk", "rk2", "text").join(own, ["rk", "rk2"]).select("cls", "text")

    def grams_of(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                grams, bounds = ngram_sets(text_bytes(part, "text", lower=True), k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([grams[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["b", "grams"])

    grams = texts.mapInArrow(grams_of, "b long, grams binary").dropDuplicates(["b"])
    found = materialize(
        centres.unionByName(leaves).join(grams, "b")
        .select("a", "salt", "own", "b", "grams")
        .repartition(parts, "a", "salt")
        .sortWithinPartitions("a", "salt", "own", "b")
        .mapInArrow(lambda b: _confirm(b, num, den), "a long, b long"),
        name,
    )
    discard(ids)
    return found
