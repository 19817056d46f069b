"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents form one stream of words in a keyed random order.  The stream, read
as often as the source's target needs (the last reading stops at the target), is cut into
blocks of a fixed number of words.  How many blocks of each source every output shard gets is
fixed exactly by recursion: a node's quotas are drawn for its left half from the multivariate
hypergeometric distribution, the rest goes right.  A keyed permutation deals a source's blocks
to the shards in disjoint ranges of those quotas, and each shard orders its pieces by a hash.

Scale: the only global state is sources x shards quotas on the driver (at most ``max_cells``,
checked).  Rows that repeat id, text and source are one run of the stream until their places
are known, so a very common row is one row of any window.  Word offsets come from sums per
bucket of a source, with as many buckets as rows need; no source is ever in one task.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (3, 1, 2), budget: Fraction = Fraction(3, 2), most: int = 2) -> dict:
    """Words to take from each source.  Sources by code point, null last, weigh ``weights`` in
    turn; they share ``budget`` of all words; none takes over ``most`` times its size, and what
    it can't take is shared by the others by weight until all are below."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left = budget * sum(size.values())
    found, free = {}, set(size)
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] > most * size[s] * total}
        if not full:
            return found | {s: left * weight[s] / total for s in free}
        for s in full:
            found[s] = Fraction(most * size[s])
        left -= sum(found[s] for s in full)
        free -= full
    return found


def splitting_tree(blocks: np.ndarray, shards: int, seed: int = 0) -> np.ndarray:
    """Exact quotas, shards x sources, whose columns add up to ``blocks``; shards get equal
    numbers of blocks as nearly as can be."""
    out = np.zeros((shards, len(blocks)), dtype=np.int64)

    def split(lo: int, hi: int, quota: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = quota
            return
        mid = (lo + hi) // 2
        total = int(quota.sum())
        want = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = np.zeros_like(quota)
        rest, need = total, want
        for i, q in enumerate(quota):  # one source after the other, conditioned on those before
            rest -= int(q)
            if need and q:
                n = _hypergeometric(rng, int(q), rest, need)
                left[i], need = n, need - n
        split(lo, mid, left)
        split(mid, hi, quota - left)

    if shards > 0:
        split(0, shards, np.asarray(blocks, dtype=np.int64))
    return out


def _hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` drawn without replacement are good, for numbers of any size: by
    inversion over all values within 12 standard deviations of the mode (all others together
    have less than a rounding error of the mass), from the ratios of neighbouring masses."""
    lo, hi = max(0, draws - bad), min(good, draws)
    n = good + bad
    deviation = math.sqrt(draws * (good / n) * (bad / n) * max(1, n - draws) / max(1, n - 1))
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (n + 2)))
    lo, hi = max(lo, mode - int(12 * deviation) - 40), min(hi, mode + int(12 * deviation) + 40)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    mass = np.append(0.0, np.cumsum(steps))
    total = np.cumsum(np.exp(mass - mass.max()))
    return lo + int(np.searchsorted(total, rng.random() * total[-1], side="right").clip(0, hi - lo))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    budget: Fraction = Fraction(3, 2),
    most: int = 2,
    block_words: int = 4096,
    shards: int = 64,
    seed: int = 0,
    bucket_rows: int = 20_000,
    max_cells: int = 10_000_000,
) -> tuple[DataFrame, DataFrame]:
    """``(sized, pieces)``.

    ``sized``: one row per document: id, source, key, row, size (words), source_size, target (double).
    ``pieces``: id, source, key, row, copy (0 for the first reading), start and length in words
    of the document, block, shard and the piece's place in its shard's order (a hash to sort by).

    A null text has size 0 and gives no piece; a null source is a source of its own, last in
    order.  Rows that repeat id, text and source stand side by side in the stream and are told
    apart by a running number, ``row``.  Draws depend on ids, texts, sources and ``seed`` only,
    so reruns agree.  Ties of the order's hash go by id.  Empty input gives empty results.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    runs = (
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), size.alias("size"))
        .groupBy("id", "source", "key", "size").agg(F.count("*").alias("rows"))
    )
    runs = materialize(runs, "sizes")
    per = [
        (r["source"], r["size"], r["n"])
        for r in runs.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.count("*").alias("n")).collect()
    ]
    per.sort(key=lambda x: (x[0] is None, x[0] or ""))
    if len(per) * shards > max_cells:
        raise ValueError(f"{len(per)} sources x {shards} shards are over max_cells={max_cells}")
    want = targets([(s, n) for s, n, _ in per], weights, budget, most)
    words = {s: round(want[s]) for s, _, _ in per}
    blocks = np.array([-(-words[s] // block_words) for s, _, _ in per], dtype=np.int64)
    quotas = splitting_tree(blocks, shards, seed)
    ends = np.cumsum(quotas, axis=0)
    rng = np.random.default_rng([seed, 1])
    bucket_rows = max(1, min(bucket_rows, sum(n for _, _, n in per) // (4 * parts)))
    table = []
    for i, (s, n, rows) in enumerate(per):
        nb = max(1, int(blocks[i]))
        most_step = max(1, min(nb - 1, (1 << 62) // nb))  # block x step stays a long
        step = int(rng.integers(1, most_step + 1))
        while math.gcd(step, nb) != 1:
            step = step % most_step + 1
        table.append((s, int(n), float(want[s]), int(words[s]), nb, step, int(rng.integers(nb)), ends[:, i].tolist(), max(1, -(-rows // bucket_rows))))
    per_source = spark.createDataFrame(
        table, "source string, source_size long, target double, words long, n_blocks long, step long, turn long, ends array<long>, buckets long"
    )
    known = runs.alias("d").join(F.broadcast(per_source.alias("p")), F.expr("d.source <=> p.source")).select(
        "d.*", "p.source_size", "p.target", "p.words", "p.n_blocks", "p.step", "p.turn", "p.ends", "p.buckets")
    # buckets are ranges of the key, so the stream's order doesn't depend on how many there are
    placed = known.where("size > 0 and words > 0").withColumn(
        "bucket", F.floor((F.shiftright("key", 32) + F.lit(1 << 31)) * F.col("buckets") / F.lit(1 << 32)).cast("int")
    ).withColumn("total", F.col("size") * F.col("rows"))
    by = Window.partitionBy("source", "bucket")
    before = (
        placed.groupBy("source", "bucket").agg(F.sum("total").alias("n"))
        .withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("source", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    )
    inner = placed.withColumn(
        "within", F.sum("total").over(by.orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")
    )
    placed = inner.alias("d").join(before.alias("b"), F.expr("d.source <=> b.source and d.bucket = b.bucket")).select(
        "d.*", (F.col("b.base") + F.col("d.within")).alias("at")
    )
    # rows of a run, dealt over tasks; then each reading of the stream, clipped at the words to
    # take and cut at block borders
    copies = F.sequence(F.lit(0), F.ceil(F.col("words") / F.col("source_size")).cast("int") - 1)
    read = (
        _rows_of(placed, parts)
        .withColumn("copy", F.explode(copies))
        .withColumn("lo", F.col("copy") * F.col("source_size") + F.col("at") + F.col("row") * F.col("size"))
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("words")))
        .where("lo < hi")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words))))
    )
    first = F.greatest("lo", F.col("block") * block_words)
    last = F.least("hi", (F.col("block") + 1) * block_words)
    rank = F.pmod(F.pmod(F.col("block"), F.col("n_blocks")) * F.col("step") + F.col("turn"), F.col("n_blocks"))
    pieces = read.select(
        F.col("id").alias(id_col), "source", "key", "row", "size", "copy",
        (first - F.col("lo")).cast("long").alias("start"),
        (last - first).cast("long").alias("length"),
        "block",
        F.size(F.filter("ends", lambda e: e <= rank)).alias("shard"),
        F.xxhash64("id", "key", "row", "copy", "block", F.lit(seed)).alias("place"),
    )
    sized = _rows_of(known, parts).select(F.col("id").alias(id_col), "source", "key", "row", "size", "source_size", "target")
    return sized, pieces


def _rows_of(runs: DataFrame, parts: int, together: int = 1000) -> DataFrame:
    """Each run as its rows, numbered from 0.  Long runs are cut before they are dealt out."""
    cut = runs.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / together))))
    within = F.sequence(F.col("cut") * together, F.least(F.col("rows"), (F.col("cut") + 1) * together) - 1)
    return cut.repartition(parts, "key", "cut").withColumn("row", F.explode(within)).drop("cut")


def taken_of(sized: DataFrame, pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``sized`` with what the mix takes of each row: ``taken`` words in ``n_pieces`` pieces on
    ``n_shards`` shards."""
    by = [id_col, "source", "key", "row"]
    found = pieces.groupBy(*by).agg(F.sum("length").alias("taken"), F.count("*").alias("n_pieces"), F.countDistinct("shard").alias("n_shards"))
    same = " and ".join(f"s.`{c}` <=> t.`{c}`" for c in by)
    none = F.lit(0).cast("long")
    return sized.alias("s").join(found.alias("t"), F.expr(f"s.key = t.key and s.row = t.row and {same}"), "left").select(
        "s.*", *(F.coalesce(f"t.{c}", none).alias(c) for c in ("taken", "n_pieces", "n_shards"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """``docs`` as the mix has them: a document's row once for each reading that takes it, with
    the text cut to the words taken where the last reading stops within it (at most one document
    of a source).  Columns stay as they are, whatever their names.

    A reading belongs to the shard of its first block, at the place of its first piece: each
    partition of the result is in the order of shards, then places.  Of rows that repeat id, text
    and source the one of least hash over all columns is read for all of them.  Null and empty texts
    have no words and are never read; very long ones are cut at the word like others.  An empty table
    gives an empty result."""
    spark = docs.sparkSession
    _, pieces = mix_sources(docs, id_col, text_col, source_col, seed=seed, **options)
    by = [F.col(id_col).alias("id"), F.col("source"), F.col("key")]
    taken = pieces.groupBy(*by, "row", "copy").agg(
        F.sum("length").alias("words"), F.max("size").alias("size"), F.min_by("shard", "start").alias("shard"), F.min_by("place", "start").alias("place")
    )
    taken = materialize(taken, "readings")
    keyed = docs.select(
        F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"),
        F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("key"),
    )
    names = ["id", "source", "key"]
    repeated = taken.where("row = 1").select(*names).distinct()
    alike = F.expr("d.key = t.key and d.id <=> t.id and d.source <=> t.source")
    if repeated.limit(1).count():
        pick = lambda x, how: x.alias("d").join(repeated.alias("t"), alike, how)
        one = pick(keyed, "left_semi").groupBy(*names).agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"), F.min("text").alias("text"))
        sides = [(pick(keyed, "left_anti"), pick(taken, "left_anti")), (one, pick(taken, "left_semi"))]
    else:
        sides = [(keyed, taken)]
    read = [x.alias("d").join(y.alias("t"), alike).select("d.doc", "d.text", "t.words", "t.size", "t.shard", "t.place") for x, y in sides]
    parted = F.regexp_extract_all(F.col("text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)  # words with the blanks before
    cut = F.array_join(F.slice(parted, F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text"))
    return (
        reduce(DataFrame.unionByName, read)
        .select("doc", text.alias("text"), "shard", "place")
        .sortWithinPartitions("shard", "place")
        .select(*(F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns))
    )
