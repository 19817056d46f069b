"""Exact deduplication by deterministic block naming.

A document's bytes are cut into blocks of a fixed size.  Blocks are sorted, and equal blocks
get one integer name; then adjacent names of a document are paired, pairs are named in the
same way, and so on until one name is left.  Names stand for contents, never for hashes:
two documents have the same number of blocks and the same last name exactly if their bytes
are equal.

Scale: the text is shuffled once, cut into blocks, on a 64-bit key of the block (the key only
places rows; blocks are compared in full).  Blocks that make up more than 1/(4 P) of all rows,
of which there are at most 4 P, are dealt over as many tasks as they need; their few
representatives (at most 8 P) are named in a second step.  All later levels move integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(column):
    """Lower-case A-Z only.  Pure ASCII text takes the faster built-in."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(
        F.translate(column, UPPER, UPPER.lower())
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8192) -> DataFrame:
    """``(id, keep_id, group_size, kept, n_bytes, n_blocks, text_sha256, row_key)``, one row per input row.

    Texts are equal when identical after lower-casing A-Z.  A null text counts as empty.  Of
    equal texts the row with the largest id stays; a null id is below all others; of repeated
    rows with one id and one text exactly one stays.  Empty input gives an empty result.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    norm = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(id_col, text_col).alias("rh"),  # tells rows apart that repeat an id
        F.encode(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8").alias("body"),
    ).withColumn("n_bytes", F.octet_length("body").cast("long"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / block_bytes)).cast("int")
    blocks_of = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)),
    )
    norm = norm.withColumn("n_blocks", n_blocks)

    # blocks that hold more than their share of all rows
    keys = norm.select(F.explode(blocks_of).alias("block")).select(F.xxhash64("block").alias("h"))
    counts = keys.groupBy("h").agg(F.count("*").alias("n"))
    counts = materialize(counts.where("n > 1"), "block-counts")
    total = norm.agg(F.sum("n_blocks")).first()[0] or 0
    share = max(1000, total // (4 * parts))
    heavy = counts.where(F.col("n") > share).select("h", F.ceil(F.col("n") / share).cast("int").alias("salts"))

    # level 0: the text moves once
    rows = norm.select(
        "id", "n_bytes", "n_blocks", "rh", F.sha2("body", 256).alias("sha"),
        F.posexplode(blocks_of).alias("pos", "block"),
    ).withColumn("h", F.xxhash64("block"))
    rows = rows.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))
    rows = rows.join(F.broadcast(heavy), "h", "left").withColumn(
        "salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("id", "rh"), F.col("salts"))).otherwise(0)
    )
    named = (
        rows.repartition(parts, "h", "salt")
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("name", F.min("uid").over(Window.partitionBy("h", "salt", "block")))
        .withColumn("rep", F.when(F.col("salts").isNotNull() & (F.col("uid") == F.col("name")), F.col("block")))
        .select("id", "rh", "n_bytes", "n_blocks", "sha", "pos", "uid", "name", "rep")
    )
    named = materialize(named, "block-names")
    reps = named.where("rep is not null").select("name", "rep")
    renamed = reps.join(reps.groupBy("rep").agg(F.min("name").alias("name2")), "rep").select("name", "name2")
    named = named.join(F.broadcast(renamed), "name", "left").select(
        "id", "rh", "n_bytes", "n_blocks", "sha", "pos", "uid", F.coalesce("name2", "name").alias("name")
    )
    heads = named.where("pos = 0").select("id", "rh", "n_bytes", "n_blocks", "sha", "uid", "name")

    # pair names until one is left
    level = 0
    cur = named.where("n_blocks > 1").select("id", "rh", "pos", "name", "n_blocks").distinct()
    largest = heads.agg(F.max("n_blocks")).first()[0] or 0
    done = []
    while (1 << level) < largest:
        level += 1
        pairs = (
            cur.groupBy("id", "rh", (F.col("pos") / 2).cast("int").alias("pos"), F.ceil(F.col("n_blocks") / 2).cast("int").alias("n_blocks"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        pairs = materialize(pairs, f"pairs-{level}")
        names = materialize(
            pairs.select("a", "b").distinct().withColumn("name", F.monotonically_increasing_id()), f"names-{level}"
        )
        cur = pairs.join(names, ["a", "b"]).select("id", "rh", "pos", "n_blocks", "name")
        done.append(cur.where("n_blocks = 1").select("id", "rh", F.lit(level).alias("level"), F.col("name").alias("last")))
        cur = cur.where("n_blocks > 1")
    single = heads.where("n_blocks = 1").withColumn("level", F.lit(0))
    whole = single
    if done:
        ends = done[0]
        for more in done[1:]:
            ends = ends.unionByName(more)
        multi = heads.where("n_blocks > 1").alias("x").join(
            ends.alias("y"), F.expr("x.id <=> y.id and x.rh = y.rh")
        ).select("x.id", "x.rh", "x.n_bytes", "x.n_blocks", "x.sha", "x.uid", F.col("y.last").alias("name"), "y.level")
        whole = single.unionByName(multi)
    groups = whole.groupBy("level", "name").agg(
        F.count("*").alias("group_size"), F.max(F.struct("id", "uid")).alias("keep")
    )
    return whole.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("uid") == F.col("keep.uid")).alias("kept"),
        "n_bytes",
        "n_blocks",
        F.col("sha").alias("text_sha256"),
        F.col("rh").alias("row_key"),
    )
