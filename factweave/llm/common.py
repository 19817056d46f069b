"""What the operators share: shared storage for cut lineage, ids, partition counts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where a session on one machine names none (unit tests) a temporary folder is set once; on a
    cluster that would be a folder of the driver alone, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="factweave-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, nothing is lost
    with an executor, and values such as generated ids stay as they are.  What the write has
    shuffled is not needed once it has ended, so its files go then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factweave/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no plan will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if f"{shared_dir(spark).split(':', 1)[-1].rstrip('/')}/factweave/" in f}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each of their keys (null
    among them) and in ``count`` the number of its rows.  Keys of more than a quarter of a
    partition's share, of which there are at most 4 x partitions, are broadcast; rows of the
    others are shuffled.  ``table`` is read three times: a written one."""
    total = table.agg(F.sum(count)).first()[0] or 0
    share = max(1000, total // (4 * partitions(rows.sparkSession)))
    other = f"{key}_of_table"
    table = table.withColumnRenamed(key, other)
    same = F.col(key).eqNullSafe(F.col(other))
    heavy = table.where(F.col(count) > share)
    names = F.broadcast(heavy.select(other))
    hot = rows.join(F.broadcast(heavy), same).drop(other, count)
    rest = rows.join(names, same, "left_anti").join(table.where(F.col(count) <= share), same).drop(other, count)
    return hot.unionByName(rest)


ROW_KEY = "factweave_row_key"


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and key (a hash of id and text) are in ``kept(id, row_key)``; of rows
    that repeat both id and text the one of least hash over all columns stays, so that reruns agree.
    Columns stay as they are, whatever their names; null ids count as one id."""
    key, own = ROW_KEY, "_kept"
    while {key, own} & set(docs.columns):
        key, own = f"{key}_", f"{own}_"
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    wanted = kept.select(F.col("row_key").alias(f"{key}k"), F.col(id_col).alias(f"{key}i"))
    rows = keyed.join(wanted, (F.col(key) == F.col(f"{key}k")) & F.col(id_col).eqNullSafe(F.col(f"{key}i")), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    picked = rows.groupBy(key, id_col).agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias(own))
    return picked.select(*[F.col(f"{own}.`{c}`").alias(c) for c in docs.columns])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of ``edges(a, b)``, as ``(node, component)``.

    Alternates large-star and small-star steps (Kiveris et al., 2014).  Minima are
    aggregated with map-side combine and joined back, so that no neighbourhood is ever
    collected; each round is written to shared storage.  Ids only need an order.
    """
    spark = edges.sparkSession
    cur = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        # large star: neighbours above u go to the least of u's neighbourhood
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        large = materialize(large, "large")
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        nxt = materialize(small, "small")
        discard(large)
        discard(cur)
        # done when each node hangs on one root and no root hangs on another node
        multi = nxt.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if multi == 0:
            roots = nxt.select(F.col("v").alias("u")).distinct().join(nxt.select("u"), "u", "left_semi").limit(1).count()
            if roots == 0:
                cur = nxt
                break
        cur = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
