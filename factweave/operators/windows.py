"""Order-dependent operators on long relations: running context, islands, states, snapshots.

Every relation has keys and a unique ordinal ``idx``; running values use ROWS frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.sources.store import cut

from factweave.functions import text as T


def _so_far(keys: list[str], idx: str):
    return Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)


def heading_context(blocks: DataFrame, keys: list[str], is_heading: Column, text: str, idx: str = "idx") -> DataFrame:
    """Each block with the text of the last heading so far; headings have their own."""
    return blocks.withColumn("heading_context", F.last(F.when(is_heading, F.col(text)), ignorenulls=True).over(_so_far(keys, idx)))


def label_value_pairs(blocks: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """``Label: Value`` rows out of a short label followed by value-shaped blocks under one heading.

    ``blocks`` has heading_context, text and struck (the value is crossed out).  The run of values
    after a label is an island; where it mixes struck and live values these become the
    original and the discounted one.
    """
    by = Window.partitionBy(*keys, "heading_context").orderBy(idx)
    value = T.value_shaped("text")
    label = T.short_label("text") & ~value
    rows = blocks.withColumn("is_value", value).withColumn("start", F.coalesce((~value).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("start").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(*keys, "heading_context", "island")
    rows = rows.withColumn("label", F.max(F.when(label, F.col("text"))).over(island))
    rows = rows.withColumn("mixed", F.bool_or(F.col("is_value") & F.col("struck")).over(island) & F.bool_or(F.col("is_value") & ~F.col("struck")).over(island))
    role = F.when(F.col("mixed"), F.when(F.col("struck"), "original").otherwise("discounted"))
    return rows.where(F.col("is_value") & F.col("label").isNotNull()).select(
        *keys, idx, "heading_context", F.concat("label", F.lit(": "), "text").alias("text"), role.alias("fee_role")
    )


def runs(rows: DataFrame, keys: list[str], member: Column, least: int = 2, idx: str = "idx") -> DataFrame:
    """Rows of maximal runs of ``least`` or more consecutive members, with the run's size."""
    by = Window.partitionBy(*keys).orderBy(idx)
    marked = rows.withColumn("_in", F.coalesce(member, F.lit(False))).withColumn("_n", F.row_number().over(by))
    marked = marked.where("_in").withColumn("_island", F.col("_n") - F.row_number().over(by))
    marked = marked.withColumn("run_size", F.count("*").over(Window.partitionBy(*keys, "_island")))
    return marked.where(F.col("run_size") >= least).drop("_in", "_n", "_island")


def state_filter(rows: DataFrame, keys: list[str], opens: Column, closes: Column, idx: str = "idx") -> DataFrame:
    """Rows outside the state that ``opens`` starts and ``closes`` ends; events themselves go."""
    event = F.when(closes, "close").when(opens, "open")
    marked = rows.withColumn("_event", event).withColumn("_state", F.last("_event", ignorenulls=True).over(_so_far(keys, idx)))
    return marked.where(F.col("_event").isNull() & F.coalesce(F.col("_state") == "close", F.lit(True))).drop("_event", "_state")


def skip_levels(headings: Column, starts) -> Column:
    """Of headings (array of struct with level) those outside skipped sections: one where
    ``starts(heading)`` opens a section to skip, with all deeper headings after it."""
    zero = F.struct(F.filter(headings, lambda h: F.lit(False)).alias("kept"), F.lit(None).cast("int").alias("skip"))

    def step(state, h):
        inside = F.coalesce(h["level"] > state["skip"], F.lit(False))
        opens = starts(h)
        kept = F.when(inside | opens, state["kept"]).otherwise(F.concat(state["kept"], F.array(h)))
        skip = F.when(inside, state["skip"]).when(opens, h["level"].cast("int")).otherwise(F.lit(None).cast("int"))
        return F.struct(kept.alias("kept"), skip.alias("skip"))

    return F.aggregate(headings, zero, step)["kept"]


def keep_first(rows: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Per key the first row, and how many more there are: duplicates are told, not lost."""
    rest = [c for c in rows.columns if c not in keys]
    g = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), idx).alias("_first"), (F.count("*") - 1).alias("n_duplicates"))
    return g.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest], "n_duplicates")


def latest(rows: DataFrame, keys: list[str], value: list[str], order: list[str]) -> DataFrame:
    """The last snapshot per key out of an append-only log."""
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("_last"))
    return g.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in value])


def top_k(rows: DataFrame, keys: list[str], order: list, k: int = 5) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def with_positions(rows: DataFrame, order: list, name: str = "position") -> DataFrame:
    """``rows`` with each one's place, from 1, in the order of all: rows are dealt over tasks by ranges
    of the order and sorted within; a task's rows come after as many as the tasks before it have, a
    sum over one number per task.  No task holds more than its range."""
    uid, part = "_place", "_task"
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(uid, F.monotonically_increasing_id()))
    task = F.shiftright(uid, 33)  # the identifiers count a task's rows in their lower 33 bits
    sizes = placed.groupBy(task.alias(part)).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # as many rows as tasks
    starts = sizes.select(part, F.coalesce(before, F.lit(0)).alias("_before"))
    found = placed.join(F.broadcast(starts), task == F.col(part))
    return found.select(*rows.columns, (F.col("_before") + F.col(uid).bitwiseAND((1 << 33) - 1) + 1).alias(name))
