"""The trie of conversations' common prefixes, by Patricia construction.

A conversation is its path: one token of 40 characters per turn, a digest of role and text and
the text's length.  Equal paths are counted once, so groups of copies cost as one.

1. Distinct paths are sorted over all tasks.  The common prefix with the path before gives the
   branch points, a path's last turn the end and leaf points; no other node is made, and an edge
   holds all turns between two points.
2. Each task scans its sorted paths with a stack of open points and closes them with their
   aggregates: members, leaves, characters below with and without repeats.  All are sums or
   minima over paths, so what tasks know of one point can be added up.  Only prefixes of a task's
   first and last path can be points of another task: on these every depth is a point, and these
   alone are grouped by name.
3. A point yields itself and the unary nodes of the edge above it, whose sums follow from the
   edge's suffix sums.

Scale: texts are read once and never shuffled, the sort deals paths over tasks by their order, and
what reaches the driver are the first and last path of each task.  Children of a point with very
many are looked up by broadcast (``common.lookup``).  The ids of one path's members are packed in
sorted blocks before they meet in the task that digests them, which streams.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import discard, lookup, materialize, partitions

#: 32 hexadecimal digits of a digest, 8 of the text's length in characters.
TOKEN = 40


def paths_of(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id, path)``, one row per conversation: its turns' tokens in order.

    Turns come by number, null first, those of one number by their tokens; null role and text count
    as empty; repeated rows are turns of their own.  Rows without an id belong to no conversation.
    A path is gathered in one row: 40 bytes a turn, whatever the texts' lengths.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    token = F.concat(digest, F.lpad(F.hex(F.char_length(text).cast("long")), TOKEN - 32, "0"))
    named = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), token.alias("token")).alias("at"))
    path = F.array_join(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["token"]), "")
    return named.groupBy("id").agg(path.alias("path"))


def with_shared_heads(paths: DataFrame, period: int = 100, most: int = 6) -> DataFrame:
    """``(id, path)`` where conversation c begins with the first ``h = crc32(decimal c) % most``
    turns of conversation ``c - c % period`` (all if it has fewer, none if there is none) and goes
    on with its own turns after its first ``h``."""
    c = F.col("id")
    own = paths.select("id", "path", (c - c % period).alias("base"), (F.crc32(c.cast("string")) % most * TOKEN).cast("int").alias("h"))
    heads = paths.where(c % period == 0).select(c.alias("base"), F.substring("path", 1, (most - 1) * TOKEN).alias("head"))
    return own.join(heads, "base", "left").select("id", F.expr("concat(coalesce(left(head, h), ''), substr(path, h + 1))").alias("path"))


class _Point:
    """An open node of the scan: depth, characters down to it, and sums over the paths below."""

    __slots__ = ("depth", "sums", "old", "path", "n", "least", "leaves", "below", "once", "kids", "ended", "spine")

    def __init__(self, depth: int, sums: list, old: int, path: str, spine: bool):
        self.depth, self.sums, self.old, self.path, self.spine = depth, sums, old, path, spine
        self.n = self.leaves = self.below = self.once = self.kids = 0
        self.least, self.ended = None, False

    def take(self, child: _Point) -> None:
        """Add a closed child.  Of its edge, depths up to ``old`` are nodes of earlier paths."""
        self.n += child.n
        self.least = child.least if self.least is None else min(self.least, child.least)
        self.leaves += child.leaves
        top, end = child.sums[self.depth], child.sums[child.depth]
        self.below += child.below + child.n * (end - top)
        self.once += child.once + end - child.sums[min(max(self.depth, child.old), child.depth)]
        self.kids += child.old <= self.depth

    def row(self, parent: _Point | None) -> tuple:
        up = parent.depth if parent else -1
        name = hashlib.md5(self.path[: self.depth * TOKEN].encode(), usedforsecurity=False).hexdigest()
        above = hashlib.md5(self.path[: up * TOKEN].encode(), usedforsecurity=False).hexdigest() if parent else None
        last = self.sums[self.depth - 1] if self.depth else 0
        edge = [last - self.sums[e - 1] for e in range(up + 1, self.depth + 1)] if parent else [0]
        return (name, above, self.depth, up, self.n, self.least, self.leaves, self.below - self.once, self.kids, self.sums[self.depth] - last, edge, self.ended, self.spine)


def _common(a: str, b: str) -> int:
    d = 0
    while (d + 1) * TOKEN <= min(len(a), len(b)) and a[d * TOKEN : (d + 1) * TOKEN] == b[d * TOKEN : (d + 1) * TOKEN]:
        d += 1
    return d


def closed_points(rows):
    """The points of one run of sorted ``(path, n, least, common, leaf)``, closed ones first.
    ``common`` is the depth up to which a path is that of the row before it, in this run or not."""
    stack: list[_Point] = []
    for path, n, least, common, leaf in rows:
        size = len(path) // TOKEN
        sums = [0]
        for d in range(size):
            sums.append(sums[-1] + int(path[d * TOKEN + 32 : (d + 1) * TOKEN], 16))
        if not stack:
            stack = [_Point(d, sums, common, path, True) for d in range(size + 1)]
        else:
            while stack[-1].depth > common:
                closed = stack.pop()
                if stack[-1].depth < common:
                    stack.append(_Point(common, closed.sums, closed.old, closed.path, False))
                stack[-1].take(closed)
                yield closed.row(stack[-1])
            stack.append(_Point(size, sums, common, path, False))
        end = stack[-1]
        end.n, end.leaves, end.ended = end.n + n, end.leaves + leaf, True
        end.least = least if end.least is None else min(end.least, least)
    while stack:  # every depth of the last path
        closed = stack.pop()
        closed.spine = True
        if not stack:
            yield closed.row(None)
            break
        if stack[-1].depth < closed.depth - 1:
            stack.append(_Point(closed.depth - 1, closed.sums, closed.old, closed.path, True))
        stack[-1].take(closed)
        yield closed.row(stack[-1])


def prefix_trie(paths: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``
    per node of the trie of ``(id, path)``, one row per id.

    A node is a distinct sequence of first turns, the root that of none; its members are the
    conversations that begin so.  ``conv_id`` is the smallest member, which with ``depth`` names the
    node; ``parent_conv_id`` is that of its parent (null for the root).  ``saved_tokens`` sums, over
    a node's subtree, members but one times the characters of its last text.  ``ends_sha256``
    digests the ids of the members that end there, ascending and joined by commas.  A conversation
    without turns belongs to the root alone.  An empty table has no nodes.
    """
    spark = paths.sparkSession
    parts = partitions(spark)
    paths = materialize(paths.select("id", "path"), "trie-paths")
    id_type = to_arrow_type(paths.schema["id"].dataType)
    ids = StructType([f for f in paths.schema.fields if f.name == "id"])

    # 1. sorted distinct paths, each with what it shares with the one before
    def neighbours(batches):
        task = TaskContext.get().partitionId()
        held, before, at = None, None, 0
        for batch in batches:
            out = []
            for path, n, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                common = None if before is None else _common(before, path)
                if held is not None:
                    out.append((*held, not path.startswith(held[2])))
                held, before, at = (task, at, path, n, least, common), path, at + 1
            yield _rows(out)
        if held is not None:
            yield _rows([(*held, None)])

    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), id_type, pa.int32(), pa.bool_()]
    names = ["task", "at", "path", "n", "least", "common", "leaf"]

    def _rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    schema = StructType().add("task", "integer").add("at", "long").add("path", "string").add("n", "long").add("least", ids["id"].dataType).add("common", "integer").add("leaf", "boolean")
    distinct = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    ordered = materialize(distinct.repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(neighbours, schema), "trie-order")

    # what the first and last path of a task share with those of the tasks beside it: two rows a task
    bounds = ordered.where("common is null or leaf is null").orderBy("task", "at").select("task", "at", "path").collect()
    beside = [None, *bounds, None]
    first = {(r["task"], r["at"]): _common(b["path"], r["path"]) if b else 0 for b, r in zip(beside, bounds)}
    leaf = {(r["task"], r["at"]): not (a and a["path"].startswith(r["path"])) for r, a in zip(bounds, beside[2:])}

    # 2. points; rows of a task that are read apart are runs of their own
    def scan(batches):
        rows = ((*r[:2], *r[2:5], first[r[:2]] if r[5] is None else r[5], leaf[r[:2]] if r[6] is None else r[6]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        # a task's rows are numbered: the difference from a count of what is read stays within a run
        for _, run in itertools.groupby(zip(itertools.count(), rows), key=lambda x: (x[1][0], x[1][1] - x[0])):
            yield from _points(r[2:] for _, r in run)

    point_kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_()]

    def _points(run):
        out: list = []
        for row in closed_points(run):
            out.append(row)
            if len(out) >= 5000:
                yield _point_rows(out)
                out = []
        yield _point_rows(out)

    def _point_rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(point_kinds)], names=point_names)

    point = StructType().add("name", "string").add("parent", "string").add("depth", "integer").add("up", "integer").add("n", "long").add("least", ids["id"].dataType)
    for name in ("leaves", "saved", "kids", "own"):
        point = point.add(name, "long")
    point = point.add("edge", ArrayType(LongType())).add("ended", "boolean").add("spine", "boolean")
    point_names = point.names
    found = materialize(ordered.mapInArrow(scan, point), "trie-scan")
    met = found.where("spine").groupBy("name").agg(
        *(F.max(c).alias(c) for c in ("parent", "depth", "up")), F.sum("n").alias("n"), F.min("least").alias("least"),
        *(F.sum(c).alias(c) for c in ("leaves", "saved", "kids")), F.max("own").alias("own"), F.max("edge").alias("edge"), F.max("ended").alias("ended"), F.max("spine").alias("spine"),
    )
    points = materialize(found.where("not spine").unionByName(met), "trie-points")
    discard(found)
    discard(ordered)

    # 3. digests of the ids that end at each point
    ended = (
        paths.select(F.md5("path").alias("name"), "id")
        .repartitionByRange(parts, "name", "id")
        .sortWithinPartitions("name", "id")
        .mapInArrow(_packed, StructType().add("name", "string").add("first", ids["id"].dataType).add("ids", "string"))
        .repartition(parts, "name")
        .sortWithinPartitions("name", "first")
        .mapInArrow(_digests, "name string, ends_sha256 string")
    )

    # 4. a row for each point and each node of the edge above it
    parents = points.where("kids > 0").select(F.col("name").alias("parent"), F.col("least").alias("parent_least"), F.col("kids").alias("rows"))
    none = points.where("depth = 0").select(F.lit(None).cast("string").alias("parent"), F.lit(None).cast(ids["id"].dataType).alias("parent_least"), F.lit(1).cast("long").alias("rows"))
    placed = lookup(points, materialize(parents.unionByName(none), "trie-parents"), "parent", "rows").join(ended, "name", "left")
    nodes = placed.select("*", F.posexplode("edge").alias("i", "above"))
    whole = F.col("up") + 1 + F.col("i") == F.col("depth")
    return nodes.select(
        F.col("least").alias("conv_id"),
        (F.col("up") + 1 + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(whole, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * (F.col("own") + F.col("above"))).alias("saved_tokens"),
        F.when(whole, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _packed(batches):
    """Sorted ``(name, id)`` as ``(name, first id, ids joined by commas)``, a row per name and batch."""
    for batch in batches:
        names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list = []
        for name, one in zip(names, ids, strict=True):
            if out and out[-1][0] == name:
                out[-1][2].append(str(one))
            else:
                out.append((name, one, [str(one)]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], batch.column(1).type), pa.array([",".join(r[2]) for r in out], pa.string())], names=["name", "first", "ids"])


def _digests(batches):
    """SHA-256 of each name's blocks joined by commas; blocks come in order and none is kept."""
    name, digest = None, None
    for batch in batches:
        done = []
        for one, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if one != name:
                if name is not None:
                    done.append((name, digest.hexdigest()))
                name, digest = one, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], names=["name", "ends_sha256"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], names=["name", "ends_sha256"])
