"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words.  Words are ordered rare first; two lines that reach the
threshold share a word within their prefixes, so prefixes are joined on their words.  Length,
positional and bitmap filters are part of the join condition; what is left is verified on
whole lines, and a line is removed if it repeats an earlier one or is similar to one.

1. Equal lines become one row with map-side combine, so a very common line never piles up.
   The row keeps the line's prefix, its number of words and a bitmap of them; no text.
2. A first round is for families of near copies: lines that share two words in a row of their
   prefixes meet the earliest line of that pair alone.  Most members find their match there,
   in a number of pairs that is linear in the family.
3. The second round joins the prefixes of lines without a match so far with those of all
   earlier lines.  It is complete by itself; the first only makes it smaller.

Rarity comes from word counts in ``1 << freq_bits`` hash buckets, a table of fixed size that
reaches the rows as a scalar; any order gives the same pairs, a good one keeps lists short.  Texts are read for candidate lines only, and shuffled where lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import discard, materialize, partitions

BLANKS = r"[\x09-\x0D]"


def _split(line) -> Column:
    """Parts between single spaces, after other blanks became spaces; some may be empty."""
    return F.split(F.when(line.rlike(BLANKS), F.regexp_replace(line, BLANKS, " ")).otherwise(line), " ")


def rarity_levels(docs: DataFrame, text_col: str, bits: int) -> DataFrame:
    """One row with an array: for each hash bucket, how many words of all texts fall in it, as
    thirds of powers of two in the leading bits of a number."""
    spark = docs.sparkSession
    n = 1 << bits
    found = (
        docs.select(F.explode(_split(F.col(text_col))).alias("w"))
        .groupBy((F.xxhash64("w").bitwiseAND(F.lit(n - 1))).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    every = spark.range(n).withColumnRenamed("id", "bucket").join(found, "bucket", "left")
    level = F.least(F.lit(127), F.floor(F.log2(F.coalesce("n", F.lit(0)) + F.lit(1)) * 3)).cast("long") * F.lit(1 << 56)
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", level.alias("level")))), lambda x: x["level"]).alias("levels"))


#: Lines of more words have a bitmap of four times as many bits: ``map`` is the exclusive or of its
#: four parts, of which the last three are kept beside it, as 0 for all other lines.
LONG = 96
MAPS = ["map", "map1", "map2", "map3"]


def _passing(x: str, y: str, num: int, den: int, positions: bool = True) -> str:
    """The filters on two postings with equal keys: ``at`` holds the size, and the position twice."""
    xn, yn = f"shiftright({x}at, 32)", f"shiftright({y}at, 32)"
    least = f"floor(({num} * ({xn} + {yn}) + {den + num - 1}) / {den + num})"
    lengths = f"least({xn}, {yn}) * {den} >= greatest({xn}, {yn}) * {num}"
    xp, yp = (f"shiftright({a}at & 4294967295, 1)" for a in (x, y))
    places = f"and least({xn} - {xp}, {yn} - {yp}) >= {least}" if positions else ""
    apart = f"{xn} + {yn} - 2 * {least}"  # most words that only one of the lines may have
    parts = [" ^ ".join(f"{a}{m}" for a in (x, y) for m in MAPS), *(f"{x}{m} ^ {y}{m}" for m in MAPS[1:])]
    wide = " + ".join(f"bit_count({c})" for c in parts)
    return f"""{lengths} {places} and bit_count({x}map ^ {y}map) <= {apart}
        and (({xn} > {LONG}) <> ({yn} > {LONG}) or {wide} <= {apart})"""


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (80, 100), freq_bits: int = 18,
    head_keys: int = 4, broadcast_ids: int = 2_000_000,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, removed)``.

    ``documents``, one row per input row: id, n_lines, n_removed, n_chars_removed (of the lines
    that go, without line feeds), removed_lines (their numbers, from 0, ascending), kept_text
    (the other lines, joined by line feeds; null if no line stays).
    ``removed``: every line that goes of each (id, row_key): line_no, and an earlier line it
    repeats or nearly repeats: match_id, match_line.

    Lines are the parts of the text between line feeds; words lie between spaces and tab to
    carriage return and count as they are written.  Lines without a word stay and match
    nothing.  A line goes if an earlier line (by id, then a hash of id and text, then line; null
    ids first) has the same text, or has a different one with Jaccard similarity of at least
    ``threshold``, whether that line stays or not.  A null text is one empty line, and stays
    null if nothing goes.  Of rows that repeat one id and one text, the lines of all but one go
    (but for those without a word).
    """
    num, den = threshold
    spark = docs.sparkSession
    parts = partitions(spark)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    lines = source.select("id", "row_key", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(r"[^ \x09-\x0D]"))
    named = lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.hash("line"))
    own = F.struct("id", "row_key", "line_no")

    # 1. distinct lines with their prefixes.  ``levels`` is used once, so it is read in place
    bucket, rest = F.lit((1 << freq_bits) - 1), F.lit((1 << 56) - 1)
    # a word is hashed once; the empty parts between blanks go by their hash
    hashes = F.array_distinct(F.array_remove(F.transform(_split(F.col("line")), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))
    # never null, so that arrays of it are sorted as plain longs
    key = lambda h: F.coalesce(F.get(F.col("levels"), h.bitwiseAND(bucket).cast("int")), F.lit(0).cast("long")) + h.bitwiseAND(rest)
    need = F.floor((F.col("n") * num + den - 1) / den).cast("int")
    distinct = (
        named.withColumn("levels", rarity_levels(source, "text", freq_bits).scalar())
        .select("id", "row_key", "line_no", "h1", "h2", F.sort_array(F.transform(hashes, key)).alias("toks"))
        .withColumn("n", F.size("toks"))
        .select(
            own.alias("own"), "h1", "h2", "n", F.slice("toks", F.lit(1), F.col("n") - need + 1).alias("prefix"),
            F.expr("aggregate(toks, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))").alias("map"),
            *(
                F.expr(f"if(n > {LONG}, aggregate(toks, 0L, (a, x) -> if((shiftright(x, 6) & 3) = {k}, a ^ shiftleft(1L, cast(x & 63 as int)), a)), 0L)").alias(m)
                for k, m in enumerate(MAPS) if k
            ),
        )
        .groupBy("h1", "h2").agg(
            F.min("own").alias("first"), F.count("*").alias("copies"),
            *(F.any_value(c).alias(c) for c in ("n", *MAPS, "prefix")),
        )
    )
    distinct = materialize(distinct, "lines")
    # null ids first; long ids are compared as they are
    if isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        order = F.coalesce(F.col("first.id").cast("long"), F.lit(-(1 << 63)))
    else:
        order = F.struct(F.col("first.id").isNotNull(), "first.id")
    ranked = distinct.select("h1", "h2", *MAPS, "n", "prefix", order.alias("ord"))
    size = F.col("n").cast("long") * (1 << 32)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose whole lines reach the threshold, read from where the lines are first.  A
        pair is named by one hash of each line; the other hash tells lines apart."""
        wanted = pairs.select(F.explode(F.array("h1", "g1")).alias("h1")).distinct()
        places = materialize(distinct.join(wanted, "h1", "left_semi").select("h1", "h2", "first"), f"{name}-places")
        rows = places.select(F.col("first.row_key").alias("row_key")).distinct()
        if places.count() <= broadcast_ids:  # else the keys are shuffled with the texts
            rows = F.broadcast(rows)
        bodies = (
            source.join(rows, "row_key", "left_semi")
            .select("row_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            .join(places.withColumn("row_key", F.col("first.row_key")).withColumn("line_no", F.col("first.line_no")), ["row_key", "line_no"])
            .groupBy("h1", "h2").agg(F.any_value("first").alias("first"), F.any_value("line").alias("line"))
        )
        bodies = materialize(bodies, f"{name}-bodies")
        other = bodies.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first").alias("first_y"), F.col("line").alias("line_y"))
        words = lambda c: F.array_remove(F.array_distinct(_split(F.col(c))), "")
        links = (
            pairs.join(bodies, "h1").join(other, "g1").where("h1 <> g1 or h2 <> g2")
            .select("h1", "h2", "first", words("line").alias("x"), "g1", "g2", "first_y", words("line_y").alias("y"))
            .where(F.size(F.array_intersect("x", "y")) * (den + num) >= (F.size("x") + F.size("y")) * num)
        )
        links = materialize(links.select("h1", "h2", "g1", "g2", "first", "first_y"), name)
        discard(places)
        discard(bodies)
        return links

    def later(links: DataFrame) -> DataFrame:
        x_late = F.col("first") > F.col("first_y")
        return links.select(
            F.when(x_late, F.col("h1")).otherwise(F.col("g1")).alias("h1"),
            F.when(x_late, F.col("h2")).otherwise(F.col("g2")).alias("h2"),
            F.when(x_late, F.col("first_y")).otherwise(F.col("first")).alias("match"),
        ).groupBy("h1", "h2").agg(F.min("match").alias("match"))

    # 2. the earliest line of two words in a row against the rest
    two = F.transform(F.sequence(F.lit(1), F.size("prefix") - 1), lambda i: F.xxhash64(F.get("prefix", i - 1), F.get("prefix", i)))
    keys = F.when(F.size("prefix") == 1, F.col("prefix")).otherwise(F.slice(F.sort_array(F.array_distinct(two)), 1, head_keys))
    in_list = Window.partitionBy("key").orderBy("ord", "h1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = (
        ranked.select("h1", *MAPS, size.alias("at"), "ord", F.explode(keys).alias("key"))
        .repartition(parts, "key")
        .withColumn("head", F.first(F.struct("h1", *MAPS, "at")).over(in_list))
        .where(F.expr(f"h1 <> head.h1 and {_passing('', 'head.', num, den, positions=False)}"))
        .select("h1", F.col("head.h1").alias("g1")).distinct()
    )
    heads = materialize(heads, "line-pairs-1")
    links = verified(heads, "line-links-1")
    # 3. lines without a match so far against all earlier lines
    done = materialize(later(links).select("h1", "h2"), "line-found")
    if done.count() <= broadcast_ids:  # else both sides are shuffled
        done = F.broadcast(done)
    # both sides of the join have the same columns and no filter of their own, so they read one
    # exchange; the last bit of ``at`` marks lines that have a match, and ``at`` is never negative
    posted = (
        ranked.join(done.withColumn("done", F.lit(1)), ["h1", "h2"], "left")
        .select("h1", *MAPS, "n", "ord", F.coalesce("done", F.lit(0)).alias("done"), F.posexplode("prefix").alias("pos", "tok"))
        .select("tok", "h1", *MAPS, (size + F.col("pos") * 2 + F.col("done")).alias("at"), "ord")
        .repartition(parts, "tok")
    )
    pairs = posted.alias("x").join(
        posted.alias("y"), F.expr(f"x.tok = y.tok and ((y.at & 1) = 0 or x.at < 0) and x.ord <= y.ord and x.h1 <> y.h1 and {_passing('x.', 'y.', num, den)}")
    ).select("y.h1", F.col("x.h1").alias("g1"))
    pairs = materialize(pairs.distinct(), "line-pairs-2").join(heads, ["h1", "g1"], "left_anti")
    links = links.unionByName(verified(pairs, "line-links-2"))

    # 4. what goes, by row
    removed = later(links)
    verdict = distinct.select("h1", "h2", "first", "copies").join(removed, ["h1", "h2"], "left").where("copies > 1 or match is not null")
    earlier = F.when(F.col("first") < own, F.least("first", F.coalesce("match", "first"))).otherwise(F.col("match"))
    gone = (
        named.select("id", "row_key", "line_no", "h1", "h2").join(verdict.select("h1", "h2", "first", "match"), ["h1", "h2"])
        .withColumn("earlier", earlier).where("earlier is not null")
        .groupBy("id", "row_key", "line_no").agg(F.any_value("earlier").alias("earlier"))
    )
    gone = materialize(gone, "lines-gone")
    nothing = F.lit(None).cast("array<int>")
    marks = (
        gone.groupBy("id", "row_key").agg(F.sort_array(F.collect_list("line_no")).alias("gone")).withColumn("n", F.lit(1).cast("long"))
        .unionByName(source.groupBy("id", "row_key").agg(F.count("*").alias("n")).where("n > 1").withColumn("gone", nothing))
        .groupBy("id", "row_key").agg(F.max("gone").alias("gone"), F.max("n").alias("n"))
    )
    marked = source.alias("s").join(marks.alias("m"), F.expr("s.row_key = m.row_key and s.id <=> m.id"), "left").select("s.*", "m.gone", "m.n")
    parted = F.split("text", "\n")
    solid = F.filter(F.transform(parted, lambda x, i: F.when(x.rlike(r"[^ \x09-\x0D]"), i)), lambda i: i.isNotNull())
    copies = (
        marked.where("n > 1").groupBy("id", "row_key").agg(F.any_value("text").alias("text"), F.any_value("gone").alias("gone"), F.max("n").alias("n"))
        .withColumn("copy", F.explode(F.expr("sequence(1L, n)")))
        .select("id", "text", F.when(F.col("copy") == 1, F.col("gone")).otherwise(solid).alias("gone"))
    )
    stay = F.filter(parted, lambda x, i: ~F.array_contains("gone", i))
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    chars = F.aggregate("gone", F.lit(0).cast("long"), lambda a, i: a + F.char_length(F.get(parted, i)))
    documents = marked.where("n is null or n = 1").select("id", "text", "gone").unionByName(copies).select(
        F.col("id").alias(id_col),
        F.when(F.col("text").isNull(), 1).otherwise(F.size(parted)).alias("n_lines"),
        n_gone.alias("n_removed"),
        F.coalesce(chars, F.lit(0)).alias("n_chars_removed"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"),
        F.when(n_gone == 0, F.col("text")).when(F.size(stay) > 0, F.array_join(stay, "\n")).alias("kept_text"),
    )
    return documents, gone.select(
        F.col("id").alias(id_col), "row_key", "line_no", F.col("earlier.id").alias("match_id"), F.col("earlier.line_no").alias("match_line")
    )
