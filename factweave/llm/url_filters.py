"""URL allow and block rules by a sort-merge range join.

A host is keyed by its reversed labels, each followed by a separator that sorts before all
others, so a rule's host and its subdomains form one interval of keys, and intervals of rules
are nested or apart.  URLs are range-partitioned and sorted on (key, path); each partition is
swept once in that order with a stack of the rules whose interval holds the current key, and a
rule on the stack fits if the path starts with the rule's.  The longest fitting rule wins.

Rules sorted by key go to every task if their text is at most ``max_rule_bytes``, which is
checked.  A larger rule table is joined instead: each distinct host asks for the rules of its
own suffixes (an equi-join on the host, as many rows as labels), then the same choice is made.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .exact_dedup import UPPER

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SEP = "\x01"


def host_key(host):
    """Reversed labels, each with a separator: interval bounds for a host and its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), SEP), F.lit(SEP))


def _split_rules(rules: DataFrame) -> DataFrame:
    at = F.expr("position('/' in rule)")
    return (
        rules.select("rule", "verdict")
        .where(F.col("rule").isNotNull() & (at > 0))
        .dropDuplicates(["rule", "verdict"])
        .withColumn("r_host", F.translate(F.expr("left(rule, position('/' in rule) - 1)"), UPPER, UPPER.lower()))
        .withColumn("r_path", F.expr("substring(rule, position('/' in rule))"))
        .withColumn("key", host_key(F.col("r_host")))
    )


def sweep(rows, rules: list[tuple[str, str, str, str]]):
    """For rows of (key, path) in order: the index of the winning rule, or -1."""
    nxt, stack = 0, []
    for key, path in rows:
        while nxt < len(rules) and rules[nxt][0] <= key:
            while stack and not rules[nxt][0].startswith(rules[stack[-1]][0]):
                stack.pop()
            stack.append(nxt)
            nxt += 1
        while stack and not key.startswith(rules[stack[-1]][0]):
            stack.pop()
        best = -1
        for i in stack:
            # longer rules win; of equal length the one with the longer host, then block
            if path.startswith(rules[i][1]) and (best < 0 or _rank(rules[i]) > _rank(rules[best])):
                best = i
        yield best


def _rank(rule: tuple[str, str, str, str]):
    return len(rule[2]), len(rule[0]), rule[3] == "block", rule[2]


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_rule_bytes: int = 16_000_000,
) -> DataFrame:
    """``(id, host, path, rule, verdict)``, one row per input row.

    ``rules(rule, verdict)`` as ``host/path``.  A null url, or one without ``://``, has an empty
    host and path; it fits no rule and takes ``default``.  Repeated rules count once, and a rule
    with both verdicts blocks; of different rules of one length the one with the longer host
    wins.  Rules without a slash or null are ignored.  Repeated rows and null ids stay.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_col), F.lit(""))
    urls = pages.select(
        F.col(id_col).alias("id"),
        F.translate(F.regexp_extract(url, PARTS, 1), UPPER, UPPER.lower()).alias("host"),
        F.regexp_extract(url, PARTS, 2).alias("path"),
    )
    parsed = _split_rules(rules)
    n_bytes = parsed.agg(F.sum(F.octet_length("rule") + 32)).first()[0] or 0
    if n_bytes > max_rule_bytes:
        return _joined(urls, parsed, id_col, default)
    table = sorted(tuple(r) for r in parsed.select("key", "r_path", "rule", "verdict").collect())
    shared = spark.sparkContext.broadcast(table)  # at most max_rule_bytes
    ordered = (
        urls.withColumn("key", host_key(F.col("host")))
        .repartitionByRange(partitions(spark), "key", "path", "id")
        .sortWithinPartitions("key", "path")
    )
    schema = ordered.select("id", "host", "path").schema.add("rule", "string").add("verdict", "string")

    def run(batches):
        own = shared.value

        feed: list = []

        def rows():
            while True:
                yield feed.pop()

        swept = sweep(rows(), own)
        for batch in batches:
            found = []
            for key, path in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                feed.append((key, path))
                found.append(next(swept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2),
                    pa.array([own[i][2] if i >= 0 else None for i in found], pa.string()),
                    pa.array([own[i][3] if i >= 0 else default for i in found], pa.string()),
                ],
                names=["id", "host", "path", "rule", "verdict"],
            )

    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _joined(urls: DataFrame, parsed: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same choice for a rule table of any size."""
    cut = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda i: F.array_join(F.slice(cut, i, F.size(cut)), "."))
    pairs = urls.select("host", "path").distinct().withColumn("r_host", F.explode(suffixes))
    best = (
        pairs.join(parsed, "r_host")
        .where(F.col("path").startswith(F.col("r_path")))
        .withColumn("rank", F.struct(F.length("rule"), F.length("key"), (F.col("verdict") == "block").alias("b"), "rule"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), "rank").alias("win"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("win.rule").alias("rule"),
        F.coalesce("win.verdict", F.lit(default)).alias("verdict"),
    )
