"""Packing and mixing: round trips, constraints and targets."""

import collections
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factweave.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120) | st.text(alphabet="abÉéß.,'s 1<|endoftext|>\n\u0301\u00a0", max_size=60))
def test_tokenizer_agrees(text):
    tok = packing.tokenizer(PATH)
    raw = text.encode("utf-8", "replace")
    assert np.frombuffer(tok.encode(raw), dtype="<u4").tolist() == tok.inner.encode(raw.decode(), add_special_tokens=False).ids


def test_packing_round_trip(docs, rows, empty):
    tok = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH, max_tokens=256).collect()
    expected = collections.Counter()
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for p, lo in enumerate(range(0, len(ids), 256)):
            own = ids[lo : lo + 256]
            expected[(r[0], p, lo, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 256) * 1.1 + 1
    assert packing.pack(empty, PATH).count() == 0


@pytest.mark.parametrize("score", ["residual", "dot"])
def test_packing_under_three_binding_capacities(docs, rows, score):
    """Documents and attention bind as well as tokens; each is reached by some sequence."""
    limits = {"max_tokens": 256, "max_docs": 3, "max_attention": 256 * 200}
    docs = docs.where("octet_length(text) < 350")  # a piece of over 226 tokens would fit nowhere
    got = packing.pack(docs, PATH, score=score, weights=(1.0, 1.0, 1.0), **limits).collect()
    tokens, count, cost = collections.Counter(), collections.Counter(), collections.Counter()
    for r in got:
        tokens[r.sequence_id] += r.length
        count[r.sequence_id] += 1
        cost[r.sequence_id] += r.length**2
    assert len(got) == docs.count()
    assert max(tokens.values()) <= 256 and max(count.values()) == 3 and max(cost.values()) <= 256 * 200
    loose = {r.sequence_id for r in packing.pack(docs, PATH, max_tokens=256).collect()}
    assert len(loose) < len(tokens) <= 2 * max(-(-sum(tokens.values()) // 256), -(-len(got) // 3), -(-sum(cost.values()) // (256 * 200)))
    with pytest.raises(ValueError, match="fits no empty bin"):
        packing.pack(docs, PATH, max_tokens=256, max_attention=4).count()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200), st.sampled_from(["residual", "dot"]), st.integers(1, 64), st.integers(4096 // 4, 4096))
def test_plan_keeps_every_capacity(lengths, score, docs, attention):
    attention = max(attention, max(lengths) ** 2)
    steps = packing.plan(np.bincount(lengths, minlength=65), 64, docs, attention, score)
    tokens, count, cost = collections.Counter(), collections.Counter(), collections.Counter()
    done = collections.Counter()
    for length, rank, n, first, per, offset in steps.tolist():
        assert rank == done[length]
        done[length] += n
        for j in range(n):
            b = first + j // per
            assert offset + (j % per) * length == tokens[b]
            tokens[b] += length
            count[b] += 1
            cost[b] += length * length
    assert done == collections.Counter(lengths)
    assert max(tokens.values()) <= 64 and max(count.values()) <= docs and max(cost.values()) <= attention


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(1, 9), st.integers(0, 5))
def test_splitting_tree_is_exact(blocks, shards, seed):
    quotas = mixing.splitting_tree(np.array(blocks), shards, seed)
    assert quotas.sum(axis=0).tolist() == blocks and (quotas >= 0).all()
    sizes = quotas.sum(axis=1)
    assert sizes.max() - sizes.min() <= max(2, shards.bit_length())


def test_targets():
    got = mixing.targets([("b", 100), (None, 40), ("a", 10)])
    assert got["a"] == 20 and sum(got.values()) == Fraction(225) and got["b"] + got[None] == 205 and got[None] == 80 and got["b"] == 125


def test_mixing(spark, docs, rows, empty):
    sized, pieces = mixing.mix_sources(docs, block_words=64, shards=5, bucket_rows=3)
    per = {r.source: r for r in sized.groupBy("source").agg(F.max("source_size").alias("size"), F.max("target").alias("target"), F.sum("size").alias("sum")).collect()}
    taken = {r.source: r.taken for r in pieces.groupBy("source").agg(F.sum("length").alias("taken")).collect()}
    assert sized.count() == len(rows)
    for s, r in per.items():
        assert r.size == r["sum"] and abs(taken[s] - r.target) <= 1
    p = pieces.collect()
    again = mixing.mix_sources(docs.repartition(2), block_words=64, shards=5, bucket_rows=3)[1].collect()
    key = lambda r: (str(r.doc_id), r.key, r.row, r.copy, r.start, r.length, r.block, r.shard)
    assert sorted(map(key, p)) == sorted(map(key, again))
    assert mixing.mix_sources(empty)[1].count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()
    whole, _ = mixing.mix_sources(docs)
    want = {r.source: r.target for r in whole.groupBy("source").agg(F.max("target").alias("target")).collect()}
    assert all(abs(r.n - want[r.source]) <= 1 for r in words)


def test_mixing_of_repeated_rows(spark):
    """Every row takes at most twice its own size, and a source's rows add up to its target."""
    rows = [(1, "a b c d e", "s")] * 2 + [(2, "f g h", "s")] + [(None, "x " * 40, "t")] * 3000 + [(3, "x y", "t"), (3, "x y", "u"), (4, None, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.taken_of(*mixing.mix_sources(docs, block_words=16, shards=3, bucket_rows=2)).collect()
    assert collections.Counter((r.doc_id, r.source) for r in got) == collections.Counter((d, s) for d, _, s in rows)
    total = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        total[r.source] += r.taken
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = mixing.targets(list(size.items()))
    assert all(abs(total[s] - want[s]) <= 1 for s in size)
    mixed = mixing.mixed_documents(docs, block_words=16, shards=3).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()
    assert all(abs(r.n - want[r.source]) <= 1 for r in mixed)


def test_mixed_documents_keep_columns_of_any_name(spark):
    rows = [(i, f"w{i} " * (i + 1), "s", i * 10, -i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key long, shard long")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert all(r.key == 10 * r.doc_id and r.shard == -r.doc_id for r in got.collect())


def test_mixed_documents_follow_the_shards(docs):
    """Within a partition the order of rows is the tree's, not that of the stream."""
    options = {"block_words": 64, "shards": 5}
    _, pieces = mixing.mix_sources(docs, **options)
    first = collections.defaultdict(dict)  # of each reading the shard of its first piece
    for r in pieces.collect():
        k = (r.doc_id, r.source)
        if r.start <= first[k].get((r.row, r.copy), (r.start,))[0]:
            first[k][(r.row, r.copy)] = (r.start, r.shard)
    known = {k: {s for _, s in v.values()} for k, v in first.items()}
    parts = collections.defaultdict(list)
    for r in mixing.mixed_documents(docs, **options).withColumn("part", F.spark_partition_id()).collect():
        if len(known[(r.doc_id, r.source)]) == 1:  # all readings are in one shard
            parts[r.part] += known[(r.doc_id, r.source)]
    assert max(len(set(x)) for x in parts.values()) > 1 and all(x == sorted(x) for x in parts.values())


def test_hypergeometric_draws_of_any_size():
    rng = np.random.default_rng(4)
    for good, bad, draws in ((30, 50, 20), (5, 0, 3), (1, 9, 10), (700, 300, 999), (0, 4, 2)):
        got = np.array([mixing._hypergeometric(rng, good, bad, draws) for _ in range(4000)])
        assert got.min() >= max(0, draws - bad) and got.max() <= min(good, draws)
        own = np.random.default_rng(5).hypergeometric(good, bad, draws, 4000)
        assert abs(got.mean() - own.mean()) < 0.15 * (1 + own.std()) and abs(got.std() - own.std()) < 0.1 * (1 + own.std())
    good, bad, draws = 3_000_000_000, 5_000_000_000, 4_000_000_001  # over numpy's own limit
    got = np.array([mixing._hypergeometric(rng, good, bad, draws) for _ in range(300)])
    n = good + bad
    deviation = (draws * (good / n) * (bad / n) * (n - draws) / (n - 1)) ** 0.5
    assert abs(got.mean() - draws * good / n) < 0.3 * deviation and 0.85 < got.std() / deviation < 1.15
    quotas = mixing.splitting_tree(np.array([2_000_000_001, 7, 3_000_000_000]), 4)
    assert quotas.sum(axis=0).tolist() == [2_000_000_001, 7, 3_000_000_000] and np.ptp(quotas.sum(axis=1)) <= 3


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_quality(text):
    w = WORD.findall(text)

    def cover(n):
        seen = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return len({j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)})

    if len(w) < 50 or 2 * cover(3) > len(w):
        return False
    seen = collections.Counter(tuple(w[i : i + 201]) for i in range(len(w) - 200))
    return 4 * cover(8) <= len(w) and max(seen.values(), default=1) < 2


def brute_near(rows):
    """Of (id, text): the ids that stay; null ids are never the smallest."""
    grams = []
    for _, t in rows:
        w = WORD.findall(t.translate(LOWER))
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, (d, _) in zip(group, rows, strict=True):
        best[g] = min(best.get(g, (True, 0)), (d is None, d or 0))
    return sorted(str(None if none else d) for none, d in best.values())


def test_pipeline_against_brute_force(spark, docs, rows, tmp_path):
    """All rows: null ids, a row twice and one id with two texts included."""
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    frames, cur = [], own
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, cur, "").write.parquet(str(tmp_path / name))
        cur = spark.read.parquet(str(tmp_path / name))
        frames.append(cur)
    ids = lambda x: sorted(str(r.doc_id) for r in x.collect())
    left = [(r[0], r[1]) for r in rows if r[1] and brute_quality(r[1])]
    assert ids(frames[0]) == sorted(str(d) for d, _ in left)
    assert len(left) > len(set(left)) or any(d is None for d, _ in left)
    best = {}
    for d, t in left:
        k = t.translate(LOWER)
        best[k] = max(best.get(k, (False, 0, t)), (d is not None, d or 0, t))
    left = [(d if has else None, t) for has, d, t in best.values()]
    assert ids(frames[1]) == sorted(str(d) for d, _ in left)
    assert ids(frames[2]) == brute_near(left)
    texts, mixed = collections.defaultdict(list), frames[3].collect()
    for d, t in left:
        texts[d].append(t)
    size = collections.Counter()
    for r in frames[2].collect():
        size[r.source] += len(WORD.findall(r.text))
    want, got = mixing.targets(list(size.items())), collections.Counter()
    for r in mixed:
        got[r.source] += len(WORD.findall(r.text))
        assert any(t.startswith(r.text) for t in texts[r.doc_id]) and len(WORD.findall(r.text)) > 0
    assert all(abs(got[s] - want[s]) <= 1 for s in size)
    tok = Tokenizer.from_file(PATH)
    lengths = sorted(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    whole = collections.Counter()
    for r in frames[4].collect():
        assert r.offset + r.length <= 4096
        whole[r.sequence_id] += r.length
    assert sum(whole.values()) == sum(lengths) and max(whole.values()) <= 4096


def test_pipeline_stages(spark, docs, empty, tmp_path):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (own, own.limit(0)):
        cur = frame
        for name, stage in corpus_pipeline.STAGES:
            out = str(tmp_path / f"{name}-{frame is own}")
            stage(spark, cur, "").write.parquet(out)
            cur = spark.read.parquet(out)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert cur.columns == own.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_join", "mixing", "packing"]


