"""Vector codes, the prefix trie and the chosen-path join against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.llm import chosen_path, prefix_trie, vector_codes
from factweave.llm.common import lookup, materialize

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- vector codes


def lloyd(rows, parts, entries, rounds, factor):
    """Every distance of every part and entry, with Python's integers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) and abs(x) < vector_codes.LIMIT for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    cut = []
    for _, v, _ in kept:
        whole = [math.floor(factor * x) for x in v] + [0] * (width * parts - len(v))
        cut.append([whole[p * width : (p + 1) * width] for p in range(parts)])
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for v in cut:
                groups[nearest(p, v[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else b for e, b in enumerate(books[p])]
    found = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    labels = collections.Counter()
    for r, f in zip(kept, found, strict=True):
        labels[r[2]] += sum(d for d, _ in f)
    told = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), labels[r[2]], told) for r, f in zip(kept, found, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 7, "k") for r in rows], "vec_id long, embedding array<float>, label int, id long, part string").repartition(3)


def codes(found):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect())


@pytest.mark.parametrize(("dim", "n", "parts", "entries"), [(8, 150, 4, 9), (6, 60, 4, 64), (4, 5, 2, 9)])
def test_vector_codes(spark, dim, n, parts, entries):
    rng = random.Random(dim)
    # few values, so that distances tie and rows repeat
    rows = [(rng.randint(0, n), [rng.choice((-0.5, -0.25, 0.0, 0.125, 0.3, 9.5)) for _ in range(dim)], rng.choice((1, 2, None))) for _ in range(n)]
    odd = [None, [], [None] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [0.0] * (dim + 1), [1e9] * dim]
    rows += [(-5 - i, v, 1) for i, v in enumerate(odd) if i != 5] + [(10**6, odd[5], 1), (None, [0.25] * dim, None), rows[0]]
    got, books = vector_codes.vector_codes(vectors(spark, rows), parts=parts, entries=entries)
    assert codes(got) == lloyd(rows, parts, entries, 2, 256)
    assert len(books) == parts and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_vector_codes_of_an_empty_table(spark):
    assert vector_codes.vector_codes(vectors(spark, []))[0].count() == 0
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 2)]))[0].count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 12), st.integers(1, 3))
def test_bounds_hold_and_prune(seed, n, width):
    """After moves of the entries the bounds still enclose the distances, and the entry is the nearest."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-30, 30, (40, width))
    book = rng.integers(-30, 30, (n, width))
    best, upper, lower = np.zeros(40, dtype=np.int64), np.full(40, 1 << 30), np.zeros((40, n), dtype=np.int64)
    for _ in range(3):
        best, upper, lower, done = vector_codes.reassign(x, book, best, upper, lower)
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (best == d.argmin(axis=1)).all() and done <= 40 * (n + 1)
        assert (upper**2 >= 16 * d[np.arange(40), best]).all() and (lower**2 <= 16 * d).all()
        new = book + rng.integers(-2, 3, book.shape)
        moved = vector_codes._upper(vector_codes.squared(book, new))
        upper, lower, book = upper + moved[best], np.maximum(lower - moved, 0), new


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    book = rng.integers(-1000, 1000, (64, 4))
    x = book[rng.integers(0, 64, 5000)] + rng.integers(-20, 20, (5000, 4))
    start = (np.zeros(5000, dtype=np.int64), np.full(5000, 1 << 60), np.zeros((5000, 64), dtype=np.int64))
    best, upper, lower, _ = vector_codes.reassign(x, book, *start)
    *_, done = vector_codes.reassign(x, book, best, upper + 8, np.maximum(lower - 8, 0))
    assert done < 5000 * 64 / 20


def test_lookup_of_heavy_and_light_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 7 if i % 2 else i) for i in range(9000)], "i long, k long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("total"))
    got = lookup(rows, materialize(table, "sums"), "k", "n").collect()
    totals = collections.Counter()
    for r in rows.collect():
        totals[r.k] += r.i
    assert sorted((r.i, r.k or -1, r.total) for r in got) == sorted((r.i, r.k or -1, totals[r.k]) for r in rows.collect())


# --- prefix trie


def trie(paths):
    """Of ``{id: [(role, text), ...]}`` every node by its sequence."""
    members = collections.defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample([c for c in range(-150, 5 * n) if not 100 <= c < 110], n):
        for t in range(rng.choice((0, 1, 1, 2, 3, 6, 9))):
            rows.append((c, t, rng.choice(("user", None, "")), rng.choice(("a", "é" * 5, "", None, "bb", "c" * 30)), 3, "k"))
    rows += [(100, t, "user", "a", 3, "k") for t in range(8)]
    rows += [(c, t, "user", f"long {t % 2}", 3, "k") for c in (101, 102, 103) for t in range(40 if c == 103 else 60)]
    rows += [(c, t, "user", f"copy {t}", 3, "k") for c in range(9000, 9060) for t in range(7)]
    rows += [(107, None, "user", "null comes first", 3, "k"), (107, 0, "user", "z", 3, "k"), (None, 0, "user", "no id", 3, "k"), (108, 0, "u", "twice", 3, "k"), (108, 0, "u", "twice", 3, "k")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "shared"), [(1, 60, True), (2, 300, False), (3, 300, True)])
def test_prefix_trie(spark, seed, n, shared):
    rows = conversations(seed, n)
    own = collections.defaultdict(list)
    for c, t, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, name string").repartition(3)
    paths = prefix_trie.paths_of(df)
    got = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(paths) if shared else paths)
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie(rebuilt(own) if shared else own)


def test_prefix_trie_of_no_and_of_turnless_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.paths_of(none)).count() == 0
    one = spark.createDataFrame([(5, "")], "id long, path string")
    assert [tuple(r) for r in prefix_trie.prefix_trie(one).collect()] == trie({5: []})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=6), min_size=1, max_size=25), st.integers(1, 6))
def test_points_of_runs_add_up(texts, runs):
    """However sorted paths are cut into runs, points that meet have sums of the whole."""
    token = {x: hashlib.md5(x.encode()).hexdigest() + f"{3 if x == 'a' else 5:08x}" for x in "ab"}
    count = collections.Counter("".join(token[x] for x in t) for t in texts)
    order = sorted(count)
    rows = []
    for i, p in enumerate(order):
        common = prefix_trie._common(order[i - 1], p) if i else 0
        rows.append((p, count[p], i, common, not (i + 1 < len(order) and order[i + 1].startswith(p))))

    def total(cuts):
        out = {}
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for name, _, depth, up, n, least, leaves, saved, kids, *_ in prefix_trie.closed_points(rows[lo:hi]):
                had = out.get(name, (depth, 0, 1 << 30, 0, 0, 0))
                out[name] = (depth, had[1] + n, min(had[2], least), had[3] + leaves, had[4] + saved, had[5] + kids)
        return out

    whole = total([0, len(rows)])
    cut = total(sorted({0, len(rows), *(i * len(rows) // runs for i in range(runs))}))
    assert all(cut[k] == v for k, v in whole.items())


# --- chosen paths


def components(rows, k, num, den):
    def grams(text):
        w = WORD.findall((text or "").translate(LOWER))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [grams(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))


@pytest.mark.parametrize("limits", [{}, {"node_rows": 2, "block_rows": 4, "levels": 2, "star_rows": 2, "broadcast_ids": 0}])
@pytest.mark.parametrize(("k", "threshold"), [(2, (80, 100)), (5, (80, 100))])
def test_chosen_path_join(docs, rows, k, threshold, limits):
    got = chosen_path.chosen_path_join(docs, k=k, threshold=threshold, **limits).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows, k, *threshold)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("levels", [1, 4])
def test_chosen_path_join_of_large_families(spark, levels):
    """Families of near copies and of texts just below the threshold, in nodes that branch."""
    rng = random.Random(11)
    rows = []
    for f, (size, edits) in enumerate(((90, 3), (60, 13), (2, 5))):
        base = [f"f{f}w{i}" for i in range(90)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = chosen_path.chosen_path_join(docs, k=2, node_rows=16, block_rows=30, levels=levels).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows, 2, 80, 100)


def test_chosen_path_join_confirms_few_pairs_of_a_family_below_the_threshold(spark, monkeypatch):
    """Of 90 texts that share two thirds of their n-grams nearly no pair reaches the confirmation."""
    rng = random.Random(12)
    rows = []
    for i in range(90):
        w = [f"w{j}" for j in range(120)]
        for j in rng.sample(range(120), 6):
            w[j] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    pairs, write = [], chosen_path.materialize

    def counted(df, name):
        out = write(df, name)
        if name.startswith(("path-first", "path-new-")) or name == "path-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(chosen_path, "materialize", counted)
    got = chosen_path.chosen_path_join(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows, 2, 80, 100)
    assert sum(pairs) <= 90


def test_chosen_path_join_of_an_empty_table(empty):
    assert chosen_path.chosen_path_join(empty).count() == 0


def test_least_matches_keeps_pairs_at_the_threshold():
    at = chosen_path.least_matches(32, 80, 100)
    rng = np.random.default_rng(2)
    assert 10 <= at <= 18 and (rng.binomial(32, 0.8, 200_000) < at).sum() <= 3
