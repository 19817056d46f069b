"""Exact, suffix-array, line and n-gram deduplication against brute force."""

import collections
import hashlib
import random
import re

import pytest

from factweave.llm import exact_dedup, line_dedup, ngram_join, suffix_dedup
from factweave.llm.common import connected_components, discard, keep_rows, materialize

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _id(x):
    return (x is not None, x if x is not None else 0)


@pytest.mark.parametrize("block", [16, 8192])
def test_exact_dedup(docs, rows, block):
    got = exact_dedup.exact_dedup(docs, block_bytes=block).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    expected = sorted((str(i), str(max(g, key=_id)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_keep_rows_keeps_columns_and_one_of_repeated_rows(docs, rows):
    kept = keep_rows(docs, exact_dedup.exact_dedup(docs).where("kept"))
    assert kept.columns == docs.columns
    assert kept.count() == len({(r[1] or "").translate(LOWER) for r in rows})


def test_keep_rows_leaves_a_column_of_the_keys_name(spark):
    docs = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "doc_id long, text string, factweave_row_key long")
    kept = keep_rows(docs, exact_dedup.exact_dedup(docs).where("doc_id = 2"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "b", 8)]


def test_keep_rows_takes_one_row_however_rows_are_dealt(spark):
    """Rows that repeat id and text and differ in source: the same one stays for any partitioning."""
    rows = [(i % 40 or None, f"text {i % 40}", f"s{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = exact_dedup.exact_dedup(docs).where("kept")
    found = [sorted(map(str, keep_rows(d, kept).collect())) for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy("source").repartition(3))]
    assert found[0] == found[1] == found[2] and len(found[0]) == 40


def test_discard_deletes_a_table_and_no_other(spark):
    one, two = materialize(spark.range(5), "one"), materialize(spark.range(7), "two")
    discard(one)
    assert two.count() == 7
    with pytest.raises(Exception, match="(?i)not.?exist|FILE_NOT|cannot"):
        one.count()


@pytest.mark.parametrize("group", [2, 50_000])
def test_suffix_dedup(docs, rows, group):
    got = suffix_dedup.repeated_spans(docs, length=200, max_group=group, with_kept=True).collect()
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = collections.Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    expected = []
    for d, t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                mark[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        runs = len(re.findall(b"\1+", bytes(mark)))
        expected.append((str(d), len(t), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(expected)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_dedup_of_many_repeated_rows(spark):
    """Ten thousand copies of a row cost as one; short ones stay, long ones go."""
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(4000))
    rows = [(None, long)] * 5000 + [(7, long)] * 3000 + [(8, "short")] * 2000 + [(9, "x" + long[500:800] + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.repeated_spans(docs).collect())
    assert got == {(None, 4000, 4000, 1): 5000, (7, 4000, 4000, 1): 3000, (8, 5, 0, 0): 2000, (9, 302, 300, 1): 1}


@pytest.mark.parametrize("limits", [{}, {"list_rows": 3, "star_rows": 2, "broadcast_ids": 0}])
@pytest.mark.parametrize(("k", "threshold"), [(4, (85, 100)), (5, (80, 100))])
def test_ngram_join(docs, rows, k, threshold, limits):
    got = ngram_join.ngram_join(docs, k=k, threshold=threshold, **limits).collect()
    num, den = threshold

    def grams(text):
        w = WORD.findall((text or "").translate(LOWER))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [grams(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    expected = sorted((str(r[0]), len(sets[i]), str(least.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == expected


def _lines_that_go(rows):
    """By brute force: of each (id, text) the numbers of the lines that go, and how many lines it has."""
    # rows with one id are in the order of a hash that only the operator knows: both orders count
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (_id(r[0]), str(r[1])))
    seen, gone = [], {}
    for d, t in order:
        gone[(d, t)] = set()
        for i, x in enumerate((t or "").split("\n")):
            w = frozenset(WORD.findall(x))
            if not w:
                continue
            for y, v in seen:
                both = len(w & v)
                if x == y or 100 * both >= 80 * (len(w) + len(v) - both):
                    gone[(d, t)].add(i)
                    break
            seen.append((x, w))
    return gone


def _kept_text(text, gone):
    rest = [x for i, x in enumerate((text or "").split("\n")) if i not in gone]
    return text if not gone else "\n".join(rest) if rest else None


def test_line_dedup(docs, rows):
    unique = collections.Counter(r[0] for r in {(r[0], r[1]) for r in rows})
    keep = [r for r in rows if unique[r[0]] == 1]  # the order of one id's texts is not known here
    ids = [r[0] for r in keep]
    got = line_dedup.line_dedup(docs.where(docs.doc_id.isin(ids)))[0].collect()
    gone = _lines_that_go(keep)
    expected = []
    for n, (d, t, *_) in enumerate(keep):
        lines = (t or "").split("\n")
        own = gone[(d, t)] if (d, t) not in [(r[0], r[1]) for r in keep[:n]] else {i for i, x in enumerate(lines) if WORD.search(x)}
        expected.append((d, len(lines), sorted(own), sum(len(lines[i]) for i in own), _kept_text(t, own)))
    assert sorted((r.doc_id, r.n_lines, list(r.removed_lines), r.n_chars_removed, r.kept_text) for r in got) == sorted(expected, key=lambda x: (x[0], x[1], x[2]))
    assert all(r.n_removed == len(r.removed_lines) for r in got)


def test_line_dedup_counts_every_row(docs, rows):
    got = line_dedup.line_dedup(docs)[0].collect()
    assert len(got) == len(rows)
    assert sum(r.n_lines for r in got) == sum(len((r[1] or "").split("\n")) for r in rows)


@pytest.mark.parametrize("ids", ["none", "few"])
def test_line_dedup_of_null_ids(spark, ids):
    """Families of near copies, one line a document: all but the first of a family go."""
    rng = random.Random(3)
    rows = []
    for f in range(12):
        base = [f"w{f}x{i}" for i in range(30)]
        for c in range(6):
            w = list(base)
            w[rng.randrange(30)] = f"n{f}c{c}"
            rows.append((None if ids == "none" or c % 2 else len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = line_dedup.line_dedup(docs)[0].collect()
    assert len(got) == 72 and sum(r.n_removed for r in got) == 60
    if ids == "few":  # null ids come first, so no line with an id stays
        assert all(r.n_removed == 1 for r in got if r.doc_id is not None)


def test_line_dedup_pairs_lines_of_null_ids(spark):
    lines = []
    for k in range(12):  # a line with the rare words of two near copies heads some of their lists
        w = [f"w{k}x{i}" for i in range(19)]
        lines += [" ".join([*w, *(f"v{i}" for i in range(40))]), " ".join([*w, f"one{k}"]), " ".join([*w, f"two{k}"])]
    docs = spark.createDataFrame([(None, "\n".join(lines))], "doc_id long, text string")
    found, removed = line_dedup.line_dedup(docs)
    assert found.first().removed_lines == [i for i in range(36) if i % 3 == 2]
    assert sorted((r.line_no, r.match_line) for r in removed.collect()) == [(i, i - 1) for i in range(2, 36, 3)]


def test_line_dedup_sorts_plain_longs(docs, monkeypatch):
    """The words of a line are an array without nulls, which Spark sorts without boxing them."""
    schemas, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: schemas.setdefault(name, df.schema) and write(df, name))
    assert line_dedup.line_dedup(docs)[0].count() == docs.count()
    assert not schemas["lines"]["prefix"].dataType.containsNull


def test_line_dedup_of_text_ids_and_long_lists(spark):
    """Ids that are no numbers, lines of many common words, and a shuffle in place of broadcasts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"d{i:03d}", " ".join(rng.sample(words, rng.randint(1, 20)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: list(r.removed_lines) for r in line_dedup.line_dedup(docs, broadcast_ids=0)[0].collect()}
    seen = []
    for d, t in rows:
        w = set(t.split())
        assert got[d] == ([0] if any(len(w & v) * 100 >= 80 * len(w | v) for v in seen) else []), d
        seen.append(w)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (100, 102), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[229] == 200 and len(got) == 41 + 3 + 30


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert suffix_dedup.repeated_spans(empty).count() == 0
    assert ngram_join.ngram_join(empty).count() == 0
    assert line_dedup.line_dedup(empty)[0].count() == 0
