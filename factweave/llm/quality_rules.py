"""Quality rules: counting rules and repetition found with a suffix array.

For each document an enhanced suffix array is built over its words: suffixes in order and the
longest common prefix (LCP) of neighbours.  The maximal LCP intervals are the maximal repeated
word strings; the spans of all their occurrences are united, and the share of words covered
and the longest repeat are limited.  Suffix arrays of many documents are built in one
vectorised prefix doubling; suffixes never reach past their own document, and only suffixes
that still tie are sorted again.

Scale: a map over documents without a shuffle; memory follows a batch of about 0.75 MB of text
or the longest single document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import SPACE, chunks, joined, text_bytes, word_hashes, word_spans

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def suffix_array(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over ``values`` cut at the ends of each ``doc`` (given in order), sorted by
    document first, and the LCP of each suffix with the one before it in that order."""
    n = len(values)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    end = np.searchsorted(doc, doc, side="right")  # a suffix ends with its document
    order = np.lexsort((values, doc))
    new = np.ones(n, dtype=bool)
    new[1:] = (values[order[1:]] != values[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    rank = np.empty(n, dtype=np.int64)
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    ranks = [rank.astype(np.int32)]
    step = 1
    sizes = np.diff(np.append(heads, n))
    tied = np.repeat(sizes > 1, sizes)
    while tied.any():
        at = np.flatnonzero(tied)
        pos = order[at]
        nxt = pos + step
        second = np.where(nxt < end[pos], rank[np.minimum(nxt, n - 1)], -1)
        first = rank[pos]
        by = np.lexsort((second, first))
        pos, first, second = pos[by], first[by], second[by]
        order[at] = pos  # groups keep their places: ``at`` is sorted and so is ``first``
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, len(at)))
        rank[pos] = np.repeat(at[head], size)
        ranks.append(rank.astype(np.int32))
        tied[at] = np.repeat(size > 1, size)
        step *= 2
    # LCP of neighbours from the ranks of each doubling, longest first
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, dtype=np.int64)
    got = np.zeros(n - 1, dtype=np.int64)
    width = 1 << (len(ranks) - 1)
    for r in reversed(ranks):
        fit = (a + width <= end[order[:-1]]) & (b + width <= end[order[1:]])
        same = np.zeros(n - 1, dtype=bool)
        at = np.flatnonzero(fit)
        same[at] = r[a[at]] == r[b[at]]
        a[same] += width
        b[same] += width
        got[same] += width
        width >>= 1
    lcp[1:] = got
    return order, lcp


def covered(order: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per position: whether it lies in a repeated string of ``least`` elements or more, and the
    length of the longest repeat that starts there (0 if shorter than ``least``).

    A suffix lies in LCP intervals whose deepest has the larger of its two LCPs, so the spans
    of the maximal intervals are these."""
    n = len(order)
    deepest = np.zeros(n, dtype=np.int64)
    if n:
        both = lcp.copy()
        both[:-1] = np.maximum(lcp[:-1], lcp[1:])
        deepest[order] = np.where(both >= least, both, 0)
    mark = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(deepest)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + deepest[at], -1)
    return np.cumsum(mark[:-1]) > 0, deepest


def measure(texts: list[bytes], min_repeat: int) -> dict[str, np.ndarray]:
    data, starts = joined(texts)
    first, last, at = word_spans(data, starts)
    n_docs = len(texts)
    n_words = np.diff(at)
    doc = np.repeat(np.arange(n_docs), n_words)

    def by_doc(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x) + 1, dtype=np.int64)
        np.cumsum(x, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    def by_text(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x) + 1, dtype=np.int64)
        np.cumsum(x, out=total[1:])
        return total[starts[1:]] - total[starts[:-1]]

    chars = by_text(((data & 0xC0) != 0x80) & ~SPACE[data])
    symbols = by_text(SYMBOLS[data])
    hashes = word_hashes(data, first, last)
    _, values = np.unique(hashes, return_inverse=True)
    order, lcp = suffix_array(values.astype(np.int64), doc)
    in_three, _ = covered(order, np.minimum(lcp, 3), 3)
    in_long, longest = covered(order, lcp, min_repeat)
    longest_by = np.zeros(n_docs, dtype=np.int64)
    np.maximum.at(longest_by, doc, longest)
    dup = np.zeros(n_docs, dtype=np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": n_words.astype(np.int64), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup,
        "n_repeat_words": by_doc(in_three), "n_covered_words": by_doc(in_long), "longest_repeat": longest_by,
    }


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_repeat: int = 8,
    max_covered: float = 0.25,
    max_longest: int = 200,
    passthrough: bool = False,
) -> DataFrame:
    """One row per document: counts, ``base_failed``, and the repetition verdict ``kept``.

    ``base_failed``: fewer than 50 words, or over half of the words in 3-word windows that occur
    twice or more.  Else ``kept`` unless maximal repeated strings of ``min_repeat`` words or more
    cover over ``max_covered`` of the words, or one is longer than ``max_longest`` words.
    Words so covered also lie in repeated 3-word windows, so a ``max_covered`` of a half or more
    never adds to the base rules.

    A null or empty text has no words and fails.  With ``passthrough`` the rows keep all columns
    of ``docs`` instead, and rejected rows go.  Rows are judged one by one, so repeated rows and
    null ids just give as many rows.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]
    if passthrough:
        schema, source = docs.schema, docs
    else:
        source = docs.select(id_col, text_col)
        schema = docs.select(id_col).schema
        for c in counts:
            schema = schema.add(c, "long")
        schema = schema.add("base_failed", "boolean").add("kept", "boolean")

    def judge(batches):
        for batch in batches:
            for part in chunks(batch, text_col):
                m = measure(text_bytes(part, text_col), min_repeat)
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                kept = ~failed & (m["n_covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
                if passthrough:
                    yield part.filter(pa.array(kept))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), *(pa.array(m[c], pa.int64()) for c in counts), pa.array(failed), pa.array(kept)],
                        names=[id_col, *counts, "base_failed", "kept"],
                    )

    return source.mapInArrow(judge, schema)
