"""Secret scans: patterns for known shapes, and a token-efficiency test for random strings.

A byte-pair vocabulary spells ordinary words and identifiers with few tokens and random
strings with many.  Maximal runs of key-like characters that hold digits and letters are
encoded; a run with few characters per token is reported, unless it has the shape of a known
digest or identifier (hex digests, UUIDs, numbers and dates, words joined by separators).
Runs of fewer than 12 characters, the length the patterns ask for too, are not tested: four or
five tokens tell chance from spelling too rarely.

Scale: a map over documents.  Whole texts are searched; cheap byte searches decide which
documents the patterns need to see.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import chunks, text_bytes

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_WORDS = re.compile(rb"password|passwd|secret|token|api_?key", re.IGNORECASE)
_HEX = re.compile(rb"[0-9a-f]{16}")
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{12}")
KINDS = ("assign", "access", "hex", "random")

_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
_NAMES = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})(?:[-_/=+]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}))*[-_/=+]*")
_TIME = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9]{2}-?[0-9]{2}(?:-?[0-9]{2})?Z?")
#: Most characters per token of a random string of fewer characters than the key.
SHORT = {16: 1.7, 20: 1.9}

_ENCODINGS: dict = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def excluded(run: str) -> bool:
    """Shapes that are long without being secret."""
    return bool(
        not re.search(r"[A-Za-z]", run)
        or _DIGEST.fullmatch(run)
        or _UUID.fullmatch(run)
        or _TIME.fullmatch(run)
        or (run.isalpha() and len(set(run)) < 5)
    )


def random_string(run: str, encode, max_chars_per_token: float) -> bool:
    """Whether a run takes many tokens for its length; joined words by their letters, 12 at least."""
    if excluded(run):
        return False
    pieces = [run]
    if _NAMES.fullmatch(run):
        pieces = [x for x in re.split(r"[-_/=+]+", run) if x.isalpha()]
    n = sum(map(len, pieces))
    limit = min([max_chars_per_token, *(most for below, most in SHORT.items() if n < below)])
    return n >= 12 and n <= limit * sum(len(encode(x)) for x in pieces)


def scan(text: str, encode, max_chars_per_token: float) -> list[tuple[int, int, str]]:
    """All spans of one text as (start, kind index, end): base patterns, then random strings."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = []
    if _WORDS.search(raw):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _HEX.search(raw):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    if _RUN.search(raw):
        for m in RUN.finditer(text):
            if random_string(m[0], encode, max_chars_per_token):
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_chars_per_token: float = 2.2
) -> DataFrame:
    """``(id, n_assign, n_access, n_hex, n_random, base_spans, spans)``, one row per input row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind as in
    ``KINDS``; base spans always stay.  A null or empty text has none.  ``vocabulary`` is the
    path of a rank file every executor has.  ``max_chars_per_token`` holds from 20 characters on;
    below, ``SHORT`` is stricter.  Spans of different kinds may overlap and all are given; spans
    that start together are ordered by kind.  Repeated rows and null ids give as many rows.
    """
    schema = docs.select(id_col).schema
    for c in ("n_assign", "n_access", "n_hex", "n_random"):
        schema = schema.add(c, "long")
    schema = schema.add("base_spans", "string").add("spans", "string").add("base_sha256", "string")

    def run(batches):
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            for part in chunks(batch, text_col):
                out = [[] for _ in range(7)]
                for raw in text_bytes(part, text_col):
                    spans = []
                    if _WORDS.search(raw) or b"AKIA" in raw or _HEX.search(raw) or _RUN.search(raw):
                        spans = scan(raw.decode("utf-8", "replace"), encode, max_chars_per_token)
                    base = [s for s in spans if s[1] < 3]
                    for k in range(4):
                        out[k].append(sum(s[1] == k for s in spans))
                    out[4].append(_said(base))
                    out[5].append(_said(spans))
                    out[6].append(hashlib.sha256(out[4][-1].encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), *(pa.array(x, pa.string()) for x in out[4:])],
                    names=schema.names,
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
