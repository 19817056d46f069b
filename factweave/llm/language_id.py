"""Language identification with error-correcting output codes.

Every language has a codeword of bits; for each bit a binary n-gram classifier tells the
languages with 1 from those with 0.  A classifier is linear: the mean, over all byte trigrams
of the text, of the log ratio of the trigram's smoothed frequency in either set of languages.
Decoding weighs each bit by how well its classifier did in training and chooses the codeword
of least weighted logistic loss; a small margin to the next codeword flags ambiguity.

Training counts trigrams of all labelled training rows: each task emits counts per language,
which are added up; what reaches the driver is bins x languages.  Scales and weights of the
bits are fitted on a bounded sample: of each language the ``calibration_rows`` distinct texts
of least hash among those that a hash chooses, the same on every run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import chunks, joined, text_bytes


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codes of +1 and -1: all splits for up to six languages, else random ones of length
    15 log2 n, the best of 50 draws by least distance.  No bit is constant."""
    if n < 2:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 6:
        bits = np.array([[(c >> i) & 1 for c in range(1, 1 << (n - 1))] for i in range(n - 1)] + [[0] * ((1 << (n - 1)) - 1)])
        return (1 - 2 * bits).astype(np.int8)
    rng = np.random.default_rng(seed)
    length, best, found = int(np.ceil(15 * np.log2(n))), -1, None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, length))
        for b in range(length):
            while abs(int(code[:, b].sum())) == n:
                code[:, b] = rng.choice(np.array([-1, 1], dtype=np.int8), size=n)
        apart = (length - code.astype(int) @ code.T.astype(int)) // 2 + length * np.eye(n, dtype=int)
        if apart.min() > best:
            best, found = apart.min(), code
    return found


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # bins x bits, log ratios
    bias: np.ndarray  # bits
    scale: np.ndarray  # bits
    trust: np.ndarray  # bits, adding up to 1


def _bins(data: np.ndarray, n_bins: int) -> np.ndarray:
    """The bin of the trigram at each byte but the last two."""
    x = data.astype(np.uint32)
    key = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(8)) & np.uint32(n_bins - 1)


def _within(starts: np.ndarray, n: int) -> np.ndarray:
    """Which trigrams lie within one text (its closing line feed included)."""
    ok = np.ones(n, dtype=bool)
    for back in (1, 2):
        at = starts[1:] - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def count_trigrams(docs: DataFrame, text_col: str, lang_col: str, n_bins: int) -> DataFrame:
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, text_col):
                langs = part.column(1).to_pylist()
                data, starts = joined(text_bytes(part, text_col, lower=True))
                if len(data) < 3:
                    continue
                bins = _bins(data, n_bins)
                bins[~_within(starts, len(bins))] = n_bins  # dropped below
                for i, lang in enumerate(langs):
                    own = totals.setdefault(lang, np.zeros(n_bins, dtype=np.int64))
                    x = bins[starts[i] : starts[i + 1]]
                    np.add.at(own, x[x < n_bins], 1)
        for lang, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bin", "n"]
            )

    return docs.select(text_col, lang_col).mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def _margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The mean log ratio of each text and bit; 0 for texts too short to have a trigram."""
    data, starts = joined(texts)
    out = np.zeros((len(texts), weights.shape[1]))
    if len(data) < 3:
        return out
    bins = _bins(data, len(weights)).astype(np.int64)
    ok = _within(starts, len(bins))
    doc = np.searchsorted(starts, np.flatnonzero(ok), side="right") - 1
    bins = bins[ok]
    if not len(bins):
        return out
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    n = np.diff(np.append(first, len(doc)))
    for b in range(weights.shape[1]):
        out[doc[first], b] = np.add.reduceat(weights[:, b][bins], first) / n
    return out


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", n_bins: int = 1 << 16, calibration_rows: int = 500) -> LanguageModel:
    """Learn from all rows of ``train`` with a language; rows without one are left out.

    Null and very short texts have no trigram and add nothing; repeated rows count as often as
    they occur (but once in the calibration sample); without rows no language is learned."""
    train = train.where(F.col(lang_col).isNotNull()).select(text_col, lang_col)
    rows = count_trigrams(train, text_col, lang_col, n_bins).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), n_bins))
    for i, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        counts[i, own["bin"].to_numpy()] = own["n"].to_numpy()
    codes = codewords(len(languages))
    n_bits = codes.shape[1] if languages else 1
    if len(languages) < 2:
        return LanguageModel(languages, np.ones((len(languages), 1), dtype=np.int8), np.zeros((n_bins, 1), dtype=np.float32), np.zeros(1), np.ones(1), np.ones(1))
    share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))  # each language counts alike
    weights = np.empty((n_bins, n_bits), dtype=np.float32)
    for b in range(n_bits):
        one, zero = share[codes[:, b] > 0].mean(axis=0), share[codes[:, b] < 0].mean(axis=0)
        weights[:, b] = np.log((one + 1e-7) / (zero + 1e-7))
    # scales, thresholds and trust of the bits from a bounded sample of each language
    ranked = train.withColumn("h", F.xxhash64(text_col, lang_col))
    n_rows = {r[lang_col]: r["n"] for r in ranked.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}
    parts = [F.lit(x) for lang in languages for x in (lang, int(min(1.0, 2.0 * calibration_rows / n_rows[lang]) * 1_000_000))]
    chosen = ranked.where(F.pmod("h", F.lit(1_000_000)) < F.try_element_at(F.create_map(*parts), F.col(lang_col)))
    # repeated rows count once, so about twice ``calibration_rows`` are left of a language
    first = Window.partitionBy(lang_col).orderBy("h")
    sample = chosen.groupBy(lang_col, "h").agg(F.any_value(text_col).alias(text_col)).withColumn("place", F.row_number().over(first)).where(F.col("place") <= calibration_rows)

    def score(batches):
        for batch in batches:
            for part in chunks(batch, text_col):
                m = _margins(text_bytes(part, text_col, lower=True), weights)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(m))], names=["lang", "m"])

    fitted = sample.select(text_col, lang_col).mapInArrow(score, "lang string, m array<double>").toPandas()
    m = np.stack(fitted["m"].to_numpy()) if len(fitted) else np.zeros((0, n_bits))
    index = np.array([languages.index(x) for x in fitted["lang"]], dtype=int)
    bias, scale, trust = np.zeros(n_bits), np.ones(n_bits), np.ones(n_bits)
    for b in range(n_bits):
        y = codes[index, b]
        up, down = m[y > 0, b], m[y < 0, b]
        if len(up) and len(down):
            bias[b] = (np.median(up) + np.median(down)) / 2
            scale[b] = 4 / max(1e-6, np.median(up) - np.median(down))
            wrong = (np.mean(up <= bias[b]) + np.mean(down >= bias[b])) / 2
            trust[b] = np.log((1 - wrong + 1e-3) / (wrong + 1e-3))
    trust = np.maximum(trust, 1e-3)
    return LanguageModel(languages, codes, weights, bias, scale, trust / trust.sum())


def decode(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its score, and the loss margin to the next codeword."""
    z = (margins - model.bias) * model.scale
    loss = np.stack([(np.logaddexp(0, -z * code) * model.trust).sum(axis=1) for code in model.codes.astype(float)], axis=1)
    best = loss.argmin(axis=1)
    p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 4)
    score = 1 / p.sum(axis=1)
    two = np.sort(loss, axis=1)
    gap = two[:, 1] - two[:, 0] if loss.shape[1] > 1 else np.full(len(loss), 1.0)
    return best, score, gap


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.1) -> DataFrame:
    """``(id, lang_pred, score, ambiguous)`` for every row from its whole text alone.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned.
    Of codewords at equal loss the first language by name is chosen; ``ambiguous`` is set then.
    Repeated rows and null ids give as many rows with one and the same answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bins x bits floats, whatever the input
    source = docs.select(
        id_col, text_col, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    )
    schema = docs.select(id_col).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in chunks(batch, text_col):
                letters = part.column(2).to_pylist()
                if own.languages:
                    best, score, gap = decode(own, _margins(text_bytes(part, text_col, lower=True), own.weights))
                else:
                    letters = [False] * len(letters)
                    best = score = gap = np.zeros(len(letters), dtype=int)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([own.languages[i] if ok else "und" for i, ok in zip(best, letters, strict=True)], pa.string()),
                        pa.array([float(s) if ok else 0.0 for s, ok in zip(score, letters, strict=True)], pa.float64()),
                        pa.array([bool(g < ambiguous_below) or not ok for g, ok in zip(gap, letters, strict=True)], pa.bool_()),
                    ],
                    names=[id_col, "lang_pred", "score", "ambiguous"],
                )

    return source.mapInArrow(run, schema)
