"""Language identification by error-correcting output codes.

Every language gets a codeword; one linear classifier over hashed byte n-grams predicts each
bit. Decoding is loss-weighted: the distance of a text to a codeword is the sum over bits of
the logistic loss of the predicted margin, weighted by how well that bit was learned. The
nearest codeword wins; a text whose two nearest codewords are almost equally near is flagged.

Cases: null text, empty text or text without a letter -> ``und`` with score 0. No training
row at all -> ``und`` for everything. One language -> that language with score 1. Repeated
rows are scored alike; ties go to the language first in code-point order. Long texts are read
whole, in blocks of ``CHUNK_BYTES``. Further columns of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.arrowtext import byte_ngrams, chunks, encode_words, segment_sums, vocab_sums
from webloom.llm.sampling import per_class

ORDERS = range(2, 4)
BITS = 13
#: Rows per language, and over all languages, that training may use.
ROWS_PER_LANGUAGE = 1_500
ROWS_IN_ALL = 12_000
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 / -1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit when decoding
    sharpness: float


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """The exhaustive code up to five languages, else the best-separated of some random codes."""
    if languages <= 5:
        bits = max(1, 2 ** (languages - 1) - 1)
        columns = [[1 if i == 0 else (1 if (b >> (i - 1)) & 1 else -1) for i in range(languages)] for b in range(bits)]
        return np.array(columns, np.float32).T
    rng, bits, best, apart = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages))), None, -1
    for _ in range(60):
        code = rng.choice([-1.0, 1.0], (languages, bits)).astype(np.float32)
        code[:, np.abs(code.sum(0)) == languages] *= np.where(np.arange(languages) % 2, -1, 1)[:, None]
        distance = (bits - code @ code.T) / 2 + bits * np.eye(languages)
        if distance.min() > apart:
            best, apart = code, distance.min()
    return best


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse relative n-gram frequencies of each text."""
    for batch in chunks(batches):
        words = encode_words(pc.utf8_lower(batch.column("text")))
        who, what = byte_ngrams(words.vocab, ORDERS, BITS)
        order = np.argsort(who, kind="stable")
        starts = np.searchsorted(who[order], np.arange(len(words.vocab) + 1))
        what = what[order]
        idx, val = [], []
        for a, b in zip(words.offsets, words.offsets[1:]):
            codes, n = np.unique(words.codes[a:b], return_counts=True)
            grams = np.zeros(1 << BITS, np.float32)
            length = starts[codes + 1] - starts[codes]
            take = np.repeat(starts[codes] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            np.add.at(grams, what[take], np.repeat(n, length).astype(np.float32))
            hit = np.flatnonzero(grams)
            idx.append(hit.astype(np.int32))
            val.append(grams[hit] / max(1.0, float(grams.sum())))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["label", "idx", "val"])


def train(rows: DataFrame, text: str, lang: str, key: str, epochs: int = 12, seed: int = 7) -> Model:
    """Fit on at most about ROWS_PER_LANGUAGE texts of a language (ROWS_IN_ALL together)."""
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("label"), F.col(key).alias("key")).where(F.col("text").rlike(r"\p{L}"))
    n_lang = rows.where(F.col("label").isNotNull()).select("label").distinct().limit(ROWS_IN_ALL).count()
    sample = per_class(rows, "label", "key", min(ROWS_PER_LANGUAGE, ROWS_IN_ALL // max(1, n_lang)))
    got = sample.select("text", "label").mapInArrow(_features, "label string, idx array<int>, val array<float>").toArrow()
    labels = got.column("label").to_pylist()
    languages = sorted(set(labels))
    code = codewords(max(1, len(languages)))
    weights, bias = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if len(languages) < 2:
        return Model(languages, code, weights, bias, np.ones(code.shape[1], np.float32), 1.0)
    idx, val = got.column("idx").combine_chunks(), got.column("val").combine_chunks()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(idx).to_numpy(zero_copy_only=False))]).astype(np.int64)
    idx, val = idx.flatten().to_numpy(), val.flatten().to_numpy()
    of = np.array([languages.index(x) for x in labels])
    # rows arrive in any order; put them in one that depends on their content alone
    lengths = np.diff(starts)
    content = np.bincount(np.repeat(np.arange(len(of)), lengths), weights=val.astype(np.float64) * (1 + idx % 1009), minlength=len(of)) + of
    steady = np.argsort(content, kind="stable")
    take = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in steady])
    idx, val, of = idx[take], val[take], of[steady]
    starts = np.concatenate([[0], np.cumsum(lengths[steady])])
    target = code[of]
    balance = (1.0 / np.bincount(of))[of]
    balance = (balance / balance.mean()).astype(np.float32)
    scale = 1.0 / np.sqrt(np.bincount(idx, weights=val.astype(np.float64) ** 2, minlength=1 << BITS) / len(of) + 1e-8).astype(np.float32)
    rng, memory, memory_b = np.random.default_rng(seed), np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(of)), max(1, len(of) // 128)):
            x = np.zeros((len(part), 1 << BITS), np.float32)
            for r, d in enumerate(part):
                x[r, idx[starts[d] : starts[d + 1]]] = val[starts[d] : starts[d + 1]]
            x *= scale
            margin = x @ weights + bias
            slope = -target[part] / (1 + np.exp(np.clip(target[part] * margin, -30, 30))) * balance[part, None] / len(part)
            g, gb = x.T @ slope + 1e-6 * weights, slope.sum(0)
            memory += g * g
            memory_b += gb * gb
            weights -= 0.05 / (1 + 0.1 * epoch) * g / np.sqrt(memory)
            bias -= 0.05 / (1 + 0.1 * epoch) * gb / np.sqrt(memory_b)
    margins = np.zeros_like(target)
    folded = weights * scale[:, None]
    for d in range(len(of)):
        margins[d] = val[starts[d] : starts[d + 1]] @ folded[idx[starts[d] : starts[d + 1]]] + bias
    loss = np.logaddexp(0, -target * margins).mean(0)
    trust = (1.0 / (0.05 + loss)).astype(np.float32)
    return Model(languages, code, folded.astype(np.float32), bias, trust / trust.sum() * len(trust), 1.0)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its share of exp(-distance), and how far the next one is."""
    loss = np.zeros((len(margins), len(model.languages)))
    for b in range(model.code.shape[1]):
        loss += model.trust[b] * np.logaddexp(0, -np.outer(margins[:, b], model.code[:, b]))
    best = loss.argmin(1)
    near = np.exp(-(loss - loss.min(1, keepdims=True)) * model.sharpness)
    ranked = np.sort(loss, axis=1)
    gap = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(margins), np.inf)
    return best, 1.0 / near.sum(1), gap


def predict(docs: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",), ambiguous_below: float = 0.7) -> DataFrame:
    """``keys`` plus lang_pred, score and ambiguous for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches):
            texts = pc.fill_null(batch.column("text"), "")
            lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False).astype(bool)
            if not m.languages:
                lettered &= False
            words = encode_words(pc.utf8_lower(texts))
            sums, number = vocab_sums(words.vocab, ORDERS, BITS, m.weights)
            both = segment_sums(np.column_stack([sums, number])[words.codes], words.offsets)
            margins = both[:, :-1] / np.maximum(1, both[:, -1:]) + m.bias
            if m.languages:
                best, score, gap = decode(m, margins)
                names = np.array(m.languages, object)[best]
            else:
                names, score, gap = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.zeros(len(texts))
            names = np.where(lettered, names, UNDETERMINED)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keys))), pa.array(names.tolist(), pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array((gap < ambiguous_below) | ~lettered)],
                [*(f"k{i}" for i in range(len(keys))), "lang_pred", "score", "ambiguous"],
            )

    picked = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("text"))
    kinds = dict(picked.dtypes)
    schema = ", ".join(f"k{i} {kinds[f'k{i}']}" for i in range(len(keys))) + ", lang_pred string, score double, ambiguous boolean"
    out = picked.mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "lang_pred", "score", "ambiguous")
