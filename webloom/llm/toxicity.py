"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

Each word, with a mark at both ends, is a bag of hashed n-grams of four to six bytes (a word of
one letter has none and counts in the average as neutral); the embeddings of the bag are
averaged per word, the words are averaged per text, and a linear softmax over two classes
reads the average. Embeddings and softmax are trained jointly in numpy. Misspelt words share
n-grams with the spellings seen, so they land near them. As all of it is linear up to the
softmax, a word's part in the score is one number, worked out once per distinct word.

Cases: a null or empty text has an empty bag and gets the score of the bias alone, capped
at the fixed logit ``EMPTY`` (a rule, not learnt: nothing was written, so nothing is toxic); no labelled row, or rows of one class only, give a constant score below
the threshold (score 0, or the threshold's half). Repeated rows are scored alike. Texts are
read whole. Further columns of the input are not touched.
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
from webloom.session import Scratch

ORDERS = range(4, 7)
BITS = 17
WIDTH = 8
#: Labelled rows of either class that training may use.
ROWS_PER_CLASS = 3_000
THRESHOLD = 0.7
#: Neutral words that every average counts in, so that one odd word cannot decide a text of two.
PADDING = 8
#: Least log-likelihood ratio between a bucket's presence and the label for the bucket to be trained.
LEAST_RATIO = 20.0
STEP, DECAY = 0.1, 1e-4
#: Largest logit of a text without a word.
EMPTY = -1.0
#: Bytes of text handled at once; a worker holds a few times as much beside its Arrow batch.
PIECE = 4_000_000


@dataclass
class Model:
    part: np.ndarray  # buckets x 1: log-odds of a bucket after embedding and softmax
    bias: float


def _clean(texts: pa.Array) -> pa.Array:
    """Lower case; everything but letters, digits and marks separates words."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN\pM]+", " ")


def _bags(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return byte_ngrams(vocab, ORDERS, BITS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The averaged bag of each text, sparse."""
    for batch in chunks(batches, limit=PIECE):
        words = encode_words(_clean(batch.column("text")))
        who, what = _bags(words.vocab)
        order = np.argsort(who, kind="stable")
        starts = np.searchsorted(who[order], np.arange(len(words.vocab) + 1))
        what = what[order]
        idx, val = [], []
        for a, b in zip(words.offsets, words.offsets[1:]):
            codes, n = np.unique(words.codes[a:b], return_counts=True)
            length = starts[codes + 1] - starts[codes]
            take = np.repeat(starts[codes] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            share = np.repeat(n / np.maximum(1, length), length) / (b - a + PADDING)
            hit, back = np.unique(what[take], return_inverse=True)
            idx.append(hit.astype(np.int32))
            val.append(np.bincount(back, weights=share, minlength=len(hit)).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["label", "idx", "val"])


def train(rows: DataFrame, text: str, label: str, key: str, epochs: int = 25, seed: int = 11) -> Model:
    """Fit on about ROWS_PER_CLASS labelled texts of either class at most."""
    rows = rows.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.col(key).alias("key")).where(F.col("label").isin(0, 1) & F.col("text").isNotNull())
    scratch = Scratch(rows.sparkSession, "toxicity")
    sample = per_class(rows, "label", "key", ROWS_PER_CLASS).select("text", "label")
    bags = scratch.save(sample.mapInArrow(_features, "label int, idx array<int>, val array<float>"), "bags")
    n = {r["label"]: r["c"] for r in bags.groupBy("label").agg(F.count(F.lit(1)).alias("c")).collect()}
    if len(n) < 2:
        flat = np.zeros((1 << BITS, 1), np.float32)
        return Model(flat, float(np.log(0.5 * THRESHOLD / (1 - 0.5 * THRESHOLD))) if n.get(1) else -30.0)
    # buckets are chosen and summed where the bags are; only the chosen ones travel (at most 2**BITS rows)
    kept = bags.select("label", F.explode(F.arrays_zip("idx", "val")).alias("x")).groupBy(F.col("x.idx").alias("bucket")).agg(
        F.count_if(F.col("label") == 0).alias("k0"), F.count_if(F.col("label") == 1).alias("k1"), F.sum(F.col("x.val").cast("double") * F.col("x.val")).alias("square")
    ).toPandas()
    stats = np.zeros((3, 1 << BITS))
    stats[:, kept["bucket"]] = kept[["k0", "k1", "square"]].to_numpy().T
    keep = telling(stats[0], stats[1], n[0], n[1])
    total = stats[0] + stats[1]
    unit = np.where(keep, STEP / np.sqrt(stats[2] / np.maximum(1, total) + 1e-12), 0).astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast(keep)

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("idx")
            idx, val = lists.flatten().to_numpy(), batch.column("val").flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            hit = shared.value[idx]
            cuts = pa.array(np.searchsorted(of[hit], np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(cuts, pa.array(idx[hit])), pa.ListArray.from_arrays(cuts, pa.array(val[hit]))], ["label", "idx", "val"])

    got = bags.mapInArrow(pruned, "label int, idx array<int>, val array<float>").toArrow()
    scratch.drop()
    y = np.array(got.column("label").to_pylist(), np.int64)
    idx, val = got.column("idx").combine_chunks(), got.column("val").combine_chunks()
    lengths = pc.list_value_length(idx).to_numpy(zero_copy_only=False)
    idx = idx.flatten().to_numpy()
    part, bias = fit(y, idx, val.flatten().to_numpy() * unit[idx], np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), epochs, seed)
    return Model((part * unit)[:, None].astype(np.float32), bias)


def telling(k0: np.ndarray, k1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Buckets whose presence depends on the label, by the log-likelihood ratio of a 2 x 2 table."""
    n, ratio, total = n0 + n1, np.zeros(1 << BITS), k0 + k1
    for k, n_c in ((k0, n0), (k1, n1)):
        for seen, expected in ((k, total * n_c / n), (n_c - k, (n - total) * n_c / n)):
            ratio += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return (ratio >= LEAST_RATIO) & (total >= 3)


def fit(y: np.ndarray, col_of: np.ndarray, val_of: np.ndarray, starts: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Embeddings and softmax by AdaGrad on sparse averaged bags; both classes weigh the same."""
    # rows arrive in any order; put them in one that depends on their content alone
    content = np.bincount(np.repeat(np.arange(len(y)), np.diff(starts)), weights=val_of.astype(np.float64) * (1 + col_of % 1009), minlength=len(y)) + y
    steady = np.argsort(content, kind="stable")
    rng = np.random.default_rng(seed)
    embed = (rng.standard_normal((1 << BITS, WIDTH)) * 0.05).astype(np.float32)
    out, bias = (rng.standard_normal((WIDTH, 2)) * 0.3).astype(np.float32), np.zeros(2, np.float32)
    mem_e, mem_o, mem_b = np.full((1 << BITS, 1), 1e-4, np.float32), np.full_like(out, 1e-4), np.full_like(bias, 1e-4)
    weigh = (0.5 / np.bincount(y))[y] * len(y)
    for epoch in range(epochs):
        rate = 0.1 * (1 - epoch / epochs) + 0.005
        for part in np.array_split(steady[rng.permutation(len(y))], max(1, len(y) // 64)):
            length = starts[part + 1] - starts[part]
            take = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in part])
            row, col, v = np.repeat(np.arange(len(part)), length), col_of[take], val_of[take]
            hidden = segment_sums(embed[col] * v[:, None], np.concatenate([[0], np.cumsum(length)])).astype(np.float32)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= (weigh[part] / len(part))[:, None]
            back = (p @ out.T).astype(np.float32)
            cols, inv = np.unique(col, return_inverse=True)
            g = np.column_stack([np.bincount(inv, weights=back[row, k] * v, minlength=len(cols)) for k in range(WIDTH)]).astype(np.float32) + DECAY * embed[cols]
            g_out, g_b = hidden.T @ p + DECAY * out, p.sum(0)
            mem_e[cols, 0] += (g * g).mean(1)
            embed[cols] -= rate * g / np.sqrt(mem_e[cols])
            mem_o += g_out**2
            mem_b += g_b**2
            out -= (rate * g_out / np.sqrt(mem_o)).astype(np.float32)
            bias -= (rate * g_b / np.sqrt(mem_b)).astype(np.float32)
    return embed @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def score(docs: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keys`` plus ``name`` (a score from 0 to 1) for every row of ``docs``.

    ``keys`` may be all columns, the text among them: no column travels twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent = [*keys, *([] if text in keys else [text])]
    body = f"k{sent.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches, body, PIECE):
            words = encode_words(_clean(batch.column(body)))
            sums, number = vocab_sums(words.vocab, ORDERS, BITS, m.part)
            each = sums[:, 0] / np.maximum(1, number)
            mean = segment_sums(each[words.codes], words.offsets) / (words.counts + PADDING)
            z = mean + m.bias
            z = np.where(words.counts == 0, np.minimum(z, EMPTY), z)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], [*(f"k{i}" for i in range(len(keys))), "score"])

    picked = docs.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(sent)))
    kinds = dict(picked.dtypes)
    out = picked.mapInArrow(run, ", ".join(f"k{i} {kinds[f'k{i}']}" for i in range(len(keys))) + ", score double")
    return out.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), F.col("score").alias(name))
