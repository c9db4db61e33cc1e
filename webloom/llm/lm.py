"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

Counts cover every training token: one aggregation over all training documents gives each
token's count. The most frequent words form the model's vocabulary; a log-bilinear model
(context vector of the word before, target vector, bias) is trained in numpy by
noise-contrastive estimation over all training documents: documents are dealt into groups by a
hash (one group for about ``GROUP_TOKENS`` tokens of the corpus), every group passes over its own
texts from the same start in the order of their hashes, and the parameters are averaged by the
tokens they saw. Groups depend on the texts alone, so files, partitions and executors do not
change a score. Batched
matrix products give the exact normaliser of every context, so log-probabilities sum to one.
A word outside the vocabulary has the probability of the unknown word times its smoothed share
among the words outside, so the model is proper over all words.

The ``HOT_WORDS`` most frequent words (of at most ``HOT_BYTES`` bytes: together a few MB) go to
the workers; the counts of all other words are joined by shuffle. That split decides only how
a count is found, never which.

Cases: a null or empty text is one end token; no training text -> N = V = 0, base 0 and the
same score; words never seen have count 0; repeated rows are scored alike; any id may be
null or repeated, as rows are told apart by a number of their own. Texts are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.arrowtext import Words, chunks, encode_words, owners, segment_sums
from webloom.session import Scratch

END = ""  # no word is empty
HOT_WORDS = 65_536
HOT_BYTES = 64
#: Bytes of text handled at once: per-token arrays are a multiple of it.
CHUNK = 3_000_000
VOCABULARY = 16_384  # two more indices must fit into 16 bits
WIDTH = 16
NOISE = 48
BATCH = 2_048
#: Training tokens of one group; the number of groups grows with the corpus.
GROUP_TOKENS = 4_000_000
RATE, MEMORY = 0.2, 0.01
#: Words of the vocabulary in one row of the parameter exchange.
BLOCK = 512


@dataclass
class Model:
    hot: pa.Array  # words by rank
    counts: np.ndarray  # of hot words, by rank
    size: int  # words of the vocabulary; index ``size`` is the unknown word, ``size + 1`` the start
    total: int
    types: int
    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    log_z: np.ndarray

    @property
    def unknown_total(self) -> float:
        """log10 of the denominator of shares among words outside the vocabulary."""
        inside = self.counts[: self.size].sum()
        return float(np.log10(self.total - inside + 0.5 * (max(0, self.types - self.size) + 1)))

    @property
    def base_total(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.types + 1)))


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes with one end after every text (code len(vocab)) and their offsets."""
    n = len(words.offsets) - 1
    return np.insert(words.codes, words.offsets[1:], len(words.vocab)), words.offsets + np.arange(n + 1)


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, c over all rows; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            words = encode_words(batch.column("text"), lower_ascii=True)
            n = np.bincount(words.codes, minlength=len(words.vocab))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.vocab, pa.array([END], words.vocab.type)]), pa.array(np.append(n, batch.num_rows).astype(np.int64))], ["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def model_index(vocab: pa.Array, hot: pa.Array) -> np.ndarray:
    """Rank of each word and of the end, -1 for words that are not hot."""
    found = pc.fill_null(pc.index_in(pa.concat_arrays([vocab, pa.array([END], vocab.type)]), value_set=hot), -1)
    return found.to_numpy(zero_copy_only=False).astype(np.int64)


def pairs(words: Words, hot: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token: rank (-1 if not hot), vocabulary index, index of the word before; offsets; codes."""
    codes, offsets = with_ends(words)
    rank = model_index(words.vocab, hot)[codes]
    index = np.where((rank >= 0) & (rank < size), rank, size)
    before = np.empty_like(index)
    before[1:] = index[:-1]
    before[offsets[:-1]] = size + 1
    return rank, index, before, offsets, codes


def _add_rows(into: np.ndarray, memory: np.ndarray, at: np.ndarray, grad: np.ndarray, rate: float) -> None:
    at = at.astype(np.uint16)  # 16 bits are sorted by radix
    order = np.argsort(at, kind="stable")
    ranked = at[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(ranked)) + 1])
    rows = ranked[first]
    total = np.add.reduceat(grad[order], first, axis=0)
    memory[rows] += (total * total).mean(1)
    into[rows] -= rate * total / np.sqrt(memory[rows])[:, None]


def start_parameters(noise: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = len(noise)
    return (rng.standard_normal((n + 1, WIDTH)) * 0.1).astype(np.float32), (rng.standard_normal((n, WIDTH)) * 0.1).astype(np.float32), np.log(noise).astype(np.float32)


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.Array]]]:
    """The groups of rows that come sorted by ``g``, each as an iterator over blocks of its texts."""

    def blocks() -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)

    for g, mine in itertools.groupby(blocks(), key=lambda b: b.column("g")[0].as_py()):
        yield g, (b.column("text") for b in mine)


def _train_group(texts: Iterator[pa.Array], hot: pa.Array, size: int, noise: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    context, target, bias = start_parameters(noise, seed)
    mem_c, mem_t, mem_b = np.full(len(context), MEMORY, np.float32), np.full(len(target), MEMORY, np.float32), np.full(len(bias), MEMORY, np.float32)
    rng, edges, log_kn = np.random.default_rng(seed), np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)
    seen, rate = 0, RATE

    def steps() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words and the words before them, BATCH at a time wherever the blocks of texts end."""
        index, before = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for text in texts:
            _, more_index, more_before, _, _ = pairs(encode_words(text, lower_ascii=True), hot, size)
            index, before = np.concatenate([index, more_index]), np.concatenate([before, more_before])
            whole = len(index) // BATCH * BATCH
            for a in range(0, whole, BATCH):
                yield index[a : a + BATCH], before[a : a + BATCH]
            index, before = index[whole:], before[whole:]
        if len(index):
            yield index, before

    for w, u in steps():
        drawn = np.minimum(np.searchsorted(edges, rng.random(NOISE)), len(noise) - 1)
        h, t, tn = context[u], target[w], target[drawn]
        pos = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, t) + bias[w] - log_kn[w], -30, 30)))  # 1 - P(data)
        neg = 1 / (1 + np.exp(-np.clip(h @ tn.T + (bias[drawn] - log_kn[drawn]), -30, 30)))  # P(data) of noise
        g_h = neg @ tn - pos[:, None] * t
        g_n, g_nb = neg.T @ h, neg.sum(0)
        _add_rows(context, mem_c, u, g_h, rate)
        _add_rows(target, mem_t, np.concatenate([w, drawn]), np.concatenate([-pos[:, None] * h, g_n]), rate)
        g_b = np.bincount(w, weights=-pos, minlength=len(bias)) + np.bincount(drawn, weights=g_nb, minlength=len(bias))
        mem_b += (g_b * g_b).astype(np.float32)
        bias -= (0.2 * rate * g_b / np.sqrt(mem_b)).astype(np.float32)
        seen += len(w)
    if seen:
        whole = np.zeros((len(context), 2 * WIDTH + 1), np.float32)
        whole[:, :WIDTH] = context
        whole[:-1, WIDTH : 2 * WIDTH], whole[:-1, -1] = target, bias
        blocks = range(0, len(whole), BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK for a in blocks], pa.int32()), pa.array([float(seen)] * len(blocks)), pa.array([whole[a : a + BLOCK].tobytes() for a in blocks], pa.binary())], ["block", "tokens", "vec"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows that come sorted by block; holds one block at a time."""
    at, weight, total = None, 0.0, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["block", "vec"])

    for batch in batches:
        for block, tokens, vec in zip(*(c.to_pylist() for c in batch.columns)):
            if block != at:
                if at is not None:
                    yield done()
                at, weight, total = block, 0.0, 0.0
            weight += tokens
            total = total + tokens * np.frombuffer(vec, np.float32).astype(np.float64)
    if at is not None:
        yield done()


def normalisers(context: np.ndarray, target: np.ndarray, bias: np.ndarray, rows: int = 256) -> np.ndarray:
    """log of the sum over the vocabulary for every context, in batched matrix products."""
    out = np.empty(len(context))
    for a in range(0, len(context), rows):
        s = context[a : a + rows] @ target.T + bias
        top = s.max(1)
        out[a : a + rows] = top + np.log(np.exp(s - top[:, None]).sum(1, dtype=np.float64))
    return out


def train(train_docs: DataFrame, counts: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 5) -> Model:
    """Fit on all rows of ``train_docs``; ``counts`` is their written count_tokens()."""
    spark = train_docs.sparkSession
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    top = counts.where(F.octet_length("word").between(1, HOT_BYTES)).orderBy(F.desc("c"), "word").limit(HOT_WORDS).toPandas()
    hot, number = pa.array([END, *top["word"]], pa.string()), np.append(ends, top["c"]).astype(np.int64)
    size = min(VOCABULARY, len(hot))
    noise = np.append(number[:size], max(0, whole[0] - number[:size].sum())).astype(np.float64) + 0.5
    noise /= noise.sum()
    shared = spark.sparkContext.broadcast((hot, noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, prior = shared.value
        for _, texts in _by_group(batches):
            yield from _train_group(texts, table, len(prior) - 1, prior, seed)

    groups = max(1, -(-int(whole[0]) // GROUP_TOKENS))
    dealt = train_docs.select(F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h")).withColumn("g", F.pmod("h", F.lit(groups)))
    parts = dealt.repartition(groups, "g").sortWithinPartitions("g", "h").select("g", "text").mapInArrow(run, "block int, tokens double, vec binary")
    mixed = parts.repartition("block").sortWithinPartitions("block", "tokens", "vec").mapInArrow(_average, "block int, vec binary").toPandas()
    context, target, bias = start_parameters(noise, seed)
    if len(mixed):
        flat = np.concatenate([np.frombuffer(v, np.float32) for v in mixed.sort_values("block")["vec"]]).reshape(-1, 2 * WIDTH + 1)
        context, target, bias = flat[:, :WIDTH].copy(), flat[:-1, WIDTH : 2 * WIDTH].copy(), flat[:-1, -1].copy()
    return Model(hot, number, size, int(whole[0]), int(whole[1]), context, target, bias, normalisers(context, target, bias))


def score(docs: DataFrame, model: Model, counts: DataFrame, scratch: Scratch, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, n_tokens, n_known, train_tokens, base_score and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        share, seen = np.append(np.log10(m.counts + 0.5), 0.0), np.append(m.counts > 0, False).astype(np.int64)  # the last for words that are not hot
        for batch in chunks(batches, limit=CHUNK):
            words = encode_words(batch.column("text"), lower_ascii=True)
            rank, index, before, offsets, codes = pairs(words, m.hot, m.size)
            logp = np.empty(len(index))
            for a in range(0, len(index), 262_144):
                u, w = before[a : a + 262_144], index[a : a + 262_144]
                logp[a : a + 262_144] = (np.einsum("ij,ij->i", m.context[u], m.target[w]) + m.bias[w] - m.log_z[u]) / np.log(10)
            known = share[rank]
            outside = index == m.size
            logp += np.where(outside, known - m.unknown_total, 0.0)
            rare = np.flatnonzero(rank < 0)
            doc = owners(offsets)[rare]
            both, n = np.unique(doc * (len(words.vocab) + 1) + codes[rare], return_counts=True)
            of = np.searchsorted(both // (len(words.vocab) + 1), np.arange(batch.num_rows + 1)).astype(np.int32)
            listed = pc.take(words.vocab, pa.array(both % (len(words.vocab) + 1)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keys))), pa.array(np.diff(offsets)), pa.array(segment_sums(seen[rank], offsets).astype(np.int64)), pa.array(segment_sums(known, offsets)), pa.array(segment_sums(logp, offsets)),
                 pa.ListArray.from_arrays(pa.array(of), listed), pa.ListArray.from_arrays(pa.array(of), pa.array(n.astype(np.int32)))],
                [*(f"k{i}" for i in range(len(keys))), "n_tokens", "known", "base", "model", "rare", "rare_n"],
            )

    picked = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("text"))
    kinds = dict(picked.dtypes)
    schema = ", ".join(f"k{i} {kinds[f'k{i}']}" for i in range(len(keys))) + ", n_tokens bigint, known bigint, base double, model double, rare array<string>, rare_n array<int>"
    rows = scratch.save(picked.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = rows.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    found = rare.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    out = rows.drop("rare", "rare_n").join(found, "rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        *(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(model.base_total)).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
