"""Benchmark decontamination by latent semantic retrieval and longest common subsequences.

Texts are cut into blocks of ``STEP`` words; a passage is a run of blocks, long enough to hold
a benchmark item, at every block. Passages are TF-IDF vectors over the words of the benchmark
(every query has weight 0 for all other words, so they are pruned); document frequencies
count all blocks of all documents, and words of very many blocks weigh nothing. A randomised
SVD is computed in one pass: every partition multiplies its passages A with a random matrix G
and back, the sums A'AG give an orthonormal range Q, and the small matrix Q'A'AQ, which Q and
the same sums determine, is factorised into singular values and the right singular vectors.
Passages whose latent cosine to an item is ``COSINE`` or more are candidates, and so are,
whatever their cosine, those that hold ``HELD`` of the item's rarest words: of the L words of an
item a hit has T in order, hence at least ``HELD`` of any L - T + ``HELD`` of them, so no hit is
missed for its place in the latent space. Exact checks follow, the cheap ones first: as many of
the rarest words (the same bound), enough of the item's words in any order, and last the
alignment. Candidates are hits if the longest common subsequence with the item covers ``COVER``
of its words, or ``PARAPHRASE`` of them when the item's answer stands in the passage. Texts are
taken apart once a sheet; the steps read each word's place in the vocabulary from a written
table. Items are taken in sheets of ``ITEMS`` at most, so what is broadcast is bounded and all
items meet all documents.

Cases: null or empty texts have no passage; items without a word find nothing; documents
shorter than an item are one passage; repeated documents hit alike; ids may repeat or be null;
an empty benchmark or document table gives no hits. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from webloom.llm.arrowtext import chunks, encode_words, owners, split_words
from webloom.session import Scratch

STEP = 16
RANK = 192
COSINE = 0.35
#: Words in more than this share of all blocks (and in COMMON_BLOCKS) weigh nothing, unless an item needs them.
COMMON_SHARE = 0.003
COMMON_BLOCKS = 10
LEAST_WORDS = 4
#: Of the rarest words of an item, how many make a region a candidate without the cosine.
HELD = 4
COVER = 0.6
PARAPHRASE = 0.45
#: Items handled at once; a sheet's words, vectors and basis are a few tens of MB.
ITEMS = 1_000
#: Bytes of codes handled at once inside a Python worker.
PIECE = 2_500_000
#: Rows handled at once, so that their vectors stay in the cache.
ROWS = 4_096
_ANSWER = re.compile(r"(?i)\banswer\s*:\s*(.+)$", re.DOTALL)


@dataclass
class Sheet:
    ids: list
    words: list[list[str]]
    answers: list[list[str]]
    vocab: pa.Array  # words of items and answers
    idf: np.ndarray | None = None  # one more entry, 0, for words outside vocab
    basis: np.ndarray | None = None  # right singular vectors, the largest singular value first
    singular: np.ndarray | None = None
    rare: list[tuple[np.ndarray, int]] | None = None  # per item its rarest words and how many of them a hit has


def clean(words: pa.Array) -> pa.Array:
    """Words in lower case, without marks at their ends; what has no letter or digit becomes empty."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"^[^\pL\pN\pM]+|[^\pL\pN\pM]+$", "")


def words_of(text: str | None) -> list[str]:
    return [w for w in clean(split_words(pa.array([text], pa.string()))[0]).to_pylist() if w]


def sheets(benchmark: DataFrame, key: str, text: str, answer: str | None) -> Iterator[Sheet]:
    """The benchmark in pieces of about ITEMS rows, by a hash of the id."""
    rows = benchmark.select(F.col(key).alias("id"), F.col(text).alias("text"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer")).where(F.length(F.coalesce("text", F.lit(""))) > 0)
    number = -(-rows.count() // ITEMS)
    for i in range(number):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(number)) == i).distinct().orderBy("id", "text").collect()
        items = [(r["id"], words_of(r["text"]), words_of(r["answer"] if r["answer"] else (m.group(1) if (m := _ANSWER.search(r["text"])) else ""))) for r in got]
        items = [x for x in items if x[1]]
        if items:
            yield Sheet([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], pa.array(sorted({w for x in items for w in (*x[1], *x[2])}), pa.string()))


def places(docs: DataFrame, vocab: pa.Array, schema: str) -> DataFrame:
    """doc_id, t and codes (4 bytes a word: its place in ``vocab``, -1: none) of every row of doc_id, t, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = encode_words(batch.column("text"))
            at = pc.fill_null(pc.index_in(clean(words.vocab), value_set=vocab), -1).to_numpy(zero_copy_only=False).astype(np.int32)[words.codes]
            codes = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((4 * words.offsets).astype(np.int32)), pa.py_buffer(at)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), codes], ["doc_id", "t", "codes"])

    return docs.mapInArrow(run, schema)


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the texts' words, their places, the block of each word and the first block of each text."""
    column = batch.column("codes")
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4)])
    at = np.frombuffer(b"".join(column.to_pylist()), np.int32).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(-(-np.diff(offsets) // STEP))])
    doc = owners(offsets)
    return offsets, at, first[doc] + (np.arange(len(doc)) - offsets[doc]) // STEP, first


def frequencies(docs: DataFrame, sheet: Sheet) -> None:
    """Set idf: ln((1 + blocks) / (1 + blocks with the word)) + 1, over all documents."""
    vocab = sheet.vocab

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks = np.zeros(len(vocab), np.int64), 0
        for batch in chunks(batches, "codes", PIECE):
            _, at, block, first = _codes(batch)
            hit = at >= 0
            total += np.bincount(np.unique(block[hit] * len(vocab) + at[hit]) % len(vocab), minlength=len(vocab))
            blocks += int(first[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocab))), pa.array(np.append(blocks, total))], ["word", "n"])

    got = docs.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(vocab) + 1)
    n[got["word"].to_numpy() + 1] = got["n"]
    stop = n[1:] > COMMON_SHARE * n[0] + COMMON_BLOCKS
    place, needed = {w: i for i, w in enumerate(vocab.to_pylist())}, np.zeros(len(vocab), bool)
    for words in sheet.words:
        own = np.array(sorted({place[w] for w in words}))
        if (~stop[own]).sum() < LEAST_WORDS:
            needed[own] = True
    asked = np.isin(np.arange(len(vocab)), [place[w] for words in sheet.words for w in words])
    sheet.rare = []
    for i, words in enumerate(sheet.words):
        own = np.array([place[w] for w in words])
        hit = next(t for t in range(1, len(own) + 1) if t / len(own) >= _least(sheet, i))
        held = min(HELD, hit)
        sheet.rare.append((own[np.argsort(n[1:][own], kind="stable")][: len(own) - hit + held], held))
    sheet.idf = np.append(np.where(stop & ~needed | ~asked, 0, np.log((1 + n[0]) / (1 + n[1:])) + 1), 0).astype(np.float32)


def _add(z: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    ranked = at[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(ranked)) + 1])
    z[ranked[start]] += np.add.reduceat(rows[order], start, axis=0)


def _block_sums(at: np.ndarray, block: np.ndarray, number: int, weights: np.ndarray) -> np.ndarray:
    """Sum of ``weights`` rows of the words of each block; words outside the vocabulary add nothing."""
    out = np.zeros((number, weights.shape[1]), np.float32)
    hit = np.flatnonzero(at >= 0)
    for a in range(0, len(hit), ROWS):
        part = hit[a : a + ROWS]
        b = block[part]
        start = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1])
        out[b[start]] += np.add.reduceat(weights[at[part]], start, axis=0)
    return out


def sketch(docs: DataFrame, sheet: Sheet, seed: int = 9) -> None:
    """Set basis and singular: the leading right singular vectors and values of all passages."""
    vocab, idf = sheet.vocab, sheet.idf
    rank = min(RANK, len(vocab))
    random = np.random.default_rng(seed).standard_normal((len(vocab), rank)).astype(np.float32) * idf[:-1, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((len(vocab), rank), np.float32)
        for batch in chunks(batches, "codes", PIECE):
            _, at, block, first = _codes(batch)
            at = np.where(idf[at] > 0, at, -1)  # -1 stays -1
            projected = _block_sums(at, block, int(first[-1]), random)
            hit = np.flatnonzero(at >= 0)
            for a in range(0, len(hit), ROWS):
                part = hit[a : a + ROWS]
                _add(z, at[part], projected[block[part]])
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([(z * idf[:-1, None]).tobytes()], pa.binary())], ["part", "z"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(vocab) * rank)
        for batch in batches:
            for z in batch.column("z"):
                out += np.frombuffer(z.as_buffer(), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([out.astype(np.float32).tobytes()], pa.binary())], ["part", "z"])

    parts = docs.mapInArrow(run, "part bigint, z binary")
    few = parts.repartition(16).mapInArrow(total, "part bigint, z binary").collect()  # 16 rows of fixed size
    z = sum(np.frombuffer(r["z"], np.float32).astype(np.float64) for r in few).reshape(len(vocab), rank)
    q = np.linalg.qr(z)[0]
    # A'A in the range Q: C (Q'G) = Q'A'AG holds for C = Q'A'AQ as far as Q spans the passages
    inner = np.linalg.lstsq((q.T @ random).T, (q.T @ z).T, rcond=None)[0].T
    square, turn = np.linalg.eigh((inner + inner.T) / 2)
    sheet.basis = np.ascontiguousarray((q @ turn)[:, ::-1]).astype(np.float32)
    sheet.singular = np.sqrt(np.maximum(square[::-1], 0))


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel over ``a``)."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & where.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def _inside(part: list, whole: list) -> bool:
    return bool(part) and any(whole[i : i + len(part)] == part for i in range(len(whole) - len(part) + 1))


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """doc_id, t (hash of the text), item_id, cosine and cover (share of the item's words) of every hit."""
    spark = docs.sparkSession
    kinds = dict(docs.select(F.col(key).alias("k")).dtypes) | dict(benchmark.select(F.col(item_key).alias("i")).dtypes)
    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    schema = f"doc_id {kinds['k']}, t bigint, item_id {kinds['i']}, cosine double, cover double"
    picked = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    scratch, out = Scratch(spark, "decontaminate"), None
    for number, sheet in enumerate(sheets(benchmark, item_key, item_text, answer)):
        placed = scratch.save(places(picked, sheet.vocab, f"doc_id {kinds['k']}, t bigint, codes binary"), f"places-{number}")
        frequencies(placed.select("codes"), sheet)
        sketch(placed.select("codes"), sheet)
        shared = spark.sparkContext.broadcast(sheet)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = shared.value
            place = {w: i for i, w in enumerate(s.vocab.to_pylist())}
            weights = s.basis * s.idf[:-1, None]
            items = np.array([sum(weights[place[w]] for w in words) for words in s.words])
            items /= np.maximum(1e-9, np.linalg.norm(items, axis=1, keepdims=True))
            spans = np.array([-(-len(w) // STEP) + 1 for w in s.words])
            groups = [(m, np.flatnonzero(spans == m)) for m in np.unique(spans)]
            lists = [_postings(s, mine) for _, mine in groups]
            leasts = [np.array([s.rare[i][1] for i in mine]) for _, mine in groups]
            for batch in chunks(batches, "codes", PIECE):
                offsets, at, block, first = _codes(batch)
                blocks = int(first[-1])
                live = np.where(s.idf[at] > 0, at, -1)
                latent = _block_sums(live, block, blocks, weights)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
                found = []
                for a in range(0, blocks, ROWS):
                    b, width = min(blocks, a + ROWS), 1
                    passage = latent[a:b].copy()
                    for (m, mine), least, posting in zip(groups, leasts, lists):  # spans grow from group to group
                        for j in range(width, m):
                            last = min(blocks, b + j)
                            ok = np.flatnonzero(doc[a + j : last] == doc[a : last - j])
                            passage[ok] += latent[a + j + ok]
                        width = m
                        norm = np.sqrt(np.einsum("ij,ij->i", passage, passage))
                        cos = (passage @ items[mine].T) / np.maximum(1e-9, norm)[:, None]
                        held = _held(at, block, doc, a, b, m, *posting) >= least
                        p, i = np.nonzero((cos >= COSINE) | held)
                        fit = held[p, i]  # no other candidate can be a hit
                        p, i = p[fit], i[fit]
                        found += _confirm(s, offsets, at, doc, first, a + p, mine[i], cos[p, i], place)
                rows = _best(found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), batch.column("t").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([s.ids[r[1]] for r in rows], item_type), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64())], ["doc_id", "t", "item_id", "cosine", "cover"])

        part = scratch.save(placed.mapInArrow(run, schema), f"hits-{number}")
        scratch.drop(f"places-{number}")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _least(s: Sheet, i: int) -> float:
    """The smallest share of item ``i`` in common order that can be a hit."""
    return PARAPHRASE if s.answers[i] else COVER


def _lengths(item: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """``common`` of the item (numbers from 1) with every row of ``seen`` (0: a word of no item)."""
    if len(item) > 63:
        return np.array([common(item.tolist(), row.tolist()) for row in seen], np.int64)
    where = np.zeros(item.max() + 1, np.uint64)
    for i, w in enumerate(item.tolist()):
        where[w] |= np.uint64(1 << i)
    full = np.uint64((1 << len(item)) - 1)
    row = np.full(len(seen), full)
    for column in where[seen].T:
        m = row & column
        row = ((row + m) | (row - m)) & full
    return len(item) - np.bitwise_count(row).astype(np.int64)


def _postings(s: Sheet, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each word the items of ``mine`` (by their number there) that have it among their rarest words."""
    word = np.concatenate([np.unique(s.rare[i][0]) for i in mine])
    who = np.concatenate([np.full(len(np.unique(s.rare[i][0])), j) for j, i in enumerate(mine)])
    order = np.argsort(word, kind="stable")
    return np.searchsorted(word[order], np.arange(len(s.vocab) + 1)), who[order], len(mine)


def _held(at: np.ndarray, block: np.ndarray, doc: np.ndarray, a: int, b: int, m: int, start: np.ndarray, who: np.ndarray, number: int) -> np.ndarray:
    """Words of the regions at blocks ``a`` to ``b`` (a block before and ``m`` from there) among the rarest of each item."""
    lo, hi = max(0, a - 1), min(len(doc), b + m - 1)
    x, y = np.searchsorted(block, [lo, hi])
    hit = x + np.flatnonzero(at[x:y] >= 0)
    many = start[at[hit] + 1] - start[at[hit]]
    hit, many = hit[many > 0], many[many > 0]
    each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item = who[np.repeat(start[at[hit]], many) + each]
    n = np.bincount(np.repeat(block[hit] - lo, many) * number + item, minlength=(hi - lo) * number).reshape(hi - lo, number).astype(np.int32)
    out = n[a - lo : b - lo].copy()
    if a > 0:
        ok = np.flatnonzero(doc[a:b] == doc[a - 1 : b - 1])
        out[ok] += n[ok]
    else:
        ok = 1 + np.flatnonzero(doc[1:b] == doc[: b - 1])
        out[ok] += n[ok - 1]
    for j in range(1, m):
        ok = np.flatnonzero(doc[a + j : min(len(doc), b + j)] == doc[a : min(len(doc), b + j) - j])
        out[ok] += n[a + j + ok - lo]
    return out


def _confirm(s: Sheet, offsets: np.ndarray, at: np.ndarray, doc: np.ndarray, first: np.ndarray, block: np.ndarray, item: np.ndarray, cosine: np.ndarray, place: dict) -> list[tuple[int, int, float, float]]:
    """Hits among candidates: row, item, cosine, share of the item's words in common order.

    Only regions that hold enough of the item's words in any order (each as often as the item
    has it) are aligned; no other region can be a hit.
    """
    out = []
    for i in np.unique(item):
        mine = np.flatnonzero(item == i)
        d = doc[block[mine]]
        start = offsets[d] + (block[mine] - first[d]) * STEP
        width = (-(-len(s.words[i]) // STEP) + 2) * STEP
        lo = np.maximum(offsets[d], start - STEP)
        hi = np.minimum(offsets[d + 1], start + width - STEP)
        own, spelt, times = np.unique([place[w] for w in s.words[i]], return_inverse=True, return_counts=True)
        number = np.zeros(len(s.vocab) + 1, np.int64)
        number[own] = np.arange(1, len(own) + 1)
        size, least = len(spelt), _least(s, i)
        for a in range(0, len(mine), 4_096):
            part = slice(a, a + 4_096)
            idx = lo[part, None] + np.arange(width)
            seen = number[at[np.minimum(idx, len(at) - 1)]] * (idx < hi[part, None])
            held = np.bincount((seen + np.arange(len(seen))[:, None] * (len(own) + 1)).ravel(), minlength=len(seen) * (len(own) + 1)).reshape(len(seen), -1)
            enough = np.flatnonzero(np.minimum(held[:, 1:], times).sum(1) / size >= least)
            for k, cover in zip((enough + a).tolist(), (_lengths(spelt + 1, seen[enough]) / size).tolist()):
                if cover >= COVER or cover >= least and _inside([place[w] for w in s.answers[i]], at[lo[k] : hi[k]].tolist()):
                    out.append((int(d[k]), int(i), float(cosine[mine[k]]), cover))
    return out


def _best(found: list[tuple[int, int, float, float]]) -> list[tuple[int, int, float, float]]:
    """One row for each document and item: the largest cosine and the largest share of its regions."""
    best: dict[tuple[int, int], tuple[float, float]] = {}
    for d, i, cosine, cover in found:
        was = best.get((d, i), (-1.0, 0.0))
        best[(d, i)] = (max(was[0], cosine), max(was[1], cover))
    return [(d, i, c, v) for (d, i), (c, v) in sorted(best.items())]


def remove(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """``docs`` without the rows that hit an item."""
    bad = hits(docs, benchmark, key, text, item_key, item_text, answer).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    return docs.withColumn("__text_hash", F.xxhash64(text)).join(bad, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__t")), "left_anti").drop("__text_hash")
