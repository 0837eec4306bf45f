"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Every word has a fixed sparse index vector made of its hash.  The vector of a common word is the sum of the index vectors of
its neighbours over all documents; that of a rare word is the vector of its shape (classes of characters, repeats joined).
A document is pooled as mean and deviation of its word vectors, with the closeness of neighbouring words.  The network and
its temperature are fitted on a bounded sample of labelled rows; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import words as W
from tallyspark.llm.shared import bounded_sample, heaviest, shared_table
from tallyspark.llm.toxicity import fold_of

VOCABULARY = 8192  # bound of the broadcast vectors
SIZE = 32  # numbers of a word vector
MARKS = 2  # set places of an index vector for each sign
REACH = 2  # neighbours on each side
TRAIN_ROWS = 30_000  # bound of the labelled rows that fit the network
HIDDEN = 32
THRESHOLD = 0.5
FOLDS, HELD_OUT = 3, 1
PIECE_BYTES = 1 << 20
FEATURES = 2 * SIZE + 3

# Classes of bytes in a word's shape: small and capital letters, digits, other letters; marks stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("a") : ord("z") + 1] = 1
SHAPE[ord("A") : ord("Z") + 1] = 2
SHAPE[ord("0") : ord("9") + 1] = 3
SHAPE[128:] = 1


class Tokens:
    """Word and shape hashes of a batch, and the n + 1 offsets of the texts."""

    def __init__(self, texts: pa.Array):
        data, offsets = W.flat(texts)
        starts, ends = W.spans(data, offsets)
        self.offsets = np.searchsorted(starts, offsets)
        self.words = W.hash_spans(data, starts, ends)
        shape = SHAPE[data]
        kept = np.ones(len(data), dtype=bool)
        kept[1:] = shape[1:] != shape[:-1]
        kept[starts] = True
        kept &= ~W.SPACE[data]
        place = np.concatenate(([0], np.cumsum(kept)))
        self.shapes = W.mix(W.hash_spans(shape[kept], place[starts], place[ends]) + np.uint64(1))

    def known(self, vocabulary: np.ndarray) -> np.ndarray:
        """Row of each token in the sorted vocabulary: of the word, else of its shape, else -1."""
        if not len(vocabulary):
            return np.full(len(self.words), -1)
        out = np.full(len(self.words), -1)
        for hashes in (self.shapes, self.words):
            place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            out = np.where(vocabulary[place] == hashes, place, out)
        return out


def vocabulary_of(docs: DataFrame, most: int = VOCABULARY) -> np.ndarray:
    """Sorted hashes of the commonest words and shapes of all documents."""
    schema = pa.schema([("token", pa.int64()), ("seen", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for piece in W.slices(batch, "text"):
                tokens = Tokens(piece.column("text"))
                held += [tokens.words, tokens.shapes]
            if held:
                token, seen = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(seen.astype(np.int64))], schema=schema)

    counts = docs.select("text").mapInArrow(work, "token bigint, seen bigint").groupBy("token").agg(F.sum("seen").alias("seen"))
    table = heaviest(shared_table(counts, "words"), F.col("seen"), most).select("token").toArrow()
    return np.sort(table.column(0).to_numpy().astype(np.int64).view(np.uint64))


def word_vectors(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """A row of unit length for each word of the vocabulary: the summed index vectors of its neighbours, less the mean row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("word", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums = np.zeros(len(own) * SIZE)
        for batch in batches:
            for piece in W.slices(batch, "text", PIECE_BYTES):
                tokens = Tokens(piece.column("text"))
                rows, text = tokens.known(own), np.repeat(np.arange(piece.num_rows), np.diff(tokens.offsets))
                marks = [((W.mix(tokens.words + np.uint64(k)) % np.uint64(SIZE)).astype(np.int64), 1 if k < MARKS else -1) for k in range(2 * MARKS)]
                for step in range(1, REACH + 1):
                    if len(rows) <= step:
                        continue
                    near = text[step:] == text[:-step]
                    for here, there in ((rows[step:], slice(None, -step)), (rows[:-step], slice(step, None))):
                        at = np.flatnonzero(near & (here >= 0))
                        for place, sign in marks:
                            sums += sign * np.bincount(here[at] * SIZE + place[there][at], minlength=len(sums))
        sums = sums.reshape(len(own), SIZE).astype(np.int64)
        used = np.flatnonzero(sums.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], schema=schema)

    parts = docs.select("text").mapInArrow(work, "word int, sums array<bigint>")
    summed = parts.groupBy("word").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(SIZE)])
    vectors = np.zeros((len(vocabulary), SIZE))
    table = summed.toArrow()  # at most a row per word of the vocabulary
    if table.num_rows:
        vectors[table.column(0).to_numpy()] = np.stack([table.column(k + 1).to_numpy() for k in range(SIZE)], axis=1)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    vectors -= vectors.mean(axis=0, keepdims=True) if len(vectors) else 0
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, vocabulary: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """doc_id, features: mean and deviation of the word vectors, closeness of neighbours, share of words, log of their number."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, np.vstack([vectors, np.zeros((1, SIZE), dtype=np.float32)])))
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value
        for batch in batches:
            for piece in W.slices(batch, "text", PIECE_BYTES):
                tokens = Tokens(piece.column("text"))
                rows, offsets = tokens.known(own), tokens.offsets
                count = np.maximum(np.diff(offsets), 1)[:, None].astype(np.float64)
                found = table[rows]
                close = np.zeros(len(rows))
                close[1:] = (found[1:] * found[:-1]).sum(axis=1)
                close[offsets[:-1][offsets[:-1] < len(rows)]] = 0  # the first word of a text has no neighbour before it
                mean = _sums(found, offsets) / count
                deviation = np.sqrt(np.maximum(_sums(found * found, offsets) / count - mean * mean, 0))
                near = _sums(close[:, None], offsets) / count
                share = _sums((rows >= 0).astype(np.float64)[:, None], offsets) / count
                length = np.log1p(np.diff(offsets))[:, None] / 10
                features = np.hstack([mean, deviation, near, share, length]).astype(np.float32)
                made = pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), made], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, "doc_id bigint, features array<float>")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows of each text; an empty text has zeros."""
    out = np.zeros((len(offsets) - 1, values.shape[1]))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=np.float64)
    return out


@dataclass(frozen=True)
class Network:
    """Two dense layers with a rectifier between, and the temperature of the logits."""

    centre: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.spread @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 2e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Fits the network by Adam on nine tenths of the rows, and the temperature by log-loss on the last tenth.

    Rows come in a fixed random order.  With rows of one kind only, or none, the result is that kind's share, smoothed.
    """
    if len(y) < 20 or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        zero = np.zeros(FEATURES)
        return Network(zero, zero + 1, np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    fitted = max(10, len(y) * 9 // 10)
    centre, spread = x[:fitted].mean(axis=0), x[:fitted].std(axis=0) + 1e-3
    z = (x - centre) / spread
    weights = [rng.normal(0, np.sqrt(2 / FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    moment, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for at in range(0, fitted, batch):
            taken = slice(at, min(at + batch, fitted))
            inner = z[taken] @ weights[0] + weights[1]
            hidden = np.maximum(inner, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30))) - y[taken]) / len(y[taken])
            back = np.outer(error, weights[2]) * (inner > 0)
            slopes = [z[taken].T @ back + decay * weights[0], back.sum(axis=0), hidden.T @ error + decay * weights[2], np.array([error.sum()])]
            step += 1
            for k, slope in enumerate(slopes):
                moment[k] = 0.9 * moment[k] + 0.1 * slope
                square[k] = 0.999 * square[k] + 0.001 * slope * slope
                weights[k] = weights[k] - rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    network = Network(centre, spread, weights[0], weights[1], weights[2], float(weights[3][0]))
    logits, truth = network.logits(x[fitted:]), y[fitted:]
    choices = np.exp(np.linspace(-2, 2, 81))
    losses = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in choices]
    return Network(centre, spread, weights[0], weights[1], weights[2], float(weights[3][0]), float(choices[int(np.argmin(losses))]))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    The network learns from the at most ``most`` labelled rows (doc_id, quality) with the smallest hash of those whose crc32
    of the id modulo 3 is not 1.  Null labels do not count; a null text is an empty one; a null id is in no part; repeated
    rows come as often as they are there.  Without labels every score is one half.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = vocabulary_of(texts)
    features = shared_table(pooled(texts, vocabulary, word_vectors(texts, vocabulary)), "features")
    fold = fold_of(F.col("doc_id"), FOLDS)
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = features.join(marked.where(fold != HELD_OUT), "doc_id")
    sample = bounded_sample(rows, ["doc_id"], most).select("doc_id", "features", "quality").toArrow().sort_by("doc_id")
    x = sample.column(1).combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if sample.num_rows else np.zeros((0, FEATURES))
    # Plain arrays: a broadcast object would need its class, and so the package, on every worker.
    network = docs.sparkSession.sparkContext.broadcast(tuple(vars(train(x, sample.column(2).to_numpy())).values()))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*network.value)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.probability(x))], schema=schema)

    scored = features.mapInArrow(work, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
