"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are runs of letters; their log-odds come from labelled documents under Dirichlet priors in a chain: a word's prior is
the estimate of its first six bytes, theirs that of the first five, then four, then the share of toxic documents.  Words
never seen fall back the same way.  With a constant taken from each token, a linear scan finds all maximal segments of
positive score (Ruzzo and Tompa); their scores are judged by the Gumbel law of the best segment of clean documents, and a
document's score is a logistic function of its summed excess over that law and, without any, of how far its best segment falls short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import words as W
from tallyspark.llm.shared import bounded_sample, heaviest, shared_table

STEMS = (4, 5, 6)  # bytes
STRENGTH = 10.0  # pseudo-documents of a prior
DRIFT = 1.2  # taken from each token's log-odds
MOST_TOKENS = 1 << 18  # bound of the broadcast token table
LEAST_DOCUMENTS = 2
CALIBRATION_ROWS = 50_000  # bound of the labelled rows that calibrate the score
TABLE_BITS = 22
DEEPEST = 10.0  # units of the law below which shortfalls are alike
LEAST_SLOPE = 0.01  # texts without a significant passage are ranked by their best one
THRESHOLD = 0.3
FOLDS, HELD_OUT, CALIBRATED = 4, 2, 3

LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True
_SEGMENT = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id has none."""
    return F.crc32(doc_id.cast("string")) % folds


class Tokens:
    """Hashes of the letter runs of a batch, for the whole word and its stems, and the n + 1 offsets of the texts."""

    def __init__(self, texts: pa.Array):
        data, offsets = W.flat(texts)
        inside = LETTERS[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1]))[: len(data)] | edge[:-1]))
        ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True]))[: len(data)] | edge[1:])) + 1
        low = W.LOWER[data]
        self.starts, self.ends, self.bytes = starts, ends, offsets
        self.offsets = np.searchsorted(starts, offsets)
        self.levels = [W.mix(W.hash_spans(low, starts, np.minimum(ends, starts + size)) + np.uint64(size)) for size in STEMS]
        self.levels.append(W.hash_spans(low, starts, ends))


def token_counts(docs: DataFrame) -> DataFrame:
    """token, level, parent, toxic, documents: in how many labelled documents each word and stem occurs; ``docs`` has toxic and text."""
    schema = pa.schema([("token", pa.int64()), ("level", pa.int32()), ("parent", pa.int64()), ("toxic", pa.int64()), ("documents", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = [[] for _ in range(len(STEMS) + 1)]
            for piece in W.slices(batch, "text"):
                tokens, label = Tokens(piece.column("text")), piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                text = np.repeat(np.arange(piece.num_rows), np.diff(tokens.offsets))
                for level, hashes in enumerate(tokens.levels):
                    parents = tokens.levels[level - 1] if level else np.zeros_like(hashes)
                    order = np.lexsort((hashes, text))
                    fresh = np.ones(len(order), dtype=bool)
                    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
                    one = order[fresh]
                    held[level].append(np.stack([hashes[one].view(np.int64), parents[one].view(np.int64), label[text[one]]]))
            for level, parts in enumerate(held):
                if not parts:
                    continue
                rows = np.concatenate(parts, axis=1)
                token, first, which = np.unique(rows[0], return_index=True, return_inverse=True)
                toxic, count = np.bincount(which, rows[2], len(token)).astype(np.int64), np.bincount(which, minlength=len(token))
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), level, dtype=np.int32)), pa.array(rows[1][first]), pa.array(toxic),
                                                  pa.array(count.astype(np.int64))], schema=schema)

    rows = docs.select("toxic", "text").mapInArrow(work, "token bigint, level int, parent bigint, toxic bigint, documents bigint")
    return rows.groupBy("token", "level").agg(F.min("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("documents").alias("documents"))


def token_table(counts: DataFrame, share: float, most: int = MOST_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log-odds of the tokens that say more than their stem; the ``most`` that say most, in bounded memory.

    A token's log-odds are against the share of toxic documents among all.
    """
    counts = shared_table(counts.where(F.col("documents") >= LEAST_DOCUMENTS), "token-counts")
    above = counts.where("level < 0").select(F.col("token").alias("parent"), F.lit(share).alias("prior"))
    parts = []
    for level in range(len(STEMS) + 1):
        own = counts.where(F.col("level") == level).join(above, "parent", "left")
        prior = F.coalesce("prior", F.lit(share))
        rate = (F.col("toxic") + STRENGTH * prior) / (F.col("documents") + STRENGTH)
        rated = own.select("token", "documents", prior.alias("prior"), rate.alias("rate"))
        parts.append(rated)
        above = rated.select(F.col("token").alias("parent"), F.col("rate").alias("prior"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    odds = F.log(F.col("rate") / (1 - F.col("rate")))
    gain = F.abs(odds - F.log(F.col("prior") / (1 - F.col("prior"))))
    told = every.select("token", (odds - math.log(share / (1 - share))).alias("odds"), (gain * F.sqrt("documents")).alias("weight")).where("weight > 0.5")
    table = heaviest(told, F.col("weight"), most).select("token", "odds").toArrow()
    tokens = table.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table.column(1).to_numpy().astype(np.float64)[order]


def scores_of(tokens: Tokens, table: tuple[np.ndarray, np.ndarray], near: np.ndarray) -> np.ndarray:
    """Log-odds of each token: of the longest form that the table has, or 0."""
    known, odds = table
    out = np.zeros(len(tokens.starts))
    if not len(known):
        return out
    for hashes in tokens.levels:  # longer forms later, so they win
        at = np.flatnonzero(near[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        hit = known[place] == hashes[at]
        out[at[hit]] = odds[place[hit]]
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence, in linear time; all have a positive score.

    Each segment knows the nearest earlier one that begins at a smaller total.  The search for such a segment follows these
    links, and what it has passed lies behind the new segment's own link, so nothing is passed twice.
    """
    totals = np.concatenate(([0.0], np.cumsum(scores)))
    segments: list[tuple[float, float, int, int, int]] = []  # totals before and after, first and last place, link
    for k in np.flatnonzero(scores > 0).tolist():
        before, after, first = float(totals[k]), float(totals[k + 1]), k
        j = len(segments) - 1
        while j >= 0 and segments[j][0] >= before:
            j = segments[j][4]
        while j >= 0 and segments[j][1] < after:
            before, first, behind = segments[j][0], segments[j][2], segments[j][4]
            del segments[j:]
            j = behind
        segments.append((before, after, first, k, j))
    return [(first, last, after - before) for before, after, first, last, _ in segments]


def toxic_segments(docs: DataFrame, table: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens and segments (first and last character byte, score) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kept = [f for f in docs.schema if f.name != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros(1 << TABLE_BITS, dtype=bool)
        near[(shared.value[0] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        for batch in batches:
            for piece in W.slices(batch, "text"):
                tokens = Tokens(piece.column("text"))
                scores = scores_of(tokens, shared.value, near) - DRIFT
                found = []
                for k in range(piece.num_rows):
                    at, to, base = tokens.offsets[k], tokens.offsets[k + 1], tokens.bytes[k]
                    own = maximal_segments(scores[at:to])
                    found.append([{"first": int(tokens.starts[at + i] - base), "last": int(tokens.ends[at + j] - base), "score": s} for i, j, s in own])
                columns = [piece.column(f.name) for f in kept]
                names = [*(f.name for f in kept), "n_tokens", "segments"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(tokens.offsets).astype(np.int64)), pa.array(found, pa.list_(_SEGMENT))], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return docs.mapInArrow(work, ", ".join([*fields, "n_tokens bigint", "segments array<struct<first:int,last:int,score:double>>"]))


def best_score(segments: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(segments, lambda s: s["score"])), F.lit(0.0))


@dataclass(frozen=True)
class Calibration:
    """The Gumbel law of clean documents' best segments, and the logistic function of summed excess and shortfall."""

    scale: float = 1.0
    log_k: float = 0.0
    slope: float = 4.0
    base: float = -3.0
    shortfall_slope: float = 0.0

    def excess(self, segments: Column, n_tokens: Column) -> Column:
        """Sum over the significant segments of their score, in units of the law, beyond what a clean text of this length has."""
        expected = F.lit(self.log_k) + F.log(F.greatest(n_tokens, F.lit(1)).cast("double"))
        return F.aggregate(segments, F.lit(0.0), lambda total, s: total + F.greatest(F.lit(0.0), self.scale * s["score"] - expected))

    def significant(self, segments: Column, n_tokens: Column) -> Column:
        """The segments beyond the expected best one of a clean text of this length."""
        expected = F.lit(self.log_k) + F.log(F.greatest(n_tokens, F.lit(1)).cast("double"))
        return F.filter(segments, lambda s: self.scale * s["score"] > expected)

    def shortfall(self, segments: Column, n_tokens: Column) -> Column:
        """How far the best segment stays behind the expected best one, in units of the law: 0 if it does not, at least -``DEEPEST``."""
        expected = F.lit(self.log_k) + F.log(F.greatest(n_tokens, F.lit(1)).cast("double"))
        return F.greatest(F.lit(-DEEPEST), F.least(F.lit(0.0), self.scale * best_score(segments) - expected))

    def score(self, segments: Column, n_tokens: Column) -> Column:
        odds = self.base + self.slope * F.log1p(self.excess(segments, n_tokens)) + self.shortfall_slope * self.shortfall(segments, n_tokens)
        return 1 / (1 + F.exp(-odds))


def calibrate(rows: DataFrame, most: int = CALIBRATION_ROWS) -> Calibration:
    """Fits the law on clean labelled rows and the logistic function on all; ``rows`` has toxic, n_tokens and segments.

    At most ``most`` rows, those with the smallest hash, reach the driver; without rows of either kind the default stays.
    """
    best = best_score(F.col("segments"))
    sample = bounded_sample(rows, ["doc_id", "n_tokens"], most).select("toxic", "n_tokens", best.alias("best"), "segments")
    sample = sample.select("toxic", "n_tokens", "best", F.transform("segments", lambda s: s["score"]).alias("scores")).toArrow()
    toxic, length = sample.column(0).to_numpy().astype(bool), np.maximum(sample.column(1).to_numpy(), 1).astype(float)
    if toxic.all() or not toxic.any():
        return Calibration()
    own = sample.column(2).to_numpy()
    clean = own[~toxic]
    scale = min(max(math.pi / (math.sqrt(6) * max(float(clean.std()), 0.2)), 0.2), 3.0)
    log_k = float(np.mean(scale * clean - np.euler_gamma - np.log(length[~toxic])))
    expected = log_k + np.log(length)
    sums = np.array([sum(max(0.0, scale * s - e) for s in scores) for scores, e in zip(sample.column(3).to_pylist(), expected, strict=True)])
    behind = np.clip(scale * own - expected, -DEEPEST, 0)
    x = np.stack([np.ones(len(sums)), np.log1p(sums), behind])
    weights = np.array([-2.0, 2.0, 0.0])
    for _ in range(50):  # Newton steps of a ridge-penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(weights @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-2 * np.eye(3), x @ (toxic - p) - 1e-2 * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return Calibration(scale, log_k, float(max(weights[1], 0.0)), float(weights[0]), float(max(weights[2], LEAST_SLOPE)))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, passages (byte ranges and scores) for each row of ``docs`` (doc_id, text).

    Labels (doc_id, toxic) count only where crc32 of the id modulo 4 is not 2: two parts give the token table, one part
    calibrates.  Null labels do not count; a null text is an empty one and has no passages; a null id is in no part.
    Repeated rows count and come as often as they are there.  Without labels, scores come from the default calibration.
    """
    fold = fold_of(F.col("doc_id"))
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    learned = marked.where(~fold.isin(HELD_OUT, CALIBRATED))
    base = learned.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    share = ((base[0] or 0) + 1) / (base[1] + 2)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Labels grow with the data, so the plan is the same at every size: the texts of two parts move once.
    counts = token_counts(texts.where(~fold.isin(HELD_OUT, CALIBRATED)).join(learned.hint("merge"), "doc_id").select("toxic", "text"))
    found = shared_table(toxic_segments(texts, token_table(counts, share)), "segments")
    law = calibrate(found.join(marked.where(fold == CALIBRATED), "doc_id"))
    passages = law.significant(F.col("segments"), F.col("n_tokens"))
    score = law.score(F.col("segments"), F.col("n_tokens"))
    return found.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), score.alias("score"),
                        F.when(score >= threshold, 1).otherwise(0).alias("predicted"), F.size(passages).alias("n_passages"), passages.alias("passages"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_passages")
