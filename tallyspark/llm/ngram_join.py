"""Jaccard join of documents on 5-word shingles, with an R-tree over count vectors.

A document's shingles are hashed into ``GROUPS`` groups; the counts per group are a point.  The overlap of two documents is
at most the sum, over the groups, of the smaller count, and for boxes of points at most the sum of the smaller upper edges.
R-trees over the points are joined under that bound.  A surviving pair is also held against the parities of its counts in
finer groups: sets differ in at least as many shingles as parities.  There are at least as many groups as shingles, up to
``MOST_FINE``, as the parities of fewer groups cannot tell long documents apart.  What is left is verified on the whole
shingle sets.

Points of unrelated documents lie too close together for one tree over all of them to prune, so the trees stand over
blocks: documents that share one of the rarest quarter of their shingles.  Two documents with a similarity of 0.75 or more
share such a shingle in any common order of shingles (the prefix property), so blocks lose no link.  Very common shingles
come last in that order; which ones those are changes the speed alone.

Links of a first round (the nearest surviving partner of each document in its block) are joined to components; a second
round takes all surviving pairs between different components.  Blocks are cut into pieces, and pairs of pieces are tasks of
their own, so neither a very common shingle nor a very large group of near copies meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import words as W
from tallyspark.llm.components import connected_components
from tallyspark.llm.shared import free_shuffles, heaviest, shared_table

GROUPS = 128
FINE_GROUPS = 2048  # at least; a power of two
MOST_FINE = 1 << 16
FULL = 255  # a count from which on a coordinate bounds nothing
PERCENT = 75
COMMON_SHINGLES = 1 << 18  # bound of the broadcast list of common shingles
COMMON_IN_BATCH = 3
PIECE = 512  # documents of a block, or partners of a document, that meet in one task
LEAF = 32
FANOUT = 16
OUT_ROWS = 50_000
RUN_ROWS = 100_000
LONG_RUN = 1_000_000
SET_BYTES = 6  # of each shingle hash, when whole sets are compared


def node_of(id_col: Column, text: Column) -> Column:
    """A 64-bit hash of id and text: rows with the same id and text are one node."""
    return F.xxhash64(id_col, F.coalesce(text, F.lit("")))


def least_overlap(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """The smallest overlap of sets of n and m for which 100 * overlap >= 75 * union."""
    return (PERCENT * (n + m) + 99 + PERCENT) // (100 + PERCENT)


def prefix_length(n: int) -> int:
    """So many of the first of n shingles, in any order, that a linked document shares one of them."""
    return n - (PERCENT * n + 99) // 100 + 1


def fine_groups(sizes: np.ndarray) -> np.ndarray:
    """How many finer groups sets of these sizes have: the next power of two, within ``FINE_GROUPS`` and ``MOST_FINE``."""
    return 1 << np.ceil(np.log2(np.clip(sizes, FINE_GROUPS, MOST_FINE))).astype(np.int64)


def _profile_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A row per document, and a row per shingle that several documents of the batch have."""
    gathered = []
    for piece in W.slices(batch, "text"):
        sets = list(W.shingle_sets(piece.column(1)))
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        gathered.append(every)
        own = np.repeat(np.arange(len(sets)), sizes)
        counts = np.bincount(own * GROUPS + (every >> np.uint64(57)).astype(np.int64), minlength=len(sets) * GROUPS)
        vectors = np.minimum(counts, FULL).astype(np.uint8).tobytes()
        widths = fine_groups(sizes)
        edges = np.concatenate(([0], np.cumsum(widths)))
        within = (every & (widths[own] - 1).astype(np.uint64)).astype(np.int64)
        parity = np.packbits((np.bincount(edges[own] + within, minlength=int(edges[-1])) & 1).astype(np.uint8)).tobytes()
        edges = (edges // 8).tolist()
        prints = [_sums(W.mix(every ^ np.uint64(seed)), sizes) for seed in (0x1234567, 0x89ABCDE)]
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(sizes), *map(pa.array, prints), pa.array([vectors[k : k + GROUPS] for k in range(0, len(vectors), GROUPS)], pa.binary()),
             pa.array([parity[at:to] for at, to in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
             pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64())], schema=_PROFILE)
    shingles, seen = np.unique(np.concatenate(gathered), return_counts=True)
    common = seen >= COMMON_IN_BATCH
    shingles, seen = shingles[common].view(np.int64), seen[common]
    for at in range(0, len(seen), OUT_ROWS):
        part = slice(at, at + OUT_ROWS)
        size = len(seen[part])
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(size, f.type) for f in list(_PROFILE)[:6]), pa.array(shingles[part]), pa.array(seen[part].astype(np.int64))], schema=_PROFILE)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the runs of given sizes."""
    filled = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
    ends = np.cumsum(sizes)
    return (filled[ends] - filled[ends - sizes]).view(np.int64)


_PROFILE = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("vector", pa.binary()),
                      ("parity", pa.binary()), ("shingle", pa.int64()), ("seen", pa.int64())])
_KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64())])
_BLOCKS = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("node", pa.int64())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def profile(docs: DataFrame) -> DataFrame:
    """node, n, k1, k2, vector, parity: size, 128-bit print and count vectors of each document's shingle set; then shingle, seen."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _profile_rows(batch)

    return docs.mapInArrow(work, "node bigint, n bigint, k1 bigint, k2 bigint, vector binary, parity binary, shingle bigint, seen bigint")


def common_shingles(profiles: DataFrame, most: int = COMMON_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles, sorted by hash, and how often they were seen; at most ``most`` reach the driver."""
    seen = profiles.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen"))
    table = heaviest(seen, F.col("seen"), most).select("shingle", "seen").toArrow()
    shingles, counts = table.column(0).to_numpy().astype(np.int64).view(np.uint64), table.column(1).to_numpy().astype(np.int64)
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def prefix_keys(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, node: the rarest quarter of each document's shingles; equal sets give rows once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = shared.value
        known: set[bytes] = set()
        for batch in batches:
            for piece in W.slices(batch, "text"):
                keys, nodes = [], []
                for node, own in zip(piece.column(0).to_pylist(), W.shingle_sets(piece.column(1)), strict=True):
                    mark = _mark(own)
                    if not len(own) or mark in known:
                        continue
                    known.add(mark)
                    if len(shingles):
                        place = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
                        rank = np.where(shingles[place] == own, counts[place], 0)
                        if rank.any():
                            own = own[np.lexsort((own, rank))]
                    keys.append(own[: prefix_length(len(own))])
                    nodes.append(np.full(len(keys[-1]), node, dtype=np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], schema=_KEYS)

    return docs.mapInArrow(work, "key bigint, node bigint")


def _mark(own: np.ndarray) -> bytes:
    return np.array([np.sum(W.mix(own)), np.sum(W.mix(own ^ np.uint64(0x1234567)))], dtype=np.uint64).tobytes()


def blocks_of(keys: DataFrame) -> DataFrame:
    """s1, s2, node: documents that share a key; blocks with the same documents come once, named by a print of the documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for keys, nodes, long in _whole_runs(batches):
            if long:  # named by its key instead, so all its parts are one block
                name = np.full(len(keys), W.mix(keys[:1].view(np.uint64)).view(np.int64)[0])
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.full(len(keys), -1)), pa.array(nodes)], schema=_BLOCKS)
                continue
            fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
            keys, nodes = keys[fresh], nodes[fresh]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            own = nodes.view(np.uint64)
            marks = [np.add.reduceat(W.mix(own ^ np.uint64(seed)), starts).view(np.int64) for seed in (0, 0x1234567)]
            taken = []
            for k in np.flatnonzero(sizes > 1).tolist():
                if (mark := int(marks[0][k])) not in told:
                    told.add(mark)
                    taken.append(k)
            if len(told) >= 1_000_000:
                told.clear()  # a block told twice is no harm
            if taken:
                chosen = np.zeros(len(starts), dtype=bool)
                chosen[taken] = True
                rows = np.repeat(chosen, sizes)
                named = [np.repeat(mark, sizes)[rows] for mark in marks]
                yield pa.RecordBatch.from_arrays([*map(pa.array, named), pa.array(nodes[rows])], schema=_BLOCKS)

    dealt = keys.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(work, "s1 bigint, s2 bigint, node bigint").distinct()


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The sorted rows (keys, nodes), cut between runs of equal keys.

    A run of more than ``LONG_RUN`` rows does not fit memory as a whole: its rows come in parts, marked with True.
    """
    keys, nodes, long_key = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None
    for batch in batches:
        keys, nodes = np.concatenate((keys, batch.column(0).to_numpy())), np.concatenate((nodes, batch.column(1).to_numpy()))
        if long_key is not None and len(keys):
            cut = int(np.searchsorted(keys, long_key, side="right"))
            if cut:
                yield keys[:cut], nodes[:cut], True
            if cut < len(keys):
                long_key = None
            keys, nodes = keys[cut:], nodes[cut:]
        if len(keys) < RUN_ROWS:
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield keys[:cut], nodes[:cut], False
            keys, nodes = keys[cut:], nodes[cut:]
        if len(keys) > LONG_RUN:
            long_key = keys[0]
            yield keys, nodes, True
            keys, nodes = keys[:0], nodes[:0]
    if len(keys):
        yield keys, nodes, False


class Parities:
    """The parities of documents, each in its own number of groups and folded to half of it.

    Two documents whose sizes allow a link are at most one power of two apart, so they are compared in the smaller number.
    """

    def __init__(self, packed: list[bytes]):
        self.widths = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed))
        self.place: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}
        for width in np.unique(self.widths).tolist():
            for target in (width, width // 2):
                if target not in self.rows:
                    own, twice = np.flatnonzero(self.widths == target), np.flatnonzero(self.widths == 2 * target)
                    rows = [np.frombuffer(b"".join([packed[k] for k in some.tolist()]), dtype=np.uint64) for some in (own, twice)]
                    halves = rows[1].reshape(len(twice), 2, target // 8)
                    self.rows[target] = np.concatenate((rows[0].reshape(len(own), target // 8), halves[:, 0] ^ halves[:, 1]))
                    self.place[target] = np.zeros(len(packed), dtype=np.int64)
                    self.place[target][np.concatenate((own, twice))] = np.arange(len(own) + len(twice))

    def differ(self, own: np.ndarray, other: Parities, others: np.ndarray) -> np.ndarray:
        """In how many groups each document of ``own`` differs from the one of ``others``; 0 if the widths are too far apart."""
        out = np.zeros(len(own), dtype=np.int64)
        first, second = self.widths[own], other.widths[others]
        least = np.minimum(first, second)
        for width in np.unique(least).tolist():
            some = np.flatnonzero((least == width) & (np.maximum(first, second) <= 2 * width))
            a, b = self.rows[width][self.place[width][own[some]]], other.rows[width][other.place[width][others[some]]]
            out[some] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return out


class CountTree:
    """R-tree over count vectors: a node has the upper edges of its points' box and the range of their sizes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, parities: Parities | None = None):
        self.vectors, self.sizes, self.parities = vectors, sizes, parities
        spread = vectors.astype(np.int32).var(axis=0) if len(sizes) > LEAF else np.zeros(1)
        axes = np.argsort(-spread)[:4]
        self.order = np.lexsort((*vectors[:, axes].T, sizes)) if len(sizes) > LEAF else np.arange(len(sizes))
        groups = [self.order[at : at + LEAF] for at in range(0, len(sizes), LEAF)]
        self.leaves = groups
        self.levels = [(np.array([vectors[g].max(axis=0) for g in groups]), np.array([sizes[g].min() for g in groups]), np.array([sizes[g].max() for g in groups]))]
        while len(self.levels[-1][0]) > 1:
            upper, low, high = self.levels[-1]
            cuts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.maximum.reduceat(upper, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))


def _surviving(upper: np.ndarray, low: np.ndarray, high: np.ndarray, upper2: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """Which pairs of boxes (or points) may hold a link: by their sizes, and by the sum of coordinate minima."""
    fits = (100 * high[:, None] >= PERCENT * low2[None]) & (100 * high2[None] >= PERCENT * low[:, None])
    if not fits.any():
        return fits
    least = np.minimum(upper[:, None], upper2[None])
    return fits & ((least.sum(axis=2, dtype=np.int64) >= least_overlap(low[:, None], low2[None])) | (least == FULL).any(axis=2))


def tree_join(first: CountTree, second: CountTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points of two trees that survive the bound, by descending both trees together; a tree with itself gives (i, j) twice."""
    stack = [(max(len(first.levels), len(second.levels)) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        rows, cols = _children(first, level, i), _children(second, level, j)
        if level == 0:
            p, q = first.leaves[i], second.leaves[j]
            a, b = np.nonzero(_surviving(first.vectors[p], first.sizes[p], first.sizes[p], second.vectors[q], second.sizes[q], second.sizes[q]))
            a, b = p[a], q[b]
            if len(a) and first.parities is not None:
                n, m = first.sizes[a], second.sizes[b]
                close = first.parities.differ(a, second.parities, b) <= n + m - 2 * least_overlap(n, m)
                a, b = a[close], b[close]
            if len(a):
                yield a, b
            continue
        x, y = first.levels[min(level - 1, len(first.levels) - 1)], second.levels[min(level - 1, len(second.levels) - 1)]
        a, b = np.nonzero(_surviving(*(v[rows] for v in x), *(v[cols] for v in y)))
        stack += [(level - 1, int(rows[s]), int(cols[t])) for s, t in zip(a, b, strict=True)]


def _children(tree: CountTree, level: int, node: int) -> np.ndarray:
    """Nodes one level below; a shallow tree waits at its root."""
    if level >= len(tree.levels):
        return np.array([0])
    if level == 0:
        return tree.leaves[node]
    return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(tree.levels[level - 1][0])))


def candidate_pairs(rows: DataFrame, between: bool) -> DataFrame:
    """a < b: pairs of a block that survive the bound of the R-tree join.

    ``rows`` has s1, s2, node, n, vector, component and pieces (how many pieces the block is cut into).  Without ``between``
    each document gets its nearest surviving partner among the smaller ones of its piece; with it, all pairs of all pieces
    whose components differ.
    """
    own = F.pmod(F.xxhash64("node"), F.col("pieces"))
    if between:
        others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))
        dealt = rows.withColumn("piece", own).withColumn("other", others)
        dealt = dealt.withColumn("p", F.least("piece", "other")).withColumn("q", F.greatest("piece", "other"))
    else:
        dealt = rows.withColumn("piece", own).withColumn("p", F.col("piece")).withColumn("q", F.col("piece"))
    dealt = dealt.select("s1", "s2", "p", "q", "piece", "node", "n", "component", "vector", "parity")
    dealt = dealt.repartition("s1", "s2", "p", "q").sortWithinPartitions("s1", "s2", "p", "q", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        firsts, seconds, held = [], [], 0
        for block in _blocks(batches):
            for a, b in _pairs_of(block, between):
                fresh = [k for k, pair in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if pair not in told]
                if len(told) >= 1_000_000:
                    told.clear()
                a, b = a[fresh], b[fresh]
                told.update(zip(a.tolist(), b.tolist(), strict=True))
                firsts.append(a)
                seconds.append(b)
                held += len(a)
            if held >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts)), pa.array(np.concatenate(seconds))], schema=_PAIRS)
                firsts, seconds, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts)), pa.array(np.concatenate(seconds))], schema=_PAIRS)

    return dealt.mapInArrow(work, "a bigint, b bigint").distinct()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (s1, s2, p, q) of the sorted rows, as tables of at most two pieces."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        keys = np.stack([table.column(k).to_numpy() for k in range(4)])
        edges = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
        for at, to in zip(edges[:-2], edges[1:-1], strict=True):
            if to - at > 1:
                yield table.slice(at, to - at)
        rest = table.slice(edges[-2])
    if rest is not None and rest.num_rows > 1:
        yield rest


def _pairs_of(block: pa.Table, between: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    piece, node, n, component = (block.column(k).to_numpy() for k in range(4, 8))
    if between and component.min() == component.max():
        return
    vectors = np.frombuffer(b"".join(block.column(8).to_pylist()), dtype=np.uint8).reshape(len(n), GROUPS)
    p, q = block.column(2)[0].as_py(), block.column(3)[0].as_py()
    left, right = np.flatnonzero(piece == p), np.flatnonzero(piece == q)
    if not len(left) or not len(right):
        return
    packed = block.column(9).to_pylist()
    first = CountTree(vectors[left], n[left], Parities([packed[k] for k in left.tolist()]))
    second = first if p == q else CountTree(vectors[right], n[right], Parities([packed[k] for k in right.tolist()]))
    best = np.full(len(n), -1, dtype=np.int64)
    slack = np.full(len(n), -1, dtype=np.int64)
    for i, j in tree_join(first, second):
        if not between:
            differ = first.parities.differ(i, second.parities, j)
        i, j = left[i], right[j]
        if between:
            i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
            apart = component[i] != component[j]
            if apart.any():
                yield node[i[apart]], node[j[apart]]
            continue
        rising = node[i] < node[j]
        i, j, differ = i[rising], j[rising], differ[rising]
        room = 1000 - 1000 * differ // (n[i] + n[j])
        for x, y, r in zip(i.tolist(), j.tolist(), room.tolist(), strict=True):
            if r > slack[y]:
                best[y], slack[y] = x, r
    found = np.flatnonzero(best >= 0)
    if len(found):
        yield node[best[found]], node[found]


def packed_set(own: np.ndarray) -> bytes:
    """A set of shingle hashes as the sorted first ``SET_BYTES`` bytes of each, mixed."""
    first = np.unique(W.mix(own) >> np.uint64(64 - 8 * SET_BYTES))
    return first.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def unpacked_set(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // SET_BYTES, 8), dtype=np.uint8)
    wide[:, :SET_BYTES] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, SET_BYTES)
    return wide.view("<u8").ravel()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose whole shingle sets have 100 * overlap >= 75 * union.

    A document's partners are dealt into parts of about ``PIECE``; its own set goes to each part, a partner's to the one it
    is in.  Sets are compared by ``SET_BYTES`` bytes of each shingle's hash, so two shingles that differ count as equal with
    a chance of 2**-48.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("bigint").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    partners = dealt.select(F.col("b").alias("node"), F.col("a").alias("home"), "part", F.lit(1).alias("turn"))
    homes = dealt.select(F.col("a").alias("node"), F.col("a").alias("home"), "part", F.lit(0).alias("turn")).distinct()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["home", "part", "turn", "node", "n", "own"]
        for batch in batches:
            for piece in W.slices(batch, "text"):
                sets = list(W.shingle_sets(piece.column(4)))
                sizes = pa.array([len(own) for own in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in range(4)), sizes, pa.array(map(packed_set, sets), pa.binary())], names=names)

    # The wanted documents grow with the data, so the plan is the same at every size: each text moves once.
    wanted = partners.unionByName(homes)
    texts = docs.select("node", "text").dropDuplicates(["node"])
    held = texts.join(wanted.hint("merge"), "node").select("home", "part", "turn", "node", "text")
    sets = held.mapInArrow(make, "home bigint, part bigint, turn int, node bigint, n bigint, own binary")
    sided = sets.repartition("home", "part").sortWithinPartitions("home", "part", "turn", "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, own = 0, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            linked: list[tuple[int, int]] = []
            for home, turn, node, n, packed in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), batch.column(5), strict=True):
                found = unpacked_set(packed.as_buffer())
                if turn == 0:
                    first, own = n, found
                elif len(np.intersect1d(own, found, assume_unique=True)) >= least_overlap(first, n):
                    linked.append((home, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.int64()) for k in (0, 1)], schema=_PAIRS)

    return sided.mapInArrow(check, "a bigint, b bigint")


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, node, n_shingles, component for each row: the smallest node that its text reaches by links.

    Links between equal sets need no comparison; all others are verified.
    """
    def kept(df: DataFrame, name: str) -> DataFrame:
        table = shared_table(df, name)
        free_shuffles(docs.sparkSession)
        return table

    nodes = docs.select(node_of(F.col(id_col), F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    profiles = shared_table(profile(nodes), "profiles")
    rows = profiles.where("shingle IS NULL").select("node", "n", "k1", "k2", "vector", "parity")
    copies = rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("node").alias("first"))
    first_of = rows.where("n > 0").join(copies, ["n", "k1", "k2"]).select("node", "first").distinct()
    firsts = kept(first_of, "copies")
    same = firsts.select(F.col("node").alias("u"), F.col("first").alias("v"))

    blocks = blocks_of(prefix_keys(nodes, common_shingles(profiles)))
    blocks = kept(blocks.join(firsts, "node").select("s1", "s2", F.col("first").alias("node")).distinct(), "blocks")
    sizes = blocks.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    sizes = sizes.select("s1", "s2", F.ceil(F.col("held") / PIECE).cast("bigint").alias("pieces"))
    points = rows.join(copies, ["n", "k1", "k2"]).where("node = first").select("node", "n", "vector", "parity").dropDuplicates(["node"])
    placed = blocks.join(sizes, ["s1", "s2"]).join(points, "node")

    near = kept(candidate_pairs(placed.withColumn("component", F.col("node")), between=False), "near")
    links = kept(verified(near, nodes), "links")
    found = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    grouped = kept(connected_components(found), "groups")
    told = placed.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_blocks = blocks.join(grouped, "node", "left").groupBy("s1", "s2").agg(
        F.min(F.coalesce("component", "node")).alias("low"), F.max(F.coalesce("component", "node")).alias("high")).where("low < high").select("s1", "s2")
    rest = candidate_pairs(told.join(open_blocks, ["s1", "s2"], "left_semi"), between=True).join(near, ["a", "b"], "left_anti")
    more = kept(verified(kept(rest, "between"), nodes), "links").select(F.col("b").alias("u"), F.col("a").alias("v"))
    labels = kept(connected_components(found.unionByName(more).unionByName(same)), "labels")
    # Rows of one text and id are one node, and the row's id comes back by the same hash.
    ids = docs.select(node_of(F.col(id_col), F.col(text_col)).alias("node"), F.col(id_col).alias(id_col))
    sized = rows.select("node", F.col("n").alias("n_shingles")).distinct()
    joined = ids.join(sized, "node").join(labels, "node", "left")
    return joined.select(id_col, "node", "n_shingles", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for each row: the smallest id that it reaches by links, its own included.

    Rows with one id share a component, whatever their texts.  A row with a null id takes part; a component without any id
    has the id null.  A document without words has no shingles and no links but those of its id.  Repeated rows give
    repeated results, other columns are not looked at, and an empty table gives no rows.
    """
    rows = shared_table(text_groups(docs, id_col, text_col), "components")
    # Components that one id holds together: links from each of them to the smallest one of the id.
    of_id = rows.where(F.col(id_col).isNotNull()).select(id_col, "component").distinct()
    least = of_id.groupBy(id_col).agg(F.min("component").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    merged = connected_components(of_id.join(least, id_col).select(F.col("component").alias("u"), "v"))
    rows = rows.join(merged.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    rows = rows.withColumn("root", F.coalesce("root", "component"))
    smallest = rows.groupBy("root").agg(F.min(id_col).alias("component_id"))
    return rows.join(smallest, "root").select(id_col, "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicate texts: the one with the smallest id, a null id last.

    Here rows with one id and unrelated texts are different documents and all stay, as do rows without words; of rows with
    the same id and text one stays.  All columns stay as they are.
    """
    groups = text_groups(docs, id_col, text_col)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "node")
    roots = groups.groupBy("component").agg(F.min(order).alias("best")).select(F.col("best.node").alias("__node"))
    noded = docs.withColumn("__node", node_of(F.col(id_col), F.col(text_col)))
    return noded.join(roots, "__node", "left_semi").dropDuplicates(["__node"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
