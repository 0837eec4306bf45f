"""Shingle join, components and decontamination against plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import components, decontaminate, ngram_join, words

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    return sorted((i if i is not None else -1, len(sets[k]), min(ids[find(k)], default=-1)) for k, (i, _) in enumerate(rows))


def mutated(words, share, rng):
    return [w if rng.random() > share else f"z{rng.random()}" for w in words]


def corpus(seed, groups=25, size=12, long=120):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(20)]
    rows = []
    for _ in range(groups):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(3, long))] + (passage if rng.random() < 0.6 else [])
        for _ in range(rng.randrange(1, size)):
            rows.append((len(rows), " ".join(mutated(words, rng.choice([0, 0, 0.01, 0.02, 0.04, 0.1]), rng))))
    return rows


ODD = [(None, "a b c d e f g"), (9001, "A B C D E F G"), (9002, ""), (9003, None), (9004, " \n\t"), (9005, "one two"), (9006, "ONE  two\n"), (9007, "one two three"),
       (9008, "same id first text of it"), (9008, "another text for the same id here"), (9009, "another text for the same id here"), (9005, "one two"),
       (None, "nobody has this one but null ids at all"), (9010, "w " * 3000), (9011, "w " * 2999)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_plain_python(make, seed, monkeypatch):
    rows = corpus(seed) + ODD
    monkeypatch.setattr(ngram_join, "PIECE", 4)  # blocks are cut and their pieces meet pairwise
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    monkeypatch.setattr(ngram_join, "RUN_ROWS", 5)
    monkeypatch.setattr(ngram_join, "LONG_RUN", 8 + seed)
    got = ngram_join.near_duplicates(make(rows, ("node", "n", "key", "component")))
    found = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, (-1 if r.component_id is None else r.component_id)) for r in got.collect())
    assert found == brute_components(rows)


def test_whole_blocks(make):
    rows = corpus(3, groups=6, size=60, long=40)
    got = ngram_join.near_duplicates(make(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_one_of_each_group_stays(make):
    docs = make([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words in this one here"), (4, ""), (5, None), (1, "a b c d e f g h"), (None, "x y z v w")], ("node",))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1, 3, 4, 5]


def test_unrelated_texts_of_one_id_and_copies_without_ids(make):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a b c d e f g h"), (1, "other words in this one here"), (None, text), (None, text + " more"), (7, text + " most"), (None, "alone in the world it is"), (8, "A B c d e f g h")]
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in ngram_join.keep_one(make(rows)).collect())
    assert kept == [(-1, "alone in the world it is"), (1, "a b c d e f g h"), (1, "other words in this one here"), (7, text + " most")]


def test_links_of_every_text_of_an_id(make):
    words, others = [f"w{k}" for k in range(80)], [f"v{k}" for k in range(80)]
    rows = [(5, " ".join(words)), (5, " ".join(others)), (6, " ".join(words[:-2])), (7, " ".join(others[2:]))]
    got = ngram_join.near_duplicates(make(rows)).collect()
    assert sorted(map(tuple, got)) == brute_components(rows) and {r.component_id for r in got} == {5}


def test_packed_sets():
    own = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    packed = ngram_join.packed_set(own)
    assert len(packed) == 6 * len(own) and (np.diff(ngram_join.unpacked_set(packed).astype(np.int64)) > 0).all()
    assert len(np.intersect1d(ngram_join.unpacked_set(packed), ngram_join.unpacked_set(ngram_join.packed_set(own[::2])))) == 500


def test_empty_tables(make, spark):
    empty = make([(1, "x")]).where("doc_id < 0")
    assert ngram_join.near_duplicates(empty).count() == 0
    questions = spark.createDataFrame([(1, "a question of more than eight words it is")], "item_id bigint, text string")
    assert decontaminate.contaminated(empty, questions).count() == 0
    assert decontaminate.contaminated(make([(1, "a text")]), questions.where("item_id < 0")).count() == 0


def test_long_unrelated_documents_are_no_candidates_of_each_other(make):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (4000, 5000, 6000, 6000, 7000, 8200)]
    texts.append(texts[0] + " " + " ".join(f"z{k}" for k in range(300)))  # 3,996 and 4,296 shingles: 4,096 and 8,192 groups
    nodes = make(list(enumerate(texts))).selectExpr("doc_id AS node", "text")
    rows = ngram_join.profile(nodes).where("shingle IS NULL").select("node", "n", "vector", "parity")
    block = rows.selectExpr("1L AS s1", "1L AS s2", "*", "node AS component", "2L AS pieces")
    assert [tuple(r) for r in ngram_join.candidate_pairs(block, between=True).collect()] == [(0, 6)]
    assert [tuple(r) for r in ngram_join.candidate_pairs(block.drop("pieces").selectExpr("*", "1L AS pieces"), between=False).collect()] == [(0, 6)]


def test_parities_differ_as_in_the_smaller_number_of_groups(make):
    rng = np.random.default_rng(12)
    sizes = [1, 1800, 2048, 2049, 2600, 4096, 5000, 60000, 70000, 90000]
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 10**6, size + 4)) for size in sizes]
    rows = ngram_join.profile(make(list(enumerate(texts))).selectExpr("doc_id AS node", "text")).where("shingle IS NULL").orderBy("node").collect()
    sets = list(words.shingle_sets(pa.array(texts)))
    assert [8 * len(r.parity) for r in rows] == ngram_join.fine_groups(np.array([len(x) for x in sets])).tolist()
    parities = ngram_join.Parities([bytes(r.parity) for r in rows])
    for i, one in enumerate(sets):
        for j, two in enumerate(sets):
            least, most = sorted((8 * len(rows[i].parity), 8 * len(rows[j].parity)))
            counts = np.bincount((np.setxor1d(one, two) % np.uint64(least)).astype(np.int64), minlength=least)
            want = int((counts % 2).sum()) if most <= 2 * least else 0
            assert parities.differ(np.array([i]), parities, np.array([j])).tolist() == [want]


def test_tree_join_gives_every_pair_that_the_bound_allows():
    rng = np.random.default_rng(5)
    for count in (1, 2, 31, 33, 700):
        vectors = rng.poisson(rng.choice([1.0, 3.0], size=(count, 1)), size=(count, ngram_join.GROUPS)).astype(np.uint8)
        vectors[rng.random(count) < 0.3] = vectors[0]
        sizes = vectors.sum(axis=1).astype(np.int64)
        tree = ngram_join.CountTree(vectors, sizes)
        got = {(i, j) for a, b in ngram_join.tree_join(tree, tree) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        least = np.minimum(vectors[:, None], vectors[None]).sum(axis=2, dtype=np.int64)
        fits = (100 * sizes[:, None] >= 75 * sizes[None]) & (100 * sizes[None] >= 75 * sizes[:, None])
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(fits & (least >= ngram_join.least_overlap(sizes[:, None], sizes[None])))), strict=True))


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (7, 300)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 300: 0, **{k: 100 for k in range(100, 140)}}


QUESTIONS = [
    (1, "If Anna buys 12 apples for 3 dollars each then how much money does Anna spend in the shop on 12 apples?"),
    (2, "What is it?"), (3, "the quick brown fox jumps"), (4, None), (5, ""), (6, "In 1999 the train took 3 hours to go from Rome to Milan with 200 people on board."),
]
ASKED = [
    (1, "x y z. if Bob buys 15 apples for 7 euros each then how much money does Bob spend in the shop on 15 apples? done"),
    (2, "x if Bob buys 15 apples for 7 euros each then how much money does Carl spend in the shop on 16 apples? done"),  # 12 is both 15 and 16
    (3, "IF ANNA BUYS 1,200.5 APPLES FOR 3 DOLLARS EACH THEN HOW MUCH MONEY"), (4, ""), (5, None), (None, "see: the quick, brown fox jumps!"),
    (6, "nothing here at all to see for you 1 2 3 4 5 6 7 8 9"), (7, "word " * 50_000 + "in 2001 the train took 5 minutes to go from Rome to Milan with 90 people on board"),
    (3, "IF ANNA BUYS 1,200.5 APPLES FOR 3 DOLLARS EACH THEN HOW MUCH MONEY"), (8, "what is it? what is it? a fox jumps the quick brown"),
]


@pytest.mark.parametrize("block_hashes", [1 << 20, 3])
def test_questions_are_found_with_other_values(make, spark, block_hashes):
    questions = spark.createDataFrame(QUESTIONS, "item_id bigint, text string")
    found = decontaminate.contaminated(make(ASKED, ("hash", "pos", "slots", "item_id")), questions, block_hashes=block_hashes).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id, r.n_changed) for r in found) == [(-1, 3, 0), (1, 1, 4), (3, 1, 1), (7, 6, 4)]


def test_clean_documents_stay_unchanged(make, spark):
    questions = spark.createDataFrame(QUESTIONS, "item_id bigint, text string")
    docs = make(ASKED, ("hash", "__x"))
    kept = decontaminate.keep_clean(docs, questions)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 8]


DENSE = [
    (1, "What is 25 percent of 80?"), (2, "What is 12 + 7 * 3 - 4?"), (3, "Table: 1 2 3 4 5 6 7 8 9 10 11 12 sums to 78"), (4, "Why so blue?"), (5, "Name the ocean"), (6, "Zanzibar?"),
    (7, "What is 9"), (8, "1 2 3 4"), (9, "What is 40 percent of Rome in 1999?"),
]
COPIES = [
    (1, "so: what is 25 percent of 80? it is 20", [1]), (2, "a 5 What is 12 + 7 * 3 - 4?", [2]), (3, "see 1 2 3 4 5 6 7 8 9 10 11 12 sums to 78 here", [3, 8]),
    (4, "I ask: Why so\nblue? Now Name the ocean of it", [4, 5]), (5, "Why so blue a sky?", []), (6, "Zanzibar is far", []), (7, "is it Zanzibar? yes", [6]), (8, "Zanzibar?", [6]),
    (9, "What is 26 percent of 80?", []), (10, "of 1 2 3", []), (11, "", []), (12, None, []), (13, "6 What is 9", [7]), (None, "then what is 40 percent of rome in 1999", [9]),
]


@pytest.mark.parametrize("block_hashes", [1 << 20, 3])
def test_exact_copies_of_dense_and_short_questions_are_found(make, spark, block_hashes):
    questions = spark.createDataFrame([*DENSE, (10, None), (11, ""), (12, "?!")], "item_id bigint, text string")
    docs = make([r[:2] for r in COPIES], ("form", "length"))
    found = decontaminate.contaminated(docs, questions, block_hashes=block_hashes).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == sorted((i or 0, item) for i, _, items in COPIES for item in items)
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, questions).collect()) == [i for i, _, items in COPIES if not items]


LONG = "Here is a long introduction without any value in it at all, as such things are, and then come 5 apples in one basket on the old table and 5 pears in another basket on the new chair"
EDITED = [
    (1, LONG, 0), (2, LONG.replace("5 pears", "6 pears"), 0), (3, LONG.replace("5 apples", "3 apples").replace("5 pears", "6 pears"), 0), (4, LONG.replace("5", "7"), 1),
    (5, "and then come 5 apples", None),
]


def test_verbatim_windows_count_beside_a_conflict(make, spark):
    questions = spark.createDataFrame([(1, LONG)], "item_id bigint, text string")
    found = {r.doc_id: r for r in decontaminate.contaminated(make([r[:2] for r in EDITED], ("unchanged",)), questions).collect()}
    assert {i: r.n_changed for i, r in found.items()} == {i: n for i, _, n in EDITED if n is not None}
    assert found[1].n_windows == found[4].n_windows > found[2].n_windows > found[3].n_windows > 10
    assert (found[1].n_slots, found[2].n_slots, found[3].n_slots) == (1, 1, 0)
    assert decontaminate.contaminated(make([r[:2] for r in EDITED]), questions, min_windows=found[3].n_windows + 1).count() == 3
