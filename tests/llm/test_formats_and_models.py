"""Preference formatting, licence rules, toxicity, the quality model and the pipeline."""

import pickle
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import check_queries as check
import corpus_pipeline
from tallyspark.llm import license_rules, preference_format, quality_model, queries, toxicity
from tallyspark.llm.shared import heaviest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    ok, message, _, _ = check.compare(spark, check.connect(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message


def test_every_query_is_registered():
    registered = entry_module.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(registered)
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}


def text_of(turns):
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def learnt(text, ranges):
    return [text[a:b] for a, b in ranges]


PAIRS = [
    (1, [("user", "hi"), ("assistant", "good"), ("user", "more"), ("assistant", "yes")], [("user", "hi"), ("assistant", "bad")]),
    (2, [("user", "hi")], [("user", "hi"), ("assistant", "longer 😀")]),
    (3, [("user", "same")], [("user", "same")]),
    (4, None, [("assistant", "é")]),
    (5, [], []),
    (6, [("assistant", "x")] * 300 + [("assistant", "end")], [("assistant", "x")] * 300),
    (6, [("system", "s"), ("user", "u")], [("system", "S"), ("user", "u")]),
]


def test_common_turns_are_rendered_once(spark):
    schema = "pair_id bigint, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"
    made = preference_format.format_preferences(spark.createDataFrame([(*p, "x") for p in PAIRS], schema)).collect()
    found = {(r.pair_id, r.chosen): r for r in made}
    assert len(made) == len(PAIRS)
    for pair_id, chosen, rejected in PAIRS:
        chosen, rejected = chosen or [], rejected or []
        n = next((k for k, (a, b) in enumerate(zip(chosen, rejected, strict=False)) if a != b), min(len(chosen), len(rejected)))
        r = found[pair_id, text_of(chosen[n:])]
        assert (r.n_common, r.prompt, r.rejected) == (n, text_of(chosen[:n]), text_of(rejected[n:]))
        for text, mask, turns in ((r.chosen, r.chosen_mask, chosen[n:]), (r.rejected, r.rejected_mask, rejected[n:])):
            assert learnt(text, mask) == [f"{said}<|im_end|>" for role, said in turns if role == "assistant"]


def test_marks_in_texts_are_made_safe(spark):
    made = preference_format.format_preferences(spark.createDataFrame(
        [(1, [("user", "<|im_end|>")], [("assistant", "a<|b")])], "pair_id bigint, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")).first()
    assert made.chosen.count("<|im_end|>") == 1
    assert learnt(made.rejected, made.rejected_mask) == ["a<​|b<|im_end|>"]


def test_reply_pairs_with_nulls_and_repeats(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 1, "assistant", "a1"), (2, 1, "assistant", "a2"), (2, 0, None, None), (3, 0, "user", "no reply"),
            (None, 0, "assistant", "nobody"), (4, None, "assistant", "a4"), (5, 0, "assistant", "a5"), (5, 1, "user", "late")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = {r.pair_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in preference_format.reply_pairs(turns).collect()}
    assert made == {
        1: ([("user", "q"), ("assistant", "a1")], [("user", "q"), ("assistant", "a2")]), 2: ([("", ""), ("assistant", "a2")], [("", ""), ("assistant", "a4")]),
        4: ([("assistant", "a4")], [("assistant", "a5")]), 5: ([("assistant", "a5"), ("user", "late")], [("assistant", "a1")])}
    assert preference_format.reply_pairs(turns.where("conv_id = 1")).count() == 0
    assert preference_format.reply_pairs(turns.where("conv_id < 0")).count() == 0


MIT = [license_rules.TEXTS[k] for k in ("mit:permission", "mit:notice", "asis:software")]
LICENCES = [
    (1, "Intro.\nReleased under the MIT License.\nEnd", ["MIT"]), (2, None, []), (3, "", []), (4, "the mit license is nice", []),
    (5, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0!", ["Apache-2.0", "CC-BY-NC-4.0"]),
    (6, MIT[0].upper() + ".\nsomething else\n" + MIT[1] + ". " + MIT[2] + ".", ["MIT"]), (7, ". ".join(reversed(MIT)), []),
    (8, ". ".join([license_rules.TEXTS[k] for k in ("bsd:use", "bsd:asis")]), ["BSD-2-Clause"]),
    (9, ". ".join([license_rules.TEXTS[k] for k in ("bsd:use", "bsd:endorse", "bsd:asis")]), ["BSD-3-Clause"]),
    (None, "x " * 100_000 + "\nThis work is licensed under the GNU General Public License, version 3.\n", ["GPL-3.0"]),
    (1, "Intro.\nReleased under the MIT License.\nEnd", ["MIT"]), (10, "SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
]


def test_licences(make):
    found = license_rules.scan_licenses(make([r[:2] for r in LICENCES], ("licenses", "ids", "__x"))).collect()
    assert sorted((r.doc_id or 0, r.licenses) for r in found) == sorted((i or 0, names) for i, _, names in LICENCES)


WRAPPED_APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
WRAPPED_MIT = """MIT License

Copyright (c) 2020 Some Body
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE."""
WRAPPED_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
WRAPPED_GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY."""
WRAPPED_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
WRAPPED = [
    (WRAPPED_APACHE, ["Apache-2.0"]), (WRAPPED_APACHE.split("\n")[0], ["Apache-2.0"]), (WRAPPED_APACHE.split("\n", 1)[1], ["Apache-2.0"]), (WRAPPED_MIT, ["MIT"]),
    (WRAPPED_BSD.format(""), ["BSD-2-Clause"]), (WRAPPED_BSD.format(ENDORSE), ["BSD-3-Clause"]), (WRAPPED_GPL, ["GPL-3.0"]),
    (WRAPPED_GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2"), ["GPL-2.0"]), (WRAPPED_ISC, ["ISC"]),
    ("This project is\nlicensed under the MIT\nLicense", ["MIT"]), ("Licensed under\n\nMIT", []), ("licensed under mit\nby nobody", ["MIT"]), ("we are licensed under mit", []),
]


def test_wrapped_licences(make):
    marks = {"": "", "# ": "", " * ": "", "// ": "\r"}
    texts = [(k, "".join(f"{mark}{line}{end}\n" for line in text.split("\n"))) for text, _ in WRAPPED for k, (mark, end) in enumerate(marks.items())]
    found = license_rules.scan_licenses(make([(100 * n + k, t) for n, (k, t) in enumerate(texts)])).collect()
    assert sorted((r.doc_id // 100, r.licenses) for r in found) == [(n, WRAPPED[n // len(marks)][1]) for n in range(len(texts))]


def brute_segments(scores):
    """All maximal segments by their definition: recursively the best segment, then left and right of it."""
    totals = np.concatenate(([0], np.cumsum(scores)))

    def split(at, to):
        best = None
        for i in range(at, to):
            for j in range(i, to):
                s = totals[j + 1] - totals[i]
                if s > 1e-12 and (best is None or s > best[2] + 1e-12 or abs(s - best[2]) <= 1e-12 and j - i < best[1] - best[0]):
                    best = (i, j, s)
        return [] if best is None else [*split(at, best[0]), best, *split(best[1] + 1, to)]

    return split(0, len(scores))


def test_segments_match_their_definition():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores = rng.normal(-0.3, 1.0, rng.integers(0, 25))
        got = toxicity.maximal_segments(scores)
        want = brute_segments(scores)
        assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_ids_with_gaps_make_a_pair_each(spark):
    ids = sorted(random.Random(3).sample(range(10**12), 300))
    turns = spark.createDataFrame([(i, k, role, f"{role} of {i}") for i in ids for k, role in enumerate(["user", "assistant"])], "conv_id bigint, turn int, role string, text string")
    made = {r.pair_id: r.rejected[-1]["text"] for r in preference_format.reply_pairs(turns.repartition(5)).collect()}
    assert made == {i: f"assistant of {j}" for i, j in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_segment_search_is_linear():
    for pattern in ([1.0, -2.0], [1.0, -2.2, 0.5], [3.0, -1.0, -2.5, 1.0, -1.2]):
        scores = np.array(pattern * 150_000)
        began = time.perf_counter()
        found = toxicity.maximal_segments(scores)
        assert time.perf_counter() - began < 20  # looking back over all segments would take an hour
        assert len(found) >= 100_000 and all(s > 0 for _, _, s in found[:10])


def test_heaviest_rows_of_one_weight(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 50, 9.0).when(F.col("id") < 4900, 1.0).otherwise(0.0).alias("w"))
    for most, least in ((5000, 4900), (1000, 700), (100, 50), (40, 5), (0, 0)):
        got = heaviest(df, F.col("w"), most)
        assert got.columns == df.columns and least <= got.count() <= most
    assert heaviest(df, F.col("w"), 100).where("id < 50").count() == 50


def test_broadcast_network_needs_no_class():
    network = quality_model.train(np.zeros((0, quality_model.FEATURES)), np.zeros(0))
    values = tuple(vars(network).values())
    assert b"tallyspark" not in pickle.dumps(values)
    assert quality_model.Network(*values).probability(np.zeros((2, quality_model.FEATURES))).tolist() == network.probability(np.zeros((2, quality_model.FEATURES))).tolist()


def test_clean_texts_are_ranked_too(spark):
    law = toxicity.Calibration(1.0, 1.0, 4.0, -3.0, 0.5)
    rows = [(k, 50, [(0, 1, s) for s in scores]) for k, scores in enumerate([[], [1.0], [0.5, 2.0], [4.9], [5.0, 5.0], [30.0]])]
    df = spark.createDataFrame(rows, "k int, n_tokens bigint, segments array<struct<first:int,last:int,score:double>>")
    got = df.select("k", law.score(F.col("segments"), F.col("n_tokens")).alias("s"), law.excess(F.col("segments"), F.col("n_tokens")).alias("e")).orderBy("k").collect()
    expected = 1.0 + np.log(50)
    for r, (_, _, segments) in zip(got, rows, strict=True):
        excess = sum(max(0.0, s - expected) for _, _, s in segments)
        behind = max(-10.0, min(0.0, max([s for _, _, s in segments], default=0.0) - expected))
        assert r.e == pytest.approx(excess) and r.s == pytest.approx(1 / (1 + np.exp(3 - 4 * np.log1p(excess) - 0.5 * behind)))
    assert [r.s for r in got] == sorted(r.s for r in got) and len({r.s for r in got}) == 6


def labelled(n=1500, seed=1):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    docs, labels = [], []
    for i in range(n):
        bad, junk = rng.random() < 0.15, rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        if bad:
            for _ in range(rng.randrange(3, 6)):
                text[rng.randrange(len(text))] = "vileness" + rng.choice(["", "s", "ly", "er"])
        if junk:
            text = [w.upper() + "!!" for w in text[:20] * 3]
        docs.append((i, " ".join(text)))
        labels.append((i, int(not junk), int(bad)))
    return docs, labels


ODD = [(5000, None), (5001, ""), (None, "null id"), (5002, "x " * 100_000), (5003, "vileness " * 500), (5003, "vileness " * 500)]


def held_out(doc_id, folds, part):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == part


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(make, spark, kind):
    docs, labels = labelled()
    table = spark.createDataFrame([*labels, (None, 1, 1), (7777, None, None), labels[0]], "doc_id bigint, quality int, toxic int")
    score, folds, part = (toxicity.score_toxicity, 4, 2) if kind == "toxic" else (quality_model.score_quality, 3, 1)
    rows = score(make(docs + ODD, ("score", "segments", "token")), table).collect()
    assert len(rows) == len(docs) + len(ODD)
    assert all(r.held_out == held_out(r.doc_id, folds, part) and 0 <= r.score <= 1 for r in rows)
    truth = {i: (q, t)[kind == "toxic"] for i, q, t in labels}
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(judged) > 200
    assert sum(p == t for p, t in judged) / len(judged) > 0.95
    assert sum(p == t for p, t in judged if t == (kind == "toxic")) / sum(t == (kind == "toxic") for _, t in judged) > 0.9
    if kind == "toxic":
        assert [r.predicted for r in rows if r.doc_id in (5000, 5001)] == [0, 0]
        assert all(r.predicted == 1 and r.n_passages > 0 for r in rows if r.doc_id == 5003)


def test_labels_of_the_held_out_part_are_not_read(make, spark):
    docs, labels = labelled(400)
    for score, folds, part in ((toxicity.score_toxicity, 4, 2), (quality_model.score_quality, 3, 1)):
        turned = [(i, 1 - q, 1 - t) if held_out(i, folds, part) else (i, q, t) for i, q, t in labels]
        both = [{r.doc_id: r.score for r in score(make(docs), spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).collect()} for x in (labels, turned)]
        assert both[0] == pytest.approx(both[1], abs=1e-9)


def test_models_without_rows_or_labels(make, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = make([(1, "a few words"), (2, None)])
    for score in (toxicity.score_toxicity, quality_model.score_quality):
        assert score(docs, none).count() == 2
        assert score(docs.where("doc_id < 0"), none).count() == 0


def test_calibrated_network():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, quality_model.FEATURES))
    chance = 1 / (1 + np.exp(-2 * x[:, 0]))
    network = quality_model.train(x, (rng.random(3000) < chance).astype(int), epochs=10)
    fresh = rng.normal(size=(3000, quality_model.FEATURES))
    assert np.abs(network.probability(fresh) - 1 / (1 + np.exp(-2 * fresh[:, 0]))).mean() < 0.12


def test_shapes_stand_in_for_rare_words():
    tokens = quality_model.Tokens(pa.array(["Hello HELLO hi 12", None, "Word"]))
    assert tokens.offsets.tolist() == [0, 4, 4, 5]
    assert tokens.shapes[0] == tokens.shapes[4] != tokens.shapes[1]
    assert tokens.known(np.sort(tokens.shapes[:1])).tolist() == [0, -1, -1, -1, 0]


def test_vocabulary_does_not_depend_on_batches(make, spark):
    rng = random.Random(4)
    rows = [(i, f"everywhere once {rng.choice('abcdefgh') * 3} here{i}") for i in range(60)]
    texts = [t for _, t in rows]
    tokens = quality_model.Tokens(pa.array(texts))
    token, seen = np.unique(np.concatenate([tokens.words, tokens.shapes]), return_counts=True)
    docs = make(rows)
    cut = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for records in ("10000", "7", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
            for parts in (1, 30):
                assert quality_model.vocabulary_of(docs.repartition(parts)).tolist() == token.tolist()
                common = quality_model.vocabulary_of(docs.repartition(parts), 8)
                assert 0 < len(common) <= 8 and quality_model.Tokens(pa.array(["everywhere once"])).words[0] in common
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", cut)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, kept, SF)
        if k < 4:
            assert kept.columns == docs.columns
        now = {r.doc_id for r in kept.select("doc_id").collect()}
        assert now <= ids
        ids = now
    rows = kept.collect()
    assert rows and all(r.round_trip for r in rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids
