"""JSON token streams against Python's parser, on random trees and on broken texts."""

import json
import random

import pytest

from tallyspark.functions import jsonstream as J
from tallyspark.operators import scans as S

KEYS = ["a", "b c", "Per-Sample", "records", "x_path", "Path", "token_usage", "privacy", "k\"q", "é", "prompt", "n.1"]
SCALARS = [1, -2.5, 0, 1e30, True, False, None, "text", "a, b: {c} [d]", "quote \" and \\ back", "", "é😀"]


def tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.4:
        return rng.choice(SCALARS)
    if kind < 0.7:
        return {k: tree(rng, depth - 1) for k in rng.sample(KEYS, rng.randint(0, 4))}
    return [tree(rng, depth - 1) for _ in range(rng.randint(0, 4))]


def trees(seed, count=120):
    rng = random.Random(seed)
    values = [{k: tree(rng, 4) for k in rng.sample(KEYS, 3)} if rng.random() < 0.8 else tree(rng, 4) for _ in range(count)]
    return [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for v in values]


def without(value, gone):
    """The tree less the members whose key ``gone`` names."""
    if isinstance(value, dict):
        return {k: without(v, gone) for k, v in value.items() if not gone(k)}
    return [without(v, gone) for v in value] if isinstance(value, list) else value


def numbers_of(value, most):
    """Paths to the numbers under plain keys, among the first ``most`` items of lists."""
    if isinstance(value, dict):
        return [(k, *p) for k, v in value.items() if k.replace(".", "").replace("_", "").replace("-", "").isalnum() and k.isascii() for p in numbers_of(v, most)]
    if isinstance(value, list):
        return [(*p,) for v in value[:most] for p in numbers_of(v, most)]
    return [(value,)] if isinstance(value, (bool, int, float)) else []


@pytest.mark.parametrize("seed", [1, 2])
def test_records_go_from_random_trees(spark, seed):
    texts = trees(seed)
    df = spark.createDataFrame([(n, t) for n, t in enumerate([*texts, texts[0]])], "n int, t string").repartition(3)
    got = {r["n"]: r["t"] for r in S.strip_records(df, "t").collect()}
    for n, t in enumerate([*texts, texts[0]]):
        assert json.loads(got[n]) == without(json.loads(t), lambda k: k in ("Per-Sample", "records", "x_path", "Path")), t


@pytest.mark.parametrize("most", [None, 2])
def test_numbers_stay_of_random_trees(spark, most):
    texts = trees(3)
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    for r in S.numeric_fields(df, "t", most).collect():
        want = numbers_of(json.loads(texts[r["n"]]), most)
        if not want:
            assert r["t"] is None
            continue
        left = json.loads(r["t"])
        assert numbers_of(left, None) == want

        def full(value):
            return len(value) > 0 and all(map(full, value.values() if isinstance(value, dict) else value)) if isinstance(value, (dict, list)) else value is not None and not isinstance(value, str)

        assert full(left)


def test_valid_and_broken_texts(spark):
    good = ["1", '"x"', "[]", "{}", ' [1, {"a": [[]]}] ', "null", "-0.5e+3", "[NaN, -Infinity]", '{"a": "\\u00e9\\n"}', "[" * 3000 + "]" * 3000]
    bad = ["", " ", "1 2", "[1,]", "[,1]", '{"a"}', '{"a":}', '{"a" 1}', '{1: 2}', '{"a": 1,}', "[1", "]", "[}", '{"a": [}]', '"x', "[1 2]", '{"a": 1 "b": 2}', "01", "tru", '"\\x"', "{}{}", "[1]]", '{"a": "b": 1}', '["a": 1]', ":", ","]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    stream = J.token_stream(df, "t")
    keys = {r[0]: r[1] for r in df.select("t", J.document_key(df["t"])).collect()}
    valid = {r[0] for r in J.valid_documents(stream).collect()}
    assert [t[:20] for t in good if keys[t] not in valid] == [] and [t for t in bad if keys[t] in valid] == []


def test_rules_per_child(spark):
    cases = [
        ('{"token_usage": {"prompt_tokens": 3, "raw_response": 1}}', []), ('{"token_usage": {"prompt_tokens": 3, "raw_response": "x"}}', ["forbidden field"]),
        ('{"token_usage": {"raw_response": true}}', ["forbidden field"]), ('{"a": {"raw_response": 1}}', ["forbidden field"]),
        ('{"privacy": {"raw_response": false}}', []), ('{"privacy": {"raw_response": 0}}', ["forbidden field"]), ('{"deep": {"privacy": {"raw_response": false}}}', ["forbidden field"]),
        ('{"raw\\u005fresponse": 1}', ["forbidden field"]), ('{"x": [NaN]}', ["non-finite number"]), ("{", ["invalid json"]), (None, ["invalid json"]),
        ('{"path": "/Users/me/run.json"}', ["unsafe text"]),
    ]
    df = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "n int, t string")
    got = {r["n"]: r["problems"] for r in S.unsafe_structure(df, "t", document="manifest").collect()}
    assert [got[n] for n in range(len(cases))] == [p for _, p in cases]
    assert [r["problems"] for r in S.unsafe_structure(df.where("n = 4"), "t").collect()] == [["forbidden field"]]
