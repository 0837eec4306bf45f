"""Sanitisation against plain Python, on hand-made and random texts and on planted contexts."""

import collections
import hashlib
import math
import random
import re

import pytest

from tallyspark.llm import sanitize

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, d in enumerate(map(int, reversed(number))):
        total += d if i % 2 == 0 else 2 * d - 9 if d > 4 else 2 * d
    return total % 10 == 0


def valid(kind, hit):
    number = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 14 <= len(number) <= 19 and luhn(number)
    return kind == "email" or 10 <= len(number) <= 15


def base(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
    return sorted(spans)


def shown(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


ROWS = [
    (1, "mail a.b+c@x-y.example.com, or a@b; a@b.c_d@e.f, a@b@c.de."), (2, None), (3, ""), (None, "ip 1.2.3.4.5.6.7.8 999.1.1.1.1.1.1 0010.000.255.256 0255.1.2.3"),
    (4, "card 4111 1111 1111 1111, 4111-1111-1111-1112 12345678901234567890 79927398713 4111111111111111 5"), (5, "tel +1 (555) 123-4567 and +12 +1234567890123456 +44.20.7946.0958--"),
    (5, "é😀 x@y.zz é +49 (30) 1234567é"), (6, "mail a.b+c@x-y.example.com, or a@b; a@b.c_d@e.f, a@b@c.de."), (7, "a" * 30000 + " 1" * 2000 + " @" * 50 + " end@of.it"),
    (8, "1.1.1.1" + ".1.1.1.1" * 500 + " " + "7" * 5000 + " +1" + "(" * 2000 + "x"), (9, "0.0.0.0 in 1.2.3.4@five.six and 00000000000000"),
]


def check_base(got):
    for text, r in got:
        want = base(text)
        assert r["base_sha256"] == hashlib.sha256(shown(want).encode()).hexdigest(), (text[:80], r["spans"], shown(want))
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[2] == k for s in want) for k in PATTERNS]
        assert r["spans"] == shown(want) or sanitize.TERM in r["spans"]


def test_base_spans(make):
    docs = make(ROWS, ("key", "spans", "private", "copies"))
    got = collections.defaultdict(list)
    for r in sanitize.digest(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    for i, text in ROWS:
        assert any(r["spans"] == shown(base(text)) for r in got[i]), (i, text and text[:60], got[i], shown(base(text)))
    check_base([(text, r) for i, text in ROWS if i != 5 for r in got[i]])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(make, seed):
    rng = random.Random(seed)
    parts = ["a", "Z", "1", "23", "255", ".", ".", "@", "@", "-", " ", "\n", "+", "(", ")", "_", "%", "é", "😀", "4111111111111111", "x.yz", "256"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for k in range(2000)]
    texts = dict(rows)
    check_base([(texts[r.doc_id], r) for r in sanitize.digest(make(rows)).collect()])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert sanitize.digest(empty).count() == 0 and sanitize.sanitize(empty).columns == ["doc_id", "text", "private"]


def planted():
    """A name that stands with one address in different contexts, a name of many, and common words."""
    rng = random.Random(5)
    common = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]

    def filler(n):
        return " ".join(rng.choice(common) for _ in range(n))

    rows = [(k, filler(12)) for k in range(200)]
    rows += [(300 + k, f"{filler(4)} Zebedee, {rng.choice(common)} z.b@mail.org {filler(3)}") for k in range(6)]
    rows += [(400, f"{filler(3)} (Zebedee) was here"), (401, filler(2)), (402, None), (403, "")]
    rows += [(500 + k, "Copied Onceonly note q@r.st with Hapaxword here") for k in range(30)]  # one context, however many copies
    rows += [(600 + k, f"{filler(2)} Shared {filler(1)} u{k}@many.org {filler(2)}") for k in range(8)]
    return rows


def disclosing(rows, threshold=0.9, support=3):
    """(entity, term) by counting over all texts in plain Python."""
    def bare(token):
        return token.strip(sanitize.MARKS)

    def terms(tokens):
        out = set()
        for token in tokens:
            t = bare(token)
            if len(t) >= 3:
                out |= {t.lower(), "<number>" if re.fullmatch("[0-9][0-9.,-]*", t) else "<code>" if re.search("[0-9]", t) else "<name>" if t[0].isupper() else "<word>"}
        return out

    n_term, n_entity, near = collections.Counter(), collections.Counter(), collections.defaultdict(dict)
    copies = collections.Counter(text for _, text in rows if text)
    for text, n in copies.items():
        for t in terms(text.split()):
            n_term[t] += n
        for e in {text[s:t].lower() for s, _, _, t in base(text)}:
            n_entity[e] += n
            for s, _, _, t in base(text):
                if text[s:t].lower() == e:
                    context = (*text[:s].split()[-5:], *text[t:].split()[:5])
                    for word in terms(context):
                        near[e, word].setdefault(text, (n, context))
    out = set()
    for (e, word), found in near.items():
        content = math.log(len(rows) / n_entity[e])
        told = content + math.log(sum(n for n, _ in found.values()) / n_term[word])
        if len({c for _, c in found.values()}) >= support and content > 0 and told >= threshold * content:
            out.add((e, word))
    return out


def test_disclosing_terms(make):
    rows = planted()
    docs = make(rows)
    spans = sanitize.base_spans(sanitize.suspicious_texts(docs))
    found = {(r.entity.split(":", 1)[1], r.term) for r in sanitize.disclosures(docs, spans).collect()}
    assert found == disclosing(rows) and ("z.b@mail.org", "zebedee") in found
    assert not any(e == "q@r.st" for e, _ in found)
    got = {r.doc_id: r for r in sanitize.sanitize(docs).collect()}
    assert got[400].text.endswith("(<name>) was here") and [p.kind for p in got[400].private] == ["term"]
    assert "Zebedee" not in " ".join(r.text or "" for r in got.values()) and "<name>, " in got[300].text and "<email>" in got[300].text
    assert got[500].text == "Copied Onceonly note <email> with Hapaxword here"
    assert got[402].text is None and got[403].text == "" and got[0].text == dict(rows)[0] and got[0].private == []
    assert len(got) == len(rows)


def test_a_class_that_discloses_is_removed(make):
    rows = [(k, "all words here are lower and plain") for k in range(50)] + [(60 + k, f"{w} Quux {w} q@r.st {w} xy") for k, w in enumerate(["one", "two", "three", "four"])]
    got = {r.doc_id: r.text for r in sanitize.sanitize(make(rows)).collect()}
    assert got[60] == "one  one <email> one xy"


def test_overlapping_spans(make):
    r = sanitize.sanitize(make([(1, "see 1.2.3.4@five.six é1.2.3.4. +4111111111111111 x"), (2, "1.1.1.1_2.2.2.2_" * 20 + "@five.six z")])).collect()
    got = {x.doc_id: x for x in r}
    assert got[1].text == "see <email> é<ip>. +<card> x"
    assert got[2].text == "<email> z" and len(got[2].private) == 41
