"""Licence scan by sentence rules, as SQL expressions on each row.

A text is cut into normalised sentences (ASCII letters and digits in lower case, single blanks).  A sentence is a line or
several lines of one paragraph, as licences are wrapped.  A sentence that is known becomes its identifier; a licence is
recognised when the identifiers of its rule come in that order, other sentences between them allowed.  Rules are tried in
order, and one may yield to an earlier one that has matched.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCE_END = r"[.!?;]+[\x20\x09-\x0D]+"
NOT_WORD = r"[^A-Za-z0-9.\n]+"
LINE_EDGES = r"(?m)^[ .]++|(?<![ .])[ .]++$"
URL_BELOW = r"(?<=license at)\n+(?=http)"
AFTER_COLON = r"(?<=free software) (?=you can redistribute)"

# How notices name licences, and the sentences of licence texts.
NAMES = {
    "MIT": ("the mit license", "mit license", "mit", "the mit licence"),
    "Apache-2.0": ("the apache license version 2.0", "apache license 2.0", "the apache license 2.0", "apache 2.0", "the apache 2.0 license"),
    "GPL-2.0": ("the gnu general public license version 2", "the gnu gpl v2", "gpl v2", "gplv2", "the gnu general public license v2.0"),
    "GPL-3.0": ("the gnu general public license version 3", "the gnu gpl v3", "gpl v3", "gplv3", "the gnu general public license v3.0"),
    "LGPL-2.1": ("the gnu lesser general public license version 2.1", "lgpl v2.1", "the gnu lgpl v2.1"),
    "LGPL-3.0": ("the gnu lesser general public license version 3", "lgpl v3", "the gnu lgpl v3"),
    "AGPL-3.0": ("the gnu affero general public license version 3", "agpl v3", "the gnu agpl v3"),
    "MPL-2.0": ("the mozilla public license version 2.0", "mpl 2.0", "the mozilla public license 2.0"),
    "BSD-2-Clause": ("the bsd 2 clause license", "the simplified bsd license"),
    "BSD-3-Clause": ("the bsd 3 clause license", "the new bsd license", "the bsd license"),
    "ISC": ("the isc license", "isc license"),
    "CC0-1.0": ("cc0 1.0", "the creative commons zero 1.0 license"),
} | {
    f"CC-{kind}-{version}": (f"cc {kind.replace('-', ' ').lower()} {version}", f"a creative commons {long} {version} license", f"a creative commons {long} {version} international license")
    for kind, long in (("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"), ("BY-ND", "attribution noderivatives"),
                       ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives"))
    for version in ("2.0", "2.5", "3.0", "4.0")
}
GRANTS = (
    "licensed under", "released under", "distributed under", "available under", "this work is licensed under", "this software is licensed under",
    "this software is released under", "this project is licensed under", "this file is licensed under", "this code is licensed under", "this program is licensed under",
    "this content is licensed under", "published under", "code released under", "spdx license identifier",
)
TEXTS = {
    "mit:permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit:notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis:software": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache:compliance": "you may not use this file except in compliance with the license",
    "apache:copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache:asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl:free": "this program is free software",
    "gpl:3": "either version 3 of the license or at your option any later version",
    "gpl:2": "either version 2 of the license or at your option any later version",
    "gpl:hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd:use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd:endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd:asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc:permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense:free": "this is free and unencumbered software released into the public domain",
}
# Longer sentences of real notices; the SQL text, which knows lines only, does without them.
NOTICES = {
    **{f"{grant} {name} the license": "grant:Apache-2.0" for grant in GRANTS for name in NAMES["Apache-2.0"]},
    **{f"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation {TEXTS[key]}": key
       for key in ("gpl:2", "gpl:3")},
}


@dataclass(frozen=True)
class Rule:
    """Identifiers in order that make up a licence, and a licence whose match makes this one void."""

    license: str
    sequence: tuple[str, ...]
    unless: str | None = None


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier: each grant with each name of a licence, and the sentences of licence texts."""
    granted = {f"{grant} {name}": f"grant:{license}" for license, names in NAMES.items() for name in names for grant in GRANTS}
    identifiers = {f"spdx license identifier {license.lower().replace('-', ' ')}": f"grant:{license}" for license in NAMES}
    return granted | identifiers | {sentence: key for key, sentence in TEXTS.items()}


RULES = (
    Rule("MIT", ("mit:permission", "mit:notice", "asis:software")),
    Rule("Apache-2.0", ("apache:compliance", "apache:copy", "apache:asis")),
    Rule("GPL-3.0", ("gpl:free", "gpl:3", "gpl:hope")),
    Rule("GPL-2.0", ("gpl:free", "gpl:2", "gpl:hope")),
    Rule("BSD-3-Clause", ("bsd:use", "bsd:endorse", "bsd:asis")),
    Rule("BSD-2-Clause", ("bsd:use", "bsd:asis"), unless="BSD-3-Clause"),
    Rule("ISC", ("isc:permission",)),
    Rule("Unlicense", ("unlicense:free",)),
    *(Rule(license, (f"grant:{license}",)) for license in NAMES),
)


def lines(text: Column) -> Column:
    """The normalised lines of a text; a sentence end or the end of a paragraph leaves an empty line."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_END, "\n\n")
    plain = F.lower(F.regexp_replace(cut, NOT_WORD, " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, LINE_EDGES, ""), URL_BELOW, " "), AFTER_COLON, "\n")


def sentence_pattern(known: Iterable[str]) -> str:
    """Matches known sentences that begin and end with a line, the longest first; blanks may be line breaks."""
    tree: dict = {}
    for sentence in known:
        at = tree
        for word in sentence.split(" "):
            at = at.setdefault(word, {})
        at[""] = {}

    def branch(at: dict) -> str:
        tails = []
        for word, below in at.items():
            if word:
                part = word.replace(".", "[.]")
                while len(below) == 1 and "" not in below:
                    word, below = next(iter(below.items()))
                    part += r"[ \n]" + word.replace(".", "[.]")
                tails.append(part + (f"(?:[ \\n]{branch(below)})" + "?" * ("" in below) if set(below) - {""} else ""))
        return f"(?:{'|'.join(tails)})"

    return f"(?m)^{branch(tree)}$"


def sentence_ids(text: Column, known: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = known or known_sentences() | NOTICES
    looked_up = F.create_map(*[F.lit(part) for item in known.items() for part in item])
    found = F.regexp_extract_all(lines(text), F.lit(sentence_pattern(known)), F.lit(0))
    return F.transform(found, lambda s: F.element_at(looked_up, F.translate(s, "\n", " ")))


def recognised(ids: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Licences whose rule matches the identifiers, in the order of the rules, each once."""
    line = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    found: dict[str, Column] = {}
    for rule in rules:
        pattern = " " + "( .*)? ".join(key.replace(".", "[.]") for key in rule.sequence) + " "
        match = line.rlike(pattern) if len(rule.sequence) > 1 else F.array_contains(ids, rule.sequence[0])
        if rule.unless:
            match = match & ~found[rule.unless]
        found[rule.license] = found[rule.license] | match if rule.license in found else match
    return F.filter(F.array(*[F.when(match, F.lit(license)) for license, match in found.items()]), lambda name: name.isNotNull())


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with sentence_ids and licenses (arrays; empty where nothing is known), in place of columns of these names.

    Works on each whole text by itself, without a shuffle; null and empty texts have no licence; repeated rows give repeated
    results; an empty table gives no rows.
    """
    marked = docs.withColumn("__ids", sentence_ids(F.col(text_col)))
    kept = [c for c in docs.columns if c not in ("sentence_ids", "licenses")]
    return marked.select(*kept, F.col("__ids").alias("sentence_ids"), recognised(F.col("__ids")).alias("licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").alias("n_sentences"), F.array_join("sentence_ids", " ").alias("sentence_ids"),
                        F.array_join("licenses", ",").alias("licenses")).where("n_sentences > 0")


def oracle() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in known_sentences().items())
    line = "' ' || sentence_ids || ' '"
    seen: dict[str, str] = {}
    for rule in RULES:
        like = f"regexp_matches({line}, ' " + "( .*)? ".join(key.replace(".", "[.]") for key in rule.sequence) + " ')"
        if rule.unless:
            like = f"({like}) AND NOT ({seen[rule.unless]})"
        seen[rule.license] = f"({seen[rule.license]}) OR ({like})" if rule.license in seen else like
    cases = [f"CASE WHEN {match} THEN '{name}' END" for name, match in seen.items()]
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
d AS (SELECT doc_id, string_split(lower(regexp_replace(regexp_replace(coalesce(text, ''), '{SENTENCE_END}', chr(10), 'g'), '{NOT_WORD}', ' ', 'g')), chr(10)) AS parts FROM documents),
s AS (SELECT doc_id, trim(unnest(parts), ' .') AS sentence, generate_subscripts(parts, 1) AS pos FROM d),
i AS (SELECT doc_id, count(*) AS n_sentences, string_agg(id, ' ' ORDER BY pos) AS sentence_ids FROM s JOIN known USING (sentence) GROUP BY doc_id)
SELECT doc_id, n_sentences, sentence_ids, concat_ws(',', {", ".join(cases)}) AS licenses FROM i"""


ORACLE = oracle()
