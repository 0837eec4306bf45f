"""Quality rules by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule looks at one document and votes +1 (good), -1 (bad) or 0 (abstains).  Nothing but the counts of equal vote rows,
at most 2 ** rules of them, is needed to fit the rules' accuracies, so the driver sees a table of bounded size.  The
posterior probability of a good document is then a sum of per-vote weights in the row, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.shared import shared_table

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
CAPITALS = r"[A-ZÀ-ÖØ-Þ]"
MARKS = r"[!?]"
STOPS = r"[.,;:]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

Votes = tuple[int, ...]
Belief = tuple[dict[int, float], dict[int, float]]  # chances of a rule's votes for good and for bad documents

#: A flaw is rare among good documents, and each kind of bad document shows a few of them; most bad ones have some virtues.
FLAW: Belief = ({-1: 0.01, 0: 0.99}, {-1: 0.25, 0: 0.75})
VIRTUE: Belief = ({1: 0.95, 0: 0.05}, {1: 0.6, 0: 0.4})
BELIEFS = (FLAW,) * 8 + (VIRTUE,) * 4


def words_of(text: Column) -> Column:
    """The runs of characters outside ``[\\x20\\x09-\\x0D]``; none for a null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES, -1))


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds a struct ``__measures`` to each row: the base measures and the counts that the rules look at.

    A repeated word lies in a window of five words whose words occur again elsewhere in the text; windows are compared by
    64-bit hash within their text.  A repeated line is a line with a word that equals an earlier one.  All is row-local.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size("__words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(WINDOW)]))
    step = docs.withColumn("__words", words_of(F.col(text_col))).withColumn("__windows", windows)
    # Only texts with a window that comes twice are sorted: equal neighbours in (hash, start) order are the repeats.
    ordered = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), ordered))
    pairs = F.zip_with(
        F.slice("__sorted", 1, F.size("__sorted") - 1), F.slice("__sorted", 2, F.size("__sorted") - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    found = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    covered = F.aggregate(
        found, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    step = step.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("bigint")

    measures = F.struct(
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("__sorted").isNull(), 0).otherwise(covered).cast("bigint").alias("n_repeat_words"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        count(SYMBOLS + "{2,}").alias("n_symbol_runs"),
        count(CAPITALS).alias("n_capitals"),
        count(MARKS).alias("n_marks"),
        count(STOPS).alias("n_stops"),
    )
    # One generated row per row: a filter on the measures is not moved below, where it would work them out again per use.
    generated = step.withColumn("__measures", F.explode(F.array(measures)))
    return generated.drop("__words", "__windows", "__lines", "__sorted")


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def rule_votes(m: Column) -> dict[str, Column]:
    """Rule name to vote, in the order of ``BELIEFS``: rules for flaws vote -1 or abstain, rules for virtues +1 or abstain."""
    words, chars = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["word_chars"], F.lit(1))
    repeated = m["n_repeat_words"] / words
    flaws = {
        "few_words": m["n_words"] < MIN_WORDS,
        "symbols": m["n_symbols"] > 0.1 * words,
        "symbol_runs": m["n_symbol_runs"] > 0.05 * words,
        "capitals": m["n_capitals"] > 0.5 * chars,
        "marks": m["n_marks"] > 0.2 * words,
        "repeated_words": repeated > 0.2,
        "repeated_lines": m["n_dup_lines"] > 0.3 * m["n_lines"],
        "word_length": (chars / words < 2) | (chars / words > 12),
    }
    virtues = {
        "plain": (m["n_symbols"] <= 0.02 * words) & (m["n_marks"] <= 0.05 * words) & (m["n_words"] >= MIN_WORDS),
        "cased": (m["n_capitals"] > 0) & (m["n_capitals"] <= 0.2 * chars),
        "varied": (repeated <= 0.1) & (m["n_words"] >= MIN_WORDS),
        "sentences": (m["n_stops"] >= 0.02 * words) & (m["n_stops"] <= 0.4 * words),
    }
    votes = {name: F.when(seen, -1).otherwise(0) for name, seen in flaws.items()}
    return votes | {name: F.when(seen, 1).otherwise(0) for name, seen in virtues.items()}


@dataclass(frozen=True)
class LabelModel:
    """Prior of good documents, and per rule the log-odds for good that each vote (or abstaining) adds."""

    prior: float
    weights: tuple[dict[int, float], ...]

    def log_odds(self, votes: Votes) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(self.weights[k][v] for k, v in enumerate(votes))

    def posterior(self, votes: Votes) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.log_odds(votes)))))


def fit_label_model(counts: dict[Votes, int], beliefs: tuple[Belief, ...], rounds: int = 100, prior: float = 0.8, trust: float = 1.0) -> LabelModel:
    """Expectation-maximisation over counted vote rows, from the beliefs about each rule.

    ``beliefs`` count as ``trust`` times the rows in every round, so that a kind of bad document which only one rule sees
    is not taken for a kind of good one because it is common.  A +1 never speaks against a document and a -1 never for it,
    so good and bad cannot trade places.  Without rows the beliefs are the result.
    """
    total = sum(counts.values())

    def weights_of(chances: list[Belief]) -> tuple[dict[int, float], ...]:
        made = []
        for good, bad in chances:
            odds = {v: math.log(good[v] / bad[v]) for v in good}
            made.append({v: min(w, 0.0) if v < 0 else max(w, 0.0) if v > 0 else w for v, w in odds.items()})
        return tuple(made)

    model = LabelModel(prior, weights_of(list(beliefs)))
    for _ in range(rounds if total else 0):
        share = {votes: model.posterior(votes) for votes in counts}
        mass = sum(share[votes] * c for votes, c in counts.items())
        heavy = trust * total
        chances = []
        for k, (good, bad) in enumerate(beliefs):
            held = {v: sum(share[votes] * c for votes, c in counts.items() if votes[k] == v) for v in good}
            rest = {v: sum((1 - share[votes]) * c for votes, c in counts.items() if votes[k] == v) for v in bad}
            chances.append(({v: (held[v] + heavy * good[v]) / (mass + heavy) for v in good},
                            {v: (rest[v] + heavy * bad[v]) / (total - mass + heavy) for v in bad}))
        model = LabelModel((mass + heavy * prior) / (total + heavy), weights_of(chances))
    return model


def vote_counts(measured: DataFrame) -> dict[Votes, int]:
    """How many rows have each vote row; combined before the shuffle, at most 2 ** rules rows reach the driver."""
    votes = rule_votes(F.col("__measures"))
    rows = measured.select(*[v.cast("int").alias(name) for name, v in votes.items()]).groupBy(*votes).count().collect()
    return {tuple(r[name] for name in votes): r["count"] for r in rows}


def fit(measured: DataFrame) -> LabelModel:
    return fit_label_model(vote_counts(measured), BELIEFS)


def posterior(model: LabelModel, m: Column) -> Column:
    """Probability that a row is good, as an expression over its measures."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for weights, vote in zip(model.weights, rule_votes(m).values(), strict=True):
        voted = 1 if 1 in weights else -1
        odds = odds + F.when(vote == voted, weights[voted]).otherwise(weights[0])
    return 1 / (1 + F.exp(-odds))


def with_verdict(measured: DataFrame, model: LabelModel, columns: list[str]) -> DataFrame:
    """The named columns, the base measures, base_failed, probability and kept."""
    m = F.col("__measures")
    failed, chance = base_failed(m), posterior(model, m)
    base = [m[c].alias(c) for c in BASE]
    rest = [F.col(c) for c in columns if c not in (*BASE, "base_failed", "probability", "kept")]
    return measured.select(*rest, *base, failed.alias("base_failed"), chance.alias("probability"), (~failed & (chance >= 0.5)).alias("kept"))


def quality_scores(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with the base measures, base_failed, probability and kept; reads each text once.

    ``kept`` is false where the base rule fails (fewer than ten words, or over a fifth of the words repeated), else whether
    the probability of a good document is at least one half.  The rules are weighed on all rows.  A null or empty text has
    no words and fails the base rule; repeated rows count as often as they come; an empty table gives no rows.  Result
    columns replace columns of the same name.
    """
    measured = shared_table(with_measures(docs, text_col).drop(text_col), "quality")
    return with_verdict(measured, fit(measured), [c for c in docs.columns if c != text_col])


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_scores`` keeps, unchanged.  Reads each text twice, but moves none."""
    measured = with_measures(docs, text_col)
    model, m = fit(measured), F.col("__measures")
    return measured.where(~base_failed(m) & (posterior(model, m) >= 0.5)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
