"""Word lists and text tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English function words left out of value and name matching.
STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
    himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
    that that'll these those am is are was were be been being have has had having do does did doing a an the and but if
    or because as until while of at by for with about against between into through during before after above below to
    from up down in out on off over under again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can will just don don't should should've now
    d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn
    isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won
    won't wouldn wouldn't
    """.split()
)
# Words that carry no schema meaning in lexical ranking, and in question linking.
NAME_STOPWORDS = ("a", "an", "and", "are", "as", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with")
QUESTION_STOPWORDS = (*NAME_STOPWORDS, "what", "which", "who", "when", "where", "how", "many", "much", "show", "list", "give")
COMMON_WORDS = ("no", "yes", "many")  # fixed values: too common to match unless exactly equal
COMMON_TERMS = ("id",)  # fixed value: a name that never identifies a value


def word_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def plain_tokens(text: Column) -> Column:
    """Distinct lower-case letter/digit runs."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def name_tokens(text: Column, stopwords=(), abbreviations: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Tokens of a name or question: camel case split, singular forms added, abbreviations expanded."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "_", " ")
    words = F.transform(F.regexp_extract_all(spaced, F.lit("[A-Za-z0-9]+"), 0), F.lower)
    stops = word_array(stopwords)
    kept = F.filter(words, lambda t: ~F.array_contains(stops, t))
    plural = F.filter(kept, lambda t: (F.length(t) > 3) & t.endswith("s"))
    singular = F.transform(plural, lambda t: F.substring(t, F.lit(1), F.length(t) - 1))
    both = F.array_distinct(F.concat(kept, F.filter(singular, lambda t: ~F.array_contains(stops, t))))
    if not abbreviations:
        return both
    table = F.create_map(*[x for k, v in abbreviations.items() for x in (F.lit(k), word_array(v))])
    more = F.flatten(F.transform(both, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(both, more))


def words(text: Column) -> Column:
    """Whitespace-separated lower-case words, with repeats."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all whitespace tokens; 0 when both texts are empty."""
    left = F.array_distinct(F.filter(F.split(a, r"\s+"), lambda t: t != ""))
    right = F.array_distinct(F.filter(F.split(b, r"\s+"), lambda t: t != ""))
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 − edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)
