"""Scores of claims, texts and pairs.  Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .lexicon import Lexicon

# Weights of the ranking.
EDITABILITY = {"numerical": 0.94, "causal": 0.88, "entity": 0.82, "temporal": 0.76, "policy": 0.72}
BONUS = {"numerical": 0.08, "causal": 0.06, "entity": 0.04, "temporal": 0.02, "policy": 0.0}
MIN_CONFIDENCE, MIN_CHARS, MAX_SENTENCES = 0.35, 18, 80
MIN_OVERALL, MAX_RISK = 0.52, 0.72


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rounded(c: Column, places: int = 4) -> Column:
    """Half up, with so much slack that sums of decimals round as they read."""
    return F.round(c + 1e-9, places)


def claim_type(sentence: Column, n_entities: Column, n_numbers: Column, n_policies: Column, n_dates: Column, lexicon: Lexicon) -> Column:
    temporal, financial = T.is_temporal(sentence, lexicon), T.contains_any(sentence, lexicon.financial)
    return (
        F.when((n_numbers > 0) & ~(temporal & ~financial), "numerical")
        .when(T.contains_any(sentence, lexicon.causal), "causal")
        .when(n_entities > 0, "entity")
        .when((n_dates > 0) | temporal, "temporal")
        .when(n_policies > 0, "policy")
        .otherwise("other")
    )


def confidence(index: Column, sentence: Column, n_entities: Column, n_numbers: Column, n_policies: Column, n_dates: Column, n_words: Column, lexicon: Lexicon) -> Column:
    return clamp(
        F.lit(0.10)
        + F.greatest(F.lit(0.0), 0.22 - 0.025 * F.least(index, F.lit(8)))
        + F.when(T.contains_any(sentence, lexicon.financial), 0.18).otherwise(0.0)
        + F.least(F.lit(0.18), 0.06 * n_entities)
        + F.least(F.lit(0.18), 0.06 * n_numbers)
        + F.least(F.lit(0.16), 0.08 * n_policies)
        + F.least(F.lit(0.12), 0.06 * n_dates)
        + F.when(T.contains_any(sentence, lexicon.causal), 0.08).otherwise(0.0)
        - F.when(n_words < 5, 0.18).otherwise(0.0)
        - F.when(n_words > 80, 0.08).otherwise(0.0)
    )


def importance(confidence: Column, index: Column, headline: Column, sentence: Column, lexicon: Lexicon) -> Column:
    head = F.array_distinct(T.words(headline))
    shared = F.size(F.array_intersect(head, T.words(sentence)))
    return clamp(
        confidence * 0.45
        + F.greatest(F.lit(0.0), 0.28 - 0.03 * F.least(index, F.lit(8)))
        + F.when(F.size(head) > 0, F.least(F.lit(0.18), shared / F.size(head))).otherwise(0.0)
        + F.when(T.contains_any(sentence, lexicon.financial), 0.09).otherwise(0.0)
    )


def editability(kind: Column, n_entities: Column, n_numbers: Column, n_policies: Column) -> Column:
    missing = F.when((kind == "entity") & (n_entities < 1), 0.20).when((kind == "numerical") & (n_numbers < 1), 0.25).when((kind == "policy") & (n_policies < 1), 0.25)
    return clamp(lookup(kind, EDITABILITY, 0.45) - missing.otherwise(0.0))


def feasibility(kind: Column, anchors: Column) -> Column:
    extra = F.when(kind.isin("numerical", "policy", "temporal"), 0.15).when(kind == "causal", 0.08).otherwise(0.0)
    return clamp(0.35 + F.least(F.lit(0.45), 0.10 * anchors) + extra)


def locality(n_words: Column, n_commas: Column) -> Column:
    long = F.when(n_words > 45, 0.18).otherwise(0.0) + F.when(n_words > 75, 0.22).otherwise(0.0)
    return clamp(0.92 - long - F.least(F.lit(0.20), 0.04 * F.greatest(F.lit(0), n_commas - 2)))


def risk(n_numbers: Column, n_entities: Column, n_words: Column, quoted: Column) -> Column:
    return clamp(
        0.12
        + F.least(F.lit(0.35), 0.08 * F.greatest(F.lit(0), n_numbers - 2))
        + F.least(F.lit(0.25), 0.06 * F.greatest(F.lit(0), n_entities - 3))
        + F.when(n_words > 90, 0.20).otherwise(0.0)
        + F.when(quoted, 0.15).otherwise(0.0)
    )


def overall(kind: Column, importance: Column, editability: Column, locality: Column, feasibility: Column, risk: Column, max_risk: float = MAX_RISK) -> Column:
    total = 0.35 * importance + 0.25 * editability + 0.20 * locality + 0.20 * feasibility + lookup(kind, BONUS, 0.0)
    return clamp(F.when(risk > max_risk, total * 0.70).otherwise(total))


def length_ratio(original: Column, edited: Column) -> Column:
    """Characters of the edited text over the original's; infinite for an empty original."""
    return F.coalesce(F.try_divide(F.length(edited), F.length(original)), F.lit(float("inf")))


def fluency_from_perplexity(perplexity: Column, most: float = 220.0) -> Column:
    return rounded(clamp(1.0 - perplexity / max(most * 1.5, 1.0)))


def heuristic_fluency(c: Column) -> Column:
    """1 less penalties for short texts, special characters, repeats and unbalanced brackets."""
    n = F.length(c)
    special = F.length(F.regexp_replace(c, rf"[\p{{L}}\p{{M}}\p{{N}}_\x{{980}}-\x{{9FF}}।]|{T.SPACE}", ""))
    opened, closed = (n - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in "()")
    return rounded(
        clamp(
            1.0
            - F.when(F.size(T.words(c)) < 5, 0.45).otherwise(0.0)
            - F.when(n < 40, 0.25).otherwise(0.0)
            - F.when(n > 0, F.least(F.lit(0.35), special / n * 1.8)).otherwise(0.0)
            - F.when(T.repeated_character(c, 4), 0.25).otherwise(0.0)
            - F.when(c.rlike(f"{T.SPACE}{{3,}}"), 0.10).otherwise(0.0)
            - F.when(opened != closed, 0.05).otherwise(0.0)
        )
    )


def difficulty(family: Column, confidence: Column) -> Column:
    score = confidence - F.when(family == "causal_inversion", 0.05).otherwise(0.0)
    return F.when(score >= 0.85, "easy").when(score >= 0.72, "medium").when(score >= 0.58, "hard").otherwise("very_hard")


def similarity_mix(a: Column, b: Column) -> Column:
    """0.4 of the bigrams' Jaccard and 0.6 of the words'."""
    return rounded(0.4 * T.jaccard(T.ngrams(a, 2), T.ngrams(b, 2)) + 0.6 * T.jaccard(F.array_distinct(T.words(a)), F.array_distinct(T.words(b))))


def contradiction_proxy(weights: Column, confidences: Column, strong: Column, temporal: Column, nli: Column | None = None) -> Column:
    """From arrays of the outcomes' family weights and confidences; blended with a model's score if there is one."""
    n = F.size(weights)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    score = 0.16 + 0.48 * mean(weights) + 0.22 * mean(confidences) + 0.06 * F.greatest(F.lit(0), n - 1)
    score = score + F.when(strong, 0.05).otherwise(0.0) + F.when(temporal, 0.02).otherwise(0.0)
    if nli is not None:
        score = F.when(nli.isNotNull(), 0.55 * score + 0.45 * nli).otherwise(score)
    return F.when(n > 0, rounded(clamp(score, 0.0, 0.99))).otherwise(0.0)
