"""Filters of (original, edited) text pairs: one reason each, null for kept rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T

# Thresholds of the stored-score filter.
CONTRADICTION_BY_DIFFICULTY, CONTRADICTION_ELSE = {"easy": 0.43, "medium": 0.52, "hard": 0.58}, 0.43
SPECIAL = r"""[!@#$%^&*()_+=\[\]{}|\\:";'<>?,./]"""


def discard_reason(original: Column, edited: Column, min_chars: int = 50, max_ratio: float = 2.0) -> Column:
    """Unchanged, only white space changed, too short, ratio out of bounds, too many special characters, repeats, too few words."""
    ratio = S.length_ratio(original, edited)
    n = F.length(edited)
    special = n - F.length(F.regexp_replace(edited, SPECIAL, ""))
    return F.coalesce(
        F.when(original == edited, "identical_texts"),
        F.when(T.squeeze(original) == T.squeeze(edited), "only_whitespace_changed"),
        F.when(n < min_chars, F.concat(F.lit("too_short_"), n.cast("string"))),
        F.when(ratio > max_ratio, F.concat(F.lit("too_long_ratio_"), F.format_string("%.2f", ratio))),
        F.when(ratio < 1 / max_ratio, F.concat(F.lit("too_short_ratio_"), F.format_string("%.2f", ratio))),
        F.when(special > n * 0.1, "excessive_special_chars"),
        F.when(T.repeated_character(edited, 4), "repeated_characters"),
        F.when(F.size(T.words(edited)) < 5, "too_few_words"),
    )


def rule_filter(pairs: DataFrame, original: str = "original_text", edited: str = "text") -> DataFrame:
    return pairs.withColumn("discard_reason", discard_reason(F.col(original), F.col(edited)))


def basic_quality(original: Column, edited: Column, scores: Column, difficulty: Column, min_similarity: float = 0.45, min_fluency: float = 0.5) -> Column:
    """Whether a pair's lengths and its stored scores (JSON text, may be null) are good enough."""
    parsed = F.from_json(scores, "passed boolean, semantic_similarity double, fluency_score double, contradiction_score double")
    ratio = F.when(F.length(original) > 0, F.length(edited) / F.length(original)).otherwise(0.0)
    shape = (F.length(edited) >= 50) & (ratio >= 0.65) & (ratio <= 1.35) & (edited != original)
    least = S.lookup(difficulty, CONTRADICTION_BY_DIFFICULTY, CONTRADICTION_ELSE)
    value = lambda c: F.coalesce(parsed[c], F.lit(0.0))
    good = F.coalesce(parsed["passed"], F.lit(False)) & (value("semantic_similarity") >= min_similarity) & (value("fluency_score") >= min_fluency) & (value("contradiction_score") >= least)
    return shape & (scores.isNull() | (scores == "") | good)


def sample_issues(original: Column, edited: Column, hops: Column, planned_hops: Column, similarity: Column, fluency: Column, contradiction: Column, difficulty: Column, low: float = 0.45, high: float = 0.995, min_fluency: float = 0.5) -> Column:
    least = S.lookup(difficulty, CONTRADICTION_BY_DIFFICULTY, CONTRADICTION_ELSE)
    rules = [
        ((edited == "") | (edited == original), "identical_text"),
        (hops != planned_hops, "hop_count_mismatch"),
        (similarity < low, "semantic_similarity_too_low"),
        (similarity > high, "semantic_similarity_too_high"),
        (fluency < min_fluency, "low_fluency"),
        (contradiction < least, "weak_contradiction"),
    ]
    return F.filter(F.array(*[F.when(c, n) for c, n in rules]), lambda x: x.isNotNull())


def by_threshold(rows: DataFrame, score: str, least: float = 0.4) -> DataFrame:
    return rows.withColumn("kept", F.col(score) >= least)


def usable_numbers(values: Column) -> Column:
    return F.filter(values, lambda v: (F.abs(v) >= 1) & (F.abs(v) <= 99_999))


def three_stage(original: Column, edited: Column) -> Column:
    """struct<integrity, surface, semantic, overall>: weights .30, .35, .35; a failed integrity gate makes overall 0."""
    integrity = F.when((edited != "") & (edited != original), 1.0).otherwise(0.0)
    surface, semantic = S.heuristic_fluency(edited), S.similarity_mix(original, edited)
    total = F.when(integrity > 0, 0.30 * integrity + 0.35 * surface + 0.35 * semantic).otherwise(0.0)
    return F.struct(integrity.alias("integrity"), surface.alias("surface"), semantic.alias("semantic"), S.rounded(total).alias("overall"))
