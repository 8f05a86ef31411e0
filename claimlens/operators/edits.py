"""Edit plans and their deterministic application.

Plans come from outside or from the heuristic planner, which names a target
but never proposes a replacement.  Every edited row keeps ``label``,
``edit_family`` and ``original_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Lexicon
from .verify import plan_facts

# The edit family of each claim type.
FAMILY = {"numerical": "numerical_fact", "causal": "causal_inversion", "entity": "entity_replacement", "temporal": "temporal_shift", "policy": "policy_reversal"}


def heuristic_plan(claims: DataFrame) -> DataFrame:
    """The claims with family, target_span (their first anchor) and an empty replacement."""
    kind = F.col("claim_type")
    family = F.lit(None).cast("string")
    for k, v in FAMILY.items():
        family = F.when(kind == k, v).otherwise(family)
    first = lambda c: F.get(F.col(c), F.lit(0))
    anchor = F.when(kind == "numerical", first("numbers")).when(kind == "entity", first("entities")).when(kind == "temporal", F.coalesce(first("dates"), first("numbers"))).when(kind == "policy", first("policies"))
    return claims.withColumns({"family": family, "target_span": F.coalesce(anchor, F.lit("")), "replacement": F.lit("")})


def plan_error(sentence: Column, family: Column, target: Column, replacement: Column, n_entities: Column, n_policies: Column, n_dates: Column, lexicon: Lexicon, facts: dict[str, Column] | None = None) -> Column:
    """The first rule that a plan breaks, null if it is valid."""
    sized = F.size(T.scaled_values(sentence, lexicon)) > 0
    has, given = F.length(T.strip(target)) > 0, F.length(T.strip(replacement)) > 0
    facts = facts or plan_facts(target, replacement, lexicon)
    t_values, r_values, counted, mismatch = (facts[k] for k in ("t_values", "r_values", "counted", "mismatch"))
    number, policy, entity, temporal, causal = (family == f for f in ("numerical_fact", "policy_reversal", "entity_replacement", "temporal_shift", "causal_inversion"))
    words = [w for terms in lexicon.policy_directions.values() for w in terms]
    return F.coalesce(
        F.when(has & ~T.occurs_as_term(sentence, target, lexicon), "target_span_not_in_claim"),
        F.when(given & has & (T.strip(replacement) == T.strip(target)), "replacement_equals_target"),
        F.when(number & ~sized, "numeric_claim_required"),
        F.when(number & T.is_temporal(target, lexicon), "numeric_target_is_temporal"),
        F.when(number & given & (F.size(r_values) == 0), "numeric_replacement_required"),
        F.when(number & given & mismatch.isNotNull(), mismatch),
        F.when(number & given & ~counted & (F.size(t_values) > 0) & (t_values == r_values), "numeric_replacement_equivalent"),
        F.when(number & given & ~counted & ~T.significant_scale_change(t_values, r_values), "numeric_change_not_significant"),
        F.when(policy & ~((n_policies > 0) | T.contains_any(sentence, words)), "policy_claim_required"),
        F.when(entity & (n_entities < 1), "entity_required"),
        F.when(entity & given & T.same_role(target, replacement, lexicon), "entity_same_role"),
        F.when(temporal & ~((n_dates > 0) | sized), "temporal_anchor_required"),
        F.when(causal & ~T.contains_any(sentence, lexicon.causal), "causal_claim_required"),
    )


def check_plans(plans: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds plan_error to claims with family, target_span and replacement."""
    found = plan_facts(F.col("target_span"), F.col("replacement"), lexicon)
    rows = plans.withColumns({f"_{k}": c for k, c in found.items()})
    sizes = [F.size(F.col(c)) for c in ("entities", "policies", "dates")]
    error = plan_error(F.col("sentence"), F.col("family"), F.col("target_span"), F.col("replacement"), *sizes, lexicon, {k: F.col(f"_{k}") for k in found})
    return rows.withColumn("plan_error", error).drop(*(f"_{k}" for k in found))


def executable_error(spans: Column, index: Column, target: Column, replacement: Column, entities: Column) -> Column:
    """Why a plan can't be carried out on an article, null if it can."""
    t, r = T.strip(target), T.strip(replacement)
    sentence = T.target_sentence(spans, index)
    near = F.exists(entities, lambda e: F.contains(e, t) | F.contains(t, e))
    return F.coalesce(
        F.when(t == "", "plan_missing_target_span"),
        F.when((r != "") & (t == r), "plan_target_equals_replacement"),
        F.when(index >= F.size(spans), "target_sentence_index_out_of_range"),
        F.when(~(F.contains(sentence, t) | F.contains(T.normalize_digits(sentence), T.normalize_digits(t)) | near), "target_span_not_in_sentence"),
    )


def apply_plan(articles: DataFrame, lexicon: Lexicon, text: str = "text", headline: str = "headline") -> DataFrame:
    """Planned edits: the plan's columns idx, family, target_span, replacement stand beside the article's.

    Entity plans replace every mention in the text; others replace the first
    occurrence in the target sentence, which is spliced back (that eats white
    space before it, as offsets cover the whole match).  The headline follows.
    Adds rewritten, rewritten_headline, edit_error.
    """
    t, r, body = F.col("target_span"), F.col("replacement"), F.col(text)
    rows = articles.withColumn("_spans", T.sentence_spans(body, lexicon))
    span = F.get(F.col("_spans"), F.col("idx"))
    local = T.splice(body, span["start"], span["end"], T.ensure_terminator(span["text"], T.replace_first(span["text"], t, r), lexicon))
    entity = F.col("family") == "entity_replacement"
    error = F.coalesce(
        F.when(F.length(T.strip(t)) == 0, "target_missing"),
        F.when(F.length(T.strip(r)) == 0, "replacement_missing"),
        F.when(span.isNull(), "sentence_missing"),
        F.when(~F.contains(span["text"], t), "target_not_literal"),
    )
    head = F.col(headline)
    return rows.withColumns(
        {
            "edit_error": error,
            "rewritten": F.when(error.isNull(), F.when(entity, T.replace_all(body, t, r)).otherwise(local)),
            "rewritten_headline": F.when(error.isNull(), F.when(entity, T.replace_all(head, t, r)).otherwise(T.replace_first(head, t, r))),
        }
    ).drop("_spans")


def localize(articles: DataFrame, answer: str, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Put a model's answer for sentence idx back into the article: adds rewritten and localize_error.

    Of several sentences in an answer, the one that holds the plan's
    replacement counts, if it is the only one; without a replacement the first.
    """
    body = F.col(text)
    clean = T.clean_output(F.col(answer))
    rows = articles.withColumns({"_spans": T.sentence_spans(body, lexicon), "_given": T.sentence_spans(clean, lexicon)})
    given, r = F.col("_given"), T.strip(F.coalesce(F.col("replacement"), F.lit("")))
    holding = F.filter(given, lambda s: F.contains(s["text"], r))
    digits = F.filter(given, lambda s: F.contains(T.normalize_digits(s["text"]), T.normalize_digits(r)))
    one = lambda a: F.get(a, F.lit(0))["text"]
    chosen = F.when((F.size(given) <= 1) | (r == ""), one(given)).when(F.size(holding) == 1, one(holding)).when((F.size(holding) == 0) & (F.size(digits) == 1), one(digits))
    span = F.get(F.col("_spans"), F.col("idx"))
    error = F.coalesce(
        F.when(span.isNull(), "sentence_missing"), F.when(F.size(T.artifacts(clean, lexicon)) > 0, "artifact_in_answer"), F.when(F.size(given) == 0, "answer_empty"), F.when(chosen.isNull(), "answer_ambiguous")
    )
    whole = T.splice(body, span["start"], span["end"], T.ensure_terminator(span["text"], chosen, lexicon))
    return rows.withColumns({"localize_error": error, "rewritten": F.when(error.isNull(), whole)}).drop("_spans", "_given")


def format_like(original: Column, value: Column) -> Column:
    """A number written as the original is: its digits' script, its percent sign, one decimal if it has any."""
    decimal = T.normalize_digits(original).rlike("[0-9][.,][0-9]")
    plain = F.when(decimal, F.format_string("%.1f", value)).otherwise(F.format_string("%d", F.round(value).cast("long")))
    written = F.when(original.rlike("[০-৯]"), T.bangla_digits(plain)).otherwise(plain)
    return F.concat(written, F.when(original.contains("%"), "%").otherwise(""))


# Constraints that every plan carries, and those that a prompt shows.
FORCED = ("preserve_all_other_sentences", "preserve_unrelated_facts", "forbid_new_entities_outside_target", "forbid_new_numbers_outside_target", "forbid_new_dates_outside_target")
SHOWN = ("preserve_all_other_sentences", "forbid_new_entities_outside_target", "forbid_new_numbers_outside_target", "forbid_new_dates_outside_target")


def merged_constraints(given: Column, index: Column) -> Column:
    """A plan's constraints, a map of strings; the forced ones and the target's index win over the model's."""
    forced = F.create_map(F.lit("target_sentence_index"), index.cast("string"), *[x for k in FORCED for x in (F.lit(k), F.lit("true"))])
    own = F.coalesce(given, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(own, lambda k, v: ~k.isin("target_sentence_index", *FORCED)), forced)


def compact_constraints(constraints: Column) -> Column:
    """The constraints that a prompt shows."""
    return F.map_filter(constraints, lambda k, v: k.isin(*SHOWN))
