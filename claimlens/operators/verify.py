"""Verifiers of (article, edited article) pairs.

Each returns struct<name, score, passed, reason, details>; ``battery`` puts
them into one array and a report.  Model-based ones take a score column that
an adapter has filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions.lexicon import Lexicon

RESULT = "struct<name:string,score:double,passed:boolean,reason:string,details:string>"


def plan_facts(target: Column, replacement: Column, lexicon: Lexicon) -> dict[str, Column]:
    """What several rules ask about a plan's spans: worth a projection of its own, so that it is computed once."""
    t, r = T.strip(target), T.strip(replacement)
    return {
        "t_values": T.scaled_values(t, lexicon),
        "r_values": T.scaled_values(r, lexicon),
        "mismatch": T.unit_mismatch(t, r, lexicon),
        "counted": (r != "") & T.significant_count_change(t, r, lexicon),
    }


def pair_facts(original: Column, edited: Column, target: Column, replacement: Column, lexicon: Lexicon) -> dict[str, Column]:
    t, r = T.strip(target), T.strip(replacement)
    return {
        **plan_facts(target, replacement, lexicon),
        "a_values": T.scaled_values(original, lexicon),
        "b_values": T.scaled_values(edited, lexicon),
        "there": F.contains(edited, r) | T.occurs_as_term(edited, r, lexicon),
        "gone": ~F.contains(edited, t) & ~T.occurs_as_term(edited, t, lexicon),
    }


def verdict(name: str, score: Column, passed: Column, reason: Column, details: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("name"), S.rounded(score).alias("score"), passed.alias("passed"), F.when(passed, "passed").otherwise(reason).alias("reason"), (F.lit(None).cast("string") if details is None else details).alias("details")
    )


def locality(original: Column, edited: Column, index: Column, family: Column, target: Column, replacement: Column, changed: Column | None = None) -> Column:
    """Only the target sentence may change; linked mentions may too if an entity was replaced in them and nothing else.

    original, edited: span arrays.
    """
    changed = T.changed_indices(original, edited) if changed is None else changed
    others = F.filter(changed, lambda i: i != index)
    t, r = T.strip(target), T.strip(replacement)
    literal = F.forall(changed, lambda i: F.replace(F.get(original, i)["text"], t, r) == F.get(edited, i)["text"])
    linked = (family == "entity_replacement") & (F.size(others) > 0) & (t != "") & (r != "") & (F.size(original) == F.size(edited)) & F.coalesce(literal, F.lit(False))
    hit = F.array_contains(changed, index)
    passed = F.when(linked, hit).otherwise((F.size(changed) > 0) & (F.size(others) == 0) & hit)
    score = F.when(passed, 1.0).when(linked, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.35 * F.size(others)))
    reason = F.when(linked, "target_sentence_unchanged").otherwise(F.concat(F.lit("unexpected_sentence_changes:["), F.array_join(others.cast("array<string>"), ", "), F.lit("]")))
    return verdict("locality", score, passed, reason, F.to_json(F.struct(changed.alias("changed_indices"))))


def text_artifacts(original: Column, edited: Column, whole: Column, family: Column, lexicon: Lexicon) -> Column:
    """original, edited: the target sentences; whole: the edited text."""
    ratio = F.try_divide(F.length(edited), F.greatest(F.length(original), F.lit(1)))
    both = (original != "") & (edited != "")
    shift = both & (family != "causal_inversion") & ((ratio < 0.75) | (ratio > 1.25))
    more = F.filter(F.array(F.when(shift, "target_sentence_length_shift"), F.when(~both, "target_sentence_missing")), lambda x: x.isNotNull())
    reasons = F.concat(T.artifacts(F.when(edited != "", edited).otherwise(whole), lexicon), more)
    passed = F.size(reasons) == 0
    return verdict("text_quality_artifacts", F.when(passed, 1.0).otherwise(0.0), passed, F.array_join(reasons, ","), F.to_json(F.struct(S.rounded(F.when(both, ratio).otherwise(0.0)).alias("target_length_ratio"))))


def semantic_similarity(a: Column, b: Column, least: float = 0.74) -> Column:
    near = F.coalesce(T.cosine(a, b), F.lit(0.0))
    return verdict("semantic_similarity", near, near >= least, F.lit("semantic_similarity_below_threshold"))


def contradiction(edited: Column, family: Column, target: Column, replacement: Column, lexicon: Lexicon, nli: Column, least: float = 0.55, facts: dict[str, Column] | None = None) -> Column:
    """Deterministic for numbers, dates and entities that were literally exchanged, else by the model's score."""
    t, r = T.strip(target), T.strip(replacement)
    given = (t != "") & (r != "")
    facts = facts or pair_facts(edited, edited, target, replacement, lexicon)
    there, gone = facts["there"], facts["gone"]
    far = T.significant_scale_change(facts["t_values"], facts["r_values"]) | facts["counted"]
    number = (family == "numerical_fact") & facts["mismatch"].isNull() & far & there & ~F.contains(edited, t)
    date = (family == "temporal_shift") & T.is_temporal(t, lexicon) & T.is_temporal(r, lexicon) & there & gone
    entity = (family == "entity_replacement") & there & gone
    rule = F.when(edited == "", None).when(given & number, "deterministic_numeric_scale_contradiction").when(given & date, "deterministic_temporal_shift_contradiction").when(given & entity, "deterministic_entity_contradiction")
    missing = edited == ""
    score = F.when(missing, 0.0).when(rule.isNotNull(), 1.0).otherwise(nli)
    passed = F.when(missing, False).otherwise(rule.isNotNull() | (nli >= least))
    reason = F.when(missing, "target_sentence_missing").otherwise("nli_contradiction_below_threshold")
    return verdict("contradiction", score, passed, reason, F.to_json(F.struct(rule.alias("rule"), S.rounded(nli).alias("nli_score"))))


def fluency(perplexity: Column, most: float = 220.0) -> Column:
    return verdict("fluency", S.fluency_from_perplexity(perplexity, most), perplexity <= most, F.lit("perplexity_above_threshold"))


def style_issues(original: Column, edited: Column, headline: Column, lexicon: Lexicon) -> Column:
    """array<struct<issue, cost>> of what departs from the original's form."""
    paragraphs = lambda c: F.size(F.filter(F.split(c, "\n"), lambda p: T.strip(p) != ""))
    marks = lambda c: F.length(c) - F.length(F.regexp_replace(c, f"[{lexicon.terminators}]", ""))
    head = F.array_distinct(T.words(headline))
    low = F.lower(edited)
    rules = [
        ((paragraphs(original) > 0) & (F.abs(paragraphs(edited) - paragraphs(original)) > 1), "paragraph_structure_shift", 0.20),
        (marks(edited) < F.greatest(F.lit(1), F.floor(marks(original) / 2)), "punctuation_structure_shift", 0.20),
        (T.repeated_character(edited, 5), "repeated_character_artifact", 0.15),
        (low.contains("click") | low.contains("subscribe") | low.contains("breaking!!!"), "non_news_register", 0.25),
        ((F.size(head) > 0) & (F.size(F.array_intersect(head, T.words(edited))) == 0), "headline_topic_drift", 0.20),
    ]
    return F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("issue"), F.lit(x).alias("cost"))) for c, n, x in rules]), lambda s: s.isNotNull())


def style(original: Column, edited: Column, headline: Column, lexicon: Lexicon, least: float = 0.72) -> Column:
    issues = style_issues(original, edited, headline, lexicon)
    score = S.clamp(1.0 - F.aggregate(issues, F.lit(0.0), lambda s, x: s + x["cost"]))
    return verdict("journalistic_style", score, score >= least, F.array_join(F.transform(issues, lambda x: x["issue"]), ","))


def outside(spans: Column, index: Column) -> Column:
    """All sentences but one, joined by spaces."""
    return F.array_join(F.transform(F.filter(spans, lambda s: s["idx"] != index), lambda s: s["text"]), " ")


def new_items(original: Column, edited: Column, lexicon: Lexicon) -> Column:
    """struct<entities, numbers, dates> that the edited text has and the original lacks, sorted."""
    fresh = lambda f: F.sort_array(F.array_except(f(edited), f(original)))
    return F.struct(fresh(lambda c: T.entities(c, lexicon)).alias("entities"), fresh(T.numbers).alias("numbers"), fresh(lambda c: T.dates(c, lexicon)).alias("dates"))


def hallucination(original: Column, edited: Column, family: Column, target: Column, replacement: Column, lexicon: Lexicon, items: Column | None = None) -> Column:
    """original, edited: the texts outside the target sentence.  Entities weigh twice, as entities and as organisations."""
    items = new_items(original, edited, lexicon) if items is None else items
    t, r = target, replacement
    own = lambda e: F.contains(r, e) | F.contains(e, r) | F.contains(t, e) | F.contains(e, t)
    names = F.when((family == "entity_replacement") & (r != ""), F.filter(items["entities"], lambda e: ~own(e))).otherwise(items["entities"])
    n = 2 * F.size(names) + F.size(items["numbers"]) + F.size(items["dates"])
    return verdict("hallucination", F.greatest(F.lit(0.0), 1.0 - 0.15 * n), n == 0, F.lit("new_facts_outside_target"), F.to_json(items))


def intended_change(original: Column, edited: Column, family: Column, target: Column, replacement: Column, lexicon: Lexicon, facts: dict[str, Column] | None = None) -> Column:
    """Whether the target sentence changed as its family demands."""
    t, r = T.strip(target), T.strip(replacement)
    given = r != ""
    facts = facts or pair_facts(original, edited, target, replacement, lexicon)
    a, b, w, counted, mismatch = (facts[k] for k in ("a_values", "b_values", "r_values", "counted", "mismatch"))
    far = F.when(given, T.significant_scale_change(facts["t_values"], w)).otherwise(T.significant_scale_change(a, b))
    row = lambda score, reason: F.struct(F.lit(score).alias("score"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    ok = row(1.0, "passed")
    number = (
        F.when((F.size(a) == 0) | (F.size(b) == 0), row(0.0, "numeric_values_missing"))
        .when((F.size(w) > 0) & ~F.arrays_overlap(w, b), row(0.25, "planned_numeric_replacement_missing"))
        .when(given & mismatch.isNotNull(), row(0.25, mismatch))
        .when((a == b) & ~counted, row(0.0, "numeric_value_unchanged"))
        .when(~counted & ~far, row(0.35, "numeric_scale_change_too_weak"))
        .otherwise(ok)
    )
    pa, pb = (T.directions(c, lexicon.policy_directions) for c in (original, edited))
    policy = (
        F.when(given & facts["there"], ok)
        .when((pa != "") & (pb != "") & (pa != pb), ok)
        .when((F.size(a) > 0) & (F.size(b) > 0) & (a != b), row(0.85, "passed"))
        .otherwise(row(0.25, "policy_direction_not_reversed"))
    )
    entity = (
        F.when(given & T.same_role(t, r, lexicon), row(0.25, "entity_same_role_replacement"))
        .when(given & ~F.contains(edited, r), row(0.0, "planned_entity_replacement_missing"))
        .when((t != "") & F.contains(edited, t), row(0.25, "original_entity_still_present"))
        .when(given & (r != t), ok)
        .when(F.sort_array(F.array_distinct(T.entities(original, lexicon))) != F.sort_array(F.array_distinct(T.entities(edited, lexicon))), ok)
        .otherwise(row(0.0, "entity_unchanged"))
    )
    days = lambda c: F.sort_array(F.array_distinct(T.dates(c, lexicon)))
    temporal = (
        F.when(given & ~F.contains(edited, r), row(0.25, "planned_temporal_replacement_missing"))
        .when((t != "") & F.contains(edited, t), row(0.25, "temporal_anchor_unchanged"))
        .when((days(original) != days(edited)) | (a != b), ok)
        .otherwise(row(0.0, "temporal_anchor_unchanged"))
    )
    ea, eb = (T.directions(T.effect_clause(c, lexicon), lexicon.effect_directions) for c in (original, edited))
    causal = (
        F.when(~T.contains_any(edited, lexicon.causal), row(0.0, "causal_marker_missing"))
        .when((ea != "") & (eb != "") & (ea != eb), ok)
        .when(given & F.contains(edited, r), row(0.7, "passed"))
        .otherwise(row(0.25, "causal_effect_not_inverted"))
    )
    other = F.when(given & F.contains(edited, r), ok).otherwise(row(0.5, "passed"))
    found = F.when(T.strip(original) == T.strip(edited), row(0.0, "target_unchanged"))
    for name, rule in (("numerical_fact", number), ("policy_reversal", policy), ("entity_replacement", entity), ("temporal_shift", temporal), ("causal_inversion", causal)):
        found = found.when(family == name, rule)
    found = found.otherwise(other)
    return verdict("intended_change", found["score"], found["reason"] == "passed", found["reason"])


def duplicate(max_seen: Column, most: float = 0.985) -> Column:
    """By the highest similarity to any earlier accepted text (``dedup.earlier_similarity``); 0 if there is none."""
    seen = F.coalesce(max_seen, F.lit(0.0))
    score = F.greatest(F.lit(0.0), 1.0 - seen)
    return verdict("duplicate_detection", score, seen < most, F.lit("near_duplicate_in_corpus"), F.to_json(F.struct(S.rounded(seen).alias("max_seen_similarity"))))


def length_ratio(original: Column, edited: Column, least: float = 0.6, most: float = 1.4) -> Column:
    """What stands in for the battery where no verifier could be built."""
    ratio = S.length_ratio(original, edited)
    return verdict("length_ratio", F.when(ratio.between(least, most), 1.0).otherwise(0.0), ratio.between(least, most), F.lit("length_ratio_out_of_range"))


def battery(results: list[Column]) -> Column:
    """struct<passed, results, scores, reasons>: all verifiers' results; nothing is cut short."""
    return report(F.array(*[r.cast(RESULT) for r in results]))


def report(every: Column) -> Column:
    """The battery's struct of an array of results."""
    return F.struct(
        F.forall(every, lambda r: r["passed"]).alias("passed"),
        every.alias("results"),
        F.map_from_entries(F.transform(every, lambda r: F.struct(r["name"], r["score"]))).alias("scores"),
        F.transform(F.filter(every, lambda r: ~r["passed"]), lambda r: r["reason"]).alias("reasons"),
    )


def verify_pairs(pairs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds ``report`` to rows with text, rewritten, headline, idx, family, target_span, replacement, nli, perplexity.

    Embedding columns ``vector`` and ``rewritten_vector``, and ``max_seen``, the highest
    similarity to earlier accepted texts, are judged too if they are there.
    """
    rows = pairs.withColumns({"_a": T.sentence_spans(F.col("text"), lexicon), "_b": T.sentence_spans(F.coalesce("rewritten", F.lit("")), lexicon)})
    i, f, t, r = (F.col(c) for c in ("idx", "family", "target_span", "replacement"))
    # what several rules ask about is a projection of its own: an expression would be evaluated at every place that names it
    rows = rows.withColumns({"_x": T.target_sentence(F.col("_a"), i), "_y": T.target_sentence(F.col("_b"), i), "_ra": outside(F.col("_a"), i), "_rb": outside(F.col("_b"), i), "_changed": T.changed_indices(F.col("_a"), F.col("_b"))})
    x, y = F.col("_x"), F.col("_y")
    found = pair_facts(x, y, t, r, lexicon)
    rows = rows.withColumns({**{f"_{k}": c for k, c in found.items()}, "_items": new_items(F.col("_ra"), F.col("_rb"), lexicon)})
    facts = {k: F.col(f"_{k}") for k in found}
    results = [
        intended_change(x, y, f, t, r, lexicon, facts),
        locality(F.col("_a"), F.col("_b"), i, f, t, r, F.col("_changed")),
        text_artifacts(x, y, F.col("rewritten"), f, lexicon),
        contradiction(y, f, t, r, lexicon, F.col("nli"), facts=facts),
        fluency(F.col("perplexity")),
        style(F.col("text"), F.col("rewritten"), F.col("headline"), lexicon),
        hallucination(F.col("_ra"), F.col("_rb"), f, t, r, lexicon, F.col("_items")),
    ]
    if "vector" in pairs.columns and "rewritten_vector" in pairs.columns:
        results.append(semantic_similarity(F.col("vector"), F.col("rewritten_vector")))
    if "max_seen" in pairs.columns:
        results.append(duplicate(F.col("max_seen")))
    rows = rows.withColumn("_every", F.array(*[x.cast(RESULT) for x in results])).withColumn("report", report(F.col("_every")))
    return rows.drop("_a", "_b", "_x", "_y", "_ra", "_rb", "_changed", "_items", "_every", *(f"_{k}" for k in found))
