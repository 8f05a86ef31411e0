"""Queries of the rule operators: over the test tables with a Latin pack, and over Bangla cases that are given inline.

A case's expected verdict stands beside it, and is the SQL side of its query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as Q
from .catalog import query, table
from .functions import salience as X
from .functions import scoring as S
from .functions import text as T
from .functions.lexicon import BANGLA as B
from .functions.lexicon import LATIN as L
from .functions.salience import BANGLA_REWRITES, Rewrites
from .operators import adapters, claims, dedup, edits, propositions, verify

#: Fragments that the test tables' invented prose holds, as cues and pairs.
LATIN_REWRITES = Rewrites(
    increase=("with", "avec"),
    decrease=("para", "von"),
    attribution=("that", "selon", "dijo"),
    effects=("was", "est"),
    specific=("the",),
    amounts=("million",),
    percent_word="percent",
    months=("this", "dans", "esta", "sich"),
    relative_times=(("there", "here"), ("sur", "sous")),
    policies=(("the", "a"), ("les", "des"), ("una", "la"), ("der", "die")),
    connectors=(("from", "to"), ("pour", "par")),
    outcomes=(("not", "was"), ("pas", "bien")),
)


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else Q.lit(x) if isinstance(x, str) else str(x)
    return ", ".join(f"({', '.join(map(cell, r))})" for r in rows)


def _expected(names: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {_values(rows)}) AS t({names})"


def _cases(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, names)


# --- salience and propositions over the documents

_L_FIN, _L_DIR = Q.contains_any("sentence", L.financial), Q.contains_any("sentence", (*LATIN_REWRITES.increase, *LATIN_REWRITES.decrease))
_HAS_YEAR = f"regexp_matches(' ' || sentence || ' ', '[^0-9০-৯]{X.YEAR}[^0-9০-৯]')"


@query(
    f"""WITH {Q.sentences(L)}
    SELECT doc_id, idx, round(CASE idx WHEN 0 THEN 1.8::DOUBLE WHEN 1 THEN 1.2 WHEN 2 THEN 0.7 ELSE greatest(0.0::DOUBLE, 0.4::DOUBLE - 0.05::DOUBLE * (idx - 2)) END
        + CASE WHEN {_L_FIN} THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN {Q.contains_any("sentence", LATIN_REWRITES.attribution)} THEN 0.9::DOUBLE ELSE 0 END
        + CASE WHEN {_L_DIR} THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(sentence, '[0-9০-৯]') THEN 0.8::DOUBLE ELSE 0 END
        + CASE WHEN {Q.contains_any("sentence", (*L.causal, *LATIN_REWRITES.effects))} THEN 0.6::DOUBLE ELSE 0 END
        + CASE WHEN {Q.contains_any("sentence", LATIN_REWRITES.months)} THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN {_HAS_YEAR} THEN 0.5::DOUBLE ELSE 0 END
        - CASE WHEN len({Q.words("sentence")}) < 6 THEN 0.3::DOUBLE ELSE 0 END + 1e-9, 4) AS salience FROM s"""
)
def sentence_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), L)
    return rows.select("doc_id", "idx", X.salience(F.col("idx"), F.col("sentence"), L, LATIN_REWRITES).alias("salience"))


def _hit_sum(terms) -> str:
    return "(" + " + ".join(f"contains(sentence, {Q.lit(t)})::INTEGER" for t in dict.fromkeys(terms)) + ")"


@query(
    f"""WITH {Q.sentences(L)}
    SELECT doc_id, idx, round(greatest(0.0::DOUBLE, least(5.0::DOUBLE, CASE idx WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE greatest(0.0::DOUBLE, 0.6::DOUBLE - 0.05::DOUBLE * (idx - 2)) END
        + least(2.0::DOUBLE, 0.25::DOUBLE * {_hit_sum(L.financial)}) + least(1.5::DOUBLE, 0.4::DOUBLE * {_hit_sum((*LATIN_REWRITES.increase, *LATIN_REWRITES.decrease))})
        + CASE WHEN {Q.contains_any("sentence", LATIN_REWRITES.attribution)} THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(sentence, '[0-9০-৯]') THEN 0.6::DOUBLE ELSE 0 END
        - CASE WHEN len({Q.words("sentence")}) < 6 THEN 0.5::DOUBLE ELSE 0 END)) + 1e-9, 4) AS importance FROM s"""
)
def archived_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), L)
    return rows.select("doc_id", "idx", X.archived_importance(F.col("idx"), F.col("sentence"), L, LATIN_REWRITES).alias("importance"))


def _spans_sql(terms) -> str:
    """How many of the terms stand in the sentence with no letter or digit beside them."""
    edge = f"[^{L.letters}0-9০-৯]"
    return "(" + " + ".join(f"regexp_matches(' ' || sentence || ' ', '{edge}{t}{edge}')::INTEGER" for t in terms) + ")"


@query(
    f"""WITH {Q.sentences(L)}, f AS (
        SELECT doc_id, {_spans_sql([a for a, _ in LATIN_REWRITES.policies])} AS policy_reversal, {_spans_sql(L.entities)} AS entity_replacement,
        {_spans_sql([a for a, _ in LATIN_REWRITES.relative_times])} + {_spans_sql(LATIN_REWRITES.months)} + {_HAS_YEAR}::INTEGER AS temporal_shift,
        {_spans_sql([a for a, _ in (*LATIN_REWRITES.connectors, *LATIN_REWRITES.outcomes)])} AS causal_inversion FROM s)
    SELECT doc_id, family, sum(n)::BIGINT AS n FROM (UNPIVOT f ON policy_reversal, entity_replacement, temporal_shift, causal_inversion INTO NAME family VALUE n) WHERE n > 0 GROUP BY doc_id, family"""
)
def proposition_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = tuple(f for f in propositions.FAMILIES if f != "numerical_fact_change")
    found = propositions.propositions(table(spark, sf_dir, "documents").select("doc_id", "text"), L, LATIN_REWRITES, families=families, places=False)
    return found.groupBy("doc_id", "family").agg(F.count("*").alias("n"))


@query(
    f"""WITH {Q.sentences(L)}, pairs AS (
        SELECT doc_id, idx, unnest([{", ".join(f"{{'source': {Q.lit(a)}, 'target': {Q.lit(b)}}}" for a, b in LATIN_REWRITES.policies)}]) AS p, sentence FROM s)
    SELECT doc_id, idx, p.source AS span, p.target AS replacement,
        regexp_replace(' ' || sentence || ' ', '([^{L.letters}0-9০-৯])' || p.source || '([^{L.letters}0-9০-৯])', '\\1' || p.target || '\\2') AS edited
    FROM pairs WHERE regexp_matches(' ' || sentence || ' ', '[^{L.letters}0-9০-৯]' || p.source || '[^{L.letters}0-9০-৯]')"""
)
def policy_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = propositions.propositions(table(spark, sf_dir, "documents").select("doc_id", "text"), L, LATIN_REWRITES, families=("policy_reversal",), places=False)
    edited = T.splice(F.col("sentence"), F.col("start"), F.col("end"), F.col("replacement"))
    return found.select("doc_id", "idx", "span", "replacement", F.concat(F.lit(" "), edited, F.lit(" ")).alias("edited"))


@query()
def rule_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    best = propositions.best_of_family(propositions.propositions(docs, L, LATIN_REWRITES).drop("salience"))
    return propositions.apply_rules(docs, propositions.replacements(best, L, LATIN_REWRITES))


_USES = "o_custkey % 40"


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 0.5 WHEN o_custkey % 40 = 0 THEN 0.8 WHEN o_custkey % 40 < 12 THEN 0.5 WHEN o_custkey % 40 < 28 THEN 0.2 ELSE 0.0 END::DOUBLE AS bonus FROM orders")
def diversity_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = F.expr(_USES)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.diversity_bonus(uses, F.expr("o_custkey % 7"), F.lit(40)).alias("bonus"))


# --- style of turns

_REPEATED = "len(list_filter(list_distinct(string_split(text, '')), lambda ch: ch <> chr(10) AND contains(text, repeat(ch, 5)))) > 0"


def _marks(x: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '[{L.terminators}]', '', 'g')))"


def _paragraphs(x: str) -> str:
    return f"len(list_filter(string_split({x}, chr(10)), lambda p: {Q.strip('p')} <> ''))"


@query(
    f"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    r AS (SELECT conv_id, turn, list_filter([
        CASE WHEN {_paragraphs("before")} > 0 AND abs({_paragraphs("text")} - {_paragraphs("before")}) > 1 THEN {{'issue': 'paragraph_structure_shift', 'cost': 0.20::DOUBLE}} END,
        CASE WHEN {_marks("text")} < greatest(1, {_marks("before")} // 2) THEN {{'issue': 'punctuation_structure_shift', 'cost': 0.20::DOUBLE}} END,
        CASE WHEN {_REPEATED} THEN {{'issue': 'repeated_character_artifact', 'cost': 0.15::DOUBLE}} END,
        CASE WHEN contains(lower(text), 'click') OR contains(lower(text), 'subscribe') OR contains(lower(text), 'breaking!!!') THEN {{'issue': 'non_news_register', 'cost': 0.25::DOUBLE}} END,
        CASE WHEN len({Q.words("left(before, 40)")}) > 0 AND len(list_intersect({Q.words("left(before, 40)")}, {Q.words("text")})) = 0 THEN {{'issue': 'headline_topic_drift', 'cost': 0.20::DOUBLE}} END
    ], lambda x: x IS NOT NULL) AS a FROM t WHERE before IS NOT NULL),
    c AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - coalesce(list_sum(list_transform(a, lambda x: x.cost)), 0))) AS score0 FROM r)
    SELECT conv_id, turn, round(score0 + 1e-9, 4) AS score, score0 >= 0.72 AS passed, CASE WHEN score0 >= 0.72 THEN 'passed' ELSE array_to_string(list_transform(a, lambda x: x.issue), ',') END AS reason FROM c"""
)
def style_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn against the one before it, whose first 40 characters stand for a headline."""
    from .catalog import _turns

    v = verify.style(F.col("before"), F.col("text"), F.substring("before", 1, 40), L)
    return _turns(spark, sf_dir).select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", "v.score", "v.passed", "v.reason")


# --- Bangla cases

#: id, text, expected values
NUMBERS = [
    (1, "দাম ৫ দশমিক ৫ শতাংশ বেড়েছে", "5.5"),
    (2, "৫শ টাকা আর 12 জন", "500,12"),
    (3, "৩ দশমিক ২৫ এবং ৭", "3.25,7"),
    (4, "১০ শতাংশ ও 5%", "10,5"),
    (5, "কোনো সংখ্যা নেই", ""),
    (6, "১,৫ এবং ২.২৫", "1.5,2.25"),
]


@query(_expected("id, numbers", [(i, v) for i, _, v in NUMBERS]))
def bangla_numeric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, "id int, text string", [(i, t) for i, t, _ in NUMBERS])
    shown = F.transform(X.numeric_values(F.col("text"), B), lambda v: F.regexp_replace(F.format_string("%.4f", v), r"\.?0+$", ""))
    return rows.select("id", F.array_join(shown, ",").alias("numbers"))


#: id, text, expected scaled values
SCALED = [(1, "২ কোটি টাকা", "20000000"), (2, "৩ লাখ ৫ হাজার", "300000,5000"), (3, "1 দশমিক 5 কোটি", "15000000"), (4, "৭ শত জন", "700"), (5, "২০ শতাংশ", "20")]


@query(_expected("id, scaled", [(i, v) for i, _, v in SCALED]))
def bangla_scaled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, "id int, text string", [(i, t) for i, t, _ in SCALED])
    return rows.select("id", F.array_join(F.transform(T.scaled_values(F.col("text"), B), lambda v: F.format_string("%.0f", v)), ",").alias("scaled"))


#: id, text, expected entities by place
ENTITIES = [
    (1, "বাংলাদেশ ব্যাংক ও এনবিআর জানায়", "বাংলাদেশ ব্যাংক|এনবিআর"),
    (2, "সরকার ও এডিবি চুক্তি করেছে", "সরকার|এডিবি"),
    (3, "কোনো নাম নেই", ""),
]


@query(_expected("id, entities", [(i, v) for i, _, v in ENTITIES]))
def bangla_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, "id int, text string", [(i, t) for i, t, _ in ENTITIES])
    return rows.select("id", F.array_join(T.term_hits(F.col("text"), B.entities), "|").alias("entities"))


#: id, family, original sentence, edited one, target, replacement, expected reason of the intended change
CHANGES = [
    (1, "numerical_fact", "কোম্পানির ১শ’টি কারখানা আছে।", "কোম্পানির ১০০টি কারখানা আছে।", "১শ’টি", "১০০টি", "numeric_value_unchanged"),
    (2, "numerical_fact", "কোম্পানির ১০০টি কারখানা আছে।", "কোম্পানির ৯০০টি কারখানা আছে।", "১০০টি", "৯০০টি", "passed"),
    (3, "numerical_fact", "দাম ১০০ টাকা।", "দাম ১২০ টাকা।", "১০০ টাকা", "১২০ টাকা", "numeric_scale_change_too_weak"),
    (4, "numerical_fact", "দাম ৫৬ টাকা।", "দাম ১০০ শতাংশ।", "৫৬ টাকা", "১০০ শতাংশ", "numeric_unit_mismatch_percent"),
    (5, "numerical_fact", "দাম বেড়েছে।", "দাম কমেছে।", "দাম", "", "numeric_values_missing"),
    (6, "entity_replacement", "এডিবি ঋণ দিয়েছে।", "এনবিআর ঋণ দিয়েছে।", "এডিবি", "এনবিআর", "passed"),
    (7, "entity_replacement", "এডিবি ঋণ দিয়েছে।", "আইএমএফ ঋণ দিয়েছে।", "এডিবি", "আইএমএফ", "entity_same_role_replacement"),
    (8, "entity_replacement", "এডিবি ঋণ দিয়েছে।", "এডিবি ও এনবিআর ঋণ দিয়েছে।", "এডিবি", "এনবিআর", "original_entity_still_present"),
    (9, "temporal_shift", "মার্চ মাসে সভা হবে।", "জুলাই মাসে সভা হবে।", "মার্চ", "জুলাই", "passed"),
    (10, "temporal_shift", "মার্চ মাসে সভা হবে।", "মার্চ ও জুলাই মাসে সভা হবে।", "মার্চ", "জুলাই", "temporal_anchor_unchanged"),
    (11, "policy_reversal", "সরকার শুল্ক আরোপ করেছে।", "সরকার শুল্ক প্রত্যাহার করেছে।", "আরোপ", "প্রত্যাহার", "passed"),
    (12, "causal_inversion", "বৃষ্টির কারণে দাম বেড়েছে।", "বৃষ্টির পরে দাম কমেছে।", "কারণে", "পরে", "causal_marker_missing"),
    (13, "causal_inversion", "বৃষ্টির কারণে লাভ হয়েছে।", "বৃষ্টির কারণে ক্ষতি হয়েছে।", "লাভ", "ক্ষতি", "passed"),
    (14, "entity_replacement", "এডিবি ঋণ দিয়েছে।", "এডিবি ঋণ দিয়েছে।", "এডিবি", "এনবিআর", "target_unchanged"),
]
_CHANGE = "id int, family string, original string, edited string, target string, replacement string"


@query(_expected("id, passed, reason", [(c[0], c[-1] == "passed", c[-1]) for c in CHANGES]))
def bangla_intended_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verify.intended_change(*(F.col(c) for c in ("original", "edited", "family", "target", "replacement")), B)
    return _cases(spark, _CHANGE, [c[:-1] for c in CHANGES]).select("id", v.alias("v")).select("id", "v.passed", "v.reason")


#: of the same cases, the rule by which they contradict without a model (0.1 from the model otherwise)
RULES = {2: "deterministic_numeric_scale_contradiction", 6: "deterministic_entity_contradiction", 7: "deterministic_entity_contradiction", 9: "deterministic_temporal_shift_contradiction"}


@query(_expected("id, score, passed, reason", [(c[0], 1.0 if c[0] in RULES else 0.1, c[0] in RULES, "passed" if c[0] in RULES else "nli_contradiction_below_threshold") for c in CHANGES]).replace("SELECT *", "SELECT id, score::DOUBLE AS score, passed, reason"))
def bangla_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verify.contradiction(*(F.col(c) for c in ("edited", "family", "target", "replacement")), B, F.lit(0.1))
    return _cases(spark, _CHANGE, [c[:-1] for c in CHANGES]).select("id", v.alias("v")).select("id", "v.score", "v.passed", "v.reason")


#: id, original, edited, expected reasons of damaged text
ARTIFACTS = [
    (1, "সরকার নতুন নীতি নিয়েছে।", "সরকার পুরোনো নীতি নিয়েছে।", "passed"),
    (2, "সরকার নতুন নীতি নিয়েছে।", "সরকার �নীতি নিয়েছে বলে।", "replacement_character"),
    (3, "সরকার নতুন নীতি নিয়েছে।", "সরকার নতুন নতুন নীতি নেয়।", "repeated_bangla_fragment"),
    (4, "সরকার নতুন নীতি নিয়েছে।", "নীতি।", "target_sentence_length_shift"),
    (5, "সরকার নতুন নীতি নিয়েছে।", "", "target_sentence_missing"),
]


@query(_expected("id, score, passed, reason", [(i, 1.0 if r == "passed" else 0.0, r == "passed", r) for i, _, _, r in ARTIFACTS]).replace("SELECT *", "SELECT id, score::DOUBLE AS score, passed, reason"))
def bangla_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, "id int, original string, edited string", [a[:3] for a in ARTIFACTS])
    v = verify.text_artifacts(F.col("original"), F.col("edited"), F.col("edited"), F.lit("numerical_fact"), B)
    return rows.select("id", v.alias("v")).select("id", "v.score", "v.passed", "v.reason")


@query("SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - value / 330.0::DOUBLE)) + 1e-9, 4) AS score, value <= 220 AS passed, CASE WHEN value <= 220 THEN 'passed' ELSE 'perplexity_above_threshold' END AS reason FROM events WHERE value IS NOT NULL")
def fluency_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values stand for perplexities."""
    v = verify.fluency(F.col("value"))
    return table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", v.alias("v")).select("event_id", "v.score", "v.passed", "v.reason")


@query(
    """WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS x, list_transform(b.embedding, lambda x: x::DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    c AS (SELECT vec_id, CASE WHEN list_inner_product(x, x) * list_inner_product(y, y) > 0 THEN list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))) ELSE 0 END AS near FROM p)
    SELECT vec_id, round(near + 1e-9, 4) AS score, near >= 0.1 AS passed, CASE WHEN near >= 0.1 THEN 'passed' ELSE 'semantic_similarity_below_threshold' END AS reason FROM c"""
)
def similarity_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    v = verify.semantic_similarity(F.col("embedding"), F.col("other"), 0.1)
    return rows.join(after, "vec_id").select("vec_id", v.alias("v")).select("vec_id", "v.score", "v.passed", "v.reason")


#: id, sentence, family, target, replacement, expected plan error
PLANS = [
    (1, "প্যাকেটের দাম ৫৬ টাকা।", "numerical_fact", "৫৬ টাকা", "৫৬০ টাকা", None),
    (2, "প্যাকেটের দাম ৫৬ টাকা।", "numerical_fact", "৫৬ টাকা", "১০০ শতাংশ", "numeric_unit_mismatch_percent"),
    (3, "দেশে ১০০টি কারখানা আছে।", "numerical_fact", "১০০টি", "১০০ শতাংশ", "numeric_unit_mismatch_count_percentage"),
    (4, "দেশে ১০০টি কারখানা আছে।", "numerical_fact", "১০০টি", "৫০০টি", None),
    (5, "দেশে ১০০টি কারখানা আছে।", "numerical_fact", "১০০টি", "১ কোটি শতাংশ", "numeric_unit_mismatch_count_percentage"),
]


@query(_expected("id, unit_mismatch", [(i, e) for i, _, _, _, _, e in PLANS]))
def bangla_unit_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, "id int, target string, replacement string", [(p[0], p[3], p[4]) for p in PLANS])
    return rows.select("id", T.unit_mismatch(F.col("target"), F.col("replacement"), B).alias("unit_mismatch"))


#: id, text, phrase, expected span with its ending, and what its base and ending are
PHRASES = [
    (1, "দেশের ব্যাংকের হিসাব", "ব্যাংকের", 6, "ব্যাংক", "ের"),
    (2, "ব্যাংকগুলো বন্ধ", "ব্যাংকগুলো", 0, "ব্যাংক", "গুলো"),
    (3, "ব্যাংকার এসেছে", None, None, None, None),
    (4, "একটি ব্যাংক আছে", "ব্যাংক", 5, "ব্যাংক", ""),
]


@query(_expected('id, span, "start", base, suffix', [(i, s, p, b, e) for i, _, s, p, b, e in PHRASES]))
def bangla_phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, "id int, text string", [p[:2] for p in PHRASES]).withColumn("p", X.phrase_span(F.col("text"), "ব্যাংক", B, BANGLA_REWRITES.suffixes))
    part = X.split_suffix(F.col("p.text"), F.lit("ব্যাংক"), BANGLA_REWRITES.suffixes)
    return rows.select("id", F.col("p.text").alias("span"), F.col("p.start").alias("start"), F.when(F.col("p").isNotNull(), part["base"]).alias("base"), F.when(F.col("p").isNotNull(), part["suffix"]).alias("suffix"))


#: id, family, confidence, expected difficulty
DIFFICULTIES = [(1, "numerical_fact", 0.9, "easy"), (2, "causal_inversion", 0.88, "medium"), (3, "causal_inversion", 0.74, "hard"), (4, "temporal_shift", 0.5, "very_hard"), (5, "policy_reversal", 0.72, "medium")]


@query(_expected("id, difficulty", [(i, d) for i, _, _, d in DIFFICULTIES]))
def difficulty_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, "id int, family string, confidence double", [d[:3] for d in DIFFICULTIES])
    return rows.select("id", S.difficulty(F.col("family"), F.col("confidence")).alias("difficulty"))


#: id, family, target, replacement, the sentence's first words; the edit that a plan spells out in full
SPELLED = [(1, "entity_replacement", "এডিবি", "এনবিআর", "এডিবি ঋণ দিয়েছে। সভা শেষ।", "এনবিআর ঋণ দিয়েছে। সভা শেষ।"), (2, "temporal_shift", "মার্চ", "জুলাই", "মার্চ মাসে সভা। পরে কথা।", "জুলাই মাসে সভা। পরে কথা।")]


@query(_expected("article_id, rewritten", [(str(i), new) for i, _, _, _, _, new in SPELLED]))
def bangla_controlled_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, "article_id string, family string, target_span string, replacement string, text string", [(str(i), f, t, r, x) for i, f, t, r, x, _ in SPELLED])
    spans = T.sentence_spans(F.col("text"), B)
    rows = rows.withColumns({"idx": F.lit(0), "sentence": T.target_sentence(spans, F.lit(0)), "headline": F.lit("")})
    return edits.apply_plan(rows, B).select("article_id", "rewritten")


# --- duplicates, constraints, model scores


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), n AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS r FROM v),
    p AS (SELECT a.vec_id, max(list_inner_product(a.x, b.x) / (a.r * b.r)) AS seen FROM n a LEFT JOIN n b ON b.vec_id < a.vec_id GROUP BY a.vec_id)
    SELECT vec_id, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - coalesce(seen, 0)) + 1e-9, 4) AS score, coalesce(seen, 0) < 0.4 AS passed, CASE WHEN coalesce(seen, 0) < 0.4 THEN 'passed' ELSE 'near_duplicate_in_corpus' END AS reason FROM p"""
)
def duplicate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verify.duplicate(F.col("max_seen"), 0.4)
    return dedup.earlier_similarity(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", v.alias("v")).select("vec_id", "v.score", "v.passed", "v.reason")


@query(
    f"""SELECT o_orderkey, 'target_sentence_index=' || (o_custkey % 9) || '|' || '{"|".join(f"{k}=true" for k in sorted(edits.FORCED))}' AS merged,
    '{"|".join(f"{k}=true" for k in sorted(edits.SHOWN))}' AS shown, o_orderpriority AS own FROM orders"""
)
def plan_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's own constraint stays, its other index and its refusal of a forced one don't."""
    given = F.create_map(F.lit("own"), F.col("o_orderpriority"), F.lit("target_sentence_index"), F.lit("77"), F.lit(edits.FORCED[1]), F.lit("false"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", edits.merged_constraints(given, F.col("o_custkey") % 9).alias("m"))
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    index = F.map_filter("m", lambda k, v: k == "target_sentence_index")
    rest = F.map_filter("m", lambda k, v: ~k.isin("own", "target_sentence_index"))
    return rows.select("o_orderkey", F.concat(shown(index), F.lit("|"), shown(rest)).alias("merged"), shown(edits.compact_constraints(F.col("m"))).alias("shown"), F.col("m")["own"].alias("own"))


@query(
    """WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), r AS (SELECT *, length(text)::DOUBLE / nullif(length(before), 0) AS ratio FROM t WHERE before IS NOT NULL)
    SELECT conv_id, turn, CASE WHEN ratio BETWEEN 0.6 AND 1.4 THEN 1.0 ELSE 0.0 END::DOUBLE AS score, CASE WHEN ratio BETWEEN 0.6 AND 1.4 THEN 'passed' ELSE 'length_ratio_out_of_range' END AS reason FROM r"""
)
def length_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalog import _turns

    v = verify.length_ratio(F.col("before"), F.col("text"))
    return _turns(spark, sf_dir).select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", "v.score", "v.reason")


@query("SELECT event_id, round(exp(least(20.0::DOUBLE, value / 10.0)), 6) AS perplexity, round(1 + 300 * (value / 1000.0::DOUBLE), 6) AS quality, round(exp(value / 100.0) / (exp(value / 100.0) + 1), 6) AS first FROM events WHERE value IS NOT NULL")
def model_score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    first = F.get(adapters.softmax(F.array(v / 100.0, F.lit(0.0))), F.lit(0))
    return table(spark, sf_dir, "events").filter("value IS NOT NULL").select(
        "event_id", F.round(adapters.perplexity_from_loss(v / 10.0), 6).alias("perplexity"), F.round(adapters.quality_from_fakes(v / 1000.0), 6).alias("quality"), F.round(first, 6).alias("first")
    )
