"""All core queries by name, with the DuckDB SQL that gives the same rows.

Each query applies operators of this package to whole test tables.  Where SQL
can't express one (order-dependent hashes, back-references, Python functions),
there is none and the tests hold it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as Q
from .functions import scoring as S
from .functions import text as T
from .functions.lexicon import LATIN as L
from .operators import adapters, claims, dataset, dedup, edits, filters, reports, verify
from .plans import pipeline as plan
from .sources import readers, storage
from .streaming import incremental

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(*names: str):
    return [F.array_join(n, "|").alias(n) for n in names]


# --- segmentation and spans


@query(f'WITH {Q.sentences(L)} SELECT doc_id, idx, "start", "end", sentence FROM s')
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), L)


@query(f"WITH {Q.sentences(L)} SELECT d.doc_id, count(s.idx)::INTEGER AS n_sentences, coalesce(max(length(s.sentence)), 0)::INTEGER AS longest FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = T.sentence_spans(F.col("text"), L)
    longest = F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x["text"]))), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", spans.alias("s")).select("doc_id", F.size("s").alias("n_sentences"), longest.alias("longest"))


@query(
    f"""WITH {Q.sentences(L)}, g AS (SELECT doc_id, list(sentence ORDER BY idx) AS a FROM s GROUP BY doc_id)
    SELECT d.doc_id, coalesce(a[2], '') AS target, CASE WHEN a IS NULL THEN {Q.strip("d.text")} ELSE {Q.strip("array_to_string(a[1:3], ' ')")} END AS context
    FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("s", T.sentence_spans(F.col("text"), L))
    return docs.select("doc_id", T.target_sentence(F.col("s"), 1).alias("target"), T.context_window(F.col("text"), F.col("s"), F.lit(1)).alias("context"))


@query(f"SELECT doc_id, CASE WHEN length(x) <= 200 THEN x ELSE rtrim(left(x, 197)) || '...' END AS excerpt FROM (SELECT doc_id, {Q.squeeze('text')} AS x FROM documents)")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 200).alias("excerpt"))


# --- extraction


@query(f"WITH {Q.sentences(L)} SELECT doc_id, idx, {Q.joined(Q.numbers('sentence'))} AS numbers FROM s WHERE len({Q.numbers('sentence')}) > 0")
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), L).withColumn("numbers", T.numbers(F.col("sentence")))
    return rows.filter(F.size("numbers") > 0).select("doc_id", "idx", *_joined("numbers"))


_PROFILE = {"has_numeric": "[0-9০-৯]", "money": L.money, "percent": L.percent, "scale": "|".join(L.scales)}


@query(
    f"""SELECT doc_id, {", ".join(f"regexp_matches(text, '{p}') AS {k}" for k, p in _PROFILE.items())},
    regexp_matches(text, '{L.count}') AND NOT regexp_matches(text, '{L.money}') AS count_unit, translate(text, '0123456789', '০১২৩৪৫৬৭৮৯') AS bangla FROM documents"""
)
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.unit_profile(F.col("text"), L)
    return table(spark, sf_dir, "documents").select(
        "doc_id", *[p[k].alias(k) for k in _PROFILE], p["count"].alias("count_unit"), T.bangla_digits(F.col("text")).alias("bangla")
    )


_UNITS = "|".join([*L.scales, *L.other_units])


@query(
    f"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9০-৯]+(?:[.,][0-9০-৯]+)?){T.SPACE}*({_UNITS})?', 1)) AS raw,
                      unnest(regexp_extract_all(text, '([0-9০-৯]+(?:[.,][0-9০-৯]+)?){T.SPACE}*({_UNITS})?', 2)) AS unit FROM documents),
    v AS (SELECT doc_id, try_cast(replace(raw, ',', '.') AS DOUBLE) * CASE unit WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 ELSE 1 END AS v FROM p)
    SELECT doc_id, count(v) AS n_values, max(v) AS largest, count_if(abs(v) BETWEEN 1 AND 99999)::BIGINT AS usable FROM v WHERE v IS NOT NULL GROUP BY doc_id"""
)
def scaled_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", T.scaled_values(F.col("text"), L).alias("v")).filter(F.size("v") > 0)
    return v.select("doc_id", F.size("v").cast("long").alias("n_values"), F.array_max("v").alias("largest"), F.size(filters.usable_numbers(F.col("v"))).cast("long").alias("usable"))


@query(f"SELECT doc_id, {Q.joined(Q.hits('text', L.entities))} AS entities, {Q.joined(Q.hits('text', L.policy))} AS policies, {Q.contains_any('text', L.financial)} AS financial FROM documents")
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.entities(text, L).alias("entities"), T.term_hits(text, L.policy).alias("policies"), T.contains_any(text, L.financial).alias("financial")).select(
        "doc_id", *_joined("entities", "policies"), "financial"
    )


_ROLES = [(role, term) for role, terms in L.roles.items() for term in terms]


@query(
    f"""WITH d AS (SELECT role, term, row_number() OVER () AS o FROM (VALUES {", ".join(f"('{r}', '{t}')" for r, t in _ROLES)}) AS v(role, term))
    SELECT b.doc_id, d.term, d.role FROM documents b JOIN d ON contains(b.text, d.term)"""
)
def entity_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.entities(F.col("text"), L)).alias("term"))
    return rows.withColumn("role", T.entity_role(F.col("term"), L))


@query(f"WITH {Q.sentences(L)} SELECT doc_id, idx, concat_ws('|', CASE WHEN {Q.contains_any('sentence', ('with', 'avec'))} THEN 'increase' END, CASE WHEN {Q.contains_any('sentence', ('para', 'von'))} THEN 'decrease' END) AS direction FROM s")
def policy_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), L)
    return rows.select("doc_id", "idx", T.directions(F.col("sentence"), L.policy_directions).alias("direction"))


@query(
    f"""WITH {Q.sentences(L)}, h AS (SELECT doc_id, idx, sentence, list_sort(list_filter([{", ".join(f"{{'pos': strpos(sentence, {Q.lit(t)}), 'term': {Q.lit(t)}}}" for t in L.causal)}], lambda h: h.pos > 0)) AS a FROM s)
    SELECT doc_id, idx, CASE WHEN len(a) = 0 THEN sentence ELSE substring(sentence, (a[1].pos + length(a[1].term))::BIGINT) END AS effect FROM h"""
)
def effect_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), L)
    return rows.select("doc_id", "idx", T.effect_clause(F.col("sentence"), L).alias("effect"))


# --- claims


#: The documents table has no headlines; a text's first 60 characters stand for one, here and in the SQL.
HEADLINE_CHARS = 60


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return claims.score(claims.extract(docs, L, headline=F.substring("text", 1, HEADLINE_CHARS), max_sentences=None), L)


_CLAIM = ["idx", "sentence", "claim_type", "confidence"]
_SCORES = ["importance", "editability", "verification", "locality", "risk", "overall"]


@query(f"WITH {Q.claims(L)} SELECT doc_id, idx, sentence, claim_type, entities, numbers, policies, dates, n_words, confidence FROM c")
def claim_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = claims.extract(docs, L, headline=F.substring("text", 1, HEADLINE_CHARS), max_sentences=None)
    return found.select("doc_id", "idx", "sentence", "claim_type", *_joined("entities", "numbers", "policies", "dates"), "n_words", "confidence")


@query(f"WITH {Q.claims(L)} SELECT doc_id, idx, claim_type, {', '.join(_SCORES)} FROM c")
def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "idx", "claim_type", *_SCORES)


@query(f"WITH {Q.claims(L)} SELECT doc_id, idx, claim_type, overall, row_number() OVER (PARTITION BY doc_id ORDER BY overall DESC, idx)::INTEGER AS rank FROM c WHERE overall >= 0.52 AND risk <= 0.72")
def ranked_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.ranked(_scored(spark, sf_dir)).select("doc_id", "idx", "claim_type", "overall", "rank")


@query(f"WITH {Q.claims(L)} SELECT doc_id, {', '.join([*_CLAIM, *_SCORES])} FROM c WHERE overall >= 0.52 AND risk <= 0.72 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overall DESC, idx) = 1")
def top_claim_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.best(_scored(spark, sf_dir)).select("doc_id", *_CLAIM, *_SCORES)


@query(f"WITH {Q.claims(L)} SELECT claim_type, count(*) AS n FROM c GROUP BY claim_type")
def claim_type_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(_scored(spark, sf_dir), "claim_type")


@query("SELECT doc_id, 'rw_' || left(sha1(doc_id::VARCHAR || ':3:numerical_fact:42'), 16) AS sample_id FROM documents")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.sample_id(F.col("doc_id"), F.lit(3), F.lit("numerical_fact"), F.lit(42)).alias("sample_id"))


@query(
    f"""WITH {Q.claims(L)} SELECT doc_id, idx, CASE claim_type WHEN 'numerical' THEN 'numerical_fact' WHEN 'causal' THEN 'causal_inversion' WHEN 'entity' THEN 'entity_replacement' WHEN 'temporal' THEN 'temporal_shift' ELSE 'policy_reversal' END AS family,
    CASE claim_type WHEN 'numerical' THEN split_part(numbers, '|', 1) WHEN 'entity' THEN split_part(entities, '|', 1) WHEN 'policy' THEN split_part(policies, '|', 1)
         WHEN 'temporal' THEN CASE WHEN dates <> '' THEN split_part(dates, '|', 1) ELSE split_part(numbers, '|', 1) END ELSE '' END AS target_span, '' AS replacement FROM c"""
)
def heuristic_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.heuristic_plan(_scored(spark, sf_dir)).select("doc_id", "idx", "family", "target_span", "replacement")


@query()
def plan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edits.heuristic_plan(_scored(spark, sf_dir)).withColumn("replacement", F.when(F.col("idx") % 2 == 0, F.lit("about 90 items")).otherwise(F.col("target_span")))
    return edits.check_plans(rows, L).select("doc_id", "idx", "family", "plan_error")


# --- edits and verifiers


@query(
    """SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN left(text, (strpos(text, 'the') - 1)::BIGINT) || 'THE' || substring(text, (strpos(text, 'the') + 3)::BIGINT) ELSE text END AS first_edit,
    replace(text, 'the', 'THE') AS all_edit FROM documents"""
)
def literal_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, t, r = F.col("text"), F.lit("the"), F.lit("THE")
    return table(spark, sf_dir, "documents").select("doc_id", T.replace_first(text, t, r).alias("first_edit"), T.replace_all(text, t, r).alias("all_edit"))


@query(
    f"""WITH {Q.sentences(L)}, x AS (SELECT doc_id, "start", "end" FROM s WHERE idx = 1)
    SELECT d.doc_id, CASE WHEN x.doc_id IS NULL THEN d.text ELSE left(d.text, x."start") || 'New words here.' || substring(d.text, x."end" + 1) END AS spliced FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id"""
)
def splice_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("s", F.get(T.sentence_spans(F.col("text"), L), F.lit(1)))
    whole = F.when(F.col("s").isNull(), F.col("text")).otherwise(T.splice(F.col("text"), F.col("s.start"), F.col("s.end"), F.lit("New words here.")))
    return docs.select("doc_id", whole.alias("spliced"))


_EDITED = "replace(text, 'thing', 'THING')"


@query(
    f"""WITH {Q.sentences(L)}, b AS (SELECT doc_id, {_EDITED} AS text FROM documents), {Q.sentences(L, "b").replace("m AS", "m2 AS").replace("FROM m)", "FROM m2)").replace("e AS", "e2 AS").replace("FROM e ", "FROM e2 ").replace("    s AS", "    s2 AS")},
    z AS (SELECT coalesce(s.doc_id, s2.doc_id) AS doc_id, coalesce(s.idx, s2.idx) AS idx FROM s FULL JOIN s2 ON s.doc_id = s2.doc_id AND s.idx = s2.idx WHERE coalesce(s.sentence, '') <> coalesce(s2.sentence, ''))
    SELECT d.doc_id, coalesce(string_agg(z.idx::VARCHAR, ',' ORDER BY z.idx), '') AS changed FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id"""
)
def changed_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumns({"a": T.sentence_spans(F.col("text"), L), "b": T.sentence_spans(F.replace("text", F.lit("thing"), F.lit("THING")), L)})
    return docs.select("doc_id", F.array_join(T.changed_indices(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("changed"))


@query(
    f"""WITH {Q.sentences(L)}, b AS (SELECT doc_id, {_EDITED} AS text FROM documents), {Q.sentences(L, "b").replace("m AS", "m2 AS").replace("FROM m)", "FROM m2)").replace("e AS", "e2 AS").replace("FROM e ", "FROM e2 ").replace("    s AS", "    s2 AS")},
    z AS (SELECT coalesce(s.doc_id, s2.doc_id) AS doc_id, coalesce(s.idx, s2.idx) AS idx FROM s FULL JOIN s2 ON s.doc_id = s2.doc_id AND s.idx = s2.idx WHERE coalesce(s.sentence, '') <> coalesce(s2.sentence, '')),
    g AS (SELECT d.doc_id, coalesce(list(z.idx ORDER BY z.idx) FILTER (z.idx IS NOT NULL), []) AS a FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id),
    p AS (SELECT doc_id, len(a) > 0 AND len(list_filter(a, lambda i: i <> 0)) = 0 AS passed, list_filter(a, lambda i: i <> 0) AS o FROM g)
    SELECT doc_id, CASE WHEN passed THEN 1.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.35::DOUBLE * len(o)) + 1e-9, 4) END AS score, passed,
    CASE WHEN passed THEN 'passed' ELSE 'unexpected_sentence_changes:[' || array_to_string(o, ', ') || ']' END AS reason FROM p"""
)
def locality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumns({"a": T.sentence_spans(F.col("text"), L), "b": T.sentence_spans(F.replace("text", F.lit("thing"), F.lit("THING")), L)})
    v = verify.locality(F.col("a"), F.col("b"), F.lit(0), F.lit("numerical_fact"), F.lit("thing"), F.lit("THING"))
    return docs.select("doc_id", v.alias("v")).select("doc_id", "v.score", "v.passed", "v.reason")


_TURNS = "t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("before")).filter("before IS NOT NULL")


@query(
    f"""WITH {_TURNS} SELECT conv_id, turn, {Q.joined(f"list_sort(list_filter(list_distinct({Q.hits('text', L.entities)}), lambda x: NOT list_contains({Q.hits('before', L.entities)}, x)))")} AS new_entities,
    {Q.joined(f"list_sort(list_filter(list_distinct({Q.numbers('text')}), lambda x: NOT list_contains({Q.numbers('before')}, x)))")} AS new_numbers FROM t WHERE before IS NOT NULL"""
)
def new_item_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = verify.new_items(F.col("before"), F.col("text"), L)
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(items["entities"], "|").alias("new_entities"), F.array_join(items["numbers"], "|").alias("new_numbers"))


def _jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct({a} || {b})) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct({a} || {b})) ELSE 0 END"


def _bigrams_sql(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x})), lambda i: substring({x}, i, 2)))"


@query(
    f"""WITH {_TURNS}, g AS (SELECT conv_id, turn, {_bigrams_sql("text")} AS a2, {_bigrams_sql("before")} AS b2, list_distinct({Q.words("text")}) AS a1, list_distinct({Q.words("before")}) AS b1 FROM t WHERE before IS NOT NULL)
    SELECT conv_id, turn, round(0.4::DOUBLE * ({_jaccard_sql("a2", "b2")}) + 0.6::DOUBLE * ({_jaccard_sql("a1", "b1")}) + 1e-9, 4) AS similarity FROM g"""
)
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", S.similarity_mix(F.col("before"), F.col("text")).alias("similarity"))


@query()
def artifact_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.artifacts(F.col("text"), L), "|").alias("artifacts"), S.heuristic_fluency(F.col("text")).alias("fluency"))


@query()
def turn_lexical_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", adapters.lexical_similarity(F.col("before"), F.col("text")).alias("similarity"))


@query()
def edit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.substring("text", 1, HEADLINE_CHARS).alias("headline"), "text")

    def planner(rows: DataFrame) -> DataFrame:
        out = edits.heuristic_plan(rows)
        return out.withColumn("replacement", F.when(F.col("family") == "temporal_shift", "2031").when(F.col("family") == "entity_replacement", "elsewhere").otherwise("with 950000000 items"))

    samples, _ = plan.run(docs, L, planner, settings=plan.Settings(max_sentences=None), settle=storage.settle)
    return samples.select("sample_id", "original_id", "edit_family", "label", "idx", "target_span", "replacement", F.col("report.passed").alias("passed"), "attempt")


# --- filters

_PAIR = "SELECT doc_id, text AS original_text, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN text || ' ' WHEN 2 THEN left(text, 40) WHEN 3 THEN text || text || text ELSE replace(text, 'the', 'a') END AS text FROM documents"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, k = F.col("text"), F.col("doc_id") % 5
    edited = F.when(k == 0, text).when(k == 1, F.concat(text, F.lit(" "))).when(k == 2, F.substring(text, 1, 40)).when(k == 3, F.concat(text, text, text)).otherwise(F.replace(text, F.lit("the"), F.lit("a")))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("original_text"), edited.alias("text"))


_REASON = f"""CASE WHEN original_text = text THEN 'identical_texts' WHEN {Q.squeeze("original_text")} = {Q.squeeze("text")} THEN 'only_whitespace_changed'
    WHEN length(text) < 50 THEN 'too_short_' || length(text) WHEN length(text)::DOUBLE / length(original_text) > 2.0 THEN 'too_long_ratio_' || printf('%.2f', length(text)::DOUBLE / length(original_text))
    WHEN length(text)::DOUBLE / length(original_text) < 0.5 THEN 'too_short_ratio_' || printf('%.2f', length(text)::DOUBLE / length(original_text))
    WHEN length(regexp_replace(text, {Q.lit("[^" + filters.SPECIAL[1:])}, '', 'g')) > length(text) * 0.1 THEN 'excessive_special_chars'
    WHEN len(list_filter(range(1, greatest(length(text) - 2, 1)), lambda i: substring(text, i, 1) <> chr(10) AND substring(text, i, 4) = repeat(substring(text, i, 1), 4))) > 0 THEN 'repeated_characters'
    WHEN len({Q.words("text")}) < 5 THEN 'too_few_words' END"""


@query(f"SELECT doc_id, {_REASON} AS discard_reason FROM ({_PAIR})")
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.rule_filter(_pairs(spark, sf_dir)).select("doc_id", "discard_reason")


@query(f"WITH r AS (SELECT {_REASON} AS x FROM ({_PAIR})) SELECT coalesce(regexp_replace(x, '_[0-9.]+$', ''), 'kept') AS reason, count(*) AS n FROM r GROUP BY 1")
def discard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.rule_filter(_pairs(spark, sf_dir)).select(F.coalesce(F.regexp_replace("discard_reason", "_[0-9.]+$", ""), F.lit("kept")).alias("reason"))
    return reports.distribution(rows, "reason")


@query(
    f"""SELECT doc_id, length(text) >= 50 AND length(text)::DOUBLE / length(original_text) BETWEEN 0.65 AND 1.35 AND text <> original_text
    AND (l.quality IS NULL OR (l.quality = 1 AND (0.4 + 0.1 * l.toxic) >= 0.43)) AS kept FROM ({_PAIR}) LEFT JOIN labels l USING (doc_id)"""
)
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.to_json(F.struct((F.col("quality") == 1).alias("passed"), F.lit(0.9).alias("semantic_similarity"), F.lit(0.8).alias("fluency_score"), (0.4 + 0.1 * F.col("toxic")).alias("contradiction_score"))).alias("scores"),
    )
    rows = _pairs(spark, sf_dir).join(labels, "doc_id", "left")
    return rows.select("doc_id", filters.basic_quality(F.col("original_text"), F.col("text"), F.col("scores"), F.lit("easy")).alias("kept"))


# --- vectors and overlap

_COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({_COSINE} + 1e-9, 4) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {_COSINE} >= 0.35")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(table(spark, sf_dir, "embeddings"), 0.35).withColumn("similarity", S.rounded(F.col("similarity")))


@query(f"SELECT a.vec_id, round(coalesce(max({_COSINE}) FILTER ({_COSINE} >= 0.35), 0.0) + 1e-9, 4) AS max_similarity FROM embeddings a LEFT JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id")
def max_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return dedup.max_similarity(dedup.similar_pairs(rows, 0.35), rows).withColumn("max_similarity", S.rounded(F.col("max_similarity")))


@query()
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return dedup.greedy_accept(dedup.similar_pairs(rows, 0.35), rows, settle=storage.settle)


@query(
    f"""WITH d AS (SELECT doc_id, list_distinct({Q.words("text")}) AS f FROM documents), r AS (SELECT item_id, list_distinct({Q.words("text")}) AS f FROM benchmark),
    p AS (SELECT doc_id, item_id, len(list_intersect(d.f, r.f)) AS c, len(d.f) + len(r.f) AS t FROM d, r)
    SELECT doc_id, item_id, round(c::DOUBLE / (t - c) + 1e-9, 4) AS jaccard FROM p WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c::DOUBLE / (t - c) DESC, item_id) = 1"""
)
def benchmark_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.max_reference_jaccard(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.withColumn("jaccard", S.rounded(F.col("jaccard")))


# --- datasets

_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' WHEN doc_id % 100 = 9 THEN '' ELSE 'test' END"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 10
    return table(spark, sf_dir, "documents").withColumn("split", F.when(k < 8, "train").when(k == 8, "validation").when(F.col("doc_id") % 100 == 9, "").otherwise("test"))


@query(
    f"""WITH r AS (SELECT source, coalesce(nullif({_SPLIT}, ''), 'unknown') AS split FROM documents), g AS (SELECT source, count(DISTINCT split) AS k, count_if(split = 'unknown') AS missing, count(*) AS n FROM r GROUP BY source)
    SELECT count_if(k > 1) > 0 OR sum(missing) > 0 AS has_leakage, count_if(k > 1)::BIGINT AS leaky_ids, count(source) AS unique_ids, sum(missing)::BIGINT AS missing_split_rows, sum(n)::BIGINT AS rows FROM g"""
)
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.leakage(_split(spark, sf_dir), "source")


@query(f"SELECT lang, {_SPLIT} AS split, count(*) AS n FROM documents GROUP BY 1, 2")
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(_split(spark, sf_dir), "lang", "split")


@query()
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.grouped_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source")


@query()
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.hash_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source")


@query()
def sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.seeds(dataset.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id"), "doc_id", 42)


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events), c AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) SELECT event_id, event_type FROM r, c WHERE p <= least")
def balance_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.balance(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["event_id"])


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 25")
def first_n_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.first_n_per_type(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["event_id"], 25)


@query("SELECT event_id, event_type FROM events WHERE value > 50 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 40")
def quota_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.quota(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50, [F.desc("value"), "event_id"], 40).select("event_id", "event_type")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 200 OFFSET 1000")
def offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.offset_limit(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 1000, 200)


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 64)::BIGINT AS chunk FROM orders")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.chunk_ids(table(spark, sf_dir, "orders").select("o_orderkey"), 64, ["o_orderkey"])


@query(
    """SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS nationkey, c_mktsegment, '' AS s_suppkey, '' AS s_name FROM customer
    UNION ALL SELECT '', '', s_nationkey::VARCHAR, '', s_suppkey::VARCHAR, s_name FROM supplier"""
)
def union_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("nationkey"), "c_mktsegment")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nationkey"))
    return dataset.union_fill([c, s])


@query("SELECT c_custkey::VARCHAR AS article_id, c_mktsegment AS headline, c_name AS text, c_custkey::VARCHAR || '|' || c_nationkey::VARCHAR AS folded, 2 AS n_keys FROM customer")
def metadata_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dataset.fold_metadata(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name", "c_nationkey"), "c_custkey", "c_mktsegment", "c_name")
    folded = F.concat_ws("|", F.col("metadata")["c_custkey"], F.col("metadata")["c_nationkey"])
    return rows.select("article_id", "headline", "text", folded.alias("folded"), F.size("metadata").alias("n_keys"))


# --- joins on ids


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return readers.semi_scan(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return readers.latest(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", done)


@query("SELECT c.c_custkey, s.s_name AS cached_name, s.s_suppkey IS NOT NULL AS cache_hit FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey")
def cached_plan_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    rows = readers.with_cached(table(spark, sf_dir, "customer").select("c_custkey"), plans, "c_custkey")
    return rows.select("c_custkey", F.col("cached.s_name").alias("cached_name"), "cache_hit")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def last_value_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.last_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("SELECT s_suppkey::VARCHAR AS term, CASE WHEN contains(lower(n_name), 'bank') THEN 'bank' WHEN contains(lower(n_name), 'insurance') THEN 'insurance' ELSE 'listed' END AS role FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def routed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return readers.routed_terms(rows.select(F.col("s_suppkey").cast("string").alias("t"), "n_name"), "t", "n_name")


@query("SELECT vec_id, CASE label % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS label FROM embeddings")
def remap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).cast("int").alias("label"))
    return readers.remap_labels(rows, "label", {0: 1, 1: 2, 2: 0})


# --- reports


@query("SELECT event_type, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, count(value) AS n FROM events GROUP BY event_type")
def per_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.type_stats(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT event_type, value AS upper_median FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value) = count(*) OVER (PARTITION BY event_type) // 2 + 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.upper_median(table(spark, sf_dir, "events"), "event_type", "value")


_SWEEP = [10.0, 50.0, 100.0, 200.0]


@query(
    f"""WITH t AS (SELECT unnest({_SWEEP})::DOUBLE AS threshold), g AS (SELECT threshold, event_type, count_if(value >= threshold) AS k, count(*) AS n FROM events, t GROUP BY 1, 2)
    SELECT threshold, sum(k)::BIGINT AS kept, round(sum(k)::DOUBLE / sum(n) * 100, 2) AS pct, min(round(k::DOUBLE / n * 100, 2)) AS least_type_pct FROM g GROUP BY threshold"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threshold_sweep(table(spark, sf_dir, "events"), "event_type", "value", _SWEEP)


@query("WITH b AS (SELECT event_id, value, CASE WHEN value >= 100 THEN 4 WHEN value >= 50 THEN 3 WHEN value >= 20 THEN 2 WHEN value >= 0 THEN 1 ELSE 0 END AS bin FROM events) SELECT bin, event_id, value, row_number() OVER (PARTITION BY bin ORDER BY event_id)::INTEGER AS place FROM b WHERE bin > 0 QUALIFY place <= 2")
def binned_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.binned(table(spark, sf_dir, "events"), "event_id", "value", [0.0, 20.0, 50.0, 100.0])


@query("SELECT lang, count_if(source = 'src0')::BIGINT AS n_src0, count_if(source = 'src1')::BIGINT AS n_src1, round(count_if(source = 'src0')::DOUBLE / count(*) * 100, 2) AS pct_src0, round(count_if(source = 'src1')::DOUBLE / count(*) * 100, 2) AS pct_src1 FROM documents GROUP BY lang")
def two_way_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.two_way(table(spark, sf_dir, "documents").select("lang", "source"), "lang", "source", ["src0", "src1"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.most_common(table(spark, sf_dir, "events"), "event_type")


@query(
    """WITH r AS (SELECT o_orderstatus = 'F' AS ok, o_custkey % 3 + 1 AS a, o_totalprice / 1000 AS s FROM orders)
    SELECT count(*) AS input_articles, count_if(ok)::BIGINT AS accepted, (count(*) - count_if(ok))::BIGINT AS failed, round(count_if(ok)::DOUBLE / count(*), 4) AS acceptance_rate, round(avg(a), 4) AS average_attempts,
    round(count_if(ok AND a = 1)::DOUBLE / count_if(ok), 4) AS first_attempt_acceptance_rate, count_if(ok AND a > 1)::BIGINT AS accepted_after_retry, round(count(*) / sum(s) * 60, 4) AS articles_per_minute, round(count_if(ok) / sum(s) * 60, 4) AS accepted_per_minute FROM r"""
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_metrics(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", F.col("o_custkey") % 3 + 1, F.col("o_totalprice") / 1000)


@query("SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 4) AS mean_seconds FROM lineitem GROUP BY l_returnflag")
def mean_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mean_seconds(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity")


@query(
    """SELECT 'failure' AS kind, event_type AS reason, count(*) AS n FROM events GROUP BY event_type
    UNION ALL SELECT 'verifier', 'k' || (json_extract_string(props, '$.k')::INTEGER % 7), count(*) FROM events GROUP BY 2"""
)
def failure_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("reason"), F.array(F.struct(F.array(reason).alias("reasons"))).alias("attempts"))
    return reports.reason_counts(rows, "reason", "attempts")


@query(
    """WITH c AS (SELECT quality AS y, 1 - toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2),
    k AS (SELECT c, sum(s) AS s, sum(g) AS g, sum(t) AS t FROM (SELECT y AS c, n AS s, 0 AS g, CASE WHEN y = p THEN n ELSE 0 END AS t FROM c UNION ALL SELECT p, 0, n, 0 FROM c) GROUP BY c)
    SELECT round(sum(t)::DOUBLE / sum(s), 4) AS accuracy, round(avg(CASE WHEN g > 0 THEN t::DOUBLE / g ELSE 0 END), 4) AS macro_precision, round(avg(CASE WHEN s > 0 THEN t::DOUBLE / s ELSE 0 END), 4) AS macro_recall,
    round(avg(2 * t::DOUBLE / (s + g)), 4) AS macro_f1, round(sum(2 * t::DOUBLE / (s + g) * s) / sum(s), 4) AS weighted_f1 FROM k"""
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("p"))
    return reports.classification(rows, "quality", "p")


@query(
    """WITH v AS (SELECT l_orderkey, l_quantity AS w, [l_discount, l_tax, 1 - l_discount - l_tax] AS p FROM lineitem),
    a AS (SELECT l_orderkey, [round(sum(p[1] * w) / sum(w), 6), round(sum(p[2] * w) / sum(w), 6), round(sum(p[3] * w) / sum(w), 6)] AS q FROM v GROUP BY l_orderkey)
    SELECT l_orderkey, round(q[1] + 1e-9, 4) AS p0, (list_position(q, list_max(q)) - 1)::INTEGER AS label FROM a"""
)
def ensemble_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.array("l_discount", "l_tax", 1 - F.col("l_discount") - F.col("l_tax"))
    rows = reports.ensemble(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", p.alias("p")), "l_orderkey", "p", "l_quantity")
    return rows.select("l_orderkey", S.rounded(F.col("probability")[0]).alias("p0"), "label")


@query(
    """WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), i AS (SELECT l_orderkey, sum(n) AS k, sum(n * n) AS q FROM c GROUP BY 1 HAVING sum(n) > 1),
    s AS (SELECT l_returnflag, sum(n) AS m FROM c WHERE l_orderkey IN (SELECT l_orderkey FROM i) GROUP BY 1), e AS (SELECT sum(m * m)::DOUBLE / (sum(m) * sum(m))::DOUBLE AS pe FROM s), a AS (SELECT avg((q - k)::DOUBLE / (k * (k - 1))::DOUBLE) AS pa FROM i)
    SELECT round(pa, 4) AS agreement, round(pe, 4) AS chance, round((pa - pe) / (1 - pe), 4) AS kappa FROM a, e"""
)
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fleiss_kappa(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT l_orderkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) = 1")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.majority(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT round(corr(l_quantity, l_extendedprice), 4) AS correlation, count(*) AS n FROM lineitem")
def score_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.correlation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query("SELECT event_type, count_if(value >= 0.4)::BIGINT AS kept, count_if(value < 0.4)::BIGINT AS dropped FROM events GROUP BY event_type")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.by_threshold(table(spark, sf_dir, "events"), "value", 0.4)
    return rows.groupBy("event_type").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


@query("SELECT time_bucket(INTERVAL '60 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.windowed_counts(table(spark, sf_dir, "events"))


from . import casebook  # noqa: E402, F401  registers its queries here
