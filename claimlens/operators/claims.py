"""Sentences, claims and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions.lexicon import Lexicon


def sentences(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """One row a sentence: the document's other columns, idx, start, end, sentence.  Narrow: no shuffle.

    most: only so many sentences of each document, cut before they become rows.
    """
    spans = T.sentence_spans(F.col(text), lexicon)
    spans = F.slice(spans, 1, most) if most else spans
    rows = docs.withColumn("_s", F.explode(spans))
    return rows.select(*[c for c in docs.columns if c != text], F.col("_s.idx").alias("idx"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), F.col("_s.text").alias("sentence"))


def numbered(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``sentences`` without their places: the document's other columns, idx, sentence."""
    others = [c for c in docs.columns if c != text]
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(lexicon.sentence), 0), T.strip)  # stripped before they are rows: filters would repeat it for each term
    return docs.select(*others, F.posexplode(found).alias("idx", "sentence")).filter("sentence <> ''")


def has_anchor(sentence: Column, lexicon: Lexicon) -> Column:
    """Whether anything stands in the sentence that could give it a type: cheap, and true of every claim."""
    found = T.contains_any(sentence, dict.fromkeys((*lexicon.temporal, *lexicon.causal, *lexicon.entities, *lexicon.policy)))
    found = found | sentence.rlike("[0-9০-৯]") | sentence.rlike(lexicon.dates)
    return found | sentence.rlike(lexicon.organisations) if lexicon.organisations else found


def extract(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", headline: Column | None = None, min_confidence: float = S.MIN_CONFIDENCE, min_chars: int = S.MIN_CHARS, max_sentences: int | None = S.MAX_SENTENCES) -> DataFrame:
    """Claims of each document: sentences of enough length, of a type, and of enough (unrounded) confidence.

    max_sentences: only so many of each document are looked at; None looks at all.
    """
    base = docs.select(key, (F.lit("") if headline is None else headline).alias("headline"), F.col(text).alias("text"))
    rows = sentences(base, lexicon, key, "text", max_sentences) if max_sentences else numbered(base, lexicon)
    s = F.col("sentence")
    rows = rows.filter((F.length(s) >= min_chars) & has_anchor(s, lexicon))
    rows = rows.select(
        key, "headline", "idx", "sentence", T.entities(s, lexicon).alias("entities"), T.numbers(s).alias("numbers"), T.term_hits(s, lexicon.policy).alias("policies"), T.dates(s, lexicon).alias("dates"), F.size(T.words(s)).alias("n_words")
    )
    n = [F.size(c) for c in ("entities", "numbers", "policies", "dates")]
    rows = rows.withColumn("claim_type", S.claim_type(s, *n, lexicon))
    rows = rows.withColumn("raw_confidence", S.confidence(F.col("idx"), s, *n, F.col("n_words"), lexicon))
    # filters aren't pushed below a generator, so what they ask for is computed once
    rows = rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("c")).select("c.*")
    rows = rows.filter((F.col("claim_type") != "other") & (F.col("raw_confidence") >= min_confidence - 1e-9))
    return rows.withColumn("confidence", S.rounded(F.col("raw_confidence"))).drop("raw_confidence")


def score(claims: DataFrame, lexicon: Lexicon, max_risk: float = S.MAX_RISK) -> DataFrame:
    """The claims with their six scores, four decimals each."""
    kind, s = F.col("claim_type"), F.col("sentence")
    ne, nn, np, nd = (F.size(c) for c in ("entities", "numbers", "policies", "dates"))
    commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    quoted = s.contains("“") | s.contains('"')
    parts = claims.withColumns(
        {
            "_i": S.importance(F.col("confidence"), F.col("idx"), F.col("headline"), s, lexicon),
            "_e": S.editability(kind, ne, nn, np),
            "_v": S.feasibility(kind, ne + nn + np + nd),
            "_l": S.locality(F.col("n_words"), commas),
            "_r": S.risk(nn, ne, F.col("n_words"), quoted),
        }
    )
    total = S.overall(kind, *(F.col(c) for c in ("_i", "_e", "_l", "_v", "_r")), max_risk)
    names = {"_i": "importance", "_e": "editability", "_v": "verification", "_l": "locality", "_r": "risk"}
    return parts.select(*claims.columns, *[S.rounded(F.col(k)).alias(v) for k, v in names.items()], S.rounded(total).alias("overall"))


def ranked(scored: DataFrame, key: str = "doc_id", min_overall: float = S.MIN_OVERALL, max_risk: float = S.MAX_RISK) -> DataFrame:
    """Claims that pass the gate with their rank in the document, best first, ties to the earlier sentence."""
    order = Window.partitionBy(key).orderBy(F.desc("overall"), "idx")
    return scored.filter((F.col("overall") >= min_overall) & (F.col("risk") <= max_risk)).withColumn("rank", F.row_number().over(order))


def best(scored: DataFrame, key: str = "doc_id", min_overall: float = S.MIN_OVERALL, max_risk: float = S.MAX_RISK) -> DataFrame:
    """The first-ranked claim of each document.

    An aggregation, not a window: a document's sentences lie in one task, so
    one row a document reaches the shuffle, however many claims it has.
    """
    passed = scored.filter((F.col("overall") >= min_overall) & (F.col("risk") <= max_risk))
    others = [c for c in scored.columns if c != key]
    top = passed.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col("overall"), -F.col("idx"))).alias("_c"))
    return top.select(key, *[F.col(f"_c.{c}").alias(c) for c in others])


def first_valid(candidates: DataFrame, key: str, rank: str, error: str) -> DataFrame:
    """Of each key the candidate of the lowest rank whose error is null; where there is none, the last error.

    Returns key, found boolean, and either the candidate's struct or the error.
    """
    others = [c for c in candidates.columns if c != key]
    valid = F.col(error).isNull()
    return candidates.groupBy(key).agg(
        F.max(valid).alias("found"),
        F.min_by(F.when(valid, F.struct(*others)), F.when(valid, F.col(rank))).alias("candidate"),
        F.when(~F.max(valid), F.max_by(error, rank)).alias("last_error"),
    )


def normalize_rows(raw: DataFrame, column: str, max_claims: int = 20) -> DataFrame:
    """Claims from a model's JSON answers: alias keys, confidence clamped to [0, 1], rows without a claim rejected.

    Returns the other columns, claim struct, rejected boolean.
    """
    item = "struct<sentence_index:int,index:int,claim:string,claim_text:string,text:string,type:string,claim_type:string,confidence:double>"
    parsed = F.coalesce(F.from_json(column, f"array<{item}>"), F.from_json(column, f"struct<claims:array<{item}>>")["claims"])
    rows = raw.withColumn("_x", F.explode_outer(F.slice(parsed, 1, max_claims)))
    claim = F.coalesce("_x.claim_text", "_x.claim", "_x.text")
    kind = F.lower(F.coalesce("_x.claim_type", "_x.type", F.lit("other")))
    return rows.select(
        *[c for c in raw.columns if c != column],
        F.struct(
            F.coalesce("_x.sentence_index", "_x.index").alias("idx"), claim.alias("claim_text"), kind.alias("claim_type"), S.clamp(F.coalesce("_x.confidence", F.lit(0.5))).alias("confidence")
        ).alias("claim"),
        (claim.isNull() | (F.trim(claim) == "")).alias("rejected"),
    )
