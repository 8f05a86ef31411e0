"""Pieces of DuckDB SQL that say the same as the text functions; only the oracles use them."""

from __future__ import annotations

from .functions.lexicon import NUMBER, Lexicon
from .functions.text import SPACE


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda w: w <> '')"


def contains_any(x: str, terms) -> str:
    return "(" + (" OR ".join(f"contains({x}, {lit(t)})" for t in terms) or "FALSE") + ")"


def hits(x: str, terms) -> str:
    all_hits = ", ".join(f"{{'pos': strpos({x}, {lit(t)}), 'term': {lit(t)}}}" for t in dict.fromkeys(terms))
    return f"list_transform(list_sort(list_filter([{all_hits}], lambda h: h.pos > 0)), lambda h: h.term)"


def numbers(x: str) -> str:
    return f"regexp_extract_all({x}, '{NUMBER}')"


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


def sentences(lexicon: Lexicon, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs that end in s(key, idx, start, end, sentence)."""
    by = f"OVER (PARTITION BY {key} ORDER BY k ROWS UNBOUNDED PRECEDING)"
    return f"""
    m AS (SELECT {key}, length(regexp_extract({text}, '^[{lexicon.terminators}]+')) AS lead, regexp_extract_all({text}, '{lexicon.sentence}') AS a FROM {table}),
    e AS (SELECT {key}, lead, unnest(a) AS x, generate_subscripts(a, 1) AS k FROM m),
    s AS (SELECT {key}, (k - 1)::INTEGER AS idx, (lead + sum(length(x)) {by} - length(x))::INTEGER AS "start", (lead + sum(length(x)) {by})::INTEGER AS "end", {strip("x")} AS sentence
          FROM e QUALIFY sentence <> '')"""


def claims(lexicon: Lexicon) -> str:
    """CTEs that end in c, the claims with their scores, of documents; the headline is the first 60 characters."""
    temporal = f"({contains_any('sentence', lexicon.temporal)} OR regexp_matches(sentence, '(?:19|20)[0-9]{{2}}') OR regexp_matches(sentence, '{lexicon.dates}'))"
    financial, causal = contains_any("sentence", lexicon.financial), contains_any("sentence", lexicon.causal)
    clamp = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
    r4 = lambda x: f"round(({x})::DOUBLE + 1e-9, 4)"
    return f"""
    {sentences(lexicon)},
    f AS (
        SELECT s.doc_id, idx, sentence, left(d.text, 60) AS headline, {hits("sentence", lexicon.entities)} AS entities, {numbers("sentence")} AS numbers,
               {hits("sentence", lexicon.policy)} AS policies, regexp_extract_all(sentence, '{lexicon.dates}') AS dates, len({words("sentence")}) AS n_words,
               {temporal} AS temporal, {financial} AS financial, {causal} AS causal
        FROM s JOIN documents d ON s.doc_id = d.doc_id WHERE length(sentence) >= 18
    ),
    g AS (
        SELECT *, len(entities) AS ne, len(numbers) AS nn, len(policies) AS np, len(dates) AS nd,
               CASE WHEN len(numbers) > 0 AND NOT (temporal AND NOT financial) THEN 'numerical' WHEN causal THEN 'causal' WHEN len(entities) > 0 THEN 'entity'
                    WHEN len(dates) > 0 OR temporal THEN 'temporal' WHEN len(policies) > 0 THEN 'policy' ELSE 'other' END AS claim_type
        FROM f
    ),
    h AS (
        SELECT *, {clamp('''0.10::DOUBLE + greatest(0.0::DOUBLE, 0.22::DOUBLE - 0.025::DOUBLE * least(idx, 8)) + CASE WHEN financial THEN 0.18::DOUBLE ELSE 0 END
               + least(0.18::DOUBLE, 0.06::DOUBLE * ne) + least(0.18::DOUBLE, 0.06::DOUBLE * nn) + least(0.16::DOUBLE, 0.08::DOUBLE * np) + least(0.12::DOUBLE, 0.06::DOUBLE * nd)
               + CASE WHEN causal THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN n_words < 5 THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN n_words > 80 THEN 0.08::DOUBLE ELSE 0 END''')} AS raw,
               list_distinct({words("headline")}) AS head, length(sentence) - length(replace(sentence, ',', '')) AS commas,
               contains(sentence, '“') OR contains(sentence, '"') AS quoted
        FROM g WHERE claim_type <> 'other'
    ),
    i AS (
        SELECT *, {r4("raw")} AS confidence, CASE claim_type WHEN 'numerical' THEN 0.94::DOUBLE WHEN 'causal' THEN 0.88 WHEN 'entity' THEN 0.82 WHEN 'temporal' THEN 0.76 ELSE 0.72 END
               - CASE WHEN claim_type = 'entity' AND ne < 1 THEN 0.20::DOUBLE WHEN claim_type = 'numerical' AND nn < 1 THEN 0.25 WHEN claim_type = 'policy' AND np < 1 THEN 0.25 ELSE 0 END AS e0,
               0.35::DOUBLE + least(0.45::DOUBLE, 0.10::DOUBLE * (ne + nn + np + nd)) + CASE WHEN claim_type IN ('numerical', 'policy', 'temporal') THEN 0.15::DOUBLE WHEN claim_type = 'causal' THEN 0.08 ELSE 0 END AS v0,
               0.92::DOUBLE - (CASE WHEN n_words > 45 THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN n_words > 75 THEN 0.22::DOUBLE ELSE 0 END) - least(0.20::DOUBLE, 0.04::DOUBLE * greatest(0, commas - 2)) AS l0,
               0.12::DOUBLE + least(0.35::DOUBLE, 0.08::DOUBLE * greatest(0, nn - 2)) + least(0.25::DOUBLE, 0.06::DOUBLE * greatest(0, ne - 3)) + CASE WHEN n_words > 90 THEN 0.20::DOUBLE ELSE 0 END
               + CASE WHEN quoted THEN 0.15::DOUBLE ELSE 0 END AS r0
        FROM h WHERE raw >= 0.35 - 1e-9
    ),
    j AS (
        SELECT *, {clamp("e0")} AS e1, {clamp("v0")} AS v1, {clamp("l0")} AS l1, {clamp("r0")} AS r1,
               {clamp(f'''confidence * 0.45::DOUBLE + greatest(0.0::DOUBLE, 0.28::DOUBLE - 0.03::DOUBLE * least(idx, 8))
               + CASE WHEN len(head) > 0 THEN least(0.18::DOUBLE, len(list_intersect(head, {words("sentence")}))::DOUBLE / len(head)) ELSE 0 END + CASE WHEN financial THEN 0.09::DOUBLE ELSE 0 END''')} AS i1
        FROM i
    ),
    k AS (
        SELECT *, 0.35::DOUBLE * i1 + 0.25::DOUBLE * e1 + 0.20::DOUBLE * l1 + 0.20::DOUBLE * v1
               + CASE claim_type WHEN 'numerical' THEN 0.08::DOUBLE WHEN 'causal' THEN 0.06 WHEN 'entity' THEN 0.04 WHEN 'temporal' THEN 0.02 ELSE 0 END AS t0
        FROM j
    ),
    c AS (
        SELECT doc_id, idx, sentence, claim_type, {joined("entities")} AS entities, {joined("numbers")} AS numbers, {joined("policies")} AS policies, {joined("dates")} AS dates, n_words::INTEGER AS n_words,
               confidence, {r4("i1")} AS importance, {r4("e1")} AS editability, {r4("v1")} AS verification, {r4("l1")} AS locality, {r4("r1")} AS risk,
               {r4(clamp("CASE WHEN r1 > 0.72 THEN t0 * 0.70::DOUBLE ELSE t0 END"))} AS overall
        FROM k
    )"""
