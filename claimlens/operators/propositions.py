"""Propositions that rules can edit, the best of each kind, and the rule edits.

Sentences and propositions are exploded in place; the best of a document is an
aggregation.  Every edited row keeps its label, family and the original's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import salience as X
from ..functions import text as T
from ..functions.lexicon import NUMBER, Lexicon
from ..functions.salience import Rewrites
from . import claims

# Families in order of priority, their difficulties' weights, and hops of each difficulty.
FAMILIES = ("policy_reversal", "numerical_fact_change", "entity_replacement", "temporal_shift", "causal_inversion")
HOPS = {"easy": 1, "medium": 2, "hard": 3}
DIFFICULTY = {"easy": 0.25, "medium": 0.45, "hard": 0.30}
FAMILY_DIFFICULTY = {
    "policy_reversal": {"easy": 0.65, "medium": 0.25, "hard": 0.10},
    "entity_replacement": {"easy": 0.45, "medium": 0.45, "hard": 0.10},
    "numerical_fact_change": {"easy": 0.05, "medium": 0.65, "hard": 0.30},
    "temporal_shift": {"easy": 0.05, "medium": 0.65, "hard": 0.30},
    "causal_inversion": {"easy": 0.0, "medium": 0.30, "hard": 0.70},
}
ROW = "array<struct<family:string,kind:string,start:int,end:int,span:string,replacement:string,score:double>>"


def chance(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts: the same for every order and partitioning."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def _row(family: str, kind: str, span: Column, replacement: Column | str, score: Column | float) -> Column:
    new = F.lit(replacement) if isinstance(replacement, str) else replacement
    value = F.lit(score) if isinstance(score, float) else score
    return F.struct(F.lit(family).alias("family"), F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["text"].alias("span"), new.alias("replacement"), value.alias("score"))


def number_spans(c: Column) -> Column:
    """array<struct<start, end, text>> of the text's numbers."""
    found = F.regexp_extract_all(c, F.lit(NUMBER), 0)
    parts = F.arrays_zip(F.slice(F.split(c, NUMBER, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("text"))
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["gap"]) + F.length(p["text"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(p["gap"])).alias("start"), (acc["at"] + F.length(p["gap"]) + F.length(p["text"])).alias("end"), p["text"].alias("text")))).alias("out"),
    )
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]


def propositions(docs: DataFrame, lexicon: Lexicon, words: Rewrites, key: str = "doc_id", text: str = "text", families: tuple[str, ...] = FAMILIES, places: bool = True) -> DataFrame:
    """key, sentence_start, idx, sentence, salience, family, kind, start, end, span, replacement, score of every proposition; offsets within the sentence.

    Families: numbers that are no years; policy phrases; known entities;
    relative times, years and months; causal connectors and outcomes.  A span
    counts once in a family.  Only the given families are looked for;
    without ``places`` there is no sentence_start.
    """
    base = docs.select(key, F.col(text).alias("text"))
    rows = claims.sentences(base, lexicon, key, "text").select(key, F.col("start").alias("sentence_start"), "idx", "sentence") if places else claims.numbered(base, lexicon)
    s = F.col("sentence")
    salience = X.salience(F.col("idx"), s, lexicon, words)
    spans = []

    def add(family: str, kind: str, source: str, target: str, score: float) -> None:
        there, place = X.phrase_place(s, source, lexicon, words.suffixes)
        spans.append((family, F.when(there, _row(family, kind, place, target, score))))  # one question for each phrase, in most sentences the only one

    for source, target in sorted(words.policies, key=lambda p: -len(p[0])):
        add("policy_reversal", "policy_action", source, target, X.PROPOSITION["policy_reversal"])
    for term in lexicon.entities:
        add("entity_replacement", "entity", term, "", round(0.70 + min(0.20, len(term) / 100), 4))
    year = F.regexp_extract(F.concat(F.lit(" "), s, F.lit(" ")), f"[^0-9০-৯]({X.YEAR})[^0-9০-৯]", 1)
    at = F.instr(s, year) - 1
    spans.append(("temporal_shift", F.when(X.has_year(s), _row("temporal_shift", "year", F.struct(at.alias("start"), (at + 4).alias("end"), year.alias("text")), "", X.PROPOSITION["year"]))))
    for kind, family, pairs in (
        ("relative_time", "temporal_shift", words.relative_times),
        ("month", "temporal_shift", words.month_pairs),
        ("causal_connector", "causal_inversion", sorted(words.connectors, key=lambda p: -len(p[0]))),
        ("causal_outcome", "causal_inversion", words.outcomes),
    ):
        for source, target in pairs:
            add(family, kind, source, target, X.PROPOSITION[kind])
    found = F.array_distinct(F.filter(F.array(F.lit(None), *[x for f, x in spans if f in families]), lambda p: p.isNotNull()).cast(ROW))
    if "numerical_fact_change" in families:

        def numbers(salient: Column) -> Column:
            amounts = F.filter(number_spans(s), lambda n: ~X.is_year_like(n["text"]))
            scored = F.transform(amounts, lambda n: _row("numerical_fact_change", "value", n, "", X.numeric_score(s, n["start"], n["end"], salient, lexicon, words)))
            return F.filter(scored, lambda p: p["score"] > 0).cast(ROW)

        found = F.concat(F.when(s.rlike("[0-9০-৯]"), T.let(salience, numbers)).otherwise(F.array().cast(ROW)), found)
    out = rows.withColumn("_p", F.explode(found)).withColumn("salience", salience)
    return out.select(*rows.columns, "salience", *[F.col(f"_p.{c}").alias(c) for c in ("family", "kind", "start", "end", "span", "replacement", "score")])


def best_of_family(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each document and family the proposition with the highest score, ties to the longer span, then the earlier sentence and place."""
    others = [c for c in found.columns if c not in (key, "family")]
    order = F.struct(F.col("score"), F.length("span"), -F.col("idx"), -F.col("start"), F.col("kind"))
    return found.groupBy(key, "family").agg(F.max_by(F.struct(*others), order).alias("_b")).select(key, "family", *[F.col(f"_b.{c}").alias(c) for c in others])


def replacements(chosen: DataFrame, lexicon: Lexicon, words: Rewrites, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """The propositions with their replacement filled in: numbers shifted, years moved, entities exchanged within their role."""
    dice = chance(F.col(key), F.col("family"), F.col("span"), F.lit(seed))
    number = X.shifted_number(F.col("span"), F.col("sentence"), dice, words)
    base = T.known_inside(F.col("span"), lexicon)
    role = T.entity_role(base, lexicon)
    peers = F.lit(None).cast("array<string>")
    for name, terms in lexicon.roles.items():
        peers = F.when(role == name, F.sort_array(F.array(*map(F.lit, terms)))).otherwise(peers)
    others = F.filter(peers, lambda t: t != base)
    pick = F.get(others, F.floor(dice * F.size(others)).cast("int"))
    ending = X.split_suffix(F.col("span"), base, words.suffixes)["suffix"]
    new = (
        F.when(F.col("replacement") != "", F.col("replacement"))
        .when(F.col("kind").isin("value", "year"), number)
        .when((F.col("kind") == "entity") & (F.size(others) > 0), F.concat(pick, ending))
    )
    return chosen.withColumn("replacement", F.coalesce(new, F.lit("")))


def apply_rules(docs: DataFrame, planned: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, family, idx, span, replacement, edited text, label 1 for every proposition with a replacement that differs from its span."""
    rows = docs.select(key, F.col(text).alias("text")).join(planned.filter("replacement <> '' AND replacement <> span"), key)
    body = F.col("sentence_start") + F.instr(F.substring(F.col("text"), F.col("sentence_start") + 1, F.length("text")), F.col("sentence")) - 1
    whole = T.splice(F.col("text"), body + F.col("start"), body + F.col("end"), F.col("replacement"))
    return rows.select(key, "family", "kind", "idx", "span", "replacement", whole.alias("rewritten"), F.lit(1).alias("label"))


def family_sequence(primary: str, counts: dict[str, int], hops: int) -> list[str]:
    """The families of a plan of several hops: the primary one, then each time the least used, then the one with most candidates."""
    available = [f for f in FAMILIES if counts.get(f)]
    if not counts.get(primary):
        return []
    out = [primary]
    while len(out) < hops:
        open_ones = [f for f in available if out.count(f) < counts[f]] or available
        out.append(min(open_ones, key=lambda f: (out.count(f), -counts[f], FAMILIES.index(f))))
    return out


def _draw(weights: dict[str, Column | float], dice: Column) -> Column:
    """A label with probability in proportion to its weight."""
    total = sum(weights.values(), F.lit(0.0))
    out, upto = F.lit(list(weights)[-1]), F.lit(0.0)
    bounds = []
    for name, w in weights.items():
        upto = upto + w
        bounds.append((name, upto / total))
    for name, bound in reversed(bounds[:-1]):
        out = F.when(dice < bound, name).otherwise(out)
    return out


def difficulty(family: Column, dice: Column, counts: dict[str, int] | None = None, targets: dict[str, float] | None = None) -> Column:
    """A difficulty drawn by the family's weights; with counts so far and targets, each weight is raised by what its target still lacks."""

    def factor(label: str) -> float:
        target = float((targets or {}).get(label, 0.0))
        return 1.0 if target <= 0 else 0.5 + 1.5 * max(target - float((counts or {}).get(label, 0)), 0.0) / target

    out = _draw({k: F.lit(v) for k, v in DIFFICULTY.items()}, dice)
    for name, weights in FAMILY_DIFFICULTY.items():
        out = F.when(family == name, _draw({k: F.lit(w * (factor(k) if targets else 1.0)) for k, w in weights.items()}, dice)).otherwise(out)
    return out


def hops(difficulty: Column) -> Column:
    out = F.lit(1)
    for name, n in HOPS.items():
        out = F.when(difficulty == name, n).otherwise(out)
    return out


def multi_hop(docs: DataFrame, lexicon: Lexicon, words: Rewrites, most: int = 3, key: str = "doc_id", text: str = "text", seed: int = 42, settle=None) -> DataFrame:
    """key, rewritten, hops, families: each document edited by up to ``most`` rules of different families, one after the other.

    Each hop finds propositions in the text that the hops before have left, and
    edits the best of the families that weren't used yet, in order of
    priority.  A document without any is left out.  ``settle`` makes a hop
    durable (by default checkpoint()); the loop is bounded by ``most``.
    """
    settle = settle or (lambda df: df.checkpoint())
    state = docs.select(key, F.col(text).alias("text"), F.array().cast("array<string>").alias("families"))
    for _ in range(most):
        found = best_of_family(propositions(state, lexicon, words, key), key)
        planned = replacements(found, lexicon, words, key, seed).filter("replacement <> '' AND replacement <> span")
        fresh = planned.join(state.select(key, "families"), key).filter(~F.array_contains("families", F.col("family"))).drop("families")
        rank = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
        others = [c for c in fresh.columns if c != key]
        first = fresh.groupBy(key).agg(F.min_by(F.struct(*others), rank).alias("_f")).select(key, *[F.col(f"_f.{c}").alias(c) for c in others])
        edited = apply_rules(state, first, key).select(key, "rewritten", "family")
        joined = state.join(edited, key, "left")
        state = settle(joined.select(key, F.coalesce("rewritten", "text").alias("text"), F.when(F.col("family").isNotNull(), F.array_append("families", F.col("family"))).otherwise(F.col("families")).alias("families")))
    return state.filter(F.size("families") > 0).select(key, F.col("text").alias("rewritten"), F.size("families").alias("hops"), "families")


def mentions_in_sentences(mentions: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds idx: the sentence whose range holds a mention's start; the key is part of the join, so it is one of equality."""
    s = sentences.select(key, "idx", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return mentions.join(s, key).filter((F.col("start") >= F.col("_s")) & (F.col("start") < F.col("_e"))).drop("_s", "_e")
