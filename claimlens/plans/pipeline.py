"""The claim pipeline: articles to verified edit samples and failures.

Stages: extract and rank claims, plan (an injected planner or the heuristic
one), check, edit, verify, retry.  Every stage is a DataFrame; attempts are a
bounded loop on the driver over what is still pending.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions.lexicon import Lexicon
from ..operators import adapters, claims, dataset, edits, verify

# How reasons begin that another temperature can't mend, and those that it may.
DETERMINISTIC = ("intended_change", "locality", "text_quality", "journalistic_style", "hallucination", "new_facts")
BY_MODEL = ("embedding", "nli", "perplexity", "duplicate")

Rewriter = Callable[[DataFrame, int, float], DataFrame]


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    attempts: int = 3
    temperature: float = 0.4
    temperature_step: float = 0.15
    most_temperature: float = 0.85
    #: Sentences of each article that are looked at; None: all.
    max_sentences: int | None = S.MAX_SENTENCES


def plans(articles: DataFrame, lexicon: Lexicon, planner: Callable[[DataFrame], DataFrame] = edits.heuristic_plan, settle: Callable[[DataFrame], DataFrame] = lambda df: df, max_sentences: int | None = S.MAX_SENTENCES) -> tuple[DataFrame, DataFrame]:
    """(planned articles, failures): each article's first claim in rank order whose plan is valid and executable."""
    found = claims.extract(articles, lexicon, "article_id", "text", F.col("headline"), max_sentences=max_sentences)
    scored = claims.ranked(claims.score(found, lexicon), "article_id")
    proposed = planner(scored.drop("headline"))
    missing = F.when(F.length(T.strip(F.col("target_span"))) == 0, "plan_missing_target_span")
    checked = edits.check_plans(proposed, lexicon).withColumn("plan_error", F.coalesce("plan_error", missing))
    chosen = settle(claims.first_valid(settle(checked), "article_id", "rank", "plan_error"))  # read three times
    good = articles.join(chosen.filter("found").select("article_id", "candidate.*"), "article_id")
    planned = dataset.seeds(good.drop("plan_error"), "article_id", 42)
    failed = chosen.filter("NOT found").select("article_id", F.lit("no_valid_plan").alias("reason"), F.col("last_error").alias("error"))
    without = articles.join(chosen, "article_id", "left_anti").select("article_id", F.lit("no_claim").alias("reason"), F.lit(None).cast("string").alias("error"))
    return planned, failed.unionByName(without)


def temperature(settings: Settings, attempt: int) -> float:
    return min(settings.temperature + settings.temperature_step * (attempt - 1), settings.most_temperature)


def rolls_back(failed: DataFrame) -> bool:
    """Whether only rules failed the pairs, no model: then the next attempt keeps the temperature of this one."""
    begins = lambda names: F.coalesce(F.max(F.col("r").rlike("^(?:" + "|".join(names) + ")")), F.lit(False))
    found = failed.select(F.explode("report.reasons").alias("r")).agg(begins(DETERMINISTIC).alias("rules"), begins(BY_MODEL).alias("models")).first()
    return found["rules"] and not found["models"]


def controlled(lexicon: Lexicon) -> Rewriter:
    """Edits that a plan spells out in full need no model."""
    return lambda rows, attempt, heat: edits.apply_plan(rows, lexicon)


def run(
    articles: DataFrame,
    lexicon: Lexicon,
    planner: Callable[[DataFrame], DataFrame] = edits.heuristic_plan,
    rewriter: Rewriter | None = None,
    nli: adapters.Factory = adapters.fake_nli,
    perplexity: adapters.Factory = adapters.fake_perplexity,
    settings: Settings = Settings(),
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(samples, failures).  ``settle`` makes a stage durable (by default checkpoint())."""
    settle = settle or (lambda df: df.checkpoint())
    attempts = settings.attempts if rewriter else 1  # a controlled edit is the same at each attempt, and so are its verdicts
    rewriter = rewriter or controlled(lexicon)
    planned, failures = plans(articles, lexicon, planner, settle, settings.max_sentences)
    pending, accepted, last = settle(planned), None, None
    for attempt in range(1, attempts + 1):
        heat = temperature(settings, attempt - 1 if attempt > 1 and rolls_back(last) else attempt)
        edited = rewriter(pending, attempt, heat)
        spans = T.sentence_spans(F.coalesce("rewritten", F.lit("")), lexicon)
        judged = settle(edited.withColumn("_y", T.target_sentence(spans, F.col("idx"))))  # models take plain columns, not expressions with nested lambdas
        judged = judged.withColumns({"nli": adapters.contradiction(nli, F.col("sentence"), F.col("_y")), "perplexity": adapters.perplexity(perplexity, F.coalesce("rewritten", F.lit("")))}).drop("_y")
        judged = settle(judged)  # models run once
        done = settle(verify.verify_pairs(judged, lexicon).withColumns({"attempt": F.lit(attempt), "temperature": F.lit(heat)}))
        ok = done.filter("edit_error IS NULL AND report.passed")
        accepted = ok if accepted is None else accepted.unionByName(ok)
        last = done.filter("NOT (edit_error IS NULL AND report.passed)")
        if attempt == attempts or last.isEmpty():
            break
        pending = last.select(*pending.columns)
    samples = accepted.withColumns(
        {
            "sample_id": T.sample_id(F.col("article_id"), F.col("idx"), F.col("family"), F.col("sample_seed")),
            "original_id": F.col("article_id"),
            "edit_family": F.col("family"),
            "label": F.lit(1),
            "context": T.context_window(F.col("text"), T.sentence_spans(F.col("text"), lexicon), F.col("idx")),
            "rewritten_sentence": T.target_sentence(T.sentence_spans(F.col("rewritten"), lexicon), F.col("idx")),
            "rewritten_context": T.context_window(F.col("rewritten"), T.sentence_spans(F.col("rewritten"), lexicon), F.col("idx")),
        }
    )
    rejected = last.select("article_id", F.lit("verification_failed").alias("reason"), F.coalesce("edit_error", F.array_join("report.reasons", ",")).alias("error"))
    return samples, failures.unionByName(rejected)
