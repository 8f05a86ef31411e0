"""Model roles as injected callables, run in Arrow batches.

A role is a zero-argument factory that a Python worker calls once; what it
returns is called with lists.  The fakes are deterministic, for tests.
"""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

Factory = Callable[[], Callable]


def perplexity_from_loss(loss: Column) -> Column:
    """exp of a language model's mean loss, which counts as 20 at most."""
    return F.exp(F.least(F.lit(20.0), loss))


def quality_from_fakes(mean_fake: Column) -> Column:
    """A discriminator's mean probability that a token is fake, on the scale of perplexities."""
    return 1.0 + 300.0 * mean_fake


def contradiction_index(labels: list[str]) -> int:
    """Which of a classifier's labels means contradiction: the one that says so, else the first."""
    return next((k for k, name in enumerate(labels) if "contradict" in name.lower()), 0)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def embed(factory: Factory, texts: Column, prefix: str = "", normalize: bool = False) -> Column:
    """list[str] -> vectors; each text gets the prefix, and each vector unit length if asked for."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            vectors = [list(map(float, v)) for v in model([prefix + t for t in s.fillna("").tolist()])]
            if normalize:
                vectors = [[x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v] for v in vectors]
            yield pd.Series(vectors)

    return run(texts)


def contradiction(factory: Factory, premises: Column, hypotheses: Column) -> Column:
    """(list[str], list[str]) -> probabilities."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for a, b in batches:
            yield pd.Series(model(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")

    return run(premises, hypotheses)


def perplexity(factory: Factory, texts: Column) -> Column:
    """list[str] -> perplexities."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            yield pd.Series(model(s.fillna("").tolist()), dtype="float64")

    return run(texts)


def generate(factory: Factory, prompts: Column, temperature: Column, seed: Column) -> Column:
    """(prompts, temperatures, seeds) -> texts; a row whose call fails gives null, others are not lost with it.

    A batch of several rows of which every one fails is an error: then the
    model is at fault, not the rows.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()

        def batch(p, t, s):
            try:
                return list(model(p, t, s))
            except Exception as error:
                if len(p) == 1:
                    failed.append(error)
                    return [None]
                h = len(p) // 2  # halve until the failing row stands alone
                return batch(p[:h], t[:h], s[:h]) + batch(p[h:], t[h:], s[h:])

        for p, t, s in batches:
            failed: list[Exception] = []
            out = batch(p.tolist(), t.tolist(), s.tolist())
            if len(failed) == len(p) > 1:
                raise failed[0]
            yield pd.Series(out)

    return run(prompts, temperature, seed)


@F.pandas_udf(ST.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def lexical_similarity(a: Column, b: Column) -> Column:
    """0.65 of the sequence ratio and 0.35 of the words' Jaccard, on normalised texts."""
    from ..functions import text as T

    flat = lambda c: F.lower(T.squeeze(F.regexp_replace(c, "[।!?;:,\\-—()\"'“”‘’]", " ")))
    x, y = flat(a), flat(b)
    ratio = sequence_ratio(x, y)
    return F.when((x == "") | (y == ""), 0.0).otherwise(F.round(F.least(F.lit(1.0), 0.65 * ratio + 0.35 * T.jaccard(F.array_distinct(T.words(x)), F.array_distinct(T.words(y)))), 4))


@F.pandas_udf(ST.StringType())
def json_payload(answers: pd.Series) -> pd.Series:
    """The JSON value in a model's answer, as compact JSON text; null if there is none."""
    decoder = json.JSONDecoder()

    def find(text):
        if text is None:
            return None
        bodies = [text.strip(), *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)]
        for body in bodies:
            for k in [0, *(m.start() for m in re.finditer(r"[{\[]", body))]:
                try:
                    value, _ = decoder.raw_decode(body[k:].lstrip())
                except ValueError:
                    continue
                if isinstance(value, (dict, list)):
                    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        return None

    return answers.map(find)


MENTIONS = ST.ArrayType(ST.StructType([ST.StructField("start", ST.IntegerType()), ST.StructField("end", ST.IntegerType()), ST.StructField("term", ST.StringType())]))


@F.pandas_udf(MENTIONS)
def longest_mentions(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """Dictionary mentions, longest terms first, the first occurrence of each that overlaps none accepted."""

    def find(text, words):
        taken, out = [], []
        for term in sorted(set(words if words is not None else ()), key=lambda t: (-len(t), t)):
            at = (text or "").find(term) if term else -1
            while at >= 0 and any(at < e and s < at + len(term) for s, e in taken):
                at = text.find(term, at + 1)
            if at >= 0:
                taken.append((at, at + len(term)))
                out.append({"start": at, "end": at + len(term), "term": term})
        return sorted(out, key=lambda m: m["start"])

    return pd.Series([find(t, w) for t, w in zip(texts, terms, strict=True)])


def fake_embedder():
    return lambda texts: [[float(len(t)), float(len(t.split())), float(sum(map(ord, t[:64])) % 97), 1.0] for t in texts]


def fake_nli():
    return lambda premises, hypotheses: [0.9 if p != h else 0.05 for p, h in zip(premises, hypotheses, strict=True)]


def fake_perplexity():
    return lambda texts: [20.0 + len(t) % 50 for t in texts]
