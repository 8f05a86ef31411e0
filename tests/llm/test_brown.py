"""The class model against plain Python: probabilities, scores, and moves that raise the likelihood."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from claimlens.llm import brown_lm as B

END = "</s>"


def _rows():
    rng = random.Random(11)
    nouns, verbs = [f"n{i}" for i in range(12)], [f"v{i}" for i in range(9)]
    rows = []
    for k in range(120):
        words = []
        for _ in range(rng.randint(0, 30)):
            words += [rng.choice(("the", "a")), rng.choice(nouns), rng.choice(verbs)]
            if rng.random() < 0.05:
                words.append(f"rare{rng.randrange(40)}")
        rows.append((k, " ".join(words)))
    return [*rows, (200, None), (201, "the nowhere a n1"), (201, "the nowhere a n1")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), "doc_id long, text string")


def _tokens(text):
    return [*(text or "").lower().split(), END]


def _held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("core", [B.CORE, 8])
def test_scores_are_the_models(docs, monkeypatch, core):
    """With every word in the core, and with most of them outside."""
    monkeypatch.setattr(B, "CORE", core)
    monkeypatch.setattr(B, "SEEDS", min(core, 6))
    count = collections.Counter(t for i, x in _rows() if not _held(i) for t in _tokens(x))
    fitted = B.fit(docs)
    assert fitted.total == sum(count.values())
    of = {}
    for r in fitted.sequences.select("key", "classes").collect():
        for text in {x for i, x in _rows() if i == r.key}:
            for t, c in zip(_tokens(text), r.classes, strict=True):
                assert of.setdefault(t, c) == c
    assert all((of[t] == B.UNKNOWN) == (not count[t]) for t in of) and of[END] == B.END_CLASS
    move, size, unseen = fitted.model()
    assert np.allclose((10.0**move).sum(1), 1)
    d = fitted.discount
    inside = collections.Counter()
    for t, n in count.items():
        inside[of[t]] += (n - d) / 10 ** size[of[t]] if t != END else 1
    for c in set(of.values()) - {B.UNKNOWN}:
        assert math.isclose(inside[c] + unseen[c], 1, rel_tol=1e-9)  # known words and the unknown one
    got = {r.doc_id: r for r in B.score(docs).collect()}
    for i, text in _rows():
        before, want = B.END_CLASS, 0.0
        for t in _tokens(text):
            c = of[t]
            if c == B.UNKNOWN:
                joint = 10.0 ** move[before] * unseen
                want, before = want + math.log10(joint.sum()), int(np.argmax(joint))
                continue
            want += move[before, c] + (0 if t == END else math.log10((count[t] - d) / 10 ** size[c]))
            before = c
        assert math.isclose(got[i].score, want, rel_tol=1e-9, abs_tol=1e-9), text
    assert sum(got[i].score for i, _ in _rows()) > sum(got[i].base_score for i, _ in _rows())


def test_words_of_a_kind_share_classes(docs):
    fitted = B.fit(docs)
    of = {}
    for r in fitted.sequences.select("key", "classes").collect():
        for t, c in zip(_tokens(dict(_rows())[r.key]), r.classes, strict=True):
            of[t] = c
    nouns, verbs = ({of[f"{k}{i}"] for i in range(n)} for k, n in (("n", 12), ("v", 9)))
    assert not nouns & verbs


def test_moves_raise_the_likelihood():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 4, 300)
    pairs = rng.random((4, 4)) ** 3
    tokens = [0]
    for _ in range(60_000):
        p = pairs[kinds[tokens[-1]]][kinds]
        tokens.append(int(rng.choice(300, p=p / p.sum())))
    tokens = np.array(tokens)
    side = B.CLASSES + 1

    def contexts(of):
        out = np.zeros((300, B.WIDTH))
        np.add.at(out, (tokens[1:], of[tokens[:-1]]), 1)
        np.add.at(out, (tokens[:-1], side + of[tokens[1:]]), 1)
        return out

    def likelihood(of):
        t = np.zeros((side, side))
        np.add.at(t, (of[tokens[:-1]], of[tokens[1:]]), 1)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    of = rng.integers(0, 4, 300)
    first = last = likelihood(of)
    for _ in range(6):
        of = B.move_all(contexts(of), of)
        last = likelihood(of)
    assert last - first > 0.7 * (likelihood(kinds) - first) > 0  # most of the way to the classes that made the text
