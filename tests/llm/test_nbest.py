"""The N-best search on ties and long runs, and its segmentations and decoded texts as columns."""

import random
import time
import zlib

import numpy as np
from claimlens.llm import nbest, pieces
from claimlens.llm import queries as Q

PATH = Q.tokenizer_path("piece_bpe_32k.model")


def _first(run, vocab, n):
    """The n best by plain recursion over all segmentations of prefixes, in the search's order."""
    unknown = nbest.unknown_score(vocab)
    best = [[(0.0, ())]]
    for end in range(1, len(run) + 1):
        own = []
        for length in range(1, end + 1):
            p = run[end - length : end]
            if p in vocab.score or length == 1:
                own += [(s - vocab.score.get(p, unknown), (length, *k)) for s, k in best[end - length]]
        best.append(sorted(own)[: 4 * n])
    return best[-1][:n]


def test_search_agrees_with_recursion():
    vocab, rng = pieces.vocabulary(PATH), random.Random(3)
    unknown = nbest.unknown_score(vocab)
    for _ in range(400):
        run = "".join(rng.choice("▁aehinrt☃") for _ in range(rng.randint(1, 14)))
        want = [-s for s, _ in _first(run, vocab, 6)]
        found = nbest.search(run, vocab, unknown)
        got = [next(found, None) for _ in want]
        assert np.allclose([s for s, _ in got], want), run
        assert len({k for _, k in got}) == len(got) and all(sum(k) == len(run) for _, k in got)


def test_first_two_are_the_searchs():
    vocab, rng = pieces.vocabulary(PATH), random.Random(4)
    words = nbest._Words(vocab, "▁", 4)
    for _ in range(400):
        word = "".join(rng.choice("aehinrt一é-") for _ in range(rng.randint(0, 12)))
        k = words[word]
        got = nbest.run_nbest("▁" + word, vocab, 2, words.unknown)
        assert np.isclose(words.best[k], got[0][0])
        assert np.isclose(words.loss[k], got[0][0] - got[1][0]) if len(got) > 1 else words.loss[k] == np.inf
        assert np.frombuffer(words.raw[k], np.uint32).tolist() == nbest.piece_ids(got[0][1], vocab)


def test_long_run_of_one_letter():
    encoder, text = nbest.Encoder(PATH), "a" * 100_000
    began = time.time()
    scores, raw = encoder.encode(text)
    assert time.time() - began < 60
    assert len(scores) == 4 and [s for s, _ in scores] == sorted((s for s, _ in scores), reverse=True)
    assert nbest.decode(np.frombuffer(raw, np.uint32).tolist(), encoder.vocab) == text


def test_segmentations_and_decoded_texts(spark):
    texts = [(1, "the then  a☃ in"), (2, None), (3, ""), (None, "x, y."), (3, "x, y.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = nbest.encode(docs, PATH).collect()
    encoder = nbest.Encoder(PATH)
    assert len(rows) == len(texts)
    for r in rows:
        text = "".join(r.pieces[0]).replace("▁", " ")[1:]
        assert (r.doc_id, text) in {(i, t or "") for i, t in texts}
        assert len({tuple(p) for p in r.pieces}) == len(r.pieces)
        assert np.allclose(r.scores, [s for s, _ in encoder.encode(text)[0]])
        assert all("".join(p) == "".join(r.pieces[0]) for p in r.pieces)
    back = nbest.decode_ids(nbest.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in texts)


def test_query_encodes_and_decodes_every_segmentation(spark):
    texts = [(1, "the then  a☃ in"), (2, None), (3, ""), (4, "x, y."), (5, "therein the rain, then another one"), (6, "▁a  é一")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    encoder = nbest.Encoder(PATH)
    rows = {r.doc_id: r for r in nbest.nbest(docs, PATH).collect()}
    whole = {r.doc_id: r for r in nbest.encode(docs, PATH).collect()}
    for i, text in texts:
        found = encoder.segmentations(text or "")
        ids = [nbest.piece_ids(p, encoder.vocab) for _, p in found]
        assert np.allclose(rows[i].scores, [s for s, _ in found])
        assert rows[i].nbest_crc32 == [zlib.crc32(np.array(k, "<u4").tobytes()) for k in ids]
        assert rows[i].piece_counts == list(map(len, ids)) and rows[i].ids_crc32 == rows[i].nbest_crc32[0]
        assert whole[i].nbest_ids == ids and whole[i].ids == ids[0]
        assert rows[i].decodes and {nbest.decode(k, encoder.vocab) for k in ids} == {(text or "").replace("▁", " ")}
