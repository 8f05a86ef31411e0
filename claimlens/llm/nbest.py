"""SentencePiece encoding and decoding: the N best segmentations of whole texts.

A lattice has an edge for each piece that a run of characters holds, and for
each character that is no piece an unknown edge.  A forward Viterbi pass gives
the best score of every prefix; it is the exact heuristic of an A-star search
that goes backward from the end, which therefore yields segmentations best
first.  Of equal scores, the one whose pieces, read from the end, are shorter
first comes first.

With an exact heuristic the search's first result is the Viterbi path, and its
second one leaves that path by the edge that loses least; both are read off the
forward pass.  Only words whose further segmentations can enter a text's N best
are searched with the heap.  A text's N best are put together from its words'
N best: all of them deviate from the best segmentation only in the N - 1 words
with the least loss of a second segmentation; of equal losses and scores, the
earlier word's deviation comes first.

A search keeps for each open entry only the segmentation that it leaves, where,
and by which edge, so long runs cost memory in proportion to their length.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of
from .pieces import NONE, SPACE, Vocabulary, units, vocabulary

BEST = 4
#: An unknown character scores this much less than the lowest-scoring piece that isn't a space run.
UNKNOWN_PENALTY = 10.0
#: In place of an id: the edge of a character that is no piece.
NO_PIECE = -1
#: Bytes, by estimate, of the words that a worker keeps; beyond them the cache starts anew.
CACHE_BYTES, WORD_BYTES = 320_000_000, 360


def unknown_score(vocab: Vocabulary) -> float:
    return min((s for p, s in vocab.score.items() if p.strip(SPACE)), default=0.0) - UNKNOWN_PENALTY


def _edges(run: str, vocab: Vocabulary, unknown: float):
    """(last place, (length, score, id)) of every edge, by place; of equal places longer ones first."""
    matches = vocab.matcher.iter(run)
    if not vocab.score.keys() >= set(run):
        own = [(i, (1, unknown, NO_PIECE)) for i, c in enumerate(run) if c not in vocab.score]
        return sorted([*matches, *own], key=lambda m: (m[0], -m[1][0]))
    return matches


class _Open:
    """An entry of the search: it leaves a found segmentation after some pieces (from the end) by its place's k-th best edge."""

    __slots__ = ("after", "behind", "f", "found", "k", "leaves", "length", "place")

    def __init__(self, f: float, found: list, leaves: int, after: int, place: int, behind: float, k: int, length: int):
        self.f, self.found, self.leaves, self.after, self.place, self.behind, self.k, self.length = f, found, leaves, after, place, behind, k, length

    def __lt__(self, other: _Open) -> bool:
        if self.f != other.f:
            return self.f < other.f
        # by the first piece in which the two differ
        at = min(self.after, other.after, _shared(self.found, self.leaves, other.leaves))
        return self.piece(at) < other.piece(at)

    def piece(self, at: int) -> int:
        return self.length if at == self.after else self.found[self.leaves][0][at]


def _shared(found: list, a: int, b: int) -> int:
    """How many pieces from the end two found segmentations share.  found: (lengths, the one it left, after how many pieces)."""
    out = len(found[a][0])
    while a != b:
        a, b = max(a, b), min(a, b)
        _, a, after = found[a]
        out = min(out, after)
    return out


def search(run: str, vocab: Vocabulary, unknown: float):
    """(score, lengths of the pieces from the end) of one run's segmentations, best first."""
    size = len(run)
    best = [0.0] + [NONE] * size  # of every prefix
    edges: list[list[tuple[float, int, float]]] = [[] for _ in best]  # by end: (minus best score over this edge, length, score)
    for last, (length, s, _) in _edges(run, vocab, unknown):
        end = last + 1
        over = best[end - length] + s
        edges[end].append((-over, length, s))
        if over > best[end]:
            best[end] = over
    for own in edges:
        own.sort()
    found: list[tuple[list[int], int, int]] = []
    heap: list[_Open] = []
    f, lengths, place, behind, left, after = -best[size], [], size, 0.0, 0, 0
    while True:
        number, opened = len(found), []
        while place:  # the best edge at each place; the heuristic being exact, these would be popped next
            own = edges[place]
            if len(own) > 1:
                opened.append(_Open(own[1][0] - behind, found, number, len(lengths), place, behind, 1, own[1][1]))
            _, length, s = own[0]
            lengths.append(length)
            place, behind = place - length, behind + s
        found.append((lengths, left, after))
        for e in opened:
            heappush(heap, e)
        yield -f, tuple(lengths)
        if not heap:
            return
        e = heappop(heap)
        own = edges[e.place]
        if e.k + 1 < len(own):
            heappush(heap, _Open(own[e.k + 1][0] - e.behind, found, e.leaves, e.after, e.place, e.behind, e.k + 1, own[e.k + 1][1]))
        f, left, after = e.f, e.leaves, e.after
        lengths = [*found[left][0][:after], e.length]
        place, behind = e.place - e.length, e.behind + own[e.k][2]


def cut(run: str, lengths: tuple[int, ...]) -> list[str]:
    """The pieces of a run, given their lengths from the end."""
    pieces, at = [], len(run)
    for length in lengths:
        pieces.append(run[at - length : at])
        at -= length
    return pieces[::-1]


def run_nbest(run: str, vocab: Vocabulary, n: int = BEST, unknown: float | None = None) -> list[tuple[float, list[str]]]:
    """Up to n (score, pieces) of one run, best first."""
    found = search(run, vocab, unknown_score(vocab) if unknown is None else unknown)
    return [(score, cut(run, lengths)) for score, lengths in islice(found, n)]


def piece_ids(pieces: list[str], vocab: Vocabulary) -> list[int]:
    """Ids; characters that are no piece become their bytes' pieces, or the unknown id."""
    out = []
    for p in pieces:
        if p in vocab.ids:
            out.append(vocab.ids[p])
        elif vocab.bytes:
            out += [vocab.bytes[b] for b in p.encode()]
        else:
            out.append(vocab.unknown)
    return out


def decode(ids: list[int], vocab: Vocabulary) -> str:
    """The text that the ids stand for, without the leading space that encoding adds."""
    of_byte = {i: b for b, i in vocab.bytes.items()}
    raw = b"".join(bytes([of_byte[i]]) if i in of_byte else vocab.piece[i].encode() for i in ids)
    return raw.decode(errors="replace").replace(SPACE, " ")[1:]


def combine(parts: list[list[tuple[float, list]]], n: int) -> list[tuple[float, list[int]]]:
    """The n best sums of one choice from each part, with the numbers of the choices; parts' choices are best first.

    Only parts with the n - 1 least losses of a second choice can deviate.
    """
    loss = sorted((p[0][0] - p[1][0], i) for i, p in enumerate(parts) if len(p) > 1)[: n - 1]
    out = [(sum(p[0][0] for p in parts), [0] * len(parts))]
    for _, i in sorted(loss, key=lambda x: x[1]):
        p = parts[i]
        out = sorted(((s + c[0] - p[0][0], [*k[:i], j, *k[i + 1 :]]) for s, k in out for j, c in enumerate(p)), key=lambda x: -x[0])[:n]
    return out


class _Words(dict):
    """Number of a word in the tables of what is known about words; missing ones are searched.

    The tables hold the best score, the loss of the second segmentation and
    the best one's ids; further segmentations are searched when a text needs them.
    """

    def __init__(self, vocab: Vocabulary, lead: str, n: int):
        super().__init__()
        self.vocab, self.lead, self.n, self.unknown = vocab, lead, n, unknown_score(vocab)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.deep: dict[str, list[tuple[float, list[str]]]] = {}
        self.raw: list[bytes] = []
        self.best, self.loss = array("d"), array("d")
        self.held = 0

    def __missing__(self, word: str) -> int:
        unit = self.lead + word
        size = len(unit)
        best = [0.0] + [NONE] * size  # of every prefix, its second best last edge, and its best one
        second, edge = [NONE] * (size + 1), [(0, 0.0, 0)] * (size + 1)
        for last, own in _edges(unit, self.vocab, self.unknown):
            last += 1
            over = best[last - own[0]] + own[1]
            if over >= best[last]:
                second[last], best[last], edge[last] = best[last], over, own
            elif over > second[last]:
                second[last] = over
        ids, loss, place = [], np.inf, size
        while place:
            if best[place] - second[place] < loss:
                loss = best[place] - second[place]
            length, _, i = edge[place]
            if i == NO_PIECE:
                ids += piece_ids([unit[place - 1]], self.vocab)[::-1]
            else:
                ids.append(i)
            place -= length
        ids.reverse()
        raw = array("I", ids).tobytes()
        self.held += WORD_BYTES + 4 * size + len(raw)
        self.best.append(best[size])
        self.loss.append(loss)
        self.raw.append(raw)
        self[word] = number = len(self.raw) - 1
        return number

    def choices(self, word: str) -> list[tuple[float, list[str]]]:
        """(score, pieces) of the word's n best segmentations."""
        got = self.deep.get(word)
        if got is None:
            parts = [run_nbest(r, self.vocab, self.n, self.unknown) for r in self.vocab.runs(self.lead + word)]
            got = self.deep[word] = [(s, [p for part, k in zip(parts, picks, strict=True) for p in part[k][1]]) for s, picks in combine(parts, self.n)]
            self.held += len(got) * (WORD_BYTES + 80 * len(word))
        return got


def between(shared: list[bytes], own: list[bytes]) -> bytes:
    """shared[0], own[0], shared[1], ... end to end."""
    return b"".join([x for two in zip(shared, [*own, b""], strict=True) for x in two])


class Encoder:
    """N-best scores of texts and the ids of the best segmentation."""

    def __init__(self, path: str, n: int = BEST):
        vocab = vocabulary(path)
        self.vocab, self.n = vocab, n
        self.word, self.unit = _Words(vocab, SPACE, n), _Words(vocab, "", n)

    def _words(self, text: str) -> tuple[list[str], _Words]:
        """A text's words and the tables for them."""
        if self.word.held + self.unit.held > CACHE_BYTES:
            self.word.forget()
            self.unit.forget()
        words = text.split(" ")
        return (units(text), self.unit) if "" in words or SPACE in text else (words, self.word)

    def _near(self, words: list[str], known: _Words, at: np.ndarray) -> list[int]:
        """The words whose second segmentations lose least, in the text's order."""
        few = min(self.n - 1, len(words))
        if not few:
            return []
        loss = np.frombuffer(known.loss)[at]
        near = np.flatnonzero(loss <= np.partition(loss, few - 1)[few - 1])
        return sorted(near[np.argsort(loss[near], kind="stable")][:few].tolist())

    def encode(self, text: str) -> tuple[list[tuple[float, int]], bytes]:
        """((score, pieces) of the n best), ids of the best as 32-bit numbers."""
        if not text:
            return [(0.0, 0)], b""
        words, known = self._words(text)
        number = list(map(known.__getitem__, words))
        raw = b"".join(map(known.raw.__getitem__, number))
        at = np.array(number)
        score, count = float(np.frombuffer(known.best)[at].sum()), len(raw) // 4
        near = self._near(words, known, at)
        parts = [known.choices(words[i]) for i in near]
        if not parts:
            return [(score, count)], raw
        sizes = [[len(piece_ids(p, self.vocab)) for _, p in part] for part in parts]
        base = score - sum(p[0][0] for p in parts), count - sum(z[0] for z in sizes)
        return [(base[0] + s, base[1] + sum(z[k] for z, k in zip(sizes, picks, strict=True))) for s, picks in combine(parts, self.n)], raw

    def parts(self, text: str) -> tuple[list[bytes], list[tuple[float, list[bytes]]]]:
        """Ids, as 32-bit numbers, that the n best share, and (score, ids between those) of each; see ``between``."""
        if not text:
            return [b""], [(0.0, [])]
        words, known = self._words(text)
        number = list(map(known.__getitem__, words))
        raw = list(map(known.raw.__getitem__, number))
        at = np.array(number)
        near = self._near(words, known, at)
        parts = [known.choices(words[i]) for i in near]
        shared = [b"".join(raw[a:b]) for a, b in zip([0, *(i + 1 for i in near)], [*near, len(raw)], strict=True)]
        own = [[array("I", piece_ids(p, self.vocab)).tobytes() for _, p in part] for part in parts]
        base = float(np.frombuffer(known.best)[at].sum()) - sum(p[0][0] for p in parts)
        return shared, [(base + s, [c[k] for c, k in zip(own, picks, strict=True)]) for s, picks in combine(parts, self.n)]

    def best_ids(self, text: str) -> list[tuple[float, bytes]]:
        """(score, ids as 32-bit numbers) of the text's n best."""
        shared, found = self.parts(text)
        return [(s, between(shared, own)) for s, own in found]

    def segmentations(self, text: str) -> list[tuple[float, list[str]]]:
        """(score, pieces) of the text's n best."""
        if not text:
            return [(0.0, [])]
        words, known = self._words(text)
        at = np.array(list(map(known.__getitem__, words)))
        score, near = float(np.frombuffer(known.best)[at].sum()), self._near(words, known, at)
        own = [known.choices(w) for w in words]
        parts = [own[i] for i in near]
        out = []
        for s, picks in combine(parts, self.n):
            pick = dict(zip(near, picks, strict=True))
            out.append((score - sum(p[0][0] for p in parts) + s, [x for i, c in enumerate(own) for x in c[pick.get(i, 0)][1]]))
        return out


@functools.lru_cache(1)
def worker_encoder(path: str, n: int) -> Encoder:
    """One encoder a Python worker, so that its tables last over tasks."""
    return Encoder(path, n)


@functools.lru_cache(1)
def _piece_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for."""
    vocab = vocabulary(path)
    out = [p.encode().replace(SPACE.encode(), b" ") for p in vocab.piece]
    for b, i in vocab.bytes.items():
        out[i] = bytes([b])
    return out


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", n: int = BEST) -> DataFrame:
    """key, scores, pieces and ids (nbest_ids) of the n best segmentations, and ids of the best, for every row.

    Null and empty texts have one segmentation without pieces.  Every input
    row, repeated ones too, gives one row; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder = worker_encoder(model, n)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # pieces take much more room than their texts
                part = batch.slice(start, 64)
                texts = part.column(1).to_pylist()
                got = [encoder.segmentations(t) for t in texts]
                ids = [[np.frombuffer(raw, np.uint32).tolist() for _, raw in encoder.best_ids(t)] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([[s for s, _ in g] for g in got], pa.list_(pa.float64())), pa.array([[p for _, p in g] for g in got], pa.list_(pa.list_(pa.string()))), pa.array([i[0] for i in ids], pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.list_(pa.int32())))],
                    ["key", "scores", "pieces", "ids", "nbest_ids"],
                )

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("_text"))
    return rows.mapInArrow(run, f"key {kind}, scores array<double>, pieces array<array<string>>, ids array<int>, nbest_ids array<array<int>>").withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, model: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and text that the ids stand for, of every row; null ids give an empty text."""
    small_batches(encoded.sparkSession)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            texts = [decode(i or [], vocab) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def nbest(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", n: int = BEST) -> DataFrame:
    """key, n_pieces and ids_crc32 of the best segmentation; scores, piece counts and ids_crc32 (nbest_crc32) of the n best; decodes.

    decodes: whether the ids of each of the n best decode to the text.
    ids_crc32: over little-endian unsigned 32-bit ids.  Null and empty texts
    have no piece and the one score 0.  Every input row, repeated ones too,
    gives one row; other columns are ignored.  A model that normalises texts
    raises ValueError.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder = worker_encoder(model, n)
        text_piece = _piece_bytes(model)

        def decode_raw(ids: bytes) -> bytes:
            return b"".join(map(text_piece.__getitem__, array("I", ids)))

        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores, counts, crcs, back = [], [], [], []
            for text in batch.column(1).to_pylist():
                shared, found = encoder.parts(text)
                ids = [between(shared, own) for _, own in found]
                scores.append([s for s, _ in found])
                counts.append([len(i) // 4 for i in ids])
                crcs.append([zlib.crc32(i) for i in ids])
                form, decoded = text.replace(SPACE, " ").encode(), list(map(decode_raw, shared))  # what the n best share, once
                back.append(all(between(decoded, list(map(decode_raw, own)))[1:] == form for _, own in found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([c[0] for c in counts], pa.int64()),
                    pa.array([c[0] for c in crcs], pa.int64()),
                    pa.array(back, pa.bool_()),
                    pa.array(scores, pa.list_(pa.float64())),
                    pa.array(counts, pa.list_(pa.int64())),
                    pa.array(crcs, pa.list_(pa.int64())),
                ],
                ["key", "n_pieces", "ids_crc32", "decodes", "scores", "piece_counts", "nbest_crc32"],
            )

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("_text"))
    return rows.mapInArrow(run, f"key {kind}, n_pieces long, ids_crc32 long, decodes boolean, scores array<double>, piece_counts array<long>, nbest_crc32 array<long>").withColumnRenamed("key", key)
