"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text gets the label good or bad.  A line's features are
statistics of its bytes and words, and the same statistics of the line before
and after it; neighbouring labels are tied by transition weights.  A document's
quality is the mean of its lines' forward-backward marginals of "good",
weighted by the lines' lengths.

The field is fitted on the driver on a bounded sample of labelled documents
(lines take their document's label); every document is scored, line by line,
over its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import Scan, mix
from .common import fold, slices, small_batches, stage_table, text_of

#: The field is fitted on at most so many labelled documents, those with the smallest hash of doc_id.
FIT_DOCS, FIT_LINES = 4_000, 400_000
#: Rows whose crc32(doc_id) modulo FOLDS is 0 are held out.
FOLDS = 5
GOOD_FROM = 0.3
STEPS, RATE, DECAY = 300, 0.1, 1e-3


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, LETTER, DIGIT = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), np.zeros(256, bool), _flags("0123456789")
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
SYMBOL, BAR, BANG, PLAIN = _flags("#*$%&<>@^~=_+\\{}[]/`"), _flags("|"), _flags("!?"), _flags(".,;:'\"-()")
OWN = 13


def features(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line (own, of the line before, of the line after, two edge flags), its text and its length."""
    start, end, doc = scan.lines()
    n_bytes = np.maximum(end - start, 1)
    line = np.searchsorted(end, scan.word_start, "right")
    words = scan.hashes(scan.word_start, scan.word_end)
    per_line = lambda w=None: np.bincount(line, w, len(start))
    n_words = per_line()
    many = np.maximum(n_words, 1)
    letters = scan.count(LETTER[scan.buf], start, end)
    own = np.empty((len(start), OWN), np.float32)
    own[:, 0] = scan.count(UPPER[scan.buf], start, end) / np.maximum(letters, 1)
    for k, kind in enumerate((SYMBOL, BAR, BANG, DIGIT, PLAIN), 1):
        own[:, k] = np.sqrt(scan.count(kind[scan.buf], start, end) / n_bytes)
    own[:, 6] = letters / n_bytes
    own[:, 7] = np.log1p(n_words)
    size = (scan.word_end - scan.word_start).astype(np.float64)
    own[:, 8] = np.log1p(per_line(size) / many)
    own[:, 9] = np.minimum(1, 4 * scan.count(BAR[scan.buf], start, end) / many)
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    own[:, 10] = np.sqrt(per_line(again) / many)
    key = mix(words + scan.word_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    seen = np.zeros(len(words))
    seen[order[1:][key[order][1:] == key[order][:-1]]] = 1
    own[:, 11] = per_line(seen) / many
    key = mix(scan.hashes(start, end) + doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    own[:, 12] = 0
    own[order[1:][key[order][1:] == key[order][:-1]], 12] = 1
    out = np.zeros((len(start), 3 * OWN + 2), np.float32)
    out[:, :OWN] = own
    joined = doc[1:] == doc[:-1]
    out[1:][joined, OWN : 2 * OWN] = own[:-1][joined]
    out[:-1][joined, 2 * OWN : 3 * OWN] = own[1:][joined]
    out[:, -2] = ~np.concatenate([[False], joined])[: len(start)]
    out[:, -1] = ~np.concatenate([joined, [False]])[: len(start)]
    return out, doc, n_bytes


@dataclass
class Field:
    """A fitted field: scaling and weights of the features, bias, transition weights."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    move: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias


def chain_marginals(logit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the sum of expected transitions, by forward-backward over all chains at once.

    logit: score of good over bad for each line, chains one after another;
    lengths: of the chains, each at least 1; move[a, b]: weight of b after a.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    most = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(most), "left")  # chains longer than t
    score = np.zeros((len(logit), 2))
    score[:, 1] = logit
    ahead, back = np.zeros_like(score), np.zeros_like(score)
    for t in range(most):
        at = first[: active[t]] + t
        if t == 0:
            ahead[at] = score[at]
        else:
            ahead[at] = score[at] + np.logaddexp(ahead[at - 1, :1] + move[0], ahead[at - 1, 1:] + move[1])
    for t in range(most - 2, -1, -1):
        at = first[: active[t + 1]] + t
        nxt = score[at + 1] + back[at + 1]
        back[at] = np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:])
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(logit), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    pair = ahead[at - 1][:, :, None] + move[None] + (score[at] + back[at])[:, None, :] - total[at][:, None, None]
    return good, np.exp(pair).sum(0)


def fit_chains(x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> Field:
    """Maximum likelihood with a small penalty, by a fixed number of Adam steps from zero."""
    width = x.shape[1]
    if not len(x):
        return Field(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)))
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-2
    z = (x - mean) / scale
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    w = np.zeros(width + 5)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        good, moves = chain_marginals(z @ w[:width] + w[width], lengths, w[width + 1 :].reshape(2, 2))
        gap = y - good
        g = np.concatenate([z.T @ gap, [gap.sum()], (seen - moves).ravel()]) / len(y) - DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Field(mean, scale, w[:width], float(w[width]), w[width + 1 :].reshape(2, 2))


def _training_rows(batches):
    for batch in batches:
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        blobs, counts = [], []
        for a, b in slices([len(t) for t in texts]):
            x, doc, _ = features(Scan(texts[a:b]))
            n = np.bincount(doc, minlength=b - a)
            counts += n.tolist()
            blobs += [p.tobytes() for p in np.split(x, np.cumsum(n)[:-1])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], ["key", "label", "n", "x"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Field:
    """Fit on at most FIT_DOCS labelled documents that are not held out, and at most FIT_LINES lines of them; without any, every score is 0.5.

    Documents are taken by the smallest hash of their key.  Of label rows that
    contradict each other, a good one counts; of rows that repeat a key, one
    text, by the smallest hash of its features; null keys and labels are no
    labels.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & (fold(key, FOLDS) != 0))
        .groupBy(F.col(key).cast("string").alias("_key"))
        .agg(F.max("quality").cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(FIT_DOCS)
    )
    found = (
        docs.select(F.col(key).cast("string").alias("_key"), text_of(text).alias("_text"))
        .join(F.broadcast(chosen), "_key")
        .mapInArrow(_training_rows, "key string, label int, n long, x binary")
        .groupBy("key")
        .agg(F.min_by(F.struct("label", "n", "x"), F.struct(F.xxhash64("x"), F.col("n"))).alias("r"))
        .select("key", "r.label", "r.n", "r.x")
    )
    found = stage_table(found, "crf-training")
    sizes = found.select("key", "n").orderBy(F.xxhash64("key"), "key").collect()  # FIT_DOCS at most
    lines = np.cumsum([r.n for r in sizes])
    within = [r.key for k, r in enumerate(sizes) if not k or lines[k] <= FIT_LINES]
    rows = found.filter(F.col("key").isin(within)).toPandas().sort_values(["key", "x"])  # FIT_LINES lines at most, or one document
    width = 3 * OWN + 2
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, width)
    lengths = rows["n"].to_numpy(np.int64)
    return fit_chains(x, np.repeat(rows["label"].to_numpy(np.int64), lengths), lengths)


def _doc_scores(field: Field, texts: list[bytes]) -> np.ndarray:
    out = []
    for a, b in slices([len(t) for t in texts]):
        x, doc, n_bytes = features(Scan(texts[a:b]))
        lengths = np.bincount(doc, minlength=b - a)
        good, _ = chain_marginals(field.logits(x), lengths, field.move)
        out.append(np.bincount(doc, good * n_bytes, b - a) / np.bincount(doc, n_bytes, b - a))
    return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def score(docs: DataFrame, field: Field, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Quality of every document: key, held_out, score, predicted.

    An empty or null text is one empty line, whose marginal is its score.
    Every input row gives one row; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            got = _doc_scores(field, [t.encode() for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array((got >= GOOD_FROM).astype(np.int32))], ["key", "held_out", "score", "predicted"]
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), (fold(key, FOLDS) == 0).alias("held_out"), text_of(text).alias("_text"))
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the field predicts to be good, with all their columns.

    docs has the columns doc_id and text.  A null text counts as empty; rows
    that repeat stay or go together; columns may have any other names; an
    empty table gives an empty table, and without labels all documents stay.
    """
    field = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            got = _doc_scores(field, [(t or "").encode() for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(got >= GOOD_FROM))

    return docs.mapInArrow(run, docs.schema)
