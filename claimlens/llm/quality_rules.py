"""Quality rules: hashed n-gram log-likelihood ratio against a trusted target.

Two multinomials over hashed n-grams are counted: one over the trusted texts
(documents labelled good), one over the whole raw corpus.  A document's score
is the sum over its n-grams of log p(target) - log p(raw), divided by their
number, so long and short texts compare.  Documents under a fixed threshold,
and those that fail simple base rules, are not kept.

N-grams: words and pairs of adjacent words (words are runs of anything but
``\\x20 \\x09-\\x0D``), and byte trigrams of the text.  Each kind has its own
range of buckets and its own multinomial; the three per-gram means add up.

Plan: counting goes over the texts once for the raw counts, and once, dealt by
doc_id to their labels, for the target's; each pass sends BUCKETS rows a task
into an aggregation.  The model (a fixed number of floats) goes out with the
last pass, which scores every document.  Labels grow with the corpus, so they
are never broadcast: the join is by hash on both sides, at every size.

Repeated lines and windows are found by hashes and confirmed by their bytes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import Scan, mix
from .common import slices, small_batches, text_of

#: Buckets of each of the three kinds of n-grams.
KIND_BITS = 13
KINDS = 3
BUCKETS = KINDS << KIND_BITS
#: A document needs at least this mean log-likelihood ratio.
THRESHOLD = -0.75
#: Base rules: least number of words, most percent of words in repeated windows.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _grams(scan: Scan, words: np.ndarray):
    """(bucket, document) arrays for each kind of n-gram."""
    shift = np.uint64(64 - KIND_BITS)
    yield (words >> shift).astype(np.int64), scan.word_doc
    if len(words) > 1:
        pair = mix(words[:-1] * np.uint64(3) + words[1:]) >> shift
        same = scan.word_doc[:-1] == scan.word_doc[1:]
        yield pair[same].astype(np.int64) + (1 << KIND_BITS), scan.word_doc[1:][same]
    else:
        yield np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = scan.buf.astype(np.uint32)
    code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    bucket = (code >> np.uint32(32 - KIND_BITS)).astype(np.int64) + (2 << KIND_BITS)
    doc = np.repeat(np.arange(scan.n), scan.doc_end - scan.doc_start + 1)[: len(bucket)]
    inside = np.ones(len(bucket), bool)  # not over a text's end
    for back in (0, 1, 2):
        at = scan.doc_end - back
        inside[at[(at >= 0) & (at < len(bucket))]] = False
    yield bucket[inside], doc[inside]


def _count(batches):
    """Per task: each bucket's count in its texts."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts = [t.encode() for t in batch.column(0).to_pylist()]
        for a, b in slices([len(t) for t in texts]):
            scan = Scan(texts[a:b])
            for bucket, _ in _grams(scan, scan.hashes(scan.word_start, scan.word_end)):
                total += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def _counts(texts: DataFrame) -> np.ndarray:
    counts = texts.select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    out = np.zeros(BUCKETS)
    out[counts["bucket"]] = counts["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """Log-likelihood ratio of each bucket.

    The raw counts cover every document; the target's cover all good
    labelled documents: every row whose key any label row calls good.  Without
    any such document all ratios are 0.  Null keys and null labels are no
    labels; empty tables give ratios 0.
    """
    small_batches(docs.sparkSession)
    good = labels.filter("quality = 1").select(F.col(key).alias("_key")).filter("_key IS NOT NULL").distinct()
    texts = docs.select(F.col(key).alias("_key"), text_of(text).alias("text"))
    raw, target = _counts(texts), _counts(texts.join(good.hint("shuffle_hash"), "_key", "left_semi"))
    out = np.zeros(BUCKETS)
    for k in range(KINDS):
        own = slice(k << KIND_BITS, (k + 1) << KIND_BITS)
        if target[own].sum():
            log_p = [np.log((c[own] + 1) / (c[own].sum() + (1 << KIND_BITS))) for c in (target, raw)]
            out[own] = log_p[0] - log_p[1]
    return out


def _rules(scan: Scan, words: np.ndarray) -> dict[str, np.ndarray]:
    """The base rules' statistics of each text."""
    n_words = scan.per_doc(scan.word_doc)
    inside = scan.doc_end  # ranges of bytes for counting
    first = (scan.buf & 0xC0) != 0x80
    out = {
        "n_words": n_words,
        "word_chars": scan.count(first & ~scan.space, scan.doc_start, inside),
        "n_symbols": scan.count(IS_SYMBOL[scan.buf], scan.doc_start, inside),
    }
    start, end, doc = scan.lines()
    has_word = scan.count(~scan.space, start, end) > 0
    start, end, doc = start[has_word], end[has_word], doc[has_word]
    later, before = _later(mix(scan.hashes(start, end) + doc.astype(np.uint64)))
    out["n_dup_lines"] = scan.per_doc(doc[later])
    unsure = doc[later[(doc[later] != doc[before]) | scan.differ(start[later], end[later], start[before], end[before])]]
    n = max(0, len(words) - 2)
    window = words[:n] * np.uint64(5) + mix(words[1 : n + 1] * np.uint64(3) + mix(words[2 : n + 2]))
    at = np.flatnonzero(scan.word_doc[:n] == scan.word_doc[2 : n + 2])
    later, before = _later(mix(window[at] + scan.word_doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    later, before = at[later], at[before]
    twice = np.zeros(n, bool)
    twice[later] = twice[before] = True
    wrong = scan.word_doc[later] != scan.word_doc[before]
    for k in range(3):
        x, y = later + k, before + k
        wrong |= scan.differ(scan.word_start[x], scan.word_end[x], scan.word_start[y], scan.word_end[y])
    unsure = np.unique(np.concatenate([unsure, scan.word_doc[later[wrong]]]))
    cover = np.zeros(len(words) + 3, np.int32)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + 3, -1)
    out["n_repeat_words"] = scan.per_doc(scan.word_doc[np.cumsum(cover)[: len(words)] > 0])
    for d in unsure.tolist():  # two hashes were equal by chance
        out["n_dup_lines"][d], out["n_repeat_words"][d] = _plain_repeats(scan.buf[scan.doc_start[d] : scan.doc_end[d]].tobytes())
    return out


def _plain_repeats(text: bytes) -> tuple[int, int]:
    """n_dup_lines and n_repeat_words of one text, by the bytes themselves."""
    lines = [x for x in text.split(b"\n") if x.split()]
    words = text.split()
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    return len(lines) - len(set(lines)), len(covered)


def _later(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key an earlier position has too, and the last such position of each."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    return order[1:][same], order[:-1][same]


def _scorer(ratio: np.ndarray, threshold: float):
    def score(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            parts = []
            for a, b in slices([len(t) for t in texts]):
                scan = Scan(texts[a:b])
                words = scan.hashes(scan.word_start, scan.word_end)
                part = _rules(scan, words)
                mean = np.zeros(scan.n)
                for bucket, doc in _grams(scan, words):
                    mean += scan.per_doc(doc, ratio[bucket]) / np.maximum(scan.per_doc(doc), 1)
                n = part["n_words"]
                part["base_failed"] = (n < MIN_WORDS) | (100 * part["n_repeat_words"] > MAX_REPEATED_PERCENT * n)
                part["kept"] = ~part["base_failed"] & (mean >= threshold)
                part["llr"] = mean
                parts.append(part)
            longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            columns = [pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in longs]
            columns += [pa.array(np.concatenate([p[k] for p in parts])) for k in ("base_failed", "kept", "llr")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *longs, "base_failed", "kept", "llr"])

    return score


def rate(docs: DataFrame, ratio: np.ndarray, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Verdict on every document.

    Returns key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, llr.  A null text counts as empty; a text without words
    has llr 0 and fails the base rules; every input row, repeated ones too,
    gives one row; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key), text_of(text).alias("_text")).mapInArrow(
        _scorer(ratio, threshold),
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double",
    )
    return out.withColumnRenamed("doc_id", key)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with all their columns, in one pass after fitting.

    docs has the columns doc_id and text.  A null text counts as empty and goes,
    as all texts under MIN_WORDS words do; rows that repeat stay or go together;
    columns may have any other names; an empty table gives an empty table.
    """
    ratio = fit(docs, labels)
    score = _scorer(ratio, threshold)
    names = docs.columns
    at = names.index("text")

    def passed(batches):
        for batch in batches:
            text = batch.column(at)
            if text.null_count:
                text = text.fill_null("")
            verdict = next(iter(score([pa.RecordBatch.from_arrays([text, text], ["k", "t"])])))
            yield batch.filter(verdict.column("kept"))

    return docs.mapInArrow(passed, docs.schema)
