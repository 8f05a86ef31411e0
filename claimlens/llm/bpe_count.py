"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a run of characters form a linked list; a heap holds adjacent
pairs that make a piece, best rank (highest score, then leftmost) first.  The
best pair is merged again and again.  The count is the number of symbols at
the start minus the number of merges, plus the extra bytes of symbols that the
vocabulary lacks; identifiers are never made.

A text's spaces cut it into units that merge independently (see pieces.py), so
a unit's count is kept in a bounded cache.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of
from .pieces import SPACE, Vocabulary, units, vocabulary

LIMIT = 4096
#: Units whose count a worker keeps; beyond it the cache starts anew.
CACHE_UNITS = 500_000


def merged_count(run: str, vocab: Vocabulary) -> int:
    """Tokens of one run of characters."""
    score = vocab.score
    symbols: list[str | None] = list(run)
    n = len(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []
    for i in range(n - 1):
        s = score.get(run[i : i + 2])
        if s is not None:
            heap.append((-s, i, i + 1, 2))
    heapify(heap)
    merges = 0
    while heap:
        _, i, j, size = heappop(heap)
        a, b = symbols[i], symbols[j]
        if a is None or b is None or right[i] != j or len(a) + len(b) != size:
            continue  # one of them has merged since
        symbols[i], symbols[j] = a + b, None
        merges += 1
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            s = score.get(whole := symbols[i] + symbols[k])
            if s is not None:
                heappush(heap, (-s, i, k, len(whole)))
        h = left[i]
        if h >= 0:
            s = score.get(whole := symbols[h] + symbols[i])
            if s is not None:
                heappush(heap, (-s, h, i, len(whole)))
    extra = 0
    if vocab.bytes:
        extra = sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in score)
    return n - merges + extra


class _Counts(dict):
    """Tokens of units (here without their leading space if there is just one), kept."""

    def __init__(self, vocab: Vocabulary, lead: str):
        super().__init__()
        self.vocab, self.lead, self.of_run = vocab, lead, {}

    def __missing__(self, unit: str) -> int:
        total, of_run = 0, self.of_run
        for run in self.vocab.runs(self.lead + unit):
            count = of_run.get(run)
            if count is None:
                of_run[run] = count = merged_count(run, self.vocab)
            total += count
        self[unit] = total
        return total


class Counter:
    """Token counts of texts."""

    def __init__(self, path: str):
        vocab = vocabulary(path)
        self.word, self.unit = _Counts(vocab, SPACE), _Counts(vocab, "")

    def count(self, text: str) -> int:
        for kept in (self.word, self.unit):
            if len(kept) + len(kept.of_run) > CACHE_UNITS:
                kept.clear()
                kept.of_run.clear()
        if not text:
            return 0
        words = text.split(" ")
        if "" not in words and SPACE not in text:
            return sum(map(self.word.__getitem__, words))
        return sum(map(self.unit.__getitem__, units(text)))


def token_counts(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row.

    model: path of a SentencePiece BPE model.  Null and empty texts have 0
    bytes and 0 tokens; every input row, repeated ones too, gives one row;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        counter = Counter(model)
        for batch in batches:
            n = np.fromiter(map(counter.count, batch.column(2).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key).alias("key"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("_text"))
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
