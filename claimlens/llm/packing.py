"""Packing: concatenate and cut.

All documents' token ids, each followed by an end id, are thought of as one
long stream in table order.  Pass one tokenizes every document once and writes
its ids with their place inside the task's own part of the stream.  Prefix
sums over the parts' totals (one number a part) turn these into global
offsets.  Pass two cuts the stream into windows of a fixed width and writes a
boundary record for each piece of a document in a window.

Only the last window is not full; it is cut further into windows of powers of
two, which need no padding, so nothing is padded at all.

Token ids are those of the ``tokenizers`` library.  Latin texts get them from
``tiktoken`` with the same vocabulary, which gives the same ids several times
faster (the tests compare both), and word by word through a cache if their
white space is single spaces and line feeds: a pre-token never reaches across
these but for the space before a word.  Texts with other characters, special
strings or long runs of white space go to the library itself.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage_table, text_of

WIDTH, END_ID = 2048, 1
#: Pre-tokens of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Any of these characters, or such runs of white space, sends a text to the slower library.
OTHER = re.compile(r"[^\x00-\x1b\x20-\u024f]")
LONG_RUNS = " " * 200, "\n" * 200
#: Words whose ids a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 300_000


class _Cache(dict):
    """Ids of words behind ``lead``; missing ones are found out."""

    def __init__(self, ids, lead: str):
        super().__init__()
        self.ids, self.lead = ids, lead

    def __missing__(self, word: str) -> bytes:
        self[word] = found = array("H", self.ids(self.lead + word)).tobytes()
        return found


class TextIds:
    """Token ids of texts as little-endian 16-bit arrays."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spelled = dict(zip(sorted(ByteLevel.alphabet(), key=ord), _byte_order(), strict=True))
        ranks = {bytes(map(spelled.__getitem__, w)): i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w not in self.specials}
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.rest = _Cache(self.fast.encode_ordinary, ""), _Cache(self.fast.encode_ordinary, " ")  # at a line's start, after a space
        self.feed = array("H", self.fast.encode_ordinary("\n")).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.rest) > CACHE_WORDS:
            self.first.clear()
            self.rest.clear()
        first, rest, out = self.first.__getitem__, self.rest.__getitem__, []
        for t in texts:
            if OTHER.search(t) or any(s in t for s in (*self.specials, *LONG_RUNS)):
                out.append(array("H", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
            elif t and " ".join(t.split()) == t.replace("\n", " "):
                lines = (line.split(" ") for line in t.split("\n"))
                out.append(self.feed.join([first(w[0]) + b"".join(map(rest, w[1:])) for w in lines]))
            else:
                out.append(array("H", self.fast.encode_ordinary(t)).tobytes())
        return out


def _byte_order() -> list[int]:
    """The bytes that the byte-level alphabet's characters stand for, in order of the characters.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for the characters from 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return own + [b for b in range(256) if b not in own]


def _tokenize(path: str, end_id: int):
    def run(batches):
        words, part, total = TextIds(path), TaskContext.get().partitionId(), 0
        end = array("H", [end_id]).tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 200):
                ids = [i + end for i in words.batch(texts[a : a + 200])]
                n = np.array([len(i) // 2 for i in ids], np.int64)
                begin = total + np.cumsum(n) - n
                total += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 200), pa.array(np.full(len(ids), part, np.int64)), pa.array(begin), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "begin", "n", "ids"]
                )

    return run


def _tail(rest: int) -> list[int]:
    """The powers of two that ``rest`` is the sum of, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(bases: dict[int, int], total: int, width: int):
    full = total // width
    tail = np.cumsum([0, *_tail(total - full * width)]) + full * width  # where the last windows begin

    def run(batches):
        for batch in batches:
            part, begin, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
            ids = batch.column(4).to_pylist()
            at = np.array([bases[int(p)] for p in part], np.int64) + begin
            out: list[tuple] = []
            for row, (g, size, raw) in enumerate(zip(at.tolist(), n.tolist(), ids, strict=True)):
                wide, done = np.frombuffer(raw, "<u2").astype("<u4").tobytes(), 0
                while done < size:
                    here = g + done
                    if here < full * width:
                        window, offset = divmod(here, width)
                        room = width - offset
                    else:
                        k = int(np.searchsorted(tail, here, "right")) - 1
                        window, offset = full + k, here - int(tail[k])
                        room = int(tail[k + 1]) - here
                    length = min(room, size - done)
                    out.append((row, done, length, zlib.crc32(wide[4 * done : 4 * (done + length)]), size, window, offset))
                    done += length
            columns = [np.array(c, np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 7
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *map(pa.array, columns[1:])], names)

    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """Boundary records: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a ``tokenizers`` file with ids under 65,536.  A null or
    empty text is just its end id.  Every input row, repeated ones too, is
    packed; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("_text"))
    stream = stage_table(rows.mapInArrow(_tokenize(tokenizer, end_id), f"doc_id {kind}, part long, begin long, n long, ids binary"), "packing-ids")
    totals = sorted((r.part, r.total) for r in stream.groupBy("part").agg(F.sum("n").alias("total")).collect())  # one row a part
    bases, total = {}, 0
    for part, n in totals:
        bases[part] = total
        total += n
    out = stream.mapInArrow(_cut(bases, total, width), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", key)
