"""Language-model scoring: Brown class-based bigrams.

Words are put into classes by the exchange algorithm, in three steps.  The SEEDS
most frequent words are exchanged one by one on the driver, on their bigram
counts, until none moves.  Then, in sweeps over the corpus, each of the CORE most
frequent words is counted with its neighbours' classes and moves to the class
with the highest likelihood, its own counts being taken out of the class that it
is in; all words of a sweep move at once (distributed exchange).  At last every
other word of the corpus moves in the same way, by its neighbours among the
core.  Those infrequent words have twins of the core's classes for themselves.
A text's probability is the product of class transitions and of words given
classes, both smoothed with what held-in documents leave over.

Plan.  One pass cuts the documents into chunks: token numbers, and the chunk's
own dictionary of word hashes with their counts.  Core words' counts and classes
are of a fixed size and go out with the code.  Only the other words' dictionary
rows, one a word and chunk, are dealt by word, classified, and dealt back to
their chunks; a word that isn't in the core has few rows.  Tasks of both steps
hold a bounded number of rows, whatever the input's size.  Words are told apart
by a 62-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import Scan
from .common import fold, slices, small_batches, stage_table, text_of

SEEDS, CLASSES, SWEEPS = 512, 48, 8
#: Words that take part in every sweep over the corpus; a fixed size, for their context counts meet on the driver.
CORE, CORPUS_SWEEPS = 1 << 16, 3
#: Core words whose context counts travel together.
RANGE = 1 << 10
#: Dictionary rows that a task gets, on average.
TASK_ROWS = 400_000
FOLDS, HELD_OUT = 7, 2
#: Tokens after which a chunk ends (with the texts at hand, about a megabyte or one long text).
CHUNK_TOKENS = 2_000_000
#: The end token's place among words; no word is likely to have this hash.
END_HASH = np.uint64(0x454E44)
UNKNOWN = 255
END_CLASS = 2 * CLASSES  # core classes, their twins, the end token's own


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd"), kind)


def _encode(kind):
    """Chunks: keys, held-out flags, tokens of each document, token numbers, word hashes, held-in counts."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        keys, held, sizes, hashes, total = [], [], [], [], 0

        def chunk():
            nonlocal number, total
            h = np.concatenate(hashes)
            out = np.concatenate(held)
            n = np.concatenate(sizes)
            words, first, tokens = np.unique(h, return_index=True, return_inverse=True)
            rank = np.empty(len(words), np.int64)  # frequent words come early; small numbers pack well
            order = np.argsort(first)
            rank[order] = np.arange(len(words))
            tokens = rank[tokens].astype(np.uint32)
            counts = np.bincount(tokens[np.repeat(~out, n)], minlength=len(words)).astype(np.uint32)
            keyed = pa.concat_arrays(keys)
            row = [
                pa.array([(part << 24) + number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(keyed)], pa.int32()), keyed),
                *(pa.array([len(x)], pa.int64()) for x in (out, words, tokens)),
                *(pa.array([_pack(x)], pa.binary()) for x in (out, n.astype(np.uint32), tokens, words[order], counts)),
            ]
            number, total = number + 1, 0
            for x in (keys, held, sizes, hashes):
                x.clear()
            return pa.RecordBatch.from_arrays(row, [f.split()[0] for f in CHUNK.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            is_held = np.array(batch.column(2).to_pylist(), bool)
            for a, b in slices([len(t) for t in texts]):
                keys.append(batch.column(0).slice(a, b - a))
                held.append(is_held[a:b])
                scan = Scan(texts[a:b], lower=True)
                n = scan.per_doc(scan.word_doc) + 1
                h = np.full(int(n.sum()), END_HASH)
                at = np.ones(len(h), bool)
                at[np.cumsum(n) - 1] = False
                h[at] = scan.hashes(scan.word_start, scan.word_end)
                sizes.append(n)
                hashes.append(h)
                total += len(h)
                if total >= CHUNK_TOKENS:
                    yield chunk()
        if hashes:
            yield chunk()

    return run


CHUNK = "chunk long, keys array<{}>, n_docs long, n_words long, n_tokens long, held binary, sizes binary, tokens binary, words binary, counts binary"


@dataclass
class _Chunk:
    id: int
    held: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    words: np.ndarray
    counts: np.ndarray

    def held_in(self) -> np.ndarray:
        """Of each token, whether its document is held in."""
        return np.repeat(~self.held, self.sizes)


def _chunks(batch):
    for r in batch.select([c for c in batch.schema.names if c != "keys"]).to_pylist():
        yield _Chunk(
            r["chunk"],
            _unpack(r["held"], bool, r["n_docs"]),
            _unpack(r["sizes"], np.uint32, r["n_docs"]).astype(np.int64),
            _unpack(r["tokens"], np.uint32, r["n_tokens"]),
            _unpack(r["words"], np.uint64, r["n_words"]),
            _unpack(r["counts"], np.uint32, r["n_words"]),
        )


def _dictionary(batches):
    for batch in batches:
        for c in _chunks(batch):
            some = c.counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(c.words[some].view(np.int64)), pa.array(c.counts[some].astype(np.int64))], ["word", "n"])


def _core_of(core: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted core, or -1."""
    if not len(core):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(core, words), len(core) - 1)
    return np.where(core[at] == words, at, -1)


def _seed_bigrams(core: np.ndarray):
    """Counts of adjacent pairs of these words and ends; the end precedes a text's first word."""

    def run(batches):
        side = len(core) + 1
        total = np.zeros(side * side, np.int64)
        for batch in batches:
            for c in _chunks(batch):
                place = _core_of(core, c.words)
                place[c.words == END_HASH] = len(core)
                now = place[c.tokens]
                before = np.concatenate([[len(core)], now[:-1]])
                ok = (now >= 0) & (before >= 0) & c.held_in()
                total += np.bincount(before[ok] * side + now[ok], minlength=side * side)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return run


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each core word.  bigrams: counts of pairs, the last row and column the end token's.

    Words start in class rank mod classes and move, one by one, to the class
    with the highest bigram likelihood, until none moves or the sweeps end.
    """
    n = len(bigrams) - 1
    of = np.append(np.arange(n) % classes, classes)  # the end has a class of its own
    k = classes + 1
    b = bigrams.astype(float)
    table = np.zeros((k, k))
    np.add.at(table, (of[:, None], of[None, :]), b)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            own = of[w]
            self_n = b[w, w]
            after, before = np.bincount(of, b[w], k), np.bincount(of, b[:, w], k)
            after[own] -= self_n
            before[own] -= self_n
            table[own] -= after
            table[:, own] -= before
            table[own, own] -= self_n
            rows, columns = table.sum(1) + before, table.sum(0) + after  # as they are once the word is back, wherever it goes
            with_after, with_before = table + after[None, :], table + before[:, None]
            gain = (f(with_after) - f(table)).sum(1) + (f(with_before) - f(table)).sum(0)
            d = np.diagonal(table)
            gain += f(d + after + before + self_n) - f(d + after) - f(d + before) + f(d)
            gain -= f(rows + after.sum() + self_n) - f(rows) + f(columns + before.sum() + self_n) - f(columns)
            gain[classes] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            of[w] = best
            table[best] += after
            table[:, best] += before
            table[best, best] += self_n
        if not moved:
            break
    return of[:n]


WIDTH = 2 * (CLASSES + 1)


def _neighbours(c: _Chunk, core: np.ndarray, core_class: np.ndarray):
    """Place of each word of the chunk in the core, and of each token the classes at its left and right (-1: none yet)."""
    place = _core_of(core, c.words).astype(np.int32)
    known = np.where(place >= 0, core_class[place] if len(core) else -1, -1).astype(np.int8)
    known[c.words == END_HASH] = CLASSES
    ends = np.array([CLASSES], np.int8)
    now = np.concatenate([ends, known[c.tokens], ends])
    return place, now[:-2], now[2:]


def _core_contexts(core: np.ndarray, core_class: np.ndarray):
    """Per task: RANGE core words' counts of neighbouring classes, left ones first, packed."""

    def run(batches):
        total = np.zeros(-(-len(core) // RANGE) * RANGE * WIDTH, np.int32)  # a task has fewer tokens than that holds
        for batch in batches:
            for c in _chunks(batch):
                place, left, right = _neighbours(c, core, core_class)
                own = c.held_in()
                for begin in range(0, len(c.tokens), 1 << 18):
                    some = slice(begin, begin + (1 << 18))
                    at = place[c.tokens[some]]
                    for side, other in enumerate((left[some], right[some])):
                        ok = own[some] & (at >= 0) & (other >= 0)
                        np.add.at(total, at[ok] * np.int64(WIDTH) + (side * (CLASSES + 1) + other[ok]), 1)
        for k, part in enumerate(total.reshape(-1, RANGE * WIDTH)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(part.astype(np.int64))])], ["part", "counts"])

    return run


def _sum_contexts(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            own = _unpack(raw, np.int64, RANGE * WIDTH)
            held[k] = held[k] + own if k in held else own
    for k, own in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(own)])], ["part", "counts"])


def class_table(contexts: np.ndarray, core_class: np.ndarray) -> np.ndarray:
    """Counts of adjacent classes, the end's class last, from the core words' neighbours; half a count more each."""
    side = CLASSES + 1
    table = np.full((side, side), 0.5)
    some = core_class >= 0
    np.add.at(table.T, core_class[some], contexts[some, :side])  # what stands before each class
    table[CLASSES, CLASSES] += 1
    np.add.at(table[:, CLASSES], core_class[some], contexts[some, side + CLASSES])  # and ends after it
    return table


def fit_of(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a word's neighbour counts (left, right), what each adds to the likelihood in each class; and the classes' sizes."""
    size = table.sum(1)[:CLASSES]
    return np.concatenate([np.log(table[:, :CLASSES] / size), np.log(table[:CLASSES].T / size)]), size


def move_all(contexts: np.ndarray, core_class: np.ndarray) -> np.ndarray:
    """Every core word's best class, all at once.  A word's own counts are taken out of its class when it is weighed against the others."""
    table = class_table(contexts, core_class)
    fit, size = fit_of(table)
    gain = contexts @ fit
    some = np.flatnonzero(core_class >= 0)
    of, own = core_class[some], contexts[some].astype(float)
    side = CLASSES + 1
    n = own[:, :side].sum(1)
    rest = np.maximum(size[of] - n, 0.5)[:, None]
    left = np.log(np.maximum(table[:, of].T - own[:, :side], 0.5) / rest)
    right = np.log(np.maximum(table[of] - own[:, side:], 0.5) / rest)
    gain[some, of] = (own * np.concatenate([left, right], 1)).sum(1)
    gain += np.log(size) * 1e-6  # ties, and words without neighbours
    return np.argmax(gain, 1)


def _contexts(core: np.ndarray, core_class: np.ndarray):
    """A row for each word of each chunk that isn't in the core: hash, count, chunk, place, packed counts of neighbouring classes.

    A packed count is class << 24 | count; classes of the left neighbour come
    first, then those of the right one.
    """

    def run(batches):
        for batch in batches:
            for c in _chunks(batch):
                place, left, right = _neighbours(c, core, core_class)
                rare = (place < 0) & (c.words != END_HASH)
                own = rare[c.tokens] & c.held_in()
                keys = []
                for side, other in enumerate((left, right)):
                    ok = own & (other >= 0)
                    keys.append(c.tokens[ok].astype(np.int64) * WIDTH + (side * (CLASSES + 1) + other[ok]))
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                at = np.flatnonzero(rare)
                offsets = 4 * np.concatenate([np.searchsorted(key, at * WIDTH), [len(key)]])  # words of the core have no keys
                data = ((key % WIDTH) << 24 | np.minimum(n, 0xFFFFFF)).astype("<u4")
                near = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c.words[at].view(np.int64)),
                        pa.array(c.counts[at].astype(np.int64)),
                        pa.array(np.full(len(at), c.id)),
                        pa.array(at.astype(np.int32)),
                        near,
                    ],
                    ["word", "n", "chunk", "place", "near"],
                )

    return run


def _classify(fit: np.ndarray, prior: np.ndarray, block: int = 16_384):
    """Over rows dealt by word: chunk, place, the word's count in the corpus, its class, and whether this row stands for the word when words are counted."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        words, at, inverse = np.unique(t["word"].to_numpy().view(np.uint64), return_index=True, return_inverse=True)
        count = np.bincount(inverse, t["n"].to_numpy(), len(words)).astype(np.int64)
        of = np.zeros(len(words), np.int64)
        near = t["near"].chunk(0)
        offsets = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + len(near) + 1].astype(np.int64) // 4
        data = np.frombuffer(near.buffers()[2] or b"", "<u4")[offsets[0] : offsets[-1]]
        of_word = np.repeat(inverse, np.diff(offsets))
        order = np.argsort(of_word, kind="stable")
        of_word, data = of_word[order], data[order]
        width = len(fit)
        for a in range(0, len(words), block):
            some = slice(*np.searchsorted(of_word, [a, a + block]))
            rows = min(block, len(words) - a)
            dense = np.bincount((of_word[some] - a) * width + (data[some] >> 24), data[some] & 0xFFFFFF, rows * width).reshape(rows, width)
            of[a : a + rows] = CLASSES + np.argmax(dense @ fit + prior, axis=1)
        of[count == 0] = UNKNOWN
        once = np.zeros(len(inverse), bool)
        once[at] = True
        yield pa.RecordBatch.from_arrays(
            [t["chunk"].chunk(0), t["place"].chunk(0), pa.array(count[inverse]), pa.array(of[inverse].astype(np.int16)), pa.array(once.astype(np.int16))], ["chunk", "place", "n", "class", "once"]
        )

    return run


def _sequences(core: np.ndarray, core_class: np.ndarray, core_count: np.ndarray, ends: int, total: int, distinct: int, discount: float):
    """Over rows sorted by chunk, a chunk's own row first and then its dictionary's: of each document what scoring needs.

    fresh, at a chunk's first document: how many of each class's words stand for themselves in this chunk.
    """

    def one(own, rows):
        c = next(_chunks(own))
        count, kind = np.zeros(len(c.words), np.int64), np.full(len(c.words), UNKNOWN, np.uint8)
        fresh = [None] * len(c.sizes)
        if rows:
            place, n, of, once = (np.concatenate([r[k] for r in rows]) for k in range(4))
            count[place], kind[place] = n, of
            fresh[0] = np.bincount(of[once.astype(bool)], minlength=UNKNOWN + 1).tobytes()
        at = _core_of(core, c.words)
        known = at >= 0
        count[known], kind[known] = core_count[at[known]], core_class[at[known]]
        is_end = c.words == END_HASH
        count[is_end], kind[is_end] = ends, END_CLASS if ends else UNKNOWN
        base = np.log10((count + 1) / (total + distinct + 1))
        word = np.where((count > 0) & (kind != END_CLASS), np.log10(np.maximum(count - discount, 1e-9)), 0.0)
        start = np.cumsum(c.sizes) - c.sizes
        per_doc = lambda v: np.add.reduceat(v[c.tokens], start)
        sequence = kind[c.tokens]
        offsets = np.append(start, len(sequence)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                own.column("keys").flatten(),
                pa.array(c.held),
                pa.array(c.sizes),
                pa.array(per_doc((count > 0).astype(np.int64))),
                pa.array(per_doc(base)),
                pa.array(per_doc(word)),
                pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(sequence))]),
                pa.array(fresh, pa.binary()),
            ],
            ["key", "held_out", "n_tokens", "n_known", "base_score", "words_score", "classes", "fresh"],
        )

    def run(batches):
        own, rows = None, []
        for batch in batches:
            is_chunk = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            columns = [batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)]
            begin = 0
            for k in [*np.flatnonzero(is_chunk).tolist(), batch.num_rows]:
                if k > begin:
                    rows.append([c[begin:k] for c in columns])
                if k < batch.num_rows:
                    if own is not None:
                        yield one(own, rows)
                    own, rows = batch.slice(k, 1).select(list(range(5, batch.num_columns))), []
                    own = own.rename_columns([n.replace("c_chunk", "chunk") for n in own.schema.names])
                begin = k + 1
        if own is not None:
            yield one(own, rows)

    return run


SIDE = END_CLASS + 1


def _transitions(batches):
    """Counts of adjacent classes in held-in documents, and from SIDE squared on of each class's distinct words."""
    total = np.zeros(SIDE * SIDE + UNKNOWN + 1, np.int64)
    for batch in batches:
        for raw, held, fresh in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not held:
                s = np.frombuffer(raw, np.uint8).astype(np.int64)
                total[: SIDE * SIDE] += np.bincount(np.concatenate([[END_CLASS], s[:-1]]) * SIDE + s, minlength=SIDE * SIDE)
            if fresh is not None:
                total[SIDE * SIDE :] += np.frombuffer(fresh, np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def _score(move: np.ndarray, size: np.ndarray, unseen: np.ndarray):
    """move[a, b]: log10 P(b after a); size: log10 of each class's tokens; unseen: P(unknown word | class)."""
    joint = 10.0**move * unseen[None, :]
    novel = np.log10(np.maximum(joint.sum(1), 1e-300))  # of an unknown word after each class
    state = np.argmax(joint, axis=1)  # the class that it then counts as

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(5).to_pylist():
                s = np.frombuffer(raw, np.uint8).astype(np.int64)
                unknown = np.flatnonzero(s == UNKNOWN)
                before = np.concatenate([[END_CLASS], s[:-1]])
                if len(unknown):
                    s = s.copy()
                    for i in unknown.tolist():
                        s[i] = state[s[i - 1] if i else END_CLASS]
                    before = np.concatenate([[END_CLASS], s[:-1]])
                    known = np.ones(len(s), bool)
                    known[unknown] = False
                    out.append((move[before[known], s[known]] - size[s[known]]).sum() + novel[before[unknown]].sum())
                else:
                    out.append((move[before, s] - size[s]).sum())
            score = np.array(out) + batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), batch.column(6), pa.array(score)], ["key", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = FOLDS, held_out: int = HELD_OUT) -> Fitted:
    """Cluster the words of the held-in rows; every row's class sequence, written to the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("_text"), (fold(key, folds) == held_out).alias("held"))
    chunks = stage_table(rows.mapInArrow(_encode(kind), CHUNK.format(kind)), "brown-chunks")
    counts = stage_table(chunks.drop("keys").mapInArrow(_dictionary, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "brown-counts")
    stat = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    total, distinct = stat.total or 0, stat.distinct
    discount = min(0.9, max(0.1, stat.once / max(1, stat.once + 2 * stat.twice)))
    end = int(END_HASH.astype(np.int64))
    top = counts.filter(F.col("word") != end).orderBy(F.desc("n"), "word").limit(CORE).toPandas()  # a fixed number
    ends = (counts.filter(F.col("word") == end).first() or {"n": 0})["n"]
    by_rank = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(by_rank)
    core, core_count = by_rank[order], top["n"].to_numpy(np.int64)[order]
    core_class, contexts = _core_classes(chunks, core, by_rank[:SEEDS])
    fit, size = fit_of(class_table(contexts, core_class))
    narrow = chunks.drop("keys")
    made = chunks.agg(F.count("*").alias("chunks"), F.sum("n_words").alias("words")).first()
    tasks = -(-(made.words or 0) // TASK_ROWS) + 1
    dealt = narrow.mapInArrow(_contexts(core, core_class), "word long, n long, chunk long, place int, near binary").repartition(tasks, "word")
    known = dealt.mapInArrow(_classify(fit, np.log(size)), "chunk long, place int, n long, class short, once short")
    payload = [f"CAST(NULL AS {t}) AS {n}" for n, t in chunks.withColumnRenamed("chunk", "c_chunk").dtypes]
    both = known.selectExpr("chunk", "place", "n", "class", "once", *payload).union(chunks.selectExpr("chunk", "-1", "CAST(NULL AS long)", "CAST(NULL AS short)", "CAST(NULL AS short)", *chunks.columns))
    sequences = stage_table(
        both.repartition(2 * made.chunks + 1, "chunk")
        .sortWithinPartitions("chunk", F.col("place") >= 0)
        .mapInArrow(
            _sequences(core, core_class, core_count, ends, total, distinct, discount),
            f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, words_score double, classes binary, fresh binary",
        ),
        "brown-sequences",
    )
    return Fitted(sequences, total, discount, np.bincount(core_class, minlength=CLASSES))


@dataclass
class Fitted:
    """The documents as class sequences, the number of training tokens, the discount, and the core's distinct words of each class."""

    sequences: DataFrame
    total: int
    discount: float
    core_words: np.ndarray

    def model(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 P(class | class), log10 of the classes' tokens, P(unknown word | class)."""
        moves = self.sequences.select("classes", "held_out", "fresh").mapInArrow(_transitions, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # a fixed number
        table = np.zeros(SIDE * SIDE + UNKNOWN + 1)
        table[moves["pair"]] = moves["n"]
        distinct_of = table[SIDE * SIDE :][:SIDE].copy()
        distinct_of[:CLASSES] += self.core_words
        table = table[: SIDE * SIDE].reshape(SIDE, SIDE)
        size = table.sum(0)
        prior = (size + 1e-9) / (size + 1e-9).sum()
        log_move = np.log10((table + 2 * prior) / (table.sum(1, keepdims=True) + 2))
        log_size = np.log10(np.maximum(size, 1))
        unseen = self.discount * distinct_of / np.maximum(size, 1)
        log_size[END_CLASS] = unseen[END_CLASS] = 0.0
        if not self.total:
            unseen[:] = 1.0
        return log_move, log_size, unseen


def _core_classes(chunks: DataFrame, core: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each core word, and its counts of neighbouring classes.  seeds: the most frequent words, by rank."""
    narrow = chunks.drop("keys")
    sorted_seeds = np.sort(seeds)
    pairs = narrow.mapInArrow(_seed_bigrams(sorted_seeds), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # SEEDS + 1 squared at most
    bigrams = np.zeros((len(seeds) + 1) ** 2)
    bigrams[pairs["pair"]] = pairs["n"]
    rank = np.append(np.searchsorted(sorted_seeds, seeds), len(seeds))
    core_class = np.full(len(core), -1)
    core_class[np.searchsorted(core, seeds)] = exchange(bigrams.reshape(len(seeds) + 1, -1)[np.ix_(rank, rank)])
    contexts = np.zeros((0, WIDTH))
    parts = -(-len(core) // RANGE)
    for sweep in range(CORPUS_SWEEPS + 1):
        per_task = narrow.mapInArrow(_core_contexts(core, core_class), "part int, counts binary")
        rows = per_task.repartition(max(1, parts), "part").mapInArrow(_sum_contexts, "part int, counts binary").collect()  # a fixed number
        contexts = np.zeros((parts * RANGE, WIDTH))
        for r in rows:
            contexts[r.part * RANGE : (r.part + 1) * RANGE] = _unpack(r.counts, np.int64, RANGE * WIDTH).reshape(RANGE, WIDTH)
        contexts = contexts[: len(core)]
        if sweep == CORPUS_SWEEPS or not len(core):
            break
        moved = move_all(contexts, core_class)
        if (moved == core_class).all():
            break
        core_class = moved
    return core_class, contexts


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows whose crc32(key) modulo folds isn't held_out.  A null
    or empty text is its end token.  Every input row, repeated ones too, gives
    one row; other columns are ignored.  Without anything to learn from, all
    words are unknown and have probability 1.
    """
    kind = docs.schema[key].dataType.simpleString()
    fitted = fit(docs, text, key, folds, held_out)
    log_move, log_size, unseen = fitted.model()
    out = fitted.sequences.select("key", "held_out", "n_tokens", "n_known", "words_score", "classes", "base_score").mapInArrow(
        _score(log_move, log_size, unseen), f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(fitted.total).cast("long").alias("train_tokens"), "base_score", "score")
