"""Near duplicates: 64-bit SimHash fingerprints within a Hamming distance.

Generalised pigeonhole: the 64 bits are grouped by correlation into
partitions; partition i gets a threshold t_i (-1: not searched) with
sum(t_i) = distance - partitions + 1, so that two fingerprints within the
distance agree in at least one partition up to its threshold.  Thresholds are
allocated by dynamic programming on candidate counts estimated from a sample
of fingerprints.  Every distinct fingerprint is indexed under its value in
each searched partition and probed under all values within the threshold;
members of a bucket are verified on all 64 bits.

Copies share a fingerprint and are counted once.  A bucket yields links that
span its linked members, not all its pairs, and buckets that are too large are
dealt again over three parts of the remaining bits, which loses no link.
Components are found by alternating large and small stars over those links.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, stage_table, text_of

DISTANCE, SHINGLE, SEED = 2, 3, 42
#: Bit correlations and candidate counts are estimated on at most so many distinct fingerprints.
SAMPLE = 4_000
#: Buckets with more distinct fingerprints than this are dealt again over the remaining bits.
BUCKET = 50_000
#: Up to this many members a bucket is verified pair by pair, beyond it by looking up all values within the distance.
PAIRWISE = 1_500


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text; 0 for a text without words."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b in slices([len(t) for t in texts]):
        hashes: list[int] = []
        counts = np.zeros(b - a, np.int64)
        for i, t in enumerate(texts[a:b]):
            words = t.lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
            if not words:
                continue
            joined = b" ".join(words)
            if len(words) <= shingle:
                hashes.append(digest(joined, SEED))
                counts[i] = 1
                continue
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
            hashes += [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
            counts[i] = len(words) - shingle + 1
        some = np.flatnonzero(counts)
        if not len(some):
            continue
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        start = (np.cumsum(counts) - counts)[some]
        ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        out[a + some] = np.packbits(2 * ones > counts[some, None], axis=1).view(">u8").ravel()
    return out


def fingerprint_table(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long, written to the shared folder."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            got = fingerprints([t.encode() for t in batch.column(1).to_pylist()], shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return stage_table(docs.select(F.col(key), text_of(text).alias("_text")).mapInArrow(run, f"doc_id {kind}, fp long"), "simhash-fp")


@dataclass
class Plan:
    """masks: of the bits of each partition; thresholds: of each, -1 for not searched."""

    masks: list[int]
    thresholds: list[int]


def _parts(bits: np.ndarray, m: int, among: list[int]) -> list[list[int]]:
    """``among`` cut into m groups of about equal size, each gathering bits that correlate with its first."""
    if len(bits) > 1:
        c = np.abs(np.nan_to_num(np.corrcoef(bits.T + 0.0))) if bits.std(0).any() else np.zeros((64, 64))
    else:
        c = np.zeros((64, 64))
    left, out = list(among), []
    for k in range(m, 0, -1):
        size = -(-len(left) // k)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (c[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def _mask(group: list[int]) -> int:
    return sum(1 << b for b in group)


def plan(sample: np.ndarray, total: int, distance: int = DISTANCE) -> Plan:
    """The partitioning into 2 to distance + 2 groups, and its thresholds, with the least estimated work.

    Work of a partition with threshold t: the keys that a fingerprint is
    probed under, plus the candidates that this brings, estimated as the
    sample's share of pairs within t in this partition times the number of
    fingerprints (never under that of evenly spread bits).
    """
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    a = sample[: len(sample) // 2]
    b = sample[len(sample) // 2 :][: len(a)]
    best = None
    for m in range(2, distance + 3):
        groups = _parts(bits, m, list(range(64)))
        budget = distance - m + 1
        cost = []
        for g in groups:
            mask = np.uint64(_mask(g))
            apart = np.concatenate([np.bitwise_count((a ^ np.roll(b, k)) & mask) for k in range(16)]) if len(a) else np.zeros(0)
            row = {-1: 0.0}
            for t in range(distance + 1):
                probes = sum(comb(len(g), k) for k in range(t + 1))
                row[t] = probes + total * max(float((apart <= t).mean()) if len(apart) else 0.0, probes / 2 ** len(g))
            cost.append(row)
        states = {0: (0.0, [])}  # sum of thresholds so far: least cost, thresholds
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in states.items():
                for t, w in row.items():
                    if s + t not in step or c + w < step[s + t][0]:
                        step[s + t] = (c + w, [*ts, t])
            states = step
        if budget in states and (best is None or states[budget][0] < best[0]):
            best = (states[budget][0], Plan([_mask(g) for g in groups], states[budget][1]))
    return best[1]


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _union(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        i, j = _find(parent, i), _find(parent, j)
        if i != j:
            parent[max(i, j)] = min(i, j)


def linked(values: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For sorted distinct values: position of the smallest value that each is connected to by steps within the distance."""
    n = len(values)
    parent = np.arange(n)
    if n <= PAIRWISE:
        for i in range(0, n, 256):
            near = np.bitwise_count(values[i : i + 256, None] ^ values[None, i:]) <= distance
            left, right = np.nonzero(near)
            ahead = right > left
            _union(parent, left[ahead] + i, right[ahead] + i)
    else:
        varying = int(np.bitwise_or.reduce(values ^ values[0]))
        flips = [1 << b for b in range(64) if varying >> b & 1]
        for k in range(1, distance + 1):
            for some in combinations(flips, k):
                other = values ^ np.uint64(sum(some))
                at = np.searchsorted(values, other)
                at[at == n] = 0
                hit = np.flatnonzero((values[at] == other) & (other > values))
                _union(parent, hit, at[hit])
    return np.array([_find(parent, i) for i in range(n)], np.int64)


def _bucket_links(distance: int):
    """Over rows (k0, k1, k2, fp) sorted by key: (fp, smallest linked fp of the bucket) where they differ."""

    def links(key: np.ndarray, fp: np.ndarray):
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        size = np.diff(edge)
        at = edge[:-1][size == 2]
        near = at[np.bitwise_count(fp[at] ^ fp[at + 1]) <= distance]
        low, high = np.minimum(fp[near], fp[near + 1]), np.maximum(fp[near], fp[near + 1])
        members, roots = [high[high != low]], [low[high != low]]
        for s, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            values = np.unique(fp[s : s + n])
            root = linked(values, distance)
            own = root != np.arange(len(values))
            members.append(values[own])
            roots.append(values[root[own]])
        return np.concatenate(members), np.concatenate(roots)

    def run(batches):
        held_key, held_fp = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key = np.concatenate([held_key, np.stack(columns[:3], 1).astype(np.int64)])
            fp = np.concatenate([held_fp, columns[3].astype(np.int64).view(np.uint64)])
            cut = len(key) - 1  # the last key's rows may go on in the next batch
            while cut and (key[cut - 1] == key[-1]).all():
                cut -= 1
            if cut:
                m, r = links(key[:cut], fp[:cut])
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(r.view(np.int64))], ["v", "m"])
            held_key, held_fp = key[cut:], fp[cut:]
        if len(held_key):
            m, r = links(held_key, held_fp)
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(r.view(np.int64))], ["v", "m"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def find_links(distinct: DataFrame, how: Plan, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (v, m) that span, in each bucket, what is connected within the distance.  distinct: one column fp."""
    keys = []
    for i, (mask, t) in enumerate(zip(how.masks, how.thresholds, strict=True)):
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        places = [b for b in range(64) if mask >> b & 1]
        for k in range(t + 1):
            for some in combinations(places, k):
                keys.append(F.struct(F.lit(4 * i).alias("k0"), own.bitwiseXOR(F.lit(_signed(sum(1 << b for b in some)))).alias("k1"), F.lit(0).cast("long").alias("k2")))
    keyed = distinct.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.*", "fp")
    heavy = stage_table(keyed.groupBy("k0", "k1").count().filter(F.col("count") > bucket).select("k0", "k1", F.lit(True).alias("heavy")), "simhash-heavy")
    if not heavy.isEmpty():
        rest = F.array(
            *[
                F.struct((F.col("k0") + 1 + j).alias("k0"), F.col("k1"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(g)))).alias("k2"), F.lit(i).alias("i"))
                for i, mask in enumerate(how.masks)
                for j, g in enumerate(_parts(np.zeros((0, 64)), distance + 1, [b for b in range(64) if not mask >> b & 1]))
            ]
        )
        part = (F.col("k0") / 4).cast("int")
        split = keyed.join(heavy, ["k0", "k1"]).select(F.explode(F.filter(rest, lambda s: s["i"] == part)).alias("s"), "fp").select("s.k0", "s.k1", "s.k2", "fp")
        keyed = keyed.join(heavy, ["k0", "k1"], "left_anti").select("k0", "k1", "k2", "fp").unionByName(split)
    dealt = keyed.repartition("k0", "k1", "k2").sortWithinPartitions("k0", "k1", "k2")
    return dealt.mapInArrow(_bucket_links(distance), "v long, m long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, m): every linked value v that isn't its component's smallest, and that smallest, m.

    Alternating large star and small star; each round is written to the shared folder.
    """
    edges, before = stage_table(links.filter("v != m").select("v", "m"), "simhash-links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            return edges
        before = state
        both = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("_m")).select("v", F.least("v", "_m").alias("_m"))
        large = both.join(least, "v").filter("m > v").select(F.col("m").alias("v"), F.col("_m").alias("m"))
        down = large.select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("m")).filter("v != m").distinct()
        lowest = down.groupBy("v").agg(F.min("m").alias("_m"))
        small = down.join(lowest, "v").select(F.explode(F.array("v", "m")).alias("v"), F.col("_m").alias("m")).filter("v != m").distinct()
        edges = stage_table(small, "simhash-links")


def _roots(distinct: DataFrame, distance: int, bucket: int) -> DataFrame:
    """(v, m): every fingerprint that isn't its component's smallest, and that smallest.  distinct: one column fp, written before."""
    total = distinct.count()
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    return components(find_links(distinct, plan(sample, total, distance), distance, bucket))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id is the smallest doc_id that can be reached over links of at
    most ``distance`` bits, the row's own included; nulls among doc_ids are
    passed over, and a component of nulls only has a null id.  Null and empty
    texts have fingerprint zero and are linked like any other.  Other columns
    are ignored.
    """
    prints = fingerprint_table(docs, text, key, shingle)
    classes = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = _roots(classes.select("fp"), distance, bucket)
    rooted = classes.join(roots.select(F.col("v").alias("fp"), "m"), "fp", "left").select("fp", "first", F.coalesce("m", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id").withColumnRenamed("doc_id", key)


def one_of_each(rows: DataFrame, classes: DataFrame, roots: DataFrame, names: list[str], key: str) -> DataFrame:
    """Of each component one row, one with its smallest key; and all rows without key, for they can't stand for a component.

    rows: with their number ``_row``; classes: (v, best), best the (id, row) of
    the smallest key; roots: (v, m).  Texts are dealt once, by row number.
    """
    chosen = classes.join(roots, "v", "left").groupBy(F.coalesce("m", "v").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("_row"))
    kept = rows.join(chosen.filter("_row IS NOT NULL").hint("shuffle_hash"), "_row", "left_semi")
    return kept.select(names).unionByName(rows.filter(F.col(key).isNull()).select(names))


def best_row(key: str):
    """(id, row) of the smallest key, as an aggregate."""
    return F.min(F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("id"), F.col("_row").alias("row"))))


def keep(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE, ratio: tuple[int, int] | None = None) -> DataFrame:
    """One document of each component, one with the smallest key, with all its columns.

    Texts are linked by fingerprints within the distance or, if a ratio is
    given, by shingle sets of at least that Jaccard similarity (``overlap``);
    64 bits can't tell 0.8 from less.  Rows without key all stay.  Null and
    empty texts are copies of each other.  Rows that repeat are copies; texts
    that differ are told apart even where they share a key.  An empty table
    gives an empty table.
    """
    if ratio is not None:
        from . import overlap

        return overlap.keep(docs, text, key, shingle, ratio)
    small_batches(docs.sparkSession)
    columns = len(docs.columns)

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            got = fingerprints([t.encode() for t in batch.column(columns).to_pylist()], shingle)
            own = [batch.column(k) for k in range(columns)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(number, number + len(got))), pa.array(got.view(np.int64))], [*batch.schema.names[:columns], "_row", "_fp"])
            number += len(got)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = stage_table(docs.withColumn("_shingled", text_of(text)).mapInArrow(run, f"{schema}, _row long, _fp long"), "simhash-rows")
    classes = stage_table(rows.groupBy(F.col("_fp").alias("v")).agg(best_row(key).alias("best")), "simhash-classes")
    return one_of_each(rows, classes, _roots(classes.select(F.col("v").alias("fp")), distance, BUCKET), docs.columns, key)
