"""Building labelled datasets: sampling, balancing, quotas, splits, unions, leakage audit."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def hash_sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement: those with the smallest hash of key and seed."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def offset_limit(rows: DataFrame, order: list[str], offset: int, n: int) -> DataFrame:
    """Rows offset .. offset + n of an explicit order."""
    return rows.orderBy(*order).offset(offset).limit(n)


def first_n_per_type(rows: DataFrame, kind: str, order: list[str], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def balance(rows: DataFrame, label: str, order: list[str], settle=None) -> DataFrame:
    """As many first rows of each label as the rarest label has."""
    own = ranks.placed(rows, [label], order, settle)
    least = own.agg(F.min("_size").alias("_least"))
    return own.join(F.broadcast(least)).filter(F.col("_place") < F.col("_least")).drop("_place", "_size", "_least")  # one row


def chunk_ids(rows: DataFrame, size: int, order: list[str], settle=None) -> DataFrame:
    """Adds chunk: rows in an explicit order, ``size`` a chunk."""
    own = ranks.placed(rows, [], order, settle)
    return own.withColumn("chunk", F.floor(F.col("_place") / size).cast("long")).drop("_place", "_size")


def seeds(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds a seed below 2**31 to each row, from a hash of its key: the same for every order and partitioning."""
    return rows.withColumn("sample_seed", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**31 - 1)))


def union_fill(parts: list[DataFrame], fill: str = "") -> DataFrame:
    """All rows over the ordered union of columns, as text; what a part lacks or has null is ``fill``."""
    names = list(dict.fromkeys(c for p in parts for c in p.columns))
    out = None
    for p in parts:
        rows = p.select(*[F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(c) if c in p.columns else F.lit(fill).alias(c) for c in names])
        out = rows if out is None else out.unionAll(rows)
    return out


def fold_metadata(rows: DataFrame, key: str, headline: str, text: str) -> DataFrame:
    """article_id, headline, text, metadata: all columns but headline and text as a map of strings, the id included."""
    rest = [c for c in rows.columns if c not in (headline, text)]
    pairs = [x for c in rest for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    head = F.col(headline) if headline in rows.columns else F.lit("")
    return rows.select(F.col(key).cast("string").alias("article_id"), head.alias("headline"), F.col(text).alias("text"), F.create_map(*pairs).alias("metadata"))


def fill(filled: dict[str, int], room: dict[str, float], n: int, groups: int) -> dict[str, int]:
    """How many of ``groups`` groups of n rows each split gets, if each goes to the split that is filled least.

    The j-th group of a split is dealt when it is filled to (filled + j * n) /
    room; so the smallest of these levels are dealt.  All but a few follow from
    a level that a bisection finds; the rest are dealt one by one.
    """
    names = list(room)
    upto = lambda level, s: max(0, int((level * room[s] - filled[s]) // n) + 1)
    low, high = 0.0, max((filled[s] + n * groups) / room[s] for s in names)
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(upto(middle, s) for s in names) <= groups else (low, middle)
    got = {s: upto(low, s) for s in names}
    if sum(got.values()) > groups:
        got = dict.fromkeys(names, 0)
    heap = [((filled[s] + n * got[s]) / room[s], filled[s] + n * got[s], k, s) for k, s in enumerate(names)]
    heapq.heapify(heap)
    for _ in range(groups - sum(got.values())):
        _, rows, k, s = heapq.heappop(heap)
        got[s] += 1
        heapq.heappush(heap, ((rows + n) / room[s], rows + n, k, s))
    return got


def grouped_split(rows: DataFrame, group: str, seed: int = 42, ratios: dict[str, float] | None = None, settle=None) -> DataFrame:
    """Adds split: all rows of a group in one; larger groups first, each to the split that is filled least.

    Groups of the same size are interchangeable, so only their numbers by size
    (few) reach the driver; which of them go where is decided by hash order
    within the size.
    """
    ratios = ratios or SPLITS
    if abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError("split ratios must sum to 1")
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    by_size = sorted(((r["_n"], r["g"]) for r in sizes.groupBy("_n").agg(F.count("*").alias("g")).collect()), reverse=True)
    total = sum(n * g for n, g in by_size)
    room = {s: max(total * share, 1.0) for s, share in ratios.items()}
    filled = dict.fromkeys(room, 0)
    bounds = []
    for n, g in by_size:
        begin = 0
        for s, k in fill(filled, room, n, g).items():
            bounds.append((n, begin, begin + k, s))
            begin += k
            filled[s] += k * n
    limits = rows.sparkSession.createDataFrame(bounds, "_n long, _from long, _to long, split string")
    own = ranks.placed(sizes.withColumn("_h", F.xxhash64(F.col(group), F.lit(seed))), ["_n"], ["_h", group], settle)
    of = own.join(F.broadcast(limits), "_n").filter((F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to"))).select(group, "split")  # a row for each size and split
    return rows.join(of, group)


def hash_split(rows: DataFrame, group: str, seed: int = 42, ratios: dict[str, float] | None = None) -> DataFrame:
    """The same without any shuffle: a group's split follows from its hash; shares are met on average."""
    place, out, upto = F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(10_000)), None, 0.0
    for name, share in (ratios or SPLITS).items():
        upto += share
        hit = place < round(upto * 10_000)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return rows.withColumn("split", out)


def leakage(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """One row: has_leakage, leaky_ids, unique_ids, missing_split_rows, rows."""
    name = F.coalesce(F.nullif(F.col(split), F.lit("")), F.lit("unknown"))
    per_group = rows.groupBy(group).agg(F.count_distinct(name).alias("_k"), F.count_if(name == "unknown").alias("_missing"), F.count("*").alias("_rows"))
    known = F.col(group).isNotNull()
    return per_group.agg(
        (F.coalesce(F.count_if(known & (F.col("_k") > 1)) > 0, F.lit(False)) | (F.coalesce(F.sum("_missing"), F.lit(0)) > 0)).alias("has_leakage"),
        F.count_if(known & (F.col("_k") > 1)).alias("leaky_ids"),
        F.count_if(known).alias("unique_ids"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_split_rows"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
    )


def require_no_leakage(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    found = leakage(rows, group, split).first()
    if found["has_leakage"]:
        raise ValueError(f"{found['leaky_ids']} groups are in several splits, {found['missing_split_rows']} rows in none")
    return rows


def quota(candidates: DataFrame, kind: str, valid: Column, order: list[str], per_kind: int) -> DataFrame:
    """The first ``per_kind`` valid candidates of each kind."""
    return first_n_per_type(candidates.filter(valid), kind, order, per_kind)
