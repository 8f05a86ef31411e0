"""Vector similarity: pairs, nearest neighbours and greedy acceptance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Rows of one side that meet a block of the other in one task.
BLOCK = 4_096


def _unit(rows: pd.DataFrame, vector: str) -> np.ndarray:
    x = np.stack(rows[vector].to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def similar_pairs(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(left_id, right_id, similarity) of all pairs left < right with cosine >= least, exactly.

    Rows are dealt into n blocks by a hash; each pair of blocks meets in one
    task as a matrix product, so every row is sent n times and no pair is made
    that isn't similar.  All vectors have the same length; nulls take no part.
    """
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = max(1, -(-rows.count() // block))
    own = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    other = F.sequence(F.lit(0), F.lit(n - 1))
    dealt = own.withColumn("o", F.explode(other)).select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "id", "v")

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        p, q = rows["p"].iloc[0], rows["q"].iloc[0]
        a, b = rows[rows["b"] == p], rows[rows["b"] == q]
        if not len(a) or not len(b):
            return pd.DataFrame({"left_id": [], "right_id": [], "similarity": []})
        s = _unit(a, "v") @ _unit(b, "v").T
        i, j = np.nonzero(s >= least - 1e-12)
        x, y = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        some = x < y if p == q else x != y
        return pd.DataFrame({"left_id": np.minimum(x, y)[some], "right_id": np.maximum(x, y)[some], "similarity": s[i, j][some]})

    return dealt.groupBy("p", "q").applyInPandas(near, "left_id long, right_id long, similarity double")


def earlier_similarity(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(key, max_seen): each row's highest cosine to any row with a smaller key; null for the first.

    Blocks meet as in ``similar_pairs``; a task sends one row for each of its
    rows, not one for each pair.
    """
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = max(1, -(-rows.count() // block))
    own = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    dealt = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "id", "v")

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = rows["id"].to_numpy(), _unit(rows, "v")
        out = np.full(len(ids), -np.inf)
        for k in range(0, len(ids), 1024):
            s = x[k : k + 1024] @ x.T
            out[k : k + 1024] = np.where(ids[None, :] < ids[k : k + 1024, None], s, -np.inf).max(1)
        some = np.isfinite(out)
        return pd.DataFrame({"id": ids[some], "s": out[some]})

    found = dealt.groupBy("p", "q").applyInPandas(near, "id long, s double").groupBy("id").agg(F.max("s").alias("max_seen"))
    return rows.select("id").join(found, "id", "left").select(F.col("id").alias(key), "max_seen")


def max_similarity(pairs: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    """Highest similarity of each id to any other among the pairs; 0 without one."""
    both = pairs.select(F.col("left_id").alias(key), "similarity").union(pairs.select(F.col("right_id").alias(key), "similarity"))
    return ids.select(key).join(both.groupBy(key).agg(F.max("similarity").alias("max_similarity")), key, "left").withColumn("max_similarity", F.coalesce("max_similarity", F.lit(0.0)))


def greedy_accept(pairs: DataFrame, ids: DataFrame, key: str = "vec_id", settle=None) -> DataFrame:
    """(key, accepted): in the order of ids, a row is accepted unless an accepted earlier one is similar.

    Solved in rounds over the pairs still open: a row that is no open pair's
    later side is accepted, and the later sides of its pairs are rejected;
    pairs with a decided side are closed.  Each round decides the smallest open
    id at least.  ``settle`` writes a round's state where executors share it;
    by default checkpoint().
    """
    settle = settle or (lambda df: df.checkpoint())
    still = settle(pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).distinct())
    rejected = None
    while not still.isEmpty():
        later = still.select(F.col("b").alias("a")).distinct()
        first = still.join(later, "a", "left_anti")
        out = settle(first.select("b").distinct())
        rejected = out if rejected is None else rejected.union(out)
        closed = still.join(out, "b", "left_anti").join(out.withColumnRenamed("b", "a"), "a", "left_anti")
        still = settle(closed.select("a", "b"))
    rows = ids.select(key)
    if rejected is None:
        return rows.withColumn("accepted", F.lit(True))
    gone = rejected.select(F.col("b").alias(key)).distinct().withColumn("accepted", F.lit(False))
    return rows.join(gone, key, "left").withColumn("accepted", F.coalesce("accepted", F.lit(True)))


def max_reference_jaccard(docs: DataFrame, references: DataFrame, key: str = "doc_id", text: str = "text", reference_key: str = "item_id", reference_text: str = "text", grams: int = 0) -> DataFrame:
    """Best Jaccard of each document with any reference text, over words or (grams > 0) character n-grams.

    A shared feature brings a pair together, so only overlapping pairs meet; the
    counts that Jaccard needs are summed per pair.  Documents without a shared
    feature are left out.
    """
    cut = lambda c: T.ngrams(c, grams) if grams else F.array_distinct(T.words(c))
    d = docs.select(F.col(key), cut(F.col(text)).alias("f"))
    r = references.select(F.col(reference_key), cut(F.col(reference_text)).alias("f"))
    left = d.select(key, F.size("f").alias("n"), F.explode("f").alias("f"))
    right = r.select(reference_key, F.size("f").alias("m"), F.explode("f").alias("f"))
    shared = left.join(right, "f").groupBy(key, reference_key, "n", "m").agg(F.count("*").alias("c"))
    scored = shared.withColumn("jaccard", F.col("c") / (F.col("n") + F.col("m") - F.col("c")))
    best = scored.groupBy(key).agg(F.max_by(F.struct(reference_key, "jaccard"), F.struct("jaccard", -F.col(reference_key))).alias("b"))
    return best.select(key, F.col(f"b.{reference_key}").alias(reference_key), F.col("b.jaccard").alias("jaccard"))
