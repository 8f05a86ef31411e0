"""Grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def per_minute(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.round(n / seconds * 60, 4)).otherwise(0.0)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, 2)).otherwise(0.0)


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(0.0)


def distribution(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Counts, most common first; ties by value."""
    out = distribution(rows, column).orderBy(F.desc("n"), column)
    return out.limit(n) if n else out


def two_way(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of each value of ``column`` by ``row``, and their percentages of the row."""
    counts = [F.count_if(F.col(column) == v) for v in values]
    return rows.groupBy(row).agg(*[c.alias(f"n_{v}") for c, v in zip(counts, values, strict=True)], *[percent(c, F.count("*")).alias(f"pct_{v}") for c, v in zip(counts, values, strict=True)])


def reason_counts(failures: DataFrame, reason: str = "reason", attempts: str | None = None) -> DataFrame:
    """(kind, reason, n): failure reasons, and verifier reasons nested in attempts' ``reasons`` arrays."""
    out = failures.groupBy(F.coalesce(F.col(reason), F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n")).select(F.lit("failure").alias("kind"), "reason", "n")
    if attempts:
        nested = failures.select(F.explode(attempts).alias("a")).select(F.explode("a.reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
        out = out.unionAll(nested.select(F.lit("verifier").alias("kind"), "reason", "n"))
    return out


def run_metrics(rows: DataFrame, accepted: Column, attempts: Column, seconds: Column) -> DataFrame:
    """One row of a run's rates, throughput and retries."""
    n, ok = F.count("*"), F.count_if(accepted)
    return rows.agg(
        n.alias("input_articles"),
        ok.alias("accepted"),
        (n - ok).alias("failed"),
        safe_ratio(ok, n).alias("acceptance_rate"),
        F.round(F.coalesce(F.avg(attempts), F.lit(0.0)), 4).alias("average_attempts"),
        safe_ratio(F.count_if(accepted & (attempts == 1)), ok).alias("first_attempt_acceptance_rate"),
        F.count_if(accepted & (attempts > 1)).alias("accepted_after_retry"),
        per_minute(n, F.sum(seconds)).alias("articles_per_minute"),
        per_minute(ok, F.sum(seconds)).alias("accepted_per_minute"),
    )


def mean_seconds(rows: DataFrame, name: str, seconds: str, items: str) -> DataFrame:
    return rows.groupBy(name).agg(F.when(F.sum(items) > 0, F.round(F.sum(seconds) / F.sum(items), 4)).otherwise(0.0).alias("mean_seconds"))


def type_stats(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """mean, median, population deviation, least, most, n of each type."""
    v = F.col(value)
    return rows.groupBy(kind).agg(
        F.round(F.avg(v), 4).alias("mean"), F.round(F.percentile(v, 0.5), 4).alias("median"), F.round(F.stddev_pop(v), 4).alias("std"), F.round(F.min(v), 4).alias("min"), F.round(F.max(v), 4).alias("max"), F.count(v).alias("n")
    )


def upper_median(rows: DataFrame, kind: str, value: str, settle=None) -> DataFrame:
    """The element at place n div 2 of each type's sorted values, by rank and not by collecting them."""
    own = ranks.placed(rows.filter(F.col(value).isNotNull()).select(kind, value), [kind], [value], settle)
    return own.filter(F.col("_place") == F.floor(F.col("_size") / 2)).select(kind, F.col(value).alias("upper_median"))


def threshold_sweep(rows: DataFrame, kind: str, score: str, thresholds: list[float]) -> DataFrame:
    """(threshold, kept, pct, least_type_pct) for each threshold, from one pass over the rows."""
    per_kind = rows.groupBy(kind).agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col(score) >= t) for t in thresholds]).alias("k"))
    long = per_kind.select("n", F.explode(F.arrays_zip(F.array(*[F.lit(float(t)) for t in thresholds]).alias("threshold"), F.col("k").alias("kept"))).alias("x")).select("n", "x.threshold", "x.kept")
    return long.groupBy("threshold").agg(F.sum("kept").alias("kept"), percent(F.sum("kept"), F.sum("n")).alias("pct"), F.min(percent(F.col("kept"), F.col("n"))).alias("least_type_pct"))


def binned(rows: DataFrame, key: str, score: str, edges: list[float], examples: int = 2) -> DataFrame:
    """(bin, key, score, place): up to ``examples`` rows of each bin [edge, next edge), smallest keys first."""
    place = F.width_bucket(F.col(score), F.lit(edges[0]), F.lit(edges[-1]), F.lit(len(edges) - 1)) if len({round(b - a, 12) for a, b in zip(edges, edges[1:], strict=False)}) == 1 else None
    if place is None:
        place = F.lit(0)
        for k, e in enumerate(edges, 1):
            place = F.when(F.col(score) >= e, k).otherwise(place)
    rank = F.row_number().over(Window.partitionBy("bin").orderBy(key))
    return rows.select(place.cast("int").alias("bin"), key, score).filter("bin > 0").withColumn("place", rank).filter(F.col("place") <= examples)


def classification(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1, weighted F1.

    Everything comes from the confusion counts, which are few.
    """
    cells = rows.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    per = cells.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("s"), F.lit(0).cast("long").alias("g"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("s"), F.col("n").alias("g"), F.lit(0).cast("long").alias("t")))).alias("x")).select("x.*")
    by_class = per.groupBy("c").agg(F.sum("s").alias("s"), F.sum("g").alias("g"), F.sum("t").alias("t"))
    precision, recall = F.coalesce(F.try_divide("t", "g"), F.lit(0.0)), F.coalesce(F.try_divide("t", "s"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("t"), F.col("s") + F.col("g")), F.lit(0.0))
    return by_class.agg(
        F.round(F.sum("t") / F.sum("s"), 4).alias("accuracy"),
        F.round(F.avg(precision), 4).alias("macro_precision"),
        F.round(F.avg(recall), 4).alias("macro_recall"),
        F.round(F.avg(f1), 4).alias("macro_f1"),
        F.round(F.sum(f1 * F.col("s")) / F.sum("s"), 4).alias("weighted_f1"),
    )


def ensemble(votes: DataFrame, key: str, probabilities: str, weight: str) -> DataFrame:
    """(key, probability array, label): weighted mean of each class over the models present; the first highest class wins."""
    rows = votes.select(key, weight, F.posexplode(probabilities).alias("c", "p"))
    per = rows.groupBy(key, "c").agg((F.sum(F.col("p") * F.col(weight)) / F.sum(weight)).alias("p"))
    out = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("c", F.round("p", 6).alias("p")))).alias("a")).select(key, F.transform("a", lambda x: x["p"]).alias("probability"))
    return out.withColumn("label", (F.array_position("probability", F.array_max("probability")) - 1).cast("int"))


def fleiss_kappa(votes: DataFrame, item: str, category: str) -> DataFrame:
    """One row: kappa over items with the same number of ratings (at least two)."""
    cells = votes.groupBy(item, category).agg(F.count("*").alias("n"))
    items = cells.groupBy(item).agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("n")).alias("q")).filter("k > 1")
    shares = cells.join(items.select(item), item, "left_semi").groupBy(category).agg(F.sum("n").alias("m"))
    chance = shares.agg((F.sum(F.col("m") * F.col("m")) / (F.sum("m") * F.sum("m"))).alias("pe"))
    seen = items.agg(F.avg((F.col("q") - F.col("k")) / (F.col("k") * (F.col("k") - 1))).alias("pa"))
    kappa = F.when(F.col("pe") < 1, (F.col("pa") - F.col("pe")) / (1 - F.col("pe"))).otherwise(1.0)
    return seen.crossJoin(F.broadcast(chance)).select(F.round("pa", 4).alias("agreement"), F.round("pe", 4).alias("chance"), F.round(kappa, 4).alias("kappa"))  # one row each


def majority(votes: DataFrame, item: str, category: str) -> DataFrame:
    """(item, category, votes): the most frequent category, ties to the smallest."""
    counts = votes.groupBy(item, category).agg(F.count("*").alias("votes"))
    rank = F.row_number().over(Window.partitionBy(item).orderBy(F.desc("votes"), category))
    return counts.withColumn("_r", rank).filter("_r = 1").drop("_r")


def correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.agg(F.round(F.corr(a, b), 4).alias("correlation"), F.count("*").alias("n"))
