"""Scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..operators.dataset import fold_metadata


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, quoted line feeds and doubled quotes; all columns text, no inference pass.  Compressed files too."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def articles(spark: SparkSession, path: str, key: str = "article_id", headline: str = "headline", text: str = "text", offset: int = 0, most: int | None = None) -> DataFrame:
    """Articles of a CSV in file order: ``offset`` raw rows are passed over, blank texts dropped, at most ``most`` kept.

    The key falls back to ``id`` and then to the row's place.
    """
    rows = csv(spark, path).withColumn("_at", F.monotonically_increasing_id())
    if key not in rows.columns:
        rows = rows.withColumn(key, F.col("id") if "id" in rows.columns else F.col("_at").cast("string"))
    if offset:
        rows = rows.orderBy("_at").offset(offset)
    rows = rows.filter(T.strip(F.coalesce(F.col(text), F.lit(""))) != "")
    if most is not None:
        rows = rows.orderBy("_at").limit(most)
    rows = rows.withColumn(text, T.strip(F.col(text)))
    if headline in rows.columns:
        rows = rows.withColumn(headline, T.strip(F.coalesce(F.col(headline), F.lit(""))))
    return fold_metadata(rows.drop("_at"), key, headline, text)


def corpus(spark: SparkSession, path: str, categories: list[str], language: str = "bn", columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Rows of some categories and one language with a text, projected."""
    rows = csv(spark, path).filter(F.col("category_original").isin(categories) & (F.col("language") == language) & (T.strip(F.coalesce("text_clean", F.lit(""))) != ""))
    rows = rows.select(*columns) if columns else rows
    return rows.limit(most) if most is not None else rows


def semi_scan(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def json_lines(spark: SparkSession, path: str, schema: ST.StructType | str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt lines); with a key, the last row of each key in file order."""
    kind = ST.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).filter(F.length("value") > 0).withColumn("_at", F.monotonically_increasing_id())
    names = [f.name for f in kind.fields]
    full = ST.StructType([*kind.fields, ST.StructField("_corrupt", ST.StringType())])
    rows = lines.select("_at", "value", F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    good = rows.filter(~broken).select("_at", "r.*").drop("_corrupt")
    if key:
        good = last_wins(good, key, "_at")
    return good.select(*names), rows.filter(broken).select("value")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in ``order``: an aggregation, so one row a key and task is shuffled."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def terms(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct non-blank terms of a dictionary CSV; none if the file isn't there."""
    try:
        rows = csv(spark, path)
    except Exception as error:  # the reader's own class differs between Spark's two clients
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], "term string")
        raise
    return rows.select(T.strip(F.col(column)).alias("term")).filter("term <> ''").distinct()


def routed_terms(rows: DataFrame, term: str, sector: str) -> DataFrame:
    """(term, role): bank, insurance or listed by the sector's name."""
    low = F.lower(F.coalesce(F.col(sector), F.lit("")))
    role = F.when(low.contains("bank"), "bank").when(low.contains("insurance"), "insurance").otherwise("listed")
    return rows.select(F.col(term).alias("term"), role.alias("role"))


def exported_samples(rows: DataFrame, json_columns: dict[str, str], casts: dict[str, str], limit: int | None = None) -> DataFrame:
    """Typed rows of an exported CSV: JSON cells decoded by schema, numbers cast."""
    out = rows.withColumns({**{c: F.from_json(c, s) for c, s in json_columns.items()}, **{c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in casts.items()}})
    return out.limit(limit) if limit is not None else out


def log_metrics(lines: DataFrame, patterns: dict[str, str], column: str = "value") -> DataFrame:
    """One row: of each pattern's first group, the highest and the last number in the log."""
    rows = lines.withColumn("_at", F.monotonically_increasing_id())
    out = []
    for name, pattern in patterns.items():
        v = F.expr(f"try_cast(regexp_extract({column}, '{pattern}', 1) AS double)")
        out += [F.max(v).alias(f"peak_{name}"), F.max_by(v, F.when(v.isNotNull(), F.col("_at"))).alias(f"last_{name}")]
    return rows.agg(*out)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def remap_labels(rows: DataFrame, label: str, mapping: dict[int, int]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return rows.withColumn(label, F.element_at(table, F.col(label)))


def latest(rows: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """Rows whose key isn't processed yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def with_cached(rows: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Rows with the cached plan of their key, if any, and whether it was a hit."""
    plans = cached.select(key, F.struct(*[c for c in cached.columns if c != key]).alias("cached"))
    return rows.join(plans, key, "left").withColumn("cache_hit", F.col("cached").isNotNull())


def ordinals(rows: DataFrame, kind: str, order: list[str]) -> DataFrame:
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(kind).orderBy(*order)) - 1)
