"""Sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..operators import dataset, reports

WORKBOOK_SHEETS = ("Instructions", "Samples", "Full Articles", "Provenance")


def flat(rows: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text."""
    nested = (ST.StructType, ST.ArrayType, ST.MapType)
    return rows.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema.fields])


def write_csv(rows: DataFrame, path: str, compression: str | None = None) -> None:
    out = flat(rows).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True)
    (out.option("compression", compression) if compression else out).csv(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def metadata(rows: DataFrame, name: str, stats: dict, kinds: tuple[str, ...] = ()) -> dict:
    """A run's metadata: name, number of rows, stats, columns and distributions."""
    out = {"pipeline": name, "total": rows.count(), "stats": stats, "columns": rows.columns}
    for k in kinds:
        out[f"{k}_distribution"] = {r[k]: r["n"] for r in reports.distribution(rows, k).collect()}
    return out


def write_metadata(rows: DataFrame, path: str, name: str, stats: dict, kinds: tuple[str, ...] = ()) -> None:
    body = json.dumps(metadata(rows, name, stats, kinds), ensure_ascii=False)
    rows.sparkSession.range(1, numPartitions=1).select(F.lit(body).alias("value")).write.mode("overwrite").text(path)


def write_splits(rows: DataFrame, path: str, group: str, split: str = "split") -> None:
    """Partitioned by split; raises if a group is in several."""
    dataset.require_no_leakage(rows, group, split).write.mode("overwrite").partitionBy(split).parquet(path)


def filter_rate(raw: DataFrame, filtered: DataFrame) -> DataFrame:
    """One row: raw, filtered, filter_rate."""
    a, b = raw.agg(F.count("*").alias("raw")), filtered.agg(F.count("*").alias("filtered"))
    return a.crossJoin(F.broadcast(b)).withColumn("filter_rate", F.when(F.col("raw") > 0, F.round(1 - F.col("filtered") / F.col("raw"), 4)).otherwise(0.0))  # one row each


def kept_and_discarded(rows: DataFrame, path: str, reason: str = "discard_reason") -> None:
    rows.filter(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(f"{path}/kept")
    rows.filter(F.col(reason).isNotNull()).write.mode("overwrite").parquet(f"{path}/discarded")


def workbook_sheets(samples: DataFrame) -> dict[str, DataFrame]:
    """The workbook's sheets as DataFrames; annotators fill the empty columns."""
    blank = [F.lit("").alias(c) for c in ("is_altered", "contradiction", "fluency", "comments")]
    guide = samples.sparkSession.createDataFrame([("1", "Read the claim in its context."), ("2", "Judge whether the claim was altered before you open the full article.")], "step string, instruction string")
    return {
        "Instructions": guide,
        "Samples": samples.select("sample_id", "headline", "sentence", "context", "rewritten_sentence", "rewritten_context", *blank),
        "Full Articles": samples.select("sample_id", "headline", "text", "rewritten"),
        "Provenance": samples.select("sample_id", "article_id", "edit_family", "label", "original_id"),
    }


#: Rows that a sheet can hold, its header included.
SHEET_ROWS = 1_048_576


def write_workbook(samples: DataFrame, path: str) -> None:
    """An XLSX with one sheet each, streamed row by row; more samples than a sheet can hold are an error, none is left out."""
    try:
        import openpyxl
    except ImportError as error:
        raise RuntimeError("openpyxl is needed to write workbooks") from error
    if samples.count() >= SHEET_ROWS:
        raise ValueError(f"a workbook holds fewer than {SHEET_ROWS} samples; write several")
    book = openpyxl.Workbook(write_only=True)
    for name, rows in workbook_sheets(samples).items():
        sheet = book.create_sheet(name)
        sheet.append(rows.columns)
        for r in rows.toLocalIterator():
            sheet.append(list(r))
        if name == "Provenance":
            sheet.sheet_state = "hidden"
    book.save(path)
