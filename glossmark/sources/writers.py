"""Sinks: tables as Parquet or JSON, small final files as CSV with a byte order mark for spreadsheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.operators.stats import no_nan

SHEET_COLUMNS = ("tier", "fluency", "acceptable", "tags", "note")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def new_version(df: DataFrame, path: str, version: str) -> str:
    """A table can't be overwritten while it is read, so each change is a new folder; returns its path."""
    df.write.parquet(out := f"{path}/{version}")
    return out


def write_csv(df: DataFrame, path: str, for_spreadsheets: bool = False) -> None:
    """CSV with a header. For spreadsheets the first header cell starts with a byte order mark and there is one file: small tables only."""
    if for_spreadsheets:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]).coalesce(1)
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; NaN is written as a missing value, as JSON has none."""
    df.select(*[no_nan(F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes]).write.mode("overwrite").json(path)


def append_checkpoint(scores: DataFrame, name: str, path: str) -> None:
    """Appends rows (item_id, translator, seg_id, ``name``) to a checkpoint."""
    scores.select(F.array("item_id", "translator", F.col("seg_id").cast("string")).alias("key"), F.col(name).alias("value")).write.mode("append").json(path)


def blank_sheet(df: DataFrame) -> DataFrame:
    """row_id, src_en, hyp_bn and the empty columns that a rater fills."""
    return df.select("row_id", "src_en", "hyp_bn", *[F.lit("").alias(c) for c in SHEET_COLUMNS])
