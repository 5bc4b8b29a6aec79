"""Deterministic samples: every draw orders rows by a hash of a seed and the key, so a rerun gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def order_hash(key: Column, seed: int = 42) -> Column:
    """A shuffled place of a key of any type: leading hex digits of the MD5 of seed and key, which other engines have too."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(order_hash(F.col(key), seed), key)


def draw(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, or all if there are fewer."""
    return shuffled(df, key, seed).limit(n)


def draw_by_stratum(df: DataFrame, stratum: str, key: str, quota: int | Column, seed: int = 42) -> DataFrame:
    """Up to ``quota`` rows of each stratum. The ranked rows carry the key alone; a rank filter keeps few on each task first."""
    w = Window.partitionBy(stratum).orderBy(order_hash(F.col(key), seed), key)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= quota).drop("__r")


def smallest(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest score; null scores are left out, ties go by key."""
    return df.filter(F.col(score).isNotNull()).orderBy(F.asc(score), key).limit(n)


def largest(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    return df.filter(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(n)


def without(df: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(taken.select(*keys).distinct(), keys, "left_anti")


def numbered(df: DataFrame, prefix: str, key: str, seed: int = 42) -> DataFrame:
    """Adds ``row_id`` (a letter and four digits) in shuffled order. For samples, whose size is a parameter."""
    w = Window.orderBy(order_hash(F.col(key), seed), key)
    return df.withColumn("row_id", F.format_string(prefix + "%04d", F.row_number().over(w)))
