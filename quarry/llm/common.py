"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import application_dir, clean_up, delete, materialize, shared_dir, write_out  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_words(c: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text. Literal replaces and a one-character split cost far less than a pattern."""
    for gap in "\t\n\x0b\x0c\r":
        c = F.replace(c, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(c, " "), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)
