"""Sinks: upserts by key, pruning after a successful write, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after a merge: all new rows, and old rows whose key is not among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of every parent in ``new`` replaced as a whole; stale ones go."""
    return upsert(old, new, [parent])


def first_of(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group in an order."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def overwrite_keys(df: DataFrame, path: str, partition: str) -> None:
    """Write by partition; only partitions that occur in ``df`` are replaced, when the job commits."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_new_keys(df: DataFrame, stored: DataFrame | None, keys: list[str], path: str) -> None:
    """Append rows whose key is not stored yet; the checkpoint of a resumable job."""
    fresh = df if stored is None else df.join(stored.select(*keys).distinct(), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def spreadsheet_safe(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(value.rlike(r"^\s*[=+@-]") | value.rlike(r"^[\t\r\n]"), F.concat(F.lit("'"), value)).otherwise(value)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with safe cells and a header."""
    safe = [spreadsheet_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One Markdown table row a row, in column ``line``."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([\\*_{}\[\]<>#|`])", r"\\$1")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))
