"""Tab-separated results, id files and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_lists(s1: DataFrame, pairs: DataFrame, column: str, by: str = "rank") -> DataFrame:
    """(source1_entity_id, column): a row for each S1 id, its targets in order of ``by``, joined by commas."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), F.col("tid").alias("t")))), lambda x: x["t"]), ",").alias(column))
    return s1.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Tab-separated files with a header, in order of the first column, quoted where ``read_table`` needs it."""
    ordered = df.orderBy(df.columns[0])
    writer = ordered.write.option("sep", "\t").option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quote", '"').option("escape", '"')
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_ids(df: DataFrame, column: str, path: str) -> None:
    """Ids, one a line, in order."""
    df.select(column).orderBy(column).write.text(path)


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): a SHA-256 that does not depend on the order of rows; rows are hashed apart, so only digests are gathered."""
    row = F.sha2(F.concat_ws("\t", *columns), 256)
    top = F.conv(F.substring(row, 1, 12), 16, 10).cast("long")
    return df.select(top.alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("digest"))


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated files with a header; quotes are doubled."""
    df.write.csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line; nulls are written."""
    df.write.option("ignoreNullFields", False).json(path)
