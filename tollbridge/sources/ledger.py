"""Certificate ledgers: tab-separated lines of status, expiry, serial and subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tollbridge.functions.text import hex_number, parse_subject

# The six columns of a line, in order, and the form of the expiry.
COLUMNS = ["status", "not_after", "c3", "serial", "filename", "subject"]
EXPIRY_FORMAT = "yyMMddHHmmssX"


def parse_ledger(df: DataFrame, line_col: str = "value") -> DataFrame:
    """Replace a ledger-line column by its six typed columns; empty texts become null."""
    parts = F.split(F.col(line_col), "\t")

    def field(name: str):
        return F.nullif(F.get(parts, F.lit(COLUMNS.index(name))), F.lit(""))

    return df.select(
        *[c for c in df.columns if c != line_col],
        field("status").alias("status"),
        F.try_to_timestamp(field("not_after"), F.lit(EXPIRY_FORMAT)).alias("not_after"),
        field("c3").alias("c3"),
        hex_number(field("serial")).alias("serial"),
        field("filename").alias("filename"),
        parse_subject(field("subject")).alias("subject"),
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of the ledger files under ``path``; blank lines hold no entry."""
    lines = spark.read.text(path)
    return parse_ledger(lines.filter(F.trim("value") != ""), "value")
