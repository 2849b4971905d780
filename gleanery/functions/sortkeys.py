"""Sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_aware(rows: DataFrame, column: str, reverse: bool) -> list[Column]:
    """Missing values are last going up. Going down, missing numbers come first and missing text stays last."""
    if not reverse:
        return [F.col(column).asc_nulls_last()]
    text = dict(rows.dtypes)[column] == "string"
    return [F.col(column).desc_nulls_last() if text else F.col(column).desc_nulls_first()]


def natural_key(text: Column) -> Column:
    """An array that orders digit runs as numbers and other text case-insensitively; numbers sort before text."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))

    def part(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        number = F.struct(F.lit(0).alias("kind"), F.length(digits).alias("width"), digits.alias("text"))
        words = F.struct(F.lit(1).alias("kind"), F.lit(0).alias("width"), run.alias("text"))
        return F.when(run.rlike(r"^\d"), number).otherwise(words)

    return F.transform(runs, part)
