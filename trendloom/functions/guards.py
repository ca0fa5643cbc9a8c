"""Checks inside the plan: rows pass through, and the job fails with examples if the check finds any violation.

Nothing is collected: a check is one row (a message or null) that is joined to the rows it guards, so that it runs
in the same job, and fails it by ``raise_error`` before a row gets out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message(bad: DataFrame, what: str, columns: list[str], examples: int = 5) -> DataFrame:
    """One row: null if there is no bad row, else the text with their number and the first ones in order of all columns."""
    total = bad.agg(F.count(F.lit(1)).alias("n"))
    text = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns])
    first = bad.select(*columns).orderBy(*columns).limit(examples).agg(F.array_sort(F.collect_list(text)).alias("e"))  # as many as examples
    said = F.concat(F.lit(f"{what}: "), F.col("n").cast("string"), F.lit(", as "), F.array_join("e", "; "))
    return total.crossJoin(first).select(F.when(F.col("n") > 0, said).alias("_message"))  # one row each


def guarded(df: DataFrame, *messages: DataFrame) -> DataFrame:
    """``df``, or a failed job with the first message."""
    out = df
    for m in messages:
        passed = F.when(F.col("_message").isNotNull(), F.raise_error(F.col("_message")).cast("boolean")).otherwise(F.lit(True))
        out = out.crossJoin(F.broadcast(m)).filter(passed).drop("_message")  # one row
    return out


def repeated(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that several rows hold."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def unique(df: DataFrame, on: list[str], name: str = "table") -> DataFrame:
    return message(repeated(df, on), f"repeated keys of the {name}", [*on, "rows"])


def join_many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join to a table whose keys must be unique."""
    return guarded(left, unique(right, on, "right side")).join(right, on, how)


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join of two tables, each with unique keys."""
    return guarded(left, unique(left, on, "left side"), unique(right, on, "right side")).join(right, on, how)


def strict(df: DataFrame, columns: list[str], kind: str = "double", *ids: str) -> DataFrame:
    """Text columns as numbers: null and blank become null, NaN and other text fail the job with examples."""
    cell = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    wrong = lambda c: cell(c).isNotNull() & (cell(c).try_cast(kind).isNull() | F.isnan(cell(c).try_cast("double")))
    bad = df.select(*ids, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), wrong(c).alias("wrong")) for c in columns])).alias("_c")).filter("_c.wrong").select(*ids, "_c.column", "_c.value")
    fine = guarded(df, message(bad, f"cells that are no {kind}", [*ids, "column", "value"]))
    return fine.withColumns({c: cell(c).try_cast(kind) for c in columns})


def none_of(df: DataFrame, bad: Column, what: str, columns: list[str], examples: int = 5) -> DataFrame:
    """``df``, or a failed job if a row is bad."""
    return guarded(df, message(df.filter(bad), what, columns, examples))
