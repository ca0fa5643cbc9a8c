"""Column expressions over raw text cells; everything stays in SQL functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Textual codes, numeric sentinels and unusual numbers that may stand for a missing cell.
TEXT_CODES = ["na", "n/a", "nan", "null", "none", "missing", "."]
SENTINELS = [-4.0, -1.0]
UNUSUAL = [-999.0, -99.0, -9.0, 888.0, 999.0, 9999.0]
# White space, as Unicode and text tools strip it.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def strip(c) -> Column:
    """Unicode strip: tabs and no-break spaces go too, which SQL ``trim`` leaves.  No regular expression: it runs many times a cell."""
    return F.btrim(col(c), F.lit(SPACES))


def blank(c) -> Column:
    return strip(c) == ""


def number(c) -> Column:
    """Numeric text as double; other text, blank and NaN become null."""
    return numeric(strip(c))


def numeric(stripped: Column) -> Column:
    """The same from stripped text.  A look at how it begins spares words the cast, whose failure costs far more."""
    return F.when(stripped.rlike(r"(?i)^[-+]?(\.?[0-9]|inf)"), stripped.try_cast("double"))


def missing_category(c) -> Column:
    v = strip(c)
    return (F.when(col(c) == "", "blank").when(v == "", "whitespace").when(F.lower(v).isin(TEXT_CODES), "text_code")
            .when(number(c).isin(SENTINELS), "sentinel"))


def sentinel_kind(c) -> Column:
    """Exposure class: the two sentinels by value (``-1.0`` counts), other negatives, unusual codes."""
    return kind_of(strip(c), number(c))


def kind_of(stripped: Column, n: Column) -> Column:
    """The same from a stripped cell and its number, where both are columns already."""
    return (F.when(stripped == "", "blank").when(n == -4, "minus4").when(n == -1, "minus1").when(n.isin(UNUSUAL), "unusual").when(n < 0, "negative")
            .when(n.isNull() & F.lower(stripped).isin(TEXT_CODES), "unusual"))


def category_of(raw: Column, stripped: Column, n: Column) -> Column:
    """``missing_category`` likewise."""
    return (F.when(raw == "", "blank").when(stripped == "", "whitespace").when(F.lower(stripped).isin(TEXT_CODES), "text_code")
            .when(n.isin(SENTINELS), "sentinel"))


def parsed(df, columns: list[str], *keep):
    """Stripped text ``{c}|s`` and number ``{c}|n`` of every column, each made once a cell, in steps that stay apart."""
    once = df.select(*keep, *columns, *[strip(c).alias(f"{c}|s") for c in columns])
    return once.select("*", *[numeric(F.col(f"`{c}|s`")).alias(f"{c}|n") for c in columns])


def normal_name(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(strip(c)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def month_number(c) -> Column:
    """``m06`` to 6: full match in either case, else null."""
    return F.nullif(F.regexp_extract(F.lower(strip(c)), r"^m(\d+)$", 1), F.lit("")).try_cast("int")


def date_of(c, formats=("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd")) -> Column:
    """Dates of mixed formats; what fits none, or is no date, is null."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(strip(c), F.lit(f))) for f in formats])


def any_populated(columns) -> Column:
    return reduce(lambda a, b: a | b, [~blank(c) for c in columns])


def format_share(c, pattern: str) -> Column:
    """Aggregate: share of non-blank values that match in full."""
    return F.avg(F.when(~blank(c), strip(c).rlike(f"^(?:{pattern})$").cast("int")))


def outside(c, low, high) -> Column:
    return ~col(c).between(low, high)


def close(a, b, rel=1e-9, absolute=0.0) -> Column:
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def close_to(a, b, rel=1e-5, absolute=1e-8) -> Column:
    """One-sided form: the tolerance is relative to b."""
    return F.abs(col(a) - col(b)) <= absolute + rel * F.abs(col(b))


def percent(part, whole) -> Column:
    return F.when(col(whole) != 0, col(part) * 100.0 / col(whole)).otherwise(F.lit(0.0))


def distance(a, b) -> Column:
    """Euclidean distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unique_join(c) -> Column:
    """Aggregate: distinct non-blank values, sorted, joined by `` | ``."""
    return F.array_join(F.array_sort(F.collect_set(F.when(~blank(c), strip(c)))), " | ")


def classify(rules: list[tuple], default=None) -> Column:
    """First rule that holds wins: ``(condition, label)`` pairs."""
    out = F
    for condition, label in rules:
        out = out.when(condition, label)
    return out.otherwise(F.lit(default))


def in_order(c, order: list[str]) -> Column:
    """Place of a value in a stated order; unknown ones come last (999)."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)]), col(c)), F.lit(999))
