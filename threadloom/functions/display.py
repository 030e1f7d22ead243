"""Column expressions for listings: short forms of ids, texts, projects, times and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(c: Column) -> Column:
    return F.substring(c, 1, 8)


def one_line(c: Column, most: int) -> Column:
    flat = F.replace(F.trim(c), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def project_name(c: Column) -> Column:
    last = F.regexp_extract(c, "/([^/]+)$", 1)
    return F.when(F.coalesce(c, F.lit("")) == "", "(unknown)").when(last != "", last).otherwise(c)


def minute_of(ts: Column) -> Column:
    return F.when(F.coalesce(ts, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm"))


def human_tokens(n: Column) -> Column:
    scaled = lambda by, digits, unit: F.concat(F.format_string(f"%.{digits}f", n / by), F.lit(unit))
    return F.when(n >= 10**9, scaled(1e9, 1, "B")).when(n >= 10**6, scaled(1e6, 1, "M")).when(n >= 10**4, scaled(1e3, 0, "k")).when(n >= 10**3, scaled(1e3, 1, "k")).otherwise(n.cast("string"))


def human_span(seconds: Column) -> Column:
    whole = lambda by, unit: F.concat(F.floor(seconds / by).cast("string"), F.lit(unit))
    return F.when(seconds < 3_600, whole(60, "m")).when(seconds < 48 * 3_600, whole(3_600, "h")).otherwise(whole(86_400, "d"))


def human_age(ts: Column, as_of: int) -> Column:
    age = F.lit(as_of) - ts
    return F.when(age < 60, "just now").otherwise(F.concat(human_span(age), F.lit(" ago")))


def usage_note(total: Column, stale: Column) -> Column:
    """Nothing for a session without usage: that is not zero tokens."""
    return F.when(
        total.isNotNull(),
        F.concat(F.lit("  ["), human_tokens(total), F.lit(" tok"), F.when(stale, ", stale").otherwise(""), F.lit("]")),
    ).otherwise("")


def shell_quoted(c: Column) -> Column:
    return F.when(c.rlike(r"^[A-Za-z0-9_./:=@%+,-]+$"), c).otherwise(
        F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    )
