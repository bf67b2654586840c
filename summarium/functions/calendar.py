"""Date mentions as calendar intervals, compared by containment.

A mention is read as intervals of days: a day, a month or a year.  ``5/6/2020`` has two
readings, one for each order of day and month; ``May 12`` without a year is a day of any
year.  Patterns are looked for from the longest to the shortest, and a match is taken out
of the text before the next, so that the year of a full date is no mention of its own.

A reading is (s, e, md): first and last day since 1970 and, for a single day, 100 * month
+ day (else 0).  Yearless days have null s and e.  A mention without a valid reading (the
31st of June) is none.  Null texts have no mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .barrier import materialize
from .text import col_

_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
#: Longest first; the groups of each in the order that ``READERS`` takes them.
PATTERNS = {
    "numeric": r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4}|[0-9]{2})\b",
    "month_first": rf"(?i)\b{_MONTH}\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})\b",
    "day_first": rf"(?i)\b([0-9]{{1,2}})\s+{_MONTH}\.?,?\s+([0-9]{{4}})\b",
    "month_year": rf"(?i)\b{_MONTH}\.?,?\s+([0-9]{{4}})\b",
    "month_day": rf"(?i)\b{_MONTH}\.?\s+([0-9]{{1,2}})\b",
    "year": r"\b([12][0-9]{3})\b",
}
#: Stands in the text for a match that was taken out; no pattern reaches across it.
TAKEN = " ; "
#: Two-digit years below this are of the 2000s.
PIVOT = 70
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _month(word: Column) -> Column:
    return F.floor((F.instr(F.lit(_MONTHS), F.lower(F.substring(word, 1, 3))) + 2) / 3).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970; null where there is no such day."""
    two = [F.lpad(x.cast("string"), 2, "0") for x in (month, day)]
    return F.unix_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), *two).try_cast("date"))


def _reading(s: Column, e: Column, md: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), md.cast("int").alias("md"))


def _day(year: Column, month: Column, day: Column) -> Column:
    d = _date(year, month, day)
    return F.when(d.isNotNull(), _reading(d, d, month * 100 + day))


def _numeric(a: Column, b: Column, y: Column) -> list[Column]:
    n = y.cast("int")
    year = F.when(F.length(y) == 4, n).when(n < PIVOT, n + 2000).otherwise(n + 1900)
    return [_day(year, b.cast("int"), a.cast("int")), _day(year, a.cast("int"), b.cast("int"))]


def _month_year(m: Column, y: Column) -> list[Column]:
    year, month, one = y.cast("int"), _month(m), F.lit(1)
    after = _date(F.when(month == 12, year + 1).otherwise(year), month % 12 + 1, one)
    return [_reading(_date(year, month, one), after - 1, F.lit(0))]


def _month_day(m: Column, d: Column) -> list[Column]:
    # 2000 has a 29th of February
    known = _date(F.lit(2000), _month(m), d.cast("int")).isNotNull()
    none = F.lit(None)
    return [F.when(known, _reading(none, none, _month(m) * 100 + d.cast("int")))]


READERS = {
    "numeric": (3, _numeric),
    "month_first": (3, lambda m, d, y: [_day(y.cast("int"), _month(m), d.cast("int"))]),
    "day_first": (3, lambda d, m, y: [_day(y.cast("int"), _month(m), d.cast("int"))]),
    "month_year": (2, _month_year),
    "month_day": (2, _month_day),
    "year": (1, lambda y: [_reading(_date(y.cast("int"), F.lit(1), F.lit(1)),
                                    _date(y.cast("int"), F.lit(12), F.lit(31)), F.lit(0))]),
}


def _readings(name: str):
    """The distinct valid readings of a match of one pattern."""
    groups, read = READERS[name]

    def of(match: Column) -> Column:
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*read(*[match[f"g{i}"] for i in range(groups)])))))
    return of


def with_calendar(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the distinct date mentions of a text: array of arrays of readings."""
    d = df.withColumn("_cal_text", F.coalesce(col_(text), F.lit("")))
    parts = []
    for name, pattern in PATTERNS.items():
        groups, _ = READERS[name]
        found = [F.regexp_extract_all("_cal_text", F.lit(pattern), F.lit(i + 1)) for i in range(groups)]
        d = materialize(d.withColumns({f"_cal_{name}": F.arrays_zip(*[f.alias(f"g{i}") for i, f in enumerate(found)]),
                                       "_cal_text": F.regexp_replace("_cal_text", pattern, TAKEN)}))
        parts.append(F.transform(f"_cal_{name}", _readings(name)))
    mentions = F.array_distinct(F.filter(F.concat(*parts), lambda r: F.size(r) > 0))
    return materialize(d.withColumn(out, mentions).drop("_cal_text", *[f"_cal_{p}" for p in PATTERNS]))


def support(mention: Column, source: Column) -> Column:
    """1 where a reading of the source lies inside one of the mention (it says the same or
    more), 0.5 where one only holds or meets it (it says less), else 0.  ``source`` is the
    array of all readings of the source."""
    def inside(m, r):
        return ((r["s"] >= m["s"]) & (r["e"] <= m["e"])) | (m["s"].isNull() & (r["md"] == m["md"]))

    def meets(m, r):
        return ((r["s"] <= m["e"]) & (r["e"] >= m["s"])) | (r["s"].isNull() & (r["md"] == m["md"]))

    def some(test):
        return F.exists(mention, lambda m: F.exists(source, lambda r: F.coalesce(test(m, r), F.lit(False))))

    return F.when(some(inside), F.lit(1.0)).when(some(meets), F.lit(0.5)).otherwise(F.lit(0.0))


def calendar_consistency(summary: str, source: str) -> Column:
    """Mean support of the summary's mentions by the source's; 1 without any.  Both name
    materialised ``with_calendar`` columns."""
    readings = F.array_distinct(F.flatten(F.col(source)))
    total = F.aggregate(F.col(summary), F.lit(0.0), lambda acc, m: acc + support(m, readings))
    return F.when(F.size(summary) == 0, F.lit(1.0)).otherwise(total / F.size(summary))
