"""Calendar readings of date mentions and their support."""

import datetime as dt

import pytest

from summarium.functions import calendar as C


def day(y, m, d):
    n = (dt.date(y, m, d) - dt.date(1970, 1, 1)).days
    return (n, n, 100 * m + d)


def span(a, b):
    return ((dt.date(*a) - dt.date(1970, 1, 1)).days, (dt.date(*b) - dt.date(1970, 1, 1)).days, 0)


READINGS = [
    ("on May 12, 2020.", [[day(2020, 5, 12)]]), ("on 12 May 2020", [[day(2020, 5, 12)]]),
    ("Sept. 3 1999", [[day(1999, 9, 3)]]), ("MAY 2020", [[span((2020, 5, 1), (2020, 5, 31))]]),
    ("Dec, 2019", [[span((2019, 12, 1), (2019, 12, 31))]]), ("in 2020", [[span((2020, 1, 1), (2020, 12, 31))]]),
    ("5/6/2020", [[day(2020, 5, 6), day(2020, 6, 5)]]), ("6-6-2020", [[day(2020, 6, 6)]]),
    ("25/12/99", [[day(1999, 12, 25)]]), ("1/2/03", [[day(2003, 1, 2), day(2003, 2, 1)]]),
    ("May 12", [[(None, None, 512)]]), ("31 June 2020", []), ("Feb 30", []), ("Feb 29, 2019", []), ("35/40/2020", []),
    ("May 12, 2020 and 2020 and 12 may 2020", [[day(2020, 5, 12)], [span((2020, 1, 1), (2020, 12, 31))]]),
    ("no dates 12345 99999", []), ("", []), (None, []),
]


@pytest.mark.parametrize("text, want", READINGS)
def test_readings(spark, text, want):
    got = C.with_calendar(spark.createDataFrame([(text,)], "t string"), "t", "d").first().d
    assert sorted([[tuple(r) for r in m] for m in got], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("summary, source, want", [
    ("May 12, 2020", "on 12 May 2020", 1.0), ("May 12, 2020", "May 30, 2020", 0.0),
    ("May 12", "May 30", 0.0), ("May 12", "12 May 1987", 1.0), ("May 12, 2020", "May 12", 0.5),
    ("2020", "May 12, 2020", 1.0), ("May 12, 2020", "2020", 0.5), ("May 2020", "2020", 0.5),
    ("2020", "May 2020", 1.0), ("5/6/2020", "June 5, 2020", 1.0), ("6 May 2020", "5/6/2020", 1.0),
    ("2019", "2020", 0.0), ("none", "2020", 1.0), ("2020", "none", 0.0),
    ("May 12, 2020 or 1999", "2020", 0.25), (None, None, 1.0)])
def test_support(spark, summary, source, want):
    d = spark.createDataFrame([(summary, source)], "a string, b string")
    d = C.with_calendar(C.with_calendar(d, "a", "x"), "b", "y")
    assert d.select(C.calendar_consistency("x", "y")).first()[0] == want
