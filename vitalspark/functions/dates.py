"""Dates of any precision, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalspark.functions.bind import bind

#: Words for a missing date, day taken for a month, month and day taken for a year.
MISSING = ("none", "null", "nan", "unknown")
DAY_OF_MONTH, MONTH_OF_YEAR, DAY_OF_YEAR = 15, 7, 1
DAYS_A_MONTH, PLOT_DAYS_A_MONTH = 30.4375, 30.44

#: Month names.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6,
    "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """Date of three ints, or null if there is no such day."""
    sound = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    return F.when(sound, F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day)))


def parse_partial_date(value: Column, precision: Column | None = None) -> Column:
    """struct(date, precision, assumed) of text: a day, a month (its 15th) or a year (1 July); a declared precision is kept."""
    bare = F.split(F.split(F.trim(value), "T")[0], " ")[0]
    known = ~F.lower(F.trim(value)).isin("", *MISSING)

    def dated(parts: Column) -> Column:
        number = [F.get(parts, F.lit(i)).try_cast("int") for i in range(3)]
        n = F.size(parts)
        return F.when(n >= 3, calendar_date(*number)).when(n == 2, calendar_date(number[0], number[1], F.lit(DAY_OF_MONTH))).otherwise(calendar_date(number[0], F.lit(MONTH_OF_YEAR), F.lit(DAY_OF_YEAR)))

    def described(x: Column) -> Column:
        found = F.when(x["n"] >= 3, "day").when(x["n"] == 2, "month").otherwise("year")
        declared = found if precision is None else F.coalesce(precision, found)
        sound = x["date"].isNotNull()
        return F.struct(x["date"].alias("date"), F.when(sound, declared).otherwise("unknown").alias("precision"), (sound & (x["n"] < 3)).alias("assumed"))

    parts = F.split(bare, "-")
    return bind(F.struct(F.when(known, bind(parts, dated)).alias("date"), F.coalesce(F.size(parts), F.lit(0)).alias("n")), described)


def resolve_date(value: Column) -> Column:
    """The date alone."""
    return parse_partial_date(value)["date"]


def resolve_date_by_length(value: Column) -> Column:
    """The warehouse's rule: the text's length (10 and more, 7, 4, other) says what it holds."""
    size = F.char_length(value)
    return (
        F.when(size >= 10, F.try_to_date(F.left(value, F.lit(10)), "yyyy-MM-dd"))
        .when(size == 7, F.try_to_date(F.concat(value, F.lit("-15")), "yyyy-MM-dd"))
        .when(size == 4, F.try_to_date(F.concat(value, F.lit("-07-01")), "yyyy-MM-dd"))
        .otherwise(F.try_to_date(value, "yyyy-M-d"))
    )


def text_to_partial_date(value: Column) -> Column:
    """struct(year, month, day, precision, error) of seven textual forms; months are 1-12 and days 1-31, not checked against a calendar."""
    s = F.trim(value)
    # The seven forms of a date, those with hyphens and those with a word as one pattern each; a word is a month or a quarter, which stands for its last month.
    plain, slash, named = r"^\d{4}(-\d{1,2}){0,2}$", r"^\d{1,2}/\d{4}$", r"^[A-Za-z]{1,9}[1-4]?\s+\d{4}$"
    stamp = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?$"
    words = F.create_map(*(F.lit(x) for pair in {**{k: str(m) for k, m in MONTHS.items()}, **{f"q{q}": str(3 * q) for q in range(1, 5)}}.items() for x in pair))

    def number(parts: Column, i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("int")

    def worded(x: Column) -> Column:
        """[year, month] of a word and a year; null if the word says nothing."""
        month = F.try_element_at(words, F.lower(x[0]))
        return F.when(month.isNotNull(), F.array(x[1], month))

    def dated(x: Column) -> Column:
        """[year, month, day], if the calendar has the day."""
        return F.when(calendar_date(number(x, 0), number(x, 1), number(x, 2)).isNotNull(), x)

    parts = (
        F.when(s.rlike(plain), F.split(s, "-")).when(s.rlike(slash), F.reverse(F.split(s, "/"))).when(s.rlike(named), bind(F.split(s, r"\s+"), worded))
        .when(s.rlike(stamp), bind(F.split(F.left(s, F.lit(10)), "-"), dated))
    )
    found = bind(parts, lambda x: F.when(x.isNotNull(), F.struct(number(x, 0).alias("year"), number(x, 1).alias("month"), number(x, 2).alias("day"))))

    def checked(x: Column) -> Column:
        month, day = (F.coalesce(x[c].between(1, top), F.lit(True)) for c, top in (("month", 12), ("day", 31)))
        error = F.when(x.isNull(), "not a partial date").when(~month, "month out of range").when(~day, "day out of range")
        precision = F.when(x["day"].isNotNull(), "day").when(x["month"].isNotNull(), "month").when(x["year"].isNotNull(), "year")
        return F.struct(x["year"].alias("year"), x["month"].alias("month"), x["day"].alias("day"), precision.alias("precision"), error.alias("error"))

    def emptied(x: Column) -> Column:
        """Without its parts if there is an error."""
        return F.struct(*(F.when(x["error"].isNull(), x[c]).alias(c) for c in ("year", "month", "day", "precision")), x["error"].alias("error"))

    return bind(bind(found, checked), emptied)


def partial_date_text(value: Column) -> Column:
    """ISO text of a (year, month, day) struct, which parse_partial_date reads."""
    return F.concat_ws("-", F.format_string("%04d", value["year"]), F.when(value["month"].isNotNull(), F.format_string("%02d", value["month"])), F.when(value["day"].isNotNull(), F.format_string("%02d", value["day"])))


def months(days: Column) -> Column:
    """Days, not below 0, as months of 30.4375 days, to two places."""
    return F.round(F.greatest(days, F.lit(0)) / DAYS_A_MONTH, 2)


def plot_months(days: Column) -> Column:
    """Months of 30.44 days, unrounded, not below 0: the scale of the survival plot."""
    return F.greatest(days / PLOT_DAYS_A_MONTH, F.lit(0.0))


def iso_timestamp(value: Column) -> Column:
    """ISO text of a timestamp, milliseconds, Z (session in UTC)."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def millis_to_iso(value: Column) -> Column:
    return iso_timestamp(F.timestamp_millis(value))


def iso_to_millis(value: Column) -> Column:
    """Milliseconds since 1970 of an ISO timestamp; without a zone it is UTC; null if it is none."""
    return F.unix_millis(F.try_to_timestamp(value))
