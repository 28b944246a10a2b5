"""Holidays by rule, as dates of whole ranges of years and as columns beside the times of a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule gives the date of a holiday from its year.
Rule = Callable[[Column], Column]


def _div(x: Column, by: int | Column) -> Column:
    return F.call_function("div", x, F.lit(by) if isinstance(by, int) else by).cast("int")


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, from the moon's cycle of 19 years and the corrections of the centuries."""
    century, golden = _div(year, 100), year % 19
    epact = (century - _div(century, 4) - _div(8 * century + 13, 25) + 19 * golden + 15) % 30
    moon = epact - _div(epact, 28) * (1 - _div(F.lit(29), epact + 1) * _div(21 - golden, 11))
    weekday = (year + _div(year, 4) + moon + 2 - century + _div(century, 4)) % 7
    # Days from 28 March to the Sunday after the full moon.
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), moon - weekday)


def fixed(month: int, day: int) -> Rule:
    return lambda year: F.make_date(year, F.lit(month), F.lit(day))


def from_easter(days: int) -> Rule:
    return lambda year: F.date_add(easter(year), days)


def nth(month: int, weekday: int, n: int) -> Rule:
    """The n-th such weekday (0: Monday) of a month, or the last for n = -1."""

    def date(year: Column) -> Column:
        first = F.make_date(year, F.lit(month), F.lit(1))
        last = F.last_day(first)
        return F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7))) if n < 0 else F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))

    return date


#: Public holidays of some countries. Fixed values.
COUNTRIES: dict[str, dict[str, Rule]] = {
    "US": {
        "new_year": fixed(1, 1), "martin_luther_king": nth(1, 0, 3), "presidents": nth(2, 0, 3), "memorial": nth(5, 0, -1), "juneteenth": fixed(6, 19), "independence": fixed(7, 4),
        "labor": nth(9, 0, 1), "columbus": nth(10, 0, 2), "veterans": fixed(11, 11), "thanksgiving": nth(11, 3, 4), "christmas": fixed(12, 25),
    },
    "DE": {
        "new_year": fixed(1, 1), "good_friday": from_easter(-2), "easter_monday": from_easter(1), "labour": fixed(5, 1), "ascension": from_easter(39), "whit_monday": from_easter(50), "unity": fixed(10, 3), "christmas": fixed(12, 25), "boxing": fixed(12, 26),
    },
    "FR": {
        "new_year": fixed(1, 1), "easter_monday": from_easter(1), "labour": fixed(5, 1), "victory": fixed(5, 8), "ascension": from_easter(39), "whit_monday": from_easter(50), "bastille": fixed(7, 14), "assumption": fixed(8, 15), "all_saints": fixed(11, 1), "armistice": fixed(11, 11), "christmas": fixed(12, 25),
    },
}


def dates(years: DataFrame, rules: Mapping[str, Rule], before: int = 0, after: int = 0) -> DataFrame:
    """(name, day) of each rule for each year of years (year int), with so many days before and after; a day that is one twice stands once."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), rule(F.col("year")).alias("day")) for n, rule in rules.items()]))
    around = F.explode(F.sequence(F.lit(-before), F.lit(after)))
    return years.select(each.alias("h")).select("h.name", "h.day", around.alias("off")).select("name", F.date_add("day", F.col("off")).alias("day")).distinct()


def column(name: str) -> str:
    return f"holiday_{name}"


def flagged(df: DataFrame, rules: Mapping[str, Rule], ts: str = "ts", before: int = 0, after: int = 0) -> DataFrame:
    """df with a column holiday_<name>, 1.0 on the holiday (and the days around it) and 0.0 else, for each rule; a null time has 0.0.

    The dates of the years that df covers, a row for each, are joined to it; their number grows with the years, not with the rows.
    """
    ends = df.agg(F.year(F.min(ts)).alias("lo"), F.year(F.max(ts)).alias("hi")).where("lo IS NOT NULL")
    years = ends.select(F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("year"))  # windows reach into the next year
    days = dates(years, rules, before, after).groupBy("day").agg(F.collect_set("name").alias("__names")).withColumnRenamed("day", "__day")
    joined = df.join(days, F.col(ts).cast("date") == F.col("__day"), "left")
    return reduce(lambda t, n: t.withColumn(column(n), F.coalesce(F.array_contains("__names", n), F.lit(False)).cast("double")), rules, joined).drop("__day", "__names")
