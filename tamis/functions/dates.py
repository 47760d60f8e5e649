"""Dates written for people. The current time is always an argument, so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import SPACE, col, let, text_array
from .text import strip

# --- fixed values: month names in the genitive, January first ------------------------------------
MONTHS = [
    "января",
    "февраля",
    "марта",
    "апреля",
    "мая",
    "июня",
    "июля",
    "августа",
    "сентября",
    "октября",
    "ноября",
    "декабря",
]
# --- fixed values: unit stems and their length in minutes ----------------------------------------
UNIT_MINUTES = {"минут": 1, "час": 60, "день": 1440, "дня": 1440, "дней": 1440, "недел": 10080, "месяц": 43200}


def parse_day_month(value: Column | str, now: Column) -> Column:
    """«17 августа» in the year that does not lie more than a day ahead of ``now``."""
    pattern = rf"^(\d{{1,2}}){SPACE}+([а-яё]+)"

    def build(t: Column) -> Column:
        day = F.regexp_extract(t, pattern, 1).try_cast("int")
        month = F.nullif(F.array_position(text_array(MONTHS), F.regexp_extract(t, pattern, 2)).cast("int"), F.lit(0))
        zero = F.lit(0)

        def at(year: Column) -> Column:
            return F.try_make_timestamp_ntz(year, month, day, zero, zero, zero.cast("decimal(16,6)"))

        this_year = at(F.year(now))
        return F.when(this_year > now + F.expr("INTERVAL 1 DAY"), at(F.year(now) - 1)).otherwise(this_year)

    return let(strip(F.lower(col(value))), build)


def parse_relative(value: Column | str, now: Column) -> Column:
    """«3 дня назад», «вчера», «сегодня» counted back from ``now``; a month is 30 days."""
    stems = "|".join(UNIT_MINUTES)
    pattern = rf"^(\d+){SPACE}+({stems})"

    def build(t: Column) -> Column:
        unit = F.regexp_extract(t, pattern, 2)
        table = F.create_map(*[F.lit(x) for kv in UNIT_MINUTES.items() for x in kv])
        minutes = F.regexp_extract(t, pattern, 1).try_cast("int") * F.try_element_at(table, unit)
        back = F.when(t == "сегодня", F.lit(0)).when(t == "вчера", F.lit(1440)).otherwise(minutes)
        return now - F.make_dt_interval(F.lit(0), F.lit(0), back)

    return let(strip(F.lower(col(value))), build)


def is_recent(published: Column | str, now: Column, days: int) -> Column:
    """Published within the last ``days``; an unknown date is not recent."""
    return F.coalesce(col(published) >= now - F.make_dt_interval(F.lit(days)), F.lit(False))
