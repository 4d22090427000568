"""Times written freely: a clock with its zone is lifted out of the text, what is left must be a whole date.

All of it is column expressions. Naive times are UTC. A date needs year, month and day; times that name less (a clock alone, a
month of a year) are null, as filling them from today would give another value with each run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of English dates.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

_MONTH = "(" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + "|sept)"
_WEEKDAY = "(?:" + "|".join(f"{d}|{d[:3]}" for d in WEEKDAYS) + ")"
_NAMES = "|".join(n[:3].upper() for n in [*MONTHS, *WEEKDAYS])
_OFFSET = r"Z|z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2}"
# A clock, the first number that a colon or a half of the day follows: hour, minute, second, fraction, half of the day, offset. Zone names other than UTC say nothing.
_CLOCK = (r"^(.*?)(?<![\d:.])(\d{1,2})(?=:\d\d|\s*[AaPp][Mm](?![A-Za-z]))(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?(?![\d:])(?:\s*([AaPp][Mm])(?![A-Za-z]))?"
          rf"(?:\s*({_OFFSET})(?![\w:])|\s+(?!(?:{_NAMES})(?![A-Z])|JUNE|JULY|MARCH|APRIL)[A-Z]{{3,5}}(?![\w+-]))?(?:\s*\([A-Z]{{3,5}}\))?(?![\d:])(.*)$")
_HAS_CLOCK = r"\d:\d\d|\d\s*[AaPp][Mm](?![A-Za-z])"
# The same without colons, behind a date of eight digits.
_COMPACT = rf"^(\d{{8}})[Tt ]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?\s*({_OFFSET})?$"
_SEP = r"[-/. ]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _part(text: Column, pattern: str, i: int) -> Column:
    found = F.regexp_extract(text, pattern, i)
    return F.when(found != "", found)


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _clock(s: Column) -> Column:
    """struct(rest, hour, minute, second, zone) of a text; hour is null where the clock is none, rest is what isn't clock."""
    def of(pattern: str, at: list[int], rest: Column, half: Column) -> Column:
        h, m, sec, frac, zone = (_part(s, pattern, i) for i in at)
        hour = _int(h)
        by_half = (F.when(half.isNull(), hour).when((hour < 1) | (hour > 12), F.lit(None).cast("int"))
                   .otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0)))
        hour = F.when(m.isNotNull() | half.isNotNull(), by_half)
        micros = F.rpad(F.substring(F.coalesce(frac, F.lit("0")), 1, 6), 6, "0")
        second = F.concat(F.coalesce(sec, F.lit("00")), F.lit("."), micros).try_cast("decimal(8,6)")
        offset = F.regexp_replace(F.coalesce(zone, F.lit("Z")), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
        offset = F.when(F.upper(offset).isin("Z", "UTC", "GMT"), F.lit("UTC")).when(F.length(offset) == 3, F.concat(offset, F.lit(":00"))).otherwise(offset)
        return F.struct(rest.alias("rest"), hour.alias("hour"), F.coalesce(_int(m), F.lit(0)).alias("minute"),
                        second.alias("second"), offset.alias("zone"))

    no_half = F.lit(None).cast("string")
    plain = F.struct(s.alias("rest"), F.lit(0).alias("hour"), F.lit(0).alias("minute"), F.lit(0).cast("decimal(8,6)").alias("second"),
                     F.lit("UTC").alias("zone"))
    rest = F.concat(F.regexp_extract(s, _CLOCK, 1), F.lit(" "), F.regexp_extract(s, _CLOCK, 8))
    return (F.when(s.rlike(_COMPACT), of(_COMPACT, [2, 3, 4, 5, 6], F.regexp_extract(s, _COMPACT, 1), no_half))
            .when(s.rlike(_HAS_CLOCK), of(_CLOCK, [2, 3, 4, 5, 7], rest, F.lower(_part(s, _CLOCK, 6))))
            .otherwise(plain))


def _day(rest: Column) -> Column:
    """struct(year, month, day) of the text without its clock, null where it is no whole date."""
    low = F.lower(rest)
    low = F.regexp_replace(low, rf"(?<![a-z]){_WEEKDAY}(?![a-z])\.?", " ")
    low = F.regexp_replace(low, r"(?<=\d)(?:st|nd|rd|th)(?![a-z])", " ")
    low = F.regexp_replace(low, r"(?<![a-z])(?:at|on|of|and)(?![a-z])|,|(?<=\d)t(?=\s*$)", " ")
    low = F.trim(F.regexp_replace(low, r"\s+", " "))
    shapes = {
        "ymd": rf"^(\d{{4}})({_SEP})(\d{{1,2}})\2(\d{{1,2}})$", "digits": r"^(\d{4})(\d{2})(\d{2})$",
        "signs": r"^(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日$", "numbers": rf"^(\d{{1,2}})({_SEP})(\d{{1,2}})\2(\d{{4}}|\d{{2}})$",
        "mdy": rf"^{_MONTH}{_SEP}*(\d{{1,2}}){_SEP}+(\d{{4}}|\d{{2}})$", "dmy": rf"^(\d{{1,2}}){_SEP}*{_MONTH}{_SEP}*(\d{{4}}|\d{{2}})$",
        "named_ymd": rf"^(\d{{4}}){_SEP}*{_MONTH}{_SEP}*(\d{{1,2}})$"}
    number = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m[:3]), F.lit(i))])

    def year(text: Column) -> Column:
        """Two digits stand for the year of the fifty before or after now."""
        now = F.year(F.current_date())
        near = _int(text) + F.floor(now / 100).cast("int") * 100
        return F.when(F.length(text) == 4, _int(text)).when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)

    def build(text: Column) -> Column:
        def get(shape: str, *at: int) -> list[Column]:
            return [F.regexp_extract(text, shapes[shape], i) for i in at]

        def ymd(y: Column, m: Column, d: Column) -> Column:
            return F.struct(y.alias("year"), m.alias("month"), _int(d).alias("day"))

        def named(m: Column) -> Column:
            return number[F.substring(m, 1, 3)]

        y, m, d = get("ymd", 1, 3, 4)
        out = F.when(text.rlike(shapes["ymd"]), ymd(_int(y), _int(m), d))
        for shape in ("digits", "signs"):
            y, m, d = get(shape, 1, 2, 3)
            out = out.when(text.rlike(shapes[shape]), ymd(_int(y), _int(m), d))
        a, b, c = get("numbers", 1, 3, 4)
        # Month first; a first number over 12 is the day, over 31 the year of two digits.
        out = out.when(text.rlike(shapes["numbers"]), F.when((_int(a) > 31) & (F.length(c) == 2), ymd(year(a), _int(b), c))
                       .when(_int(a) > 12, ymd(year(c), _int(b), a)).otherwise(ymd(year(c), _int(a), b)))
        m, d, y = get("mdy", 1, 2, 3)
        out = out.when(text.rlike(shapes["mdy"]), ymd(year(y), named(m), d))
        d, m, y = get("dmy", 1, 2, 3)
        # Of a day and a year of two digits around a month, only a number over 31 is the year.
        out = out.when(text.rlike(shapes["dmy"]), F.when((_int(d) > 31) & (F.length(y) == 2), ymd(year(d), named(m), y)).otherwise(ymd(year(y), named(m), d)))
        y, m, d = get("named_ymd", 1, 2, 3)
        return out.when(text.rlike(shapes["named_ymd"]), ymd(_int(y), named(m), d))

    return _let(low, build)


def free_time(text: Column) -> Column:
    """struct(time timestamp, day date as written) of a freely written time, both null where it is none."""
    def build(clock: Column) -> Column:
        def join(day: Column) -> Column:
            time = F.try_make_timestamp(day["year"], day["month"], day["day"], clock["hour"], clock["minute"], clock["second"], clock["zone"])
            # An offset that isn't one would be an error, not a null.
            good = (clock["second"] < 60) & ((clock["zone"] == "UTC") | clock["zone"].rlike(r"^[+-](0\d|1[0-7]):[0-5]\d$"))
            made = F.when(good, time)
            return F.struct(made.alias("time"), F.when(made.isNotNull(), F.make_date(day["year"], day["month"], day["day"])).alias("day"))

        return _let(_day(clock["rest"]), join)

    return _let(text, lambda s: _let(_clock(s), build))
