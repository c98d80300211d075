"""Calendars of time series: recognized from their instants, counted and listed by arithmetic.

A calendar is a base (``s`` .. ``D`` fixed steps, ``B`` business days, ``W`` weeks, ``MS`` ``ME`` ``BMS`` ``BME`` month starts
and ends and their business days, ``QS`` .. ``BQE`` the same of quarters, ``YS`` .. ``BYE`` of years, ``WOM`` one weekday of a
month, ``bh`` business hours), a multiple, and an anchor (a weekday, a month, or ``3THU``).  Its code reads
``2QE-MAR``: multiple, base, anchor.

Recognition tests all candidates on one aggregate per series (extremes of steps in microseconds, months and years, and
whether every instant is a month start, month end, business start, business end or one weekday), so rows are
combined map-side.  Days are counted from the epoch; the session's time zone plays no part.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import quoted
from .blocks import TASK_ROWS, running_last

DAY = 86_400_000_000
HOUR = 3_600_000_000

# Names of units, weekdays and months in frequency codes.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": HOUR, "D": DAY}
WEEKDAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
SPANS = {"M": 1, "Q": 3, "Y": 12}
CODE = re.compile(r"(\d*)(us|ms|s|min|h|D|W|B?[MQY][SE]|B|WOM|bh)(?:-([A-Z0-9]+))?")


def date_of(us: Column) -> Column:
    """Calendar day of an instant."""
    return F.date_from_unix_date(F.floor(us / DAY).cast("int"))


def _midnight(date: Column) -> Column:
    return F.unix_date(date).cast("bigint") * DAY


def _floor_div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("bigint")


def _cut_short(first: Column, last: Column) -> Column:
    """1 when the last day ends before the calendar's time of day."""
    return (F.pmod(last, F.lit(DAY)) < F.pmod(first, F.lit(DAY))).cast("int")


# ---------------------------------------------------------------- one calendar


@dataclass(frozen=True)
class Calendar:
    """A calendar with a fixed code; instants are columns of microseconds.

    Points keep the time of day of the instant they are counted from.
    """

    base: str
    multiple: int = 1
    anchor: str | None = None

    @staticmethod
    def parse(code: str) -> Calendar:
        found = CODE.fullmatch(code)
        if not found:
            raise ValueError(f"unknown frequency {code!r}")
        count, base, anchor = found.groups()
        if base == "W":
            anchor = anchor or "SUN"
        elif base[-2:-1] in ("Q", "Y") and base not in UNITS:
            anchor = anchor or ("JAN" if base[-1] == "S" else "DEC")
        known = WEEKDAYS if base == "W" else MONTHS if base[-2:-1] in ("Q", "Y") else [f"{n}{d}" for n in range(1, 5) for d in WEEKDAYS] if base == "WOM" else [None]
        if anchor not in known or (count and int(count) == 0) or base == "bh":
            raise ValueError(f"no calendar points for frequency {code!r}")
        return Calendar(base, int(count or 1), anchor)

    @property
    def _span(self) -> int:
        """Months between points."""
        return SPANS.get(self.base[-2:-1], 1) if self.base != "WOM" else 1

    def _month(self, date: Column, back: bool = False) -> Column:
        """First day of the calendar's month at or after a day's month, or at or before it."""
        month, span = F.trunc(date, "month"), self._span
        if span == 1:
            return month
        ahead = F.pmod(F.lit(MONTHS.index(self.anchor) + 1) - F.month(date), F.lit(span))
        return F.add_months(month, F.when(ahead > 0, ahead - span).otherwise(ahead) if back else ahead)

    def _in_month(self, first: Column) -> Column:
        """The calendar's day in a month, given by its first day."""
        if self.base == "WOM":
            wanted = WEEKDAYS.index(self.anchor[1:])
            ahead = F.pmod(F.lit(wanted) - F.weekday(first), F.lit(7))
            return F.date_add(first, (ahead + 7 * (int(self.anchor[0]) - 1)).cast("int"))
        if self.base[-1] == "S":
            if self.base[0] != "B":
                return first
            return F.date_add(first, (F.weekday(first) > 4).cast("int") * (7 - F.weekday(first)))
        last = F.last_day(first)
        return F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0))) if self.base[0] == "B" else last

    def _first_month(self, start: Column) -> Column:
        """First day of the month of the first point that is not before an instant."""
        date = date_of(start)
        month = self._month(date)
        if self.base[-1] == "E" and self.base[0] != "B":
            return month  # the end of a month is never before a day of it
        return F.add_months(month, F.when(self._in_month(month) < date, self._span).otherwise(0))

    def _weekdays_before(self, day: Column) -> Column:
        """Business days before a day (counted in days since the epoch, a Thursday), from a fixed Monday."""
        return _floor_div(day + 3, 7) * 5 + F.least(F.pmod(day + 3, F.lit(7)), F.lit(5))

    def point(self, start: Column, i: Column) -> Column:
        """The i-th point (from 0) that is not before ``start``."""
        clock, i = F.pmod(start, F.lit(DAY)), i * self.multiple
        if self.base in UNITS:
            return start + i * UNITS[self.base]
        day = F.floor(start / DAY).cast("bigint")
        if self.base == "W":
            ahead = F.pmod(F.lit(WEEKDAYS.index(self.anchor)) - F.pmod(day + 3, F.lit(7)), F.lit(7))
            return (day + ahead + 7 * i) * DAY + clock
        if self.base == "B":
            nth = self._weekdays_before(day) + i
            return (_floor_div(nth, 5) * 7 + F.pmod(nth, F.lit(5)) - 3) * DAY + clock
        return _midnight(self._in_month(F.add_months(self._first_month(start), (i * self._span).cast("int")))) + clock

    def length(self, first: Column, last: Column) -> Column:
        """Number of points from ``first`` to ``last``, both included.

        From a first instant on the calendar, the last point up to the day of ``last`` counts unless its time of day is later
        than that of ``last`` (so it does not on any day); from another, all points up to ``last`` do.
        """
        if self.base in UNITS:
            count = F.floor((last - first) / UNITS[self.base]) + 1
        else:
            on = self.point(first, F.lit(0).cast("bigint")) == first
            day = F.floor(first / DAY).cast("bigint")
            end = F.floor(F.when(on, last).otherwise(last - F.pmod(first, F.lit(DAY))) / DAY).cast("bigint")
            if self.base == "W":
                ahead = F.pmod(F.lit(WEEKDAYS.index(self.anchor)) - F.pmod(day + 3, F.lit(7)), F.lit(7))
                count = _floor_div(end - day - ahead, 7) + 1
            elif self.base == "B":
                count = self._weekdays_before(end + 1) - self._weekdays_before(day)
            else:
                date = F.date_from_unix_date(end.cast("int"))
                month, since = self._month(date, back=True), self._first_month(first)
                number = lambda d: F.year(d) * 12 + F.month(d)
                count = F.floor((number(month) - number(since)) / self._span) + 1 - (self._in_month(month) > date).cast("int")
            count = count - F.when(on, _cut_short(first, last)).otherwise(F.lit(0))
        count = F.greatest(count.cast("bigint"), F.lit(0).cast("bigint"))
        return F.ceil(count / self.multiple).cast("bigint") if self.multiple > 1 else count

    def period(self, us: Column) -> Column:
        """The point (at midnight) of the period an instant lies in: weeks, months, quarters and years by their first or
        last day, weekends by the Friday before them."""
        if self.multiple > 1 or self.base == "WOM":
            raise ValueError(f"{self} does not divide time into periods")
        date = date_of(us)
        day = F.floor(us / DAY).cast("bigint")
        if self.base in UNITS:
            return us - F.pmod(us, F.lit(UNITS[self.base]))
        if self.base == "W":
            return (day + F.pmod(F.lit(WEEKDAYS.index(self.anchor)) - F.pmod(day + 3, F.lit(7)), F.lit(7))) * DAY
        if self.base == "B":
            return (day - F.greatest(F.pmod(day + 3, F.lit(7)) - 4, F.lit(0))) * DAY
        return _midnight(self._in_month(self._month(date, back=self.base[-1] == "S")))


# ---------------------------------------------------------------- recognition


def _steps(c: Column, before: Column, name: str) -> list[Column]:
    return [F.min(c - before).alias(f"{name}_least"), F.max(c - before).alias(f"{name}_most")]


def shapes(counted: DataFrame, keys: Sequence[str] = (), task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per series from (keys, us, n): what its calendar may be told from."""
    stepped = running_last(counted, "before", F.col("us"), ["us"], keys, include_current=False, task_rows=task_rows)
    us, before = F.col("us"), F.col("before")
    delta, date, earlier = us - before, date_of(us), date_of(before)
    weekday, day = F.weekday(date), F.dayofmonth(date)
    left = F.dayofmonth(F.last_day(date)) - day
    month = F.year(date) * 12 + F.month(date)
    week = F.floor((day - 1) / 7).cast("int")
    after_weekend = (weekday == 0) & (delta == 3 * DAY)
    return stepped.groupBy(*[quoted(k) for k in keys]).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("instants"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.max("n").alias("repeats"),
        F.min(delta).alias("least"),
        F.max(delta).alias("most"),
        *_steps(F.year(date), F.year(earlier), "years"),
        *_steps(month, F.year(earlier) * 12 + F.month(earlier), "months"),
        F.min(F.month(date)).alias("month_least"),
        F.max(F.month(date)).alias("month_most"),
        F.bool_and(day == 1).alias("starts"),
        F.bool_and((day == 1) | ((day <= 3) & (weekday == 0))).alias("business_starts"),
        F.bool_and(left == 0).alias("ends"),
        F.bool_and((left == 0) | ((left < 3) & (weekday == 4))).alias("business_ends"),
        F.bool_and(delta.isNull() | after_weekend | (weekday.between(1, 4) & (delta == DAY))).alias("business_days"),
        F.bool_and(delta.isNull() | (delta == HOUR) | (delta == 17 * HOUR) | (delta == 65 * HOUR)).alias("office_hours"),
        F.min(weekday).alias("weekday_least"),
        F.max(weekday).alias("weekday_most"),
        F.min(F.when(week < 4, week)).alias("week_least"),
        F.max(F.when(week < 4, week)).alias("week_most"),
    )


def recognized() -> Column:
    """Struct (base, multiple, anchor) over a row of :func:`shapes`; null where no calendar fits.

    A series needs three instants, none of them repeated.  Rules are tried from years down: a
    month position all instants share and one step in years, quarters or months; one step in days or below; business days and
    hours; one weekday of the month.
    """
    c = F.col
    names = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    calendar = lambda base, multiple=1, anchor=None: F.struct(
        (base if isinstance(base, Column) else F.lit(base)).alias("base"),
        (multiple if isinstance(multiple, Column) else F.lit(multiple)).cast("bigint").alias("multiple"),
        (anchor if isinstance(anchor, Column) else F.lit(anchor)).cast("string").alias("anchor"),
    )
    position = (
        F.when(c("ends"), F.array(F.lit(""), F.lit("E")))
        .when(c("business_ends"), F.array(F.lit("B"), F.lit("E")))
        .when(c("starts"), F.array(F.lit(""), F.lit("S")))
        .when(c("business_starts"), F.array(F.lit("B"), F.lit("S")))
    )
    base = lambda letter: F.concat(position[0], F.lit(letter), position[1])
    first = date_of(c("first_us"))
    placed, daily, even = position.isNotNull(), c("least") % DAY == 0, c("least") == c("most")
    months, one_month_step = c("months_least"), c("months_least") == c("months_most")
    yearly = placed & (c("years_least") == c("years_most")) & (c("years_least") >= 1) & (c("month_least") == c("month_most"))
    days = (c("least") / DAY).cast("bigint")
    third = names([MONTHS[11], MONTHS[9], MONTHS[10]], F.month(first) % 3)
    nth = F.concat((c("week_least") + 1).cast("string"), names(WEEKDAYS, c("weekday_least")))
    on_days = (
        F.when(yearly, calendar(base("Y"), c("years_least"), names(MONTHS, F.month(first) - 1)))
        .when(placed & one_month_step & (months >= 1) & (months % 3 == 0), calendar(base("Q"), months / 3, third))
        .when(placed & one_month_step & (months >= 1), calendar(base("M"), months))
        .when(even & (days % 7 == 0), calendar("W", days / 7, names(WEEKDAYS, F.weekday(first))))
        .when(even, calendar("D", days))
        .when(c("business_days") & (c("least") == DAY) & (c("most") == 3 * DAY), calendar("B"))
        .when((c("weekday_least") == c("weekday_most")) & (c("week_least") == c("week_most")), calendar("WOM", 1, nth))
    )
    below = F.when(c("office_hours") & (c("least") == HOUR) & (c("most") > HOUR), calendar("bh"))
    for unit in ("h", "min", "s", "ms", "us"):
        below = below.when(even & (c("least") % UNITS[unit] == 0), calendar(unit, c("least") / UNITS[unit]))
    fit = (c("instants") >= 3) & (c("repeats") == 1)
    return F.when(fit & daily, on_days).when(fit & ~daily, below)


def code_of(calendar: Column) -> Column:
    """The code of a struct (base, multiple, anchor), as ``2QE-MAR``."""
    count = F.when(calendar["multiple"] == 1, F.lit("")).otherwise(calendar["multiple"].cast("string"))
    return F.concat(count, calendar["base"], F.coalesce(F.concat(F.lit("-"), calendar["anchor"]), F.lit("")))


def weekday_of_month_length(first: Column, last: Column, week: Column, weekday: Column) -> Column:
    """Number of months whose ``week``-th (from 0) given weekday lies between two instants."""
    month = lambda date: F.trunc(date, "month")
    held = lambda date: F.date_add(month(date), (F.pmod(weekday - F.weekday(month(date)), F.lit(7)) + 7 * week).cast("int"))
    clock = F.pmod(first, F.lit(DAY))
    a = date_of(first)
    on = held(a) == a
    b = date_of(F.when(on, last).otherwise(last - clock))
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) + 1
    short = F.when(on, _cut_short(first, last)).otherwise(F.lit(0))
    return (months - (held(a) < a).cast("int") - (held(b) > b).cast("int") - short).cast("bigint")
