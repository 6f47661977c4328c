"""Time algebra on epoch milliseconds, as Columns and as numbers.

Time is a LONG, because the first and last instant lie far outside the range of TIMESTAMP.  Intervals are half-open; an
instant has equal ends.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First and last instant.
MIN_MS, MAX_MS = -8_334_601_228_800_000, 8_210_266_876_799_999

#: Milliseconds of the granularities that have a fixed length.
UNIT_MS = {"millis": 1, "seconds": 1_000, "minutes": 60_000, "hours": 3_600_000, "days": 86_400_000}
GRANULARITIES = (*UNIT_MS, "months", "years")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def to_ms(text: str | int) -> int:
    """Epoch milliseconds of an ISO 8601 string (UTC unless it has an offset); numbers pass."""
    if isinstance(text, int):
        return text
    when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return (when - _EPOCH) // timedelta(milliseconds=1)


def _date(ms: int) -> datetime:
    return _EPOCH + timedelta(milliseconds=ms)


def intersects(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two intervals share an instant; equal instants do, an instant at the other's end does not."""
    return ((a_start == b_start) & (a_end == b_end)) | ((a_start >= b_start) & (a_start < b_end)) | ((b_start >= a_start) & (b_start < a_end))


def interval_intersects(a: tuple[int, int], b: tuple[int, int]) -> bool:
    return a == b or b[0] <= a[0] < b[1] or a[0] <= b[0] < a[1]


def floor_div(a: Column, by: int) -> Column:
    """Division of longs rounded down; the quotient is whole before it becomes a double, so nothing is lost."""
    return ((a - F.pmod(a, F.lit(by).cast("long"))) / F.lit(by)).cast("long")


def days_of(ms: Column) -> Column:
    """Whole days since the epoch, rounded down."""
    return F.floor(ms / F.lit(86_400_000)).cast("int")


def _moved(days: Column, months: Column | int, rest: Column) -> Column:
    """Milliseconds of a day some months later; a day that the month lacks becomes its last."""
    return F.unix_date(F.add_months(F.date_from_unix_date(days), months)).cast("long") * 86_400_000 + rest


def _inside(t: Column) -> Column:
    """``t`` cut to what the calendar can tell."""
    return F.least(F.greatest(t, F.lit(-62_135_596_800_000)), F.lit(253_402_214_400_000))


@dataclass(frozen=True)
class TimeStep:
    """A number of units of the calendar; months and years have no fixed length."""

    granularity: str
    step: int

    def __post_init__(self) -> None:
        if self.granularity not in GRANULARITIES:
            raise ValueError(f"unknown granularity {self.granularity!r}")
        if self.step <= 0:
            raise ValueError("a step must be positive")

    @property
    def months(self) -> int:
        return self.step * (12 if self.granularity == "years" else 1)

    @property
    def fixed_ms(self) -> int | None:
        """Length of the step, where it has one."""
        unit = UNIT_MS.get(self.granularity)
        return unit and unit * self.step

    def index(self, t: Column, reference: int) -> Column:
        """How many steps from the reference the snapped time lies.

        Differences count whole units, cut off towards zero, before they are rounded down to steps.
        """
        if unit := UNIT_MS.get(self.granularity):
            whole = _div(t - F.lit(reference), unit)
            return floor_div(whole, self.step)
        ref, date = _date(reference), F.date_from_unix_date(days_of(_inside(t)))
        year, month = F.year(date), F.month(date)
        if self.granularity == "years":
            return floor_div(year - ref.year, self.step)
        return floor_div((year - ref.year) * 12 + month - ref.month, self.step)

    def at(self, index: Column, reference: int) -> Column:
        """The time that lies ``index`` steps after the reference."""
        if fixed := self.fixed_ms:
            return (F.lit(reference) + index * F.lit(fixed)).cast("long")
        day, rest = divmod(reference, 86_400_000)
        return _moved(F.lit(day), (index * self.months).cast("int"), F.lit(rest).cast("long"))

    def snap(self, t: Column, reference: int = 0) -> Column:
        """The step at or before ``t`` (see ``index`` for times before the reference); the first and last instant stay."""
        inner = self.at(self.index(t, reference), reference)
        return F.when(t <= MIN_MS, F.lit(MIN_MS)).when(t >= MAX_MS, F.lit(MAX_MS)).otherwise(inner).cast("long")

    def add(self, t: Column, n: int = 1) -> Column:
        """``n`` steps later; the first and last instant stay."""
        if fixed := self.fixed_ms:
            moved = t + F.lit(n * fixed)
        else:
            moved = _moved(days_of(_inside(t)), n * self.months, F.pmod(t, F.lit(86_400_000).cast("long")))
        return F.when((t <= MIN_MS) | (t >= MAX_MS), t).otherwise(moved).cast("long")

    def snap_ms(self, t: int, reference: int = 0) -> int:
        """``snap`` of a number."""
        if t <= MIN_MS or t >= MAX_MS:
            return max(MIN_MS, min(MAX_MS, t))
        if unit := UNIT_MS.get(self.granularity):
            diff = t - reference
            whole = abs(diff) // unit * (1 if diff >= 0 else -1)
            return reference + whole // self.step * self.step * unit
        ref, own = _date(reference), _date(t)
        diff = (own.year - ref.year) * 12 + (own.month - ref.month if self.granularity == "months" else 0)
        return self._shifted(reference, diff // self.months * self.months)

    def index_ms(self, t: int, reference: int = 0) -> int:
        """``index`` of a number."""
        if unit := UNIT_MS.get(self.granularity):
            diff = t - reference
            return (abs(diff) // unit * (1 if diff >= 0 else -1)) // self.step
        ref, own = _date(reference), _date(t)
        return ((own.year - ref.year) * 12 + (own.month - ref.month if self.granularity == "months" else 0)) // self.months

    def add_ms(self, t: int, n: int = 1) -> int:
        """``add`` of a number."""
        if t <= MIN_MS or t >= MAX_MS:
            return t
        if fixed := self.fixed_ms:
            return t + n * fixed
        return self._shifted(t, n * self.months)

    @staticmethod
    def _shifted(t: int, months: int) -> int:
        when = _date(t)
        total = when.year * 12 + when.month - 1 + months
        year, month = divmod(total, 12)
        day = min(when.day, calendar.monthrange(year, month + 1)[1])
        return to_ms(when.replace(year=year, month=month + 1, day=day).isoformat())

    def steps(self, start: int, end: int, reference: int = 0) -> list[tuple[int, int]]:
        """All steps that intersect [start, end); for an instant the one that holds it."""
        at, out = self.snap_ms(start, reference), []
        while at < end or not out:
            out.append((at, self.add_ms(at)))
            at = out[-1][1]
        return out

    @classmethod
    def of(cls, spec: TimeStep | dict) -> TimeStep:
        return spec if isinstance(spec, TimeStep) else cls(spec["granularity"].lower(), spec["step"])

    def json(self) -> dict:
        return {"granularity": self.granularity, "step": self.step}


def _div(a: Column, unit: int) -> Column:
    """Division of longs that cuts off towards zero."""
    return F.when(a >= 0, floor_div(a, unit)).otherwise(-floor_div(-a, unit))
