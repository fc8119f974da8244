"""Strict, never-failing conversions from feed and grid text to typed values."""

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MONEY
from .text import _col, cell_trim

# Answers that mean "foil", and the comment marking a row priced by hand.
FOIL_WORDS = ["sim", "s", "yes", "y", "foil", "true"]
MANUAL_MARKER = "*conferir sempre manualmente"

_ISO_LOCAL = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"


def safe_date(c) -> Column:
    """ISO ``yyyy-MM-dd`` only; anything else is null."""
    c = _col(c)
    return F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c.try_cast("date"))


def parse_ts(c) -> Column:
    """ISO local date-time; anything else, a bare date included, is null."""
    c = _col(c)
    return F.when(c.rlike(rf"\A{_ISO_LOCAL}\z"), c.try_cast("timestamp_ntz"))


def moment(value, up: bool = False) -> datetime:
    """Date-time of an ISO local text, malformed text being an error; columns hold microseconds,
    so a finer fraction is cut off, or rounded ``up``."""
    if isinstance(value, datetime):
        return value
    if not re.fullmatch(_ISO_LOCAL, value, re.ASCII):
        raise ValueError(f"not an ISO local date-time: {value!r}")
    head, _, fraction = value.partition(".")
    micros = int(fraction.ljust(9, "0")[:6]) + (up and bool(fraction[6:].strip("0")))
    return datetime.fromisoformat(head) + timedelta(microseconds=micros)


def ts_literal(value, up: bool = False) -> Column:
    """Zone-less timestamp literal of a datetime or ISO local text."""
    return F.lit(moment(value, up).isoformat()).cast("timestamp_ntz")


def ts_bound(value, upper: bool = False) -> Column | None:
    """Literal for a range bound; None or blank means unbounded, malformed text is an error."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    return ts_literal(value, up=not upper)


def foil_flag(c) -> Column:
    return F.coalesce(F.lower(cell_trim(c)).isin(FOIL_WORDS), F.lit(False))


def manual_flag(c) -> Column:
    return F.coalesce(F.lower(cell_trim(c)).startswith(MANUAL_MARKER), F.lit(False))


def cell_text(c, number) -> Column:
    """Text of a grid cell; a number that is whole shows without a fraction."""
    number = _col(number)
    whole = F.when(number == F.floor(number), number.try_cast("long").cast("string"))
    return F.coalesce(whole, number.cast("string"), _col(c))


def parse_quantity(c, number=None) -> Column:
    """Whole number of at least 1; blank or malformed text counts as 1, a number is cut off."""
    text = cell_trim(c)
    whole = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("int"))
    if number is not None:
        whole = F.when(_col(number).isNotNull(), _col(number).try_cast("int")).otherwise(whole)
    return F.greatest(F.coalesce(whole, F.lit(1)), F.lit(1))


def cell_decimal(c, number=None) -> Column:
    """Money from a grid cell, surrounding blanks allowed; malformed text is null."""
    money = cell_trim(c).try_cast(MONEY)
    return money if number is None else F.coalesce(_col(number).try_cast(MONEY), money)


def pick_price(foil, usd, usd_foil) -> Column:
    """Foil-aware feed price; text with surrounding blanks counts as malformed."""
    raw = F.when(_col(foil), _col(usd_foil)).otherwise(_col(usd))
    return F.when(~raw.rlike(r"\A\s|\s\z"), raw.try_cast(MONEY))
