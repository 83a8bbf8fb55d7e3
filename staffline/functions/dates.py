"""Date and month expressions.

Spells are handled as DATE values: hire and exit are cut to the day when staff is prepared,
so a month start is plain midnight and every comparison below is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default reference instant for every query over the test tables ("now" in the reference).
DEFAULT_AS_OF = "2001-12-01 00:00:00"

# Spellings of a date that arrives as text (see ``coerce_timestamp``): year first, year last, compact;
# each with an optional time (seconds, fraction and zone optional).
_TIME = r"(?:[T ]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?"
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME + "$"
YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _TIME + "$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})" + _TIME + "$"


def ts_lit(value: str) -> Column:
    """A TIMESTAMP_NTZ literal (the test tables carry NTZ timestamps)."""
    return F.expr(f"TIMESTAMP_NTZ '{value}'")


def date_lit(value: str) -> Column:
    return F.expr(f"DATE '{value[:10]}'")


def month_floor(d: Column) -> Column:
    """First day of the month of a DATE."""
    return F.trunc(d, "MM")


def month_label(d: Column) -> Column:
    """'yyyy-MM' label of a month start."""
    return F.date_format(d, "yyyy-MM")


def months_30(later: Column, earlier: Column) -> Column:
    """Whole days between two dates divided by 30 (floor of whole days: dates carry no time)."""
    return F.datediff(later, earlier) / F.lit(30.0)


def month_sequence(lo: Column, hi: Column) -> Column:
    """All month starts from ``lo`` (a month start) to ``hi``; null when the range is empty."""
    return F.when(lo <= hi, F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH")))


def coerce_timestamp(c: Column, day_first: bool | Column = False) -> Column:
    """Text → TIMESTAMP_NTZ; anything that is no date becomes null (never raises under ANSI).

    Year-first, year-last and compact dates with one- or two-digit parts and an optional time; a zone
    is dropped, so the wall-clock time stays. Year-last dates are read month first, as the reference
    reads them, or day first on request (a flag, or a column that tells it per row); a first part above 12 is a day either way, and so is a
    second one."""
    text = F.trim(c.cast("string"))

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    def built(pattern: str, y: Column, m: Column, d: Column) -> Column:
        pad = lambda x: F.when(x == "", F.lit("00")).otherwise(F.lpad(x, 2, "0"))
        fraction = F.rpad(F.substring(part(pattern, 7), 1, 6), 6, "0")
        iso = F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"), F.lit(" "), pad(part(pattern, 4)),
                       F.lit(":"), pad(part(pattern, 5)), F.lit(":"), pad(part(pattern, 6)), F.lit("."), fraction)
        return F.when(text.rlike(pattern), iso.try_cast("timestamp_ntz"))

    a, b = part(YEAR_LAST, 1), part(YEAR_LAST, 2)
    number = lambda x: x.try_cast("int")
    a_is_day = (number(a) > 12) | ((number(b) <= 12) & (F.lit(day_first) if isinstance(day_first, bool) else day_first))
    return F.coalesce(
        built(YEAR_FIRST, part(YEAR_FIRST, 1), part(YEAR_FIRST, 2), part(YEAR_FIRST, 3)),
        built(YEAR_LAST, part(YEAR_LAST, 3), F.when(a_is_day, b).otherwise(a), F.when(a_is_day, a).otherwise(b)),
        built(COMPACT, part(COMPACT, 1), part(COMPACT, 2), part(COMPACT, 3)))


def order_evidence(c: Column) -> tuple[Column, Column]:
    """Of a text date: 1 where it can only be read day first, 1 where it can only be read month first (else 0)."""
    text = F.trim(c.cast("string"))
    a, b = (F.regexp_extract(text, YEAR_LAST, i).try_cast("int") for i in (1, 2))
    one = lambda x: F.when(x, 1).otherwise(0)
    return one((a > 12) & (a <= 31) & (b <= 12)), one((b > 12) & (b <= 31) & (a <= 12))


def make_month(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


# ---- fixed values: month names and period texts shown by the reference ----------------------
MONTH_NAMES = ("Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
               "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro")
LABEL_ALL = "Todo o período"
LABEL_YEAR = "Ano %s (média mensal)"
LABEL_MONTH = "Mês %s (média de todos os anos)"
# ---------------------------------------------------------------------------------------------


def month_name(month: Column) -> Column:
    """Month number 1-12 → its name (null outside)."""
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), month)


def month_number(name: Column) -> Column:
    """Month name → number 1-12 (0 when unknown): ``array_position`` on the name list."""
    return F.array_position(F.array(*[F.lit(n) for n in MONTH_NAMES]), name)


def period_label(year: Column | None, month: Column | None) -> Column:
    """Text of a period filter: 'Março/2000', 'Ano 2000 (média mensal)',
    'Mês Março (média de todos os anos)' or 'Todo o período'."""
    if year is not None and month is not None:
        return F.concat(month_name(month), F.lit("/"), year.cast("string"))
    if year is not None:
        return F.format_string(LABEL_YEAR, year.cast("string"))
    if month is not None:
        return F.format_string(LABEL_MONTH, month_name(month))
    return F.lit(LABEL_ALL)
