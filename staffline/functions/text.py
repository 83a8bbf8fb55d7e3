"""Text tests used by the KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's for equal results) -------------------------
# Words that mark an exit as voluntary, searched in the lower-cased exit type or reason.
VOLUNTARY_PATTERN = "voluntário|pedido|demissão|rescisão"
# Words that mark a leadership role, searched in the lower-cased role.
LEADER_PATTERN = "coord|gerente|diretor"
# Contract value counted as CLT (compared upper-cased) and gender values (compared lower-cased).
CLT_VALUE = "CLT"
FEMALE_VALUES = ("feminino",)
MALE_VALUES = ("masculino", "m")
# -------------------------------------------------------------------------------------------


def contains_any(c: Column, pattern: str) -> Column:
    """Null-safe regex test on the lower-cased text (null → false)."""
    return F.coalesce(F.lower(c).rlike(pattern), F.lit(False))


def voluntary_flag(df: DataFrame, mode: str = "compat") -> Column:
    """True when an exit counts as voluntary.

    If the table has an ``exit_type`` column it decides alone, also where it is null; otherwise
    ``exit_reason`` is searched. In a table of several data sets ``has_exit_type`` says for each
    row whether its own set has that column. ``mode='compat'`` is the plain substring search (so
    'involuntário' matches 'voluntário'); ``mode='word'`` requires whole words.
    """
    has = [c for c in ("exit_type", "exit_reason") if c in df.columns]
    if not has:
        return F.lit(False)
    source = F.col(has[0])
    if len(has) == 2 and "has_exit_type" in df.columns:
        source = F.when(F.col("has_exit_type"), source).otherwise(F.col("exit_reason"))
    if mode == "word":
        pattern = r"(?<![\p{L}])(" + VOLUNTARY_PATTERN + r")(?![\p{L}])"
    else:
        pattern = VOLUNTARY_PATTERN
    return contains_any(source, pattern)


def capitalize_first(c: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def non_blank(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c.cast("string")) != "")
