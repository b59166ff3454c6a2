"""Column -> Column helpers for the scalar functions the queries use.

All of them are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none is a Python UDF. Casts (F4) are ``Column.cast``,
IIF/CASE (F11) is ``when/otherwise``, arithmetic (F19) stays in integers where
the reference relies on decimal rounding.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def idiv(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Integer division of longs (SQL ``a div b``), exact over their whole range; NULL for b = 0."""
    b_c = _c(b).cast("long")
    return F.call_function("div", _c(a).cast("long"), F.nullif(b_c, F.lit(0)))


def full_name(first: ColumnOrName, last: ColumnOrName) -> Column:
    """``CONCAT_WS(' ', first, last)`` - NULL parts are skipped."""
    return F.concat_ws(" ", _c(first), _c(last))


def strict_name(first: ColumnOrName, last: ColumnOrName) -> Column:
    """``first + ' ' + last`` - NULL when either part is NULL."""
    return F.concat(_c(first), F.lit(" "), _c(last))


def concat_nulls_as_empty(*cols: ColumnOrName) -> Column:
    """T-SQL ``CONCAT`` treats NULL as ''; Spark's ``concat`` would return NULL."""
    return F.concat_ws("", *[_c(c) for c in cols])


def hundredths_of_percent(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Exact ``ROUND(100.0 * num / den, 2)`` scaled to a long, rounding half up.

    Integer arithmetic keeps the result identical on every engine (decimal
    division in some engines goes through double). ``den = 0`` gives NULL (F10
    ``NULLIF``). Both inputs are counts, so they are non-negative.
    """
    n = _c(num).cast("long")
    d = F.nullif(_c(den).cast("long"), F.lit(0))
    return idiv(n * 20000 + d, d * 2)


def whole_percent(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``ROUND(num / den, 2) * 100`` as a long, half up; inputs are whole numbers (Q1)."""
    n = _c(num).cast("long")
    d = F.nullif(_c(den).cast("long"), F.lit(0))
    return idiv(n * 200 + d, d * 2)


def percent_text_fixed(hundredths: ColumnOrName) -> Column:
    """hundredths of a percent -> ``'86.36%'`` (always two decimals)."""
    h = _c(hundredths)
    return F.concat(
        idiv(h, F.lit(100)).cast("string"), F.lit("."),
        F.lpad((h % 100).cast("string"), 2, "0"), F.lit("%"),
    )


def percent_text_trimmed(hundredths: ColumnOrName) -> Column:
    """hundredths of a percent -> ``'29.49%'``, ``'27%'``, ``'7.9%'`` (no trailing zeros)."""
    h = _c(hundredths)
    whole = idiv(h, F.lit(100)).cast("string")
    frac = h % 100
    body = (
        F.when(frac == 0, whole)
        .when(frac % 10 == 0, F.concat(whole, F.lit("."), idiv(frac, F.lit(10)).cast("string")))
        .otherwise(F.concat(whole, F.lit("."), F.lpad(frac.cast("string"), 2, "0")))
    )
    return F.concat(body, F.lit("%"))


def first_word(name: ColumnOrName) -> Column:
    """F12 first half: ``LEFT(n, CHARINDEX(' ', n + ' ') - 1)``."""
    return F.substring_index(_c(name), " ", 1)


def after_first_word(name: ColumnOrName) -> Column:
    """F12 second half: ``LTRIM(SUBSTRING(n, CHARINDEX(' ', n + ' '), LEN(n)))``; '' for one word."""
    n = _c(name)
    pos = F.instr(F.concat(n, F.lit(" ")), " ")
    return F.ltrim(n.substr(pos, F.length(n) + 1))


def nth_part(text: ColumnOrName, sep: str, n: int) -> Column:
    """N-th (1-based) field of ``text`` split on ``sep``; NULL when out of range.

    W8's ``ROW_NUMBER() OVER (ORDER BY (SELECT NULL))`` over STRING_SPLIT is not
    needed: the array position is the real field ordinal."""
    return F.get(F.split(_c(text), re.escape(sep)), n - 1)


def year_range(lo: ColumnOrName, hi: ColumnOrName, dash: str = "-") -> Column:
    """``'1991'`` for a one-year island, ``'1991-2006'`` otherwise."""
    lo_c, hi_c = _c(lo), _c(hi)
    return F.when(lo_c == hi_c, lo_c.cast("string")).otherwise(
        F.concat_ws(dash, lo_c.cast("string"), hi_c.cast("string")))


def time_text(micros: ColumnOrName) -> Column:
    """A TIME kept as microseconds (a long, SURVEY 1.3) printed like the reference's
    TIME(7) values: ``'00:01:19.8130000'`` (hours, minutes, seconds, 7 decimals)."""
    us = _c(micros).cast("long")
    hours = idiv(us, F.lit(3_600_000_000))
    minutes = idiv(us % 3_600_000_000, F.lit(60_000_000))
    seconds = idiv(us % 60_000_000, F.lit(1_000_000))
    fraction = (us % 1_000_000) * 10
    return F.concat(F.lpad(hours.cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(minutes.cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(seconds.cast("string"), 2, "0"), F.lit("."),
                    F.lpad(fraction.cast("string"), 7, "0"))
