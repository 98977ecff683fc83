"""Field cleaners for the raw retail CSVs, as Column expressions (no Python UDFs).

Each ``parse_*`` returns the typed value or NULL when the text is not valid; the
matching ``require_*`` wraps it so a bad value fails the job with a message naming
the column and the raw text (the load aborts on the first parse error, like the
reference). Everything stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise.schema import SPEND_TYPE

# The white space that ECMAScript String.prototype.trim removes
# (tab, line feed, vertical tab, form feed, carriage return, space, no-break space,
# ogham space, en quad .. hair space, line separator, paragraph separator, narrow
# no-break space, medium mathematical space, ideographic space, byte order mark).
JS_WHITESPACE = ("\t\n\u000b\f\r \u00a0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000\ufeff")

# English month abbreviations of the DD-MON-YY date format, in
# calendar order, and the two-digit-year pivot (yy < 70 -> 20yy, else 19yy).
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN",
          "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
YEAR_PIVOT = 70
ORACLE_DATE_PATTERN = r"^(\d{1,2})-([A-Z]{3})-(\d{2})$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column | str) -> Column:
    """Trim all Unicode white space at both ends (Spark's ``trim`` only strips spaces).

    A missing field (NULL from the CSV reader) is treated as the empty string. Text that
    has visible ASCII at both ends once its spaces are gone needs no look at the whole set.
    """
    return trim_rest(trim_spaces(c))


def trim_spaces(c: Column | str) -> Column:
    return F.trim(F.coalesce(_col(c), F.lit("")))


def trim_rest(c: Column | str) -> Column:
    """The second half of ``js_trim``; reads its argument, spaces trimmed, several times."""
    t = _col(c)
    last = F.substring(t, -1, 1)
    done = (t >= "!") & (t < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(done, t).otherwise(F.btrim(t, F.lit(JS_WHITESPACE)))


def _t(c: Column | str, trimmed: bool) -> Column:
    """The trimmed text; ``trimmed=True`` when the caller trimmed it already in an
    earlier projection (keeps each generated expression small)."""
    return F.coalesce(_col(c), F.lit("")) if trimmed else js_trim(c)


def clean_optional_text(c: Column | str, trimmed: bool = False) -> Column:
    """Trimmed text; empty or the word ``null`` in any case -> NULL."""
    t = _t(c, trimmed)
    return F.when((t == "") | (F.lower(t) == "null"), F.lit(None).cast("string")).otherwise(t)


def clean_text(c: Column | str, trimmed: bool = False) -> Column:
    """Required text: trimmed only (an empty value stays empty)."""
    return _t(c, trimmed)


#: Digits with an optional sign, fraction and exponent.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_int(c: Column | str, trimmed: bool = False) -> Column:
    """Padded (spaces or leading zeros) integer -> bigint; NULL when not an integer.

    Whole numbers written as ``1.0`` or ``1e3`` are accepted; an empty field is 0.
    """
    t = _t(c, trimmed)
    direct = F.when(t == "", F.lit(0).cast("bigint")).otherwise(t.try_cast("bigint"))
    # A cast to double alone would take a type suffix (``5d``, ``5f``) too.
    as_double = F.when(t.rlike(NUMBER_PATTERN), t).try_cast("double")
    # As a lambda's argument the double is parsed once. The generated code stays small enough
    # for the JVM to compile (it interprets methods of over 8,000 bytes).
    whole = F.floor(F.get(F.filter(F.array(as_double), lambda x: (F.abs(x) < F.lit(9.2e18))
                                   & (x == F.floor(x))), F.lit(0)))
    return F.coalesce(direct, whole)


def parse_yes_no(c: Column | str, trimmed: bool = False) -> Column:
    v = F.upper(_t(c, trimmed))
    return F.when(v == "Y", F.lit(True)).when(v == "N", F.lit(False))


def parse_money(c: Column | str, trimmed: bool = False) -> Column:
    """Money text such as ``.59`` or `` 3.49 `` -> decimal(10,2), rounded half up;
    an empty field is 0."""
    t = _t(c, trimmed)
    return F.when(t == "", F.lit(0).cast(SPEND_TYPE)).otherwise(t.try_cast(SPEND_TYPE))


def parse_oracle_date(c: Column | str, trimmed: bool = False) -> Column:
    """``DD-MON-YY`` (any case, 1-2 digit day) -> date; NULL when not that shape.

    Day overflow rolls into the next month (31-FEB-18 -> 2018-03-03) and day 0 is
    the last day of the previous month, as with a UTC calendar constructor.
    """
    v = F.upper(_t(c, trimmed))
    ok = v.rlike(ORACLE_DATE_PATTERN)
    # The shape fixes the places of month and year.
    day = F.substring_index(v, "-", 1).try_cast("int")
    mon = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(v, -6, 3)).cast("int")
    yy = F.substring(v, -2, 2).try_cast("int")
    year = F.when(yy < YEAR_PIVOT, yy + 2000).otherwise(yy + 1900)
    first = F.make_date(year, F.greatest(mon, F.lit(1)), F.lit(1))
    return F.when(ok & (mon > 0), F.date_add(first, day - 1))


def require(parsed: Column, raw: Column | str, what: str, column: str) -> Column:
    """Fail the job on the first value that did not parse."""
    message = F.concat(F.lit(f"Expected {what} in {column} but got \""),
                       F.coalesce(_col(raw).cast("string"), F.lit("<missing>")), F.lit("\""))
    return F.when(parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def require_int(raw: Column | str, column: str) -> Column:
    return require(parse_int(raw), raw, "an integer", column)


def require_yes_no(raw: Column | str, column: str) -> Column:
    return require(parse_yes_no(raw), raw, "Y or N", column)


def require_money(raw: Column | str, column: str) -> Column:
    return require(parse_money(raw), raw, "a money value", column)


def require_oracle_date(raw: Column | str, column: str) -> Column:
    return require(parse_oracle_date(raw), raw, "a DD-MON-YY date", column)
