"""Column helpers: exact money, null-safe ratios, dates, JSON, arrays and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- money -----------------------------------------------------------------
# Amounts are doubles with two decimals. They are added as whole cents, so that a sum does
# not depend on the order of the rows, and in a decimal that 10^28 cents fit into.

def cents(c: str | Column) -> Column:
    """An amount as whole cents; cheaper than a cast of the double to a decimal."""
    return F.rint(col(c) * 100).cast("long")


def total(units: Column, digits: int) -> Column:
    """Exact sum of whole units of 10^-digits."""
    return F.sum(units.cast("decimal(18,0)")) * F.lit(10 ** -digits).cast(f"decimal({digits},{digits})")


def money(c: str | Column) -> Column:
    """An amount as an exact decimal."""
    return cents(c).cast("decimal(18,0)") * F.lit(0.01).cast("decimal(2,2)")


def money_total(c: str | Column) -> Column:
    return total(cents(c), 2)


def exact_sum(c: str | Column, digits: int = 2) -> Column:
    """Sum of values that have ``digits`` decimals; further ones are rounded away."""
    return total(F.rint(col(c) * 10 ** digits).cast("long"), digits).cast("double")


def exact_avg(c: str | Column, digits: int = 2) -> Column:
    return exact_sum(c, digits) / F.count(col(c))


def amount_total(c: str | Column, digits: int | None = None) -> Column:
    """Sum in the column's own type; with ``digits``, exactly in units of 10^-digits, which the caller says the values have."""
    return F.sum(col(c)) if digits is None else total(F.rint(col(c) * 10 ** digits).cast("long"), digits)


def amount_avg(c: str | Column, digits: int | None = None) -> Column:
    return amount_total(c, digits).cast("double") / F.nullif(F.count(col(c)), F.lit(0).cast("long"))


def revenue_units() -> Column:
    """Discounted line price in units of 10^-4, in which it is whole."""
    return cents("l_extendedprice") * (F.lit(100) - cents("l_discount"))


def revenue_total() -> Column:
    return total(revenue_units(), 4)


# --- ratios and defaults ---------------------------------------------------

def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (plain ``/ 0`` raises in ANSI mode)."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def pct(a: str | Column, b: str | Column, digits: int = 2) -> Column:
    """ROUND(100.0 * a / NULLIF(b, 0), digits)."""
    return F.round(ratio(F.lit(100.0) * col(a), col(b).cast("double")), digits)


def flag_when(condition: Column, yes=1, no=0) -> Column:
    """CASE WHEN condition THEN yes ELSE no; a NULL condition counts as no."""
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


# Fixed spellings of a stored truth value.
TRUE_VALUES, FALSE_VALUES = ["1", "Y", "TRUE", "T"], ["0", "N", "FALSE", "F"]


def as_bool(c: str | Column) -> Column:
    """Boolean from 0 / 1, 'Y' / 'N' or true / false; anything else is NULL."""
    text = F.upper(F.trim(col(c).cast("string")))
    return F.when(text.isin(TRUE_VALUES), True).when(text.isin(FALSE_VALUES), False)


def band(c: str | Column, cuts: list[tuple[float, str]], last: str) -> Column:
    """CASE ladder: label of the first upper bound the value stays below."""
    expr = None
    for upper, label in cuts:
        test = col(c) < upper
        expr = F.when(test, label) if expr is None else expr.when(test, label)
    return expr.otherwise(last)


# --- strings ---------------------------------------------------------------

def concat_strict(*cols: str | Column) -> Column:
    """``||``: NULL if any part is NULL."""
    return F.concat(*[col(c) for c in cols])


def concat_skip_null(*cols: str | Column) -> Column:
    """CONCAT that leaves NULL parts out."""
    return F.concat_ws("", *[col(c) for c in cols])


def ci_equals(a: str | Column, b: str | Column) -> Column:
    return F.lower(col(a)) == F.lower(col(b))


def ci_like(a: str | Column, pattern: str) -> Column:
    return col(a).ilike(pattern)


def matches(c: str | Column, pattern: str, regex: bool = True) -> Column:
    """Case-insensitive regex or substring test; NULL or empty text or pattern gives false."""
    if not pattern:
        return F.lit(False)
    test = col(c).rlike(f"(?i){pattern}") if regex else F.contains(F.lower(col(c)), F.lit(pattern.lower()))
    return F.coalesce(test & (F.length(col(c)) > 0), F.lit(False))


def indent(c: str | Column, level: str | Column, unit: str = "  ") -> Column:
    """Prefix a name with ``level - 1`` units."""
    return F.concat(F.repeat(F.lit(unit), (col(level) - 1).cast("int")), col(c))


def snippet(c: str | Column, n: int = 80) -> Column:
    """At most ``n`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("…"))).otherwise(col(c))


# --- dates -----------------------------------------------------------------

def month_of(c: str | Column) -> Column:
    return F.trunc(col(c).cast("date"), "month")


def quarter_start(c: str | Column) -> Column:
    return F.trunc(col(c).cast("date"), "quarter")


def year_of(c: str | Column) -> Column:
    return F.year(col(c)).cast("long")


def add_days(c: str | Column, n: int) -> Column:
    return F.date_add(col(c).cast("date"), n)


def add_months(c: str | Column, n: int) -> Column:
    """Shift by months; a day past the month's end is clipped to it."""
    return F.add_months(col(c).cast("date"), n)


def date_diff(a: str | Column, b: str | Column, mode: str = "days") -> Column:
    """b - a as whole ``days``, calendar-boundary ``years`` or fractional ``months``."""
    if mode == "days":
        return F.date_diff(col(b), col(a)).cast("long")
    if mode == "years":
        return (F.year(col(b)) - F.year(col(a))).cast("long")
    if mode == "months":
        return F.months_between(col(b).cast("date"), col(a).cast("date"))
    raise ValueError(f"unknown mode {mode!r}")


def date_series(lo: str | Column, hi: str | Column, step: str = "1 day") -> Column:
    """All dates from ``lo`` to ``hi`` by ``step``, as an array; NULL where an end is missing or ``hi`` comes first."""
    first, last = col(lo).cast("date"), col(hi).cast("date")
    return F.when(first <= last, F.sequence(first, last, F.expr(f"interval {step}")))


def months_apart(a: str | Column, b: str | Column) -> Column:
    """Whole calendar months from a to b (12 * years + months)."""
    return (12 * (F.year(col(b)) - F.year(col(a))) + F.month(col(b)) - F.month(col(a))).cast("long")


def fmt_date(c: str | Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(col(c), pattern)


def epoch_seconds(c: str | Column) -> Column:
    return F.unix_seconds(col(c).cast("timestamp"))


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch, exact."""
    return F.unix_micros(col(c).cast("timestamp"))


# --- JSON and arrays -------------------------------------------------------

def json_field(c: str | Column, path: str, dtype: str = "string") -> Column:
    return F.get_json_object(col(c), path).try_cast(dtype)


def json_contains(c: str | Column, path: str, value) -> Column:
    """The field exists and equals the value; NULL never matches."""
    return F.coalesce(F.get_json_object(col(c), path) == F.lit(str(value)), F.lit(False))


def row_json(*cols: str, keep_null: bool = False) -> Column:
    """The row as JSON; NULL fields are left out unless ``keep_null``."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": str(not keep_null).lower()})


def array_contains_all(arr: str | Column, values: list) -> Column:
    """``arr @> values``."""
    return F.size(F.array_except(F.array(*[F.lit(v) for v in values]), col(arr))) == 0


def array_append(arr: str | Column, value) -> Column:
    return F.concat(col(arr), F.array(F.lit(value)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
