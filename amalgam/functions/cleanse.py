"""Cleansers as expressions; a missing value becomes the empty string."""

from __future__ import annotations

from datetime import date
from importlib.util import find_spec

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.functions.text import cleaned, pytitle, title_case, utrim

#: Address abbreviations, whole words in this case, applied in this order.
ABBREVIATIONS = (
    ("St", "Street"), ("Ave", "Avenue"), ("Blvd", "Boulevard"), ("Dr", "Drive"), ("Rd", "Road"), ("Ln", "Lane"), ("Ct", "Court"), ("Pl", "Place"),
    ("Sq", "Square"), ("Fwy", "Freeway"), ("Hwy", "Highway"), ("Pkwy", "Parkway"), ("N", "North"), ("S", "South"), ("E", "East"), ("W", "West"),
    ("NE", "Northeast"), ("NW", "Northwest"), ("SE", "Southeast"), ("SW", "Southwest"), ("Apt", "Apartment"), ("Ste", "Suite"), ("Flr", "Floor"), ("Bldg", "Building"), ("PO Box", "PO Box"),
)

#: Forms of phone numbers and e-mail addresses that count as valid.
PHONE = r"^\+?[\d\s\-().]{7,15}$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

#: Names of months, and of weekdays that may stand before a date.
_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_WEEKDAY = "(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? +)?"
#: Forms of dates with a month's name, and a time that may follow.
_NAMED = rf"(?i)^{_WEEKDAY}({_MONTH}[ -]\d{{1,2}}(st|nd|rd|th)?(, ?| |-)\d{{4}}|\d{{1,2}}(st|nd|rd|th)?[ -]{_MONTH}[ ,-]+\d{{4}}|\d{{4}}[ -]{_MONTH}[ -]\d{{1,2}}|{_MONTH}[ ,-]+\d{{4}})$"
_TIME = r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: Years whose dates count; others stay as they are.
FIRST_YEAR, LAST_YEAR = 1678, 2261
#: Forms of numbers that say the same whichever of day and month comes first, rewritten as year, month and day.
_PLAIN = ((r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"), (r"^(\d{4})$", "$1-1-1"), (r"^(\d{4})[-/](\d{1,2})$", "$1-$2-1"), (r"^(\d{1,2})[-/](\d{4})$", "$2-$1-1"))
_YEAR_FIRST, _YEAR_LAST = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$"


def normalise_phone(c: Column) -> Column:
    """Digits and plus signs; the value itself if it has none."""
    return cleaned(c, lambda t: F.coalesce(F.nullif(F.regexp_replace(t, r"[^\d+]", ""), F.lit("")), t))


def validate_phone(c: Column) -> Column:
    return F.coalesce(utrim(c.cast("string")).rlike(PHONE), F.lit(False))


def normalise_email(c: Column, strict: bool = False) -> Column:
    """Lower case; with `strict`, an address of no valid form becomes empty."""
    return cleaned(c, lambda t: F.when(F.lower(t).rlike(EMAIL), F.lower(t)).otherwise("") if strict else F.lower(t))


def validate_email(c: Column) -> Column:
    return F.coalesce(utrim(c.cast("string")).rlike(EMAIL), F.lit(False))


def expand_address(c: Column) -> Column:
    def expanded(t: Column) -> Column:
        for short, full in ABBREVIATIONS:
            t = F.regexp_replace(t, rf"\b{short}\b", full)
        return t

    return cleaned(c, expanded)


def standardise_address(c: Column) -> Column:
    return pytitle(expand_address(c))


def parse_address(c: Column) -> Column:
    return F.create_map(F.lit("full_address"), cleaned(c, lambda t: t))


def standardise_name(c: Column) -> Column:
    return cleaned(c, pytitle)


def parse_full_name(c: Column) -> Column:
    return F.create_map(F.lit("full"), cleaned(c, lambda t: t))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def standardise_date(c: Column, day_first: bool = False) -> Column:
    """ISO date of a value in one of the forms above; any other value stays as it is.

    Of two numbers that can both be the month the first is, or with `day_first` the second; where that gives
    no date, the other way. Two digits of a year stand for one less than fifty years ahead or at most fifty back.
    """
    now = date.today().year
    years = {f"{y:02d}": next(x for x in range(y + now // 100 * 100 - 100, now + 151, 100) if now - 50 <= x < now + 50) for y in range(100)}
    centuries = {y[:-2]: "|".join(two for two, full in years.items() if str(full)[:-2] == y[:-2]) for y in sorted(map(str, years.values()))}

    def numbers(t: Column) -> Column:
        for century, two in centuries.items():
            t = F.regexp_replace(t, rf"^(\d{{1,2}}[-/.]\d{{1,2}}[-/.])({two})$", f"$1{century}$2")
        for form, ymd in _PLAIN:
            t = F.regexp_replace(t, form, ymd)
        return t

    def named(t: Column) -> Column:
        month = ((F.instr(F.lit(_MONTHS), F.substring(F.regexp_extract(t, _MONTH, 0), 1, 3)) + 2) / 3).cast("int").cast("string")
        day = F.regexp_extract(t, r"(?<!\d)(\d{1,2})(?!\d)", 1)
        return F.when(t.rlike(_NAMED), F.concat_ws("-", F.regexp_extract(t, r"\d{4}", 0), month, F.when(day == "", "1").otherwise(day)))

    def dated(t: Column, swapped: bool) -> Column:
        m, d = ("$4", "$3") if swapped else ("$3", "$4")
        t = F.regexp_replace(t, _YEAR_FIRST, f"$1-{m}-{d}")
        m, d = ("$3", "$1") if swapped else ("$1", "$3")
        return _let(F.regexp_replace(t, _YEAR_LAST, f"$4-{m}-{d}"), lambda ymd: F.when(ymd.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), ymd.try_cast("date")))

    def read(t: Column) -> Column:
        t = F.lower(F.when(F.contains(t, F.lit(":")), F.regexp_replace(t, _TIME, "")).otherwise(t))
        plain = lambda t: _let(numbers(t), lambda n: F.coalesce(dated(n, day_first), dated(n, not day_first)))
        found = _let(t, lambda t: F.when(t.rlike("[a-z]"), named(t).try_cast("date")).otherwise(plain(t)))
        return _let(found, lambda d: F.when(F.year(d).between(FIRST_YEAR, LAST_YEAR), d.cast("string")))

    return cleaned(c, lambda t: F.coalesce(read(t), t))


#: Fixes by the words that name them, in order of precedence.
FIXES = (
    ("E.164", normalise_phone),
    ("casing", title_case),
    ("email", normalise_email),
    ("ISO 8601", standardise_date),
    ("abbreviation", expand_address),
)


def apply_fix(df: DataFrame, column: str, fix: str) -> DataFrame:
    """Apply the first fix whose name `fix` holds; a fix of no known name changes nothing."""
    for name, function in FIXES:
        if name.lower() in fix.lower():
            return df.withColumn(column, function(F.col(column)))
    return df


def apply_fixes(df: DataFrame, fixes: list[tuple[str, str]]) -> DataFrame:
    """Fixes (column, fix) in order; columns that are not there are passed over."""
    for column, fix in fixes:
        if column in df.columns:
            df = apply_fix(df, column, fix)
    return df


def changed_cells(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """field, changed: how many cells differ as text, of columns in which any does; null to "" is a change."""
    columns = [c for c in before.columns if c != key and c in after.columns]
    both = before.select(key, *[F.col(c).cast("string").alias(f"a{i}") for i, c in enumerate(columns)]).join(after.select(key, *[F.col(c).cast("string").alias(f"b{i}") for i, c in enumerate(columns)]), key)
    sums = both.agg(*[F.count_if(~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))).alias(f"n{i}") for i in range(len(columns))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"n{i}").alias("changed")) for i, c in enumerate(columns)]))
    return sums.select(rows.alias("r")).select("r.field", "r.changed").where("changed > 0")


def available_cleansers() -> dict[str, bool]:
    return {name: find_spec(name) is not None for name in ("phonenumbers", "email_validator", "usaddress", "nameparser")}
