"""Numbers, units and dates as Columns: what cannot be read becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor to the dimension's base unit (power in cv, torque in Nm, length in mm, volume in litres).
UNITS = {
    "power": {"cv": 1.0, "ps": 1.0, "hp": 1.0139, "bhp": 1.0139, "kw": 1.3596},
    "torque": {"nm": 1.0, "n.m": 1.0, "kgfm": 9.80665, "kgf.m": 9.80665, "kgm": 9.80665, "mkgf": 9.80665, "m.kgf": 9.80665, "lb-ft": 1.3558, "lbft": 1.3558, "lb.ft": 1.3558, "lbf.ft": 1.3558},
    "length": {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4, "pol": 25.4},
    "volume": {"l": 1.0, "lt": 1.0, "ml": 0.001, "cc": 0.001, "cm3": 0.001, "gal": 3.785411784},
}
#: Digits after the point that a converted value keeps.
DIGITS = {"power": 0, "torque": 0, "length": 0, "volume": 3}
#: Month names of locale dates.
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
YES = ["sim", "yes", "true", "1", "s", "y"]
NO = ["nao", "não", "no", "false", "0", "n"]

#: A number: grouped by points, with a decimal comma, with a decimal point, or plain; and the points that group. Each step
#: of the reading names the one before once, so an expression for the text is worked out once wherever it stands.
_NUMBER = r"-?[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?(?![0-9])|-?[0-9]+,[0-9]+|-?[0-9]+\.[0-9]+|-?[0-9]+"
_THOUSANDS = r"\.(?=[0-9]{3}[.,])|(?<=\.[0-9]{3})\.|(?<=^-[0-9]{1,2}|^[0-9]{1,3})\.(?=[0-9]{3}$)"


def cents(x: Column) -> Column:
    """Two digits by plain arithmetic, the same in every engine: floor(100 x + 1/2) / 100."""
    return F.floor(x * 100 + 0.5) / F.lit(100.0)


def parse_number(text: Column) -> Column:
    """double: the first number of a text in the locale 1.234,5. A point with exactly three digits after at most
    three separates thousands, any other point is a decimal one; no number: null."""
    num = F.regexp_extract(F.translate(text, " ", ""), _NUMBER, 0)
    return F.translate(F.regexp_replace(num, _THOUSANDS, ""), ",", ".").try_cast("double")


def unit_slug(unit: Column) -> Column:
    return F.translate(F.lower(F.trim(unit)), "áéíóúãõâêôç _·", "aeiouaoaeoc  .").try_cast("string")


def convert(value: Column, unit: Column, dimension: str) -> Column:
    """value in the dimension's base unit, half-even rounded; an unknown unit gives null. Lengths of 100 'm' and
    more are millimetres already."""
    slug = F.regexp_replace(unit_slug(unit), " ", "")
    factor = F.lit(None).cast("double")
    for name, f in UNITS[dimension].items():
        factor = F.when(slug == name, F.lit(f)).otherwise(factor)
    if dimension == "length":
        factor = F.when((slug == "m") & (value >= 100), F.lit(1.0)).otherwise(factor)
    return F.bround(value * factor, DIGITS[dimension])


def parse_price(text: Column) -> Column:
    """bigint: whole currency units of a price with its currency words."""
    return F.bround(parse_number(F.regexp_replace(F.lower(text), r"r\$|reais|brl", "")), 0).cast("bigint")


def cylinders(text: Column) -> Column:
    """double: the one- or two-digit count of a text such as V6 or '4 em linha'."""
    return F.nullif(F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{1,2})(?:[^0-9]|$)", 1), F.lit("")).try_cast("double")


def parse_flag(text: Column) -> Column:
    """boolean: yes and no words; any other text counts as presence; null and blank are null."""
    word = F.lower(F.trim(text))
    return F.when(word.isNull() | (word == ""), F.lit(None)).when(word.isin(YES), F.lit(True)).when(word.isin(NO), F.lit(False)).otherwise(word.isNotNull())


def tyre(text: Column) -> Column:
    """struct(width, profile, rim) of a text such as 285/70 R17; null where there is none."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"([0-9]{3})/([0-9]{2}) ?[Rr]([0-9]{2})", i), F.lit("")).try_cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("width"), part(2).alias("profile"), part(3).alias("rim")))


def close(expected: Column, got: Column, tol_abs: Column, tol_rel: Column) -> Column:
    """Whether two numbers agree within the absolute or the relative tolerance; exact if both are null."""
    gap = F.abs(got - expected)
    exact = tol_abs.isNull() & tol_rel.isNull() & (gap == 0)
    return exact | F.coalesce(gap <= tol_abs, F.lit(False)) | F.coalesce(gap <= tol_rel * F.abs(expected), F.lit(False))


def within_pct(value: Column, reference: Column, pct: Column | float) -> Column:
    return F.when(reference != 0, F.abs(value - reference) / F.abs(reference) * 100 <= pct)


def change_pct(before: Column, after: Column) -> Column:
    """Change in per cent of the size of before, two digits; null for a zero base."""
    return F.round(100 * (after - before) / F.abs(F.nullif(before, F.lit(0.0))), 2)


#: Confidence of a value by its source's tier, from the first on.
TIERS = [0.90, 0.85, 0.60, 0.40, 0.20]


def confidence(tier: Column, independent: Column, divergent: Column) -> Column:
    """Base by the best tier (beyond the last tier the last one's), 0.05 more for each further independent source; at most 0.6 from tier 3 on, 1 at most.
    Divergence earns no bonus."""
    base = F.element_at(F.array(*map(F.lit, TIERS)), F.greatest(F.lit(1), F.least(F.lit(len(TIERS)), tier.cast("int"))))
    raised = base + 0.05 * F.greatest(independent - 1, F.lit(0))
    raised = F.when(tier >= 3, F.least(raised, F.lit(0.6))).otherwise(raised)
    return F.round(F.when(divergent, base).otherwise(F.least(raised, F.lit(1.0))), 4)


def combined_consumption(urban: Column, highway: Column) -> Column:
    return F.round(urban * 0.55 + highway * 0.45, 2)


def iso_date(text: Column) -> Column:
    """yyyy-MM-dd of an ISO or day/month/year date, yyyy-MM of a month's name and year; else null. Days that the
    calendar does not have are null too."""
    t = F.lower(F.trim(text))
    iso = F.nullif(F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))
    pick = lambda i: F.regexp_extract(t, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", i)
    local = F.when(pick(3) != "", F.concat_ws("-", pick(3), F.lpad(pick(2), 2, "0"), F.lpad(pick(1), 2, "0")))
    day = F.date_format(F.try_to_date(F.coalesce(iso, local), "yyyy-MM-dd"), "yyyy-MM-dd")
    named = lambda i: F.regexp_extract(t, r"^([a-zç]+)(?: de |/| )([0-9]{4})$", i)
    at = F.array_position(F.array(*map(F.lit, MONTHS)), named(1))
    return F.coalesce(day, F.when(at > 0, F.concat(named(2), F.lit("-"), F.lpad(at.cast("string"), 2, "0"))))


def display_date(iso: Column) -> Column:
    """dd/mm/yyyy of an ISO date, mm/yyyy of a month; any other text as it is."""
    day = F.date_format(F.try_to_date(F.when(iso.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), iso), "yyyy-MM-dd"), "dd/MM/yyyy")
    month = F.when(iso.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.concat(F.substring(iso, 6, 2), F.lit("/"), F.substring(iso, 1, 4)))
    return F.coalesce(day, month, iso)


def split_year(text: Column) -> Column:
    """struct(rest, year): the last year from 1950 to 2049 that stands alone, taken out of the text; null without one."""
    year = r"(?:19[5-9]|20[0-4])[0-9](?![0-9])"
    found = F.regexp_extract_all(text, F.lit(rf"(?:^|[^0-9])({year})"), F.lit(1))
    rest = F.regexp_replace(text, rf"(?s)^(.*[^0-9]|){year}", "$1")
    return F.struct(F.trim(F.regexp_replace(rest, " +", " ")).alias("rest"), F.try_element_at(found, F.lit(-1)).cast("int").alias("year"))


def age_days(then: Column, now: Column) -> Column:
    """Whole periods of 24 hours between two timestamps, at least 0."""
    return F.greatest(F.lit(0), F.floor((now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")) / 86400)).cast("bigint")


def year_in_path(url: Column) -> Column:
    """The largest year from 1990 to 2099 in a url's path; its query doesn't count."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    years = F.transform(F.regexp_extract_all(path, F.lit(r"/((?:199|20[0-9])[0-9])(?:/|$|[^0-9])"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_max(years)


def whole_tokens(text: Column) -> Column:
    """array<string>: the runs of digits with . , / inside them, without trailing marks."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9.,/]*"), F.lit(0)), lambda n: F.regexp_replace(n, r"[.,/]+$", ""))


def precision_note(field: Column, quote: Column) -> Column:
    """A caveat where a field in millimetres rests on a quote in metres: its decimals bound what is known; else ''."""
    decimals = F.length(F.regexp_extract(quote, r"\b[0-9]+[,.]([0-9]{1,2}) *m\b", 1))
    note = F.concat(F.lit("given in metres with "), decimals.cast("string"), F.lit(" decimal(s); millimetres add no precision"))
    return F.when(F.endswith(field, F.lit("_mm")) & (decimals > 0), note).otherwise("")
