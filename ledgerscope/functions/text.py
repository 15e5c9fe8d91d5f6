"""Column expressions for demographic clean-up, birth dates and age bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope import reference_data as rd

# What counts as surrounding white space when a value is
# stripped (the characters Python's ``str.strip()`` removes).
WHITESPACE = (r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029"
              r"\u202f\u205f\u3000]")


def strip(c: Column) -> Column:
    """Remove leading and trailing white space, tabs and newlines included."""
    return F.regexp_replace(c, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def apply_aliases(c: Column, aliases: dict[str, str]) -> Column:
    """Whole-value replacement; values not in ``aliases`` pass unchanged."""
    out = None
    for src, dst in aliases.items():
        if src == dst:
            continue
        out = (F.when(c == src, F.lit(dst)) if out is None
               else out.when(c == src, F.lit(dst)))
    return c if out is None else out.otherwise(c)


def clean_label(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Strip, lower-case, then map aliases (NULL stays NULL)."""
    out = F.lower(strip(c))
    return apply_aliases(out, aliases) if aliases else out


_MONTHS = ("Jan(?:uary)?", "Feb(?:ruary)?", "Mar(?:ch)?", "Apr(?:il)?", "May", "June?", "July?", "Aug(?:ust)?",
           "Sep(?:tember)?", "Oct(?:ober)?", "Nov(?:ember)?", "Dec(?:ember)?")
_NAME = f"({'|'.join(_MONTHS)})"
#: Spellings of a date besides ISO, each with the replacement that makes year, month and day of it. No text has two of them.
_SPELLINGS = (
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1"),
    (rf"(?i)^{_NAME} (\d{{1,2}}), (\d{{4}})$", "$3-$1-$2"),
    (rf"(?i)^(\d{{1,2}}) {_NAME} (\d{{4}})$", "$3-$2-$1"),
)
#: Two numbers and a year, with slashes or hyphens: either may be the day.
_TWO_NUMBERS = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$"


def _numbered_month(text: Column) -> Column:
    """``text`` with the name of its month as a number."""
    place = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.regexp_extract(text, r"([A-Za-z]{3})", 1)))
    number = ((place + 2) / 3).cast("int").cast("string")
    return F.when(text.rlike("[A-Za-z]"), F.regexp_replace(text, "[A-Za-z]+", number)).otherwise(text)


def _once(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once and not copied into each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbers(bare: Column) -> tuple[Column, Column]:
    return tuple(F.regexp_extract(bare, _TWO_NUMBERS, i).try_cast("int") for i in (1, 3))


def day_first_votes(c: Column) -> Column:
    """+1 where a date of two numbers and a year can only have its day first, -1 where only its month, else 0.

    One match a sign on the text as it is: every row of the column votes, and few of them are such dates.
    """
    bare, space = c.cast("string"), f"{WHITESPACE}*"
    over, upto = r"(?:1[3-9]|[2-9]\d)", r"(?:0?\d|1[0-2])"  # over 12; at most 12
    return (F.when(bare.rlike(rf"^{space}{over}([/-]){upto}\1\d{{4}}{space}$"), 1)
            .when(bare.rlike(rf"^{space}{upto}([/-]){over}\1\d{{4}}{space}$"), -1).otherwise(0))


def birth_date(c: Column, day_first: Column | bool = False) -> Column:
    """Lenient date parse; text that is no date becomes NULL, not an error.

    The text's spelling rewrites it as year-month-day, and that is parsed once.  Of two numbers and a year one
    over 12 is the day; where both may be, ``day_first`` says (the column's vote, ``day_first_votes``).
    """
    if not isinstance(day_first, bool):
        return F.when(day_first, birth_date(c, True)).otherwise(birth_date(c, False))

    def rewritten(bare: Column) -> Column:
        first, second = _numbers(bare)
        day_leads = (first > 12) | (second <= 12) if day_first else first > 12
        plain = F.when(bare.rlike(_TWO_NUMBERS), F.when(day_leads, F.regexp_replace(bare, _TWO_NUMBERS, "$4-$3-$1"))
                       .otherwise(F.regexp_replace(bare, _TWO_NUMBERS, "$4-$1-$3")))
        for pattern, made in _SPELLINGS:
            spelled = F.regexp_replace(bare, pattern, made)
            plain = plain.when(bare.rlike(pattern), _numbered_month(spelled) if _NAME in pattern else spelled)
        return plain.otherwise(bare)

    return _once(strip(c.cast("string")), rewritten).try_cast("date")


def age_on(dob: Column, as_of) -> Column:
    """Calendar-year difference (birthdays ignored), as the source computes it."""
    return F.year(F.lit(as_of)) - F.year(dob)


def age_bin(age: Column) -> Column:
    """Index of the left-closed 5-year bin from 18; NULL outside [18, 78)."""
    lo = rd.AGE_BIN_FIRST
    hi = rd.AGE_BIN_FIRST + rd.AGE_BIN_WIDTH * rd.AGE_BIN_COUNT
    return F.when((age >= lo) & (age < hi),
                  F.floor((age - lo) / rd.AGE_BIN_WIDTH).cast("int"))


def age_group_label(age: Column) -> Column:
    """``[lo, hi)`` text of the bin holding ``age``; NULL outside the bins."""
    b = age_bin(age)
    lo = F.lit(rd.AGE_BIN_FIRST) + b * rd.AGE_BIN_WIDTH
    return F.concat(F.lit("["), lo.cast("string"), F.lit(", "),
                    (lo + rd.AGE_BIN_WIDTH).cast("string"), F.lit(")"))
