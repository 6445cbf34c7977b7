"""Scalar rules of names, identifiers, dates, money and text as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
HONORIFICS = ("shri", "smt", "mr", "mrs", "ms", "dr", "sh", "md", "mohd")
MORE_HONORIFICS = ("kumari", "km")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: What else a month may be written as.
MORE_MONTHS = {
    "jan": ("january",), "feb": ("february",), "mar": ("march",), "apr": ("april",), "may": (), "jun": ("june",),
    "jul": ("july",), "aug": ("august",), "sep": ("september", "sept"), "oct": ("october",), "nov": ("november",), "dec": ("december",),
}
IST = "Asia/Kolkata"
SNIPPET = 240

_PUNCTUATION = "[.,;:\"']"


def _collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(name: Column) -> Column:
    """One leading honorific and punctuation off, blanks collapsed, lower case."""
    bare = F.regexp_replace(F.trim(name), rf"(?i)^({'|'.join(HONORIFICS)})\.?\s+", "")
    return F.lower(_collapsed(F.regexp_replace(bare, _PUNCTUATION, "")))


def normalize_identifier(value: Column) -> Column:
    """Separators off, upper case; any 12 characters that start with 91 lose it."""
    bare = F.upper(F.regexp_replace(value, r"[ \-+()]", ""))
    return F.when((F.length(bare) == 12) & bare.startswith("91"), F.substring(bare, 3, 10)).otherwise(bare)


def normalize_phone(value: Column) -> Column:
    """Digits only; a country code or a leading 0 before ten digits goes."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    long = (F.length(digits) == 12) & digits.startswith("91")
    trunk = (F.length(digits) == 11) & digits.startswith("0")
    return F.when(long, F.substring(digits, 3, 10)).when(trunk, F.substring(digits, 2, 10)).otherwise(digits)


def normalize_account(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"[ \-./]", ""))


def identifier_type(value: Column) -> Column:
    """PHONE for ten digits from 6 to 9 on, else ACCOUNT."""
    return F.when(F.regexp_replace(value, "[^0-9]", "").rlike("^[6-9][0-9]{9}$"), "PHONE").otherwise("ACCOUNT")


def legacy_identifier_type(value: Column) -> Column:
    return F.when(normalize_identifier(value).rlike("^[0-9]{10}$"), "PHONE").otherwise("BANK_ACCOUNT")


def identifier_key(kind: Column, value: Column) -> Column:
    """PHONE:... or ACCOUNT:..., null for an empty value or an unknown kind."""
    norm = F.when(kind == "PHONE", normalize_phone(value)).when(kind == "ACCOUNT", normalize_account(value))
    return F.when(norm != "", F.concat_ws(":", kind, norm))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which no built-in function offers."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def name_tokens(name: Column) -> Column:
    """Sorted words of a name in compatibility form, without honorific and without punctuation at their ends; repeats are kept.

    Only names with characters beyond ASCII go through the Arrow kernel.
    """
    words = "|".join((*HONORIFICS, *MORE_HONORIFICS))
    composed = F.coalesce(nfkc(F.when(name.rlike(r"[^\x00-\x7F]"), name)), name)
    bare = F.regexp_replace(F.lower(F.trim(composed)), rf"^({words})\.?\s+", "")
    ends = "[.,;:\"'()\\[\\]]+"
    return F.array_sort(F.filter(F.transform(F.split(bare, r"\s+"), lambda w: F.regexp_replace(w, f"^{ends}|{ends}$", "")), lambda w: w != ""))


def valid_case_code(code: Column) -> Column:
    """1 to 40 letters, digits, _ . - beginning with a letter or digit."""
    return code.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.\-]{0,39}$")


def case_of(person: Column) -> Column:
    """The case of a person key."""
    return F.split(person, ":", 3)[1]


def name_of(person: Column) -> Column:
    """The name tokens of a person key."""
    return F.split(person, ":", 3)[2]


def person_key(case: Column, name: Column) -> Column:
    """P:<case>:<sorted name tokens>, null without tokens or with an invalid case code."""
    tokens = name_tokens(name)
    return F.when((F.size(tokens) > 0) & valid_case_code(case), F.concat(F.lit("P:"), case, F.lit(":"), F.array_join(tokens, " ")))


def short_hash(size: int, *parts: Column) -> Column:
    """First hex digits of the SHA-256 of parts joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, size)


def wording(text: Column) -> Column:
    """Lower case, everything that is no letter, digit or underscore of any script as a blank, blanks collapsed."""
    return _collapsed(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def snippet(text: Column, size: int = SNIPPET) -> Column:
    flat = _collapsed(text)
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size - 1), F.lit("…"))).otherwise(flat)


def parse_moment(text: Column) -> Column:
    """A UTC instant: ISO text with its offset, or ISO or d/m/Y text read as Indian time; else null."""
    t = F.trim(text)
    offset = t.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    naive = F.coalesce(
        F.try_to_timestamp(F.regexp_replace(t, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.regexp_replace(t, "T", " "), F.lit("yyyy-MM-dd HH:mm")),
        F.try_to_timestamp(t, F.lit("dd/MM/yyyy HH:mm:ss")), F.try_to_timestamp(t, F.lit("dd/MM/yyyy HH:mm")),
        F.try_to_timestamp(t, F.lit("dd-MM-yyyy HH:mm:ss")), F.try_to_timestamp(t, F.lit("dd-MM-yyyy HH:mm")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")),
    )
    return F.when(offset, F.try_to_timestamp(t)).otherwise(F.to_utc_timestamp(naive, IST))


def parse_day(text: Column) -> Column:
    """Midnight in India of a stated day, as a UTC instant; else null."""
    t = F.trim(text)
    day = F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy")))
    return F.to_utc_timestamp(day, IST)


# The three ways that a date may be written.
ISO_DATE = r"\b(20\d{2}-\d{2}-\d{2})\b"
NUMBER_DATE = r"\b(\d{1,2}[./]\d{1,2}[./]20\d{2})\b"
WORDED_DATE = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s+(20\d{2})\b"


def _worded_day(found: Column) -> Column:
    name = F.lower(F.regexp_extract(found, WORDED_DATE, 2))
    month = F.coalesce(*[F.when(name.isin(m, *MORE_MONTHS[m]), F.lit(str(i))) for i, m in enumerate(MONTHS, 1)])
    return F.try_to_date(F.concat_ws("/", F.regexp_extract(found, WORDED_DATE, 1), F.coalesce(month, F.lit("0")), F.regexp_extract(found, WORDED_DATE, 3)), "d/M/yyyy")


def first_date(text: Column) -> Column:
    """The valid date that stands earliest in a text: 2026-05-12, 12/5/2026, 12.5.2026 or 12th May 2026."""
    ways = (
        (ISO_DATE, lambda m: F.try_to_date(m, "yyyy-MM-dd")),
        (NUMBER_DATE, lambda m: F.try_to_date(F.translate(m, ".", "/"), "d/M/yyyy")),
        (WORDED_DATE, _worded_day),
    )
    options = []
    for pattern, day in ways:
        found = F.get(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: day(m).isNotNull()), F.lit(0))  # noqa: B023
        options.append(F.when(found.isNotNull(), F.struct(F.position(found, text).alias("at"), day(found).alias("day"))))
    return F.array_min(F.array_compact(F.array(*options))).getField("day")


def ist_day(stamp: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(stamp, IST))


def money_text(amount: Column) -> Column:
    return F.format_number(amount, 0)


def score_text(z: Column) -> Column:
    return F.when(z < 100, F.format_number(z, 1)).otherwise("above 100")


def indian_grouping(amount: Column) -> Column:
    """Whole rupees grouped 12,34,567."""
    digits = F.abs(amount).cast("long").cast("string")
    grouped = F.regexp_replace(digits, r"(\d)(?=(\d\d)+\d$)", "$1,")
    return F.concat(F.when(amount < 0, "-").otherwise(""), grouped)


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * (1 - indel distance / total length), by a bit-parallel longest common subsequence."""
    return pd.Series([_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def _ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    if not total:
        return 100.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 100.0 * 2 * common / total


def token_sort(name: Column) -> Column:
    """Words of a name in order, repeats kept."""
    return F.array_join(F.array_sort(F.split(normalize_name(name), " ")), " ")


def maybe_similar(a: Column, b: Column, threshold: float = 95) -> Column:
    """A cheap test that every pair at or above the indel threshold passes: lengths that are close enough."""
    return F.abs(F.length(a) - F.length(b)) * 100 <= (F.length(a) + F.length(b)) * (100 - threshold)
