"""Fixed patterns, word lists and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: format patterns
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^[\+]?[1-9]?[0-9]{7,15}$"
URL = r"^https?://[^\s/$.?#].[^\s]*$"
DATE = r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"
CREDIT_CARD = r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$"
SSN = r"^\d{3}-\d{2}-\d{4}$"
ZIP_CODE = r"^\d{5}(-\d{4})?$"
TEXT_PATTERNS = {
    "email": EMAIL,
    "phone": PHONE,
    "url": URL,
    "numeric": r"^\d+$",
    "alphanumeric": r"^[a-zA-Z0-9]+$",
    "starts_with_special": r"^[^a-zA-Z0-9\s]",
    "contains_special": r"[^a-zA-Z0-9\s]",
}
FORMAT_PATTERNS = {
    "email": EMAIL, "phone": PHONE, "url": URL, "date": DATE, "credit_card": CREDIT_CARD,
    "ssn": SSN, "zip_code": ZIP_CODE,
}
# fixed values: words read as booleans
TRUE_WORDS = ["true", "1", "yes", "t", "y"]
FALSE_WORDS = ["false", "0", "no", "f", "n"]
# fixed values: keywords of critical columns
BUSINESS_KEYWORDS = ["age", "salary", "income", "price", "cost", "revenue"]
IDENTITY_KEYWORDS = ["name", "email", "id", "key"]

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def to_number(c: Column) -> Column:
    """Double for numeric text, NULL otherwise (Java suffixes such as '1d' are not numbers)."""
    return F.when(is_number(c), F.trim(c).cast("double"))


def to_datetime(c: Column, formats: list[str] | None = None) -> Column:
    """First of ISO and the given formats that parses, else NULL."""
    tries = [c.try_cast("timestamp")] + [F.try_to_timestamp(c, F.lit(f)) for f in (formats or ["M/d/yyyy"])]
    return F.coalesce(*tries)


def to_boolean(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(TRUE_WORDS), True).when(low.isin(FALSE_WORDS), False)


def shape(c: Column, compat: bool = False) -> Column:
    """Letters -> A, digits -> N. ``compat`` replaces digits first, so both end up as A."""
    if compat:
        return F.regexp_replace(F.regexp_replace(c, r"\d", "N"), "[a-zA-Z]", "A")
    return F.regexp_replace(F.regexp_replace(c, "[a-zA-Z]", "A"), r"\d", "N")
