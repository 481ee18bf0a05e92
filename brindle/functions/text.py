"""Column expressions for text normalisation. All run inside generated code; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of ideographs, web and e-mail addresses.
CJK = "[一-鿿]"
URL = r"https?://\S+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def ustrip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"^(?U:\s)+|(?U:\s)+$", "")


def filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def without_urls(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, URL, by)


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def language(c: Column) -> Column:
    return F.when(has_cjk(c), "cn").otherwise("en")


def dedup_form(c: Column) -> Column:
    """Lower case without web addresses; everything but word characters is one space."""
    words = F.regexp_replace(F.lower(without_urls(c, "")), r"(?U)[^\w一-鿿]+", " ")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def keywords(c: Column) -> Column:
    """Items of a '|' list, stripped, without blanks, in order."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), ustrip), lambda x: x != "")


def latin_pattern(keyword: Column, ignore_case: bool = True) -> Column:
    """Pattern of a whole-word match: no ASCII letter or digit on either side."""
    return F.concat(F.lit("(?iu)" if ignore_case else ""), F.lit(r"(?<![A-Za-z0-9])\Q"), keyword, F.lit(r"\E(?![A-Za-z0-9])"))


def contains_keyword(text: Column, keyword: Column) -> Column:
    """Ideographic keywords match as substrings, others as whole words, both without regard to case."""
    return F.when(has_cjk(keyword), F.contains(F.lower(text), F.lower(keyword))).otherwise(F.rlike(text, latin_pattern(keyword)))


def sanitise(text: Column, numeric_tickers: list[str] = (), handles: Column | None = None) -> Column:
    """Web addresses, e-mail addresses, user handles and long numbers as placeholders.

    `handles` maps a registered handle (lower case) to a company name, which stands for it; registered numeric tickers stay.
    """
    c = F.regexp_replace(without_urls(text, " [URL] "), EMAIL, " [EMAIL] ")
    parts = F.split(c, r"(?U)(?=@\w{2,})")

    def one(p: Column) -> Column:
        handle = F.lower(F.regexp_extract(p, r"(?U)^@(\w{2,})", 1))
        name = F.coalesce(F.element_at(handles, handle), F.lit("[HANDLE]")) if handles is not None else F.lit("[HANDLE]")
        return F.when(handle == "", p).otherwise(F.concat(name, F.regexp_replace(p, r"(?U)^@\w{2,}", "")))

    c = F.array_join(F.transform(parts, one), "")
    keep = rf"(?!(?:{'|'.join(sorted(numeric_tickers))})\b)" if numeric_tickers else ""
    return F.regexp_replace(c, rf"(?U)(?<!\$)\b{keep}\d{{6,}}\b", "[ID]")


def to_iso(millis: Column) -> Column:
    """ISO time in UTC of epoch milliseconds; '' for null and 0."""
    return F.when(F.coalesce(millis, F.lit(0)) == 0, F.lit("")).otherwise(F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss"))


def guarded(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))
