"""Identifiers: DOI, ISBN, ISSN and ORCID as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.basics import blank, digit_sum, let, let_both


def raw_doi(value: Column) -> Column:
    """Trimmed, without a resolver's address."""
    return F.regexp_replace(F.trim(blank(value)), r"(?i)^https?://(?:dx\.)?doi\.org/", "")


def normalized_doi(value: Column) -> Column:
    return F.lower(raw_doi(value))


def doi_in(value: Column) -> Column:
    """The first DOI in a text, without closing punctuation; empty if none."""
    found = F.regexp_extract(raw_doi(value), r"\b(10\.\d{4,9}/[^\s\"<>]+)", 1)
    return F.regexp_replace(found, r"[.,;:)\]}>'\"]+$", "")


def doi_from_url(value: Column) -> Column:
    """A DOI within an address, without a file ending."""
    found = F.regexp_extract(blank(value), r"(?i)\b(10\.\d{4,9}/[^\s\"'<>?&#]+)", 1)
    return F.regexp_replace(found, r"(?i)\.(?:pdf|html?|xml|full|abstract|epub)$", "")


def doi_boundary_ambiguous(value: Column) -> Column:
    """Whether it is unclear where a DOI ends: closing punctuation, or parentheses that don't pair."""
    raw = raw_doi(value)
    return raw.rlike(r"[.,;:]$") | (F.regexp_count(raw, F.lit(r"\(")) != F.regexp_count(raw, F.lit(r"\)")))


def _agreement(page: Column, record: Column, unclear: Column) -> Column:
    def of(p: Column, r: Column) -> Column:
        return F.when((p == "") | (r == ""), "missing").when(p == r, "exact").when(unclear, "ambiguous").otherwise("differs")

    return let_both(page, record, of)


def compare_doi(on_page: Column, in_record: Column) -> Column:
    """exact, differs, ambiguous or missing."""
    unclear = doi_boundary_ambiguous(on_page) | doi_boundary_ambiguous(in_record)
    return _agreement(normalized_doi(on_page), normalized_doi(in_record), unclear)


def same_doi(a: Column, b: Column) -> Column:
    return (normalized_doi(a) != "") & (normalized_doi(a) == normalized_doi(b))


def container_doi(own: Column, printed: Column) -> Column:
    """The whole's DOI where the part's is that with a short suffix; else null."""
    part, whole = normalized_doi(own), normalized_doi(printed)
    suffix = F.substring(part, F.char_length(whole) + 1, F.char_length(part))
    return F.when((whole != "") & part.startswith(F.concat(whole, F.lit("_"))) & suffix.rlike(r"^_[\w.-]{1,12}$"), whole)


def normalized_isbn(value: Column) -> Column:
    """Thirteen digits where ten or thirteen are given, else what digits there are."""

    def widen(digits: Column) -> Column:
        body = F.concat(F.lit("978"), F.substring(digits, 1, 9))
        odd_even = digit_sum(body, 12, lambda i: F.when(i % 2 == 1, 1).otherwise(3))
        return F.when(F.char_length(digits) == 10, F.concat(body, ((10 - odd_even % 10) % 10).cast("string"))).otherwise(digits)

    return let(F.regexp_replace(F.upper(blank(value)), "[^0-9X]", ""), widen)


def valid_isbn(value: Column) -> Column:
    """The digits if their check digit is right, else empty."""

    def checked(digits: Column) -> Column:
        ten = digit_sum(digits, 10, lambda i: 11 - i) % 11 == 0
        thirteen = digit_sum(digits, 13, lambda i: F.when(i % 2 == 1, 1).otherwise(3)) % 10 == 0
        good = (digits.rlike(r"^\d{9}[\dX]$") & ten) | (digits.rlike(r"^97[89]\d{10}$") & thirteen)
        return F.when(good, digits).otherwise("")

    return let(F.upper(F.regexp_replace(blank(value), r"[\s-]", "")), checked)


def compare_isbn(on_page: Column, in_record: Column) -> Column:
    return _agreement(normalized_isbn(on_page), normalized_isbn(in_record), F.lit(False))


def valid_issn(value: Column) -> Column:
    """NNNN-NNNC if the check digit is right, else empty."""

    def checked(digits: Column) -> Column:
        check = (11 - digit_sum(digits, 7, lambda i: 9 - i) % 11) % 11
        letter = F.when(check == 10, "X").otherwise(check.cast("string"))
        good = digits.rlike(r"^\d{7}[\dX]$") & (F.substring(digits, 8, 1) == letter)
        return F.when(good, F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 4))).otherwise("")

    return let(F.upper(F.regexp_replace(blank(value), r"[^\dXx]", "")), checked)


def valid_orcid(value: Column) -> Column:
    """The identifier if its check digit (ISO 7064 mod 11-2) is right, else empty."""

    def checked(text: Column) -> Column:
        digits = F.regexp_replace(text, "-", "")
        total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0).cast("long"), lambda n, i: (n + F.coalesce(F.substring(digits, i, 1).try_cast("long"), F.lit(0).cast("long"))) * 2)
        result = (12 - total % 11) % 11
        letter = F.when(result == 10, "X").otherwise(result.cast("string"))
        good = text.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$") & (F.substring(digits, 16, 1) == letter)
        return F.when(good, text).otherwise("")

    return let(F.upper(F.trim(blank(value))), checked)


def merged_identifiers(stored: Column, read: Column) -> Column:
    """The union of two separated lists, by digits alone; the first spelling of each stays."""
    items = F.filter(F.split(F.concat_ws(" ", stored, read), r"[\s,;/|]+"), lambda x: x != "")
    key = lambda x: F.regexp_replace(F.upper(x), "[^0-9X]", "")
    kept = F.aggregate(items, F.array().cast("array<string>"), lambda got, x: F.when(F.exists(got, lambda g: key(g) == key(x)), got).otherwise(F.concat(got, F.array(x))))
    return F.array_join(kept, " ")
