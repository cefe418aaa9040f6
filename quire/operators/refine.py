"""Printed identifiers against stored ones, fuller forms of values, and texts that serve as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import dates, identifiers
from quire.functions.basics import blank, let_both
from quire.functions.people import letters

#: Lengths of a query, fragments in a row that make a page degraded, fields of dates.
SHORTEST, LONGEST, TITLE_SIZED, FRAGMENTS = 4, 200, 12, 4
DATES = ("date", "filingDate", "issueDate")


def identifier_sets(rows: DataFrame, found: str) -> DataFrame:
    """Counts of rows by the identifiers that they print (``found``: array of kind, value, confidence)."""
    dois, isbns = F.filter(found, lambda x: x["kind"] == "doi"), F.filter(found, lambda x: x["kind"] == "isbn")
    d, i = F.size(dois) > 0, F.size(isbns) > 0
    sure = lambda level: F.exists(dois, lambda x: x["confidence"] == level)
    parts = {"doi_only": d & ~i, "isbn_only": i & ~d, "both": d & i, "neither": ~d & ~i, "ambiguous": sure("ambiguous"), "repaired": sure("repaired"), "multiple": F.size(dois) > 1}
    return rows.agg(*(F.count_if(c).alias(n) for n, c in parts.items()))


def printed_outcomes(rows: DataFrame, found: str, stored: str) -> DataFrame:
    """Rows that print a DOI by how it agrees with the stored one, with how many agree only after a repair."""
    dois = F.filter(found, lambda x: x["kind"] == "doi")
    usable = F.filter(dois, lambda x: x["confidence"] != "ambiguous")
    held = identifiers.normalized_doi(F.col(stored))
    agreeing = F.filter(usable, lambda x: x["value"] == held)
    outcome = F.when(held == "", "noRecord").when(F.size(usable) == 0, "heldAmbiguous").when(F.size(agreeing) > 0, "exact").otherwise("differs")
    repaired = (outcome == "exact") & F.exists(agreeing, lambda x: x["confidence"] == "repaired")
    return rows.where(F.size(dois) > 0).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count_if(repaired).alias("repaired"))


def is_degraded(text: Column) -> Column:
    """Whether a text has four words of one or two Latin letters in a row, as broken spacing leaves them."""
    marks = F.transform(F.split(blank(text), r"\s+"), lambda w: F.when(w.rlike("^[A-Za-z]{1,2}$"), "f").otherwise("-"))
    return F.contains(F.array_join(marks, ""), F.lit("f" * FRAGMENTS))


def is_askable(text: Column, web: bool = False) -> Column:
    """Whether a text serves as a query: 4 to 200 characters and no prose; on the web two words, or one of a title's size."""
    n = F.char_length(F.trim(blank(text)))
    fits = n.between(SHORTEST, LONGEST) & (F.regexp_count(blank(text), F.lit(r"[.!?]\s+[A-Z]")) < 2)
    return fits & ((F.regexp_count(blank(text), F.lit(r"[\p{L}\p{N}]{2,}")) >= 2) | (n >= TITLE_SIZED)) if web else fits


def refined(field: Column, read: Column, stated: Column) -> Column:
    """The stated value where it is a fuller form of the one that was read; else null.

    A date that goes on with more, a range that opens at the page, a spelling with marks or not in capitals alone.
    """
    dated = let_both(dates.canonical_date(read), dates.canonical_date(stated), lambda a, b: F.when((F.char_length(b) > F.char_length(a)) & b.startswith(a), b))
    dash = F.regexp_replace(blank(stated), r"\s*[-–—~]\s*", "-")
    first, last = F.regexp_extract(dash, r"^([A-Za-z]?\d{1,6})-", 1), F.regexp_extract(dash, r"-([A-Za-z]?\d{1,6})$", 1)
    number = lambda c: F.regexp_replace(c, r"\D", "").try_cast("int")
    opened = F.when((first != "") & (first == F.trim(blank(read))) & (number(last) > number(first)), dash)
    shouting = lambda c: (F.upper(c) == c) & c.rlike(r"\p{L}{2}")
    marks = lambda c: F.regexp_count(c, F.lit(r"[À-ɏ]"))
    better = (letters(read) == letters(stated)) & (read != stated) & ~(shouting(stated) & ~shouting(read)) & (marks(stated) >= marks(read)) & ((shouting(read) & ~shouting(stated)) | (marks(stated) > marks(read)))
    return F.when(field.isin(*DATES), dated).when(field == "pages", opened).when(better, stated)
