"""Judging, comparing and verifying the fields of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import dates, identifiers, readings, titles, web
from quire.functions.basics import blank, let_both
from quire.operators.joins import small

#: Fields that only keep books, that the library owns, and that name a container.
BOOKKEEPING = ("accessDate", "libraryCatalog")
OWNED = ("callNumber", "archive", "archiveLocation", "extra")
CONTAINERS = ("publicationTitle", "proceedingsTitle", "bookTitle")
DATES = ("date", "filingDate", "issueDate")
HOUSES = ("publisher", "place", "university", "institution")


def field_problem(field: Column, value: Column) -> Column:
    """Why a value can't stand in a field; null if it can."""
    text = F.trim(blank(value))
    bad = lambda *names: field.isin(*names)
    roman = text.rlike(r"(?i)^[ivxlcdm]{1,6}$|^[A-Za-z]{1,4}$")
    return (
        F.when(text == "", "empty")
        .when(bad("title") & titles.is_placeholder(text), "placeholder")
        .when(bad("title", *HOUSES) & ~text.rlike(r"\p{L}{2}"), "noLetters")
        .when(bad(*HOUSES) & text.rlike(r"(?i)^(?:https?://|www\.)|\S@\S+\.\p{L}{2,}"), "address")
        .when(bad("url") & ~web.is_external_url(text), "noAddress")
        .when(bad("numPages") & ~text.rlike(r"^(?:[ivxlcdm]+\s*[,+]\s*)?0*[1-9]\d{0,5}(?:\s*(?:p|pp|pages)\.?)?$"), "noNumber")
        .when(bad("DOI") & (identifiers.doi_in(text) == ""), "noDoiShape")
        .when(bad("DOI") & text.rlike(r"(?i)10\.\d{4,9}/(?:x+|example|\.{3})$"), "template")
        .when(bad("ISBN") & (F.size(F.filter(F.split(text, r"[\s,;/|]+"), lambda x: identifiers.valid_isbn(x) != "")) == 0), "checkDigit")
        .when(bad("ISSN") & (identifiers.valid_issn(text) == ""), "checkDigit")
        .when(bad(*DATES) & dates.canonical_date(text).isNull(), "noDate")
        .when(bad("pages") & ~text.rlike(r"^[A-Za-z]{0,2}\d{1,8}(?:\s*[-–—~]\s*[A-Za-z]{0,2}\d{1,8})?$"), "noPages")
        .when(bad("volume", "issue") & ((~text.rlike(r"\d") & ~roman) | text.rlike("^0+$")), "noNumber")
        .when(bad(*CONTAINERS) & text.rlike(r"(?i)^(?:vol(?:ume)?|no|issue)\.?\s*\d|^\d+\s*\(\d+\)"), "citation")
        .when(bad("language") & ~readings.language_code(text).rlike(r"^[a-z]{2,3}(?:-[A-Za-z]{2,8})*$"), "noLanguage")
    )


def record_diff(stored: DataFrame, read: DataFrame, key: str = "key", authoritative: bool = False, valid: DataFrame | None = None) -> DataFrame:
    """Changes that a reading (key, field, value) proposes to stored records (key, field, value).

    The reading drives: what it doesn't state stays, unless it is
    ``authoritative``, which clears fields that it leaves out. ``valid`` (field)
    bounds the fields. Returns key, field, old, new.

    Rows here are fields, several for each row of a table, which Spark's estimate
    takes for one; so the joins name their method, and neither side is broadcast.
    """
    now = read.where(F.trim(blank(F.col("value"))) != "").select(key, "field", F.col("value").alias("new"))
    now = now.where(~F.col("field").isin(*BOOKKEEPING))
    if valid is not None:
        now = now.join(small(valid.select("field").distinct()), "field", "left_semi")
    met = now.join(stored.select(key, "field", F.col("value").alias("_old")).hint("merge"), [key, "field"], "left").withColumn("old", blank(F.col("_old")))
    f, old, new = F.col("field"), F.col("old"), F.col("new")
    has = old != ""
    skip = (
        (f.isin(*OWNED) & has)
        | (f.isin("title", *CONTAINERS) & has & (titles.fold(old) == titles.fold(new)))
        | ((f == "title") & titles.is_truncated(old, new))
        | (f.isin(*DATES) & let_both(dates.canonical_date(old), dates.canonical_date(new), lambda a, b: F.coalesce(a == b, F.lit(False)) | (has & dates.says_less(a, b))))
        | ((f == "publisher") & readings.same_publisher(old, new))
        | ((f == "DOI") & identifiers.same_doi(old, new))
        | (old == new)
    )
    merged = F.when(f.isin("ISBN", "ISSN") & has, identifiers.merged_identifiers(old, new)).otherwise(new)
    changes = met.where(~skip).withColumn("new", merged).where("old <> new").select(key, "field", "old", "new")
    if authoritative:
        silent = stored.where(blank(F.col("value")) != "").where(~F.col("field").isin(*OWNED)).join(read.select(key, "field").hint("merge"), [key, "field"], "left_anti")
        changes = changes.unionByName(silent.join(read.select(key).distinct().hint("merge"), key, "left_semi").select(key, "field", F.col("value").alias("old"), F.lit("").alias("new")))
    return changes


def printed(field: Column, value: Column, text: Column) -> Column:
    """Whether a document prints a value: by its digits, its canonical date's year, or its letters."""
    digits = F.regexp_replace(F.upper(blank(value)), "[^0-9X]", "")
    year = F.substring(dates.canonical_date(value), 1, 4)
    return (
        F.when(field.isin("ISBN", "ISSN"), (digits != "") & F.contains(F.regexp_replace(F.upper(blank(text)), "[^0-9X]", ""), digits))
        .when(field == "DOI", F.contains(F.lower(blank(text)), identifiers.normalized_doi(value)))
        .when(field.isin(*DATES), F.coalesce(F.contains(blank(text), year), F.lit(False)))
        .when(field.isin("volume", "issue", "pages"), F.rlike(blank(text), F.concat(F.lit(r"(?<!\d)"), F.regexp_replace(blank(value), r"[^0-9A-Za-z]+", "[-–—~ ]+"), F.lit(r"(?!\d)"))))
        .otherwise((titles.fold(value) != "") & F.contains(titles.fold(text), titles.fold(value)))
    )


def verify(changes: DataFrame, text: Column, rival: Column, linked: Column) -> DataFrame:
    """``changes`` (field, new, ...) with a level: verified, conflicting, sourceStated, proposed or unknown.

    ``rival`` is another value that the document prints for the field, or null;
    ``linked`` says that a record of the same edition states the value.
    """
    shown = printed(F.col("field"), F.col("new"), text)
    level = (
        F.when(blank(F.col("new")) == "", "unknown")
        .when(field_problem(F.col("field"), F.col("new")).isNotNull(), "proposed")
        .when(shown, "verified")
        .when(rival.isNotNull() & (rival != F.col("new")), "conflicting")
        .when(linked, "verified")
        .when(blank(text) == "", "sourceStated")
        .otherwise("proposed")
    )
    return changes.withColumn("level", level)


def binding(record_doi: Column, page_doi: Column, title: Column, text: Column, surnames: Column, year: Column) -> Column:
    """Five checks that tie a registry's record to a document, and whether they do."""
    folded = titles.fold(text)
    same = identifiers.same_doi(record_doi, page_doi)
    titled = (F.char_length(titles.fold(title)) >= 12) & F.contains(folded, titles.fold(title))
    named = F.size(F.filter(surnames, lambda s: (F.char_length(titles.fold(s)) >= 2) & F.contains(folded, titles.fold(s))))
    authored = (F.size(surnames) > 0) & (named >= F.ceil(F.size(surnames) / 2))
    dated = F.contains(blank(text), F.coalesce(year, F.lit("\0")))
    ambiguous = identifiers.doi_boundary_ambiguous(page_doi)
    bound = same & ~ambiguous & (titled | (authored & dated))
    return F.struct(same.alias("doi"), titled.alias("title"), authored.alias("authors"), dated.alias("year"), ambiguous.alias("ambiguous"), bound.alias("bound"))
