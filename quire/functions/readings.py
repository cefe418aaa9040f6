"""What texts state: page ranges, volumes, editions, languages, publishers, identifiers and records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.basics import blank, let, let_both
from quire.functions.identifiers import valid_isbn

#: Ordinals, language names, legal forms of publishers, published forms.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
LANGUAGES = {
    "english": "en", "eng": "en", "en": "en", "korean": "ko", "kor": "ko", "ko": "ko", "kr": "ko", "한국어": "ko", "한글": "ko",
    "japanese": "ja", "jpn": "ja", "ja": "ja", "jp": "ja", "일본어": "ja", "chinese": "zh", "zho": "zh", "chi": "zh", "zh": "zh", "중국어": "zh",
    "german": "de", "deu": "de", "ger": "de", "de": "de", "french": "fr", "fra": "fr", "fre": "fr", "fr": "fr", "spanish": "es", "spa": "es", "es": "es",
}
LEGAL_FORMS = "ltd|limited|inc|incorporated|llc|plc|bv|nv|gmbh|ag|sa|sas|srl|spa|ab|as|oy|kk|pty|co|company|corp|corporation|group|holdings?|press|publishers?|publishing|publications?|the"
PUBLISHED_FORMS = ("journal-article", "proceedings-article", "book", "book-chapter", "monograph", "edited-book", "reference-entry", "report", "dissertation")


def page_ranges(text: Column) -> Column:
    """Ranges that a text states, as start-end with abbreviated ends written out, in order."""
    found = F.regexp_extract_all(blank(text), F.lit(r"(?<!\d)\d{1,6}\s*[-–—~]\s*\d{1,6}(?![\d-])"), F.lit(0))

    def whole(x: Column) -> Column:
        a, b = F.regexp_extract(x, r"^(\d+)", 1), F.regexp_extract(x, r"(\d+)$", 1)
        longer = F.concat(F.substring(a, F.lit(1), F.char_length(a) - F.char_length(b)), b)
        plain = ~a.rlike(r"^0\d") & ~b.rlike(r"^0\d")
        return (
            F.when(plain & (b.cast("int") > a.cast("int")), F.concat_ws("-", a, b))
            .when(plain & (F.char_length(b) < F.char_length(a)) & (longer.cast("int") > a.cast("int")), F.concat_ws("-", a, longer))
        )

    return F.array_compact(F.transform(found, whole))


def volumes(text: Column) -> Column:
    return F.regexp_extract_all(blank(text), F.lit(r"(?i)\bvol(?:ume)?\.?\s*[:：]?\s*(\d{1,4})\b(?![-\d])"), F.lit(1))


def issues(text: Column) -> Column:
    return F.regexp_extract_all(blank(text), F.lit(r"(?i)\b(?:no\.?|number|issue|iss\.?)\s*[:：]?\s*(\d{1,4})\b(?![-\d])"), F.lit(1))


def same_locator(a: Column, b: Column) -> Column:
    """Equal volumes, issues or ranges, whatever their dashes and leading zeros; an unstated one agrees."""

    def parts(x: Column) -> Column:
        each = F.split(F.regexp_replace(blank(x), "[–—~−]", "-"), "-")
        return F.filter(F.transform(each, lambda p: F.regexp_replace(F.trim(p), r"^0+(?=\d)", "")), lambda p: p != "")

    return (F.trim(blank(a)) == "") | (F.trim(blank(b)) == "") | (parts(a) == parts(b))


def edition_key(value: Column) -> Column:
    """An edition for comparison: its number, or its words without the usual ones."""
    text = F.lower(F.trim(blank(value)))
    for i, word in enumerate(ORDINALS, 1):
        text = F.regexp_replace(text, rf"\b{word}\b", str(i))
    text = F.regexp_replace(text, r"(\d+)(?:st|nd|rd|th)\b", "$1")
    text = F.regexp_replace(text, r"\b(?:ed|edn|edition|revised|rev)\b\.?", " ")
    return F.regexp_replace(F.regexp_replace(text, "제|판", " "), r"[^\p{L}\p{N}]+", "")


def language_code(value: Column) -> Column:
    """The code of a language's name or locale; what is unknown stays as it is."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    text = F.lower(F.trim(blank(value)))
    return F.coalesce(F.try_element_at(table, text), F.try_element_at(table, F.regexp_replace(text, "[-_].*$", "")), F.trim(blank(value)))


def publisher_letters(value: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(blank(value)), r"\([^)]*\)", " "), "[.,]", "")
    return F.regexp_replace(F.regexp_replace(bare, rf"\b(?:{LEGAL_FORMS})\b", " "), r"[^\p{L}\p{N}]+", "")


def publisher_traits(value: Column) -> Column:
    """What ``equal_publishers`` compares of a house."""
    each = F.split(F.regexp_replace(F.regexp_replace(blank(value), r"\([^)]*\)", " "), "[.,]", ""), r"[^\p{L}\p{N}]+")
    words = F.filter(F.transform(each, F.lower), lambda w: ~w.rlike(rf"^(?:|and|{LEGAL_FORMS})$"))
    named = let(words, lambda w: F.struct(F.get(w, 0).alias("word"), (F.size(w) == 1).alias("alone")))
    return let(named, lambda w: F.struct(publisher_letters(value).alias("letters"), w["word"].alias("word"), w["alone"].alias("alone")))


def equal_publishers(x: Column, y: Column) -> Column:
    """``same_publisher`` of two houses' traits."""
    nested = (x["alone"] | y["alone"]) & (F.char_length(x["word"]) >= 4) & (x["word"] == y["word"])
    return (x["letters"] != "") & (y["letters"] != "") & ((x["letters"] == y["letters"]) | F.coalesce(nested, F.lit(False)))


def same_publisher(a: Column, b: Column) -> Column:
    """Equal but for legal forms, or one is the house's first word alone."""
    return let_both(publisher_traits(a), publisher_traits(b), equal_publishers)


def reference_kind(value: Column) -> Column:
    """What a person pasted: isbn, doi or url; null for anything else."""
    text = F.regexp_replace(F.trim(blank(value)), "[.,;]+$", "")
    isbn = valid_isbn(F.regexp_replace(text, r"(?i)^isbn[-\s:]*(?:1[03][-\s:]+)?", "")) != ""
    doi = text.rlike(r"(?i)^https?://(?:dx\.)?doi\.org/.") | text.rlike(r"(?i)^(?:doi:\s*)?10\.\d{4,9}/\S+")
    return F.when(text == "", None).when(isbn, "isbn").when(doi, "doi").when(text.rlike(r"(?i)^https?://|^[\w.-]+\.[a-z]{2,}/"), "url")


def is_report_url(value: Column) -> Column:
    """An address of a page of its own, not a home page or a search."""
    text = F.trim(blank(value))
    path = F.regexp_extract(text, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    return ~path.isin("", "/") & ~path.rlike(r"(?i)/search\b") & ~text.rlike(r"(?i)[?&](?:q|query|keyword|search|s)=")


def extra_line(extra: Column, label: str) -> Column:
    """The value of the first line that starts with a label; empty if none does."""
    lines = F.transform(F.split(blank(extra), "\n"), lambda x: F.trim(x))
    hit = F.get(F.filter(lines, lambda x: F.lower(x).startswith(f"{label.lower()}:")), 0)
    return F.trim(F.coalesce(F.substring(hit, F.lit(len(label) + 2), F.char_length(hit)), F.lit("")))


def with_extra_line(extra: Column, label: str, value: Column) -> Column:
    """The lines without those of a label, and one with its value at the end if there is one."""
    lines = F.filter(F.split(blank(extra), "\n"), lambda x: (F.trim(x) != "") & ~F.lower(F.trim(x)).startswith(f"{label.lower()}:"))
    return F.array_join(F.when(blank(value) == "", lines).otherwise(F.concat(lines, F.array(F.concat(F.lit(f"{label}: "), value)))), "\n")


def registry_date(message: Column) -> Column:
    """A registry record's date from its date parts, as precise as they are; null without a year."""
    part = lambda i: F.coalesce(*(F.get_json_object(message, f"$['{k}']['date-parts'][0][{i}]") for k in ("published-print", "issued", "published", "published-online"))).try_cast("int")
    y, m, d = part(0), part(1), part(2)
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    year = y.cast("string")
    return (
        F.when(~y.between(1000, 9999) | y.isNull(), None)
        .when(m.between(1, 12) & d.between(1, 31), F.concat_ws("-", year, pad(m), pad(d)))
        .when(m.between(1, 12), F.concat_ws("-", year, pad(m)))
        .otherwise(year)
    )


def registry_stage(message: Column) -> Column:
    """preprint, versionOfRecord or unknown, from a registry's record."""
    get = lambda k: F.get_json_object(message, f"$['{k}']")
    kind = F.lower(F.coalesce(get("type"), F.lit("")))
    placed = F.coalesce(get("volume"), get("page"), get("published-print"), get("issue")).isNotNull()
    pre = (kind == "posted-content") | (F.lower(F.coalesce(get("subtype"), F.lit(""))) == "preprint") | F.get_json_object(message, "$.relation['is-preprint-of'][0].id").isNotNull()
    return F.when(pre, "preprint").when(kind.isin(*PUBLISHED_FORMS) & placed, "versionOfRecord").otherwise("unknown")


def linked_record(html: Column) -> Column:
    """Fields of a page's first JSON-LD record; null if it has none that parses."""
    body = F.trim(F.regexp_extract(blank(html), r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""", 1))
    get = lambda p: F.coalesce(F.get_json_object(body, f"$.{p}"), F.lit(""))
    title = F.coalesce(*(F.get_json_object(body, f"$.{k}") for k in ("headline", "title", "name")))
    fields = F.struct(title.alias("title"), get("datePublished").alias("date"), get("publisher.name").alias("publisher"), get("author.name").alias("author"), get("isbn").alias("isbn"), get("inLanguage").alias("language"))
    return F.when((body != "") & F.try_parse_json(body).isNotNull() & title.isNotNull(), fields)


def page_citation(html: Column) -> Column:
    """Title and date of a page by the first reader that has them: citation tags, JSON-LD, Dublin Core, Open Graph, the title itself."""

    def meta(*names: str) -> Column:
        found = []
        for n in names:
            for pattern in (rf"""(?i)<meta\s[^>]*?(?:name|property)=["']{n}["'][^>]*?content=["']([^"']*)["']""", rf"""(?i)<meta\s[^>]*?content=["']([^"']*)["'][^>]*?(?:name|property)=["']{n}["']"""):
                got = F.trim(F.regexp_extract(blank(html), pattern, 1))
                found.append(F.when(got != "", got))
        return F.coalesce(*found)

    linked = linked_record(html)
    heading = F.trim(F.regexp_extract(blank(html), r"(?is)<title[^>]*>(.*?)</title>", 1))
    title = F.coalesce(meta("citation_title"), linked["title"], meta(r"dc\.title", r"dcterms\.title"), meta("og:title"), F.when(heading != "", heading))
    date = F.coalesce(meta("citation_publication_date", "citation_date"), F.when(linked["date"] != "", linked["date"]), meta(r"dc\.date", r"dcterms\.issued"), meta("article:published_time"))
    return F.struct(title.alias("title"), date.alias("date"))


def _isbn_ok(digits: str) -> bool:
    if re.fullmatch(r"\d{9}[\dX]", digits):
        return sum((10 if c == "X" else int(c)) * (10 - i) for i, c in enumerate(digits)) % 11 == 0
    return bool(re.fullmatch(r"97[89]\d{10}", digits)) and sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(digits)) % 10 == 0


def _thirteen(digits: str) -> str:
    if len(digits) == 13:
        return digits
    body = "978" + digits[:9]
    return body + str(-sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(body)) % 10)


def find_isbns(text: str) -> list[str]:
    """Every valid ISBN of a text as thirteen digits, once, those set apart by spaces or run together too."""
    found: list[str] = []
    parts: list[str] = []

    def take(digits: str) -> bool:
        if not _isbn_ok(digits):
            return False
        if (key := _thirteen(digits)) not in found:
            found.append(key)
        return True

    for word in re.split(r"[\s,;/|]+", text.upper()):
        digits = re.sub("[^0-9X]", "", word)
        if not digits:
            continue
        if len(digits) > 13:  # several in one word: take them from the front
            parts = []
            while len(digits) >= 10 and (n := next((k for k in (13, 10) if take(digits[:k])), 0)):
                digits = digits[n:]
            continue
        parts.append(digits)
        while sum(map(len, parts)) > 13:
            parts.pop(0)
        if take(digits) or any(take("".join(parts[i:])) for i in range(len(parts)) if sum(map(len, parts[i:])) in (10, 13)):
            parts = []
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def isbns_in(text: pd.Series) -> pd.Series:
    return text.fillna("").map(find_isbns)


SCAN = re.compile(
    r"(?P<doi>\b10\.\d{4,9}/[^\s\"<>]+)|(?P<orcid>\b\d{4}-\d{4}-\d{4}-\d{3}[\dX]\b)|(?P<arxiv>(?i:arxiv:)\s*\d{4}\.\d{4,5}(?:v\d+)?)"
    r"|(?P<isbn>\b97[89](?:[- ]?\d){10}\b|(?<![\d-])\d(?:[- ]?\d){8}[- ]?[\dX]\b)|(?P<issn>\b\d{4}-\d{3}[\dX]\b)"
)


def scan(text: str) -> list[dict]:
    """Identifiers of a text: kind, value, raw and place, and how sure each is: exact, repaired or ambiguous."""
    out = []
    cited = re.search(r"(?im)^\s*(?:references|bibliography|works cited)\s*$", text)
    for m in SCAN.finditer(text):
        kind, raw, sure = m.lastgroup, m[0], "exact"
        value = raw
        if kind == "doi":
            value = re.sub(r"[.,;:)\]}>'\"]+$", "", raw).lower()
            if raw.count("(") != raw.count(")"):
                sure = "ambiguous"
            elif len(value) != len(raw):
                sure = "repaired"
        elif kind == "isbn":
            digits = re.sub("[- ]", "", raw)
            if not _isbn_ok(digits):
                continue
            value = _thirteen(digits)
        elif kind == "issn":
            check = -sum(int(c) * (8 - i) for i, c in enumerate(raw.replace("-", "")[:7])) % 11
            if raw[-1] != ("X" if check == 10 else str(check)):
                continue
        out.append({"kind": kind, "value": value, "raw": raw, "at": m.start(), "confidence": sure, "cited": bool(cited and m.start() > cited.start())})
    return out


SCANNED = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("confidence", T.StringType()), T.StructField("cited", T.BooleanType())]))


@F.pandas_udf(SCANNED)
def identifiers_in(text: pd.Series) -> pd.Series:
    return text.fillna("").map(scan)


def us_patents(text: Column) -> Column:
    """Numbers of United States patents and applications that a text prints, each once, in order of kind."""
    t = blank(text)
    application = r"(?<![A-Za-z0-9])US\s*((?:19|20)\d{2})\s*/?\s*(\d{7})\s*A\s*([1-9Il])(?![A-Za-z0-9])"
    grant = r"(?<![A-Za-z0-9])US\s*((?:RE|D|PP)?\s*(?:\d{1,3}(?:,\d{3}){1,2}|\d{7,8}))\s*([ABEPS])\s*([1-9Il]?)(?![A-Za-z0-9])"
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s,/]", ""), "[Il]$", "1")
    both = F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (application, grant)))
    return F.array_distinct(F.transform(both, bare))
