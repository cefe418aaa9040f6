"""What lines and pages state: abstracts, degrees, citations, page numbers, counted names and repaired letters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.basics import blank, let, let_both

#: Words that head an abstract, and what stands between its paragraphs.
ABSTRACT_HEADS = ("abstract", "초록", "요약", "摘要", "resumen", "résumé", "resume", "resumo")
PARAGRAPHS = r"\s*\n\s*,\s*\n\s*"
LEAST_ABSTRACT = 80
#: Fields that a record of each type needs.
REQUIRED = {
    "journalArticle": ("title", "creators", "date", "publicationTitle"),
    "thesis": ("title", "creators", "date", "university"),
    "report": ("title", "date", "institution"),
    "book": ("title", "creators", "date", "publisher"),
    "bookSection": ("title", "creators", "date"),
}
#: Levels, in the wording before "thesis" or "dissertation", and whole statements in other languages.
LEVELS = ("master", "masters", "master's", "bachelor", "bachelors", "bachelor's", "doctoral", "doctorate", "diploma", "honours", "honors", "undergraduate", "graduation", "senior", "final year", "phd", "ph d", "msc", "ma", "meng", "mphil", "ms", "bsc", "ba", "beng", "bphil", "bs")
WHOLE_STATEMENTS = (
    "trabajo de fin de máster", "trabajo fin de máster", "trabajo de fin de grado", "trabajo fin de grado", "trabajo fin de carrera", "tesis", "tesis doctoral", "tesis de doctorado", "tesis de maestría",
    "tesis de licenciatura", "tesis de grado", "tesina", "memoria de tesis", "memoria de grado", "dissertação", "dissertação de mestrado", "dissertação de doutorado", "tese", "tese de doutorado", "tese de mestrado",
    "trabalho de conclusão de curso", "mémoire de master", "mémoire de maîtrise", "mémoire de licence", "thèse", "thèse de doctorat", "masterarbeit", "bachelorarbeit", "diplomarbeit", "magisterarbeit", "doktorarbeit",
    "masterthesis", "bachelorthesis", "master-arbeit", "bachelor-arbeit", "tesi", "tesi di laurea", "tesi di laurea magistrale", "tesi di dottorato", "학위논문", "석사학위논문", "박사학위논문", "학사학위논문",
    "석사논문", "박사논문", "석사학위청구논문", "박사학위청구논문", "碩士論文", "博士論文", "修士論文", "學位論文", "学位論文", "学位论文", "硕士论文", "博士论文", "卒業論文",
)
LONGEST_STATEMENT = 80
#: Spacing accents and the combining marks that they stand for; marks that consonants bear.
ACCENTS = {"´": "́", "`": "̀", "¨": "̈", "ˆ": "̂", "˜": "̃", "˘": "̆", "˚": "̊", "˝": "̋", "¯": "̄", "¸": "̧", "ˇ": "̌", "˙": "̇"}
CONSONANT_MARKS = "̧̌̇"
#: Words by which English is known.
COMMON = frozenset(
    "the of and in to for with is are on by from this that as be at an or which can was were has have its their between into these also we our based using such than when where these more other been where high".split()
)


def tidy_abstract(text: Column) -> Column:
    """An abstract without its heading, in single spaces, without paragraphs that others hold."""
    heads = "|".join(r"\s*".join(h) if ord(h[0]) > 0x2FFF else h for h in ABSTRACT_HEADS)
    heading = rf"(?i)^\s*(?:{heads})(?:[ \t ]*[.:：][ \t ]*|[ \t ]*\r?\n\s*)"
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))

    def of(value: Column) -> Column:
        rest = F.regexp_replace(value, heading, "")
        body = F.when(F.char_length(F.trim(rest)) >= LEAST_ABSTRACT, rest).otherwise(value)
        parts = F.filter(F.transform(F.split(body, PARAGRAPHS), squeeze), lambda p: p != "")

        def kept(all_: Column) -> Column:
            own = F.filter(all_, lambda p: ~F.exists(all_, lambda o: (o != p) & F.contains(o, p)))
            return F.when(F.size(all_) < 2, squeeze(body)).otherwise(F.array_join(own, " "))

        return let(parts, kept)

    return let(blank(text), of)


def is_degree_statement(line: Column) -> Column:
    """Whether a line says nothing but that the work is a thesis, and of which level."""

    def of(value: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.lower(value), r"\s*[.:]$", ""))
        whole = F.regexp_replace(F.regexp_replace(bare, r"^an? ", ""), r"\s*\(tf[gm]\)$", "")
        level = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"\b(?:thesis|dissertation)$", ""), "’", "'"), r"(?<=\b\p{L}{1,4})\.|-", " "))
        level = F.trim(F.regexp_replace(F.regexp_replace(level, r"\s+", " "), r"(?<=^(?:master|bachelor)(?:'?s)?) of [a-z]+$| of [a-z]+(?= degree$)| degree$", ""))
        level = F.regexp_replace(F.regexp_replace(level, r" of [a-z]+$", ""), r"^(m|b|ph) (?=(?:sc|a|eng|phil|s|d)$)", "$1")
        named = whole.rlike(r"(?:^|\s)(?:thesis|dissertation)$") & ((level == "") | level.isin(*LEVELS))
        field = F.regexp_replace(F.regexp_replace(value, r"\s", ""), r"^(?:[가-힣]{1,4}?학|\p{IsHan}{1,4}?[學学])(?=(?:석사|박사|학사|학위|碩士|博士|學士|硕士|学士|修士|學位|学位))", "")
        return (value != "") & (F.char_length(value) <= LONGEST_STATEMENT) & (named | whole.isin(*WHOLE_STATEMENTS) | field.isin(*WHOLE_STATEMENTS))

    return let(F.trim(F.regexp_replace(blank(line), r"\s+", " ")), of)


def required_missing(kind: Column, fields: Column) -> Column:
    """The fields that a type needs and a map of fields lacks, in order; none for types without a rule."""
    table = F.create_map(*(x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    wanted = F.coalesce(F.try_element_at(table, kind), F.array().cast("array<string>"))
    return F.filter(wanted, lambda f: F.coalesce(F.trim(F.try_element_at(fields, f)), F.lit("")) == "")


def citation_statement(text: Column) -> Column:
    """What "to cite this article" states: year, title, journal, volume, issue, pages and doi; null where it isn't stated whole."""
    cited = F.regexp_extract(F.regexp_replace(blank(text), r"\s+", " "), r"(?i)to cite this article ?[:：](.{0,900})", 1)

    def of(span: Column) -> Column:
        year = F.regexp_extract(span, r"\( ?((?:1[5-9]|20)\d{2}) ?\)", 1)
        # Fields are told apart from the end: pages, volume and issue, journal; what is left before is the title.
        tail = r"^(.*), ([^,]{4,80}), (\d{1,4}) ?(?:: ?(\d{1,4}))? ?, (\d{1,6}) ?[-–—] ?(\d{1,6})(?: ?, DOI ?[:：]? ?(10\.\d{4,9}/\S+?))?[\s.,]*$"
        body = F.trim(F.regexp_replace(F.regexp_replace(span, r"^.*?\( ?(?:1[5-9]|20)\d{2} ?\)", ""), r"(?i)To link.*$", ""))
        part = lambda n: F.regexp_extract(body, tail, n)
        none = lambda c: F.when(c != "", c)
        fields = F.struct(
            year.alias("year"), F.trim(part(1)).alias("title"), F.trim(part(2)).alias("journal"), none(part(3)).alias("volume"), none(part(4)).alias("issue"),
            F.concat_ws("-", part(5), part(6)).alias("pages"), none(F.regexp_replace(part(7), r"[.,;]+$", "")).alias("doi"),
        )
        return F.when((year != "") & body.rlike(tail) & (F.char_length(F.trim(part(1))) >= 8), fields)

    return let(cited, of)


def _range(value: Column) -> Column:
    """The ends of a range, or null; each value is matched once."""
    shape = r"^\s*(\d{1,6})\s*[‐-―−-]\s*(\d{1,6})\s*$"
    ends = F.split(F.regexp_replace(blank(value), shape, "$1 $2"), " ")
    return F.when(blank(value).rlike(shape), F.struct(F.get(ends, 0).alias("first"), F.get(ends, 1).alias("last")))


def _ranges(page: Column) -> Column:
    """The ranges that a page prints, as (first, last).

    The pattern is fixed, so it is compiled once and not for each row; its
    lookahead reads the second number, so that this may begin a range itself.
    """
    pattern = F.lit(r"(?<![\d.])(\d+)(?=\s*[‐-―−⁃〜~/eE-]\s*(\d+))")
    return F.arrays_zip(F.regexp_extract_all(page, pattern, F.lit(1)).alias("first"), F.regexp_extract_all(page, pattern, F.lit(2)).alias("last"))


def _is_printed(page: Column, ranges: Column, first: Column, last: Column) -> Column:
    """Whether a page prints a range, or its first number alone; most pages don't hold the number at all."""
    alone = F.regexp_extract_all(page, F.lit(r"(?<![\d.‐-―−-])(\d+)(?![\d.‐-―−-])"), F.lit(1))
    return F.contains(page, first) & (F.exists(ranges, lambda r: (r["first"] == first) & (r["last"] == last)) | F.array_contains(alone, first))


def _squeezed(page: Column) -> Column:
    return F.regexp_replace(blank(page), r"\s+", " ")


def _span(first: Column, last: Column) -> Column:
    return last.cast("int") - first.cast("int") + 1


def start_page_not_printed(stored: Column, read: Column, page: Column, extent: Column) -> Column:
    """Whether a range that was read begins with a page that the document doesn't print, while the stored one fits its extent."""

    def of(s: Column, r: Column) -> Column:
        (a, b), (c, d) = (s["first"], s["last"]), (r["first"], r["last"])
        fits = (b == d) & (a != c) & (extent >= 1) & (extent == _span(a, b)) & (extent != _span(c, d))
        seen = let(_squeezed(page), lambda p: let(_ranges(p), lambda x: _is_printed(p, x, a, b) & ~_is_printed(p, x, c, d)))
        return F.coalesce(F.when(fits, seen), F.lit(False))

    return let_both(_range(stored), _range(read), of)


def start_page_printed(read: Column, page: Column, extent: Column) -> Column:
    """The range that a document prints in place of one that was read, if its extent says so; else null."""

    def of(r: Column) -> Column:
        c, d = r["first"], r["last"]

        def found(p: Column, ranges: Column) -> Column:
            fit = F.get(F.filter(ranges, lambda x: (x["last"] == d) & (F.char_length(x["first"]) <= 6) & (x["first"] != c) & (_span(x["first"], d) == extent)), 0)
            return F.when(~_is_printed(p, ranges, c, d), F.concat(fit["first"], F.lit("-"), d))

        apart = (extent >= 1) & (extent != _span(c, d))
        return F.when(apart, let(_squeezed(page), lambda p: let(_ranges(p), lambda x: found(p, x))))

    return let(_range(read), of)


def count_names(region: Column) -> Column:
    """How many names a byline has; null where it is shortened or has none."""
    text = F.regexp_replace(blank(region), r"(?i)\s+with\s+", ", ")
    parts = F.filter(F.transform(F.split(text, r"(?i)\s*[,;·、]\s*(?:and\s+|&\s*)?|\s+and\s+|\s*&\s*|\n"), F.trim), lambda p: (F.char_length(p) >= 2) & p.rlike(r"\p{L}"))
    shortened = text.rlike(r"(?i)\bet\s+al\b") | text.rlike(r"(?i)\band\s+others\b|외\s*\d*\s*(?:명|인)")
    return F.when(~shortened & (F.size(parts) > 0), F.size(parts))


def page_of(stated: Column, locator: Column) -> Column:
    """The page of an observation: as stated, else as its locator says; null if neither does."""
    located = F.regexp_extract(blank(locator), r"(?i)page\s+(\d{1,4})\b", 1).try_cast("int")
    return F.when(stated > 0, stated.cast("int")).otherwise(located)


def letters_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(blank(text), r"[^\p{L}\p{N}]", ""))


def extraction_quality(text: Column) -> Column:
    """The share of letters in the first 5000 characters, which is what the measure is of, and up to 0.3 more for words."""
    head = F.left(blank(text), F.lit(5000))
    visible = F.greatest(F.lit(1), F.char_length(F.regexp_replace(head, r"\s", "")))
    return F.regexp_count(head, F.lit(r"\p{L}")) / visible + F.least(F.regexp_count(head, F.lit(r"\p{L}{2,}")), F.lit(30)) / 100.0


def combined_text(own: Column, cached: Column, characters: int) -> Column:
    """Two extractions of one text as one: the one that holds the other, else both, the clearly better one first."""
    a, b = letters_key(own), letters_key(cached)
    wrapper = F.left(blank(cached), F.lit(2500)).rlike(r"(?i)creative\s+commons\s+(?:licen[cs]e|deed)")
    own_first = wrapper | (extraction_quality(own) > extraction_quality(cached) + 0.12)
    both = F.when(own_first, F.concat(own, F.lit("\n\f\n"), cached)).otherwise(F.concat(cached, F.lit("\n\f\n"), own))
    text = F.when(a == "", blank(cached)).when(b == "", blank(own)).when(F.contains(b, a), cached).when(F.contains(a, b), own).otherwise(both)
    return F.left(text, F.lit(characters))


def without_regions(text: Column, regions: Column) -> Column:
    """A text with a line break in place of each of the ``regions`` (array of start, end), overlapping ones as one."""

    def step(state: Column, r: Column) -> Column:
        apart = r["start"] > state["at"]
        gap = F.when(apart, F.concat(F.substring(text, state["at"] + 1, r["start"] - state["at"]), F.lit("\n"))).otherwise(F.when(state["out"].isNull(), F.lit("\n")).otherwise(F.lit("")))
        return F.struct(F.greatest(state["at"], r["end"]).alias("at"), F.concat(F.coalesce(state["out"], F.lit("")), gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("out"))
    end = lambda s: F.concat(F.coalesce(s["out"], F.lit("")), F.substring(text, s["at"] + 1, F.char_length(text)))
    return F.aggregate(F.array_sort(regions), start, step, end)


def _shifted(token: str, shift: int) -> str | None:
    """A token with every character moved on, if that gives a word of Latin letters."""
    moved = "".join(chr(ord(c) + shift) for c in token if ord(c) + shift < 0x110000)
    if not (moved.isascii() and moved.isalpha()):
        return None
    if len(moved) == 1:
        return moved if moved in "aAI" else None
    return moved if any(c.islower() for c in moved) and set(moved.lower()) & set("aeiouy") else None


def repaired_shift(text: str) -> str:
    """A text whose letters were all moved by one number of places, moved back; other texts as they are.

    The number is the one that gives most common words; it must decode a fifth
    of the tokens, and common words must be eight, of four kinds, and 15% of these.
    """
    tokens = text.split()
    if len(tokens) < 30:
        return text
    best, most = None, 0
    for shift in (s for s in range(1, 64) if s != 32):
        words = [w for w in (_shifted(t, shift) for t in tokens) if w is not None]
        common = [w.lower() for w in words if w.lower() in COMMON]
        if len(words) >= max(20, 0.2 * len(tokens)) and len(common) >= 8 and len(set(common)) >= 4 and len(common) >= 0.15 * len(words) and len(common) > most:
            best, most = shift, len(common)
    if best is None:
        return text
    out, word = [], []
    for c in text + " ":
        if c.isspace():
            token = "".join(word)
            out += [_shifted(token, best) or token, c] if word else [c]
            word = []
        else:
            word.append(c)
    return "".join(out)[:-1]


def attached_accents(text: str) -> str:
    """Accents that stand beside their letters put on them; vowels take any mark, consonants only those that they bear."""
    out: list[str] = []
    rest = list(reversed(text))

    def bears(letter: str, mark: str) -> str | None:
        if not letter or not (mark in CONSONANT_MARKS or letter in "aeiouyAEIOUYıæøÆØ") or "LATIN" not in unicodedata.name(letter, ""):
            return None
        whole = unicodedata.normalize("NFC", ("i" if letter == "ı" else letter) + mark)
        return whole if len(whole) == 1 else None

    while rest:
        c = rest.pop()
        detached = c.isspace() and c != "\n" and bool(rest) and "̀" <= rest[-1] <= "ͯ"
        mark = rest[-1] if detached else ACCENTS.get(c)
        if not mark:
            out.append(c)
            continue
        if detached:
            rest.pop()
        before, after = (out[-1] if out else ""), (rest[-1] if rest else "")
        plain = [c, mark] if detached else [c]
        if c == "`" and not (before.isalpha() and after.isalpha()):
            out += plain
            continue
        on_before, on_after = bears(before, mark), bears(after, mark)
        later = on_after and (not on_before or (mark not in CONSONANT_MARKS and after in "eE" and before not in "eE"))
        if later:
            rest.pop()
            out.append(on_after)
        elif on_before:
            out[-1] = on_before
        else:
            out += plain
    return "".join(out)


@F.pandas_udf(T.StringType())
def repaired_encoding(text: pd.Series) -> pd.Series:
    """``repaired_shift`` of each page."""
    return text.fillna("").map(lambda t: "\f".join(map(repaired_shift, t.split("\f"))))


@F.pandas_udf(T.StringType())
def with_attached_accents(text: pd.Series) -> pd.Series:
    return text.fillna("").map(attached_accents)
