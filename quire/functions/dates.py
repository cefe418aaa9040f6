"""Dates as texts of year, month or day precision.

A text is cut into tokens: numbers, words, marks. Each token has a class of one
letter, and the classes of all tokens side by side spell a shape. A date is a
text whose shape is one of a few, so that a word counts as a month only if it is
the whole name of one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.basics import blank, let, let_both

#: Names of the months from January to December, by language, and other spellings of some.
MONTH_NAMES = (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
)
OTHER_SPELLINGS = {"sept": 9, "fevrier": 2, "aout": 8, "decembre": 12, "jänner": 1, "maerz": 3, "setiembre": 9}
MONTHS = {name: n for names in MONTH_NAMES for n, name in enumerate(names.split(), 1)} | OTHER_SPELLINGS
#: What may stand after a day's number, and marks that part a date's fields.
ORDINALS = ("st", "nd", "rd", "th", "er", "º", "ª")
PARTING = "•·‧∙|"
#: Classes of other tokens by their text; four digits are Y, one or two N, a month's name A.
CLASSES = {"년": "y", "年": "y", "월": "m", "月": "m", "일": "d", "日": "d", "de": "e"} | dict.fromkeys(ORDINALS, "o") | dict.fromkeys(PARTING, ",") | {c: c for c in ".,/-"}
#: Shapes of dates: all numbers, with units, month's name first, day first.
SHAPES = (
    r"Y|Y[./-]N\.?|Y[./-]N[./-]N\.?|N[./]Y",
    r"Yy\.?|YyNm(Nd)?\.?",
    r"(A|Nm)\.?[,/]?(N[od]?,?)?Y\.?",
    r"No?\.?e?A\.?,?e?Y\.?",
)
FULL_WIDTH = ("０１２３４５６７８９．／－，", "0123456789./-,")


def is_real_date(year: Column, month: Column, day: Column) -> Column:
    """Whether the calendar has the day."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    longest = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31).otherwise(0)
    return F.coalesce(day.between(1, longest), F.lit(False))


def _table(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _classed(token: Column) -> Column:
    """A token with its class, and with its number if it is one or names a month."""
    # A lookup goes through its whole table, so only words are looked up, once each.
    word = token.rlike(r"^\p{L}{3,}$")

    def of(month: Column) -> Column:
        kind = (
            F.when(month.isNotNull(), "A").when(token.rlike(r"^\d{4}$"), "Y").when(token.rlike(r"^\d{1,2}$"), "N").when(token.rlike(r"^\d"), "x")
            .otherwise(F.coalesce(F.try_element_at(_table(CLASSES), token), F.lit("x")))
        )
        return F.struct(kind.alias("kind"), F.coalesce(month, token.try_cast("int")).alias("n"))

    return let(F.when(word, F.try_element_at(_table(MONTHS), token)), of)


def canonical_date(value: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD, as precise as stated; null for anything else or a day that doesn't exist."""
    text = F.lower(F.translate(blank(value), *FULL_WIDTH))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"\d+|\p{L}+|[^\s\d\p{L}]"), F.lit(0)), _classed)

    def of(found: Column) -> Column:
        def numbers(kind: str) -> Column:
            return F.transform(F.filter(found, lambda t: t["kind"] == kind), lambda t: t["n"])

        shape = F.array_join(F.transform(found, lambda t: t["kind"]), "")
        parts = F.struct(numbers("N").alias("small"), F.get(numbers("A"), 0).alias("named"), F.get(numbers("Y"), 0).alias("year"))

        def fields(p: Column) -> Column:
            small, named = p["small"], p["named"]
            day = F.when(named.isNotNull(), F.get(small, 0)).otherwise(F.get(small, 1))
            return F.struct(p["year"].alias("year"), F.coalesce(named, F.get(small, 0)).alias("month"), day.alias("day"))

        def written(p: Column) -> Column:
            year, month, day = p["year"], p["month"], p["day"]
            real = month.isNull() | F.when(day.isNull(), month.between(1, 12)).otherwise(is_real_date(year, month, day))
            return F.when(real, F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))

        return F.when(shape.rlike("^(?:" + "|".join(SHAPES) + ")$"), let(let(parts, fields), written))

    return let(tokens, of)


def precision(canonical: Column) -> Column:
    """year, month or day."""
    return F.when(F.char_length(canonical) == 4, "year").when(F.char_length(canonical) == 7, "month").when(F.char_length(canonical) == 10, "day")


def same_date(a: Column, b: Column) -> Column:
    """Equal at equal precision."""
    return let_both(canonical_date(a), canonical_date(b), lambda x, y: F.coalesce(x == y, F.lit(False)))


def coarser_or_default(old: Column, new: Column) -> Column:
    """Whether the new date only says less than the old one, or adds January 1st to its year."""
    return let_both(canonical_date(old), canonical_date(new), says_less)


def says_less(a: Column, b: Column) -> Column:
    """``coarser_or_default`` of canonical dates."""
    year = F.substring(a, 1, 4)
    first = (b == F.concat(year, F.lit("-01-01"))) & (F.char_length(a) >= 7) & (F.substring(a, 6, 2) != "01")
    return F.coalesce((F.char_length(b) < F.char_length(a)) & a.startswith(b), F.lit(False)) | F.coalesce(first, F.lit(False))


def date_role(role: Column) -> Column:
    """What a date is of: online, accepted, received, record or published."""
    text = F.lower(blank(role))
    return (
        F.when(text.rlike("online|epub|electronic|published_time|e-?pub"), "online")
        .when(text.rlike("accept"), "accepted")
        .when(text.rlike("receiv|submit|접수|투고"), "received")
        .when(text.rlike("creat|deposit|index|access|modif|updat|게시|등록|조회"), "record")
        .otherwise("published")
    )


#: Spans of a text that may be dates: a year with numbers, units, or words around it.
_WORD = "(?:" + "|".join(sorted(map(re.escape, MONTHS), key=len, reverse=True)) + ")"
_YEAR = r"(?:1[4-9]|20)\d{2}"
_GAP = rf"(?:,?\s+|\s*[{re.escape(PARTING)}]\s*)"
SPANS = rf"(?iu)(?<![\p{{L}}\d])(?:{_YEAR}\s*[년年](?:\s*\d{{1,2}}\s*[월月](?:\s*\d{{1,2}}\s*[일日])?)?|{_YEAR}\s*[./-]\s*\d{{1,2}}(?:\s*[./-]\s*\d{{1,2}})?|{_WORD}\.?{_GAP}(?:\d{{1,2}}(?:st|nd|rd|th)?{_GAP})?{_YEAR}|\d{{1,2}}(?:st|nd|rd|th|er)?\.?\s+(?:de\s+)?{_WORD}\.?,?\s+(?:de\s+)?{_YEAR}|{_YEAR})(?![\p{{L}}\d])"
#: Words before a date that say what it is of; the first that fits.
LABELS = {
    "received": "received|submitted|접수|투고",
    "revised": "revised|수정",
    "accepted": "accepted|게재\\s*확정|채택",
    "online": "available online|published online|first online|온라인",
    "published": "published|발행|publication date",
    "accessed": "accessed|retrieved|검색",
    "copyright": "copyright|©",
}
BEFORE = 40


def dates_in_text(text: Column) -> Column:
    """The dates of a text in order: value, precision, place (characters before it) and role, what the words just before say it is of."""
    # Matches and the pieces between them alternate, so a running sum of their lengths gives the places.
    found = F.regexp_extract_all(text, F.lit(SPANS), F.lit(0))
    between = F.split(text, SPANS, -1)

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + F.char_length(x["0"])
        before = F.lower(F.right(F.concat(state["last"], x["0"]), F.lit(BEFORE)))
        role = F.lit(None).cast("string")
        for name, words in reversed(LABELS.items()):
            role = F.when(before.rlike(rf"(?:{words})(?:\s+on)?\s*[:：]?\s*$"), name).otherwise(role)
        each = F.struct(x["1"].alias("raw"), at.cast("int").alias("at"), role.alias("role"))
        grown = F.when(x["1"].isNotNull(), F.concat(state["out"], F.array(each))).otherwise(state["out"])
        return F.struct((at + F.coalesce(F.char_length(x["1"]), F.lit(0))).cast("int").alias("at"), F.coalesce(x["1"], F.lit("")).alias("last"), grown.alias("out"))

    none = F.array().cast("array<struct<raw:string,at:int,role:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), none.alias("out"))
    walked = F.aggregate(F.arrays_zip(between, found), start, step, lambda s: s["out"])
    dated = F.transform(walked, lambda d: let(canonical_date(d["raw"]), lambda v: F.struct(v.alias("value"), precision(v).alias("precision"), d["at"].alias("at"), d["role"].alias("role"))))
    return F.when(F.size(found) > 0, F.filter(dated, lambda d: d["value"].isNotNull())).otherwise(F.array().cast("array<struct<value:string,precision:string,at:int,role:string>>"))
