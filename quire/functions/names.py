"""Personal names, also across scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.basics import blank, let

#: Romanised spellings of a syllable's three parts, and common spellings of surnames.
INITIALS = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
MEDIALS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
FINALS = ("", "k", "k", "ks", "n", "nj", "nh", "t", "l", "lk", "lm", "lb", "ls", "lt", "lp", "lh", "m", "p", "ps", "t", "t", "ng", "t", "t", "k", "t", "p", "h")
SURNAMES = {
    "김": ("kim", "gim"), "이": ("lee", "yi", "rhee", "i", "ee", "li", "rhie"), "박": ("park", "pak", "bak", "bahk"), "최": ("choi", "choe", "che", "chwe"),
    "정": ("jung", "jeong", "chung", "cheong", "chong"), "강": ("kang", "gang"), "조": ("cho", "jo", "joe"), "윤": ("yoon", "yun", "youn", "yune"),
    "장": ("jang", "chang"), "임": ("im", "lim", "rim", "yim"),
}
FIRST = 0xAC00


def characters(text: Column) -> Column:
    """A text's characters, in order."""
    return let(blank(text), lambda t: F.when(F.char_length(t) > 0, F.transform(F.sequence(F.lit(1), F.char_length(t)), lambda i: F.substring(t, i, 1))).otherwise(F.array().cast("array<string>")))


def _spelled(code: Column) -> Column:
    part = lambda table, at: F.get(F.array(*map(F.lit, table)), at.cast("int"))
    return F.concat(part(INITIALS, F.floor(code / 588)), part(MEDIALS, F.floor(code % 588 / 28)), part(FINALS, code % 28))


def romanise(text: Column) -> Column:
    """Syllables in Latin letters, everything else in lower case."""
    one = lambda c: let(F.ascii(c) - FIRST, lambda k: F.when(k.between(0, 11171), _spelled(k)).otherwise(F.lower(c)))
    return F.array_join(F.transform(characters(text), one), "")


def jamo(syllable: Column) -> Column:
    """The numbers of a syllable's initial, medial and final; null for other characters."""
    code = F.ascii(blank(syllable)) - FIRST
    parts = F.struct(F.floor(code / 588).cast("int").alias("initial"), F.floor(code % 588 / 28).cast("int").alias("medial"), (code % 28).cast("int").alias("final"))
    return F.when(code.between(0, 11171), parts)


def syllables_by_spelling(spark: SparkSession) -> DataFrame:
    """Each spelling with all syllables that have it: 11 172 in all, so it may be broadcast."""
    rows = spark.range(11172).select(_spelled(F.col("id")).alias("latin"), "id")
    syllable = F.decode(F.unhex(F.concat(F.hex(0xE0 + F.shiftright(F.col("id") + FIRST, 12)), F.hex(0x80 + F.shiftright(F.col("id") + FIRST, 6).bitwiseAND(63)), F.hex(0x80 + (F.col("id") + FIRST).bitwiseAND(63)))), "UTF-8")
    return rows.select("latin", syllable.alias("syllable")).groupBy("latin").agg(F.array_sort(F.collect_list("syllable")).alias("syllables"))


def surname_spelled(hangul: Column, latin: Column) -> Column:
    """Whether a Latin surname is a usual or the regular spelling of a Korean one."""
    table = F.create_map(*(x for k, v in SURNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.array_contains(F.try_element_at(table, blank(hangul)), F.lower(latin)), F.lit(False)) | (romanise(hangul) == F.lower(latin))


def person_parts(name: Column) -> Column:
    """Last and first name: around a comma; else the last word last; a Korean name's first syllable first."""
    text = F.trim(F.regexp_replace(blank(name), r"\s+", " "))
    comma = F.split(text, r"\s*,\s*", 2)
    words = F.split(text, " ")
    korean = text.rlike("^[가-힣]{2,4}$")
    last = F.when(text.contains(","), F.get(comma, 0)).when(korean, F.left(text, F.lit(1))).otherwise(F.element_at(words, -1))
    first = (
        F.when(text.contains(","), F.get(comma, 1)).when(korean, F.substring(text, F.lit(2), F.char_length(text)))
        .otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - 1)), " "))
    )
    return F.struct(last.alias("last"), first.alias("first"))


def initials(given: Column) -> Column:
    """The first letters of given names, in lower case."""
    return F.array_join(F.transform(F.filter(F.split(blank(given), r"[\s.\-]+"), lambda w: w != ""), lambda w: F.lower(F.left(w, F.lit(1)))), "")


def name_relation(a: Column, b: Column) -> Column:
    """How two (last, first) names agree: same, initials, swapped, otherScript, surnameOnly, different or unknown."""
    fold = lambda c: F.regexp_replace(F.lower(blank(c)), r"[^\p{L}]+", "")
    al, af, bl, bf = fold(a["last"]), fold(a["first"]), fold(b["last"]), fold(b["first"])
    ai, bi = initials(a["first"]), initials(b["first"])
    shortened = ((F.char_length(af) <= 3) & bi.startswith(af)) | ((F.char_length(bf) <= 3) & ai.startswith(bf))
    korean = lambda c: c.rlike("^[가-힣]+$")
    across = (korean(al) & ~korean(bl) & surname_spelled(al, bl) & (romanise(af) == bf)) | (korean(bl) & ~korean(al) & surname_spelled(bl, al) & (romanise(bf) == af))
    return (
        F.when((al == "") | (bl == ""), "unknown")
        .when((al == bl) & (af == bf), "same")
        .when(across, "otherScript")
        .when((al == bf) & (af == bl), "swapped")
        .when((al == bl) & ((af == "") | (bf == "")), "surnameOnly")
        .when((al == bl) & shortened, "initials")
        .otherwise("different")
    )
