"""Whether two names are one person's: relations across spellings and scripts, policies on them, and lists of people."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.basics import blank, let, let_both
from quire.functions.names import SURNAMES, initials, person_parts, romanise

#: Latin letters with marks, and the plain letters below them, by Unicode's own decompositions.
MARKED = [chr(c) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0].isascii() and len(unicodedata.normalize("NFD", chr(c))) > 1]
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)
#: Particles of surnames, readings of surnames in Han letters, letters taken for each other.
PARTICLES = ("de", "da", "di", "do", "dos", "del", "della", "der", "den", "van", "von", "la", "le", "du", "el", "al", "bin", "ibn", "ter", "ten")
HAN_SURNAMES = {"金": "김", "李": "이", "朴": "박", "崔": "최", "鄭": "정", "姜": "강", "趙": "조", "尹": "윤", "張": "장", "林": "임", "韓": "한", "吳": "오", "徐": "서", "申": "신", "權": "권", "黃": "황"}
#: Which relations make one person, by purpose.
POLICIES = {
    "link": ("identical", "spelling", "initials", "hanjaReading", "romanised", "romanisedVariant"),
    "bodyLanguage": ("identical", "romanised", "hanRomanised"),
    "hanjaInHangul": ("identical", "hanjaReading"),
    "storedDifference": ("identical", "spelling", "initials", "romanised", "hanjaReading", "romanisedVariant", "transliterationOrder"),
    "bylineMerge": ("identical", "spelling", "initials", "hanjaReading", "romanised", "hanRomanised", "transliterationOrder", "misread", "romanisedVariant"),
    "misreadCorrection": ("misread",),
}
LONGEST = 400


def letters(text: Column) -> Column:
    """Lower-case letters and digits without marks."""
    return F.regexp_replace(F.lower(F.translate(blank(text), "".join(MARKED), PLAIN)), r"[^\p{L}\p{N}]+", "")


def script_of(text: Column) -> Column:
    """hangul, han, kana or latin where a name has one script alone; mixed or none else."""
    has = [blank(text).rlike(p) for p in ("[가-힣]", r"\p{IsHan}", r"[\p{IsHiragana}\p{IsKatakana}]", r"\p{IsLatin}")]
    n = sum((h.cast("int") for h in has[1:]), has[0].cast("int"))
    return F.when(n == 0, "none").when(has[2] & ~has[0] & ~has[3], "kana").when(n > 1, "mixed").when(has[0], "hangul").when(has[1], "han").otherwise("latin")


def romanised_key(text: Column) -> Column:
    """Latin letters with long vowels, however they are written, as short ones."""
    bare = F.regexp_replace(F.lower(F.translate(blank(text), "".join(MARKED), PLAIN)), "[^a-z]+", "")
    return F.regexp_replace(F.regexp_replace(bare, "ou|oo|oh(?![aeiou])", "o"), "uu", "u")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.translate(blank(text), "".join(MARKED), PLAIN)), r"[^\p{L}\p{N}\s,]+", ""), r"[\s,]+"), lambda w: w != "")


def _given_agree(a: Column, b: Column) -> Column:
    """Given names that agree word by word, an initial with any word that it begins; words left over are initials."""
    cut = lambda c: F.filter(F.split(F.lower(F.translate(blank(c), "".join(MARKED), PLAIN)), r"[\s.]+|-"), lambda w: w != "")

    def pair(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        one = lambda p: (p["x"] == p["y"]) | ((F.char_length(p["x"]) == 1) & p["y"].startswith(p["x"])) | ((F.char_length(p["y"]) == 1) & p["x"].startswith(p["y"]))
        both = F.arrays_zip(F.slice(x, F.lit(1), n).alias("x"), F.slice(y, F.lit(1), n).alias("y"))
        longer = F.when(F.size(x) > F.size(y), x).otherwise(y)
        left = F.slice(longer, n + 1, F.greatest(F.lit(0), F.size(longer) - n))
        return (n > 0) & F.forall(both, one) & F.forall(left, lambda w: F.char_length(w) == 1)

    return let_both(cut(a), cut(b), pair)


def syllables(latin: Column) -> Column:
    """How many syllables a romanised name has: its groups of vowels."""
    return F.regexp_count(F.regexp_replace(F.lower(F.translate(blank(latin), "".join(MARKED), PLAIN)), "[^a-z]+", ""), F.lit("[yw]?[aeiou]+"))


def traits(name: Column) -> Column:
    """What ``relation`` compares of a (last, first) name, each worked out once."""

    def of(p: Column) -> Column:
        first = blank(p["first"])
        whole, turned = F.trim(F.concat_ws(" ", p["last"], first)), F.concat_ws(" ", first, p["last"])

        def more(w: Column) -> Column:
            script = script_of(w)
            tight = F.regexp_replace(w, " ", "")
            bare = lambda c: F.array_join(F.filter(_words(c), lambda x: ~x.isin(*PARTICLES)), "")
            korean = person_parts(tight)
            table = F.create_map(*(x for k, v in SURNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
            spellings = F.concat(F.coalesce(F.try_element_at(table, korean["last"]), F.array().cast("array<string>")), F.array(romanise(korean["last"])))
            of_script = lambda kind, c: F.when(script == kind, c)
            return F.struct(
                script.alias("script"), tight.alias("tight"), F.char_length(w).alias("length"), letters(w).alias("letters"), letters(turned).alias("turned"), letters(p["last"]).alias("last"), letters(first).alias("first"), first.alias("given"),
                of_script("latin", bare(p["last"])).alias("bare_last"), of_script("latin", bare(first)).alias("bare_first"), initials(first).alias("initials"), first.rlike(r"^(?:\p{Lu}\.?[\s-]*){1,3}$").alias("only_initials"),
                of_script("latin", romanised_key(w)).alias("key"), of_script("latin", romanised_key(turned)).alias("key_turned"), of_script("latin", F.array_sort(F.transform(_words(w), romanised_key))).alias("keys"),
                of_script("hangul", spellings).alias("spellings"), of_script("hangul", romanise(korean["first"])).alias("given_roman"), of_script("latin", syllables(w)).alias("syllables"),
                F.array_sort(F.filter(F.split(w, r"[\s,]+"), lambda x: x != "")).alias("chunks"),
            )

        return let(whole, more)

    return let(name, of)


def relation(a: Column, b: Column, paired: bool = False, misread: bool = False) -> Column:
    """How two (last, first) names agree, the first that fits: identical, spelling, initials, romanisedVariant,
    romanised, hanjaReading, hanRomanised, transliterationOrder, misread, different or unknown.

    ``paired`` says that their places pair them, without which Han and Latin names can't be compared; ``misread``
    lets names of one script differ by a letter or two.
    """
    return let_both(traits(a), traits(b), lambda x, y: compared(x, y, paired, misread))


def compared(x: Column, y: Column, paired: bool = False, misread: bool = False) -> Column:
    """``relation`` of two names' traits."""
    is_ = lambda k, n: (x["script"] == k) & (y["script"] == n)
    latin = is_("latin", "latin")
    spelling = latin & (x["first"] != "") & (y["first"] != "") & (x["bare_last"] != "") & (x["bare_last"] == y["bare_last"]) & (x["bare_first"] == y["bare_first"])
    short = (x["only_initials"] | y["only_initials"]) & (x["initials"] == y["initials"])
    abbreviated = latin & (x["last"] != "") & (x["last"] == y["last"]) & ((x["first"] == "") | (y["first"] == "") | short | _given_agree(x["given"], y["given"]))
    variant = latin & (x["key"] != "") & ((x["key"] == y["key"]) | (x["key"] == y["key_turned"]) | (x["keys"] == y["keys"]))

    def spelled(k: Column, r: Column) -> Column:
        """Whether a Latin name, in either order, spells a Korean one."""
        straight = F.array_contains(k["spellings"], r["last"]) & (k["given_roman"] == r["first"])
        return straight | (F.array_contains(k["spellings"], r["first"]) & (k["given_roman"] == r["last"]))

    romanised = (is_("hangul", "latin") & spelled(x, y)) | (is_("latin", "hangul") & spelled(y, x))
    table = F.create_map(*(F.lit(v) for pair in HAN_SURNAMES.items() for v in pair))
    read = lambda h, k: (F.try_element_at(table, F.left(h["tight"], F.lit(1))) == F.left(k["tight"], F.lit(1))) & (F.char_length(h["tight"]) == F.char_length(k["tight"]))
    mixed = is_("han", "hangul") | is_("hangul", "han")
    reading = F.coalesce((is_("han", "hangul") & read(x, y)) | (is_("hangul", "han") & read(y, x)), F.lit(False))
    seated = (x["script"].isin("han", "kana") & (y["script"] == "latin")) | (y["script"].isin("han", "kana") & (x["script"] == "latin"))
    n = F.char_length(F.when(x["script"] == "latin", y["tight"]).otherwise(x["tight"]))
    by_seat = F.when(F.coalesce(x["syllables"], y["syllables"]).between(n, 3 * n), "hanRomanised").otherwise("different") if paired else F.lit("unknown")
    order = is_("hangul", "hangul") & (F.size(x["chunks"]) >= 2) & (x["chunks"] == y["chunks"])
    out = (
        F.when((x["letters"] == "") | (y["letters"] == "") | (x["length"] > LONGEST) | (y["length"] > LONGEST), "unknown")
        .when((x["letters"] == y["letters"]) | (x["letters"] == y["turned"]), "identical").when(spelling, "spelling").when(abbreviated, "initials").when(variant, "romanisedVariant")
        .when(F.coalesce(romanised, F.lit(False)), "romanised").when(mixed, F.when(reading, "hanjaReading").otherwise("different")).when(seated, by_seat).when(order, "transliterationOrder")
    )
    if misread:
        most = F.when(F.char_length(x["letters"]) >= 8, 2).otherwise(1)
        digits = x["letters"].rlike(r"\d") | y["letters"].rlike(r"\d")
        out = out.when((x["script"] == y["script"]) & ~x["script"].isin("none", "mixed") & ~digits & (F.levenshtein(x["letters"], y["letters"]) <= most), "misread")
    return out.otherwise("different")


def same_name(a: Column, b: Column, policy: str, paired: bool = False, misread: bool = False) -> Column:
    """Whether two names are one person's for a purpose."""
    return relation(a, b, paired, misread or policy == "misreadCorrection").isin(*POLICIES[policy])


def once_per_person(people: Column, prefer: str | None = None) -> Column:
    """An array of (last, first) without those who stand in it before in another script; of the two, the one in ``prefer`` stays."""
    dressed = F.transform(people, lambda p: F.struct(p.alias("p"), traits(p).alias("t")))

    def step(kept: Column, new: Column) -> Column:
        own = new["t"]["script"]
        same = lambda q: (q["t"]["script"] != own) & compared(q["t"], new["t"]).isin("romanised", "hanjaReading")
        met = F.exists(kept, same)
        placed = F.transform(kept, lambda q: F.when((own == prefer) & same(q), new).otherwise(q)) if prefer else kept
        return F.when(met, placed).otherwise(F.concat(kept, F.array(new)))

    return let(dressed, lambda all_: F.transform(F.aggregate(all_, F.slice(all_, 1, 0), step), lambda x: x["p"]))


def paired_by_line(people: Column) -> Column:
    """Pairs of the i-th Korean and the i-th Latin name of an array of (last, first, role), if the list is made so; else none.

    All Korean names come before the Latin ones, there are as many of both, at least two, of equal roles; at least
    all but one pair read alike, two or more, and no name reads like one of another place.
    """
    dressed = F.transform(people, lambda p: F.struct(p.alias("p"), traits(p).alias("t")))

    def of(all_: Column) -> Column:
        n = F.size(all_).cast("int") / 2
        half = F.floor(n).cast("int")
        korean, roman = F.slice(all_, F.lit(1), half), F.slice(all_, half + 1, half)
        ordered = (n == half) & F.forall(korean, lambda x: x["t"]["script"] == "hangul") & F.forall(roman, lambda x: x["t"]["script"] != "hangul")
        read = F.flatten(F.transform(korean, lambda k, i: F.transform(roman, lambda r, j: F.when(compared(k["t"], r["t"]) == "romanised", i == j))))
        both = F.arrays_zip(korean.alias("k"), roman.alias("r"))
        roles = F.forall(both, lambda x: x["k"]["p"]["role"].eqNullSafe(x["r"]["p"]["role"]))
        whole = lambda x: F.concat_ws(" ", x["p"]["last"], x["p"]["first"])
        named = F.transform(both, lambda x: F.struct(whole(x["k"]).alias("korean"), whole(x["r"]).alias("latin")))

        def judged(found: Column) -> Column:
            hits = F.size(F.filter(found, lambda x: x))
            good = (hits >= 2) & (hits >= half - 1) & ~F.exists(found, lambda x: ~x)
            return F.when((half >= 2) & ordered & roles & good, named)

        return let(F.array_compact(read), judged)

    return F.coalesce(let(dressed, of), F.array().cast("array<struct<korean:string,latin:string>>"))


def _byline(text: Column) -> Column:
    return F.filter(F.transform(F.split(blank(text), r"[;；\n]"), F.trim), lambda n: n != "")


def partial_byline(held: Column, offered: Column) -> Column:
    """Whether a byline is part of another: every name of it is there, and the other has more, or longer forms."""
    dressed = lambda text: F.transform(_byline(text), lambda n: F.struct(n.alias("n"), traits(person_parts(n)).alias("t")))

    def of(a: Column, b: Column) -> Column:
        same = lambda x, y: compared(x["t"], y["t"]).isin(*POLICIES["bylineMerge"])
        matched = F.forall(a, lambda x: F.exists(b, lambda y: same(x, y)))
        each = F.arrays_zip(a.alias("x"), b.alias("y"))
        longer = F.forall(each, lambda p: same(p["x"], p["y"])) & F.exists(each, lambda p: F.char_length(p["x"]["n"]) < F.char_length(p["y"]["n"]))
        return F.when((F.size(a) == 0) | (F.size(b) < F.size(a)), False).when(F.size(b) > F.size(a), matched).otherwise(longer)

    return let_both(dressed(held), dressed(offered), of)


def fullest_byline(bylines: Column) -> Column:
    """Of bylines in order, the first, replaced by each later one that it is part of."""
    return F.aggregate(bylines, F.lit(""), lambda held, b: F.when(F.trim(blank(b)) == "", held).when((held == "") | partial_byline(held, b), F.trim(b)).otherwise(held))
