"""Column expressions on text that several operators share; all run in the JVM."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"[\x20\x09-\x0D]+"
#: Everything in ASCII that is neither a digit nor a letter a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts that still have capital letters.
SEPARATORS_OF_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once.

    The optimiser puts an expression wherever its column is used, inside lambdas
    too, where it would run again for every element; a lambda's own variable is
    evaluated before.
    """
    return F.get(F.transform(F.array(value), then), 0)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are.

    Characters are looked up one by one, which is slow, only in texts that have
    capital letters beyond ASCII.
    """
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(OTHER_CAPITALS)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def pieces(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of ``separators``; null has none."""
    return F.array_remove(F.split(text_or_empty(text), separators), "")


def piece_count(text: Column, separators: str) -> Column:
    """How many pieces ``pieces`` gives."""

    def inner(found: Column) -> Column:
        return F.size(found) - (F.get(found, 0) == "").cast("int") - ((F.element_at(found, -1) == "") & (F.size(found) > 1)).cast("int")

    return let(F.split(text_or_empty(text), separators), inner)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII whitespace, as long."""
    return piece_count(text, WHITESPACE).cast("long")


def shingle_hashes(words: Column, width: int) -> Column:
    """A 64-bit hash of every run of ``width`` words, in order, repeats kept.

    Fewer words than ``width`` count as one shingle; no words give no hash.
    """

    def hashed(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
        few = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(n >= width, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashed)
