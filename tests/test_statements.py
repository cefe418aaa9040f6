"""Statements and people that need no table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import people, statements
from quire.functions.names import person_parts
from quire.operators import stages

ENGLISH = "the cost of this is that we have been in the house where these were made and by which others can be seen as it was with more to come for all of us at an end or the start"


def test_shifted_letters_come_back():
    moved = "".join(chr(ord(c) - 3) if c != " " else c for c in ENGLISH)
    assert statements.repaired_shift(moved) == ENGLISH
    assert statements.repaired_shift(ENGLISH) == ENGLISH
    assert statements.repaired_shift("too short") == "too short"
    assert statements.repaired_shift("") == ""


def test_accents_come_to_their_letters():
    cases = {"Cr´ eme": "Cr´ eme", "r´esum´e": "résumé", "Mu¨ller": "Müller", "fa¸cade": "façade", "a `b": "a `b", "n ̃o": "nõ", "Ko ̈nig": "König", "´": "´", "": ""}
    assert {k: statements.attached_accents(k) for k in cases} == cases


def relation(spark, a, b, **options):
    pair = spark.range(1).select(person_parts(F.lit(a)).alias("a"), person_parts(F.lit(b)).alias("b"))
    return pair.select(people.relation(F.col("a"), F.col("b"), **options)).first()[0]


def test_names_that_only_a_setting_relates(spark):
    assert relation(spark, "Johnson, Peter", "Johnsen, Peter", misread=True) == "misread"
    assert relation(spark, "Smith, John", "Brown, John", misread=True) == "different"
    assert relation(spark, "山田太郎", "Yamada, Taro", paired=True) == "hanRomanised"
    assert relation(spark, "山田太郎", "Li, X", paired=True) == "different"


def test_dropping_what_attempts_leave(spark):
    rows = spark.createDataFrame([(1, "done", "x", "y")], "id int, status string, error string, kept string")
    assert stages.reset_attempts(rows).collect()[0].asDict() == {"id": 1, "status": "pending", "kept": "y", "checked": False, "changes": []}


def test_a_job_appears_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "ok"), (2, "b", "ok")], "id int, title string, status string")
    stages.write_job(rows, str(tmp_path), "id", 7)
    assert {r["id"] for r in spark.read.json(f"{tmp_path}/job=7/manifest").collect()} == {1, 2}


def test_regions_at_the_ends(spark):
    cases = [("abcdef", [(0, 2)]), ("abcdef", [(4, 6), (1, 2)]), ("abcdef", []), ("abcdef", [(0, 6)]), ("abcdef", [(1, 3), (2, 5)])]
    df = spark.createDataFrame(cases, "t string, r array<struct<start:int,end:int>>")
    got = [r[0] for r in df.select(statements.without_regions(F.col("t"), F.col("r"))).collect()]
    assert got == ["\ncdef", "a\ncd\n", "abcdef", "\n", "a\nf"]
