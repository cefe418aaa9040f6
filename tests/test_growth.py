"""How queries grow: what their plans may hold, and inputs on which forms that don't grow well or hold few letters go wrong."""

from __future__ import annotations

import shutil

import oracle
import pytest

from quire.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_exploded_fields_are_not_broadcast(spark, small):
    assert "BroadcastExchange" not in plan(catalogue.QUERIES["record_changes"](spark, small))


def test_combined_texts_with_sharp_s(spark, small, tmp_path):
    for name in oracle.TABLES:
        shutil.copy(f"{small}/{name}.parquet", tmp_path)
    (tmp_path / "benchmark.parquet").chmod(0o644)
    rows = [(2, "Die Straße ist weiß und groß"), (3, "Straße"), (7, "ß"), (12, "")]
    spark.createDataFrame(rows, "item_id bigint, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    con = oracle.connect(str(tmp_path))
    assert oracle.difference(catalogue.QUERIES["combined_texts"](spark, str(tmp_path)), con, catalogue.ORACLE["combined_texts"]) == ""


def test_pairs_are_scored_once_for_each_pair_of_classes(spark, small):
    # The sets of bigrams stand beside the classes, below the join, and the pairs are dealt over as many tasks as the session has.
    for name in ("bigram_dice_parts", "author_overlaps"):
        text = plan(catalogue.QUERIES[name](spark, small))
        assert "collect_list" in text and "_piece" in text and "CartesianProduct" not in text


def test_class_pairs_with_parts_repeated_members_and_nulls(spark):
    from itertools import combinations

    from pyspark.sql import functions as F

    from quire.operators import joins

    rows = [(k % 2, "abc"[k % 3], k // 2) for k in range(40)] + [(0, None, 50), (None, "a", 51), (0, "b", None)]
    df = spark.createDataFrame(rows, "key int, value string, id int")
    got = joins.class_pairs(df, ["key"], "value", "id", F.col("value"), lambda x, y: x == y, most=3)
    kept = [r for r in rows if r[0] is not None and r[2] is not None]
    want = [(min(x[2], y[2]), max(x[2], y[2]), None if None in (x[1], y[1]) else x[1] == y[1]) for x, y in combinations(kept, 2) if x[0] == y[0] and x[2] != y[2]]
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_houses_are_read_below_the_join(spark, small):
    text = plan(catalogue.QUERIES["publisher_equality"](spark, small)).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "publishing" not in text.split("Join", 1)[0]


def test_passes_read_their_answers_once(spark, small):
    text = plan(catalogue.QUERIES["restore_passes"](spark, small)).split("== Physical Plan ==")[1]
    assert text.count("l_returnflag") > 0 and text.count("lineitem.parquet") == 1


@pytest.mark.parametrize("name", ["people_once", "fullest_bylines", "name_policies", "creators_paired_by_line"])
def test_equal_names_are_compared_once(spark, small, name):
    text = plan(catalogue.QUERIES[name](spark, small)).split("== Optimized Logical Plan ==")[1]
    assert "eqNullSafe" in text or "<=>" in text


def test_page_patterns_are_fixed(spark, small):
    assert "RLIKE concat(" not in plan(catalogue.QUERIES["start_pages"](spark, small))


@pytest.mark.parametrize(
    ("page", "printed"),
    [("pp. 12–20", "12-20"), ("pp. 1012–20", None), ("pp. 12.12–20", None), ("pp. 12–20–30", "12-20"), ("12 - 20", "12-20"), ("pp. 12–201", None), ("13, 12–20", None), ("13–20, 12–20", None), ("", None), (None, None)],
)
def test_start_pages(spark, page, printed):
    from pyspark.sql import functions as F

    from quire.functions import statements

    df = spark.createDataFrame([("12-20", "13-20", page, 9)], "stored string, read string, page string, extent int")
    row = df.select(statements.start_page_printed(*map(F.col, ("read", "page", "extent"))).alias("p"), statements.start_page_not_printed(*map(F.col, ("stored", "read", "page", "extent"))).alias("n")).first()
    assert row["p"] == printed and row["n"] == (printed is not None)


def test_notes_on_editions_are_one_pattern(spark, small):
    assert plan(catalogue.QUERIES["evaluated_rows"](spark, small)).split("== Physical Plan ==")[1].count("StartsWith") <= 1


def test_letters_are_counted_without_arrays(spark, small):
    assert "regexp_count" not in plan(catalogue.QUERIES["dominant_scripts"](spark, small))


def test_lines_are_counted_without_windows(spark, small):
    text = plan(catalogue.QUERIES["document_titles"](spark, small)).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "windowspecdefinition(doc_id" in text and "doc_id#" in text and " count(1) windowspecdefinition" not in text


def test_only_words_are_looked_up_as_months(spark, small):
    text = plan(catalogue.QUERIES["date_and_locator_validity"](spark, small)).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert text.count("try_element_at") <= 2 or text.count("element_at") <= 2


def test_identifiers_are_widened_without_folds(spark, small):
    assert "aggregate(sequence" not in plan(catalogue.QUERIES["registry_by_isbn"](spark, small))
