"""Operators on small tables with ties, gaps and empty inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.operators import aggregates, joins, windows
from quire.plans import relational, scalars
from quire.sources import sinks, tables
from quire.streaming import events


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_islands(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 4), ("a", 5), ("b", None)], "k string, at long")
    assert rows(windows.islands(df, ["k"], "at"), "k", "first", "last", "length") == [("a", 1, 2, 2), ("a", 4, 5, 2)]
    assert rows(windows.longest_island(df, ["k"], "at"), "k", "first") == [("a", 1)]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 9), ("a", 4, 5), ("a", 9, 10), ("a", 12, 13)], "k string, s int, e int")
    assert rows(windows.interval_union(df, ["k"], "s", "e"), "start", "end", "parts") == [(1, 10, 4), (12, 13, 1)]


def test_range_join_meets_each_pair_once(spark):
    points = spark.createDataFrame([("a", 5), ("a", 16), ("b", 5)], "k string, p int")
    spans = spark.createDataFrame([("a", 0, 40), ("a", 5, 5), ("b", 6, 9)], "k string, s int, e int")
    assert rows(joins.range_join(points, spans, ["k"], "p", "s", "e", 8), "p", "s", "e") == [(5, 0, 40), (5, 5, 5), (16, 0, 40)]


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("a", 5, "z")], "k string, u int, v string")
    assert rows(joins.as_of(left, right, ["k"], "t", "u", ["v"]).fillna("-"), "k", "t", "v") == [("a", 1, "-"), ("a", 5, "y"), ("b", 9, "-")]


def test_field_diff_takes_null_for_empty(spark):
    before = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (1, "c", "y")], "k int, f string, v string")
    after = spark.createDataFrame([(1, "a", ""), (1, "b", "z"), (1, "d", "n")], "k int, f string, v string")
    assert rows(joins.field_diff(before, after, "k", "f", "v"), "f", "kind") == [("b", "changed"), ("c", "cleared"), ("d", "added")]


def test_greedy_matching_uses_each_name_once(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c", "d"]), ([], ["a"]), (["a"], ["a"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(joins.creators_differ(F.col("x"), F.col("y"))).collect()] == [True, False, False]


def test_keep_latest_and_rivals(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.87), ("a", 3, 0.2), ("b", 4, 0.5)], "k string, i int, s double")
    assert rows(windows.keep_latest(df, ["k"], F.col("i").desc(), extra="more"), "k", "i", "more") == [("a", 3, 2), ("b", 4, 0)]
    assert rows(windows.rivals(df, ["k"], "s", 0.05, "i"), "i", "rival") == [(1, True), (2, True), (3, False), (4, False)]


def test_state_counts_of_nothing(spark):
    empty = spark.createDataFrame([], "s string")
    assert aggregates.state_counts(empty, F.col("s"), ["x", "y"]).first().asDict() == {"x": 0, "y": 0, "total": 0, "consistent": True}


def test_guarded_apply_and_undo(spark):
    records = spark.createDataFrame([(1, {"t": "a", "n": "x"}), (2, {"t": "b"})], "key int, fields map<string,string>")
    prints = {r[0]: r[1] for r in records.select("key", sinks.fingerprint()).collect()}
    changes = spark.createDataFrame([(1, prints[1], {"t": "A", "n": ""}), (2, "stale", {"t": "B"})], "key int, expected string, new map<string,string>")
    written, refused = sinks.apply_changes(records, changes)
    found = {r["key"]: r for r in written.collect()}
    assert found[1]["fields"] == {"t": "A"} and found[1]["was"] == {"t": "a", "n": "x"} and found[2]["fields"] == {"t": "b"}
    assert [r["key"] for r in refused.collect()] == [2]
    applied = written.where("was is not null").select("key", "was", sinks.fingerprint().alias("after"))
    restored, conflicts = sinks.undo(written.select("key", "fields"), applied)
    assert {r["key"]: r["fields"] for r in restored.collect()}[1] == {"t": "a", "n": "x"}
    assert conflicts.count() == 0


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, True, "x" * 20_013), (2, False, "y"), (3, None, "z")], "id int, checked boolean, text string")
    assert sinks.export_selected(df, str(tmp_path / "out"), ["text"]) == 1
    text = spark.read.json(str(tmp_path / "out")).first()["text"]
    assert text.endswith("…[13 characters omitted]") and len(text) == 20_000 + len("…[13 characters omitted]")
    with pytest.raises(ValueError, match="no row"):
        sinks.export_selected(df.where("id = 2"), str(tmp_path / "none"), ["text"])


def test_any_stretch_of_all_hits_counts(spark):
    far = "the " + "x" * 500
    df = spark.createDataFrame([(1, 0, far + " the big and the thing"), (1, 1, far + " and thing"), (2, 0, "x"), (3, 0, None)], "conv_id long, turn int, text string")
    found = scalars.span_cover_all_hits(lambda name: df)
    assert rows(found, "conv_id", "turn", "covered", "supported") == [(1, 0, 3, True), (1, 1, 2, False)]


def test_export_takes_all_rows(spark):
    df = spark.createDataFrame([(3, "en", "x" * 20_013), (4, "fr", "y" * 20_013), (6, "en", "z" * 6_000)], "doc_id long, lang string, text string")
    found = {r["doc_id"]: r["text"] for r in relational.export_all_rows(lambda name: df).collect()}
    assert found == {3: "x" * 20_000 + "…[13 characters omitted]", 4: "y" * 20_013, 6: "z" * 6_000}


def test_all_items_get_lookups(spark):
    tables_ = {
        "orders": spark.createDataFrame([(1, 7, 10.0), (2, 7, 400_000.0), (3, 8, 10.0)], "o_orderkey long, o_custkey long, o_totalprice double"),
        "customer": spark.createDataFrame([(7, "c", 1)], "c_custkey long, c_name string, c_nationkey int"),
        "nation": spark.createDataFrame([(1, "n")], "n_nationkey int, n_name string"),
    }
    found = relational.all_attachments_with_lookups(tables_.get)
    assert rows(found, "o_orderkey", F.coalesce("customer", F.lit("")), F.coalesce("nation", F.lit(""))) == [(1, "c", "n"), (2, "c", "n"), (3, "", "")]


def test_short_items_are_looked_up(spark):
    tables_ = {
        "documents": spark.createDataFrame([(1, "one two three four"), (2, "stone two"), (3, None), (4, "?!")], "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(1, "one"), (2, "one two"), (3, "one two three"), (4, "?!"), (5, None), (6, "absent"), (7, "")], "item_id long, text string"),
    }
    assert rows(scalars.benchmark_containment(tables_.get), "item_id", "documents") == [(1, 2), (2, 2), (3, 1), (4, 1), (5, 0), (6, 0), (7, 3)]


def test_blocked_pairs_come_once_with_their_shared_tokens(spark):
    left = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, None)], "k int, w array<string>")
    right = spark.createDataFrame([(7, ["b", "a"]), (8, ["a"]), (9, ["d"])], "k int, w array<string>")
    assert rows(joins.blocked_pairs(left, right, "k", "w"), "left_key", "right_key", "shared") == [(1, 7, 2), (1, 8, 1)]
    assert rows(joins.blocked_pairs(left, right, "k", "w", 1), "left_key", "right_key", "shared") == [(1, 7, 1)]


def test_corrupt_json_is_kept(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n{"a": \n')
    found = tables.json_rows(spark, str(tmp_path), "a int").cache()
    assert sorted((r["a"] is None, r["_corrupt"] is None) for r in found.collect()) == [(False, True), (True, False)]


def test_files_and_fixtures(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert tables.whole_texts(spark, str(tmp_path)).first()["text"] == "one\ntwo"
    print_ = tables.file_fingerprints(spark, str(tmp_path)).first()["fingerprint"]
    df = spark.createDataFrame([(print_, print_), (print_, "x")], "a string, b string")
    assert [r[0] for r in df.select(tables.same_file(F.col("a"), F.col("b"))).collect()] == [True, False]
    urls = spark.createDataFrame([("http://a/1",), ("http://b/2",)], "url string")
    fixtures = spark.createDataFrame([(1, "/1$", True, "first"), (2, "http", False, "any")], "ordinal int, match string, is_regex boolean, body string")
    assert rows(tables.fixtures_for(urls, fixtures), "url", "body") == [("http://a/1", "first"), ("http://b/2", "any")]


def test_stream_counts_match_batch(spark, small):
    stream = events.read_events(spark, small)
    out = events.run_to_end(events.windowed_counts(stream, "1000 days", "1 day"), spark, "counts", "complete")
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()


def test_stream_budgets(spark, tmp_path):
    calls = [("p", i, "record", None) for i in range(8)] + [("q", 0, "blocked", None), ("q", 1, "record", None), ("r", 0, "rateLimited", 5), ("r", 3, "record", None), ("r", 6, "record", None)]
    spark.createDataFrame(calls, "provider string, at long, kind string, wait_ms long").write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema("provider string, at long, kind string, wait_ms long").parquet(str(tmp_path / "calls"))
    out = events.run_to_end(events.budgets(stream), spark, "budgets")
    got = {}
    for r in out.orderBy("provider", "at").collect():
        got.setdefault(r["provider"], []).append(r["admitted"])
    assert got == {"p": [True] * 6 + [False] * 2, "q": [True, False], "r": [True, False, True]}


def test_places_over_many_ranges(spark, monkeypatch):
    from quire.operators import windows

    monkeypatch.setattr(windows, "RANGE_ROWS", 7)
    df = spark.createDataFrame([(i, i * 37 % 50) for i in range(200)], "k int, v int")
    got = {r["k"]: r["place"] for r in windows.in_order(df, F.col("v"), "k").collect()}
    order = sorted(range(200), key=lambda i: (i * 37 % 50, i))
    assert got == {k: n for n, k in enumerate(order, 1)}


def test_most_words_in_a_stretch(spark):
    import itertools
    import random

    from quire.operators import windows

    random.seed(5)
    rows = [(k, s, s + len(w), w) for k in range(20) for w in ("aa", "bbb", "c") for s in random.sample(range(400), random.randint(0, 6))]
    df = spark.createDataFrame(rows, "k int, s int, e int, w string")
    got = {r["k"]: r["covered"] for r in windows.span_cover(df, ["k"], "s", "e", "w", 3).collect()}
    reach = 83
    want = {k: max(len({w for _, s, e, w in g if s >= at - reach and e <= at}) for _, _, at, _ in g) for k, g in ((k, list(g)) for k, g in itertools.groupby(rows, lambda r: r[0]))}
    assert got == want
