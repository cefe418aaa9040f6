"""Each operator against its brute-force version and over odd tables."""

from __future__ import annotations

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import (
    decontaminate,
    fingerprints,
    mixing,
    secret_scan,
    separator_scan,
    simhash,
    storage,
    token_output,
    tokenizing,
    toxicity,
    url_filter,
    warc,
)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# Secret scans


def versions(df):
    return df.withColumnRenamed("doc_id", "path").withColumn("version", F.lit(1))


def test_secrets(spark, odd):
    found = secret_scan.scan_versions(versions(odd), storage.scratch(spark, "ledger")).collect()
    want = sorted((str(k), brute.secrets(t)["spans"]) for k, t in texts(odd))
    assert sorted((str(r["path"]), ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in r["findings"])) for r in found) == want


SECRETS = ["token: abc", "secret=token: abcdefgh", "API_KEY='xyzxyz'", "password==a1b2c3d4", "AKIA" + "Z" * 16, "AKIA" + "Z" * 15, "é" + "0a" * 12, "ab" * 11, "Token\n=abcdefg"]


def test_secret_patterns(spark):
    rows = [(i, t + " " + u) for i, (t, u) in enumerate((t, u) for t in SECRETS for u in SECRETS)]
    df = spark.createDataFrame(rows, "path long, text string").withColumn("version", F.lit("v"))
    got = secret_scan.scan_versions(df, storage.scratch(spark, "ledger")).select("path", secret_scan.spans_text(F.col("findings"))).collect()
    assert dict(map(tuple, got)) == {i: brute.secrets(t)["spans"] for i, t in rows}


def test_ledger_scans_only_what_is_new(spark, docs):
    ledger = storage.scratch(spark, "ledger")
    secret_scan.scan_versions(versions(docs.where("doc_id < 6")), ledger).collect()
    before = secret_scan.read_ledger(spark, ledger).count()
    assert before == 3 * 3  # three rules; documents 1 and 4 are one blob, as are 2 and 3
    secret_scan.scan_versions(versions(docs.where("doc_id < 6")), ledger).collect()
    assert secret_scan.read_ledger(spark, ledger).count() == before
    newer = (*secret_scan.BASE_RULES[:2], secret_scan.Rule("hex", "[0-9a-f]{24,}", version=2))
    secret_scan.scan_versions(versions(docs.where("doc_id < 6")), ledger, newer).collect()
    assert secret_scan.read_ledger(spark, ledger).count() == before + before // 3


@pytest.mark.parametrize("most", [200_000, 0])
def test_versions_that_share_path_and_number(spark, most):
    ledger = storage.scratch(spark, "ledger")
    rows = [("p", 1, f"token: secret{k:06d}") for k in range(300)] + [(None, None, "token: secret000000")] * 5
    df = spark.createDataFrame(rows, "path string, version int, text string").repartition(5)
    found = secret_scan.scan_versions(df, ledger, most=most).collect()
    assert len(found) == 305 and all(len(r["findings"]) == 1 for r in found)
    assert spark.read.schema(secret_scan.LEDGER).option("recursiveFileLookup", True).parquet(ledger).count() == 900


def test_secrets_of_nothing(spark, nothing):
    assert secret_scan.scan_versions(versions(nothing), storage.scratch(spark, "ledger")).count() == 0


# Separator scan


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_separators_across_blocks(spark, tmp_path, block):
    files, want = [], []
    for part, ids in enumerate(([5, 6, 9, 9, 7, 9], [1, 2, 3, 4, 5, 6, 7, 8], [9], [4, 9, 1, 1])):
        path = tmp_path / f"{part}.bin"
        path.write_bytes(np.array(ids, dtype="<u2").tobytes())
        files.append((f"file://{path}", part, len(ids)))
        start, ordinal = 0, 0
        for i, x in enumerate(ids):
            if x == 9 or i == len(ids) - 1:
                want.append((part, ordinal, start, i - start + 1, x == 9))
                start, ordinal = i + 1, ordinal + 1
    df = spark.createDataFrame(files, "file string, part int, ids long")
    got = separator_scan.scan_separators(df, (9,), "<u2", block).select("part", "ordinal", "start", "n_tokens", "ended").collect()
    assert sorted(map(tuple, got)) == want


def test_counted_tokens(spark, odd):
    got = separator_scan.count_tokens(odd, block=1000).collect()
    want = brute.tokens([(i, t) for i, (_, t) in enumerate(texts(odd))], tokenizing.default_path(), separator_scan.END)
    assert sorted(r["n_tokens"] for r in got) == sorted(n for _, n, _ in want.values())
    assert all(r["ended"] for r in got)


def test_counted_tokens_of_nothing(nothing):
    assert separator_scan.count_tokens(nothing).count() == 0


# Fingerprints


def test_edited_fingerprints(docs):
    got = {r["doc_id"]: r for r in fingerprints.edited_with_next(docs).withColumn("e", F.sha2("edited", 256)).withColumn("near", fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch"))).collect()}
    want = brute.edited(texts(docs))
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k]["n_chars"], got[k]["e"]) == (w["n_chars"], w["edited_sha256"])
        assert abs(got[k]["near"] - w["near_edited"]) < 0.15


def test_next_rows_across_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    ids = [i * i % 1009 + 3 * i for i in range(500)]
    df = spark.createDataFrame([(i, f"t{i}") for i in sorted(set(ids))] + [(None, "none")], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, "doc_id", ["text"]).collect()}
    order = [None, *sorted(set(ids))]
    assert got == {k: ("none" if n is None else f"t{n}") for k, n in zip(order, [*order[1:], None], strict=True)}


def test_fingerprints_of_odd_tables(odd, nothing):
    assert fingerprints.edited_with_next(odd).count() == odd.count()
    assert fingerprints.edited_with_next(nothing).count() == 0
    alone = fingerprints.edited_with_next(odd.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0]["next_sketch"] == alone[0]["sketch"]


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([("a", " ".join(words[:2000])), ("a", " ".join(words[1000:])), ("b", None)], "k string, text string")
    df = df.withColumn("sketch", fingerprints.sketch(F.col("text")))
    merged = {r["k"]: r["n"] for r in fingerprints.merge_sketches(df.select("k", "sketch"), ["k"]).select("k", fingerprints.distinct_shingles(F.col("sketch")).alias("n")).collect()}
    assert merged["b"] == 0 and abs(merged["a"] - 2996) < 900
    whole, half = (F.array(*map(F.lit, range(0, n))).cast("array<bigint>") for n in (60, 30))
    assert spark.range(1).select(fingerprints.containment(half, whole), fingerprints.resemblance(whole, half)).first() == (1.0, 0.5)


# Toxicity


def test_toxicity_is_learnt_from_documents_that_are_not_held_out(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 40))
        if toxic := i % 5 == 0:
            for at in rng.choice(40, 3, replace=False):
                text[at] = str(rng.choice(["vilexx", "nastyyy"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1))
    model = toxicity.train(docs, known)
    judged = {r["doc_id"]: r for r in toxicity.score(docs, model, ["doc_id"]).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()}
    right = [judged[i]["predicted"] == y for i, y in labels if judged[i]["out"]]
    assert np.mean(right) > 0.97
    spans = judged[0]["spans"]
    assert {rows[0][1][s["start"] : s["end"]] for s in spans} <= {"vilexx", "nastyyy"} and len(spans) == 3
    again = toxicity.score(docs, toxicity.train(docs, known), ["doc_id"]).where("doc_id = 0").first()
    assert again["score"] == judged[0]["score"]


def test_marginals_match_the_plain_chain():
    model = toxicity.Model({"=x": 4.0}, -3.0, np.array([[0.0, -1.0], [-0.5, 0.7]]))
    lifts = [0.0, 4.0, 0.0, 0.0, 4.0, 4.0, 0.0]
    step = np.exp(model.moves)
    best = np.zeros(len(lifts))
    total, clean = 0.0, 0.0
    for path in np.ndindex(*[2] * len(lifts)):
        weight, before = 1.0, 0
        for s, x in zip(path, lifts, strict=True):
            weight *= step[before, s] * (np.exp(-3.0 + x) if s else 1.0)
            before = s
        total += weight
        clean += weight * (not any(s for s, x in zip(path, lifts, strict=True) if x))
        best += weight * np.array(path)
    places = [i for i, x in enumerate(lifts) if x]
    p, score = model.marginals(places, [4.0] * 3, len(lifts))
    assert np.allclose(p, (best / total)[places]) and np.isclose(score, 1 - clean / total)


def test_the_sample_is_bounded_by_documents_and_characters(spark):
    other = lambda i, j: "".join(chr(97 + (i * 7 + j * 3 + k * k) % 26) for k in range(5))
    docs = spark.createDataFrame([(i, " ".join(f"{'vile' if i % 2 else 'good'} {other(i, j)}" for j in range(10))) for i in range(90)] + [(1000, "x " * 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)] + [(1000, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is not None
    assert toxicity.train(docs, labels, sample_chars=80) is None  # no document is so short


def test_toxicity_of_odd_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    for frame in (odd, nothing):
        model = toxicity.train(frame, labels)
        assert model is None
        assert toxicity.score(frame, model, ["doc_id"]).where("score <> 0").count() == 0
        assert toxicity.drop_toxic(frame, labels).columns == frame.columns
    assert toxicity.drop_toxic(odd, labels).count() == odd.count()


# Decontamination

ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "A plain TEXT"), (3, None), (4, "?!"), (5, "word5"), (5, "word5 and token5"), (None, "two three four")]


@pytest.mark.parametrize("most", [300_000, 0])
def test_contamination(spark, odd, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("row", F.lit(1))
    got = decontaminate.find_contamination(odd.repartition(3), items, most=most)
    got = got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    key = lambda r: tuple(map(str, r.values()))
    want = brute.contamination(texts(odd), ITEMS)
    assert sorted((r.asDict() for r in got.collect()), key=key) == sorted(want, key=key)


def test_contamination_of_nothing(spark, odd, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(odd, none).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(nothing, none).count() == 0
    assert decontaminate.drop_contaminated(odd, none).count() == odd.count()


def test_rows_are_dropped_by_text_not_by_id(spark):
    item = " ".join(f"i{k}" for k in range(12))
    rows = [(None, f"clean text {k}") for k in range(9)] + [(None, f"x {item}"), (1, "clean"), (1, f"{item} y"), (2, None), (2, "")]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([r for r in rows if not r[1] or "i0" not in r[1]], "doc_id long, text string").collect()))


def test_only_whole_windows_within_the_text_are_hits(spark):
    items = [(k, " ".join(f"a{k} b c d e{k} f g h i{k} j k l m".split())) for k in range(5)]
    texts = [" ".join(items[k % 5][1].split()[a:b]) for k in range(40) for a, b in [(k % 4, 13 - k % 3)]]
    docs = list(enumerate([*texts, "b c d " * 40, " ".join(t for _, t in items) * 3]))
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in brute.contamination(docs, items)}
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()} == want
    assert 0 < sum(n > 0 for _, n, _ in want.values()) < len(docs)


# Mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    got = mixing.share_out(sizes, weights, 1.5 * sum(sizes), 2.0)
    assert np.allclose(got, brute.targets(sizes, weights, 1.5 * sum(sizes), 2.0), rtol=1e-9, atol=1e-6)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=5), st.integers(1, 9), st.integers(1, 4))
def test_split_deals_every_draw_once(draws, shards, most):
    kinds = np.arange(len(draws))
    seen, sizes = set(), []
    for path, first, n, *arrays in mixing.split(kinds, np.array(draws), np.zeros(len(draws), dtype=np.int64), shards, most):
        for _, _, one, k, d, b in mixing.split(*arrays, n, 1, mixing.SEED, first, path):
            assert one == 1
            sizes.append(int(d.sum()))
            drawn = {(int(i), x) for i, c, at in zip(k, d, b, strict=True) for x in range(at, at + c)}
            assert not seen & drawn
            seen |= drawn
    assert seen == {(i, x) for i, c in enumerate(draws) for x in range(c)}
    assert len(sizes) == shards and max(sizes) - min(sizes) <= shards


def test_shards_are_the_same_whoever_splits(spark, monkeypatch):
    draws = [300, 0, 7, 55, 120]
    rows = lambda: sorted(map(tuple, mixing.shard_draws(spark, draws, 37).collect()))
    one = rows()
    assert {s for _, s, _, _ in one} == set(range(37)) and sum(n for *_, n in one) == sum(draws)
    monkeypatch.setattr(mixing, "NODES", 1)
    assert rows() == one
    assert mixing.shard_draws(spark, [], 1).count() == mixing.shard_draws(spark, [0], 1).count() == 0


def test_mix_takes_what_is_due(spark):
    rows = [(i, f"s{i % 4}" if i % 7 else None, " ".join(["w"] * (i % 50))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    per_doc, each = mixing.mix(docs, block_words=300)
    taken = {}
    for r in per_doc.collect():
        size = len(rows[r["doc_id"]][2].split())
        assert r["size"] == size and r["taken"] <= 2 * size
        taken.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 1 for t, n in taken.values()) and len(taken) == 5
    assert each.agg(F.sum("words")).first()[0] == sum(n for _, n in taken.values())
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5), block_words=300)[0].collect()}
    assert again == {r["doc_id"]: r["taken"] for r in per_doc.collect()}
    mixed = mixing.mixed_documents(docs, block_words=300)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.size(F.expr("filter(split(text, ' '), x -> x <> '')")))).first()[0] == sum(n for _, n in taken.values())


def test_mix_of_odd_tables(odd, nothing):
    per_doc, _ = mixing.mix(odd)
    assert per_doc.count() == odd.count()
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(nothing)[0].count() == 0
    assert mixing.mixed_documents(nothing).count() == 0


# SimHash


def test_fingerprints_bit_by_bit():
    for text in ("", "a", "a b c d", "A b C d e f g", "é ü \t x", "w " * 300):
        assert simhash.fingerprint(text.encode()) == brute.simhash(text)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 63), max_size=7)), min_size=1, max_size=60), st.integers(1, 5))
def test_forest_finds_every_neighbour(draws, radius):
    pairs = sorted({(g, sum(1 << b for b in set(bits))) for g, bits in draws})
    groups, fps = np.array([g for g, _ in pairs]), np.array([f for _, f in pairs], dtype=np.uint64)
    forest = simhash.Forest(groups, fps)
    got = {(int(q), int(n)) for a, b in forest.search(groups, fps, radius) for q, n in zip(a, b, strict=True)}
    want = {(i, j) for i, a in enumerate(pairs) for j, b in enumerate(pairs) if a[0] == b[0] and (a[1] ^ b[1]).bit_count() <= radius}
    assert got == want


@pytest.mark.parametrize("piece", [4096, 3])
def test_components(spark, piece):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    fps = {}
    for i in range(240):
        x = base[i % 20] if i < 200 else int(rng.integers(0, 2**63))
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            x ^= 1 << int(b)
        fps[i] = x
    df = spark.createDataFrame([(int(np.array(x, dtype=np.uint64).view(np.int64)),) for x in set(fps.values())], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, piece=piece)).collect()}
    signed = {k: int(np.array(x, dtype=np.uint64).view(np.int64)) for k, x in fps.items()}
    want = brute.linked(fps)
    got = {}
    for k, x in signed.items():
        got.setdefault(roots.get(x, x), set()).add(k)
    groups = {}
    for k, c in want.items():
        groups.setdefault(c, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_near_duplicates_of_odd_tables(odd, nothing):
    got = {(r["doc_id"], r["fp"] & (2**64 - 1)): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    known = {k: simhash.fingerprint((t or "").encode()) for k, t in texts(odd) if k is not None}
    want = brute.linked(known)
    assert all(got[k, f] == want[k] for k, f in known.items())
    assert simhash.near_duplicates(odd).count() == odd.count()
    kept = sorted(r["doc_id"] for r in simhash.keep_one(odd).collect())
    assert kept == sorted(set(want.values()))
    assert simhash.near_duplicates(nothing).count() == 0


def test_trees_propose_what_bands_miss(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:200], "x", *words[201:]])), (3, "other words than these are here")], "doc_id long, text string")
    found = storage.materialise(simhash.signatures(docs), "signatures")
    apart = found.withColumn("bands", F.array_repeat(F.col("key"), simhash.BANDS))  # no band is shared
    distinct = storage.materialise(apart.select("key", "fp", "bands"), "distinct")
    groups = simhash.candidate_groups(distinct).collect()
    assert len(groups) == 2 and {g["n"] for g in groups} == {2}


def similar(rows: list[tuple[int, str]], similarity: float = 0.8) -> list[list[int]]:
    """Groups of ids by links of all pairs, by brute force."""
    sets = {k: brute.shingles(t) for k, t in rows}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and brute.jaccard(sets[a], sets[b]) >= similarity:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return sorted(sorted(k for k in root if root[k] == r) for r in set(root.values()))


@pytest.mark.parametrize("piece", [4096, 20])
def test_templated_texts_are_all_measured(spark, piece):
    rng = np.random.default_rng(7)
    template, rows = [f"t{i}" for i in range(150)], []
    for k in range(240):
        words = list(template)
        for at in rng.choice(150, int(rng.integers(2, 9)), replace=False):
            words[at] = f"v{rng.integers(0, 10**9)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = similar(rows)
    assert 20 < len(want) < 220 and max(map(len, want)) > 2
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [g[0] for g in want]
    found = storage.materialise(simhash.signatures(docs), "signatures")
    ids = {r["key"]: r["doc_id"] for r in found.collect()}
    groups = {}
    links = simhash.similar_links(docs, found, piece=piece)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    for key, k in ids.items():
        groups.setdefault(roots.get(key, key), []).append(k)
    assert sorted(map(sorted, groups.values())) == want


def test_recall_of_similar_pairs_over_the_smallest_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(k, "".join(c.lower() if c.isascii() else c for c in t or "")) for k, t in texts(docs)]
    want = similar(rows)
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    extra = [g for g in want if len(kept & set(g)) != 1]
    assert any(len(g) > 1 for g in want) and len(extra) <= 0.1 * sum(len(g) > 1 for g in want)
    assert all(kept & set(g) for g in want)  # no group is lost


def test_repeated_passages_dont_hide_copies(spark):
    rows = []
    for k in range(20):
        words, line = " ".join(f"w{k}x{i}" for i in range(150)), " ".join(f"l{k}x{i}" for i in range(10))
        rows += [(2 * k, f"{words} {line}"), (2 * k + 1, f"{words} " + " ".join([line] * 40))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 40, 2))


def test_rows_are_kept_by_text_not_by_id(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " end"), (None, texts[2]), (None, texts[2]), (3, texts[3]), (3, texts[4]), (4, texts[4]), (5, texts[5]), (5, texts[5] + " end"), (6, texts[6]), (6, texts[6]), (None, texts[7]), (7, texts[7] + " end")]
    kept = sorted((r["doc_id"] or 0, r["text"].removesuffix(" end")) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [(0, texts[0]), (0, texts[1]), (0, texts[2]), (3, texts[3]), (3, texts[4]), (5, texts[5]), (6, texts[6]), (7, texts[7])]


# WARC


def pages(spark):
    rows = [(1, "http://a/", "x"), (2, "http://b/\r\nX: y", "x"), (3, None, None), (4, "u", ""), (5, "é", "ü" * 50_000), (6, "u", "x"), (6, "u", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("k"))


@pytest.mark.parametrize("least", [0, 2])
def test_warc(spark, least):
    got = {(r["page_id"]): tuple(r)[1:] for r in warc.archive(pages(spark), least=least).collect()}
    want = brute.warc_rows([(r["page_id"], r["html"]) for r in pages(spark).dropDuplicates().collect()], least)
    assert got == want


def test_warc_of_nothing(spark):
    assert warc.archive(pages(spark).where("page_id < 0")).count() == 0
    null = pages(spark).withColumn("page_id", F.lit(None).cast("long"))
    assert warc.archive(null).count() == null.count()


# Token files


def test_memo_tokenizer_gives_the_librarys_ids(docs, spark, small):
    from tokenizers import Tokenizer

    memo, library = tokenizing.MemoTokenizer(tokenizing.default_path(), "<u4"), Tokenizer.from_file(tokenizing.default_path())
    odd = ["don't!! I'm", "x\u00a0y\u2003z", "<|endoftext|> a<|endoftext|>b", "e\u0301 É ſ İ ß ΑΣ Σ", "日本 한국, 123.45,", "a\x1cb", "....", "µ ª º", "\ufeffhey"]
    for text in [*odd, *(t for _, t in texts(docs) if t), *(t for _, t in texts(spark.read.parquet(f"{small}/documents.parquet")))]:
        assert np.frombuffer(memo.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    memo, library = tokenizing.MemoTokenizer(path, "<u2"), Tokenizer.from_file(path)
    assert not memo.apart
    for text in ("", "Hello World, two words", " a  b\n", "é 日本"):
        assert np.frombuffer(memo.encode(text.encode()), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_memos_are_bounded_and_keep_what_is_in_use():
    made = []
    memo = tokenizing.Memo(lambda k: made.append(k) or k * 2, most=3 * (tokenizing.ENTRY + 3))
    for k in (b"a", b"b", b"a", b"c", b"d", b"a", b"e"):
        assert memo[k] == k * 2
    assert made == [b"a", b"b", b"c", b"d", b"e"] and len(memo) + len(memo.older) <= 6


def test_token_files(spark, docs, nothing):
    folder = storage.scratch(spark, "tokens")
    files = token_output.write_tokens(docs, folder)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_tokens(files, docs.schema["doc_id"].dataType).collect()}
    assert got == brute.tokens(texts(docs), tokenizing.default_path(), token_output.STOP)
    empty = token_output.write_tokens(nothing, storage.scratch(spark, "tokens"))
    assert token_output.read_tokens(empty, docs.schema["doc_id"].dataType).count() == 0


def test_single_frames_and_broken_sums(tmp_path):
    import io

    import pyarrow as pa
    import zstandard

    stream = io.BytesIO()
    out = token_output.FrameFile(stream, "<u2", {})
    for ids in ([1, 2, 3], [], [7] * 1000):
        out.add(np.array(ids, dtype="<u2").tobytes())
    assert out.close(pa.array([10, None, 30])) == len(stream.getvalue())
    path = tmp_path / "x"
    path.write_bytes(stream.getvalue())
    reader = token_output.FrameReader(f"file://{path}")
    assert [x.tolist() for x in reader.ids(2)] == [[7] * 1000] and reader.doc_ids().to_pylist() == [10, None, 30]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(stream.getvalue()), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u2").tolist() == [1, 2, 3] + [7] * 1000  # any decoder skips the tables
    data = bytearray(stream.getvalue())
    data[-9 - 12 * 3 + 8] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError, match="sum"):
        next(token_output.FrameReader(f"file://{path}").ids(0))


# URL filter

URLS = [None, "", "no scheme", "http://example.org/en/1?x", "https://A.Example.ORG/es/", "x://org/", "http://org", "http://org?/x", "http://b.com/fr/1", "http://com/de/#/fr/", "http://www.spam-farm.example.com/x", "http://spam-farm.example.com/fr/x", "http://notexample.org/en/1", "a://b://org/"]


@pytest.mark.parametrize("shards", [8, 0])
def test_urls(spark, monkeypatch, shards):
    monkeypatch.setattr(url_filter, "OPEN_SHARDS", shards)
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("h"))
    about = url_filter.build_index(url_filter.default_list(spark), storage.scratch(spark, "urls"))
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(df, about).collect()}
    assert got == {i: brute.url_verdict(u, url_filter.RULES, url_filter.LISTED) for i, u in enumerate(URLS)}
    assert url_filter.filter_urls(df.where("page_id < 0"), about).count() == 0


@pytest.mark.parametrize("shards", [8, 2])
def test_urls_with_many_shards_and_without_keys(spark, monkeypatch, shards):
    monkeypatch.setattr(url_filter, "OPEN_SHARDS", shards)
    keys = spark.createDataFrame([(f"h{i}.net", "/" if i % 2 else "", "block" if i % 3 else "allow") for i in range(200)] + [("h1.net", "/", "allow")], "host string, path string, action string")
    about = url_filter.build_index(keys, storage.scratch(spark, "urls"), shard_keys=30)
    assert about["shards"] == 7
    df = spark.createDataFrame([(i, f"http://a.h{i}.net/p") for i in range(210)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, about).collect()}
    assert got == {i: (f"h{i}.net" + ("/" if i % 2 else ""), "block" if i % 3 else "allow") if i < 200 else (None, "allow") for i in range(210)}
    none = url_filter.build_index(keys.where("host = ''"), storage.scratch(spark, "urls"))
    assert {r["verdict"] for r in url_filter.filter_urls(df, none).collect()} == {"allow"}


def test_collided_digests_are_told_apart(tmp_path):
    import struct

    keys = [b"a\n", b"bb\n", b"c\n"]
    digests = np.array([7, 7, 9], dtype="<u8")
    offsets = np.cumsum([0] + [len(k) for k in keys], dtype="<u8")
    path = tmp_path / "s"
    path.write_bytes(struct.pack("<Q", 3) + digests.tobytes() + offsets.tobytes() + bytes([0, 1, 2]) + b"".join(keys))
    shard = url_filter.Shard(f"file://{path}")
    assert shard.find(np.array([7, 7, 7, 9, 5], dtype="<u8"), [b"bb\n", b"a\n", b"z\n", b"c\n", b"c\n"]).tolist() == [1, 0, -1, 2, -1]
