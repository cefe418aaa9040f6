"""Benchmark decontamination: a prefix-filtered set join with exact verification.

Each item's text is cut into windows of ten consecutive words (an item of fewer
words is one window), each window into shingles of up to four words. A text
contains a window only if it contains all its shingles, so for containment 1
the necessary prefix of a window, with shingles ordered by rarity in the
documents, is its single rarest shingle.

One pass over the documents counts how often each of the benchmark's shingles
occurs in each text: postings, whose sums by shingle are the order of rarity.
Prefix shingles alone are joined with the postings, and only the texts that have
one are read again. In these, places whose window would reach over an end of the
text are dropped, and the words of the other windows are compared with the
benchmark's word by word. Texts are known by their SHA-256, so that copies are
judged once and results reach every row with that text.

Everything is DataFrame code. Tables of hashes, places and results are broadcast
up to ``BROADCAST_ROWS`` rows, by count; beyond that both sides are shuffled.

Defined cases: null and empty texts have no words. Items without words have no
window. Very long texts are treated like others. Rows with equal texts are
judged alike, whatever their ids: null and repeated doc_ids make no difference.
Repeated item ids count once, a null item id as ``null``. Either table may be
empty. Other columns are ignored, or kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import few, materialise
from quire.llm.textcols import SEPARATORS, SEPARATORS_OF_ANY_CASE, ascii_lower, let, piece_count, pieces, text_or_empty

WINDOW = 10
SHINGLE = 4
#: Rows of two numbers and a hash of 32 bytes at most: 40 MB.
BROADCAST_ROWS = 300_000
NO_ITEMS = "array<string>"


def words_of(text: Column) -> Column:
    return pieces(ascii_lower(text_or_empty(text)), SEPARATORS)


def key_of(text: Column) -> Column:
    """What stands for a text in joins.

    It is never null, so that these need not compute it twice to see that, and
    made in a lambda, so that Spark doesn't put it off to each exploded row.
    """
    return F.coalesce(let(text_or_empty(text), lambda t: F.unhex(F.sha2(t, 256))), F.lit(b""))


def _runs(words: Column, width: Column | int) -> Column:
    """Every run of ``width`` words; ``width`` is at most the number of words."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.slice(words, i, width))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (wid, win), and which item has which (wid, item)."""
    cut = (
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .select("item", F.explode(_runs(F.col("words"), F.least(F.size("words"), F.lit(window)))).alias("win"))
        .distinct()
    )
    cut = materialise(cut, "windows")
    wins = materialise(cut.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()), "window-ids")
    return wins, materialise(cut.join(wins, "win").select("wid", "item"), "window-items")


def window_shingles(wins: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The shingles of windows: wid, size, width, off (words before it in the window), h."""
    width = F.least(F.size("win"), F.lit(shingle))
    cut = wins.select("wid", F.size("win").alias("size"), width.alias("width"), F.posexplode(_runs(F.col("win"), width)).alias("off", "run"))
    h = F.lit(None).cast("bigint")
    for w in range(1, shingle + 1):
        h = F.when(F.col("width") == w, F.xxhash64(*(F.get("run", j) for j in range(w)))).otherwise(h)
    return cut.select("wid", "size", "width", "off", h.alias("h"))


def document_shingles(docs: DataFrame, widths: list[int], *carried: Column) -> DataFrame:
    """All runs of words of ``widths`` in ``docs``: the ``carried`` columns, n_words, pos and h.

    Words next to each other are zipped and taken apart row by row, which Spark
    compiles into one loop: no row has more than the words of its run.
    """
    read = docs.select(*carried, words_of(F.col("text")).alias("w")).select("*", F.size("w").alias("n_words"))
    names = [f"w{j}" for j in range(max(widths))]
    zipped = F.arrays_zip(*(F.slice("w", j + 1, F.size("w")).alias(n) for j, n in enumerate(names)))
    kept = [c for c in read.columns if c != "w"]
    # Outer, so that the optimiser adds no test of the whole array before; nothing after it needs the array.
    runs = read.select(*kept, F.posexplode_outer(zipped).alias("pos", "run"))
    hashes = [F.when(F.col(f"run.w{n - 1}").isNotNull(), F.xxhash64(*(F.col(f"run.{x}") for x in names[:n]))) for n in widths]
    h = hashes[0] if len(hashes) == 1 else F.explode(F.array(*hashes))
    return runs.select(*kept, "pos", h.alias("h")).where("h is not null")


def occurrences(docs: DataFrame, wins: DataFrame, shingle: int = SHINGLE, most: int = BROADCAST_ROWS) -> DataFrame:
    """Where windows occur: key (of the text), start (words before it), size and wid."""
    cut = materialise(window_shingles(wins, shingle), "window-shingles")
    widths = sorted(r[0] for r in cut.select("width").distinct().collect()) or [shingle]  # at most ``shingle`` rows
    wanted = few(materialise(cut.select("h").distinct(), "shingles"), most)
    found = document_shingles(docs, widths, key_of(F.col("text")).alias("key")).join(wanted, "h")
    postings = materialise(found.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n")), "postings")
    rarity = postings.groupBy("h").agg(F.sum("n").alias("n"))
    # A window with a shingle that no document has cannot occur.
    prefix = (
        cut.join(rarity, "h", "left")
        .groupBy("wid", "size")
        .agg(F.min(F.struct("n", "off", "h")).alias("rarest"), F.min(F.col("n").isNotNull()).alias("can"))
        .where("can")
        .select("rarest.h", "rarest.off", "size")
        .distinct()
    )
    prefix = few(materialise(prefix, "prefixes"), most)
    keys = few(materialise(postings.join(prefix.select("h").distinct(), "h", "left_semi").select("key").distinct(), "candidates"), most)
    texts = docs.select(key_of(F.col("text")).alias("key"), "text").join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    texts = materialise(texts, "candidate-texts")
    start = F.col("pos") - F.col("off")
    places = (
        document_shingles(texts, widths, F.col("key"))
        .join(prefix, "h")
        .where((start >= 0) & (start + F.col("size") <= F.col("n_words")))  # positional and length bounds
        .select("key", start.alias("start"), "size")
        .distinct()
    )
    by_text = places.groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("places"))  # no more than words and sizes of windows
    words = texts.join(by_text, "key").select("key", "places", words_of(F.col("text")).alias("w"))
    cuts = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["size"].alias("size"), F.slice("w", p["start"] + 1, p["size"]).alias("win")))
    found = words.select("key", F.inline(cuts))
    known = few(wins.select(F.xxhash64("win").alias("hash"), F.col("win").alias("known"), "wid"), most)
    met = found.withColumn("hash", F.xxhash64("win")).join(known, "hash").where("win = known")
    return materialise(met.select("key", "start", "size", "wid"), "held")


def find_by_text(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most: int = BROADCAST_ROWS) -> DataFrame:
    """key, n_hit and items for each text of ``docs`` in which a window of ``benchmark`` occurs."""
    wins, has = benchmark_windows(benchmark, window)
    held = occurrences(docs, wins, shingle, most)

    def grow(state: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        fresh = F.greatest(F.lit(0), end - F.greatest(x["start"], state["end"]))
        return F.struct(F.greatest(end, state["end"]).alias("end"), (state["n"] + fresh).alias("n"))

    hits = (
        held.groupBy("key")
        .agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"))  # no more than words and sizes of windows
        .select("key", F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), grow, lambda s: s["n"].cast("long")).alias("n_hit"))
    )
    items = held.select("key", "wid").distinct().join(few(has, most), "wid").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return materialise(hits.join(items, "key"), "contaminated")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most: int = BROADCAST_ROWS) -> DataFrame:
    """Windows of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text).

    One row for each row of ``docs``: doc_id, n_words, n_hit (words inside any
    occurrence), n_items, and items, the ids with occurring windows, sorted as
    strings.
    """
    found = find_by_text(docs, benchmark, window, shingle, most)
    rows = docs.select("doc_id", key_of(F.col("text")).alias("key"), piece_count(F.col("text"), SEPARATORS_OF_ANY_CASE).cast("long").alias("n_words"))
    return rows.join(few(found, most), "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast(NO_ITEMS)).alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows in whose text a window of the benchmark occurs."""
    hit = find_by_text(docs, benchmark, most=most).select(F.col("key").alias("_hit"))
    return docs.withColumn("_text_key", key_of(F.col("text"))).join(few(hit, most), F.col("_text_key") == F.col("_hit"), "left_anti").select(*docs.columns)
