"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; Spark prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a given schema; what doesn't parse is kept in ``_corrupt``."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*wanted.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified and a JSON fingerprint of each file, without reading its content."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.withColumn("fingerprint", F.to_json(F.struct("path", "length", "modified")))


def same_file(a, b):
    """Whether two fingerprints are of one file: equal size and time, else equal text."""
    part = lambda x, p: F.get_json_object(x, p)
    known = part(a, "$.length").isNotNull() & part(b, "$.length").isNotNull()
    same = (part(a, "$.length") == part(b, "$.length")) & part(a, "$.modified").eqNullSafe(part(b, "$.modified"))
    return F.when(known, same).otherwise(a.eqNullSafe(b))


def valid_cache(cache: DataFrame, schema: int, pipeline: str) -> DataFrame:
    """Cache rows of the current form with a status that stands; ``recognized`` needs a payload."""
    good = F.col("status").isin("noMatch", "textlessPDF") | ((F.col("status") == "recognized") & F.col("payload").isNotNull())
    return cache.where((F.col("schema") == schema) & (F.col("pipeline") == pipeline) & good)


def records_from_long(fields: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """Records with a map of their fields that aren't empty, in order of field."""
    stated = fields.where(F.coalesce(value, F.lit("")) != "")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(field).alias("key"), F.col(value).alias("value"))))
    return stated.groupBy(key).agg(F.map_from_entries(pairs).alias("fields"))


def lines_of_words(words: DataFrame, document: str = "doc_id", page: str = "page") -> DataFrame:
    """Lines from positioned words (x, y, text): rows of a page with the same rounded y, ordered by x."""
    parts = F.sort_array(F.collect_list(F.struct("x", "text")))
    return words.groupBy(document, page, F.round("y").cast("long").alias("row")).agg(F.array_join(F.transform(parts, lambda w: w["text"]), " ").alias("line"))


def front_matter(pages: DataFrame, document: str = "doc_id", page: str = "page", text: str = "text", most_pages: int = 5, characters: int = 60_000) -> DataFrame:
    """The first pages of each document as one text, form feeds between them, cut to a length."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t"))))
    joined = F.array_join(F.transform(parts, lambda x: x["t"]), "\f")
    return pages.where(F.col(page) <= most_pages).groupBy(document).agg(F.left(joined, F.lit(characters)).alias("front"))


def body_sample(text, width: int = 2400):
    """Up to three stretches of a long text, at 40, 50 and 60 percent of it."""
    n = F.char_length(text)
    cut = lambda share: F.substring(text, F.floor(n * share).cast("int") + 1, F.lit(width))
    return F.when(n > 3 * width, F.concat_ws("\n", cut(0.4), cut(0.5), cut(0.6))).otherwise(text)


def fixtures_for(urls: DataFrame, fixtures: DataFrame) -> DataFrame:
    """The first fixture (ordinal, match, is_regex, ...) that fits each url.

    ``fixtures`` is a short list for tests; it is counted before it is broadcast.
    """
    from quire.operators.joins import small

    fits = F.when(F.col("is_regex"), F.rlike("url", F.col("match"))).otherwise(F.contains("url", F.col("match")))
    met = urls.join(small(fixtures), fits)
    first = met.groupBy("url").agg(F.min_by(F.struct(*fixtures.columns), "ordinal").alias("f"))
    return first.select("url", "f.*")


def text_states(items: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Each item's state in a text cache (``content``, ``readable``): missing, unreadable, empty or present."""
    met = items.join(cache.select(key, "content", "readable"), key, "left")
    empty = F.trim(F.coalesce("content", F.lit("")), F.lit(" \t\r\n\f")) == ""
    state = F.when(F.col("readable").isNull(), "missing").when(~F.col("readable"), "unreadable").when(empty, "empty").otherwise("present")
    return met.select(key, state.alias("state"))


def cached_row_counts(bodies: DataFrame, body: str) -> DataFrame:
    """How many cached rows in JSON parse, are corrupt, name no item, or name one that another does; the item may be in the row's fingerprint."""
    parsed = F.try_parse_json(body).isNotNull()
    key = F.coalesce(F.get_json_object(body, "$.key"), F.get_json_object(F.get_json_object(body, "$.print"), "$.key"))
    rows = bodies.select(parsed.alias("parsed"), F.when(parsed, key).alias("key"))
    n = lambda c: F.count(F.when(c, 1))
    keyed = F.col("key").isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("files"), n(F.col("parsed")).alias("parsed"), n(~F.col("parsed")).alias("corrupt"), n(F.col("parsed") & ~keyed).alias("without_key"), (n(keyed) - F.count_distinct("key")).alias("duplicates")
    )


#: Pages that are read of a transcript, and characters of a page's text and layout.
PAGES, TEXT, LAYOUT = 12, 12_000, 24_000


def transcript_pages(transcripts: DataFrame, document: str, text: str) -> DataFrame:
    """Pages of transcripts with marks ``--- PAGE n ---``: page, text, layout and whether the text was cut; blank ones are left out."""
    mark = r"(?m)^--- PAGE (\d+) ---[^\S\n]*\n?"
    numbers = F.regexp_extract_all(text, F.lit(mark), F.lit(1))
    bodies = F.split(text, mark, -1)
    each = F.arrays_zip(numbers.alias("page"), F.slice(bodies, F.lit(2), F.size(numbers)).alias("body"))
    rows = transcripts.select(document, F.inline(each)).select(document, F.col("page").try_cast("int").alias("page"), F.trim(F.replace(F.col("body"), F.lit("\f"), F.lit("")), F.lit(" \t\r\n")).alias("body"))
    kept = rows.where(F.col("page").between(1, PAGES) & (F.col("body") != ""))
    return kept.select(document, "page", F.left("body", F.lit(TEXT)).alias("text"), F.left("body", F.lit(LAYOUT)).alias("layout"), (F.char_length("body") > TEXT).alias("truncated"))
